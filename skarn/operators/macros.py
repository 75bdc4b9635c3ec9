"""Class-body macros: the methods they declare and the calls they stand for.

Rules are rows (see ``plans.ruby_vocabulary``), so what a library adds is a join of macro calls with
its rows: each operand of a call meets each pattern of its macro and gives a symbol, and each link
gives an edge.  Inflection is Column expressions.

macro calls: call_id, rel_path, scope, source_symbol_id, macro, args (array of kind, value) where a kind is
``symbol``, ``string``, ``constant``, or a keyword's name with a colon (``to:``), in order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import ruby_vocabulary as V
from .resolution import camel

ARGS = "array<struct<kind:string,value:string>>"


def rules(spark: SparkSession, gems: Iterable[str] | None = None) -> DataFrame:
    """(framework, macro, category, operands, links, makes): one row per macro of the active frameworks."""
    rows = [(f["framework"], name, m["category"], m["operands"], m["links"], m["makes"]) for f in V.active(None if gems is None else set(gems)) for name, m in f["macros"].items()]
    return F.broadcast(spark.createDataFrame(rows, "framework string, macro string, category string, operands string, links string, makes array<string>"))  # some 150 rows


def words(spark: SparkSession, facet: str, gems: Iterable[str] | None = None) -> DataFrame:
    """(framework, name) of a facet: builtins, ambiguous, instances, relations, structured, receiver_prefixes or enqueue (with ``runs``)."""
    found = [(f["framework"], w, f[facet][w] if isinstance(f[facet], dict) else None) for f in V.active(None if gems is None else set(gems)) for w in f.get(facet, [])]
    return spark.createDataFrame(found, "framework string, name string, runs string").distinct()


def external(spark: SparkSession, gems: Iterable[str] | None = None) -> DataFrame:
    """(name): bare calls that are not a project's own: macros, and what the active frameworks bring at run time."""
    return rules(spark, gems).select(F.col("macro").alias("name")).union(words(spark, "builtins", gems).select("name")).distinct()


def singular(word: Column) -> Column:
    """``companies`` -> ``company``, ``boxes`` -> ``box``, ``users`` -> ``user``; other words stay."""
    return (
        F.when(word.endswith("ies"), F.concat(F.regexp_replace(word, "ies$", ""), F.lit("y")))
        .when(word.rlike("(?:xes|ses|shes|ches)$"), F.regexp_replace(word, "es$", "")).when(word.endswith("s") & ~word.endswith("ss"), F.regexp_replace(word, "s$", "")).otherwise(word)
    )


def _names(args: Column, operands: Column) -> Column:
    """The operands of a call: leading symbols, the first, those after the first, or a literal name."""
    plain = F.filter(args, lambda a: a["kind"].isin("symbol", "string"))
    other = F.array_min(F.transform(F.filter(F.transform(args, lambda a, i: F.struct(i.alias("i"), a["kind"].alias("kind"))), lambda a: ~a["kind"].isin("symbol", "string")), lambda a: a["i"]))
    leading = F.slice(args, 1, F.coalesce(other, F.size(args)))
    values = lambda xs: F.transform(xs, lambda a: a["value"])
    return (
        F.when(operands.isin("first", "name"), values(F.slice(plain, 1, 1))).when(operands == "rest", values(F.slice(plain, 2, F.greatest(F.size(plain) - 1, F.lit(0)))))
        .otherwise(values(leading))
    )


def declared(calls: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(call_id, framework, rel_path, symbol_id, short_name, scope): the methods that macros declare."""
    on = calls.where("scope IS NOT NULL").join(vocabulary, "macro")
    each = on.select("call_id", "framework", "rel_path", "scope", "args", "operands", F.explode("makes").alias("pattern"))
    whole = ~F.contains("pattern", F.lit("{"))
    named = each.select("call_id", "framework", "rel_path", "scope", "pattern", F.explode(F.when(whole, F.array(F.lit(""))).otherwise(_names(F.col("args"), F.col("operands")))).alias("operand"))
    made = F.replace(F.replace("pattern", F.lit("{one}"), singular(F.col("operand"))), F.lit("{}"), F.col("operand"))
    out = named.withColumn("made", made)
    return out.select("call_id", "framework", "rel_path", F.concat("scope", "made").alias("symbol_id"), F.substring("made", 2, 1 << 20).alias("short_name"), "scope").distinct()


def _keyword(args: Column, name: str) -> Column:
    return F.get(F.transform(F.filter(args, lambda a: a["kind"] == f"{name}:"), lambda a: a["value"]), F.lit(0))


def linked(calls: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(call_id, link, target): what macros refer to, as a symbol id or a constant; it need not be defined.

    ``own-method``: each operand, on the own type; ``model``: the association's class, by ``class_name:`` or
    its name in the singular; ``second-symbol``: the method that an alias stands for; ``delegate``: the
    operand on the class that ``to:`` names; ``route``: the action of ``"things#act"``; ``policy``, ``ability``,
    ``ability-subject``: the constant or the class of the first operand; ``serialized``: the operand on the model
    that the serializer's name says.
    """
    on = calls.join(vocabulary.where("links IS NOT NULL"), "macro").where("scope IS NOT NULL OR links = 'route'")
    args, scope = F.col("args"), F.col("scope")
    names = _names(args, F.lit(None).cast("string"))
    plain = F.transform(F.filter(args, lambda a: a["kind"].isin("symbol", "string")), lambda a: a["value"])
    constant = F.get(F.transform(F.filter(args, lambda a: a["kind"] == "constant"), lambda a: a["value"]), F.lit(0))
    own = F.transform(names, lambda n: F.concat(scope, F.lit("#"), n))
    model = F.transform(names, lambda n: F.coalesce(_keyword(args, "class_name"), camel(singular(n))))
    second = F.when(F.size(plain) >= 2, F.array(F.concat(scope, F.lit("#"), F.get(plain, F.lit(1)))))
    through = _keyword(args, "to")
    delegate = F.when(through.isNotNull(), F.transform(names, lambda n: F.concat(camel(singular(through)), F.lit("#"), n)))
    spec = F.coalesce(_keyword(args, "to"), F.get(F.filter(plain, lambda p: F.contains(p, F.lit("#"))), F.lit(0)))
    path = F.split(spec, "#")
    controller = F.array_join(F.transform(F.split(F.get(path, F.lit(0)), "/"), camel), "::")
    route = F.when(F.contains(spec, F.lit("#")), F.array(F.concat(controller, F.lit("Controller#"), F.get(path, F.lit(1)))))
    subject = F.array(F.coalesce(constant, camel(singular(F.get(plain, F.lit(0))))))
    policy = F.transform(subject, lambda s: F.concat(s, F.lit("Policy")))
    serialized = F.transform(names, lambda n: F.concat(F.regexp_replace(scope, "Serializer$", ""), F.lit("#"), n))
    link = F.col("links")
    targets = (
        F.when(link == "own-method", own).when(link == "model", model).when(link == "second-symbol", second).when(link == "delegate", delegate).when(link == "route", route).when(link == "policy", policy)
        .when(link.isin("ability", "ability-subject"), subject).when(link == "serialized", serialized)
    )
    return on.select("call_id", link.alias("link"), F.explode(targets).alias("target")).where("target IS NOT NULL").distinct()


def extended(symbols: DataFrame, calls: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The symbols with those that macros declare and that are not written out."""
    made = declared(calls, vocabulary).select(F.lit("ruby").alias("language"), "rel_path", "symbol_id", "short_name", "scope").distinct()
    return symbols.unionByName(made.join(symbols.select("symbol_id"), "symbol_id", "left_anti"), allowMissingColumns=True)


def column_types(schema: DataFrame) -> DataFrame:
    """schema (table, column, type) with ``ruby_type``, the class of a column's values; unknown types have none."""
    known = F.create_map(*[F.lit(x) for k, v in V.COLUMN_TYPES.items() for x in (k, v)])
    return schema.withColumn("ruby_type", known[F.col("type")])
