"""Call resolution on candidate tables: chains of strategies, narrowing, fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import last_segment

# Fan-out limits and discounts.
CAP_FLOOR, CONE_MAX = 16, 8


def first_verdict(verdicts: DataFrame, call: str = "call_id") -> DataFrame:
    """The outcome of an ordered chain per call.

    verdicts: call_id, priority, verdict (resolved, deferred, drop, continue), target.  The
    first resolved or drop ends the chain.  A resolved target counts; a drop, or a chain
    without either, leaves the first deferred target before its end, if any.
    """
    stop = F.min(F.when(F.col("verdict").isin("resolved", "drop"), F.struct("priority", "verdict", "target")))
    parked = F.min(F.when(F.col("verdict") == "deferred", F.struct("priority", "target")))
    out = verdicts.groupBy(call).agg(stop.alias("stop"), parked.alias("parked"))
    early = F.when(F.col("parked").isNotNull() & (F.col("stop").isNull() | (F.col("parked.priority") < F.col("stop.priority"))), F.col("parked.target"))
    hit = F.col("stop.verdict").eqNullSafe("resolved")
    outcome = F.when(hit | early.isNotNull(), "resolved").when(F.col("stop").isNotNull(), "dropped").otherwise("unresolved")
    return out.select(call, outcome.alias("outcome"), F.when(hit, F.col("stop.target")).otherwise(early).alias("target"))


def first_component(edges: DataFrame, call: str = "call_id", order: str = "component") -> DataFrame:
    """All edges of the first component that has any for a call."""
    w = Window.partitionBy(call)
    return edges.withColumn("_first", F.min(order).over(w)).where(F.col(order) == F.col("_first")).drop("_first")


def arity_fits(n: Column, low: Column, high: Column, splat: Column | None = None) -> Column:
    """Unknown bounds fit; else low <= n <= high, and any n from low on with a splat."""
    open_ended = F.coalesce(splat, F.lit(False)) if splat is not None else F.lit(False)
    return n.isNull() | low.isNull() | ((n >= low) & (open_ended | high.isNull() | (n <= high)))


def keywords_fit(given: Column, required: Column, declared: Column, splat: Column) -> Column:
    """Required keywords are given, and given ones declared unless there is a splat."""
    return given.isNull() | ((F.size(F.array_except(required, given)) == 0) & (F.coalesce(splat, F.lit(False)) | declared.isNull() | (F.size(F.array_except(given, declared)) == 0)))


def narrowed(candidates: DataFrame, call: str = "call_id") -> DataFrame:
    """Candidates that fit a call's arity, keywords, visibility and block.

    Block acceptors are kept alone only where a call passes a block and any accepts one.
    """
    fits = arity_fits(F.col("n_args"), F.col("min_args"), F.col("max_args"), F.col("splat")) & (F.coalesce("visibility", F.lit("public")) != "private")
    if "given_keywords" in candidates.columns:
        fits = fits & keywords_fit(F.col("given_keywords"), F.col("required_keywords"), F.col("declared_keywords"), F.col("keyword_splat"))
    rows = candidates.where(fits)
    takes = F.coalesce("accepts_block", F.lit(False))
    some = F.max(takes.cast("int")).over(Window.partitionBy(call)) == 1
    return rows.withColumn("_keep", ~(F.coalesce("has_block", F.lit(False)) & some) | takes).where("_keep").drop("_keep")


def fan_out(candidates: DataFrame, cap, discount: float = 1.0, call: str = "call_id") -> DataFrame:
    """One candidate: confidence 1; up to the cap: discount / n each; more: ambiguous."""
    n = F.count("*").over(Window.partitionBy(call))
    rows = candidates.withColumn("n_candidates", n)
    over = F.col("n_candidates") > cap
    conf = F.when(F.col("n_candidates") == 1, 1.0).when(over, None).otherwise(F.lit(float(discount)) / F.col("n_candidates"))
    return rows.withColumn("confidence", conf).withColumn("ambiguous", over)


def fan_out_cap(symbols: DataFrame) -> DataFrame:
    """One row: the nearest-rank p99 of definitions per short name, 16 at least."""
    per = symbols.groupBy("short_name").agg(F.count("*").alias("n"))
    return per.agg(F.greatest(F.lit(CAP_FLOOR), F.coalesce(F.expr("percentile_disc(0.990000000001) WITHIN GROUP (ORDER BY n)"), F.lit(0)).cast("int")).alias("cap"))


def cone(calls: DataFrame, inheritance: DataFrame, symbols: DataFrame, instantiated: DataFrame | None = None, cone_max: int = CONE_MAX) -> DataFrame:
    """Calls on a receiver typed as a base: one edge per overriding subtype, or one to the base.

    calls: call_id, receiver_type, member; inheritance: source_fq_name, ancestor_fq_name;
    symbols: symbol_id.  n overriding subtypes up to ``cone_max`` give edges of 1 / n each.
    """
    own = calls.join(inheritance.select(F.col("ancestor_fq_name").alias("receiver_type"), F.col("source_fq_name").alias("subtype")), "receiver_type").withColumn("target", F.concat("subtype", F.lit("#"), "member"))
    own = own.join(symbols.select(F.col("symbol_id").alias("target")).distinct(), "target", "left_semi")
    if instantiated is not None:
        own = own.join(instantiated.select(F.col("type").alias("subtype")).distinct(), "subtype", "left_semi")
    n = F.count("*").over(Window.partitionBy("call_id"))
    few = own.withColumn("n", n).where(F.col("n") <= cone_max).select("call_id", "target", F.lit("cone").alias("edge_kind"), (1 / F.col("n")).alias("confidence"))
    base = calls.join(few.select("call_id").distinct(), "call_id", "left_anti").select("call_id", F.concat("receiver_type", F.lit("#"), "member").alias("target"), F.lit("poly-base").alias("edge_kind"), F.lit(1.0).alias("confidence"))
    return few.unionByName(base)


def external_calls(calls: DataFrame, names: DataFrame) -> DataFrame:
    """Calls (receiver, member) with ``external``: whether they name an entry of a vocabulary (one column).

    A bare call is looked up by its member, another by its receiver and by both together.
    """
    known = names.select(F.col(names.columns[0]).alias("_name")).distinct()
    at = F.explode(F.when(F.col("receiver").isNull(), F.array("member")).otherwise(F.array("receiver", F.concat("receiver", F.lit("."), "member"))))
    hits = calls.select("call_id", at.alias("_name")).join(known, "_name", "left_semi").select("call_id").distinct().withColumn("external", F.lit(True))
    return calls.join(hits, "call_id", "left").withColumn("external", F.coalesce("external", F.lit(False)))


def miss(calls: DataFrame, definitions: DataFrame, core: list[str] = ()) -> DataFrame:
    """Why a call has no target.  calls: call_id, receiver_kind, member, dynamic, external."""
    known = definitions.select(last_segment("symbol_id").alias("member")).distinct().withColumn("_known", F.lit(True))
    out = calls.join(known, "member", "left")
    why = F.when(F.coalesce("dynamic", F.lit(False)), "unresolvable").when(F.coalesce("external", F.lit(False)), "external_skipped").when(F.col("_known").isNull(), "no_in_project_def")
    why = why.when(F.col("member").isin(list(core)) & ~F.col("receiver_kind").isin("localVar", "selfMember", "bareCall"), "core_ambiguous") if core else why
    return out.select("call_id", why.otherwise("miss").alias("why"))


def tally(outcomes: DataFrame) -> DataFrame:
    """(language, receiver_kind, counts): outcomes of all calls for the run statistics."""
    kinds = ("resolved", "external_skipped", "unresolvable", "no_in_project_def", "ambiguous_fanout", "core_ambiguous")
    return outcomes.groupBy("language", "receiver_kind").agg(F.count("*").alias("attempted"), *[F.sum((F.col("outcome") == k).cast("bigint")).alias(k) for k in kinds])


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, import_text): imports whose last segment is a file's name, first per target."""
    stem = F.regexp_extract("rel_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    byname = files.select(F.col("rel_path").alias("dst"), stem.alias("stem"))
    met = imports.withColumn("stem", F.element_at(F.split("import_text", r"[./:]+"), -1)).join(byname, "stem").where("src != dst")
    w = Window.partitionBy("src", "dst").orderBy("position")
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("src", "dst", "import_text")
