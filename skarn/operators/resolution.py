"""Call resolution: which definition a call in a source file means, language by language.

Everything is a join.  A strategy turns the calls of a language into verdicts (resolved,
deferred, drop) with the tables of ``Facts``; a language's chain is an ordered list of
strategies; ``dispatch.first_verdict`` decides per call.  Before the chain come the
components that give a call several targets: registries, unions, overriding subtypes.

A target is (file, symbol); a file alone is a weak target.  Where several definitions fit, a
strategy does not guess.  Names are looked up within one language.

* calls: call_id, language, rel_path, line, source_symbol_id, scope, receiver, member, and
  n_args, given_keywords, keyword_splat, has_block, dynamic (all may be null);
* symbols: language, rel_path, symbol_id, short_name, scope, and min_args, max_args, splat,
  required_keywords, declared_keywords, visibility, accepts_block, is_column;
* imports: language, rel_path, position, import_text, names (what it binds);
* bindings: rel_path, owner, name, line, type, is_class; call_bindings: the same with ``function``;
* fields: language, scope, field, type; returns: language, function, type;
* inheritance: language, source_fq_name, ancestor_fq_name, kind, ordinal;
* registries: language, name, type (values of registry constants); unions: rel_path, owner, name, type;
* arguments: call_id, position, type, name; parameters: function, position, name (see ``folded``).
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .dispatch import CONE_MAX, fan_out_cap, first_verdict, narrowed, tally

#: More edges from one file than this mean generated code; its method edges are left out.
EDGE_CAP = 10_000
#: Share of confidence that a fan-out over an untyped receiver keeps.
DYNAMIC_DISCOUNT = 0.5
ANCESTOR_DEPTH = 30

# Types that every Java file sees.
JAVA_LANG = [
    "String", "Integer", "Long", "Double", "Float", "Boolean", "Byte", "Short", "Character", "Math", "System", "Object", "Thread", "Runtime", "Class", "Number", "StringBuilder",
    "StringBuffer", "Iterable", "Comparable", "Runnable", "CharSequence", "Throwable", "Exception", "RuntimeException", "Error", "Void", "Enum", "Record", "Process", "ClassLoader",
]
# Calls in a Ruby receiver that build a query.
RELATION_BUILDERS = [
    "where", "order", "joins", "select", "group", "having", "includes", "eager_load", "preload", "limit", "offset", "distinct", "ransack", "unscope", "reorder", "except", "pluck",
]
# Methods that Ruby itself calls.
RUNTIME_HOOKS = [
    "method_missing", "respond_to_missing?", "method_added", "method_removed", "inherited", "included", "extended", "prepended", "const_missing", "singleton_method_added",
]
# Verbs that enqueue a job, and the method the job runs.
ENQUEUE = {"perform_async": "perform", "perform_in": "perform", "perform_at": "perform", "perform_later": "perform", "perform_bulk": "perform"}
# Members that any object may answer; no fan-out over them says anything.
DUCK_MEMBERS = [
    "call", "each", "map", "to_s", "to_h", "to_a", "to_json", "inspect", "name", "id", "size", "length", "empty?", "present?", "blank?", "nil?", "==", "hash", "dup", "freeze", "send",
    "public_send",
]

CONSTANT = r"^[A-Z][A-Za-z0-9_]*(?:::[A-Z][A-Za-z0-9_]*)*$"


@dataclass
class Facts:
    """The tables of one run (see the module's text); ``ancestors`` is made from inheritance."""

    calls: DataFrame
    symbols: DataFrame
    imports: DataFrame
    bindings: DataFrame
    fields: DataFrame
    inheritance: DataFrame
    returns: DataFrame
    call_bindings: DataFrame
    registries: DataFrame | None = None
    unions: DataFrame | None = None
    arguments: DataFrame | None = None
    parameters: DataFrame | None = None
    ancestors: DataFrame = field(init=False)
    is_written: bool = field(init=False, default=False)

    def __post_init__(self) -> None:
        if "is_column" not in self.symbols.columns:
            self.symbols = self.symbols.withColumn("is_column", F.lit(False))
        self.defined = self.symbols.where(~F.coalesce("is_column", F.lit(False)))
        self.ancestors = ancestors(self.inheritance)
        self.files = self.symbols.select("language", "rel_path").union(self.calls.select("language", "rel_path")).distinct()

    def of(self, *languages: str) -> DataFrame:
        return self.calls.where(F.col("language").isin(*languages))

    def settled(self) -> Facts:
        """The same facts, each table written once and spread out, so that the strategies of a run do not make it again each."""
        if self.is_written:
            return self
        out = copy.copy(self)
        # a number of its own, as Spark would merge parts that it takes for small, and every strategy then reads calls in few tasks
        cores = self.calls.sparkSession.sparkContext.defaultParallelism
        out.calls, out.symbols = written(self.calls.repartition(cores, "call_id"), "calls"), written(self.symbols.repartition("language", "rel_path", "symbol_id"), "symbols")
        for name in ("imports", "bindings", "fields", "inheritance", "returns", "call_bindings", "registries", "unions", "arguments", "parameters"):
            if getattr(self, name) is not None:
                setattr(out, name, written(getattr(self, name), name))
        out.defined = out.symbols.where(~F.coalesce("is_column", F.lit(False)))
        out.files = written(out.symbols.select("language", "rel_path").union(out.calls.select("language", "rel_path")).distinct(), "files")
        out.is_written = True
        return out


def ancestors(inheritance: DataFrame, depth: int = ANCESTOR_DEPTH) -> DataFrame:
    """(language, scope, ancestor, rank): all types above a type, nearest first, in declared order.

    A type met again keeps its first rank, so a cycle ends; deeper than ``depth`` is an error.
    """
    step = inheritance.select("language", F.col("source_fq_name").alias("scope"), F.col("ancestor_fq_name").alias("ancestor"), F.array((F.col("ordinal") + 1).cast("int")).alias("rank")).where("scope != ancestor")
    step = written(step, "inheritance")
    up = step.select("language", F.col("scope").alias("ancestor"), F.col("ancestor").alias("above"), F.col("rank").alias("last"))
    best = lambda df: df.groupBy("language", "scope", "ancestor").agg(F.min(F.struct(F.size("rank").alias("n"), "rank")).alias("r")).select("language", "scope", "ancestor", "r.rank")
    frontier = written(best(step), "ancestors")
    levels = [frontier]
    for _ in range(depth):
        # both sides grow with the types, so neither goes through the driver
        met = frontier.join(up.hint("merge"), ["language", "ancestor"]).where("scope != above").select("language", "scope", F.col("above").alias("ancestor"), F.concat("rank", "last").alias("rank"))
        seen = reduce(DataFrame.unionByName, levels)
        frontier = written(best(met.join(seen.hint("merge"), ["language", "scope", "ancestor"], "left_anti")), "ancestors")
        if frontier.isEmpty():
            return written(seen.repartition("language", "scope", "ancestor"), "ancestors")
        levels.append(frontier)
    raise ValueError(f"types inherit over more than {depth} levels")


# -- what strategies are made of -----------------------------------------------


def sole(candidates: DataFrame, order: list[str] = ()) -> DataFrame:
    """(call_id, file, target) of calls with exactly one candidate, in the first group of ``order`` that has just one."""
    one = candidates.select("call_id", *order, "file", "target").distinct().groupBy("call_id", *order).agg(F.count("*").alias("n"), F.min(F.struct("file", "target")).alias("t")).where("n = 1")
    if order:
        one = one.groupBy("call_id").agg(F.min(F.struct(*order, "t")).alias("m")).select("call_id", "m.t")
    return one.select("call_id", "t.file", "t.target")


def _symbols(t: Facts, *names: str) -> DataFrame:
    return t.defined.select("language", F.col("rel_path").alias("file"), F.col("symbol_id").alias("target"), F.col("short_name").alias("member"), F.col("scope").alias("in_scope"), *names)


def by_name(t: Facts, calls: DataFrame) -> DataFrame:
    """Candidates of calls by the short name of their member."""
    return calls.select("call_id", "language", "member", "receiver", F.col("rel_path").alias("caller"), F.col("scope").alias("caller_scope")).join(_symbols(t), ["language", "member"])


def by_name_in(t: Facts, calls: DataFrame, files: DataFrame, *more: str) -> DataFrame:
    """The same in certain files only; files: call_id, file (none twice).

    The file is a key of the join, so a name with very many calls and definitions makes no pairs.
    """
    asked = calls.select("call_id", "language", "member", "receiver", F.col("rel_path").alias("caller"), F.col("scope").alias("caller_scope"), *more)
    return asked.join(files.select("call_id", "file"), "call_id").join(_symbols(t), ["language", "member", "file"])


def by_name_at(t: Facts, calls: DataFrame) -> DataFrame:
    """The same for calls that have the ``file`` they want beside them."""
    asked = calls.select("call_id", "language", "member", "receiver", F.col("rel_path").alias("caller"), F.col("scope").alias("caller_scope"), "file")
    return asked.join(_symbols(t), ["language", "member", "file"])


def wanted(rows: DataFrame) -> DataFrame:
    """(call_id, file) from calls with the one file they want."""
    return rows.select("call_id", F.col("wanted").alias("file"))


def typed(t: Facts, calls: DataFrame, order: list[str] = (), kinds: str = "#.") -> DataFrame:
    """(call_id, file, target): the member of each call's ``type``, the instance's before the class's."""
    ids = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.concat("type", F.lit(k), "member").alias("target")) for i, k in enumerate(kinds)]))
    asked = calls.select("call_id", "language", *order, "type", "member", ids.alias("x")).select("call_id", "language", *order, "x.*")
    found = t.defined.select("language", F.col("symbol_id").alias("target"), F.col("rel_path").alias("file"))
    return sole(asked.join(found, ["language", "target"]), [*order, "step"])


def inherited(t: Facts, calls: DataFrame, start: str = "scope", itself: bool = True, first_only: bool = False, kinds: str = "#.") -> DataFrame:
    """The member on the type ``start`` of each call, or else on the nearest type above it that has it."""
    up = t.ancestors.where(F.forall("rank", lambda r: r == 1)) if first_only else t.ancestors
    rows = calls.select("call_id", "language", "member", F.col(start).alias("scope")).where("scope IS NOT NULL")
    above = rows.join(up, ["language", "scope"]).select("call_id", "language", "member", F.col("ancestor").alias("type"), F.size("rank").alias("level"), F.col("rank").alias("place"))
    if itself:
        none = F.array().cast("array<int>")
        above = above.unionByName(rows.select("call_id", "language", "member", F.col("scope").alias("type"), F.lit(0).alias("level"), none.alias("place")))
    return typed(t, above, ["level", "place"], kinds)


def bound(t: Facts, calls: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Calls with ``value`` of the last binding of their receiver's name at or before their line."""
    b = table.select("rel_path", F.col("owner").alias("source_symbol_id"), F.col("name").alias("receiver"), F.col("line").alias("at"), value, *[c for c in ("is_class",) if c in table.columns])
    met = calls.where("receiver IS NOT NULL").join(b, (calls["rel_path"] == b["rel_path"]) & calls["source_symbol_id"].eqNullSafe(b["source_symbol_id"]) & (calls["receiver"] == b["receiver"])).where("at <= line")
    w = Window.partitionBy("call_id").orderBy(F.col("at").desc(), value)
    return met.select(*[calls[c] for c in calls.columns], "at", value, *[c for c in ("is_class",) if c in table.columns]).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "at")


def verdicts(found: DataFrame, applies: DataFrame | None = None, otherwise: str | None = None, verdict: str = "resolved") -> DataFrame:
    """Verdict rows: those found, and for the rest of ``applies`` what happens ``otherwise``."""
    out = found.select("call_id", F.lit(verdict).alias("verdict"), "file", "target")
    if applies is None or otherwise is None:
        return out
    rest = applies.select("call_id").distinct().join(found.select("call_id"), "call_id", "left_anti")
    return out.unionByName(rest.select("call_id", F.lit(otherwise).alias("verdict"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("string").alias("target")))


def weakly(files: DataFrame) -> DataFrame:
    """Deferred targets: a file alone."""
    return files.select("call_id", F.lit("deferred").alias("verdict"), "file", F.lit(None).cast("string").alias("target"))


def own_member(t: Facts, calls: DataFrame) -> DataFrame:
    """The member of the enclosing type in the caller's own file."""
    ids = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.concat("scope", F.lit(k), "member").alias("target")) for i, k in enumerate("#.")]))
    asked = calls.where("scope IS NOT NULL").select("call_id", "language", F.col("rel_path").alias("file"), ids.alias("x")).select("call_id", "language", "file", "x.*")
    found = t.symbols.select("language", F.col("symbol_id").alias("target"), F.col("rel_path").alias("file")).distinct()
    return sole(asked.join(found, ["language", "target", "file"]), ["step"])


def field_calls(t: Facts, calls: DataFrame, prefix: str) -> DataFrame:
    """Calls on one field of the own object, with the field's ``type`` where it is known."""
    on = calls.where(F.col("receiver").startswith(prefix) & F.col("scope").isNotNull() & ~F.contains(F.expr(f"substring(receiver, {len(prefix) + 1})"), F.lit(".")))
    on = on.withColumn("field", F.expr(f"substring(receiver, {len(prefix) + 1})"))
    return on.join(t.fields.select("language", "scope", "field", "type").dropDuplicates(["language", "scope", "field"]), ["language", "scope", "field"], "left")


def only_names(defined: DataFrame, by: list[str] = ()) -> DataFrame:
    """(language, member, by, t): names with a single definition, and that."""
    return defined.groupBy("language", "member", *by).agg(F.count_distinct(F.struct("file", F.coalesce("target", F.lit("")))).alias("n"), F.min(F.struct("file", "target")).alias("t")).where("n = 1").drop("n")


def global_name(t: Facts, calls: DataFrame) -> DataFrame:
    """The only definition of the member's name in the project.

    Definitions are reduced to one row per name before calls meet them, so a name with very
    many of both makes no pairs.
    """
    one = only_names(_symbols(t))
    return calls.select("call_id", "language", "member").join(one, ["language", "member"]).select("call_id", "t.file", "t.target")


def normal(path: Column) -> Column:
    """A relative path without ``.`` and ``..``."""
    parts = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda a, x: F.when(x.isin("", "."), a).when((x == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == "..", a).otherwise(F.concat(a, F.array(x))),
    )
    return F.array_join(parts, "/")


def folder(path: str = "rel_path") -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def last(name: str, by: str = r"[.]") -> Column:
    return F.element_at(F.split(name, by), -1)


def first_import(calls: DataFrame, imports: DataFrame, match: Column) -> DataFrame:
    """Calls with the first import of their file that matches (columns position, import_text, names)."""
    met = calls.join(imports.drop("language"), "rel_path").where(match)
    w = Window.partitionBy("call_id").orderBy("position")
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_keyed(calls: DataFrame, imports: DataFrame, at: Column) -> DataFrame:
    """Calls with the first import of their file whose ``key`` equals ``at``.

    Imports are reduced to one row per file and key before calls meet them, so calls are neither multiplied nor sorted.
    """
    names = ["position", *[c for c in imports.columns if c not in ("language", "rel_path", "key", "position")]]
    one = imports.groupBy("rel_path", "key").agg(F.min(F.struct(*names)).alias("_i"))
    return calls.withColumn("key", at).join(one, ["rel_path", "key"]).select(*calls.columns, *[F.col(f"_i.{c}").alias(c) for c in names])


# -- the strategies --------------------------------------------------------------
# Each takes (facts, calls of its language) and gives (call_id, verdict, file, target).

Strategy = Callable[[Facts, DataFrame], DataFrame]


def _with(calls: DataFrame) -> DataFrame:
    return calls.where("receiver IS NOT NULL AND receiver != ''")


def _bare(calls: DataFrame) -> DataFrame:
    return calls.where("receiver IS NULL OR receiver = ''")


def own_object(name: str, otherwise: str | None = None) -> Strategy:
    """``this.m()``: the enclosing type's own member in the same file."""
    return lambda t, c: verdicts(own_member(t, c.where(F.col("receiver") == name)), c.where((F.col("receiver") == name) & F.col("scope").isNotNull()), otherwise)


def bare_own(t: Facts, c: DataFrame) -> DataFrame:
    """A bare call: a member of the enclosing type in the same file."""
    return verdicts(own_member(t, _bare(c)))


def bare_global(t: Facts, c: DataFrame) -> DataFrame:
    """A bare call: the only definition of that name."""
    return verdicts(global_name(t, _bare(c)))


def any_global(t: Facts, c: DataFrame) -> DataFrame:
    """Any call: the only definition of that name."""
    return verdicts(global_name(t, c))


def receiver_drop(t: Facts, c: DataFrame) -> DataFrame:
    """A receiver that nothing before has explained ends the chain."""
    return verdicts(c.limit(0).select("call_id", F.lit("").alias("file"), F.lit("").alias("target")), _with(c), "drop")


def local_binding(otherwise: str | None) -> Strategy:
    """A variable of known type: the member of that type."""

    def run(t: Facts, c: DataFrame) -> DataFrame:
        on = bound(t, c, t.bindings, "type")
        return verdicts(typed(t, on), on, otherwise)

    return run


def local_binding_or_name(t: Facts, c: DataFrame) -> DataFrame:
    """As before, and where the type's member is not defined here, its name all the same (Java)."""
    on = bound(t, c, t.bindings, "type")
    found = typed(t, on)
    rest = on.join(found.select("call_id"), "call_id", "left_anti").select("call_id", F.col("type").alias("file"), F.concat("type", F.lit("#"), "member").alias("target"))
    return verdicts(found.unionByName(rest))


def field_type(prefix: str, unknown: str | None, missing: str | None) -> Strategy:
    """``this.field.m()``: the member of the field's type; what an unknown type or a missing member means."""

    def run(t: Facts, c: DataFrame) -> DataFrame:
        on = field_calls(t, c, prefix)
        known = on.where("type IS NOT NULL")
        found = typed(t, known)
        if missing == "name":  # the type's name stands for a definition elsewhere
            rest = known.join(found.select("call_id"), "call_id", "left_anti").select("call_id", F.col("type").alias("file"), F.concat("type", F.lit("#"), "member").alias("target"))
            out = verdicts(found.unionByName(rest))
        else:
            out = verdicts(found, known, missing)
        return out if unknown is None else out.unionByName(verdicts(found.limit(0), on.where("type IS NULL"), unknown))

    return run


def own_or_inherited(name: str, first_only: bool = False, kinds: str = "#.") -> Strategy:
    """``self.m()``: the enclosing type's member or the nearest inherited one, or nothing."""

    def run(t: Facts, c: DataFrame) -> DataFrame:
        on = c.where((F.col("receiver") == name) & F.col("scope").isNotNull())
        return verdicts(inherited(t, on, first_only=first_only, kinds=kinds), on, "drop")

    return run


def above(names: tuple[str, ...], first_only: bool = True, kinds: str = "#.", file_too: bool = False, hooks: list[str] = ()) -> Strategy:
    """``super``: the nearest inherited member; with ``file_too`` an ancestor's file if it has no such member."""

    def run(t: Facts, c: DataFrame) -> DataFrame:
        on = c.where(F.col("receiver").isin(*names))
        found = inherited(t, on, itself=False, first_only=first_only, kinds=kinds)
        if file_too:
            up = t.ancestors.where(F.forall("rank", lambda r: r == 1)) if first_only else t.ancestors
            where = t.symbols.where("scope IS NULL OR scope = ''").select("language", F.col("symbol_id").alias("ancestor"), F.col("rel_path").alias("file"))
            rest = on.where(~F.col("member").isin(list(hooks))) if hooks else on
            near = rest.join(found.select("call_id"), "call_id", "left_anti").join(up, ["language", "scope"]).join(where, ["language", "ancestor"])
            near = near.groupBy("call_id").agg(F.min(F.struct(F.size("rank").alias("n"), "rank", "file")).alias("m")).select("call_id", "m.file", F.lit(None).cast("string").alias("target"))
            found = found.unionByName(near)
        return verdicts(found, on, "drop")

    return run


# -- Go


def go_return_type(t: Facts, c: DataFrame) -> DataFrame:
    """A variable assigned from a call whose declared result type is defined here."""
    on = bound(t, c, t.call_bindings, "function").join(t.returns, ["language", "function"])
    known = t.symbols.select("language", F.explode(F.array("symbol_id", "short_name")).alias("type")).distinct()
    on = on.join(known, ["language", "type"], "left_semi")
    return verdicts(typed(t, on), on, "drop")


def go_import(t: Facts, c: DataFrame) -> DataFrame:
    """A receiver that is the last part of an imported package: a function of a file below its path."""
    on = first_import(_with(c), t.imports, last("import_text", "/") == F.col("receiver"))
    on = on.withColumn("suffix", F.regexp_replace("import_text", r"^\./", ""))
    met = on.select("call_id", "suffix").join(by_name(t, on), "call_id").where(F.contains("file", F.col("suffix")))
    return verdicts(sole(met))


# -- Java


def java_import(t: Facts, c: DataFrame) -> DataFrame:
    """A receiver that is an imported type, the scope of a definition, or one of java.lang; else nothing."""
    # each step is written: one plan of them all repeats its joins, and a task pays for every sort of a plan
    on = _with(c)
    named = first_import(on, t.imports, ~F.col("import_text").endswith(".*") & (last("import_text") == F.col("receiver")))
    path = F.regexp_replace(F.regexp_extract("import_text", r"^((?:[^A-Z.][^.]*\.)*[A-Z][^.]*)", 1), r"\.", "/")
    named = written(named.withColumn("wanted", F.when(path != "", F.concat(path, F.lit(".java")))).where("wanted IS NOT NULL"), "named")
    base = _symbols(t).withColumn("base", last("file", "/"))
    inside = named.select("call_id", "language", "member", "wanted", last("wanted", "/").alias("base")).join(base, ["language", "member", "base"]).where((F.col("file") == F.col("wanted")) | F.col("file").endswith(F.concat(F.lit("/"), F.col("wanted"))))
    found = written(sole(inside), "inside")
    found = found.unionByName(named.join(found.select("call_id"), "call_id", "left_anti").select("call_id", F.col("wanted").alias("file"), F.lit(None).cast("string").alias("target")))
    rest = written(on.join(found.select("call_id"), "call_id", "left_anti"), "rest")
    scoped = written(sole(by_name(t, rest).where(F.col("in_scope") == F.col("receiver"))), "scoped")
    rest = rest.join(scoped.select("call_id"), "call_id", "left_anti")
    core = rest.where(F.col("receiver").isin(JAVA_LANG)).select("call_id", F.col("receiver").alias("file"), F.concat("receiver", F.lit("."), "member").alias("target"))
    return verdicts(found.unionByName(scoped).unionByName(core), on, "drop")


# -- Python


def python_file(imports: DataFrame) -> DataFrame:
    """Imports with ``file``: the module's path; a relative one counts its dots up from the importing file."""
    dots = F.length(F.regexp_extract("import_text", r"^(\.*)", 1))
    tail = F.regexp_replace(F.regexp_replace(F.regexp_replace("import_text", r"\s+as\s+.*$", ""), r"^\.+", ""), r"\.+", "/")
    up = F.concat(folder(), F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0)).cast("int")), F.lit("/"), tail)
    return imports.withColumn("file", F.when(tail == "", None).when(dots > 0, F.concat(normal(up), F.lit(".py"))).otherwise(F.concat(tail, F.lit(".py"))))


def _python_last() -> Column:
    return last(F.regexp_replace(F.regexp_replace("import_text", r"\s+as\s+.*$", ""), r"^\.+", ""))


def python_import(t: Facts, c: DataFrame) -> DataFrame:
    """A receiver that is the last part of an import: a member of that module's file, or the file."""
    on = first_import(_with(c), python_file(t.imports), _python_last() == F.col("receiver")).where("file IS NOT NULL").withColumnRenamed("file", "wanted")
    found = sole(by_name_in(t, on, wanted(on)))
    rest = on.join(found.select("call_id"), "call_id", "left_anti").select("call_id", F.col("wanted").alias("file"), F.lit(None).cast("string").alias("target"))
    return verdicts(found.unionByName(rest))


def python_type_file(t: Facts, typed_calls: DataFrame) -> DataFrame:
    """(call_id, file): where each call's ``bare`` type is defined: its only definition, that in an imported file, or an imported module of its name."""
    defined = typed_calls.join(t.symbols.select("language", F.col("short_name").alias("bare"), F.col("rel_path").alias("file")), ["language", "bare"])
    n = defined.groupBy("call_id").agg(F.count("*").alias("n"), F.min("file").alias("file"))
    imported = python_file(t.imports).where("file IS NOT NULL")
    many = n.where("n > 1").select("call_id").join(defined.select("call_id", "rel_path", "file"), "call_id").join(imported.select("rel_path", "file").distinct(), ["rel_path", "file"], "left_semi")
    many = many.groupBy("call_id").agg(F.count("*").alias("n"), F.min("file").alias("file")).where("n = 1")
    none = typed_calls.join(n.select("call_id"), "call_id", "left_anti").join(imported.select("rel_path", "position", "file", _python_last().alias("bare")), ["rel_path", "bare"])
    none = none.groupBy("call_id").agg(F.min(F.struct("position", "file")).alias("m")).select("call_id", "m.file")
    return n.where("n = 1").select("call_id", "file").unionByName(many.select("call_id", "file")).unionByName(none)


def python_binding(t: Facts, c: DataFrame) -> DataFrame:
    """A variable bound to a class: its member in the class's file, an inherited one, or the file; else nothing."""
    # each step is written: one plan of them all repeats its joins, and a task pays for every sort of a plan
    on = written(bound(t, c, t.bindings, "type").withColumn("bare", last("type")), "bound")
    at = written(python_type_file(t, on), "type-files")
    own = written(sole(by_name_in(t, on, at, "bare").where("in_scope = bare")), "own")
    rest = written(on.join(at, "call_id").join(own.select("call_id"), "call_id", "left_anti"), "rest")
    above_ = written(inherited(t, rest, "bare", itself=False, first_only=True), "above")
    weak = rest.join(above_.select("call_id"), "call_id", "left_anti").select("call_id", "file", F.lit(None).cast("string").alias("target"))
    return verdicts(own.unionByName(above_).unionByName(weak), on, "drop")


# -- Rust


def rust_binding(t: Facts, c: DataFrame) -> DataFrame:
    """A bound variable: its type's member, the own file's first; else nothing."""
    on = bound(t, c, t.bindings, "type")
    ids = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.concat("type", F.lit(k), "member").alias("target")) for i, k in enumerate("#.")]))
    met = on.select("call_id", "language", F.col("rel_path").alias("caller"), ids.alias("x")).select("call_id", "language", "caller", "x.*").join(t.symbols.select("language", F.col("symbol_id").alias("target"), F.col("rel_path").alias("file")), ["language", "target"])
    both = met.where("file = caller").withColumn("own", F.lit(0)).unionByName(met.withColumn("own", F.lit(1)))
    return verdicts(sole(both, ["step", "own"]), on, "drop")


def rust_import(t: Facts, c: DataFrame) -> DataFrame:
    """A receiver that a ``use`` names: a definition in the file of that module path."""
    clean = F.regexp_replace("import_text", r"^(crate|super|self)::", "")
    tail = F.trim(last(clean, "::"))
    names = F.when(tail.startswith("{") & tail.endswith("}"), F.transform(F.split(F.regexp_replace(tail, r"^\{|\}$", ""), ","), F.trim)).otherwise(F.array(tail))
    on = first_import(_with(c), t.imports.withColumn("_names", names), F.array_contains("_names", F.col("receiver")))
    suffix = F.regexp_replace(F.when(tail.startswith("{"), F.regexp_replace(clean, r"(?:::)?\{.*$", "")).otherwise(clean), "::", "/")
    on = on.withColumn("suffix", suffix).where("suffix != ''")
    ends = F.col("file").endswith(F.concat("suffix", F.lit(".rs"))) | F.col("file").endswith(F.concat("suffix", F.lit("/mod.rs")))
    return verdicts(sole(on.select("call_id", "suffix").join(by_name(t, on), "call_id").where(ends)))


# -- Bash


def bash_global(t: Facts, c: DataFrame) -> DataFrame:
    """The only function of that name, or the only one in a file that the script sources."""
    found = global_name(t, c)
    rest = c.join(found.select("call_id"), "call_id", "left_anti")
    sourced = t.imports.select("rel_path", normal(F.concat(folder(), F.lit("/"), F.col("import_text"))).alias("file")).distinct()
    near = by_name_in(t, rest, rest.select("call_id", "rel_path").join(sourced, "rel_path"))
    return verdicts(found.unionByName(sole(near)))


# -- TypeScript and JavaScript


def script_files(t: Facts, imports: DataFrame) -> DataFrame:
    """Imports with ``file``: the project file that a specifier means, relative or from the root."""
    bare = r"(?:/index)?\.(?:d\.ts|tsx?|jsx?|mts|cts|mjs|cjs)$"
    files = t.files.where("language IN ('typescript', 'javascript')").select(F.regexp_replace("rel_path", bare, "").alias("stem"), F.col("rel_path").alias("file")).groupBy("stem").agg(F.min("file").alias("file"))
    path = F.when(F.col("import_text").startswith("."), normal(F.concat(folder(), F.lit("/"), F.col("import_text")))).otherwise(F.col("import_text"))
    return imports.withColumn("stem", F.regexp_replace(path, bare, "")).join(files, "stem", "left").drop("stem")


def _imported(t: Facts) -> DataFrame:
    return script_files(t, t.imports).where("file IS NOT NULL").select(F.col("rel_path").alias("caller"), "file").distinct()


def _with_imported(t: Facts, calls: DataFrame) -> DataFrame:
    """Calls with ``file``, a row for each file that their own file imports."""
    return calls.join(_imported(t).withColumnRenamed("caller", "rel_path"), "rel_path")


def _external(t: Facts, c: DataFrame) -> DataFrame:
    """Calls whose receiver, or bare member, is bound by an import that is no file of the project."""
    out = script_files(t, t.imports).where("file IS NULL").select("rel_path", F.explode("names").alias("name")).distinct()
    return c.withColumn("name", F.coalesce(F.regexp_extract("receiver", r"^([^.]+)", 1), "member")).join(out, ["rel_path", "name"], "left_semi")


def script_named_import(t: Facts, c: DataFrame) -> DataFrame:
    """A receiver that an import binds: its member in the imported file (or where that passes it on from), or the file weakly."""
    bound_ = script_files(t, t.imports).withColumn("key", F.explode("names"))
    on = first_keyed(_with(c), bound_, F.col("receiver")).where("file IS NOT NULL").withColumnRenamed("file", "imported")
    declared = t.symbols.select(F.col("symbol_id").alias("receiver"), F.col("rel_path").alias("origin")).distinct()
    once = declared.groupBy("receiver").agg(F.count("*").alias("n"), F.min("origin").alias("origin")).where("n = 1")
    on = on.join(once.select("receiver", "origin"), "receiver", "left").withColumn("wanted", F.coalesce("origin", "imported"))
    met = by_name_at(t, on.withColumn("file", F.col("wanted")))
    scoped = met.where(F.col("in_scope") == F.col("receiver")).withColumn("o", F.lit(0))
    found = written(sole(scoped.unionByName(met.withColumn("o", F.lit(1))), ["o"]), "found")
    weak = on.join(found.select("call_id"), "call_id", "left_anti").select("call_id", F.col("wanted").alias("file"))
    return verdicts(found).unionByName(weakly(weak))


def script_import_basename(t: Facts, c: DataFrame) -> DataFrame:
    """A receiver like the base name of an imported file, letters and digits only."""
    plain = lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    base = F.regexp_replace(last("import_text", "/"), r"\.(?:tsx?|jsx?|mjs|cjs)$", "")
    on = first_keyed(_with(c), script_files(t, t.imports).withColumn("key", plain(base)), plain(F.col("receiver"))).where("file IS NOT NULL").withColumn("wanted", F.col("file"))
    found = written(sole(by_name_at(t, on)), "found")
    weak = on.join(found.select("call_id"), "call_id", "left_anti").select("call_id", F.col("wanted").alias("file"))
    return verdicts(found).unionByName(weakly(weak))


def script_receiver_symbol(t: Facts, c: DataFrame) -> DataFrame:
    """A receiver defined in just one imported file: its member there, or the file weakly."""
    on = _with(c)
    homes = on.select("call_id", F.col("rel_path").alias("caller"), F.col("receiver").alias("symbol_id")).join(t.symbols.select("symbol_id", F.col("rel_path").alias("file")).distinct(), "symbol_id").join(_imported(t), ["caller", "file"], "left_semi")
    homes = homes.groupBy("call_id").agg(F.countDistinct("file").alias("n"), F.min("file").alias("wanted")).where("n = 1")
    found = sole(by_name_in(t, on, wanted(homes)).where(F.col("in_scope") == F.col("receiver")))
    weak = homes.join(found.select("call_id"), "call_id", "left_anti").select("call_id", F.col("wanted").alias("file"))
    return verdicts(found).unionByName(weakly(weak))


def script_this(t: Facts, c: DataFrame) -> DataFrame:
    """``this.m()``: the enclosing class's member, or else a definition of that name in the file."""
    on = c.where((F.col("receiver") == "this") & F.col("scope").isNotNull())
    found = own_member(t, on)
    rest = by_name(t, on.join(found.select("call_id"), "call_id", "left_anti")).where("file = caller")
    rest = rest.groupBy("call_id").agg(F.min(F.struct("file", "target")).alias("m")).select("call_id", "m.file", "m.target")
    return verdicts(found.unionByName(rest))


def script_same_file(t: Facts, c: DataFrame) -> DataFrame:
    """A bare call, or one on a class, that the caller's own file defines once."""
    met = by_name(t, c).where("file = caller")
    return verdicts(sole(met.where(F.col("receiver").isNull() | (F.col("receiver").rlike("^[A-Z]") & (F.col("in_scope") == F.col("receiver"))))))


def script_global(t: Facts, c: DataFrame) -> DataFrame:
    """The only definition of the name, unless the call is on something from outside."""
    return verdicts(global_name(t, c.join(_external(t, c).select("call_id"), "call_id", "left_anti")))


def script_import_narrowed(t: Facts, c: DataFrame) -> DataFrame:
    """Of several definitions of the name, the only one in an imported file."""
    inside = c.join(_external(t, c).select("call_id"), "call_id", "left_anti")
    return verdicts(sole(by_name_at(t, _with_imported(t, inside))))


def script_jsx(t: Facts, c: DataFrame) -> DataFrame:
    """An element ``<Name>`` calls the component of that name that the file defines or imports."""
    on = c.where(F.col("receiver").isNull() & F.col("member").rlike("^[A-Z]"))
    own = by_name(t, on).where("file = caller").withColumn("o", F.lit(0))
    near = own.unionByName(by_name_at(t, _with_imported(t, on)).select(*by_name(t, on).columns).withColumn("o", F.lit(1)))
    return verdicts(sole(near, ["o"]))


def return_type(otherwise: str | None = None, walk: bool = False) -> Strategy:
    """A variable assigned from a call with a known result type: the member of that type."""

    def run(t: Facts, c: DataFrame) -> DataFrame:
        on = bound(t, c, t.call_bindings, "function").join(t.returns.dropDuplicates(["language", "function"]), ["language", "function"])
        return verdicts(inherited(t, on, "type") if walk else typed(t, on), on, otherwise)

    return run


# -- Ruby


def _ruby_type(t: Facts, calls: DataFrame, kinds: str = "#") -> DataFrame:
    """The member of each call's ``type`` or of the nearest type above it."""
    return inherited(t, calls, "type", kinds=kinds)


def ruby_local_type(t: Facts, c: DataFrame) -> DataFrame:
    """A variable of known type; one that holds a class has the class's own methods."""
    on = bound(t, c, t.bindings, "type")
    klass = F.coalesce("is_class", F.lit(False)) if "is_class" in on.columns else F.lit(False)
    return verdicts(_ruby_type(t, on.where(~klass)).unionByName(_ruby_type(t, on.where(klass), ".")), on, "drop")


def camel(name: Column) -> Column:
    """``line_item`` -> ``LineItem``."""
    return F.array_join(F.transform(F.split(name, "_"), lambda w: F.initcap(w)), "")


def _convention(t: Facts, calls: DataFrame, name: Column) -> DataFrame:
    """Calls with ``type``: the class whose name the receiver's is, if it is defined."""
    known = t.symbols.where("language = 'ruby'").select(F.col("symbol_id").alias("type")).distinct()
    return calls.withColumn("type", camel(name)).join(known, "type", "left_semi")


def ruby_ivar(t: Facts, c: DataFrame) -> DataFrame:
    """``@field.m``: the field's type, or else the class of its name; else nothing."""
    on = c.where(F.col("receiver").rlike(r"^@\w+$") & F.col("scope").isNotNull()).withColumn("field", F.col("receiver"))
    on = on.join(t.fields.select("language", "scope", "field", "type").dropDuplicates(["language", "scope", "field"]), ["language", "scope", "field"], "left")
    known = _ruby_type(t, on.where("type IS NOT NULL"), "#.")
    guessed = _ruby_type(t, _convention(t, on.where("type IS NULL").drop("type"), F.regexp_replace("receiver", "^@", "")))
    return verdicts(known.unionByName(guessed), on, "drop")


def ruby_enqueue(t: Facts, c: DataFrame) -> DataFrame:
    """``Job.perform_later``: the instance method that the job runs."""
    verbs = F.create_map(*[F.lit(x) for k, v in ENQUEUE.items() for x in (k, v)])
    on = _with(c).where(F.col("member").isin(*ENQUEUE)).withColumn("member", verbs[F.col("member")]).withColumn("type", F.col("receiver"))
    return verdicts(_ruby_type(t, on))


def ruby_constants(t: Facts, calls: DataFrame, name: str = "receiver") -> DataFrame:
    """(call_id, constant, file): the definition of a constant, innermost lexical scope first."""
    parts = F.split(F.coalesce("scope", F.lit("")), "::")
    nested = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct((F.size(parts) - k).alias("depth"), F.concat_ws("::", F.array_join(F.slice(parts, 1, k), "::"), F.col(name)).alias("constant")))
    asked = calls.select("call_id", "language", F.explode(nested).alias("x")).select("call_id", "language", "x.depth", F.regexp_replace("x.constant", "^::", "").alias("constant"))
    homes = t.symbols.select("language", F.col("symbol_id").alias("constant"), F.col("rel_path").alias("file")).distinct()
    met = asked.join(homes, ["language", "constant"]).groupBy("call_id").agg(F.min(F.struct("depth", "constant", "file")).alias("m"))
    return met.select("call_id", "m.constant", "m.file")


def ruby_constant(t: Facts, c: DataFrame) -> DataFrame:
    """``Some::Const.m``: the class method in the constant's file, an inherited one, or the file weakly."""
    on = _with(c).where(F.col("receiver").rlike(CONSTANT))
    at = ruby_constants(t, on)
    of_class = (F.col("target") == F.col("member")) | F.col("target").endswith(F.concat(F.lit("."), F.col("member")))
    found = sole(by_name_in(t, on, at).where(of_class))
    rest = on.join(at, "call_id").join(found.select("call_id"), "call_id", "left_anti")
    up = inherited(t, rest, "constant", itself=False, kinds=".")
    weak = rest.join(up.select("call_id"), "call_id", "left_anti").select("call_id", "file")
    return verdicts(found.unionByName(up)).unionByName(weakly(weak))


def ruby_require(t: Facts, c: DataFrame) -> DataFrame:
    """A receiver named by ``require``: a member of that file, or the file weakly."""
    plain = F.regexp_replace("import_text", r"^\./", "")
    on = first_import(_with(c), t.imports, (F.col("import_text") == F.col("receiver")) | (plain == F.col("receiver")))
    rb = F.when(plain.endswith(".rb"), plain).otherwise(F.concat(plain, F.lit(".rb")))
    on = on.withColumn("wanted", F.when(F.col("import_text").startswith("./"), normal(F.concat(folder(), F.lit("/"), rb))).otherwise(rb))
    files = t.files.where("language = 'ruby'").select(F.col("rel_path").alias("file"), last("rel_path", "/").alias("base"))
    at = on.select("call_id", "wanted", last("wanted", "/").alias("base")).join(files, "base").where((F.col("file") == F.col("wanted")) | F.col("file").endswith(F.concat(F.lit("/"), F.col("wanted"))))
    at = at.groupBy("call_id").agg(F.min(F.struct(F.length("file").alias("n"), "file")).alias("m")).select("call_id", F.col("m.file").alias("wanted"))
    found = sole(by_name_in(t, on, wanted(at)))
    return verdicts(found).unionByName(weakly(at.join(found.select("call_id"), "call_id", "left_anti").select("call_id", F.col("wanted").alias("file"))))


def ruby_chain_type(t: Facts, c: DataFrame) -> DataFrame:
    """``a.b.m``: the result type of ``b`` on the type of ``a``, or of ``Const.new``; its member, else nothing."""
    made = c.where(F.col("receiver").rlike(r"^[A-Z][\w:]*\.new(\(.*\))?$")).withColumn("type", F.regexp_extract("receiver", r"^([A-Z][\w:]*)\.new", 1))
    pair = c.where(F.col("receiver").rlike(r"^\w+\.\w+[?!]?$")).withColumn("through", F.regexp_extract("receiver", r"\.(\w+[?!]?)$", 1)).withColumn("whole", F.col("receiver")).withColumn("receiver", F.regexp_extract("receiver", r"^(\w+)\.", 1))
    inner = bound(t, pair, t.bindings, "type").withColumn("function", F.concat("type", F.lit("#"), "through")).drop("type")
    on = made.select("call_id", "language", "member", "type").unionByName(inner.join(t.returns.dropDuplicates(["language", "function"]), ["language", "function"]).select("call_id", "language", "member", "type"))
    return verdicts(_ruby_type(t, on), on, "drop")


def ruby_relation_guard(t: Facts, c: DataFrame) -> DataFrame:
    """A receiver that builds a query has methods of the framework, none of ours."""
    on = _with(c).where(F.col("receiver").rlike(r"\.(?:" + "|".join(RELATION_BUILDERS) + r")\("))
    return verdicts(c.limit(0).select("call_id", F.lit("").alias("file"), F.lit("").alias("target")), on, "drop")


def ruby_convention(t: Facts, c: DataFrame) -> DataFrame:
    """``user.m``: the method of ``User`` if there is one and the variable's type is not known otherwise."""
    on = _with(c).where(F.col("receiver").rlike(r"^[a-z_]\w*$") & (F.col("receiver") != "self"))
    on = on.join(bound(t, on, t.bindings, "type").select("call_id"), "call_id", "left_anti")
    return verdicts(_ruby_type(t, _convention(t, on, F.col("receiver"))))


def ruby_self_entry(t: Facts, c: DataFrame) -> DataFrame:
    """``Const.entry`` whose body calls a hook on a new object: the type's own hook (a template method)."""
    on = _with(c).where(F.col("receiver").rlike(CONSTANT))
    hooks = templates(t).select("language", F.col("entry").alias("member"), "hook", F.col("scope").alias("base"))
    up = t.ancestors.select("language", F.col("scope").alias("receiver"), F.col("ancestor").alias("base"))
    met = on.join(up, ["language", "receiver"]).join(hooks, ["language", "member", "base"]).select("call_id", "language", F.col("receiver").alias("type"), F.col("hook").alias("member"))
    return verdicts(typed(t, met, kinds="#"))


def templates(t: Facts) -> DataFrame:
    """(language, scope, entry, hook): class methods that call a method which only subtypes define.

    The hook is called on the own object or bare inside ``Type.entry`` or ``Type#entry``.
    """
    inside = t.calls.where("scope IS NOT NULL AND (receiver IS NULL OR receiver IN ('self', 'new'))").select("language", "scope", F.col("source_symbol_id").alias("entry_id"), F.col("member").alias("hook")).distinct()
    defined = t.symbols.select("language", "scope", F.col("short_name").alias("hook")).distinct()
    missing = inside.join(defined, ["language", "scope", "hook"], "left_anti")
    below = t.ancestors.select("language", F.col("scope").alias("sub"), F.col("ancestor").alias("scope"))
    has = missing.join(below, ["language", "scope"]).join(defined.withColumnRenamed("scope", "sub"), ["language", "sub", "hook"], "left_semi")
    return has.select("language", "scope", F.regexp_extract("entry_id", r"[.#]([^.#]+)$", 1).alias("entry"), "hook").where("entry != ''").distinct()


def ruby_bare(t: Facts, c: DataFrame) -> DataFrame:
    """A bare call: along the own type and those above, a consensus of those that include it, or the only definition."""
    on = _bare(c)
    chain = inherited(t, on.where("scope IS NOT NULL"), kinds="#")
    rest = on.join(chain.select("call_id"), "call_id", "left_anti")
    mixed = t.inheritance.where("kind IN ('include', 'prepend', 'extend')").select("language", F.col("ancestor_fq_name").alias("scope"), F.col("source_fq_name").alias("host"))
    hosts = rest.where("scope IS NOT NULL").join(mixed, ["language", "scope"]).select("call_id", "language", "member", F.col("host").alias("type"))
    agreed = sole(inherited(t, hosts.withColumn("many", F.col("call_id")).withColumn("call_id", F.concat_ws("\u0001", F.col("call_id").cast("string"), "type")), "type", kinds="#").withColumn("call_id", F.split("call_id", "\u0001")[0].cast(t.calls.schema["call_id"].dataType)))
    rest = rest.join(agreed.select("call_id"), "call_id", "left_anti")
    own = F.col("target").endswith(F.concat(F.lit("#"), F.col("member"))) | (F.col("target") == F.col("member"))
    only = only_names(_symbols(t).where(own).withColumn("o", F.lit(0)).unionByName(_symbols(t).withColumn("o", F.lit(1))), ["o"]).groupBy("language", "member").agg(F.min_by("t", "o").alias("t"))
    last_ = rest.select("call_id", "language", "member").join(only, ["language", "member"]).select("call_id", "t.file", "t.target")
    return verdicts(chain.unionByName(agreed).unionByName(last_))


def ruby_column(t: Facts, c: DataFrame) -> DataFrame:
    """A bare read of a column of the own model, or of a model above it."""
    on = _bare(c).where("scope IS NOT NULL")
    columns = t.symbols.where("is_column").select("language", F.col("scope").alias("type"), F.col("short_name").alias("member"), F.col("symbol_id").alias("target"), F.col("rel_path").alias("file"))
    up = on.select("call_id", "language", "member", F.col("scope").alias("type"), F.lit(0).alias("level")).unionByName(on.join(t.ancestors, ["language", "scope"]).select("call_id", "language", "member", F.col("ancestor").alias("type"), F.size("rank").alias("level")))
    return verdicts(sole(up.join(columns, ["language", "type", "member"]), ["level"]))


_SCRIPT: list[tuple[str, Strategy]] = [
    ("super", above(("super",), file_too=True)), ("thisMember", script_this), ("fieldType", field_type("this.", None, None)), ("localBinding", local_binding(None)), ("namedImport", script_named_import),
    ("importBasename", script_import_basename), ("receiverSymbol", script_receiver_symbol), ("sameFile", script_same_file), ("globalShortName", script_global), ("importNarrowedFallback", script_import_narrowed),
    ("jsxComponent", script_jsx), ("returnTypeInference", return_type()),
]

#: The chains, in order.
CHAINS: dict[str, list[tuple[str, Strategy]]] = {
    "bash": [("globalShortName", bash_global)],
    "go": [("localBinding", local_binding("drop")), ("returnTypeBinding", go_return_type), ("importMatch", go_import), ("receiverDrop", receiver_drop), ("globalShortName", bare_global)],
    "java": [("thisMember", own_object("this")), ("fieldType", field_type("this.", None, "name")), ("localBinding", local_binding_or_name), ("importReceiver", java_import), ("enclosingBareCall", bare_own), ("globalShortName", any_global)],
    "javascript": _SCRIPT,
    "python": [("super", above(("super()", "super"))), ("selfField", field_type("self.", "drop", "name")), ("selfMember", own_or_inherited("self", first_only=True)), ("localBinding", python_binding), ("importMatch", python_import), ("globalShortName", any_global)],
    "ruby": [
        ("super", above(("super",), first_only=False, kinds="#", file_too=True, hooks=RUNTIME_HOOKS)), ("selfMember", own_or_inherited("self", kinds="#.")), ("localType", ruby_local_type), ("ivarField", ruby_ivar), ("returnTypeBinding", return_type(None, True)),
        ("enqueueDispatch", ruby_enqueue), ("selfDispatchEntry", ruby_self_entry), ("constant", ruby_constant), ("explicitRequire", ruby_require), ("chainType", ruby_chain_type), ("arRelationGuard", ruby_relation_guard),
        ("conventionReceiver", ruby_convention), ("receiverSetDrop", receiver_drop), ("bareCall", ruby_bare), ("schemaColumn", ruby_column),
    ],
    "rust": [("selfMethod", own_object("self")), ("selfField", field_type("self.", "drop", "drop")), ("localBinding", rust_binding), ("importMatch", rust_import), ("bareSelfMethod", bare_own), ("globalShortName", any_global)],
    "typescript": _SCRIPT,
}


def strategy(t: Facts, language: str, name: str) -> DataFrame:
    """The verdicts of one strategy of a language's chain."""
    return dict(CHAINS[language])[name](t, t.of(language))


def chain(t: Facts, language: str) -> DataFrame:
    """(call_id, outcome, file, target, by): each call's first verdict, and the strategy that gave it."""
    made, t = [], t.settled()
    for k, (name, run) in enumerate(CHAINS[language]):
        v = written(run(t, t.of(language)), "verdicts")
        made.append(v.select("call_id", F.lit(k).alias("priority"), "verdict", F.struct("file", "target", F.lit(name).alias("by")).alias("target")))
    every = reduce(DataFrame.unionByName, made)
    out = t.of(language).select("call_id").join(first_verdict(every), "call_id", "left")
    return out.select("call_id", F.coalesce("outcome", F.lit("unresolved")).alias("outcome"), "target.file", "target.target", "target.by")


# -- calls with several targets -----------------------------------------------------


def receiver_types(t: Facts, c: DataFrame) -> DataFrame:
    """Calls with the ``type`` of their receiver: by binding, by field, or the own type."""
    a = bound(t, c, t.bindings, "type").select("call_id", "type")
    b = reduce(DataFrame.unionByName, [field_calls(t, c, p).where("type IS NOT NULL").select("call_id", "type") for p in ("this.", "self.")])
    return c.join(a.unionByName(b).dropDuplicates(["call_id"]), "call_id")


def cone(t: Facts, c: DataFrame, cone_max: int = CONE_MAX) -> DataFrame:
    """Calls on a type whose subtypes override the member: an edge to each of few, or one to the base."""
    on = receiver_types(t, c)
    below = t.ancestors.select("language", F.col("ancestor").alias("type"), F.col("scope").alias("subtype"))
    own = t.symbols.select("language", F.col("symbol_id").alias("target"), F.col("rel_path").alias("file"))
    met = on.join(below, ["language", "type"]).withColumn("target", F.concat("subtype", F.lit("#"), "member")).join(own, ["language", "target"]).select("call_id", "language", "type", "member", "file", "target").distinct()
    n = F.count("*").over(Window.partitionBy("call_id"))
    met = met.withColumn("n", n)
    few = met.where(F.col("n") <= cone_max).select("call_id", "file", "target", F.lit("cone").alias("edge_kind"), (1 / F.col("n")).alias("confidence"))
    base = met.where(F.col("n") > cone_max).select("call_id", "language", F.concat("type", F.lit("#"), "member").alias("target")).distinct().join(own, ["language", "target"], "left")
    return few.unionByName(base.select("call_id", "file", "target", F.lit("poly-base").alias("edge_kind"), F.lit(1.0).alias("confidence")))


def union_types(t: Facts, c: DataFrame, cone_max: int = CONE_MAX) -> DataFrame:
    """Calls on a variable of one of several types: an edge to each type's member, at 1 / n."""
    u = t.unions.select("rel_path", F.col("owner").alias("source_symbol_id"), F.col("name").alias("receiver"), "type")
    on = c.join(u, ["rel_path", "source_symbol_id", "receiver"]).select(F.concat_ws("\u0001", F.col("call_id").cast("string"), "type").alias("call_id"), "language", "member", "type")
    found = inherited(t, on, "type").withColumn("call_id", F.split("call_id", "\u0001")[0].cast(t.calls.schema["call_id"].dataType)).distinct()
    n = F.count("*").over(Window.partitionBy("call_id"))
    return found.withColumn("n", n).where(F.col("n") <= cone_max).select("call_id", "file", "target", F.lit("cone").alias("edge_kind"), (1 / F.col("n")).alias("confidence"))


def registry(t: Facts, c: DataFrame, cone_max: int = CONE_MAX) -> DataFrame:
    """``TABLE[key].new.m``: the member of every class that the registry constant holds."""
    name = F.regexp_extract("receiver", r"^([A-Z][\w:]*)\[[^\]]*\](?:\.new(?:\(.*\))?)?$", 1)
    on = _with(c).withColumn("name", name).where("name != ''").join(t.registries, ["language", "name"])
    on = on.select(F.concat_ws("\u0001", F.col("call_id").cast("string"), "type").alias("call_id"), "language", "member", "type")
    found = typed(t, on).withColumn("call_id", F.split("call_id", "\u0001")[0].cast(t.calls.schema["call_id"].dataType)).distinct()
    n = F.count("*").over(Window.partitionBy("call_id"))
    return found.withColumn("n", n).where(F.col("n") <= cone_max).select("call_id", "file", "target", F.lit("table").alias("edge_kind"), (1 / F.col("n")).alias("confidence"))


def gates(t: Facts, c: DataFrame) -> DataFrame:
    """(call_id, gate): calls that must not fan out over a name, with the first reason of these.

    ``bare``: no receiver; ``shape``: the own object, a constant, a literal, a field; ``typed``: a receiver
    of known type; ``relation``: a chain that builds a query; ``index``: an element of unknown type
    (``rows[k]``); ``outside``: a chain from a constant that the project doesn't define; ``duck``: a member
    that any object may answer.
    """
    typed_ = receiver_types(t, c).select("call_id").distinct().withColumn("_typed", F.lit(True))
    root = F.when(F.contains("receiver", F.lit(".")), F.regexp_extract("receiver", r"^([A-Z]\w*(?:::[A-Z]\w*)*)[.]", 1))
    inside = t.symbols.select("language", F.col("symbol_id").alias("_root")).distinct().withColumn("_inside", F.lit(True))
    on = c.join(typed_, "call_id", "left").withColumn("_root", root).join(inside, ["language", "_root"], "left")
    r, bare = F.col("receiver"), F.col("receiver").isNull() | (F.col("receiver") == "")
    why = (
        F.when(bare, "bare").when(r.isin("self", "this", "super") | (r.rlike(r"^[A-Z\"'\[{0-9:@]") & ~F.contains(r, F.lit("."))), "shape").when(F.col("_typed"), "typed")
        .when(r.rlike(r"\.(?:" + "|".join(RELATION_BUILDERS) + r")\("), "relation").when(r.endswith("]"), "index").when((F.col("_root") != "") & F.col("_inside").isNull(), "outside")
        .when(r.rlike(r"^[A-Z\"'\[{0-9:@]"), "shape").when(F.col("member").isin(DUCK_MEMBERS), "duck")
    )
    return on.select("call_id", why.alias("gate")).where("gate IS NOT NULL")


def dynamic(t: Facts, c: DataFrame) -> DataFrame:
    """Calls on a receiver of unknown type: narrowed definitions of the name, shared out, or ambiguous.

    What a gate holds back has none (see ``gates``).
    (call_id, file, target, edge_kind, confidence, ambiguous)
    """
    on = c.join(gates(t, c).select("call_id"), "call_id", "left_anti")
    given = ["n_args", "given_keywords", "keyword_splat", "has_block"]
    facts = ["min_args", "max_args", "splat", "required_keywords", "declared_keywords", "visibility", "accepts_block"]
    cap = F.broadcast(fan_out_cap(t.symbols))  # one row
    # definitions of a name with the same signature fit the same calls, so calls meet signatures, not definitions
    defined = _symbols(t, *facts).where(F.col("in_scope").isNotNull())
    forms = defined.groupBy("language", "member", *facts).agg(F.count("*").alias("times"))
    forms = forms.withColumn("form", F.xxhash64("language", "member", *[F.coalesce(F.col(f).cast("string"), F.lit("-")) for f in facts]))
    met = narrowed(on.select("call_id", "language", "member", *given).join(forms, ["language", "member"]))
    n = F.sum("times").over(Window.partitionBy("call_id"))
    counted = met.withColumn("n_candidates", n).crossJoin(cap).withColumn("ambiguous", F.col("n_candidates") > F.col("cap"))
    many = counted.where("ambiguous").select("call_id").distinct()
    homes = defined.select("language", "member", "file", "target", F.xxhash64("language", "member", *[F.coalesce(F.col(f).cast("string"), F.lit("-")) for f in facts]).alias("form"))
    few = counted.where("NOT ambiguous").select("call_id", "language", "member", "form", "n_candidates").join(homes, ["language", "member", "form"])
    kind = F.when(F.col("n_candidates") == 1, "exact").otherwise("dynamic")
    share = F.when(F.col("n_candidates") == 1, 1.0).otherwise(DYNAMIC_DISCOUNT / F.col("n_candidates"))
    none = F.lit(None).cast("string")
    return few.select("call_id", "file", "target", kind.alias("edge_kind"), share.alias("confidence"), F.lit(False).alias("ambiguous")).unionByName(
        many.select("call_id", none.alias("file"), none.alias("target"), F.lit("dynamic").alias("edge_kind"), F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("ambiguous"))
    )


# -- a run ---------------------------------------------------------------------------


def _none(t: Facts) -> DataFrame:
    return t.calls.limit(0).select("call_id", F.lit("").alias("file"), F.lit("").alias("target"), F.lit("").alias("edge_kind"), F.lit(1.0).alias("confidence"))


def resolve(t: Facts, language: str, edge_cap: int = EDGE_CAP) -> dict[str, DataFrame]:
    """All of one language: ``edges``, ``ambiguous`` calls, ``outcomes`` of all calls and run statistics.

    In order: registries, unions and overriding subtypes, the chain, calls on parameters whose type
    their call sites agree on, and for Ruby what is left over the fan-out on untyped receivers.  Files with more edges than ``edge_cap``
    keep none.
    """
    t = t.settled()
    c = t.of(language)
    parts = [(0, registry(t, c) if t.registries is not None else _none(t)), (1, union_types(t, c) if t.unions is not None else _none(t)), (2, cone(t, c))]
    single = written(chain(t, language), "chain")
    exact = single.where("target IS NOT NULL").select("call_id", "file", "target", F.lit("exact").alias("edge_kind"), F.lit(1.0).alias("confidence"))
    parts.append((3, exact))
    ambiguous, left = c.limit(0).select("call_id"), single.where("outcome != 'resolved'").select("call_id")
    if t.arguments is not None and t.parameters is not None:
        gained = folded(t, exact.select("call_id", "target"), t.arguments, t.parameters)["edges"].join(left, "call_id", "left_semi")
        parts.append((3, gained.select("call_id", "file", "target", F.lit("exact").alias("edge_kind"), F.lit(1.0).alias("confidence"))))
        left = left.join(gained.select("call_id"), "call_id", "left_anti")
    if language == "ruby":
        open_ = c.join(left, "call_id", "left_semi")
        wide = written(dynamic(t, open_), "dynamic")
        parts.append((4, wide.where("NOT ambiguous").drop("ambiguous")))
        ambiguous = wide.where("ambiguous").select("call_id").distinct()
    every = reduce(DataFrame.unionByName, [p.withColumn("component", F.lit(k)) for k, p in parts])
    w = Window.partitionBy("call_id")
    chosen = every.withColumn("_first", F.min("component").over(w)).where("component = _first").drop("_first", "component")
    edges = chosen.join(c.select("call_id", F.col("source_symbol_id"), F.col("rel_path").alias("source_rel_path"), F.concat_ws(".", "receiver", "member").alias("call_expression")), "call_id")
    per_file = Window.partitionBy("source_rel_path")
    edges = edges.withColumn("_n", F.count("*").over(per_file)).where(F.col("_n") <= edge_cap).drop("_n")
    edges = written(edges.select("call_id", "source_symbol_id", "source_rel_path", F.col("target").alias("target_symbol_id"), F.col("file").alias("target_rel_path"), "call_expression", "edge_kind", "confidence"), "edges")
    ambiguous = written(ambiguous, "ambiguous")
    return {"edges": edges, "ambiguous": ambiguous, "outcomes": outcomes(t, c, edges, single, ambiguous)}


def receiver_kind(receiver: Column) -> Column:
    """What a call is on, for the statistics of a run."""
    return (
        F.when(receiver.isNull() | (receiver == ""), "bareCall").when(receiver.isin("self", "this"), "selfMember").when(receiver.startswith("super"), "super").when(receiver.rlike(r"^(self|this)\.|^@"), "field")
        .when(receiver.rlike(r"^[A-Z][\w:.]*$"), "constant").when(receiver.rlike(r"^[a-z_]\w*$"), "localVar").otherwise("chain")
    )


def outcomes(t: Facts, calls: DataFrame, edges: DataFrame, single: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(call_id, language, receiver_kind, outcome): resolved, ambiguous, or why there is no target."""
    known = t.symbols.select("language", F.col("short_name").alias("member")).distinct().withColumn("_known", F.lit(True))
    out = calls.join(edges.select("call_id").union(single.where("outcome = 'resolved'").select("call_id")).distinct().withColumn("_edge", F.lit(True)), "call_id", "left")
    out = out.join(ambiguous.withColumn("_many", F.lit(True)), "call_id", "left").join(known, ["language", "member"], "left")
    why = F.when(F.col("_edge"), "resolved").when(F.col("_many"), "ambiguous_fanout").when(F.coalesce("dynamic", F.lit(False)), "unresolvable").when(F.col("_known").isNull(), "no_in_project_def")
    return out.select("call_id", "language", receiver_kind(F.col("receiver")).alias("receiver_kind"), why.otherwise("missed").alias("outcome"))


def statistics(outcomes_: DataFrame) -> DataFrame:
    """Run statistics per language and receiver kind, as ``graph.resolve_summary`` takes them."""
    return tally(outcomes_)


def parameter_types(t: Facts, arguments: DataFrame) -> DataFrame:
    """(function, position, type): what the call sites of a function agree on; arguments: call_id, position, type."""
    met = arguments.join(t.calls.select("call_id", "member", "language"), "call_id").join(t.symbols.select("language", F.col("short_name").alias("member"), F.col("symbol_id").alias("function")), ["language", "member"])
    return agreed(met)


def agreed(evidence: DataFrame) -> DataFrame:
    """(function, position, type) where all evidence is of one type; a disagreement is silence."""
    n = evidence.groupBy("function", "position").agg(F.countDistinct("type").alias("n"), F.min("type").alias("type"))
    return n.where("n = 1").select("function", "position", "type")


def folded(t: Facts, targets: DataFrame, arguments: DataFrame, parameters: DataFrame) -> dict[str, DataFrame]:
    """Types of parameters from the arguments of calls, to a fixpoint: ``types`` and the ``edges`` that they give.

    * targets: call_id, target (calls that are resolved already);
    * arguments: call_id, position, type (known from the text) or name (a variable);
    * parameters: function, position, name.

    An argument says what its parameter is: by its own type, the type its variable is bound to, or
    what is known of the caller's parameter it hands on.  A call on a parameter means the member of its
    type or of the nearest one above, and its arguments say more in turn.  All parameters that have come
    to one type in a round hand it on in the next, each once; one that two arguments disagree about is
    silent, for good (what it has handed on before stays).  When no parameter is new, those that are
    still of one type have it, and only they give edges.

    Each round joins only what is new; there are as many rounds as calls hand a type on, and no more
    evidence than arguments.
    """
    # all tables here grow with the calls, and their files look small: no side of a join is sent to all through the driver
    merged = lambda df: df.hint("merge")
    t = copy.copy(t.settled())
    t.defined, t.ancestors, t.bindings = merged(t.defined), merged(t.ancestors), merged(t.bindings)
    targets, arguments, parameters = (merged(written(x, n)) for x, n in ((targets, "targets"), (arguments, "given"), (parameters, "parameters")))
    calls = t.calls.select("call_id", "language", "rel_path", "line", "source_symbol_id", "receiver", "member")
    own = parameters.select(F.col("function").alias("source_symbol_id"), F.col("position").alias("from_position"), F.col("name").alias("receiver"))
    at = calls.drop("receiver", "member").join(arguments.where("type IS NULL AND name IS NOT NULL").select("call_id", "position", F.col("name").alias("receiver")), "call_id").withColumn("argument", F.concat_ws(":", "call_id", "position")).withColumnRenamed("call_id", "of_call").withColumnRenamed("argument", "call_id")
    local = bound(t, at, t.bindings, "type")
    known = written(arguments.where("type IS NOT NULL").select("call_id", "position", "type").unionByName(local.select(F.col("of_call").alias("call_id"), "position", "type")), "arguments")
    handed = at.join(merged(local.select("call_id")), "call_id", "left_anti").join(own, ["source_symbol_id", "receiver"])
    handed = written(handed.select(F.col("of_call").alias("call_id"), "position", F.col("source_symbol_id").alias("from_function"), "from_position"), "handed")
    open_ = calls.where("receiver IS NOT NULL").join(targets.select("call_id"), "call_id", "left_anti")
    open_ = open_.join(merged(bound(t, open_, t.bindings, "type").select("call_id")), "call_id", "left_anti").join(own, ["source_symbol_id", "receiver"])
    open_ = written(open_.select("call_id", "language", "member", F.col("source_symbol_id").alias("function"), F.col("from_position").alias("position")), "open-calls")

    def says(meant: DataFrame) -> DataFrame:
        """What the arguments of calls with these targets say by themselves."""
        return meant.select("call_id", F.col("target").alias("function")).join(merged(known), "call_id").select("function", "position", "type")

    def ways(meant: DataFrame) -> DataFrame:
        """(from_function, from_position, function, position): parameters handed on."""
        return meant.select("call_id", F.col("target").alias("function")).join(merged(handed), "call_id").select("from_function", "from_position", "function", "position").distinct()

    through = lambda facts, flows: facts.select(F.col("function").alias("from_function"), F.col("position").alias("from_position"), "type").join(merged(flows), ["from_function", "from_position"]).select("function", "position", "type")
    flows, evidence = written(ways(targets), "flows"), written(says(targets).distinct(), "evidence")
    said = written(evidence.limit(0), "said")
    meant = written(open_.select("call_id", F.lit("").alias("type"), F.lit("").alias("file"), F.lit("").alias("target")).limit(0), "meant")
    while True:
        new = written(agreed(evidence).join(merged(said), ["function", "position"], "left_anti"), "new")
        if new.isEmpty():
            break
        said = written(said.unionByName(new), "said", instead_of=said)
        asked = open_.join(merged(new), ["function", "position"]).select("call_id", "language", "member", "type")
        got = written(inherited(t, asked, "type").join(merged(asked.select("call_id", "type")), "call_id").select("call_id", "type", "file", "target"), "got")
        more = written(ways(got), "more")
        step = through(new, flows).unionByName(says(got)).unionByName(through(said, more))
        evidence = written(evidence.unionByName(step).distinct(), "evidence", instead_of=evidence)
        flows = written(flows.unionByName(more).distinct(), "flows", instead_of=flows)
        meant = written(meant.unionByName(got), "meant", instead_of=meant)
    types = written(agreed(evidence), "types")
    edges = open_.join(merged(types), ["function", "position"]).select("call_id", "type").join(merged(meant), ["call_id", "type"]).select("call_id", "file", "target")
    return {"types": types.join(parameters, ["function", "position"]).select("function", "position", "name", "type"), "edges": written(edges.distinct(), "edges"), "evidence": evidence}


def column_symbols(schema: DataFrame, models: DataFrame) -> DataFrame:
    """Accessors of a model's database columns; schema: table, column; models: table, scope, rel_path."""
    return schema.join(models, "table").select(F.lit("ruby").alias("language"), "rel_path", F.concat("scope", F.lit("#"), "column").alias("symbol_id"), F.col("column").alias("short_name"), "scope", F.lit(True).alias("is_column"))
