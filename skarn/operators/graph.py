"""Graph operators on edge tables.

All are joins and aggregates.  Iterations are bounded, and each one's result is written to
the shared folder, so plans stay short and a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round2
from ..functions.text import edge_visible, split_method
from ..storage import bucketed, written

# PageRank, impact and path tracing.
DAMPING, EPSILON, MAX_ITERATIONS = 0.85, 1e-6, 50
IMPACT_DEPTH = 5
TRACE_DEPTH, TRACE_PATHS, TRACE_DEPTH_CAP, TRACE_PATHS_CAP = 8, 10, 20, 50
CALLERS_LIMIT, CALLERS_CAP = 50, 500
EDGE_KINDS = ("exact", "cone", "poly-base", "dynamic", "registry")


#: Edges of one node that a bucket holds; those of busier nodes are spread over several.
HOT_EDGES = 1_000_000


class Adjacency:
    """Edges stored once, in buckets by one of their ends, for steps that join them again and again.

    A step moves its rows to the edges and leaves the edges where they are.  Nodes with more than
    ``HOT_EDGES`` edges have several salts, and rows on them go to each; the others have one.
    """

    def __init__(self, edges: DataFrame, key: str, other: str, name: str = "adjacency", hot: int | None = None):
        self.key = key
        limit = HOT_EDGES if hot is None else hot
        counts = edges.groupBy(key).agg(F.ceil(F.count("*") / limit).alias("_salts")).where("_salts > 1")
        self.hot = written(counts, f"{name}-hot")  # at most the number of edges / limit
        spread = edges.join(self.hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(other), F.coalesce("_salts", F.lit(1)))).drop("_salts")
        self.edges = bucketed(spread, name, [key, "_salt"])

    def step(self, rows: DataFrame, on: str) -> DataFrame:
        """Rows joined with the edges of the node in their column ``on``, which becomes the edges' end."""
        keyed = rows.withColumnRenamed(on, self.key)
        salted = keyed.join(self.hot, self.key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
        return salted.join(self.edges, [self.key, "_salt"]).drop("_salt")


def fan(edges: DataFrame, files: DataFrame, node: str = "rel_path", src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, fan_in, fan_out) of every file, zeros kept."""
    ins = edges.groupBy(F.col(dst).alias(node)).agg(F.count("*").alias("fan_in"))
    outs = edges.groupBy(F.col(src).alias(node)).agg(F.count("*").alias("fan_out"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return files.select(node).distinct().join(ins, node, "left").join(outs, node, "left").select(node, zero("fan_in"), zero("fan_out"))


def fan_in_p95(fans: DataFrame) -> DataFrame:
    """One row: the interpolated 95th percentile of fan-in over all files; none gives 0."""
    return fans.agg(F.coalesce(F.percentile("fan_in", F.lit(0.95)), F.lit(0.0)).alias("p95"))


def file_signals(fans: DataFrame) -> DataFrame:
    """Instability, connections, hub (fan-in over p95) and leaf (called, calls nothing)."""
    both = F.col("fan_in") + F.col("fan_out")
    out = fans.crossJoin(F.broadcast(fan_in_p95(fans)))  # one row
    return out.select(
        *fans.columns, F.when(both > 0, F.col("fan_out") / F.when(both > 0, both)).otherwise(0.0).alias("instability"), both.alias("connection_count"),
        (F.col("fan_in") > F.col("p95")).alias("is_hub"), ((F.col("fan_out") == 0) & (F.col("fan_in") > 0)).alias("is_leaf"),
    )


def call_fan(edges: DataFrame, node: str = "symbol_id", src: str = "source_symbol_id", dst: str = "target_symbol_id") -> DataFrame:
    """Confidence-weighted fan-in and fan-out of symbols, to two decimals."""
    weight = F.coalesce(F.col("confidence").cast("double"), F.lit(1.0))
    part = lambda c, i, o: edges.where(F.col(c).isNotNull()).select(F.col(c).alias(node), (weight * i).alias("i"), (weight * o).alias("o"))
    both = part(dst, 1, 0).unionByName(part(src, 0, 1))
    return both.groupBy(node).agg(round2(F.sum("i")).alias("fan_in"), round2(F.sum("o")).alias("fan_out"))


def impact(edges: DataFrame, depth: int = IMPACT_DEPTH, roots: DataFrame | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(root, impact): distinct nodes that reach the root in at most ``depth`` steps.

    All roots at once; a (root, node) pair is expanded only in the step it is first met.
    """
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct()
    start = roots.select(F.col(roots.columns[0]).alias("root")) if roots is not None else e.select(F.col("d").alias("root")).union(e.select("s"))
    start = start.distinct()
    frontier = seen = start.select("root", F.col("root").alias("node"))
    into = Adjacency(e.where("s IS NOT NULL AND d IS NOT NULL"), "d", "s", "impact-edges")
    for _ in range(depth):
        step = into.step(frontier, "node").select("root", F.col("s").alias("node")).distinct()
        frontier = written(step.join(seen, ["root", "node"], "left_anti"), "impact")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    counts = seen.where("root != node").groupBy("root").agg(F.count("*").alias("impact"))
    return start.join(counts, "root", "left").select("root", F.coalesce("impact", F.lit(0)).alias("impact"))


def reach(edges: DataFrame, start: DataFrame, depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, depth): nodes reached from ``start`` (column node) and the fewest steps."""
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct()
    frontier = seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    out = Adjacency(e.where("s IS NOT NULL AND d IS NOT NULL"), "s", "d", "reach-edges")
    for k in range(1, depth + 1):
        step = out.step(frontier.select("node"), "node").select(F.col("d").alias("node")).distinct()
        frontier = written(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(k)), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def page_rank(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, damping: float = DAMPING, epsilon: float = EPSILON, iterations: int = MAX_ITERATIONS, fixed: bool = False) -> DataFrame:
    """(node, rank).  Dangling mass is spread evenly; stops when the L1 change is small.

    Parallel edges add their weights; nodes that are only targets take part.
    """
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d"), w.alias("w")).groupBy("s", "d").agg(F.sum("w").alias("w"))
    total = e.groupBy("s").agg(F.sum("w").alias("total"))
    e = written(e.join(total, "s").where("total > 0").select("s", "d", (F.col("w") / F.col("total")).alias("share")), "edges")
    out = Adjacency(e, "s", "d", "rank-edges")
    nodes = edges.select(F.col(src).alias("node")).union(edges.select(F.col(dst))).distinct()
    nodes = written(nodes.join(e.select(F.col("s").alias("node")).distinct().withColumn("gives", F.lit(1)), "node", "left"), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks, before = nodes.select("node", "gives", F.lit(1.0 / n).alias("rank")), None
    for _ in range(iterations):
        dangling = ranks.where("gives IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = out.step(ranks.select("node", "rank"), "node").groupBy("d").agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        new = ranks.join(got, ranks["node"] == got["d"], "left").crossJoin(F.broadcast(dangling))  # one row
        new = new.select("node", "gives", F.col("rank").alias("old"), (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        step = written(new, "ranks", instead_of=before)
        ranks, before = step.drop("old"), step
        if not fixed and step.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < epsilon:
            break
    return ranks.select("node", "rank")


def _among(e: DataFrame, nodes: DataFrame, how: str = "left_semi") -> DataFrame:
    """Edges (s, d) whose ends are both among the nodes (n), or neither."""
    return e.join(nodes.select(F.col("n").alias("s")), "s", how).join(nodes.select(F.col("n").alias("d")), "d", how).select("s", "d")


#: Edges that one task finishes by itself.
FEW_EDGES = 200_000


def _by_one_task(e: DataFrame) -> DataFrame:
    """(node, component) of few edges (s, d): one depth-first walk, with its own stack."""
    kind = e.schema["s"].dataType.simpleString()

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict = {}
        for df in parts:
            for a, b in zip(df["s"], df["d"], strict=True):
                out.setdefault(a, []).append(b)
                out.setdefault(b, [])
        order, low, on, stack, rows = {}, {}, set(), [], []
        for root in out:
            if root in order:
                continue
            work = [(root, iter(out[root]))]
            order[root] = low[root] = len(order)
            stack.append(root)
            on.add(root)
            while work:
                node, rest = work[-1]
                for other in rest:
                    if other not in order:
                        order[other] = low[other] = len(order)
                        stack.append(other)
                        on.add(other)
                        work.append((other, iter(out[other])))
                        break
                    if other in on:
                        low[node] = min(low[node], order[other])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[node])
                    if low[node] == order[node]:
                        at = len(stack) - 1 - stack[::-1].index(node)
                        members = stack[at:]
                        del stack[at:]
                        on.difference_update(members)
                        if len(members) > 1:
                            rows += [(m, min(members)) for m in members]
        yield pd.DataFrame({"node": pd.Series([r[0] for r in rows]), "component": pd.Series([r[1] for r in rows])})

    return e.coalesce(1).mapInPandas(walk, f"node {kind}, component {kind}")


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst", few: int = FEW_EDGES) -> DataFrame:
    """(node, component): strongly connected components of two nodes and more.

    Forward-backward colouring: nodes without in- or out-edges among the rest are trimmed;
    the largest label that reaches a node is its colour; what reaches a colour's root
    backwards inside the colour is one component.  Named by the smallest member.  Once at
    most ``few`` edges are left, which is checked, one task finishes them.
    """
    e = written(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s != d").distinct(), "scc")
    found = None
    while not e.isEmpty():
        if e.count() <= few:
            rest = written(_by_one_task(e), "scc")
            return rest if found is None else found.unionByName(rest)
        while True:  # a node that lacks a way in or out is in no cycle
            both = e.select(F.col("s").alias("n")).distinct().join(e.select(F.col("d").alias("n")).distinct(), "n", "left_semi")
            kept = written(_among(e, both), "scc")
            if kept.count() == e.count():
                break
            e = kept
        if e.isEmpty():
            break
        colour = e.select(F.col("s").alias("n")).distinct().withColumn("c", F.col("n"))
        while True:
            push = e.join(colour.withColumnRenamed("n", "s"), "s").groupBy(F.col("d").alias("n")).agg(F.max("c").alias("m"))
            new = written(colour.join(push, "n", "left").select("n", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") > F.col("c")).alias("moved")), "colour")
            colour = new.drop("moved")
            if new.where("moved").isEmpty():
                break
        inside = e.join(colour.select(F.col("n").alias("s"), F.col("c").alias("cs")), "s").join(colour.select(F.col("n").alias("d"), F.col("c").alias("cd")), "d").where("cs = cd").select("s", "d", F.col("cs").alias("c"))
        inside = written(inside, "scc")
        back = frontier = inside.select(F.col("c").alias("n"), "c").distinct()
        while True:
            step = frontier.withColumnRenamed("n", "d").join(inside, ["d", "c"]).select(F.col("s").alias("n"), "c").distinct()
            frontier = written(step.join(back, ["n", "c"], "left_anti"), "scc")
            if frontier.isEmpty():
                break
            back = back.unionByName(frontier)
        whole = back.join(back.groupBy("c").agg(F.count("*").alias("k"), F.min("n").alias("component")).where("k > 1"), "c").select(F.col("n").alias("node"), "component")
        found = whole if found is None else found.unionByName(whole)
        done = written(back.select("n").union(colour.where("n = c").select("n")).distinct(), "scc")
        e = written(_among(e, done, "left_anti"), "scc")
    if found is None:
        return edges.select(F.col(src).alias("node"), F.col(src).alias("component")).limit(0)
    return found


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """The rows with their place in the order of a column, from 0: ranges are sorted apart and their sizes added up."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = written(df.repartitionByRange(n, by).sortWithinPartitions(by).withColumn("_at", at).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_at", "_part", "_n", "_before")


def cycles(components: DataFrame) -> DataFrame:
    """(cycle_id, member, position): components by smallest member, members in order."""
    ids = numbered(components.select("component").distinct(), "component", "cycle_id")
    return components.join(ids, "component").select("cycle_id", F.col("node").alias("member"), (F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1).alias("position"))


def callers(edges: DataFrame, inheritance: DataFrame, symbol: str, limit: int = CALLERS_LIMIT) -> DataFrame:
    """Calls of a symbol: direct ones, and those of the same member of an ancestor.

    edges: source_symbol_id, source_rel_path, target_symbol_id, call_expression, edge_kind,
    confidence; inheritance: source_fq_name, ancestor_fq_name.
    """
    from pyspark.sql import SparkSession

    spark: SparkSession = edges.sparkSession
    one = spark.createDataFrame([(symbol,)], "id string").select(split_method("id").alias("m")).select("m.*")
    bases = inheritance.join(F.broadcast(one), inheritance["source_fq_name"] == one["owner"]).select(F.concat("ancestor_fq_name", "separator", "member").alias("target_symbol_id")).distinct()
    direct = edges.where(F.col("target_symbol_id") == symbol).withColumn("via", F.lit(0))
    base = edges.where(F.col("edge_kind") == "poly-base").join(bases, "target_symbol_id", "left_semi").withColumn("via", F.lit(1))
    every = direct.unionByName(base).where(edge_visible("edge_kind", "confidence"))
    w = Window.partitionBy("source_symbol_id", "call_expression").orderBy("via", "source_rel_path", "target_symbol_id")
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "via").orderBy("source_rel_path", "source_symbol_id", "call_expression").limit(min(limit, CALLERS_CAP))


def callees(edges: DataFrame, inheritance: DataFrame, symbols: DataFrame, symbol: str, limit: int = CALLERS_LIMIT) -> DataFrame:
    """Calls by a symbol; a call of a base's member also counts for the subtypes' own ones."""
    own = edges.where((F.col("source_symbol_id") == symbol) & F.col("target_symbol_id").isNotNull()).where(edge_visible("edge_kind", "confidence"))
    poly = own.where(F.col("edge_kind") == "poly-base").withColumn("_m", split_method("target_symbol_id"))
    sub = poly.join(inheritance, poly["_m.owner"] == inheritance["ancestor_fq_name"]).withColumn("_own", F.concat("source_fq_name", "_m.separator", "_m.member"))
    known = symbols.select(F.col("symbol_id").alias("_own"), F.col("rel_path").alias("_path"))
    names = [c for c in own.columns if c not in ("target_symbol_id", "target_rel_path")]
    overrides = sub.join(known, "_own").select(*names, F.col("_own").alias("target_symbol_id"), F.col("_path").alias("target_rel_path"))
    every = own.unionByName(overrides.select(*own.columns)).dropDuplicates(["target_symbol_id", "call_expression"])
    return every.orderBy("target_rel_path", "target_symbol_id", "call_expression").limit(min(limit, CALLERS_CAP))


def paths(edges: DataFrame, start, end, depth: int = TRACE_DEPTH, limit: int = TRACE_PATHS, src: str = "src", dst: str = "dst") -> DataFrame:
    """(path, steps): simple paths, shorter first and then in order of their nodes.

    A node is only visited if the end can still be reached in the steps that are left.
    """
    depth, limit = min(depth, TRACE_DEPTH_CAP), min(limit, TRACE_PATHS_CAP)
    spark = edges.sparkSession
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s IS NOT NULL AND d IS NOT NULL").distinct()
    kind = e.schema["s"].dataType
    if start == end:
        return spark.range(1).select(F.array(F.lit(start).cast(kind)).alias("path"), F.lit(0).alias("steps"))
    target = spark.range(1).select(F.lit(end).cast(kind).alias("node"))
    left = written(reach(e, target, depth, src="d", dst="s"), "distance").select(F.col("node").alias("d"), F.col("depth").alias("left"))
    e = written(e.join(left, "d"), "edges")
    now = spark.range(1).select(F.array(F.lit(start).cast(kind)).alias("path"), F.lit(start).cast(kind).alias("s"))
    found = None
    for k in range(1, depth + 1):
        step = now.join(e, "s").where((F.col("left") <= depth - k) & ~F.array_contains("path", F.col("d"))).select(F.concat("path", F.array("d")).alias("path"), F.col("d").alias("s"))
        step = written(step, "paths")
        ends = step.where(F.col("s") == F.lit(end)).select("path", F.lit(k).alias("steps"))
        found = ends if found is None else found.unionByName(ends)
        now = step.where(F.col("s") != F.lit(end))
        if now.isEmpty() or found.count() >= limit:
            break
    return found.orderBy("steps", "path").limit(limit)


def danger(paths_: DataFrame, scored: DataFrame, node: str = "node", score_col: str = "rank_score") -> DataFrame:
    """Paths with the largest score of their steps, and the steps from the worst down."""
    keyed = paths_.withColumn("_path", F.monotonically_increasing_id())
    steps = keyed.select("_path", "path", "steps", F.explode("path").alias(node)).join(scored.select(node, score_col), node, "left")
    worst = F.transform(F.sort_array(F.collect_list(F.struct((-F.coalesce(score_col, F.lit(0.0))).alias("o"), F.col(node).alias("n")))), lambda x: x["n"])
    return steps.groupBy("_path", "path", "steps").agg(F.coalesce(F.max(score_col), F.lit(0.0)).alias("danger"), worst.alias("ranking")).drop("_path").orderBy(F.col("danger").desc(), "path")


def subtypes(inheritance: DataFrame, root: str, depth: int = 20) -> DataFrame:
    """(name, depth): all types below a type; a cycle ends where a type was met before."""
    start = inheritance.sparkSession.range(1).select(F.lit(root).alias("node"))
    return reach(inheritance, start, depth, src="ancestor_fq_name", dst="source_fq_name").where("depth > 0").select(F.col("node").alias("name"), "depth")


def hierarchy(inheritance: DataFrame) -> DataFrame:
    """(name, supertypes, subtypes) of every type, in declared order and by name."""
    up = inheritance.groupBy(F.col("source_fq_name").alias("name")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "ancestor_fq_name"))), lambda x: x["ancestor_fq_name"]).alias("supertypes"))
    down = inheritance.groupBy(F.col("ancestor_fq_name").alias("name")).agg(F.sort_array(F.collect_set("source_fq_name")).alias("subtypes"))
    none = F.array().cast("array<string>")
    return up.join(down, "name", "full").select("name", F.coalesce("supertypes", none).alias("supertypes"), F.coalesce("subtypes", none).alias("subtypes"))


def symbol_chunk(symbols: DataFrame, symbol: str) -> DataFrame:
    """The chunk of a symbol: by its exact id, or else by its last segment."""
    from ..functions.text import last_segment

    exact = F.col("symbol_id") == symbol
    near = last_segment("symbol_id") == last_segment(F.lit(symbol))
    return symbols.where(F.col("chunk_id").isNotNull() & (exact | near)).orderBy(F.when(exact, 0).otherwise(1), "rel_path", "symbol_id").limit(1)


def ambiguous_callers(fanout: DataFrame, member: str, limit: int = CALLERS_LIMIT) -> DataFrame:
    return fanout.where(F.col("member") == member).orderBy("source_rel_path", "source_symbol_id", "call_expression").limit(limit)


# -- resolution statistics ----------------------------------------------------


def _rates(c=lambda n: F.col(n)) -> list[Column]:
    missed = F.greatest(F.lit(0), c("attempted") - c("resolved") - c("external_skipped") - c("unresolvable") - c("no_in_project_def") - c("core_ambiguous"))
    whole = c("resolved") + missed
    ratio = lambda a: F.when(whole > 0, a / F.when(whole > 0, whole)).otherwise(0.0)
    return [ratio(c("resolved")).alias("edge_recall"), F.least(F.lit(1.0), ratio(c("resolved") + c("ambiguous_fanout"))).alias("covered_recall"), F.when(c("attempted") > 0, c("resolved") / F.greatest(F.lit(1), whole)).otherwise(0.0).alias("resolve_rate")]


RUN_COUNTS = ("attempted", "resolved", "external_skipped", "unresolvable", "no_in_project_def", "ambiguous_fanout", "core_ambiguous")


def resolve_summary(run_stats: DataFrame) -> DataFrame:
    """Counts and rates per language and receiver kind, per language, and over all."""
    sums = [F.sum(c).alias(c) for c in RUN_COUNTS]
    grains = run_stats.rollup("language", "receiver_kind").agg(*sums, F.grouping_id().alias("g"))
    return grains.select(F.when(F.col("g") == 0, "kind").when(F.col("g") == 1, "language").otherwise("total").alias("grain"), "language", "receiver_kind", *RUN_COUNTS, *_rates())


def edge_kinds(edges: DataFrame) -> DataFrame:
    """One row: edges by kind, their total and the share of exact ones."""
    counts = [F.sum((F.col("edge_kind") == k).cast("bigint")).alias(k.replace("-", "_")) for k in EDGE_KINDS]
    out = edges.agg(*counts, F.count("*").alias("total"))
    return out.withColumn("exact_ratio", F.when(F.col("total") > 0, F.col("exact") / F.when(F.col("total") > 0, F.col("total"))).otherwise(0.0))
