"""Enrichment: history and graph signals joined onto chunks, with markers and their health.

Signals come as tables keyed by file or by chunk.  A file's signals go to all of its chunks,
a chunk's to itself, each under its payload column (``git_file_commitCount``).  A marker
column per family and level says when it was joined and whether there was anything to
join, so that chunks which were missed can be found and joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import SIGNALS
from ..plans.payload import Payload
from . import graph
from .intervals import innermost

#: Families of signals, and the levels each has.
FAMILIES = {"git": ("file", "chunk"), "codegraph": ("file", "chunk")}
#: Metrics of ``history`` by payload field.
GIT_FILE = {
    "commitCount": "commit_count", "ageDays": "age_days", "bugFixRate": "bug_fix_rate", "relativeChurn": "relative_churn", "recencyWeightedFreq": "recency_weighted_freq", "changeDensity": "change_density", "churnVolatility": "churn_volatility",
    "recentDominantAuthor": "dominant_author", "recentDominantAuthorPct": "dominant_pct", "recentContributorCount": "contributors", "lastModifiedAt": "last_modified_at", "firstCreatedAt": "first_created_at", "taskIds": "task_ids",
    "blameDominantAuthor": "blame_dominant_author", "blameDominantAuthorPct": "blame_dominant_author_pct", "blameAuthors": "blame_authors", "blameContributorCount": "blame_contributor_count",
}
GIT_CHUNK = {
    "commitCount": "commit_count", "churnRatio": "churn_ratio", "recentContributorCount": "recent_contributor_count", "bugFixRate": "bug_fix_rate", "ageDays": "age_days", "lastModifiedAt": "last_modified_at", "relativeChurn": "relative_churn",
    "recencyWeightedFreq": "recency_weighted_freq", "changeDensity": "change_density", "churnVolatility": "churn_volatility",
}


def named(signals: DataFrame, key: str, family: str, level: str, fields: dict[str, str]) -> DataFrame:
    """The key and the signals that are there, under their payload columns."""
    return signals.select(key, *[F.col(c).alias(f"{family}_{level}_{f}") for f, c in fields.items() if c in signals.columns])


def join(chunks: DataFrame, signals: DataFrame, key: str, family: str, level: str, now: int, chunk_key: str | None = None) -> DataFrame:
    """Chunks with a family's signals of one level; ``family_level_enrichedAt`` and ``..._missing`` mark it.

    Columns that are already there are replaced, so joining again brings a chunk up to date.
    """
    own = [c for c in signals.columns if c != key]
    mark, gone = f"{family}_{level}_enrichedAt", f"{family}_{level}_missing"
    kept = chunks.drop(*own, mark, gone)
    s = signals.dropDuplicates([key]).withColumnRenamed(key, "_key").withColumn("_hit", F.lit(True))
    out = kept.join(s, kept[chunk_key or key] == s["_key"], "left")
    return out.withColumn(mark, F.lit(now).cast("bigint")).withColumn(gone, F.col("_hit").isNull()).drop("_key", "_hit")


def overlays(chunks: DataFrame, git_file: DataFrame | None = None, git_chunk: DataFrame | None = None, edges: DataFrame | None = None, calls: DataFrame | None = None, now: int = 0, path: str = "relativePath", chunk: str = "id", symbol: str = "symbolId") -> DataFrame:
    """All families that are given: file and chunk metrics, the file graph (src, dst) and the call graph."""
    out = chunks
    if git_file is not None:
        out = join(out, named(git_file, "file", "git", "file", GIT_FILE), "file", "git", "file", now, path)
    if git_chunk is not None:
        out = join(out, named(git_chunk, "chunk_id", "git", "chunk", GIT_CHUNK), "chunk_id", "git", "chunk", now, chunk)
    if edges is not None:
        files = chunks.select(F.col(path).alias("rel_path")).distinct()
        made = graph.file_signals(graph.fan(edges, files)).join(graph.impact(edges), F.col("rel_path") == F.col("root"), "left")
        fields = {"fanIn": "fan_in", "fanOut": "fan_out", "instability": "instability", "connectionCount": "connection_count", "isHub": "is_hub", "isLeaf": "is_leaf", "transitiveImpact": "impact"}
        out = join(out, named(made, "rel_path", "codegraph", "file", fields), "rel_path", "codegraph", "file", now, path)
    if calls is not None:
        fan = graph.call_fan(calls)
        ranks = graph.page_rank(calls.where("target_symbol_id IS NOT NULL AND source_symbol_id IS NOT NULL"), "source_symbol_id", "target_symbol_id", "confidence")
        made = fan.join(ranks.withColumnRenamed("node", "symbol_id"), "symbol_id", "left")
        out = join(out, named(made, "symbol_id", "codegraph", "chunk", {"fanIn": "fan_in", "fanOut": "fan_out", "pageRank": "rank"}), "symbol_id", "codegraph", "chunk", now, symbol)
    return out


def health(chunks: DataFrame) -> DataFrame:
    """(family, level, chunks, enriched, missing, unenriched, state) of every family and level.

    ``healthy``: all joined; ``partial``: some never joined; ``absent``: none joined.
    """
    rows = []
    for family, levels in FAMILIES.items():
        for level in levels:
            mark, gone = f"{family}_{level}_enrichedAt", f"{family}_{level}_missing"
            has = F.col(mark).isNotNull() if mark in chunks.columns else F.lit(False)
            lost = F.coalesce(F.col(gone), F.lit(False)) if gone in chunks.columns else F.lit(False)
            rows.append(F.struct(F.lit(family).alias("family"), F.lit(level).alias("level"), F.count("*").alias("chunks"), F.coalesce(F.sum(has.cast("bigint")), F.lit(0)).alias("enriched"), F.coalesce(F.sum((has & lost).cast("bigint")), F.lit(0)).alias("missing")))
    one = chunks.agg(F.array(*rows).alias("all")).select(F.explode("all").alias("r")).select("r.*").withColumn("unenriched", F.col("chunks") - F.col("enriched"))
    return one.withColumn("state", F.when((F.col("enriched") == 0) & (F.col("chunks") > 0), "absent").when(F.col("unenriched") > 0, "partial").otherwise("healthy"))


def pending(chunks: DataFrame, family: str, level: str, again_before: int | None = None) -> DataFrame:
    """Chunks that a family never reached, or reached before a time."""
    mark = f"{family}_{level}_enrichedAt"
    if mark not in chunks.columns:
        return chunks
    late = F.col(mark) < again_before if again_before is not None else F.lit(False)
    return chunks.where(F.col(mark).isNull() | late)


def attach_chunks(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Symbols (rel_path, symbol_id, line) with ``chunk_id``: by id in their file (the last one counts), or the innermost chunk at their line.

    chunks: rel_path, chunk_id, symbol_id, start_line, end_line.
    """
    w = Window.partitionBy("rel_path", "symbol_id").orderBy(F.col("start_line").desc(), F.col("chunk_id").desc())
    by_id = chunks.where("symbol_id IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("rel_path", "symbol_id", F.col("chunk_id").alias("_by_id"))
    met = symbols.join(by_id, ["rel_path", "symbol_id"], "left")
    if "line" not in symbols.columns:
        return met.withColumnRenamed("_by_id", "chunk_id")
    rest = met.where("_by_id IS NULL AND line IS NOT NULL").select("rel_path", "symbol_id", "line").distinct().withColumn("_point", F.concat_ws(":", "rel_path", "symbol_id", "line"))
    ranges = chunks.select("rel_path", F.col("chunk_id").alias("_near"), "start_line", "end_line", F.lit(0).alias("_depth"))
    near = innermost(rest, ranges, "rel_path", "line", ("start_line", "end_line"), "_point", "_depth", "_near").select("_point", "_near")
    met = met.withColumn("_point", F.concat_ws(":", "rel_path", "symbol_id", "line")).join(near, "_point", "left")
    return met.withColumn("chunk_id", F.coalesce("_by_id", "_near")).drop("_by_id", "_near", "_point")


def graph_exclusion(path: str, language_kind: str = "kind") -> Column:
    """Files that take no part in the code graph: generated ones and tests."""
    return F.col(language_kind).isin("generated", "test") | F.col(path).rlike(r"(^|/)(node_modules|vendor|dist|build|__generated__)/|\.min\.js$|\.d\.ts$")


def merged(results: list[DataFrame], id_col: str = "id") -> DataFrame:
    """Results of several scrolls as one: a row's first list counts, in the order of the lists."""
    every = None
    for k, r in enumerate(results):
        part = r.withColumn("_list", F.lit(k))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    w = Window.partitionBy(id_col).orderBy("_list")
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_list")


def overlay(df: DataFrame, mask: dict[str, list[str]] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Results with ``overlay``: the raw values behind their score, as a struct of ``file`` and ``chunk`` maps.

    A mask names fields per level; without one, the sources of the active weights are shown.
    """
    from ..plans.catalog import DERIVED
    from ..plans.signals import payload_key

    p = Payload(df)
    if mask is None:
        keys = sorted({payload_key(n, s) for n, w in (weights or {}).items() if w for s in DERIVED[n].sources})
        mask = {level: [k for k in keys if f".{level}." in k] for level in ("file", "chunk")}
    else:
        mask = {level: [next((k for k in SIGNALS if k.endswith(f".{level}.{f}")), f) for f in fields] for level, fields in mask.items()}
    shown = lambda keys: F.map_filter(F.create_map(*[x for k in keys if p.has(k) for x in (F.lit(k.rpartition(".")[2]), p[k].cast("string"))]), lambda k, v: v.isNotNull()) if any(p.has(k) for k in keys) else F.create_map().cast("map<string,string>")
    return df.withColumn("overlay", F.struct(*[shown(mask.get(level, [])).alias(level) for level in ("file", "chunk")]))


def essential(df: DataFrame) -> DataFrame:
    """Results with the essential payload fields only, of each family a struct of its levels, over what an overlay shows."""
    p = Payload(df)
    out = []
    for family in FAMILIES:
        levels = []
        for level in FAMILIES[family]:
            keys = [k for k, s in SIGNALS.items() if s.essential and k.startswith(f"{family}.{level}.") and p.has(k)]
            if keys:
                levels.append(F.struct(*[p[k].alias(k.rpartition(".")[2]) for k in keys]).alias(level))
        if levels:
            out.append(F.struct(*levels).alias(family))
    plain = [c for c in df.columns if not c.startswith(tuple(f"{f}_" for f in FAMILIES)) and not c.startswith("_")]
    return df.select(*[c for c in plain if c not in FAMILIES], *out)


def document_preset(rerank, language: str | None = None, documentation: str | None = None):
    """The preset of a search over documentation where none is named."""
    if rerank is None and (documentation == "only" or language == "markdown"):
        return "documentationRelevance"
    return rerank
