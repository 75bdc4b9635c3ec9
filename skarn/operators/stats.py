"""Collection statistics: percentiles at three grains, distributions, background."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import cosine
from ..plans.catalog import SIGNALS, Signal
from ..plans.payload import Payload
from ..storage import written

# Smallest share and sample of a language to have its own statistics.
LANGUAGE_SHARE, LANGUAGE_SAMPLE = 0.05, 10
#: Languages whose chunks are documentation or data, not code.
NOT_CODE = ("markdown", "json", "yaml", "toml", "xml", "text", "unknown")


def scope(df: DataFrame, is_test_path: Column | None = None) -> Column:
    """test, source or null (setup); a test path counts as source where tests have chunks.

    The number of test chunks per language is a window over language with one counter.
    """
    p = Payload(df)
    tests = F.sum((p["chunkType"] == "test").cast("int")).over(Window.partitionBy(p["language"]))
    path = F.coalesce(is_test_path if is_test_path is not None else p["isTest"], F.lit(False))
    return F.when(p["chunkType"] == "test", "test").when(p["chunkType"] == "test_setup", None).when(path & (tests == 0), "test").otherwise("source")


def _melted(df: DataFrame, signals: Iterable[Signal], scope_col: str) -> DataFrame:
    """(signal, language, scope, value): values above 0 that count for their signal."""
    p = Payload(df)
    rows = []
    for s in signals:
        value = p[s.key].cast("double")
        if s.only:
            value = F.when(p["chunkType"] == s.only, value)
        if s.once_per_file:
            value = F.when(F.col("_first"), value)
        rows.append(F.struct(F.lit(s.key).alias("signal"), value.alias("value")))
    w = Window.partitionBy(p["relativePath"]).orderBy(p["startLine"], p["id"]) if p.has("id") else Window.partitionBy(p["relativePath"]).orderBy(p["startLine"])
    first = df.withColumn("_first", F.row_number().over(w) == 1) if any(s.once_per_file for s in signals) else df
    return first.select(p["language"].alias("language"), F.col(scope_col).alias("scope"), F.explode(F.array(*rows)).alias("r")).select("language", "scope", "r.signal", "r.value").where(F.col("value") > 0)


def signal_percentiles(df: DataFrame, keys: Iterable[str] | None = None, scope_col: str = "scope", digits: int = 6) -> DataFrame:
    """(grain, language, scope, signal, n, p10 ... p95, min, max, mean, stddev).

    One pass with grouping sets: the collection, each language, each language and scope.
    Percentiles interpolate linearly.
    """
    known = [SIGNALS[k] for k in keys] if keys else [s for s in SIGNALS.values() if s.percentiles]
    long = _melted(df, known, scope_col)
    at = {p: f"round(percentile(value, {p / 100}), {digits}) AS p{p}" for p in (10, 25, 50, 75, 90, 95)}
    return df.sparkSession.sql(f"""
        SELECT CASE grouping_id(signal, language, scope) WHEN 3 THEN 'collection' WHEN 1 THEN 'language' ELSE 'scope' END AS grain,
               language, scope, signal, count(*) AS n, {', '.join(at.values())}, round(min(value), {digits}) AS min_value, round(max(value), {digits}) AS max_value,
               round(avg(value), {digits}) AS mean_value, round(stddev_pop(value), {digits}) AS stddev_value
        FROM {{long}} GROUP BY GROUPING SETS ((signal), (signal, language), (signal, language, scope))""", long=long)


def kept_languages(df: DataFrame) -> DataFrame:
    """Languages with enough of the collection to be told apart."""
    p = Payload(df)
    counts = df.groupBy(p["language"].alias("language")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).where((F.col("n") >= LANGUAGE_SHARE * F.col("total")) & (F.col("n") >= LANGUAGE_SAMPLE)).select("language", "n")


def as_mapping(stats: DataFrame) -> dict[str, dict[int, float]]:
    """Collection-grain percentiles as the mapping that filters and ranks take: a row per signal."""
    rows = stats.where("grain = 'collection'").collect()
    return {r.signal: {p: r[f"p{p}"] for p in (10, 25, 50, 75, 90, 95)} for r in rows}


def counts_by(df: DataFrame, key: str) -> DataFrame:
    p = Payload(df)
    return df.groupBy(p[key].alias("value")).agg(F.count("*").alias("n"))


def summary(df: DataFrame) -> DataFrame:
    """One row: chunks, documentation and code chunks, files, time range, files with history."""
    p = Payload(df)
    first, last = p["git.file.firstCreatedAt"], p["git.file.lastModifiedAt"]
    doc = F.coalesce(p["isDocumentation"], F.lit(False))
    return df.agg(
        F.count("*").alias("chunks"), F.sum(doc.cast("int")).alias("doc_chunks"), F.sum((~doc).cast("int")).alias("code_chunks"), F.countDistinct(p["relativePath"]).alias("files"),
        F.min(F.when(first > 0, first)).alias("first_created"), F.max(F.when(last > 0, last)).alias("last_modified"), F.countDistinct(F.when(first > 0, p["relativePath"])).alias("files_with_history"),
    )


def top_and_others(df: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """(value, n): the most frequent values and the sum of all others."""
    counts = counts_by(df, key).where(F.col("value").isNotNull())
    best = counts.orderBy(F.col("n").desc(), "value").limit(limit)
    rest = counts.join(best.select("value"), "value", "left_anti").agg(F.lit("(others)").alias("value"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return best.unionByName(rest.where("n > 0"))


def score_background(vectors: DataFrame, sample: int | None = None, min_pairs: int = 50, vec_col: str = "embedding", id_col: str = "vec_id", digits: int = 6) -> DataFrame:
    """One row: mean, stddev and number of cosines of disjoint pairs of neighbours by id.

    Of all vectors with the most frequent length, or of the first ``sample`` of them by id where a
    caller gives one.  No row with fewer pairs than ``min_pairs``.
    """
    sized = vectors.select(id_col, vec_col, F.size(vec_col).alias("width"))
    width = sized.groupBy("width").agg(F.count("*").alias("k"), F.min(id_col).alias("first")).orderBy(F.col("k").desc(), "first").limit(1).select("width")
    some = sized.join(F.broadcast(width), "width").select(id_col, vec_col)
    some = some if sample is None else some.orderBy(id_col).limit(sample)
    # ranges of ids are numbered by themselves, from where the ranges before them end
    dealt = written(some.repartitionByRange(id_col).withColumn("part", F.spark_partition_id()), "by-id")
    before = F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy("part").agg(F.count("*").alias("k")).select("part", before.alias("before"))  # as many rows as partitions
    at = F.row_number().over(Window.partitionBy("part").orderBy(id_col)) - 1 + F.col("before")
    placed = dealt.join(F.broadcast(parts), "part").withColumn("at", at)
    pair = placed.groupBy(F.floor(F.col("at") / 2).alias("pair")).agg(F.max(F.when(F.col("at") % 2 == 0, F.col(vec_col))).alias("a"), F.max(F.when(F.col("at") % 2 == 1, F.col(vec_col))).alias("b"))
    scored = pair.where("a IS NOT NULL AND b IS NOT NULL").select(cosine("a", "b").alias("s"))
    return scored.agg(F.round(F.avg("s"), digits).alias("mean"), F.round(F.stddev_pop("s"), digits).alias("stddev"), F.count("*").alias("pairs")).where(F.col("pairs") >= min_pairs)


def thresholds(stats: DataFrame, labels: Mapping[str, Signal] = SIGNALS) -> DataFrame:
    """(grain, language, scope, signal, label, threshold): what each label begins at."""
    rows = [(s.key, p, name) for s in labels.values() for p, name in s.labels.items()]
    table = stats.sparkSession.createDataFrame(rows, "signal string, p int, label string")
    wide = stats.select("grain", "language", "scope", "signal", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"p{p}").alias("threshold")) for p in (10, 25, 50, 75, 90, 95)])).alias("x"))
    return wide.select("grain", "language", "scope", "signal", "x.p", "x.threshold").join(F.broadcast(table), ["signal", "p"])
