"""Version-control logs as tables.

A log is one text whose fields are cut by NUL characters; it is read as one record per
commit with a custom separator, and parsed by Column expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("sha", "parents", "author", "email", "ts", "body")
_SHA = r"^[a-f0-9]{40}$"


def commits(spark: SparkSession, text: str | None = None, path: str | None = None, committer_time: bool = False) -> DataFrame:
    """One row per commit: sha, parents, author, email, ts, body, stat (its files' text).

    From a log in a string or a file.  A field group begins at a 40-digit hash; others
    before it are skipped.
    """
    if path is not None:
        raw = spark.read.option("wholetext", True).text(path)
    else:
        raw = spark.createDataFrame([(text or "",)], "value string")
    names = [*FIELDS[:5], *(["committer_ts"] if committer_time else []), "body", "stat"]
    parts = raw.select(F.split("value", "\x00").alias("p"))
    is_sha = lambda i: F.trim(F.element_at(F.col("p"), i)).rlike(_SHA)
    # the field after a commit's own hash is its parents, which may be one hash
    first = F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: is_sha(i) & ~F.when(i > 1, is_sha(F.greatest(i - 1, F.lit(1)))).otherwise(F.lit(False)))
    heads = parts.select("p", F.explode(first).alias("i"))
    at = lambda k: F.coalesce(F.try_element_at("p", F.col("i") + k), F.lit(""))
    out = heads.select(*[at(k).alias(n) for k, n in enumerate(names)])
    return out.select(
        F.trim("sha").alias("sha"), F.filter(F.split(F.trim("parents"), " "), lambda x: x != "").alias("parents"), "author", "email", F.expr("try_cast(ts AS bigint)").alias("ts"),
        *([F.expr("try_cast(committer_ts AS bigint)").alias("committer_ts")] if committer_time else []), "body", "stat",
    )


def numstat(commits_: DataFrame) -> DataFrame:
    """One row per commit and file: lines added and deleted; binary files (``-``) are left out."""
    keep = [c for c in commits_.columns if c != "stat"]
    lines = commits_.select(*keep, F.explode(F.split("stat", "\n")).alias("line")).withColumn("p", F.split("line", "\t"))
    out = lines.where(F.size("p") >= 3).select(*keep, F.element_at("p", 3).alias("file"), F.expr("try_cast(p[0] AS bigint)").alias("added"), F.expr("try_cast(p[1] AS bigint)").alias("deleted"))
    return out.where("added IS NOT NULL AND deleted IS NOT NULL")


def changed_files(commits_: DataFrame) -> DataFrame:
    """One row per commit with its list of changed files (a log of names only)."""
    files = F.filter(F.transform(F.split("stat", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return commits_.withColumn("files", files).drop("stat")


def touching(changes: DataFrame, paths: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Commits that change any of some paths within a range of time, each with those of its files.

    changes: as ``numstat`` gives them; paths: one column of files or folders.  A file is looked up by
    itself and by each of its folders, so it is an equi join whatever the number of paths.  ``since`` and
    ``until`` are seconds, both included, and reach the scan.
    """
    rows = changes if since is None else changes.where(F.col("ts") >= since)
    rows = rows if until is None else rows.where(F.col("ts") <= until)
    wanted = paths.select(F.regexp_replace(F.col(paths.columns[0]), "/+$", "").alias("_path")).distinct()
    parts = F.split("file", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    met = rows.withColumn("_path", F.explode(prefixes)).join(wanted, "_path", "left_semi")
    return met.groupBy("sha").agg(F.first("author").alias("author"), F.first("ts").alias("ts"), F.array_sort(F.collect_set("file")).alias("files"))


def blame(spark: SparkSession, text: str) -> DataFrame:
    """One row per live line of a porcelain blame: line, author, email, sha, ts.

    Fields of a commit stand only with its first line; later lines take them from there.
    """
    lines = spark.createDataFrame(list(enumerate(text.split("\n"))), "at bigint, t string")
    head = r"^([a-f0-9]{40}) \d+ (\d+)"
    marked = lines.withColumn("head", F.when(F.col("t").rlike(head), F.col("at")))
    from pyspark.sql import Window

    run = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # one file's lines
    grouped = marked.withColumn("g", F.last("head", ignorenulls=True).over(run)).where("g IS NOT NULL")
    field = lambda name: F.max(F.when(F.col("t").startswith(name + " "), F.regexp_extract("t", f"^{name} (.*)$", 1)))
    rows = grouped.groupBy("g").agg(F.max(F.regexp_extract("t", head, 1)).alias("sha"), F.max(F.when(F.col("t").rlike(head), F.regexp_extract("t", head, 2).cast("bigint"))).alias("line"), field("author").alias("author"), field("author-mail").alias("email"), field("author-time").alias("ts"))
    known = rows.where("author IS NOT NULL").groupBy("sha").agg(F.first("author").alias("a"), F.first("email").alias("e"), F.first("ts").alias("t"))
    out = rows.join(known, "sha", "left")
    return out.select("line", F.coalesce("author", "a").alias("author"), F.regexp_replace(F.coalesce("email", "e"), "[<>]", "").alias("email"), "sha", F.coalesce("ts", "t").cast("bigint").alias("ts"))
