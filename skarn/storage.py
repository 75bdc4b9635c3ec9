"""Written tables: cut lineage in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where unset and Spark runs in this process alone (tests), a new local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skarn-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/skarn/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step", instead_of: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Write the rows as Parquet and read them back: loops keep short plans and survive lost executors.

    ``by``: columns whose values become folders, so that a filter on them prunes.  A written
    table that nothing reads once this one is there is deleted (``instead_of``).
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _places[id(out)] = (weakref.ref(out), path)
    if instead_of is not None:
        discard(instead_of)
    return out


_places: dict[int, tuple[weakref.ref, str]] = {}


def discard(table: DataFrame) -> None:
    """Delete the files of a written table; another DataFrame is left alone."""
    ref, path = _places.pop(id(table), (None, ""))
    if ref is not None and ref() is table:
        jvm = table.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    for key in [k for k, (r, _) in _places.items() if r() is None]:
        del _places[key]


def listing(spark: SparkSession, path: str) -> str:
    """What a table is made of now: path, length and time of each file, digested; another listing is another table."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(target))
    return f"{path}#{hashlib.sha256(repr(files).encode()).hexdigest()}"


def bucketed(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """Write the rows as a table of the catalog, in one bucket per shuffle partition, in the shared folder.

    A join on ``by`` then moves the other side only, as often as it is done.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"skarn_{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.repartition(n, *by).write.format("parquet").option("path", fresh_path(spark, name)).bucketBy(n, *by).sortBy(*by).saveAsTable(table)
    return spark.table(table)


_stored: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame], by: list[str] | None = None) -> DataFrame:
    """A table derived from ``source`` (see ``listing``), written the first time it is asked for and read after that.

    For what a collection keeps beside its rows (postings, codes): made once per
    application, partitioned by ``by``, so that queries prune to what they need.
    """
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _stored:
        path = f"{shared_dir(spark)}/skarn/{name}-{uuid.uuid4().hex}"
        made = build()
        schema = made.schema
        (made.write.partitionBy(*by) if by else made.write).parquet(path)
        _stored[key] = spark.read.schema(schema).parquet(path)
    return _stored[key]


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``new`` stand in for rows of ``old`` with the same key."""
    keys = [key] if isinstance(key, str) else key
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def patch(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of ``changes`` that are not null are set on the rows of their key."""
    names = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names])
    out = old.join(renamed, key, "left")
    return out.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in old.columns], *[F.col(f"_new_{c}").alias(c) for c in names if c not in old.columns])


def delete(old: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose key is listed go."""
    return old.join(keys, key, "left_anti")
