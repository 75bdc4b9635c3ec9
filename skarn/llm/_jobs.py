"""Spark helpers of the corpus operators: shared folder, written tables, Arrow stages."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a URI.

    Read from ``spark.checkpoint.dir`` of the session.  Where that is unset and Spark runs
    in this process alone (tests) a folder is made once and set, so that later calls find
    it; on a cluster no folder of one machine would do, and the setting is asked for.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skarn-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/skarn/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None, row_group_bytes: int | None = None) -> DataFrame:
    """Cut the lineage: write the rows as Parquet in the shared folder and read them.

    A lost executor then costs a re-read of files, not a re-run of what came before.
    The shuffle files of the finished job are let go, and so is a written table that
    nothing reads any more once this one is there (``instead_of``).
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    schema = df.schema
    (df.write.option("parquet.block.size", row_group_bytes) if row_group_bytes else df.write).parquet(path)
    release(spark)
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
        fs, inner = pafs.FileSystem.from_uri(path)
        fs.delete_dir(inner)
    for key in [k for k, (r, _) in _places.items() if r() is None]:
        del _places[key]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores more as make it new to the table."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and broadcasts that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_of(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the columns an operator needs, under its own names; others may clash freely."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def arrow_stage(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of few rows, as texts may be very long.

    A Python worker lives on from task to task; at the end of each it hands the memory it
    has freed back to the system, so that what one stage needed is there for the next.
    """
    spark = df.sparkSession

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "8388608")):
        spark.conf.set(key, value)
    return df.mapInArrow(tidy, schema)


def bloom(keys: DataFrame, *places: Column) -> tuple[int, bytes]:
    """A Bloom filter over rows, given the hashes of each: some 16 bits a row, from 128 kB to 16 MB.

    More rows than it can tell apart only let more through to the exact join.
    """
    bits = min(max((16 * keys.count()).bit_length(), 20), 27)
    at = F.explode(F.array(*[F.pmod(h, F.lit(1 << bits)) for h in places])).alias("at")
    words = keys.select(at).select((F.col("at") / 32).cast("int").alias("word"), F.expr("shiftleft(1L, cast(pmod(at, 32) as int))").alias("bit"))
    table = np.zeros(1 << (bits - 5), np.uint32)
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2**22 rows
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return bits, table.tobytes()


def in_bloom(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at these places are set; a row is in the filter if all of its places are."""
    return ((table[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1)).astype(bool)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as an empty string)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
