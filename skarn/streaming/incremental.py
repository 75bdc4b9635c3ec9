"""Incremental indexing: micro-batches of changed files against an index of chunks.

A stream of file versions is applied batch by batch.  A batch writes what it changes and
nothing else: the chunks of its added and changed files, and then one row per path it has
touched, which commits it.  The index is what the latest batch of each path has written.
So the work of a batch follows its changes, not the size of the index; a batch that is run
twice is skipped; one that was lost half-way has no commit and is written again; and an
index is found on its folder whoever opens it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.segment import chunks


class Index:
    """The chunks of all files, in a folder that Spark writes."""

    def __init__(self, spark: SparkSession, folder: str, chunker: Callable[[DataFrame], DataFrame] = chunks):
        self.spark, self.folder, self.chunker = spark, folder.rstrip("/"), chunker

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def applied(self, batch_id: int) -> bool:
        return self._exists(f"{self.folder}/paths/batch={batch_id}/_SUCCESS")

    def read(self) -> DataFrame:
        """Chunks of the latest version of every path."""
        if not self._exists(f"{self.folder}/paths"):
            raise LookupError("nothing is indexed yet")
        latest = self.spark.read.parquet(f"{self.folder}/paths").groupBy("path").agg(F.max("batch").alias("batch"))
        return self.spark.read.parquet(f"{self.folder}/chunks").join(latest, ["path", "batch"], "left_semi").drop("batch")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """batch: path, language, text, deleted, seq.  The last version of a path counts."""
        if self.applied(batch_id):
            return
        w = Window.partitionBy("path").orderBy(F.col("seq").desc())
        last = batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        made = self.chunker(last.where(~F.coalesce("deleted", F.lit(False))))
        made.write.mode("overwrite").parquet(f"{self.folder}/chunks/batch={batch_id}")
        last.select("path").write.mode("overwrite").parquet(f"{self.folder}/paths/batch={batch_id}")

    def compact(self, folder: str) -> Index:
        """The same index in a new folder as one batch, when many have come together."""
        last = self.spark.read.parquet(f"{self.folder}/paths").agg(F.max("batch")).first()[0]
        self.read().write.mode("overwrite").parquet(f"{folder}/chunks/batch={last}")
        out = Index(self.spark, folder, self.chunker)
        self.spark.read.parquet(f"{self.folder}/paths").select("path").distinct().write.mode("overwrite").parquet(f"{folder}/paths/batch={last}")
        return out

    def follow(self, stream: DataFrame, checkpoint: str, once: bool = True):
        """Apply a stream of file versions; with ``once``, what is there now."""
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 day", late: str = "1 day", key: str = "event_type") -> DataFrame:
    """Counts per window and key with a watermark, for batch and stream tables alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
