"""Tables by name in a folder, in any of Spark's formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str, form: str = "parquet", **options) -> DataFrame:
    suffix = "" if form == "table" else f".{form}"
    return spark.read.options(**options).format(form).load(f"{folder}/{name}{suffix}")


def views(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Register tables as temporary views for SQL."""
    for n in names:
        load(spark, folder, n).createOrReplaceTempView(n)
