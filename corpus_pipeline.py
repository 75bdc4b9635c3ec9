"""Corpus pipeline: five stages applied one after another to ``documents``.

Each stage works on everything its predecessor kept, and its decisions take effect: the
first three remove documents, the fourth rewrites texts, the last encodes what remains.
All but the last return the columns of ``documents``; each result is written as Parquet
and read again, so that a lost executor costs at most one stage.

SQL can't express the fourth and fifth stage, so ``ORACLE_SQL`` is None and the tests
compare the whole pipeline with a plain Python version on small documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import decontaminate, near_dup, pii, piece_codec, quality_rules
from skarn.llm._jobs import written
from skarn.llm.queries import tokenizer_file


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, 0.8)."""
    return near_dup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that give it away, are replaced in the texts."""
    return pii.sanitise(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), "n_chars"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids under the public 32k pieces, and whether they decode to it."""
    return piece_codec.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("quality_rules", rules), ("near_dedup", dedup), ("decontamination", decontamination), ("pii", privacy), ("sentencepiece", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
