"""The registered queries of the corpus operators and their SQL.

``QUERIES`` maps a name to ``f(spark, sf_dir) -> DataFrame``; ``ORACLES`` holds DuckDB
SQL for those that SQL can express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, license_scan, lm_score, near_dup, pii, piece_codec, quality_classifier, quality_rules, token_store, toxicity, warc, whitening
from .oracles import ORACLES  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to WARC archives and read them back through the index."""
    manifest = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under a model of four fifths of them."""
    return lm_score.score_corpus(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, with the terms that give it away."""
    return pii.detect(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, from two thirds of the labels."""
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, from three quarters of the labels."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of benchmark items in all documents."""
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of repetition coverage for all documents."""
    out = quality_rules.measure(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents: three-word shingles, 85 per cent."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents into rANS files and read them back."""
    manifest = token_store.write_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)
    return token_store.read_tokens(manifest)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and whether decoding gives the text back."""
    return piece_codec.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), ids=False)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the eight leading components of their covariance, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 16 clusters after three rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_lm_score": op2_lm_score,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_token_store": op8_token_store,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_near_dup": op10_near_dup,
    "op11_license_scan": op11_license_scan,
    "op12_whitening": op12_whitening,
    "op13_centroids": op13_centroids,
}
