"""Dense, sparse, hybrid and recommend retrieval.

A query vector is a literal in the plan, so a search is one scan with a per-task top-k
(TakeOrderedAndProject) and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import cosine, dot, euclidean
from ..functions.terms import term_counts
from ..functions.text import bm25_tf, code_tokens, feature_hash
from ..storage import written

RRF_K = 60


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def similarity(column: str, query: Sequence[float], distance: str = "cosine") -> Column:
    """Larger is nearer: cosine, dot product, or the negated Euclidean distance."""
    q = vector(query)
    return {"cosine": lambda: cosine(column, q), "dot": lambda: dot(column, q), "euclid": lambda: -euclidean(column, q)}[distance]()


def dense(df: DataFrame, query: Sequence[float], limit: int, where: Column | None = None, vec_col: str = "embedding", id_col: str = "vec_id", distance: str = "cosine", digits: int | None = 6) -> DataFrame:
    """Exact k nearest neighbours with their ``score``; equal scores by id."""
    s = similarity(vec_col, query, distance)
    rows = (df if where is None else df.where(where)).withColumn("score", F.round(s, digits) if digits is not None else s)
    return rows.orderBy(F.col("score").desc(), id_col).limit(limit)


def vector_of(df: DataFrame, id_value, vec_col: str = "embedding", id_col: str = "vec_id") -> list[float]:
    """One stored vector by id."""
    row = df.where(F.col(id_col) == id_value).select(vec_col).first()
    if row is None:
        raise KeyError(f"no vector {id_value}")
    return [float(x) for x in row[0]]


def coded(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id, codes): each vector as 8-bit integers of its largest component, to be stored."""
    scale = F.array_max(F.transform(vec_col, lambda x: F.abs(x))).cast("double")
    return df.select(id_col, F.transform(vec_col, lambda x: F.round(x / F.when(scale > 0, scale) * 127).cast("tinyint")).alias("codes"))


def quantised(df: DataFrame, codes: DataFrame, query: Sequence[float], limit: int, oversample: float = 2.0, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """Search on stored codes (a quarter of the bytes of floats), then rescore the best exactly.

    The best ``limit * oversample`` ids come to the driver and go back as literals, so a table
    sorted by id is read where they are; ``inverted`` also keeps vectors in folders.
    """
    rough = dense(codes, query, int(limit * oversample), None, "codes", id_col, digits=None).select(id_col).collect()
    return dense(df.where(F.col(id_col).isin([r[0] for r in rough])), query, limit, None, vec_col, id_col)


class RecommendError(ValueError):
    pass


def recommend(df: DataFrame, positive: Sequence[Sequence[float]], negative: Sequence[Sequence[float]] = (), strategy: str = "best_score", limit: int = 10, exclude: Sequence = (), vec_col: str = "embedding", id_col: str = "vec_id", digits: int = 6) -> DataFrame:
    """Rows like the positives and unlike the negatives.

    ``average_vector``: near 2 * mean(positives) - mean(negatives), or the positives' mean;
    ``sum_scores``: sum of cosines to positives less that to negatives; ``best_score``:
    the best positive cosine if it beats the best negative one, else the latter negated.
    """
    if not positive and (strategy != "best_score" or not negative):
        raise RecommendError("a positive example is needed" if negative or strategy != "best_score" else "an example is needed")
    rows = df.where(~F.col(id_col).isin(list(exclude))) if exclude else df
    if strategy == "average_vector":
        mean = lambda xs: [sum(c) / len(xs) for c in zip(*xs, strict=True)]
        p = mean(positive)
        q = [2 * a - b for a, b in zip(p, mean(negative), strict=True)] if negative else p
        s = cosine(vec_col, vector(q))
    else:
        good, bad = [cosine(vec_col, vector(v)) for v in positive], [cosine(vec_col, vector(v)) for v in negative]
        if strategy == "sum_scores":
            s = reduce(lambda a, b: a + b, good) - reduce(lambda a, b: a + b, bad, F.lit(0.0))
        elif strategy == "best_score":
            best = lambda xs: F.greatest(*xs) if len(xs) > 1 else xs[0] if xs else F.lit(float("-inf"))
            s = F.when(best(good) > best(bad), best(good)).otherwise(-best(bad))
        else:
            raise RecommendError(f"unknown strategy {strategy}")
    return rows.withColumn("score", F.round(s, digits)).orderBy(F.col("score").desc(), id_col).limit(limit)


def grouped(df: DataFrame, query: Sequence[float], group_col: str, group_size: int = 3, groups: int | None = None, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The best hits of each group; at most ``groups`` groups, by their best hit."""
    w = Window.partitionBy(group_col).orderBy(F.col("score").desc(), id_col)
    hits = df.withColumn("score", F.round(similarity(vec_col, query), 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= group_size)
    if groups is not None:
        best = hits.where("rank = 1").orderBy(F.col("score").desc(), group_col).limit(groups).select(group_col)
        hits = hits.join(best, group_col, "left_semi")
    return hits


#: Partitions of stored postings; a query reads those of its buckets only.
PARTS = 64
#: Bytes of text that a Python worker takes at a time, and rows it gives at a time.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1 << 18


def terms(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", buckets: Sequence[int] | None = None) -> DataFrame:
    """(id, length, bucket, tf): the sparse form of each text, or its part in some buckets.

    Tokens are counted where the text is, so none of them moves; ids that repeat are not added up here.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    wanted = None if buckets is None else np.array(sorted(buckets), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, doc, length, bucket, tf in term_counts(b.column(1)):
                if wanted is not None:
                    keep = np.isin(bucket, wanted)
                    doc, length, bucket, tf = doc[keep], length[keep], bucket[keep], tf[keep]
                for at in range(0, len(doc), BATCH_ROWS):
                    cut = slice(at, at + BATCH_ROWS)
                    columns = [b.column(0).take(pa.array(first + doc[cut])), pa.array(length[cut], pa.int32()), pa.array(bucket[cut], pa.int32()), pa.array(tf[cut], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, [id_col, "length", "bucket", "tf"])

    return df.select(id_col, text_col).where(F.col(text_col).isNotNull()).mapInArrow(run, f"{id_col} {kind}, length int, bucket int, tf bigint")


def postings(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, bucket, tf, length, part): the sparse form of each text, to be stored by ``part``.

    Rows are dealt by ranges of (part, bucket, id) and come sorted, so a frequent bucket is written by
    several tasks and a reader skips most of a file.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = terms(df, text_col, id_col).select(id_col, "length", "bucket", "tf")
    # the borders of ranges are found on what is written, so that texts are read once
    made = written(made.withColumn("part", (F.col("bucket") % PARTS).cast("int")), "terms")
    dealt = made.repartitionByRange(n, "part", "bucket", id_col)
    # ids may repeat; all rows of a bucket and id are in one range, so nothing moves again
    return dealt.groupBy(id_col, "length", "bucket", "part").agg(F.sum("tf").alias("tf")).select(id_col, "length", "bucket", "tf", "part").sortWithinPartitions("part", "bucket", id_col)


def stored_sparse(post: DataFrame, n_docs: int, query: str, limit: int, id_col: str = "doc_id", digits: int = 6) -> DataFrame:
    """BM25 over stored postings of ``n_docs`` texts: as ``sparse``, without reading a text."""
    weights = query_weights(post.sparkSession, query)
    if not weights:
        return post.select(id_col, F.lit(0.0).alias("score")).limit(0)
    hits = post.where(F.col("part").isin(sorted({b % PARTS for b in weights})) & F.col("bucket").isin(list(weights)))
    return _scored(hits, hits.groupBy("bucket").agg(F.count("*").alias("df")).withColumn("n_docs", F.lit(n_docs)), weights, limit, id_col, digits)


def _scored(hits: DataFrame, freq: DataFrame, weights: dict[int, float], limit: int, id_col: str, digits: int) -> DataFrame:
    """The best rows by the sum of query weight * document weight * idf; freq has a row per bucket of the query."""
    idf = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    q = F.create_map(*[x for b, w in weights.items() for x in (F.lit(b), F.lit(w))])
    scored = hits.join(F.broadcast(freq), "bucket").select(id_col, (q[F.col("bucket")] * bm25_tf("tf", "length") * idf).alias("part"))
    return scored.groupBy(id_col).agg(F.round(F.sum("part"), digits).alias("score")).orderBy(F.col("score").desc(), id_col).limit(limit)


def query_weights(spark: SparkSession, query: str) -> dict[int, float]:
    """Bucket weights of a query: the BM25 term weights of its own text."""
    one = spark.createDataFrame([(query,)], "text string").select(code_tokens("text").alias("t"))
    rows = one.select(F.explode("t").alias("token"), F.size("t").alias("length")).groupBy("length", feature_hash("token").alias("bucket")).agg(F.count("*").alias("tf")).select("bucket", bm25_tf("tf", "length").alias("w")).collect()  # as many rows as the query has terms
    return {r.bucket: r.w for r in rows}


def sparse(df: DataFrame, query: str, limit: int, text_col: str = "text", id_col: str = "doc_id", digits: int = 6) -> DataFrame:
    """BM25 over hashed tokens: sum of query weight * document weight * idf."""
    weights = query_weights(df.sparkSession, query)
    if not weights:
        return df.select(id_col, F.lit(0.0).alias("score")).limit(0)
    hits = written(terms(df, text_col, id_col, list(weights)).groupBy(id_col, "length", "bucket").agg(F.sum("tf").alias("tf")), "hits")
    freq = hits.groupBy("bucket").agg(F.count("*").alias("df"))  # as many rows as the query has buckets
    n = df.agg(F.count("*").alias("n_docs"))
    return _scored(hits, freq.crossJoin(n), weights, limit, id_col, digits)


def fuse(rankings: Sequence[DataFrame], id_col: str, limit: int, weights: Sequence[float] | None = None, k: int = RRF_K, digits: int = 8) -> DataFrame:
    """Reciprocal rank fusion of result lists (id, score); a list's rank starts at 1."""
    parts = []
    for r, w in zip(rankings, weights or [1.0] * len(rankings), strict=True):
        ordered = r.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("score").desc(), id_col)))  # a list of at most its limit
        parts.append(ordered.select(id_col, (F.lit(float(w)) / (k + F.col("_rank"))).alias("_part")))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(id_col).agg(F.round(F.sum("_part"), digits).alias("score")).orderBy(F.col("score").desc(), id_col).limit(limit)


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, query_vector: Sequence[float], limit: int, dense_weight: float | None = None, id_col: str = "doc_id", vec_id: str = "vec_id", post: DataFrame | None = None) -> DataFrame:
    """Dense and sparse lists of ``limit`` rows each, fused; weights are w and 1 - w.

    With stored postings (``post``) the texts are only counted.
    """
    a = dense(vectors, query_vector, limit, id_col=vec_id).select(F.col(vec_id).alias(id_col), "score")
    b = sparse(docs, query, limit, id_col=id_col) if post is None else stored_sparse(post, docs.count(), query, limit, id_col)
    return fuse([a, b], id_col, limit, None if dense_weight is None else [dense_weight, 1 - dense_weight])


def hashed_embedding(text: str | Column, width: int = 64) -> Column:
    """A deterministic embedding without a model: signed hashed token counts, unit length."""
    buckets = F.transform(code_tokens(text), lambda t: F.xxhash64(t))
    hot = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(F.filter(buckets, lambda h: F.pmod(h, F.lit(width)) == i), F.lit(0.0), lambda a, h: a + F.when(F.pmod(F.floor(h / width), F.lit(2)) == 0, 1.0).otherwise(-1.0)))
    length = F.sqrt(F.aggregate(hot, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(hot, lambda x: F.when(length > 0, x / F.when(length > 0, length)).otherwise(0.0).cast("float"))


def file_level(hits: DataFrame, path_col: str, id_col: str, limit: int) -> DataFrame:
    """Hits folded to files by their best hit, with the members in order of score."""
    member = F.struct((-F.col("score")).alias("order"), F.col(id_col).alias("id"))
    files = hits.groupBy(path_col).agg(F.max("score").alias("score"), F.transform(F.sort_array(F.collect_list(member)), lambda m: m["id"]).alias("members"))
    return files.orderBy(F.col("score").desc(), path_col).limit(limit)
