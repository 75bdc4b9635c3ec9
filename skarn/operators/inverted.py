"""An inverted file of vectors: lists around centroids, 8-bit codes, exact rescoring.

``build`` assigns every row to the nearest of some centroids and writes (id, codes, vector) in one
folder per list, sorted by id.  A search ranks the centroids on the driver, names the nearest lists as
literals, so that only their folders are listed, reads the codes there (one byte a component), and
then the whole vectors of its best candidates, again by literals.  ``search_all`` answers a table of
queries: lists meet the queries that probe them in blocks of bounded size.

Centroids are fitted on at most ``SAMPLE`` rows a list, those of smallest hashed id; every row is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .retrieval import coded, dense

#: Rows a list to fit on; rows of a list, and queries, that meet in one task at a time.
SAMPLE, MEMBERS, QUERIES = 64, 4096, 512
#: Cosines of rows to centroids, and rows that queries are sent as, that a worker holds at a time.
CELLS, SENT = 1 << 20, 1 << 13
DIGITS = 9


@dataclass(frozen=True)
class Inverted:
    """The rows (id, codes, vector, list), in folders by list, and the lists' centroids."""

    rows: DataFrame
    centroids: np.ndarray
    id_col: str

    def nearest(self, query: Sequence[float], probes: int) -> list[int]:
        """The numbers of the lists to read, nearest first; equally near ones by number."""
        return _near(self.centroids, np.asarray([query], float))[0, :probes].tolist()


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of all rows of x to all of y, to nine digits, so that ties are the same everywhere; 0 for zero vectors."""
    length = np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    return np.round(x @ y.T / np.where(length > 0, length, 1), DIGITS)


def _near(centroids: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.argsort(-_cosines(x, centroids), axis=1, kind="stable")


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _pieces(parts: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The same rows, at most so many at a time, one at least."""
    step = max(1, rows)
    for df in parts:
        for at in range(0, len(df), step):
            yield df.iloc[at : at + step]


def _probed(parts: Iterator[pd.DataFrame], centroids: np.ndarray, probes: int) -> Iterator[pd.DataFrame]:
    """(query_id, q, list): a query goes out once for each of its lists, so rows grow with both and are sent in pieces."""
    for df in _pieces(parts, min(CELLS // max(1, len(centroids)), SENT // max(1, probes))):
        near = _near(centroids, _stack(df["q"]))[:, :probes]
        at, lists = np.repeat(np.arange(len(df)), near.shape[1]), near.ravel().astype("int32")
        for first in range(0, len(at), SENT):
            cut = slice(first, first + SENT)
            yield pd.DataFrame({"query_id": df["query_id"].to_numpy()[at[cut]], "q": df["q"].to_numpy()[at[cut]], "list": lists[cut]})


def fit(vectors: DataFrame, lists: int, rounds: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> np.ndarray:
    """Centroids: the sample's first ``lists`` rows by hashed id, then rounds of spherical k-means on the sample."""
    order = F.sha2(F.concat(F.lit("1:"), F.col(id_col).cast("string")), 256)
    taken = vectors.where(F.col(vec_col).isNotNull()).select(order.alias("h"), F.col(vec_col).alias("v")).orderBy("h").limit(lists * (SAMPLE if rounds else 1))
    sample = np.array([r.v for r in taken.collect()], float)  # the sample's bound
    centroids = sample[:lists].copy()
    for _ in range(rounds):
        own = _near(centroids, sample)[:, 0]
        for k in range(len(centroids)):
            mine = _unit(sample[own == k])
            if len(mine):
                centroids[k] = mine.mean(0)
    return centroids


def assigned(vectors: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vector, list): every row with the number of its nearest centroid."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(parts):
        for df in _pieces(parts, CELLS // max(1, len(centroids))):
            yield df.assign(list=_near(centroids, _stack(df["vector"]))[:, 0].astype("int32"))

    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col), F.col(vec_col).cast("array<float>").alias("vector"))
    return rows.mapInPandas(run, f"{id_col} {kind}, vector array<float>, list int")


def build(vectors: DataFrame, lists: int | None = None, rounds: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> Inverted:
    """Fit, assign and write; by default as many lists as the root of the number of rows.

    Rows are dealt by ranges of (list, id), so a list of very many rows is written by several tasks.
    """
    n = lists or max(1, math.isqrt(vectors.count()))
    centroids = fit(vectors, n, rounds, id_col, vec_col)
    rows = assigned(vectors, centroids, id_col, vec_col)
    codes = coded(rows, "vector", "*")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = codes.repartitionByRange(parts, "list", id_col).sortWithinPartitions("list", id_col)
    return Inverted(written(placed, "inverted", by=["list"]), centroids, id_col)


def search(index: Inverted, query: Sequence[float], limit: int, probes: int, oversample: float = 4.0, where: Column | None = None) -> DataFrame:
    """The nearest rows of the nearest lists by cosine: codes first, then the best of them exactly."""
    i, lists = index.id_col, index.nearest(query, probes)
    near = index.rows.where(F.col("list").isin(lists))
    near = near if where is None else near.where(where)
    rough = dense(near.select(i, "list", "codes"), query, math.ceil(limit * oversample), None, "codes", i, digits=None).select(i, "list").collect()  # limit * oversample rows
    if not rough:
        return near.select(i, "vector", F.lit(0.0).alias("score"))
    best = index.rows.where(F.col("list").isin(sorted({r["list"] for r in rough})) & F.col(i).isin([r[i] for r in rough]))
    return dense(best.select(i, "vector"), query, limit, None, "vector", i)


def _meet(members: DataFrame, queries: DataFrame, id_col: str, value: str, keep: int, digits: int = DIGITS) -> DataFrame:
    """(query_id, id, score): the ``keep`` best members of each query in the lists they share.

    members: id, list, value; queries: query_id, list, q.  Both sides of a list are cut into
    blocks, so no task grows with a list, and a block sends on the best of each query only.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((members, id_col), (queries, "query_id"))}
    cut = lambda df, c, size, name: df.groupBy("list").agg(F.ceil(F.count("*") / size).alias(name))
    sizes = cut(members, id_col, MEMBERS, "parts").join(cut(queries, "query_id", QUERIES, "qparts"), "list")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    m = members.join(sizes, "list").withColumn("part", deal(id_col, "parts")).withColumn("qpart", spread("qparts")).select("list", "part", "qpart", id_col, F.col(value).alias("v"))
    q = queries.join(sizes, "list").withColumn("qpart", deal("query_id", "qparts")).withColumn("part", spread("parts")).select("list", "part", "qpart", "query_id", "q")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], id_col: [], "score": []})
        left = left.sort_values(id_col)
        scores = np.round(_cosines(_stack(right["q"]), _stack(left["v"])), digits)
        order = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
        n = order.shape[1]
        return pd.DataFrame({"query_id": np.repeat(right["query_id"].to_numpy(), n), id_col: left[id_col].to_numpy()[order.ravel()], "score": np.take_along_axis(scores, order, 1).ravel()})

    keys = ["list", "part", "qpart"]
    met = m.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(best, f"query_id {kinds['query_id']}, {id_col} {kinds[id_col]}, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_col)
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def search_all(index: Inverted, queries: DataFrame, limit: int, probes: int, oversample: float = 4.0, query_id: str = "vec_id", vec_col: str = "embedding", digits: int = 6) -> DataFrame:
    """(query_id, rank, id, score) of every query; as ``search`` for each."""
    i, centroids = index.id_col, index.centroids
    kind = queries.schema[query_id].dataType.simpleString()
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vec_col).cast("array<double>").alias("q"))
    probed = asked.mapInPandas(lambda parts: _probed(parts, centroids, probes), f"query_id {kind}, q array<double>, list int")
    rough = _meet(index.rows.select(i, "list", "codes"), probed, i, "codes", math.ceil(limit * oversample)).select("query_id", i)
    whole = rough.join(index.rows.select(i, "vector"), i).join(asked, "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    length = lambda a: F.sqrt(dot(a, F.transform(a, lambda x: x.cast("double"))))
    v, q = F.col("vector"), F.col("q")
    both = length(v) * length(q)
    scored = whole.select("query_id", i, F.round(F.when(both > 0, dot(v, q) / F.when(both > 0, both)).otherwise(0.0), digits).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), i)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "rank", i, "score")


def exact_all(vectors: DataFrame, queries: DataFrame, limit: int, id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "vec_id", digits: int = 6) -> DataFrame:
    """(query_id, rank, id, score): every query against every row, block by block."""
    members = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col), F.lit(0).alias("list"), F.col(vec_col).alias("v"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.lit(0).alias("list"), F.col(vec_col).alias("q"))
    return _meet(members, asked, id_col, "v", limit, digits).select("query_id", "rank", id_col, "score")


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(found, wanted, recall): how many of the exact neighbours of all queries were found."""
    hit = exact.select("query_id", id_col).join(found.select("query_id", id_col, F.lit(1).alias("hit")), ["query_id", id_col], "left")
    return hit.agg(F.count("hit").alias("found"), F.count("*").alias("wanted")).withColumn("recall", F.col("found") / F.col("wanted"))
