"""Centroid clustering by Lloyd's rounds that follow changes (delta Lloyd).

Vectors are whole numbers, so every sum is exact and the result does not depend on how Spark deals
the rows.  What is kept between rounds is a table of vectors with their owner and distance, and one
row of sums and a count per cluster.

A round compares a vector only with what may have changed for it:

* its owner's centroid stayed: its distance is the one that is stored, and only centroids that moved
  can be nearer;
* its owner's centroid moved: it is compared with all.

Only vectors that change their owner send anything on: minus itself from the old cluster, plus itself
to the new one, added up within each task before it moves.  The signed sums of all tasks are added to
those of the last round.  A round writes the table anew and lets the last one go, so a lost executor
costs tasks of one round, and the driver holds k centroids only.

Defined results: rows without a vector, of another number of components, or with a null or non-finite
component are left out; scaled components beyond 2**27 count as that, so squared distances fit a long; a null
id is hashed as an empty string; where ids repeat, each row is a vector, and the smaller vector comes
first among equal hashes; fewer vectors than clusters make one cluster each; an empty table gives an
empty one; sums of distances that no long holds are null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._jobs import arrow_stage, text_of, written

BOUND = 1 << 27


def kept_vectors(vectors: DataFrame, dimensions: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors of the right form as whole numbers ``floor(scale * component)``."""
    rows = text_of(vectors, {"vec_id": id_col, "v": vector_col}).withColumn("v", F.col("v").cast("array<double>"))
    fine = (F.size("v") == dimensions) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = lambda c: F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), F.floor(c * scale).cast("double"))).cast("int")
    return rows.where(F.col("v").isNotNull() & fine).select("vec_id", F.transform("v", whole).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances; sums may wrap on the way, the results fit."""
    return (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)[None, :]


def _assign(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The table with owners and distances under these centroids, and the owner before."""
    kind = state.schema["vec_id"].dataType.simpleString()
    far = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, owner, near = _matrix(b.column(1)), b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy().astype(np.int64)
            if not len(x):
                continue
            to, best = owner.copy(), near.copy()
            settled = (owner >= 0) & ~moved[np.maximum(owner, 0)]
            some = np.flatnonzero(moved)
            at = np.flatnonzero(settled)
            if len(some) and len(at):
                d = _distances(x[at], centroids[some])
                pick = d.argmin(1)  # the first of equal ones has the smallest number
                dist, number = d[np.arange(len(at)), pick], some[pick]
                better = (dist < best[at]) | ((dist == best[at]) & (number < to[at]))
                to[at[better]], best[at[better]] = number[better], dist[better]
            at = np.flatnonzero(~settled)
            if len(at):
                d = _distances(x[at], centroids)
                to[at] = d.argmin(1)
                best[at] = d[np.arange(len(at)), to[at]]
            assert best.max() < far
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to.astype(np.int32)), pa.array(best), pa.array(owner.astype(np.int32))], ["vec_id", "x", "cluster", "distance", "before"])

    return arrow_stage(state.select("vec_id", "x", "cluster", "distance"), run, f"vec_id {kind}, x array<int>, cluster int, distance bigint, before int")


def _transfers(state: DataFrame, k: int, dimensions: int) -> list:
    """Signed sums per cluster and component (component -1 is the count): k * (dimensions + 1) rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros((k, dimensions + 1), np.int64), 0

        def rows() -> pa.RecordBatch:
            c, i = np.nonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array((i - 1).astype(np.int32)), pa.array(total[c, i])], ["cluster", "i", "delta"])

        for b in batches:
            x = _matrix(b.column(0))
            if not len(x):
                continue
            one = np.concatenate((np.ones((len(x), 1), np.int64), x), axis=1)
            for column, sign in ((1, 1), (2, -1)):
                owner = b.column(column).to_numpy()
                mine = owner >= 0
                np.add.at(total, owner[mine], sign * one[mine])
            held += len(x)
            if held >= 1 << 34:  # before a sum could overflow
                yield rows()
                total[:], held = 0, 0
        yield rows()

    moved = state.where("cluster != before").select("x", "cluster", "before")
    parts = arrow_stage(moved, run, "cluster int, i int, delta bigint")
    return parts.groupBy("cluster", "i").agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("delta")).collect()


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per kept vector."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dimensions, scale, id_col, vector_col)
    state = written(kept.select("vec_id", "x", F.lit(-1).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = state.select(digest.alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k rows
    n = len(first)
    centroids = np.array([r.x for r in first], np.int64).reshape(n, dimensions)
    sums = [[0] * (dimensions + 1) for _ in range(n)]
    moved = np.ones(n, bool)
    for step in range(rounds + 1):
        if not moved.any():
            break
        state = written(_assign(state, centroids, moved), "vectors", instead_of=state)
        if step == rounds:
            break
        for r in _transfers(state, n, dimensions):
            sums[r["cluster"]][r["i"] + 1] += int(r["delta"])
        after = np.array([[s // c[0] for s in c[1:]] if c[0] else old for c, old in zip(sums, centroids.tolist(), strict=True)], np.int64).reshape(n, dimensions)
        moved = (after != centroids).any(axis=1)
        centroids = after
    named = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = written(state.groupBy("cluster").agg(exact.alias("s")), "inertia")  # k rows
    fits = lambda c: F.expr(f"try_cast({c} AS bigint)")
    total = per.agg(F.sum("s").alias("t")).select(fits("t").alias("inertia"))
    totals = F.broadcast(per.select("cluster", fits("s").alias("cluster_inertia")).join(named, "cluster").crossJoin(total))  # k rows by one
    return state.select("vec_id", "cluster", "distance").join(totals, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
