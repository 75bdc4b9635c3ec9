"""Whitening by a randomised range finder and Rayleigh-Ritz.

The covariance is never needed as a whole unless the range finder fails.  A pass multiplies it with a
narrow block Q: each task centres its rows, adds up ``row * (row . Q)`` and sends one block on; Spark
adds the blocks and the driver holds ``dimensions x block`` numbers.

1. Pass over all rows: their number and the exact sums per dimension (whole numbers).
2. Q starts as random directions, ``components + OVERSAMPLE`` of them, orthonormal.  Up to ``PASSES``
   passes give ``Y = V Q``; the small problem ``Q' Y`` gives Ritz values and vectors, and
   ``Y - Q theta`` what is missing to eigenvectors.  The next Q is the orthonormal basis of Y.
3. If after these passes a wanted vector may still be off by more than ``TOLERANCE`` (its residual over
   its distance to the other values), Q becomes the whole space, where Rayleigh-Ritz is exact.
   Spectra without a gap after the wanted components end there.
4. A last pass measures the covariance of the whitened rows before they are returned.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry are left out; of
different lengths the most frequent one counts (of equally frequent ones the longest) and other rows
are left out; scaled entries beyond 2**52 count as that; components without variance are not returned,
so fewer rows may come back, and none for a single vector or an empty table; repeated rows and null
ids get rows of their own; a deviation that no long holds is null and stands in ``deviation_exact``;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._jobs import arrow_stage, text_of, written

OVERSAMPLE, PASSES, TOLERANCE, SEED = 8, 4, 1e-12, 20
#: Values below this share of the trace are no variance but rounding.
NOTHING = 1e-13
BOUND = float(1 << 52)
_LOW = 26


def kept_vectors(vectors: DataFrame, scale: int, shift: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors of the most frequent length as whole numbers ``floor(scale * c) + shift``."""
    rows = text_of(vectors, {"vec_id": id_col, "v": vector_col}).withColumn("v", F.col("v").cast("array<double>"))
    fine = (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = lambda c: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(c * scale).cast("double"))).cast("bigint") + shift
    good = rows.where(F.col("v").isNotNull() & fine).select("vec_id", F.transform("v", whole).alias("x"))
    made = written(good, "whole")
    lengths = made.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return made.where(F.size("x") == (lengths[0]["d"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def _blocks(rows: DataFrame, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``part(x)``, a block of this shape: added up per task, then in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += part(_matrix(b.column(0)))
        for i in range(shape[0]):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(shape[1], i, np.int32)), pa.array(np.arange(shape[1], dtype=np.int32)), pa.array(total[i])], ["i", "j", "v"])

    summed = arrow_stage(rows.select("x"), run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros(shape)
    for r in summed.collect():  # one value a cell of the block
        out[r["i"], r["j"]] = r["v"]
    return out


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(number of rows, exact sum of each dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            x = _matrix(b.column(0)) if b.num_rows else None
            if x is None:
                continue
            n += len(x)
            high, low = (x >> _LOW).sum(0).tolist(), (x & ((1 << _LOW) - 1)).sum(0).tolist()  # no sum of a batch overflows
            both = [(h << _LOW) + m for h, m in zip(high, low, strict=True)]
            total = both if total is None else [a + c for a, c in zip(total, both, strict=True)]
        if n:
            values = [n, *total]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total), dtype=np.int32)), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))], ["i", "v"])

    found = dict(arrow_stage(rows.select("x"), run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect())
    return int(found.get(-1, 0)), [int(found[i]) for i in range(len(found) - 1)]


def _centre(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """Rows minus their mean: the mean's whole part goes while numbers are exact, then the rest."""
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])
    at = np.array(whole, np.int64)
    return lambda x: (x - at) - rest


def _ritz(q: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in falling order, vectors, and the norms of their residuals."""
    h = q.T @ y
    values, u = np.linalg.eigh((h + h.T) / 2)
    values, u = values[::-1], u[:, ::-1]
    return values, q @ u, np.linalg.norm(y @ u - (q @ u) * values, axis=0)


def _sure(values: np.ndarray, residuals: np.ndarray, wanted: int) -> bool:
    """Whether each wanted vector is right to double precision: its residual over its gap."""
    for i in range(wanted):
        gap = min(abs(values[i] - values[j]) for j in range(len(values)) if j != i) if len(values) > 1 else values[i]
        if residuals[i] > TOLERANCE * gap:
            return False
    return True


def fit(rows: DataFrame, components: int = 8, oversample: int = OVERSAMPLE, passes: int = PASSES) -> dict | None:
    """{n, sums, values, vectors, trace, width}: the leading eigenvectors of the rows' covariance.

    ``width`` is the size of the space they were found in.
    """
    n, sums = _sums(rows)
    if not n:
        return None
    d = len(sums)
    centre = _centre(n, sums)

    def times(q: np.ndarray) -> np.ndarray:
        """V times Q, and the variances in a column more."""

        def part(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return np.concatenate((c.T @ (c @ q), (c * c).sum(0)[:, None]), axis=1)

        return _blocks(rows, (d, q.shape[1] + 1), part) / n

    wanted, width = min(components, d), min(components + oversample, d)
    q = np.eye(d) if width == d else np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, width)))[0]
    for k in range(passes + 2):
        made = times(q)
        y, trace = made[:, :-1], made[:, -1].sum()
        values, vectors, residuals = _ritz(q, y)
        if q.shape[1] == d or _sure(values, residuals, wanted):
            break
        q = np.linalg.qr(y)[0] if k < passes - 1 else np.eye(d)
    keep = [i for i in range(wanted) if values[i] > NOTHING * trace]
    return {"n": n, "sums": sums, "values": values[keep], "vectors": vectors[:, keep], "trace": float(trace), "width": q.shape[1]}


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S)**2, exact."""
    reach = n * int(np.abs(x).max()) + max(abs(s) for s in sums)
    if reach < 1 << 62:
        far = n * x - np.array(sums, np.int64)
        if int(np.abs(far).max()) ** 2 * x.shape[1] < 1 << 63:
            return (far * far).sum(1).tolist()
    far = n * x.astype(object) - np.array(sums, object)
    return (far * far).sum(1).tolist()


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) per row and component."""
    spark = vectors.sparkSession
    rows = kept_vectors(vectors, scale, shift, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    model = fit(rows, components)
    if model is None or not len(model["values"]):
        return spark.createDataFrame([], schema)
    n, sums, c = model["n"], model["sums"], len(model["values"])
    project, centre = model["vectors"] / np.sqrt(model["values"]), _centre(n, sums)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centre(x) @ project
        return np.concatenate((w.T @ w, w.sum(0)[:, None]), axis=1)

    made = _blocks(rows, (c, c + 1), moments) / n
    error = float(np.abs(made[:, :-1] - np.outer(made[:, -1], made[:, -1]) - np.eye(c)).max())
    explained = model["values"] / model["trace"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            w, exact = centre(x) @ project, _deviation(x, n, sums)
            each = pa.array(np.repeat(np.arange(len(x)), c))
            total = len(x) * c
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(each), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))), pa.array(np.full(total, n)), pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()).take(each),
                    pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(total, error)), pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0)).take(each),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
            )

    return arrow_stage(rows.select("vec_id", "x"), run, schema)
