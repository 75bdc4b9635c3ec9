"""Numeric building blocks of the signals.  All stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Commits a chunk needs before its own signals count fully.
MATURE_COMMITS = 3
DAMPING_POWER = 2


def col(x: Column | str | float | int | None) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def round2(x: Column) -> Column:
    """Two decimals, half up on the binary product (``floor(x * 100 + 0.5) / 100``)."""
    return F.floor(x * 100 + 0.5) / 100


def round0(x: Column) -> Column:
    return F.floor(x + 0.5)


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def normalize(value, bound) -> Column:
    """value / bound cut to 0..1; null counts as 0, a bound of 0 or less gives 0."""
    v, b = col(value).cast("double"), col(bound).cast("double")
    return F.when(b > 0, clip01(F.coalesce(v, F.lit(0.0)) / b)).otherwise(F.lit(0.0))


def alpha(chunk, file, mature: int = MATURE_COMMITS) -> Column:
    """How far a chunk's own history is trusted: share of its file's commits, by maturity."""
    c, f = col(chunk).cast("double"), col(file).cast("double")
    return F.when((c > 0) & (f > 0), F.least(F.lit(1.0), c / f * F.least(F.lit(1.0), c / mature))).otherwise(F.lit(0.0))


def blend(chunk: Column, file: Column, a: Column) -> Column:
    """a * chunk + (1 - a) * file; the file alone where there is no chunk value."""
    return F.when(chunk.isNull(), file).otherwise(a * chunk + (1 - a) * file)


def dampen(n, k, power: int = DAMPING_POWER) -> Column:
    """Confidence by support: 1 from k on, (n / k)**power below; k of 0 or less gives 1."""
    n, k = F.coalesce(col(n).cast("double"), F.lit(0.0)), col(k).cast("double")
    return F.when((k <= 0) | (n >= k), F.lit(1.0)).otherwise(F.pow(F.greatest(n, F.lit(0.0)) / F.when(k > 0, k), F.lit(float(power))))


def silo(contributors) -> Column:
    """1 contributor 1, 2 one half, 3 or more 0, linear between; none 0."""
    n = col(contributors).cast("double")
    return F.when(n.isNull() | (n <= 0), 0.0).when(n <= 1, 1.0).when(n <= 2, 1 - (n - 1) * 0.5).when(n < 3, 0.5 - (n - 2) * 0.5).otherwise(0.0)


def dot(a, b) -> Column:
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine of two vectors in double; 0 where one has no length."""
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d).otherwise(F.lit(0.0))


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Batch scaling; a flat batch gives 1."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(1.0))


def age_days(as_of, last) -> Column:
    """Whole days between two epochs in seconds, never negative."""
    return F.greatest(F.lit(0).cast("bigint"), F.floor((col(as_of) - col(last)) / 86400))
