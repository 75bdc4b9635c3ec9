"""Reranking: adaptive bounds, weighted scores, grouping, labels, confidence.

One aggregate over the candidates gives all bounds of a batch; it is a single row, so the
cross join with it sends a bounded row to every task.  Scores are codegen expressions.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip01, min_max, round2
from ..functions.text import directory
from .catalog import DERIVED, SIGNALS, Preset, presets
from .payload import Payload
from .signals import SIGNALS as EXTRACT
from .signals import Context, payload_key

# Search limits.
MIN_FETCH, OVERFETCH, OVERFETCH_RERANKED = 20, 2, 4
# Confidence.
MAGNITUDE, LOCALITY, Z_FLOOR, Z_CEILING, MIN_PAIRS = 0.75, 0.25, 1.0, 3.0, 50
CONFIDENCE_LABELS = ((0.0, "low"), (0.35, "medium"), (0.55, "high"))
# Smallest thresholds of module labels per language.
FLOORS = {
    "typescript": {"moduleLines": {"large": 300, "god-module": 600}, "memberCount": {"large": 10, "god-module": 20}, "moduleMethodCount": {"busy": 15, "god-module": 30}},
    "javascript": {"moduleLines": {"large": 300, "god-module": 600}, "memberCount": {"large": 10, "god-module": 20}, "moduleMethodCount": {"busy": 15, "god-module": 30}},
    "python": {"moduleLines": {"large": 500, "god-module": 1000}, "memberCount": {"large": 20, "god-module": 30}, "moduleMethodCount": {"busy": 20, "god-module": 35}},
    "ruby": {"moduleLines": {"large": 100, "god-module": 250}, "memberCount": {"large": 10, "god-module": 20}, "moduleMethodCount": {"busy": 12, "god-module": 25}},
    "go": {"moduleLines": {"large": 500, "god-module": 1000}, "memberCount": {"large": 15, "god-module": 30}, "moduleMethodCount": {"busy": 15, "god-module": 30}},
    "java": {"moduleLines": {"large": 750, "god-module": 1500}, "memberCount": {"large": 20, "god-module": 35}, "moduleMethodCount": {"busy": 20, "god-module": 35}},
    "rust": {"moduleLines": {"large": 500, "god-module": 1000}, "memberCount": {"large": 15, "god-module": 30}, "moduleMethodCount": {"busy": 15, "god-module": 30}},
}

#: The nearest-rank 95th percentile: the element at floor(0.95 n).
NEAREST_P95 = "percentile_disc(0.950000000001) WITHIN GROUP (ORDER BY {x})"


def nearest_p95(column: str) -> Column:
    """Nearest-rank p95 of the values above 0; none, or 0, gives 1."""
    positive = f"CASE WHEN {column} > 0 THEN {column} END"
    return F.coalesce(F.expr(NEAREST_P95.format(x=positive)), F.lit(1.0))


def fetch_size(limit: int, offset: int = 0, reranked: bool = True) -> int:
    return max(MIN_FETCH, (limit + offset) * (OVERFETCH_RERANKED if reranked else OVERFETCH))


class UnknownSignal(ValueError):
    pass


def resolve_mode(mode: str | Mapping | None, trajectories=("static", "git", "codegraph")) -> tuple[dict[str, float], Preset | None]:
    """Weights of a preset's name, of ``{"custom": weights}``, or similarity alone."""
    known = presets(trajectories)
    if isinstance(mode, Mapping):
        if "custom" in mode:
            if unknown := set(mode["custom"]) - set(EXTRACT):
                raise UnknownSignal(f"unknown signals: {sorted(unknown)}")
            return dict(mode["custom"]), None
        mode = mode.get("preset")
    p = known.get(mode) if mode else None
    return (dict(p.weights), p) if p else ({"similarity": 1.0}, None)


def score(df: DataFrame, mode, stats: Mapping[str, Mapping[int, float]] | None = None, level: str | None = None, query: str | None = None, trajectories=("static", "git", "codegraph"), score_col: str = "score") -> DataFrame:
    """The candidates with their ``rank_score`` and the signals that made it.

    score = sum(weight * signal) / sum(abs(weight)).  A bound is the larger of the batch's
    p95 and the collection's; without collection statistics, of the batch's and the
    signal's default.
    """
    weights, chosen = resolve_mode(mode, trajectories)
    weights = {k: w for k, w in weights.items() if w}
    level = level or (chosen.level if chosen else None)
    if set(weights) <= {"similarity"}:
        return df.withColumn("rank_score", F.col(score_col).cast("double"))
    p = Payload(df)
    sources = sorted({(name, s) for name in weights for s in DERIVED[name].sources})
    keys = {payload_key(n, s): None for n, s in sources if p.has(payload_key(n, s))}
    made = df.select("*", *[p[k].cast("double").alias(f"_src{i}") for i, k in enumerate(keys)])
    one = made.agg(*[nearest_p95(f"_src{i}").alias(f"_bound{i}") for i in range(len(keys))], F.min(score_col).alias("_low"), F.max(score_col).alias("_high"))
    joined = made.crossJoin(F.broadcast(one))  # one row
    index = {k: i for i, k in enumerate(keys)}

    bounds, damping = {}, {}
    for name, s in sources:
        key = payload_key(name, s)
        if key not in index:
            continue
        batch = F.col(f"_bound{index[key]}")
        own = (stats or {}).get(key, {}).get(95)
        floor = 1.0 if stats else DERIVED[name].bound or 1.0
        bounds[(name, s)] = F.greatest(batch, F.lit(float(own if own is not None else 0)), F.lit(float(floor)))
        signal = SIGNALS.get(key)
        if signal is not None and signal.support and stats:
            support = f"{key.rpartition('.')[0]}.{signal.support}"
            if 25 in stats.get(support, {}):
                damping[s] = stats[support][25]

    similarity = min_max(F.col(score_col).cast("double"), F.col("_low").cast("double"), F.col("_high").cast("double"))
    columns = {}
    for name in weights:
        of = {s: b for (n, s), b in bounds.items() if n == name}
        columns[name] = EXTRACT[name](Context(Payload(df), of, damping, level, query, similarity))
    total = sum(abs(w) for w in weights.values())
    value = reduce(lambda a, b: a + b, [F.lit(w) * columns[n] for n, w in weights.items()]) / F.lit(total)
    extra = [c.alias(f"signal_{n}") for n, c in columns.items()]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *extra, value.alias("rank_score"))


def group_top(df: DataFrame, key: str, id_col: str, score_col: str = "rank_score", per_group: int = 1) -> DataFrame:
    """The best rows of each key; rows without a key all stay."""
    w = Window.partitionBy(key).orderBy(F.col(score_col).desc(), F.col(id_col))
    best = df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_group).drop("_n")
    return best.unionByName(df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) == ""))


def top(df: DataFrame, limit: int, id_col: str, offset: int = 0, score_col: str = "rank_score") -> DataFrame:
    """The best rows; equal scores in order of id."""
    ordered = df.orderBy(F.col(score_col).desc(), F.col(id_col))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def label(value: Column, labels: Mapping[int, str], thresholds: Mapping[int, object], support: Column | None = None, below=(), support_thresholds: Mapping[int, float] | None = None) -> Column:
    """The highest label whose threshold the value reaches, capped where support is low."""
    ladder = sorted(labels.items())
    if not ladder:
        return F.lit("")
    rank = F.lit(0)
    for i, (p, _) in enumerate(ladder):
        if thresholds.get(p) is not None:
            t = thresholds[p]
            rank = F.when(value >= (t if isinstance(t, Column) else F.lit(float(t))), F.lit(i)).otherwise(rank)
    if support is not None and below:
        names = [n for _, n in ladder]
        rules = sorted(((float((support_thresholds or {}).get(p, fallback)), names.index(c)) for p, fallback, c in below))
        cap = F.lit(None).cast("int")
        for limit, c in reversed(rules):
            cap = F.when(support < limit, F.lit(c)).otherwise(cap)
        rank = F.when(support.isNotNull() & cap.isNotNull(), F.least(rank, cap)).otherwise(rank)
    return F.element_at(F.array(*[F.lit(n) for _, n in ladder]), rank.cast("int") + 1)


def signal_label(df: DataFrame, key: str, stats: Mapping[str, Mapping[int, float]]) -> Column:
    """A declared signal's label by the collection's statistics."""
    s, p = SIGNALS[key], Payload(df)
    support = f"{key.rpartition('.')[0]}.{s.support}" if s.support else None
    return F.when(p[key].isNotNull(), label(p[key], s.labels, stats.get(key, {}), p[support] if support else None, s.below, stats.get(support, {}) if support else None))


def floored(language: str, key: str, thresholds: Mapping[int, float]) -> dict[int, float]:
    """Percentile thresholds raised to the language's floors for their labels."""
    floors = FLOORS.get(language, {}).get(key, {})
    return {p: max(t, floors.get(SIGNALS[key].labels.get(p, ""), t)) for p, t in thresholds.items()}


def confidence(results: DataFrame, mean: float, stddev: float, pairs: int, score_col: str = "score", path_col: str = "relativePath") -> DataFrame:
    """One row: value and label of how much a result set can be trusted.

    0.75 * the mean score's height over the collection's background plus 0.25 * how much
    the hits gather in few directories.  No row where the background is unknown.
    """
    dirs = results.where(F.coalesce(path_col, F.lit("")) != "").groupBy(directory(path_col).alias("d")).agg(F.count("*").alias("k"))
    local = dirs.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.ln("k")).alias("klnk"))
    entropy = F.ln("n") - F.col("klnk") / F.col("n")
    locality = F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).when(F.col("n") == 1, 1.0).otherwise(clip01(1 - entropy / F.ln("n")))
    head = results.agg(F.avg(score_col).alias("m"), F.count("*").alias("total"))
    usable = stddev > 0 and pairs >= MIN_PAIRS
    z = clip01(((F.col("m") - mean) / (stddev or 1.0) - Z_FLOOR) / (Z_CEILING - Z_FLOOR))
    out = head.crossJoin(local)  # one row each
    value = F.when(F.col("total") == 0, 0.0).otherwise(round2(clip01(MAGNITUDE * z + LOCALITY * locality)))
    out = out.where((F.col("total") == 0) | F.lit(usable)).select(value.alias("confidence"))
    name = F.lit(CONFIDENCE_LABELS[0][1])
    for cut, n in CONFIDENCE_LABELS[1:]:
        name = F.when(F.col("confidence") >= cut, n).otherwise(name)
    return out.withColumn("label", name)
