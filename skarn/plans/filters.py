"""Filters: a boolean tree of conditions, typed parameters and presets, as Columns.

Everything compiles to plain comparisons, so Catalyst pushes it into the scan.  A missing
field never meets a positive condition, and a negated condition keeps rows without it.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import last_segment, matches_glob
from .catalog import FILTER_PRESETS, Condition
from .payload import Payload


class FilterError(ValueError):
    pass


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def leaf(payload: Payload, condition: Mapping) -> Column:
    """One condition: ``match`` (value, any, text), ``range`` or ``is_empty``; or a subtree."""
    if {"must", "should", "must_not"} & set(condition):
        return compile_tree(payload, condition)
    if "is_empty" in condition:
        c = payload[condition["is_empty"]["key"]]
        return c.isNull()
    c = payload[condition["key"]]
    if "range" in condition:
        ops = {"gt": lambda v: c > v, "gte": lambda v: c >= v, "lt": lambda v: c < v, "lte": lambda v: c <= v}
        return _true(_all([ops[k](v) for k, v in condition["range"].items()]))
    match = condition["match"]
    if "any" in match:
        return _true(c.isin(list(match["any"])))
    if "text" in match:
        return _true(F.contains(F.lower(c.cast("string")), F.lit(str(match["text"]).lower())))
    return _true(c == match["value"])


def compile_tree(payload: Payload, tree: Mapping) -> Column:
    """``{must, should, must_not}``; a flat mapping is a list of equalities."""
    if not {"must", "should", "must_not"} & set(tree):
        return _all([_true(payload[k] == v) for k, v in tree.items()])
    parts = [_all([leaf(payload, x) for x in tree.get("must", ())])]
    if tree.get("should"):
        parts.append(_any([leaf(payload, x) for x in tree["should"]]))
    if tree.get("must_not"):
        parts.append(~_any([leaf(payload, x) for x in tree["must_not"]]))
    return _all(parts)


def merge(typed: Mapping | None, raw: Mapping | None) -> dict:
    """Both trees: must and must_not add up, ``should`` is the raw filter's alone."""
    typed, raw = typed or {}, raw or {}
    out = {k: [*typed.get(k, ()), *raw.get(k, ())] for k in ("must", "must_not")}
    return {k: v for k, v in out.items() if v} | ({"should": list(raw["should"])} if raw.get("should") else {})


def epoch(value: str) -> int:
    """Seconds of an ISO date or time (UTC where it names no zone)."""
    t = datetime.fromisoformat(value)
    return int((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp())


def _level(payload: Payload, field: str, level: str | None, family: str = "git") -> Column:
    return payload[f"{family}.{'chunk' if level == 'chunk' else 'file'}.{field}"]


def _tri_state(payload: Payload, key: str, value: str) -> Column:
    flag = F.coalesce(payload[key], F.lit(False))
    if value not in ("only", "exclude", "include"):
        raise FilterError(f"{key}: only, exclude or include")
    return {"only": flag, "exclude": ~flag, "include": F.lit(True)}[value]


def _positive(c: Column) -> Column:
    return c.isNotNull() & (c > 0)


#: parameter -> (payload, value, level) -> Column
PARAMETERS = {
    "language": lambda p, v, _: _true(p["language"] == v),
    "fileExtension": lambda p, v, _: _true(p["fileExtension"].isin(list(v) if isinstance(v, (list, tuple)) else [v])),
    "chunkType": lambda p, v, _: _true(p["chunkType"] == v),
    "documentation": lambda p, v, _: _tri_state(p, "isDocumentation", v),
    "testFile": lambda p, v, _: _tri_state(p, "isTest", v),
    "pathPattern": lambda p, v, _: _true(matches_glob(p["relativePath"], v)),
    "symbolId": lambda p, v, _: _true((p["symbolId"] == v) | (last_segment(p["symbolId"]) == last_segment(F.lit(v)))),
    "recentAuthor": lambda p, v, _: _true(p["git.file.recentDominantAuthor"] == v) | _true(p["git.file.recentDominantAuthorEmail"] == v),
    "blameOwner": lambda p, v, _: _true(p["git.file.blameDominantAuthor"] == v),
    "minRecentContributors": lambda p, v, _: _true(p["git.file.recentContributorCount"] >= v),
    "maxRecentContributors": lambda p, v, _: _true(p["git.file.recentContributorCount"] <= v),
    "modifiedAfter": lambda p, v, level: _true(_level(p, "lastModifiedAt", level) >= epoch(v)),
    "modifiedBefore": lambda p, v, level: _true(_level(p, "lastModifiedAt", level) <= epoch(v)),
    "minAgeDays": lambda p, v, level: _true(_positive(_level(p, "ageDays", level)) & (_level(p, "ageDays", level) >= v)),
    "maxAgeDays": lambda p, v, level: _true(_positive(_level(p, "ageDays", level)) & (_level(p, "ageDays", level) <= v)),
    "minCommitCount": lambda p, v, level: _true(_level(p, "commitCount", level) >= v),
    "taskId": lambda p, v, level: _true(F.array_contains(_level(p, "taskIds", level), v)),
    "minFanIn": lambda p, v, level: _true(_level(p, "fanIn", level, "codegraph") >= v),
    "minFanOut": lambda p, v, level: _true(_level(p, "fanOut", level, "codegraph") >= v),
    "minPageRank": lambda p, v, _: _true(p["codegraph.chunk.pageRank"] >= v),
    "minInstability": lambda p, v, _: _true(p["codegraph.file.instability"] >= v),
    "minTransitiveImpact": lambda p, v, _: _true(p["codegraph.file.transitiveImpact"] >= v),
    "minConnectionCount": lambda p, v, _: _true(p["codegraph.file.connectionCount"] >= v),
    "isHub": lambda p, v, _: _true(p["codegraph.file.isHub"] == v),
    "isLeaf": lambda p, v, _: _true(p["codegraph.file.isLeaf"] == v),
}


def typed(df: DataFrame, level: str | None = None, **params) -> Column:
    """All typed parameters; a name that does not exist is an error."""
    if unknown := set(params) - set(PARAMETERS):
        raise FilterError(f"unknown filter parameters: {sorted(unknown)}")
    p = Payload(df)
    return _all([PARAMETERS[k](p, v, level) for k, v in params.items() if v is not None])


def preset(df: DataFrame, name: str, stats: Mapping[str, Mapping[int, float]] | None = None) -> Column:
    """A filter preset; adaptive thresholds are the collection's percentiles, if known."""
    if name not in FILTER_PRESETS:
        raise FilterError(f"unknown filter preset: {name}")
    p = Payload(df)

    def one(c: Condition) -> Column:
        column, value = p[c.key], c.value
        if c.percentile is not None:
            value = (stats or {}).get(c.key, {}).get(c.percentile, value)
        if c.op == "eq":
            return _true(column.isin(value) if isinstance(value, list) else column == value)
        if c.op == "contains":
            return _true(F.contains(F.lower(column), F.lit(str(value).lower())))
        return _true(column >= value if c.op == "gte" else column <= value)

    by = {k: [one(c) for c in FILTER_PRESETS[name] if c.kind == k] for k in ("must", "should", "must_not")}
    return _all([*by["must"], *([_any(by["should"])] if by["should"] else []), *([~_any(by["must_not"])] if by["must_not"] else [])])


def resolve(df: DataFrame, spec, default: str | None = None, stats=None) -> Column:
    """A given filter stands for itself, ``{}`` for none, ``{"presets": "a,b"}`` for those."""
    if spec is None:
        return preset(df, default, stats) if default else F.lit(True)
    if "presets" in spec:
        names = [x.strip() for x in str(spec["presets"]).split(",") if x.strip()]
        if not names:
            raise FilterError("no filter preset named")
        return _all([preset(df, n, stats) for n in names])
    return compile_tree(Payload(df), spec) if spec else F.lit(True)
