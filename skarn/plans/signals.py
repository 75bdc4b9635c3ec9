"""The derived signals as Column expressions over a payload."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import MATURE_COMMITS, alpha, blend, clip01, dampen, normalize, silo
from ..functions.text import HEADING_STOP_WORDS, heading_tokens, path_risk
from .catalog import DERIVED
from .payload import Payload

HEADING_DEPTHS = 3


@dataclass
class Context:
    """What a signal may look at: columns, bounds by source, K by scope, level, query."""

    payload: Payload
    bounds: Mapping[str, object] = field(default_factory=dict)
    damping: Mapping[str, float] = field(default_factory=dict)
    level: str | None = None
    query: str | None = None
    similarity: Column | None = None
    chunk_size_floor: float = 20.0

    def bound(self, name: str, source: str) -> object:
        b = self.bounds.get(source)
        return b if b is not None else DERIVED[name].bound or 1.0

    def alpha(self) -> Column:
        """0 at file level or without chunk commits; 1 where the file's count is missing."""
        if self.level == "file":
            return F.lit(0.0)
        c, f = self.payload["git.chunk.commitCount"], self.payload["git.file.commitCount"]
        return F.when(c.isNull() | (c <= 0), 0.0).when(f.isNull(), 1.0).otherwise(alpha(c, f, MATURE_COMMITS))


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _blended(x: Context, name: str, field_: str, damped: bool = False) -> Column:
    file, chunk = x.payload[f"git.file.{field_}"].cast("double"), x.payload[f"git.chunk.{field_}"].cast("double")
    f = normalize(_number(file), x.bound(name, f"file.{field_}"))
    c = F.when(chunk.isNotNull(), normalize(chunk, x.bound(name, f"chunk.{field_}"))).otherwise(f)
    if damped:
        k = DERIVED[name].k or 0
        f = f * dampen(x.payload["git.file.commitCount"], x.damping.get(f"file.{field_}", k))
        c = c * dampen(x.payload["git.chunk.commitCount"], x.damping.get(f"chunk.{field_}", k))
    a = x.alpha()
    return F.when(a == 0, f).otherwise(blend(c, f, a))


def _share(x: Context, pct: str, authors: str) -> Column:
    p, n = x.payload[f"git.file.{pct}"].cast("double"), F.size(x.payload[f"git.file.{authors}"].cast("array<string>"))
    share = F.when(p > 0, p / 100).when(n > 0, 1 / F.when(n > 0, n).cast("double")).otherwise(0.0)
    return share * dampen(x.payload["git.file.commitCount"], x.damping.get(f"file.{pct}", 5))


def _silo(x: Context) -> Column:
    k = DERIVED["knowledgeSilo"].k
    f = silo(x.payload["git.file.blameContributorCount"]) * dampen(x.payload["git.file.commitCount"], k)
    n = x.payload["git.chunk.blameContributorCount"]
    c = F.when(n.isNotNull(), silo(n) * dampen(x.payload["git.chunk.commitCount"], k))
    a = x.alpha()
    return F.when(a == 0, f).otherwise(blend(c, f, a))


def _heading(x: Context) -> Column:
    words = [w for w in re.split(r"[\s\-_/]+", (x.query or "").lower()) if len(w) > 1 and w not in HEADING_STOP_WORDS]
    if not words or not x.payload.has("headingPath"):
        return F.lit(0.0)
    asked = F.array(*[F.lit(w) for w in words])

    def one(h: Column) -> Column:
        tokens = heading_tokens(h["text"])
        found = F.size(F.filter(asked, lambda w: F.array_contains(tokens, w)))
        return found / F.lit(float(len(words))) * (HEADING_DEPTHS - h["depth"] + 1) / HEADING_DEPTHS

    return F.coalesce(F.greatest(F.lit(0.0), F.array_max(F.transform(x.payload["headingPath"], one))), F.lit(0.0))


def _function_like(x: Context) -> Column:
    return x.payload["chunkType"].isin("function", "test", "test_setup") & (x.payload["methodLines"] > 0)


def _graph(x: Context, name: str, scope: str, key: str) -> Column:
    if scope == "chunk" and x.level == "file":
        return F.lit(0.0)
    return normalize(_number(x.payload[f"codegraph.{scope}.{key}"]), x.bound(name, f"{scope}.{key}"))


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _per_line(x: Context) -> Column:
    lines = x.payload["endLine"].cast("double") - x.payload["startLine"] + 1
    return F.when(lines > 0, normalize(_number(x.payload["codegraph.file.fanOut"]) / F.when(lines > 0, lines), DERIVED["fanOutPerLine"].bound)).otherwise(0.0)


def _block(x: Context) -> Column:
    p = x.payload
    return F.when(F.coalesce(p["chunkType"], F.lit("")) != "block", 0.0).when(p["git.chunk.commitCount"].isNotNull(), 1 - x.alpha()).otherwise(1.0)


SIGNALS: dict[str, Callable[[Context], Column]] = {
    "similarity": lambda x: x.similarity if x.similarity is not None else F.lit(0.0),
    "documentation": lambda x: _flag(x.payload["isDocumentation"]),
    "headingRelevance": _heading,
    "imports": lambda x: normalize(F.greatest(F.size(x.payload["imports"].cast("array<string>")), F.lit(0)), DERIVED["imports"].bound),
    "pathRisk": lambda x: F.coalesce(path_risk(x.payload["relativePath"]), F.lit(0.0)),
    "symbolCount": lambda x: normalize(_number(x.payload["moduleMethodCount"]), x.bound("symbolCount", "moduleMethodCount")),
    "chunkSize": lambda x: F.when(_function_like(x), normalize(x.payload["methodLines"], x.bound("chunkSize", "methodLines"))).otherwise(0.0),
    "chunkDensity": lambda x: F.when(_function_like(x) & (x.payload["methodLines"] >= x.chunk_size_floor), normalize(_number(x.payload["methodDensity"]), x.bound("chunkDensity", "methodDensity"))).otherwise(0.0),
    "age": lambda x: _blended(x, "age", "ageDays"),
    "recency": lambda x: 1 - _blended(x, "recency", "ageDays"),
    "churn": lambda x: _blended(x, "churn", "commitCount"),
    "stability": lambda x: 1 - _blended(x, "stability", "commitCount"),
    "burstActivity": lambda x: _blended(x, "burstActivity", "recencyWeightedFreq"),
    "bugFix": lambda x: _blended(x, "bugFix", "bugFixRate", damped=True),
    "density": lambda x: _blended(x, "density", "changeDensity", damped=True),
    "relativeChurnNorm": lambda x: _blended(x, "relativeChurnNorm", "relativeChurn", damped=True),
    "volatility": lambda x: _blended(x, "volatility", "churnVolatility", damped=True),
    "blockPenalty": _block,
    "chunkChurn": lambda x: normalize(_number(x.payload["git.chunk.commitCount"]), x.bound("chunkChurn", "chunk.commitCount")) * x.alpha(),
    "chunkRelativeChurn": lambda x: normalize(_number(x.payload["git.chunk.churnRatio"]), x.bound("chunkRelativeChurn", "chunk.churnRatio")) * x.alpha(),
    "knowledgeSilo": _silo,
    "ownership": lambda x: _share(x, "blameDominantAuthorPct", "blameAuthors"),
    "recentActivityConcentration": lambda x: _share(x, "recentDominantAuthorPct", "recentAuthors"),
    "fanIn": lambda x: _graph(x, "fanIn", "file", "fanIn"),
    "fanOut": lambda x: _graph(x, "fanOut", "file", "fanOut"),
    "fanOutPerLine": _per_line,
    "instability": lambda x: clip01(_number(x.payload["codegraph.file.instability"])) * dampen(x.payload["codegraph.file.connectionCount"], x.damping.get("file.instability", DERIVED["instability"].k)),
    "isHub": lambda x: _flag(x.payload["codegraph.file.isHub"]),
    "isLeaf": lambda x: _flag(x.payload["codegraph.file.isLeaf"]),
    "transitiveImpact": lambda x: _graph(x, "transitiveImpact", "file", "transitiveImpact"),
    "chunkFanIn": lambda x: _graph(x, "chunkFanIn", "chunk", "fanIn"),
    "chunkFanOut": lambda x: _graph(x, "chunkFanOut", "chunk", "fanOut"),
    "pageRank": lambda x: _graph(x, "pageRank", "chunk", "pageRank"),
}


def payload_key(name: str, source: str) -> str:
    """The payload key of a derived signal's source (``file.x`` and ``chunk.x`` need their family)."""
    if not source.startswith(("file.", "chunk.")):
        return source
    graph = {"chunkFanIn", "chunkFanOut", "fanIn", "fanOutPerLine", "fanOut", "instability", "isHub", "isLeaf", "pageRank", "transitiveImpact"}
    return f"{'codegraph' if name in graph else 'git'}.{source}"
