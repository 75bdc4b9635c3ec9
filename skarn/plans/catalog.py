"""The declared payload signals, derived signals, rerank presets and filter presets.

All are data.  The texts below hold fixed values: names, bounds, labels and weights that
results depend on.  They are parsed once, on import, into the dictionaries at the end.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values.  payload signal, type, labels by percentile, then options: also=pN (a
# percentile kept besides those of labels), only=TYPE (chunk type that counts),
# once_per_file, essential, and for labels clamped by support: support=FIELD k=K
# below=PERCENTILE/FALLBACK/CEILING,...
SIGNALS_TEXT = """
relativePath string -
fileExtension string -
language string -
startLine number -
endLine number -
chunkIndex number -
isDocumentation boolean -
isTest boolean -
chunkType string -
name string -
parentSymbolId string -
parentType string -
imports strings -
symbolId string -
methodLines number p50=small,p75=large,p95=decomposition_candidate only=function
methodDensity number p50=sparse,p95=dense only=function
contentSize number -
memberCount number p50=typical,p75=large,p95=god-module
moduleLines number p50=small,p75=large,p95=god-module once_per_file
moduleMethodCount number p50=typical,p75=busy,p95=god-module once_per_file
git.file.commitCount number p25=low,p50=typical,p75=high,p95=extreme essential also=p10
git.file.ageDays number p25=recent,p50=typical,p75=old,p95=legacy essential
git.file.recentDominantAuthor string -
git.file.recentAuthors strings -
git.file.recentDominantAuthorPct number p25=shared,p50=mixed,p75=concentrated,p95=silo
git.file.fileChurnCount number p25=minimal,p50=moderate,p75=significant,p95=massive
git.file.relativeChurn number p75=normal,p95=high
git.file.recencyWeightedFreq number p75=normal,p95=burst also=p50
git.file.changeDensity number p50=calm,p75=active,p95=intense
git.file.churnVolatility number p75=stable,p95=erratic
git.file.bugFixRate number p50=healthy,p75=concerning,p95=critical also=p25 support=commitCount k=10 below=p10/5/healthy,p25/10/concerning
git.file.recentContributorCount number p50=solo,p75=team,p95=crowd
git.file.taskIds strings - essential
git.file.blameDominantAuthor string - essential
git.file.blameDominantAuthorPct number p50=shared,p75=concentrated,p90=silo,p95=deep-silo essential
git.file.blameAuthors strings -
git.file.blameContributorCount number p25=solo,p50=pair,p75=team,p95=crowd essential
git.chunk.churnRatio number p75=normal,p95=concentrated
git.chunk.commitCount number p25=low,p50=typical,p75=high,p95=extreme essential also=p10
git.chunk.ageDays number p25=recent,p50=typical,p75=old,p95=legacy essential
git.chunk.recentContributorCount number p50=solo,p95=crowd
git.chunk.bugFixRate number p50=healthy,p75=concerning,p95=critical support=commitCount k=10 below=p10/5/healthy,p25/10/concerning
git.chunk.relativeChurn number p75=normal,p95=high
git.chunk.recencyWeightedFreq number p75=normal,p95=burst
git.chunk.changeDensity number p75=active,p95=intense
git.chunk.churnVolatility number p75=stable,p95=erratic
git.chunk.taskIds strings - essential
git.chunk.blameDominantAuthor string - essential
git.chunk.blameDominantAuthorPct number p50=shared,p75=concentrated,p90=silo,p95=deep-silo essential
git.chunk.blameAuthors strings -
git.chunk.blameContributorCount number p25=solo,p50=pair,p75=team,p95=crowd essential
codegraph.file.fanIn number p25=isolated,p50=typical,p75=popular,p95=hub
codegraph.file.fanOut number p25=minimal,p50=typical,p75=heavy,p95=exhaustive
codegraph.file.instability number p50=stable,p75=mixed,p95=unstable also=p90 support=connectionCount k=5 below=p10/2/stable,p25/5/mixed
codegraph.file.connectionCount number p25=sparse,p50=typical,p75=busy,p95=highly-connected also=p10
codegraph.file.isHub boolean -
codegraph.file.isLeaf boolean -
codegraph.file.transitiveImpact number p50=local,p75=regional,p95=systemic
codegraph.chunk.fanIn number p25=unused,p50=typical,p75=frequent,p95=central only=function
codegraph.chunk.fanOut number p25=leaf,p50=typical,p75=orchestrator,p95=god-method only=function
codegraph.chunk.pageRank number p50=peripheral,p75=important,p95=critical only=function
"""

# Fixed values.  derived signal, its sources, default bound, dampening K, inverted.
DERIVED_TEXT = """
chunkDensity methodDensity,methodLines 120 -
chunkSize methodLines 500 -
documentation - - -
headingRelevance - - -
imports - 20 -
pathRisk - - -
similarity - - -
symbolCount moduleMethodCount 40 -
age file.ageDays,chunk.ageDays 365 -
blockPenalty chunk.commitCount,file.commitCount - - inverted
bugFix file.bugFixRate,chunk.bugFixRate 100 10
burstActivity file.recencyWeightedFreq,chunk.recencyWeightedFreq 10.0 -
chunkChurn chunk.commitCount,file.commitCount 30 -
chunkRelativeChurn chunk.churnRatio,file.commitCount 1.0 -
churn file.commitCount,chunk.commitCount 50 -
density file.changeDensity,chunk.changeDensity 20 5
knowledgeSilo file.blameContributorCount,chunk.blameContributorCount - 5
ownership file.blameDominantAuthorPct,file.blameAuthors - 5
recency file.ageDays,chunk.ageDays 365 - inverted
recentActivityConcentration file.recentDominantAuthorPct,file.recentAuthors - 5
relativeChurnNorm file.relativeChurn,chunk.relativeChurn 5.0 5
stability file.commitCount,chunk.commitCount 50 - inverted
volatility file.churnVolatility,chunk.churnVolatility 100 8
chunkFanIn chunk.fanIn 40 -
chunkFanOut chunk.fanOut 30 -
fanIn file.fanIn 20 -
fanOutPerLine file.fanOut 0.1 -
fanOut file.fanOut 20 -
instability file.instability 1 5
isHub file.isHub 1 -
isLeaf file.isLeaf 1 -
pageRank chunk.pageRank 0.01 -
transitiveImpact file.transitiveImpact 50 -
"""

# Fixed values.  filter preset: conditions (N/M: percentile N of the collection, or else M).
FILTER_PRESETS_TEXT = """
deadCandidates: must codegraph.chunk.fanIn eq 0; must chunkType eq function
hubs: must codegraph.file.isHub eq true
unstableCore: must codegraph.file.instability gte p90/0.9; must codegraph.file.connectionCount gte p50/5
abandonedHotspots: must git.file.commitCount gte p75/9; must git.file.ageDays gte p75/42
battleTested: must git.file.ageDays gte p50/30; must git.file.bugFixRate lte p25/10; must git.file.blameContributorCount gte 2
fragileSilo: must git.file.blameContributorCount lte 1; must git.chunk.commitCount gte p75/5
freshLegacyEdits: must git.file.ageDays gte p75/60; must git.chunk.ageDays lte 7
godMethods: must git.chunk.churnRatio gte 0.8; must git.file.commitCount gte p50/5
panicZone: must git.file.recencyWeightedFreq gte p50/1; should git.file.bugFixRate gte p75/30; should git.file.churnVolatility gte p75/25
coreLogic: must chunkType eq function,class; must_not isTest eq true
production: must_not isTest eq true; must_not isDocumentation eq true; must_not chunkType eq block
securityPaths: should relativePath contains auth; should relativePath contains crypto; should relativePath contains secret; should relativePath contains token; should relativePath contains password; should relativePath contains credential; should relativePath contains permission; should relativePath contains acl; should relativePath contains oauth; should relativePath contains jwt
"""


@dataclass(frozen=True)
class Signal:
    key: str
    type: str
    labels: dict[int, str]
    percentiles: tuple[int, ...]
    only: str | None = None
    once_per_file: bool = False
    essential: bool = False
    support: str | None = None
    k: float | None = None
    #: (percentile, fallback, ceiling) of support below which a label is capped.
    below: tuple[tuple[int, float, str], ...] = ()


@dataclass(frozen=True)
class Derived:
    name: str
    sources: tuple[str, ...]
    bound: float | None
    k: float | None
    inverted: bool


@dataclass(frozen=True)
class Preset:
    owner: str
    name: str
    tools: tuple[str, ...]
    level: str | None
    group_by: str | None
    filter: str | None
    weights: dict[str, float] = field(default_factory=dict)


# Owner, name, tools that offer it, level, group, filter preset, weights.
ALL_PRESETS = [
    Preset("static", "decomposition", ("semantic_search", "hybrid_search", "rank_chunks", "find_similar"), None, "parentSymbolId", "coreLogic", {"similarity": 0.4, "chunkSize": 0.4, "chunkDensity": 0.2}),
    Preset("static", "documentationRelevance", ("semantic_search", "hybrid_search"), None, None, None, {"similarity": 0.5, "headingRelevance": 0.3, "documentation": 0.2}),
    Preset("static", "godModule", ("semantic_search", "hybrid_search", "rank_chunks", "find_similar"), "file", None, None, {"similarity": 0.2, "symbolCount": 0.8}),
    Preset("static", "relevance", ("semantic_search", "hybrid_search", "search_code", "find_similar"), None, None, None, {"similarity": 1}),
    Preset("git", "bugHunt", ("semantic_search", "hybrid_search", "search_code", "find_similar", "rank_chunks", "trace_path"), None, None, "production", {"similarity": 0.25, "burstActivity": 0.2, "volatility": 0.2, "relativeChurnNorm": 0.15, "bugFix": 0.15, "recency": 0.05, "blockPenalty": -0.05}),
    Preset("git", "codeReview", ("semantic_search", "hybrid_search", "find_similar", "rank_chunks"), None, None, None, {"similarity": 0.3, "recency": 0.15, "burstActivity": 0.1, "density": 0.1, "chunkChurn": 0.15, "chunkRelativeChurn": 0.1, "recentActivityConcentration": 0.15, "blockPenalty": -0.1}),
    Preset("git", "dangerous", ("semantic_search", "hybrid_search", "find_similar", "rank_chunks"), None, None, "production", {"bugFix": 0.35, "volatility": 0.25, "knowledgeSilo": 0.2, "burstActivity": 0.1, "similarity": 0.1, "blockPenalty": -0.05}),
    Preset("git", "hotspots", ("semantic_search", "hybrid_search", "rank_chunks", "find_similar"), None, None, "production", {"similarity": 0.2, "chunkSize": 0.1, "chunkChurn": 0.15, "chunkRelativeChurn": 0.15, "burstActivity": 0.15, "bugFix": 0.1, "volatility": 0.15, "blockPenalty": -0.15}),
    Preset("git", "onboarding", ("semantic_search", "hybrid_search", "find_similar"), "file", None, None, {"similarity": 0.3, "documentation": 0.2, "stability": 0.2, "age": 0.1, "ownership": -0.1, "recentActivityConcentration": 0.1, "volatility": -0.1}),
    Preset("git", "ownership", ("semantic_search", "hybrid_search", "rank_chunks", "find_similar"), "file", None, "production", {"similarity": 0.35, "ownership": 0.35, "knowledgeSilo": 0.3}),
    Preset("git", "proven", ("semantic_search", "hybrid_search", "search_code", "find_similar", "trace_path"), "file", None, "production", {"similarity": 0.2, "stability": 0.3, "age": 0.3, "bugFix": -0.15, "knowledgeSilo": -0.1, "volatility": -0.05}),
    Preset("git", "recent", ("search_code", "semantic_search", "hybrid_search", "find_similar", "trace_path"), None, None, None, {"similarity": 0.5, "recency": 0.2, "burstActivity": 0.15, "density": 0.1, "churn": 0.05}),
    Preset("git", "refactoring", ("semantic_search", "hybrid_search", "rank_chunks", "find_similar"), None, "parentSymbolId", "coreLogic", {"similarity": 0.15, "chunkSize": 0.3, "chunkDensity": 0.1, "chunkChurn": 0.15, "chunkRelativeChurn": 0.1, "volatility": 0.1, "bugFix": 0.05, "age": 0.05, "blockPenalty": -0.1}),
    Preset("git", "securityAudit", ("semantic_search", "hybrid_search", "find_similar"), "file", None, "production", {"similarity": 0.25, "age": 0.15, "ownership": 0.1, "bugFix": 0.15, "pathRisk": 0.15, "volatility": 0.2}),
    Preset("git", "stable", ("search_code", "semantic_search", "hybrid_search", "find_similar", "trace_path"), None, None, None, {"similarity": 0.45, "stability": 0.2, "age": 0.15, "bugFix": -0.15, "volatility": -0.1}),
    Preset("git", "techDebt", ("semantic_search", "hybrid_search", "rank_chunks", "find_similar"), None, None, "production", {"similarity": 0.15, "age": 0.15, "churn": 0.1, "chunkChurn": 0.1, "bugFix": 0.15, "volatility": 0.1, "knowledgeSilo": 0.1, "density": 0.1, "blockPenalty": -0.05}),
    Preset("codegraph", "criticalMethod", ("semantic_search", "hybrid_search", "rank_chunks", "find_similar"), "chunk", None, None, {"similarity": 0.3, "pageRank": 0.7}),
    Preset("codegraph", "godMethod", ("semantic_search", "hybrid_search", "rank_chunks", "find_similar"), "chunk", None, None, {"similarity": 0.3, "chunkFanOut": 0.7}),
    Preset("codegraph", "hotMethod", ("semantic_search", "hybrid_search", "rank_chunks", "find_similar"), "chunk", None, None, {"similarity": 0.3, "chunkFanIn": 0.7}),
    Preset("composite", "architecturalHub", ("semantic_search", "hybrid_search", "rank_chunks", "find_similar", "trace_path"), "file", None, "production", {"similarity": 0.2, "isHub": 0.35, "fanIn": 0.2, "fanOut": 0.1, "churn": 0.1, "bugFix": 0.05}),
    Preset("composite", "blastRadius", ("semantic_search", "hybrid_search", "rank_chunks", "trace_path"), None, None, "production", {"similarity": 0.2, "transitiveImpact": 0.2, "fanIn": 0.15, "churn": 0.2, "bugFix": 0.15, "isHub": 0.05, "chunkFanIn": 0.05}),
    Preset("composite", "bugHunt", ("semantic_search", "hybrid_search", "search_code", "find_similar", "rank_chunks", "trace_path"), None, None, "production", {"similarity": 0.2, "burstActivity": 0.18, "volatility": 0.18, "bugFix": 0.15, "pageRank": 0.14, "relativeChurnNorm": 0.1, "recency": 0.05, "blockPenalty": -0.05}),
    Preset("composite", "codeReview", ("semantic_search", "hybrid_search", "find_similar", "rank_chunks", "trace_path"), None, None, None, {"similarity": 0.27, "recency": 0.13, "burstActivity": 0.1, "density": 0.08, "chunkChurn": 0.13, "chunkRelativeChurn": 0.09, "recentActivityConcentration": 0.13, "fanIn": 0.07, "blockPenalty": -0.1}),
    Preset("composite", "criticalPath", ("semantic_search", "hybrid_search", "rank_chunks", "find_similar"), "chunk", None, "production", {"similarity": 0.2, "pageRank": 0.3, "bugFix": 0.3, "churn": 0.2}),
    Preset("composite", "dangerous", ("semantic_search", "hybrid_search", "find_similar", "rank_chunks", "trace_path"), None, None, "production", {"bugFix": 0.3, "volatility": 0.2, "knowledgeSilo": 0.15, "fanIn": 0.15, "burstActivity": 0.1, "similarity": 0.1, "blockPenalty": -0.05}),
    Preset("composite", "decomposition", ("semantic_search", "hybrid_search", "rank_chunks", "find_similar"), "chunk", "parentSymbolId", None, {"similarity": 0.2, "chunkSize": 0.35, "chunkFanOut": 0.3, "chunkDensity": 0.15}),
    Preset("composite", "entryPoint", ("semantic_search", "hybrid_search", "rank_chunks", "find_similar", "trace_path"), None, None, "production", {"similarity": 0.3, "fanOutPerLine": 0.3, "fanIn": -0.2, "chunkSize": 0.1}),
    Preset("composite", "godModule", ("semantic_search", "hybrid_search", "rank_chunks", "find_similar"), "file", None, None, {"similarity": 0.15, "symbolCount": 0.5, "fanIn": 0.15, "transitiveImpact": 0.1, "isHub": 0.1}),
    Preset("composite", "hotspots", ("semantic_search", "hybrid_search", "rank_chunks", "find_similar", "trace_path"), None, None, "production", {"similarity": 0.18, "chunkSize": 0.1, "chunkChurn": 0.15, "chunkRelativeChurn": 0.15, "burstActivity": 0.12, "bugFix": 0.1, "volatility": 0.12, "fanIn": 0.08, "blockPenalty": -0.15}),
    Preset("composite", "ownership", ("semantic_search", "hybrid_search", "rank_chunks", "find_similar", "trace_path"), "file", None, "production", {"similarity": 0.3, "ownership": 0.35, "knowledgeSilo": 0.25, "fanIn": 0.1}),
    Preset("composite", "securityAudit", ("semantic_search", "hybrid_search", "find_similar", "trace_path"), "file", None, "production", {"similarity": 0.2, "age": 0.15, "ownership": 0.1, "bugFix": 0.15, "pathRisk": 0.15, "volatility": 0.15, "fanIn": 0.1}),
    Preset("composite", "techDebt", ("semantic_search", "hybrid_search", "rank_chunks", "find_similar", "trace_path"), None, None, "production", {"similarity": 0.13, "age": 0.15, "churn": 0.1, "chunkChurn": 0.1, "bugFix": 0.15, "volatility": 0.1, "knowledgeSilo": 0.07, "density": 0.05, "fanIn": 0.1, "blockPenalty": -0.05}),
]


@dataclass(frozen=True)
class Condition:
    kind: str  # must, should, must_not
    key: str
    op: str  # eq, contains, gte, lte
    value: object
    percentile: int | None = None


def _signal(line: str) -> Signal:
    key, kind, labels, *options = line.split()
    by = {} if labels == "-" else {int(p[1:]): name for p, name in (x.split("=") for x in labels.split(","))}
    o = dict(x.split("=", 1) if "=" in x else (x, "1") for x in options if not x.startswith("also="))
    also = [int(x.removeprefix("also=p")) for x in options if x.startswith("also=")]
    below = tuple((int(p[1:]), float(f), c) for p, f, c in (x.split("/") for x in o.get("below", "").split(",") if x))
    return Signal(key, kind, by, tuple(sorted({*by, *also})), o.get("only"), "once_per_file" in o, "essential" in o, o.get("support"), float(o["k"]) if "k" in o else None, below)


def _derived(line: str) -> Derived:
    name, sources, bound, k, *inverted = line.split()
    number = lambda x: None if x == "-" else float(x)
    return Derived(name, () if sources == "-" else tuple(sources.split(",")), number(bound), number(k), bool(inverted))


def _value(text: str) -> object:
    if "," in text:
        return text.split(",")
    return {"true": True, "false": False}.get(text, float(text) if text.replace(".", "", 1).isdigit() else text)


def _condition(text: str) -> Condition:
    kind, key, op, value = text.split()
    if value[0] == "p" and "/" in value:
        p, fallback = value[1:].split("/")
        return Condition(kind, key, op, float(fallback), int(p))
    return Condition(kind, key, op, _value(value))


_lines = lambda text: text.strip().splitlines()
SIGNALS = {s.key: s for s in map(_signal, _lines(SIGNALS_TEXT))}
DERIVED = {d.name: d for d in map(_derived, _lines(DERIVED_TEXT))}
FILTER_PRESETS = {name: [_condition(c) for c in rest.split("; ")] for name, rest in (x.split(": ", 1) for x in _lines(FILTER_PRESETS_TEXT))}


def presets(trajectories: tuple[str, ...] = ("static", "git", "codegraph")) -> dict[str, Preset]:
    """Presets by name; composite ones stand in for others if all trajectories are there."""
    out = {p.name: p for p in ALL_PRESETS if p.owner in trajectories}
    if {"git", "codegraph"} <= set(trajectories):
        out |= {p.name: p for p in ALL_PRESETS if p.owner == "composite"}
    return out
