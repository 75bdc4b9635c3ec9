"""DuckDB SQL of derived signals and scores, written apart from the Column expressions."""

from __future__ import annotations

from .functions.text import SECURITY_TOKENS
from .plans.catalog import DERIVED

# What each preset weighs, and whether it scores files; kept apart from the engine's catalog.
WEIGHTS = {
    ("static", "decomposition", ""): {"similarity": 0.4, "chunkSize": 0.4, "chunkDensity": 0.2},
    ("static", "documentationRelevance", ""): {"similarity": 0.5, "headingRelevance": 0.3, "documentation": 0.2},
    ("static", "godModule", "file"): {"similarity": 0.2, "symbolCount": 0.8},
    ("static", "relevance", ""): {"similarity": 1},
    ("git", "bugHunt", ""): {"similarity": 0.25, "burstActivity": 0.2, "volatility": 0.2, "relativeChurnNorm": 0.15, "bugFix": 0.15, "recency": 0.05, "blockPenalty": -0.05},
    ("git", "codeReview", ""): {"similarity": 0.3, "recency": 0.15, "burstActivity": 0.1, "density": 0.1, "chunkChurn": 0.15, "chunkRelativeChurn": 0.1, "recentActivityConcentration": 0.15, "blockPenalty": -0.1},
    ("git", "dangerous", ""): {"bugFix": 0.35, "volatility": 0.25, "knowledgeSilo": 0.2, "burstActivity": 0.1, "similarity": 0.1, "blockPenalty": -0.05},
    ("git", "hotspots", ""): {"similarity": 0.2, "chunkSize": 0.1, "chunkChurn": 0.15, "chunkRelativeChurn": 0.15, "burstActivity": 0.15, "bugFix": 0.1, "volatility": 0.15, "blockPenalty": -0.15},
    ("git", "onboarding", "file"): {"similarity": 0.3, "documentation": 0.2, "stability": 0.2, "age": 0.1, "ownership": -0.1, "recentActivityConcentration": 0.1, "volatility": -0.1},
    ("git", "ownership", "file"): {"similarity": 0.35, "ownership": 0.35, "knowledgeSilo": 0.3},
    ("git", "proven", "file"): {"similarity": 0.2, "stability": 0.3, "age": 0.3, "bugFix": -0.15, "knowledgeSilo": -0.1, "volatility": -0.05},
    ("git", "recent", ""): {"similarity": 0.5, "recency": 0.2, "burstActivity": 0.15, "density": 0.1, "churn": 0.05},
    ("git", "refactoring", ""): {"similarity": 0.15, "chunkSize": 0.3, "chunkDensity": 0.1, "chunkChurn": 0.15, "chunkRelativeChurn": 0.1, "volatility": 0.1, "bugFix": 0.05, "age": 0.05, "blockPenalty": -0.1},
    ("git", "securityAudit", "file"): {"similarity": 0.25, "age": 0.15, "ownership": 0.1, "bugFix": 0.15, "pathRisk": 0.15, "volatility": 0.2},
    ("git", "stable", ""): {"similarity": 0.45, "stability": 0.2, "age": 0.15, "bugFix": -0.15, "volatility": -0.1},
    ("git", "techDebt", ""): {"similarity": 0.15, "age": 0.15, "churn": 0.1, "chunkChurn": 0.1, "bugFix": 0.15, "volatility": 0.1, "knowledgeSilo": 0.1, "density": 0.1, "blockPenalty": -0.05},
    ("codegraph", "criticalMethod", ""): {"similarity": 0.3, "pageRank": 0.7},
    ("codegraph", "godMethod", ""): {"similarity": 0.3, "chunkFanOut": 0.7},
    ("codegraph", "hotMethod", ""): {"similarity": 0.3, "chunkFanIn": 0.7},
    ("composite", "architecturalHub", "file"): {"similarity": 0.2, "isHub": 0.35, "fanIn": 0.2, "fanOut": 0.1, "churn": 0.1, "bugFix": 0.05},
    ("composite", "blastRadius", ""): {"similarity": 0.2, "transitiveImpact": 0.2, "fanIn": 0.15, "churn": 0.2, "bugFix": 0.15, "isHub": 0.05, "chunkFanIn": 0.05},
    ("composite", "bugHunt", ""): {"similarity": 0.2, "burstActivity": 0.18, "volatility": 0.18, "bugFix": 0.15, "pageRank": 0.14, "relativeChurnNorm": 0.1, "recency": 0.05, "blockPenalty": -0.05},
    ("composite", "codeReview", ""): {"similarity": 0.27, "recency": 0.13, "burstActivity": 0.1, "density": 0.08, "chunkChurn": 0.13, "chunkRelativeChurn": 0.09, "recentActivityConcentration": 0.13, "fanIn": 0.07, "blockPenalty": -0.1},
    ("composite", "criticalPath", ""): {"similarity": 0.2, "pageRank": 0.3, "bugFix": 0.3, "churn": 0.2},
    ("composite", "dangerous", ""): {"bugFix": 0.3, "volatility": 0.2, "knowledgeSilo": 0.15, "fanIn": 0.15, "burstActivity": 0.1, "similarity": 0.1, "blockPenalty": -0.05},
    ("composite", "decomposition", ""): {"similarity": 0.2, "chunkSize": 0.35, "chunkFanOut": 0.3, "chunkDensity": 0.15},
    ("composite", "entryPoint", ""): {"similarity": 0.3, "fanOutPerLine": 0.3, "fanIn": -0.2, "chunkSize": 0.1},
    ("composite", "godModule", "file"): {"similarity": 0.15, "symbolCount": 0.5, "fanIn": 0.15, "transitiveImpact": 0.1, "isHub": 0.1},
    ("composite", "hotspots", ""): {"similarity": 0.18, "chunkSize": 0.1, "chunkChurn": 0.15, "chunkRelativeChurn": 0.15, "burstActivity": 0.12, "bugFix": 0.1, "volatility": 0.12, "fanIn": 0.08, "blockPenalty": -0.15},
    ("composite", "ownership", "file"): {"similarity": 0.3, "ownership": 0.35, "knowledgeSilo": 0.25, "fanIn": 0.1},
    ("composite", "securityAudit", "file"): {"similarity": 0.2, "age": 0.15, "ownership": 0.1, "bugFix": 0.15, "pathRisk": 0.15, "volatility": 0.15, "fanIn": 0.1},
    ("composite", "techDebt", ""): {"similarity": 0.13, "age": 0.15, "churn": 0.1, "chunkChurn": 0.1, "bugFix": 0.15, "volatility": 0.1, "knowledgeSilo": 0.07, "density": 0.05, "fanIn": 0.1, "blockPenalty": -0.05},
}


def _norm(v: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN greatest(0.0, least(1.0, coalesce(({v})::DOUBLE, 0.0) / ({b}))) ELSE 0.0 END)"


def _damp(n: str, k: float) -> str:
    return f"(CASE WHEN coalesce({n}, 0) >= {k} THEN 1.0 ELSE power(coalesce({n}, 0)::DOUBLE / {k}, 2) END)"


def _silo(n: str) -> str:
    return f"(CASE WHEN {n} IS NULL OR {n} <= 0 THEN 0.0 WHEN {n} <= 1 THEN 1.0 WHEN {n} <= 2 THEN 0.5 ELSE 0.0 END)"


ALPHA = "(CASE WHEN git_chunk_commitCount IS NULL OR git_chunk_commitCount <= 0 THEN 0.0 ELSE least(1.0, git_chunk_commitCount::DOUBLE / git_file_commitCount * least(1.0, git_chunk_commitCount / 3.0)) END)"


def _blend(name: str, field: str, a: str, damped: bool = False) -> str:
    f = _norm(f"git_file_{field}", f"b_{name}_file_{field}")
    c = f"(CASE WHEN git_chunk_{field} IS NOT NULL THEN {_norm(f'git_chunk_{field}', f'b_{name}_chunk_{field}')} ELSE {f} END)"
    if damped:
        k = DERIVED[name].k
        c, f = f"({c} * {_damp('git_chunk_commitCount', k)})", f"({f} * {_damp('git_file_commitCount', k)})"
    return f"(CASE WHEN {a} = 0 THEN {f} ELSE {a} * {c} + (1 - {a}) * {f} END)"


_ASKED = "len(list_filter(['guide', 'install'], lambda w: list_contains(string_split_regex(lower({h}), '[\\s\\-_/]+'), w))) / 2.0"
HEADING = f"greatest(coalesce({_ASKED.format(h='heading1')}, 0.0), coalesce({_ASKED.format(h='heading2')} * 2 / 3.0, 0.0))"
RISK = "(CASE WHEN list_has_any(string_split_regex(lower(relativePath), '[^a-z0-9]+'), [" + ", ".join(f"'{x}'" for x in SECURITY_TOKENS) + "]) THEN 1.0 ELSE 0.0 END)"


def signals(level: str | None) -> dict[str, str]:
    a = "0.0" if level == "file" else ALPHA
    g = lambda name, scope, key: "0.0" if scope == "chunk" and level == "file" else _norm(f"codegraph_{scope}_{key}", f"b_{name}_{scope}_{key}")
    callable_ = "chunkType IN ('function', 'test', 'test_setup') AND methodLines > 0"
    silo_f = f"({_silo('git_file_blameContributorCount')} * {_damp('git_file_commitCount', 5)})"
    silo_c = f"({_silo('git_chunk_blameContributorCount')} * {_damp('git_chunk_commitCount', 5)})"
    share = lambda pct: f"((CASE WHEN {pct} > 0 THEN {pct} / 100.0 ELSE 0.0 END) * {_damp('git_file_commitCount', 5)})"
    return {
        "similarity": "(CASE WHEN high > low THEN (score - low) / (high - low) ELSE 1.0 END)", "documentation": "(CASE WHEN isDocumentation THEN 1.0 ELSE 0.0 END)", "headingRelevance": HEADING, "imports": "least(1.0, len(imports) / 20.0)", "pathRisk": RISK,
        "symbolCount": _norm("moduleMethodCount", "b_symbolCount_moduleMethodCount"), "chunkSize": f"(CASE WHEN {callable_} THEN {_norm('methodLines', 'b_chunkSize_methodLines')} ELSE 0.0 END)",
        "chunkDensity": f"(CASE WHEN {callable_} AND methodLines >= 20 THEN {_norm('methodDensity', 'b_chunkDensity_methodDensity')} ELSE 0.0 END)",
        "age": _blend("age", "ageDays", a), "recency": f"(1 - {_blend('recency', 'ageDays', a)})", "churn": _blend("churn", "commitCount", a), "stability": f"(1 - {_blend('stability', 'commitCount', a)})",
        "burstActivity": _blend("burstActivity", "recencyWeightedFreq", a), "bugFix": _blend("bugFix", "bugFixRate", a, True), "density": _blend("density", "changeDensity", a, True),
        "relativeChurnNorm": _blend("relativeChurnNorm", "relativeChurn", a, True), "volatility": _blend("volatility", "churnVolatility", a, True),
        "blockPenalty": f"(CASE WHEN chunkType <> 'block' THEN 0.0 WHEN git_chunk_commitCount IS NOT NULL THEN 1 - {a} ELSE 1.0 END)",
        "chunkChurn": f"({_norm('git_chunk_commitCount', 'b_chunkChurn_chunk_commitCount')} * {a})", "chunkRelativeChurn": f"({_norm('git_chunk_churnRatio', 'b_chunkRelativeChurn_chunk_churnRatio')} * {a})",
        "knowledgeSilo": f"(CASE WHEN {a} = 0 OR git_chunk_blameContributorCount IS NULL THEN {silo_f} ELSE {a} * {silo_c} + (1 - {a}) * {silo_f} END)",
        "ownership": share("git_file_blameDominantAuthorPct"), "recentActivityConcentration": share("git_file_recentDominantAuthorPct"),
        "fanIn": g("fanIn", "file", "fanIn"), "fanOut": g("fanOut", "file", "fanOut"), "fanOutPerLine": _norm("codegraph_file_fanOut / (endLine - startLine + 1.0)", "0.1"),
        "instability": f"(greatest(0.0, least(1.0, codegraph_file_instability)) * {_damp('codegraph_file_connectionCount', 5)})", "isHub": "(CASE WHEN codegraph_file_isHub THEN 1.0 ELSE 0.0 END)", "isLeaf": "(CASE WHEN codegraph_file_isLeaf THEN 1.0 ELSE 0.0 END)",
        "transitiveImpact": g("transitiveImpact", "file", "transitiveImpact"), "chunkFanIn": g("chunkFanIn", "chunk", "fanIn"), "chunkFanOut": g("chunkFanOut", "chunk", "fanOut"), "pageRank": g("pageRank", "chunk", "pageRank"),
    }


GRAPH = {"chunkFanIn", "chunkFanOut", "fanIn", "fanOutPerLine", "fanOut", "instability", "isHub", "isLeaf", "pageRank", "transitiveImpact"}


def _column(name: str, source: str) -> str:
    if not source.startswith(("file.", "chunk.")):
        return source
    return ("codegraph_" if name in GRAPH else "git_") + source.replace(".", "_")


def bounds(names) -> str:
    """Select list of the bounds b_SIGNAL_SOURCE over the candidates."""
    out = []
    for n in names:
        for s in DERIVED[n].sources:
            c = _column(n, s)
            if c in ("git_file_blameAuthors", "git_file_recentAuthors", "codegraph_file_isHub", "codegraph_file_isLeaf"):
                continue
            values = f"list_sort(list({c}::DOUBLE) FILTER (WHERE {c} > 0))"
            p95 = f"coalesce({values}[least(floor(len({values}) * 0.95)::BIGINT, len({values}) - 1) + 1], 1)"
            out.append(f"greatest({p95}, {DERIVED[n].bound or 1.0}) AS b_{n}_{s.replace('.', '_')}")
    return ", ".join(dict.fromkeys(out))


def preset_scores(chunks_sql: str) -> str:
    """(preset, id, rank_score) of every preset over all chunks."""
    parts = []
    for level in (None, "file"):
        s = signals(level)
        for (owner, name, of), weights in WEIGHTS.items():
            if (of == "file") != (level == "file"):
                continue
            total = sum(abs(w) for w in weights.values())
            value = "score" if set(weights) == {"similarity"} else "(" + " + ".join(f"{w} * {s[k]}" for k, w in weights.items()) + f") / {total}"
            parts.append(f"SELECT '{owner}/{name}' AS preset, id, round({value}, 6) AS rank_score FROM c, b")
    names = [n for n in DERIVED if DERIVED[n].sources]
    return f"WITH c AS ({chunks_sql}), b AS (SELECT {bounds(names)}, min(score) AS low, max(score) AS high FROM c)\n" + "\nUNION ALL\n".join(parts)
