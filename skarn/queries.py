"""The engine's registered queries, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from . import folding_fixture, macro_fixture, oracle, resolution_fixture, ruby_fixture
from .functions import numeric as N
from .functions import text as S
from .operators import dispatch, enrichment, graph, history, intervals, inverted, macros, resolution, retrieval, segment, stats, symbols, sync
from .plans import catalog, filters, rank
from .plans.catalog import DERIVED
from .sources import gitlog, walkers
from .storage import listing, stored, written
from .streaming import machines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _vec(spark: SparkSession, d: str, i: int) -> list[float]:
    return retrieval.vector_of(X.table(spark, d, "embeddings"), i)


# -- DuckDB building blocks ----------------------------------------------------

DOT = "list_dot_product(({a})::DOUBLE[], ({b})::DOUBLE[])"
COS = "({ab} / (sqrt({aa}) * sqrt({bb})))"


def _dot(a: str, b: str) -> str:
    return DOT.format(a=a, b=b)


def _cos(a: str, b: str) -> str:
    return COS.format(ab=_dot(a, b), aa=_dot(a, a), bb=_dot(b, b))


TOKENS = (
    "list_filter(string_split(lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '[^a-zA-Z0-9]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), "
    "'([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-zA-Z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-zA-Z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))), ' '), "
    "lambda w: len(w) >= 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in S.STOP_WORDS) + "], w))"
)
FNV = "(list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, len({t}) + 1), lambda i: ascii(substr({t}, i, 1))::BIGINT)), lambda a, c: (xor(a, c) * 16777619) & 4294967295) & 65535)"


# -- retrieval -----------------------------------------------------------------

_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


@query(f"""
WITH hits AS (SELECT doc_id, n_chars, (lang = 'de')::INT AS documentation, round({_cos('embedding', _Q0)}, 6) AS score
    FROM documents JOIN embeddings ON doc_id = vec_id WHERE lang = 'en' ORDER BY score DESC, doc_id LIMIT 40),
whole AS (SELECT quantile_cont(n_chars, 0.95) AS p FROM documents WHERE n_chars > 0),
batch AS (SELECT min(score) AS low, max(score) AS high, list_sort(list(n_chars) FILTER (WHERE n_chars > 0)) AS v FROM hits),
b AS (SELECT low, high, greatest(coalesce(v[least(floor(len(v) * 0.95)::BIGINT, len(v) - 1) + 1], 1), p, 1) AS bound FROM batch, whole)
SELECT doc_id, score, round((0.6 * CASE WHEN high > low THEN (score - low) / (high - low) ELSE 1 END + 0.3 * least(1.0, n_chars / bound) - 0.1 * documentation) / 1.0, 6) AS rank_score
FROM hits, b ORDER BY rank_score DESC, doc_id LIMIT 10""")
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: filter, exact cosine top 40, bounds of batch and collection, weighted score, top 10."""
    docs, vectors = X.table(spark, d, "documents"), X.table(spark, d, "embeddings")
    rows = docs.where(F.col("lang") == "en").join(vectors, F.col("doc_id") == F.col("vec_id"))
    hits = retrieval.dense(rows, _vec(spark, d, 0), 40, id_col="doc_id").select("doc_id", "n_chars", "score", (F.col("lang") == "de").cast("double").alias("documentation"))
    batch = hits.agg(F.min("score").alias("low"), F.max("score").alias("high"), rank.nearest_p95("n_chars").alias("p95"))
    whole = docs.where("n_chars > 0").agg(F.percentile("n_chars", F.lit(0.95)).alias("all95"))
    b = batch.crossJoin(whole)  # one row each
    bound = F.greatest("p95", "all95", F.lit(1.0))
    score = 0.6 * N.min_max(F.col("score"), F.col("low"), F.col("high")) + 0.3 * N.normalize("n_chars", bound) - 0.1 * F.col("documentation")
    return hits.crossJoin(F.broadcast(b)).select("doc_id", "score", F.round(score, 6).alias("rank_score")).orderBy(F.col("rank_score").desc(), "doc_id").limit(10)


@query(f"SELECT vec_id, round({_cos('embedding', _Q0)}, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dense(X.table(spark, d, "embeddings"), _vec(spark, d, 0), 20).select("vec_id", "score")


@query(f"SELECT vec_id, round({_cos('embedding', _Q0)}, 6) AS score FROM embeddings WHERE label % 2 = 1 ORDER BY score DESC, vec_id LIMIT 20")
def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dense(X.table(spark, d, "embeddings"), _vec(spark, d, 0), 20, F.col("label") % 2 == 1).select("vec_id", "score")


@query(f"""
SELECT 'dot' AS distance, vec_id, score FROM (SELECT vec_id, round({_dot('embedding', _Q0)}, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10) a
UNION ALL SELECT 'euclid', vec_id, score FROM (SELECT vec_id, round(-list_distance(embedding::DOUBLE[], {_Q0}::DOUBLE[]), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10) b""")
def dense_distances(spark: SparkSession, d: str) -> DataFrame:
    e, q = X.table(spark, d, "embeddings"), _vec(spark, d, 0)
    made = [retrieval.dense(e, q, 10, distance=k).select(F.lit(k).alias("distance"), "vec_id", "score") for k in ("dot", "euclid")]
    return made[0].unionByName(made[1])


_CODES = "list_transform({v}, lambda x: round(x::DOUBLE / list_max(list_transform({v}, lambda y: abs(y)))::DOUBLE * 127)::TINYINT)"


@query(f"""WITH c AS (SELECT vec_id, embedding, {_CODES.format(v='embedding')} AS codes FROM embeddings), r AS (SELECT vec_id, embedding FROM c ORDER BY {_cos('codes', _Q0)} DESC, vec_id LIMIT 80)
SELECT vec_id, round({_cos('embedding', _Q0)}, 6) AS score FROM r ORDER BY score DESC, vec_id LIMIT 20""")
def dense_quantised(spark: SparkSession, d: str) -> DataFrame:
    """Search on the codes of all lists with exact rescoring: whole vectors only of the best candidates."""
    index = _inverted(spark, d)
    return inverted.search(index, _vec(spark, d, 0), 20, len(index.centroids), 4.0).select("vec_id", "score")


_indexes: dict[tuple, inverted.Inverted] = {}


def _inverted(spark: SparkSession, d: str) -> inverted.Inverted:
    """The inverted file of all vectors, built once per application; its centroids are rows as they are, which SQL can follow."""
    key = (spark.sparkContext.applicationId, listing(spark, f"{d}/embeddings.parquet"))
    if key not in _indexes:
        _indexes[key] = inverted.build(X.table(spark, d, "embeddings"), rounds=0)
    return _indexes[key]


_PROBED = 0.75


def _probes(index: inverted.Inverted) -> int:
    return math.ceil(_PROBED * len(index.centroids))


_ROUGH = f"round({_cos("{a}", "{b}")}, 9)"
_LISTS = f"""v AS (SELECT vec_id, embedding AS e, {_CODES.format(v='embedding')} AS codes FROM embeddings),
c AS MATERIALIZED (SELECT e, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS list FROM v QUALIFY list < (SELECT floor(sqrt(count(*))) FROM v)),
m AS MATERIALIZED (SELECT vec_id, any_value(v.e) AS e, any_value(codes) AS codes, min({{'s': -{_ROUGH.format(a='v.e', b='c.e')}, 'k': list}}).k AS list FROM v, c GROUP BY vec_id),
q AS MATERIALIZED (SELECT vec_id AS query_id, v.e AS q FROM v WHERE vec_id % 20 = 0),
p AS MATERIALIZED (SELECT query_id, q, list FROM (SELECT query_id, q, list, row_number() OVER (PARTITION BY query_id ORDER BY {_ROUGH.format(a='q', b='c.e')} DESC, list) AS r FROM q, c) x WHERE r <= ceil({_PROBED} * (SELECT count(*) FROM c))),
t AS MATERIALIZED (SELECT query_id, q, vec_id, e FROM (SELECT query_id, q, vec_id, e, row_number() OVER (PARTITION BY query_id ORDER BY {_ROUGH.format(a='codes', b='q')} DESC, vec_id) AS r FROM m JOIN p USING (list)) x WHERE r <= 40),
f AS MATERIALIZED (SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM (SELECT query_id, vec_id, round({_cos('e', 'q')}, 6) AS score FROM t) x) y WHERE rank <= 10),
x AS MATERIALIZED (SELECT * FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT query_id, vec_id, round({_cos('e', 'q')}, 6) AS score FROM v, q) x) y WHERE rank <= 10)"""


@query(f"WITH {_LISTS}, n AS (SELECT count(f.vec_id) / count(*) AS recall FROM x LEFT JOIN f USING (query_id, vec_id)) SELECT query_id, rank, vec_id, score, round(recall, 6) AS recall, recall >= 0.9 AS enough FROM f, n")
def dense_inverted(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of every twentieth vector by an inverted file, with their recall against brute force over all rows."""
    e, index = X.table(spark, d, "embeddings"), _inverted(spark, d)
    asked = e.where(F.col("vec_id") % 20 == 0)
    found = written(inverted.search_all(index, asked, 10, _probes(index)), "neighbours")
    share = inverted.recall(found, inverted.exact_all(e, asked, 10)).select("recall")
    return found.crossJoin(F.broadcast(share)).select("query_id", "rank", "vec_id", "score", F.round("recall", 6).alias("recall"), (F.col("recall") >= 0.9).alias("enough"))  # one row


_V = lambda i: f"(SELECT embedding FROM embeddings WHERE vec_id = {i})"
_BEST = f"greatest({_cos('embedding', _V(1))}, {_cos('embedding', _V(2))})"


@query(f"""
WITH v AS (SELECT (SELECT embedding FROM embeddings WHERE vec_id = 1) AS a, (SELECT embedding FROM embeddings WHERE vec_id = 2) AS b, (SELECT embedding FROM embeddings WHERE vec_id = 3) AS n),
q AS (SELECT list_transform(range(1, len(a) + 1), lambda i: a[i]::DOUBLE + b[i]::DOUBLE - n[i]::DOUBLE) AS q FROM v)
SELECT vec_id, round({_cos('embedding', 'q')}, 6) AS score FROM embeddings, q WHERE vec_id NOT IN (1, 2, 3) ORDER BY score DESC, vec_id LIMIT 15""")
def recommend_average(spark: SparkSession, d: str) -> DataFrame:
    v = [_vec(spark, d, i) for i in (1, 2, 3)]
    return retrieval.recommend(X.table(spark, d, "embeddings"), v[:2], v[2:], "average_vector", 15, [1, 2, 3]).select("vec_id", "score")


@query(f"SELECT vec_id, round({_cos('embedding', _V(1))} + {_cos('embedding', _V(2))} - {_cos('embedding', _V(3))}, 6) AS score FROM embeddings WHERE vec_id NOT IN (1, 2, 3) ORDER BY score DESC, vec_id LIMIT 15")
def recommend_sum(spark: SparkSession, d: str) -> DataFrame:
    v = [_vec(spark, d, i) for i in (1, 2, 3)]
    return retrieval.recommend(X.table(spark, d, "embeddings"), v[:2], v[2:], "sum_scores", 15, [1, 2, 3]).select("vec_id", "score")


@query(f"SELECT vec_id, round(CASE WHEN {_BEST} > {_cos('embedding', _V(3))} THEN {_BEST} ELSE -{_cos('embedding', _V(3))} END, 6) AS score FROM embeddings WHERE vec_id NOT IN (1, 2, 3) ORDER BY score DESC, vec_id LIMIT 15")
def recommend_best(spark: SparkSession, d: str) -> DataFrame:
    v = [_vec(spark, d, i) for i in (1, 2, 3)]
    return retrieval.recommend(X.table(spark, d, "embeddings"), v[:2], v[2:], "best_score", 15, [1, 2, 3]).select("vec_id", "score")


@query(f"SELECT label, vec_id, score, rank FROM (SELECT label, vec_id, round({_cos('embedding', _Q0)}, 6) AS score, row_number() OVER (PARTITION BY label ORDER BY round({_cos('embedding', _Q0)}, 6) DESC, vec_id)::INT AS rank FROM embeddings) t WHERE rank <= 3")
def grouped_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.grouped(X.table(spark, d, "embeddings"), _vec(spark, d, 0), "label", 3).select("label", "vec_id", "score", "rank")


_BM25 = f"""
toks AS (SELECT doc_id, unnest(t) AS token, len(t) AS length FROM (SELECT doc_id, {TOKENS.format(t='text')} AS t FROM documents) x),
distinct_toks AS (SELECT token, {FNV.format(t='token')} AS bucket FROM (SELECT DISTINCT token FROM toks) y),
post AS (SELECT doc_id, bucket, length, count(*) AS tf FROM toks JOIN distinct_toks USING (token) GROUP BY ALL),
qt AS (SELECT unnest(t) AS token, len(t) AS length FROM (SELECT {TOKENS.format(t="'{q}'")} AS t) z),
qw AS (SELECT bucket, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 50.0)) AS w FROM (SELECT {FNV.format(t='token')} AS bucket, length, count(*) AS tf FROM qt GROUP BY ALL) z2),
idf AS (SELECT bucket, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM post WHERE bucket IN (SELECT bucket FROM qw) GROUP BY bucket),
bm AS (SELECT doc_id, round(sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 50.0)) * idf), 6) AS score FROM post JOIN qw USING (bucket) JOIN idf USING (bucket) GROUP BY doc_id)"""
TEXT_QUERY = "therean worthless tionha"


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, "postings", listing(spark, f"{d}/documents.parquet"), lambda: retrieval.postings(X.table(spark, d, "documents")), ["part"])


_POST = "WITH " + _BM25.replace("{q}", TEXT_QUERY)


@query(_POST + " SELECT doc_id, count(*) AS buckets, sum(tf)::BIGINT AS tokens, sum(bucket * tf)::BIGINT AS weighted FROM post GROUP BY doc_id")
def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    """The sparse form of all texts, stored with the collection and added up per text."""
    return _postings(spark, d).groupBy("doc_id").agg(F.count("*").alias("buckets"), F.sum("tf").alias("tokens"), F.sum(F.col("bucket") * F.col("tf")).alias("weighted"))


@query(_POST + " SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 20")
def sparse_bm25(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over stored postings: only the query's parts of them are read."""
    return retrieval.stored_sparse(_postings(spark, d), X.table(spark, d, "documents").count(), TEXT_QUERY, 20)


@query(_POST + " SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 20")
def sparse_bm25_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same without postings, from the texts."""
    return retrieval.sparse(X.table(spark, d, "documents"), TEXT_QUERY, 20)


_RRF = "WITH " + _BM25.replace("{q}", TEXT_QUERY) + f""",
s AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 20) x),
e AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM (SELECT vec_id, round({_cos('embedding', _Q0)}, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20) x)
SELECT doc_id, round(sum(p), 8) AS score FROM (SELECT doc_id, {{a}} / (60 + r) AS p FROM e UNION ALL SELECT doc_id, {{b}} / (60 + r) FROM s) u GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20"""


@query(_RRF.replace("{a}", "1.0").replace("{b}", "1.0"))
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(X.table(spark, d, "documents"), X.table(spark, d, "embeddings"), TEXT_QUERY, _vec(spark, d, 0), 20, post=_postings(spark, d))


@query(_RRF.replace("{a}", "0.7").replace("{b}", "0.3"))
def hybrid_rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(X.table(spark, d, "documents"), X.table(spark, d, "embeddings"), TEXT_QUERY, _vec(spark, d, 0), 20, 0.7, post=_postings(spark, d))


@query(f"SELECT source, max(score) AS score, list(doc_id ORDER BY -score, doc_id) AS members FROM (SELECT doc_id, source, round({_cos('embedding', _Q0)}, 6) AS score FROM documents JOIN embeddings ON doc_id = vec_id ORDER BY score DESC, doc_id LIMIT 60) t GROUP BY source ORDER BY score DESC, source LIMIT 8")
def file_level_group(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "documents").join(X.table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    hits = retrieval.dense(rows, _vec(spark, d, 0), 60, id_col="doc_id")
    return retrieval.file_level(hits, "source", "doc_id", 8)


# -- ranking -------------------------------------------------------------------


@query(oracle.preset_scores(X.CHUNKS))
def preset_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk's score under every preset, from one computation of all signals per level."""
    c = X.chunks(spark, d)
    out = None
    for level in (None, "file"):
        chosen = [p for p in catalog.ALL_PRESETS if (p.level == "file") == (level == "file")]
        used = {n for p in chosen for n in p.weights}
        scored = rank.score(c, {"custom": {n: 1.0 for n in DERIVED if n in used}}, level=level, query="Guide to the install")
        rows = []
        for p in chosen:
            total = sum(abs(w) for w in p.weights.values())
            value = F.col("score") if set(p.weights) == {"similarity"} else sum((F.lit(w) * F.col(f"signal_{n}") for n, w in p.weights.items()), F.lit(0.0)) / total
            rows.append(F.struct(F.lit(f"{p.owner}/{p.name}").alias("preset"), F.round(value.cast("double"), 6).alias("rank_score")))
        part = scored.select("id", F.explode(F.array(*rows)).alias("r")).select("r.preset", "id", "r.rank_score")
        out = part if out is None else out.unionByName(part)
    return out


_HOT = {k: v for k, v in catalog.presets()["hotspots"].weights.items() if k != "similarity"}
_SQL_SIGNALS = oracle.signals(None)
_PRODUCTION = "NOT coalesce(isTest, false) AND NOT coalesce(isDocumentation, false) AND NOT coalesce(chunkType = 'block', false)"


@query(f"WITH c AS (SELECT * FROM ({X.CHUNKS}) t WHERE {_PRODUCTION}), b AS (SELECT {oracle.bounds([n for n in _HOT if DERIVED[n].sources])}, 0 AS low, 0 AS high FROM c) SELECT id, round((" + " + ".join(f"{w} * {_SQL_SIGNALS[k]}" for k, w in _HOT.items()) + f") / {sum(map(abs, _HOT.values()))}, 6) AS rank_score FROM c, b ORDER BY rank_score DESC, id LIMIT 25")
def rank_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of the hotspots preset without a query, with the preset's own filter."""
    c = X.chunks(spark, d)
    kept = c.where(filters.preset(c, "production")).withColumn("score", F.lit(0.0))
    scored = rank.score(kept, {"custom": _HOT}).withColumn("rank_score", F.round("rank_score", 6))
    return rank.top(scored, 25, "id").select("id", "rank_score")


@query(f"SELECT parentSymbolId, id, score FROM (SELECT *, row_number() OVER (PARTITION BY parentSymbolId ORDER BY score DESC, id) AS n FROM ({X.CHUNKS}) t) u WHERE n = 1 OR parentSymbolId IS NULL")
def group_by_parent(spark: SparkSession, d: str) -> DataFrame:
    return rank.group_top(X.chunks(spark, d), "parentSymbolId", "id", "score").select("parentSymbolId", "id", "score")


_FILTER_SQL = {
    "language": ("fr", "language = 'fr'"), "fileExtension": ([".en", ".de"], "fileExtension IN ('.en', '.de')"), "chunkType": ("function", "chunkType = 'function'"), "documentation": ("exclude", "NOT coalesce(isDocumentation, false)"), "testFile": ("only", "coalesce(isTest, false)"),
    "pathPattern": ("src{1,2}/**/f?.en", "regexp_matches(relativePath, '^src(1|2)/(.*/)?f[^/]\\.en$')"), "symbolId": ("X#m3", "symbolId = 'X#m3' OR string_split_regex(symbolId, '::|[#.]')[-1] = 'm3'"), "recentAuthor": ("a3@x.org", "git_file_recentDominantAuthor = 'a3@x.org' OR git_file_recentDominantAuthorEmail = 'a3@x.org'"), "blameOwner": ("b5", "git_file_blameDominantAuthor = 'b5'"),
    "minRecentContributors": (3, "git_file_recentContributorCount >= 3"), "maxRecentContributors": (2, "git_file_recentContributorCount <= 2"), "modifiedAfter": ("2023-12-01", "git_file_lastModifiedAt >= 1701388800"), "modifiedBefore": ("2023-12-01T12:00:00", "git_file_lastModifiedAt <= 1701432000"),
    "minAgeDays": (100, "git_file_ageDays > 0 AND git_file_ageDays >= 100"), "maxAgeDays": (90, "git_file_ageDays > 0 AND git_file_ageDays <= 90"), "minCommitCount": (20, "git_file_commitCount >= 20"), "taskId": ("TD-3", "list_contains(git_file_taskIds, 'TD-3')"), "minFanIn": (12, "codegraph_file_fanIn >= 12"), "minFanOut": (9, "codegraph_file_fanOut >= 9"),
    "minPageRank": (0.005, "codegraph_chunk_pageRank >= 0.005"), "minInstability": (0.5, "codegraph_file_instability >= 0.5"), "minTransitiveImpact": (30, "codegraph_file_transitiveImpact >= 30"), "minConnectionCount": (4, "codegraph_file_connectionCount >= 4"), "isHub": (True, "codegraph_file_isHub"), "isLeaf": (False, "NOT codegraph_file_isLeaf"),
}


@query(f"WITH c AS ({X.CHUNKS}) " + " UNION ALL ".join(f"SELECT '{k}' AS param, count(*) AS n, coalesce(sum(id), 0)::BIGINT AS ids FROM c WHERE {sql}" for k, (_, sql) in _FILTER_SQL.items()))
def filter_parameters(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks, and which, each typed parameter keeps."""
    c = X.chunks(spark, d)
    flags = [F.when(filters.typed(c, **{k: v}), F.col("id")).alias(k) for k, (v, _) in _FILTER_SQL.items()]
    one = c.select(*flags).agg(*[F.struct(F.lit(k).alias("param"), F.count(k).alias("n"), F.coalesce(F.sum(k), F.lit(0)).alias("ids")).alias(k) for k in _FILTER_SQL])
    return one.select(F.explode(F.array(*_FILTER_SQL)).alias("r")).select("r.param", "r.n", "r.ids")


def _preset_sql(name: str) -> str:
    def one(c) -> str:
        key = c.key.replace(".", "_") if c.key.startswith(("git.", "codegraph.")) else c.key
        if c.op == "contains":
            return f"contains(lower({key}), '{c.value}')"
        v = f"({', '.join(repr(x) for x in c.value)})" if isinstance(c.value, list) else str(c.value).lower() if isinstance(c.value, bool) else repr(c.value)
        return f"coalesce({key} {'IN' if isinstance(c.value, list) else {'eq': '=', 'gte': '>=', 'lte': '<='}[c.op]} {v}, false)"

    by = {k: [one(c) for c in catalog.FILTER_PRESETS[name] if c.kind == k] for k in ("must", "should", "must_not")}
    parts = [*by["must"], *([f"({' OR '.join(by['should'])})"] if by["should"] else []), *[f"NOT {x}" for x in by["must_not"]]]
    return " AND ".join(parts)


@query(f"WITH c AS ({X.CHUNKS}) " + " UNION ALL ".join(f"SELECT '{k}' AS preset, count(*) AS n, coalesce(sum(id), 0)::BIGINT AS ids FROM c WHERE {_preset_sql(k)}" for k in catalog.FILTER_PRESETS))
def filter_presets(spark: SparkSession, d: str) -> DataFrame:
    c = X.chunks(spark, d)
    names = list(catalog.FILTER_PRESETS)
    one = c.select(*[F.when(filters.preset(c, k), F.col("id")).alias(k) for k in names]).agg(*[F.struct(F.lit(k).alias("preset"), F.count(k).alias("n"), F.coalesce(F.sum(k), F.lit(0)).alias("ids")).alias(k) for k in names])
    return one.select(F.explode(F.array(*names)).alias("r")).select("r.preset", "r.n", "r.ids")


@query(f"WITH c AS ({X.CHUNKS}) SELECT id FROM c WHERE language = 'en' AND git_file_commitCount > 5 AND git_file_commitCount <= 30 AND (chunkType IN ('class', 'block') OR isTest) AND NOT (coalesce(git_chunk_commitCount IS NULL, false) OR contains(lower(relativePath), 'src3'))")
def filter_tree(spark: SparkSession, d: str) -> DataFrame:
    """A raw boolean tree with all kinds of leaves."""
    c = X.chunks(spark, d)
    tree = {
        "must": [{"key": "language", "match": {"value": "en"}}, {"key": "git.file.commitCount", "range": {"gt": 5, "lte": 30}}],
        "should": [{"key": "chunkType", "match": {"any": ["class", "block"]}}, {"key": "isTest", "match": {"value": True}}],
        "must_not": [{"is_empty": {"key": "git.chunk.commitCount"}}, {"key": "relativePath", "match": {"text": "SRC3"}}],
    }
    return c.where(filters.resolve(c, tree)).select("id")


# -- statistics ----------------------------------------------------------------

_STATS = ["contentSize", "git.file.commitCount", "git.file.bugFixRate", "git.chunk.commitCount", "codegraph.chunk.fanIn", "moduleLines"]


def _stats_sql() -> str:
    parts = []
    for k in _STATS:
        s, c = catalog.SIGNALS[k], k.replace(".", "_")
        where = [f"{c} > 0"] + ([f"chunkType = '{s.only}'"] if s.only else []) + (["first_in_file"] if s.once_per_file else [])
        parts.append(f"SELECT '{k}' AS signal, language, scope, {c}::DOUBLE AS value FROM c WHERE {' AND '.join(where)}")
    ps = ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90, 95))
    rest = "round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS stddev_value"
    return f"""WITH b AS ({X.CHUNKS}), c AS (SELECT *, row_number() OVER (PARTITION BY relativePath ORDER BY startLine, id) = 1 AS first_in_file,
CASE WHEN chunkType = 'test' THEN 'test' WHEN isTest AND sum((chunkType = 'test')::INT) OVER (PARTITION BY language) = 0 THEN 'test' ELSE 'source' END AS scope FROM b), v AS ({' UNION ALL '.join(parts)})
SELECT CASE WHEN language IS NULL THEN 'collection' WHEN scope IS NULL THEN 'language' ELSE 'scope' END AS grain, language, scope, signal, count(*) AS n, {ps}, {rest} FROM v GROUP BY GROUPING SETS ((signal), (signal, language), (signal, language, scope))"""


@query(_stats_sql())
def signal_percentiles(spark: SparkSession, d: str) -> DataFrame:
    c = X.chunks(spark, d)
    return stats.signal_percentiles(c.withColumn("scope", stats.scope(c)), _STATS)


@query(f"WITH c AS ({X.CHUNKS}), n AS (SELECT language, count(*) AS n FROM c GROUP BY language) SELECT language, n FROM n WHERE n >= 0.05 * (SELECT sum(n) FROM n) AND n >= 10")
def kept_languages(spark: SparkSession, d: str) -> DataFrame:
    return stats.kept_languages(X.chunks(spark, d))


@query(f"WITH c AS ({X.CHUNKS}) SELECT 'language' AS kind, language AS value, count(*) AS n FROM c GROUP BY language UNION ALL SELECT 'chunkType', chunkType, count(*) FROM c GROUP BY chunkType UNION ALL (WITH a AS (SELECT git_file_blameDominantAuthor AS v, count(*) AS n FROM c GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS k FROM a) SELECT 'author', CASE WHEN k <= 10 THEN v ELSE '(others)' END, sum(n)::BIGINT FROM r GROUP BY 2)")
def distributions(spark: SparkSession, d: str) -> DataFrame:
    c = X.chunks(spark, d)
    kinds = [stats.counts_by(c, "language"), stats.counts_by(c, "chunkType"), stats.top_and_others(c, "git.file.blameDominantAuthor")]
    named = [k.select(F.lit(n).alias("kind"), "value", "n") for k, n in zip(kinds, ("language", "chunkType", "author"), strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(f"WITH c AS ({X.CHUNKS}) SELECT count(*) AS chunks, sum(isDocumentation::INT)::BIGINT AS doc_chunks, sum((NOT isDocumentation)::INT)::BIGINT AS code_chunks, count(DISTINCT relativePath) AS files, min(git_file_firstCreatedAt) AS first_created, max(git_file_lastModifiedAt) AS last_modified, count(DISTINCT relativePath) AS files_with_history FROM c")
def collection_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.summary(X.chunks(spark, d))


_BACKGROUND = f"""p AS (SELECT vec_id, embedding AS e, row_number() OVER (ORDER BY vec_id) - 1 AS at FROM embeddings),
s AS (SELECT {_cos('x.e', 'y.e')} AS s FROM p x JOIN p y ON x.at % 2 = 0 AND y.at = x.at + 1)"""


@query(f"WITH {_BACKGROUND} SELECT round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS stddev, count(*) AS pairs FROM s")
def score_background(spark: SparkSession, d: str) -> DataFrame:
    return stats.score_background(X.table(spark, d, "embeddings"))


@query(f"""WITH {_BACKGROUND}, b AS (SELECT round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS sd FROM s),
h AS (SELECT 'd' || label || '/x' AS path, round({_cos('embedding', _Q0)}, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10),
dirs AS (SELECT count(*) AS k FROM h GROUP BY regexp_extract(path, '^(.*)/[^/]*$', 1)),
l AS (SELECT greatest(0.0, least(1.0, 1 - (-sum(k / 10.0 * ln(k / 10.0))) / ln(10))) AS loc FROM dirs),
v AS (SELECT floor(greatest(0.0, least(1.0, 0.75 * greatest(0.0, least(1.0, ((SELECT avg(score) FROM h) - mean) / sd / 2 - 0.5)) + 0.25 * loc)) * 100 + 0.5) / 100 AS c FROM b, l)
SELECT c AS confidence, CASE WHEN c >= 0.55 THEN 'high' WHEN c >= 0.35 THEN 'medium' ELSE 'low' END AS label FROM v""")
def search_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "embeddings")
    hits = retrieval.dense(e, _vec(spark, d, 0), 10).select(F.concat(F.lit("d"), F.col("label"), F.lit("/x")).alias("relativePath"), "score")
    b = stats.score_background(e).first()
    return rank.confidence(hits, b.mean, b.stddev, b.pairs)


_LADDER = "CASE WHEN least({r}, {cap}) >= 2 THEN 'critical' WHEN least({r}, {cap}) = 1 THEN 'concerning' ELSE 'healthy' END"


@query(f"""WITH c AS ({X.CHUNKS}), q AS (SELECT quantile_cont(git_file_bugFixRate, 0.5) FILTER (WHERE git_file_bugFixRate > 0) AS p50, quantile_cont(git_file_bugFixRate, 0.75) FILTER (WHERE git_file_bugFixRate > 0) AS p75, quantile_cont(git_file_bugFixRate, 0.95) FILTER (WHERE git_file_bugFixRate > 0) AS p95,
quantile_cont(git_file_commitCount, 0.1) AS s10, quantile_cont(git_file_commitCount, 0.25) AS s25 FROM c),
r AS (SELECT id, CASE WHEN git_file_bugFixRate >= round(p95, 6) THEN 2 WHEN git_file_bugFixRate >= round(p75, 6) THEN 1 ELSE 0 END AS r, CASE WHEN git_file_commitCount < s10 THEN 0 WHEN git_file_commitCount < s25 THEN 1 ELSE 2 END AS cap FROM c, q)
SELECT id, {_LADDER.format(r='r', cap='cap')} AS label FROM r""")
def label_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Bug-fix labels by the collection's percentiles, capped where a file has few commits."""
    c = X.chunks(spark, d)
    known = stats.as_mapping(stats.signal_percentiles(c.withColumn("scope", stats.scope(c)), ["git.file.bugFixRate", "git.file.commitCount"]))
    return c.select("id", rank.signal_label(c, "git.file.bugFixRate", known).alias("label"))


# -- history -------------------------------------------------------------------

_K = "regexp_extract(props, '([0-9]+)', 1)"
_BODY = f"""CASE event_type WHEN 'error' THEN 'fix: handle ' || {_K} WHEN 'click' THEN 'ABC-' || {_K} || ' update #' || CAST(event_id AS STRING) || ' and !7' WHEN 'view' THEN 'Merge branch ''x''' WHEN 'signup' THEN '[TD-12] fixed login' ELSE 'closes #' || {_K} || ' with text fix' END"""
COMMITS_SQL = f"SELECT event_id AS id, 'u' || user_id AS author, {_K} AS file, floor(epoch(ts))::BIGINT AS ts, {_BODY} AS body, abs(value) AS churn, event_type FROM events"
_FIX = "(NOT regexp_matches(body, '(?i)^Merge\\b') AND NOT regexp_matches(body, '(?i)\\btext\\s+fix(?:es)?\\b') AND (regexp_matches(body, '(?i)^(?:hot)?fix(?:\\([^)]+\\))?!?:') OR regexp_matches(body, '(?i)^\\[?[A-Z]+-\\d+\\]?\\s+(?:fix|fixed|fixes)\\b') OR regexp_matches(body, '(?i)\\b(?:fix|fixe[sd]|resolve[sd]?|close[sd]?)\\s+#\\d+')))"


def commits(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1)
    body = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("fix: handle "), k)).when(F.col("event_type") == "click", F.concat(F.lit("ABC-"), k, F.lit(" update #"), F.col("event_id"), F.lit(" and !7")))
        .when(F.col("event_type") == "view", "Merge branch 'x'").when(F.col("event_type") == "signup", "[TD-12] fixed login").otherwise(F.concat(F.lit("closes #"), k, F.lit(" with text fix")))
    )
    out = e.select(F.col("event_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("author"), k.alias("file"), F.col("ts").cast("timestamp").cast("bigint").alias("ts"), body.alias("body"), F.abs("value").alias("churn"), "event_type")
    return out.withColumn("is_fix", S.is_fix("body"))


@query(f"WITH c AS ({COMMITS_SQL}) SELECT id, {_FIX} AS is_fix, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(body, '\\b([A-Z]{{2,10}}-\\d{{1,6}})\\b', 1), list_concat(list_transform(regexp_extract_all(body, '(?:^|[^&])#(\\d{{1,7}})\\b', 1), lambda x: '#' || x), list_transform(regexp_extract_all(body, '!(\\d{{1,7}})\\b', 1), lambda x: '!' || x))))), ' ') AS tasks FROM c")
def commit_messages(spark: SparkSession, d: str) -> DataFrame:
    """Bug fixes and ticket ids of all messages."""
    return commits(spark, d).select("id", "is_fix", F.array_join(F.array_sort(S.task_ids("body")), " ").alias("tasks"))


_SESSIONS = f"""c AS (SELECT *, {_FIX} AS is_fix FROM ({COMMITS_SQL}) x WHERE NOT regexp_matches(body, '(?i)^Merge\\b')),
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= {{gap}} THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY {{keys}} ORDER BY ts, id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY {{keys}} ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS session FROM g)"""


@query("WITH " + _SESSIONS.format(gap=86400, keys="author") + " SELECT author, session::BIGINT AS session, max(ts) AS ts, min(ts) AS first_ts, count(*) AS commits, bool_or(is_fix) AS is_fix FROM s GROUP BY author, session")
def commit_sessions(spark: SparkSession, d: str) -> DataFrame:
    return history.sessions(commits(spark, d), gap_minutes=1440, id_col="id")


def _metrics_sql(units: str) -> str:
    return f"""SELECT file, count(*) AS commit_count, floor(sum(exp(-0.1 * ({X.AS_OF} - ts) / 86400.0)) * 100 + 0.5) / 100 AS recency_weighted_freq, floor(count(*) / greatest((max(ts) - min(ts)) / 2592000.0, 1.0) * 100 + 0.5) / 100 AS change_density,
floor(coalesce(stddev_pop(gap), 0.0) * 100 + 0.5) / 100 AS churn_volatility, floor(100 * avg(is_fix::INT) + 0.5)::BIGINT AS bug_fix_rate FROM (SELECT *, (ts - lag(ts) OVER (PARTITION BY file ORDER BY ts, id)) / 86400.0 AS gap FROM {units}) u GROUP BY file"""


_PLAIN = f"""plain AS (SELECT file, max(ts) AS last_modified_at, floor(({X.AS_OF} - max(ts)) / 86400)::BIGINT AS age_days, sum(added)::BIGINT AS lines_added, sum(deleted)::BIGINT AS lines_deleted FROM a GROUP BY file),
per AS (SELECT file, author, count(*) AS n, min(ts * 1000000 + id) AS first FROM a GROUP BY file, author), rk AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, first) AS r, sum(n) OVER (PARTITION BY file) AS total FROM per),
au AS (SELECT file, max(CASE WHEN r = 1 THEN author END) AS dominant_author, max(CASE WHEN r = 1 THEN floor(100.0 * n / total + 0.5) END)::BIGINT AS dominant_pct, count(*) AS contributors FROM rk GROUP BY file)"""
_ALL = f"a AS (SELECT *, {_FIX} AS is_fix, floor(churn)::BIGINT AS added, floor(churn / 3)::BIGINT AS deleted FROM ({COMMITS_SQL}) x)"
_FILE_COLUMNS = ["file", "last_modified_at", "age_days", "lines_added", "lines_deleted", "commit_count", "recency_weighted_freq", "change_density", "churn_volatility", "bug_fix_rate", "dominant_author", "dominant_pct", "contributors"]


@query(f"WITH {_ALL}, m AS ({_metrics_sql('a')}), {_PLAIN} SELECT {', '.join(_FILE_COLUMNS)}, floor((lines_added + lines_deleted) * 100.0 + 0.5) / 100 AS relative_churn FROM plain JOIN m USING (file) JOIN au USING (file)")
def file_churn_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = commits(spark, d).withColumn("added", F.floor("churn")).withColumn("deleted", F.floor(F.col("churn") / 3))
    return history.file_metrics(c, X.AS_OF).select(*_FILE_COLUMNS, "relative_churn")


@query("WITH " + _SESSIONS.format(gap=86400, keys="file, author") + ", z AS (SELECT file, author || '#' || session AS id, max(ts) AS ts, bool_or(is_fix) AS is_fix FROM s GROUP BY file, author, session) " + _metrics_sql("z"))
def file_session_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The counting metrics with bursts of commits squashed to sessions."""
    c = commits(spark, d).withColumn("added", F.lit(0)).withColumn("deleted", F.lit(0))
    return history.file_metrics(c, X.AS_OF, squash=True, gap_minutes=1440).select("file", "commit_count", "recency_weighted_freq", "change_density", "churn_volatility", "bug_fix_rate")


@query(f"""WITH p AS ({X.POINTS}), n AS (SELECT file, author, count(*) AS n FROM p GROUP BY file, author), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, author) AS r, sum(n) OVER (PARTITION BY file) AS t FROM n)
SELECT file, max(CASE WHEN r = 1 THEN author END) AS blame_dominant_author, max(CASE WHEN r = 1 THEN floor(100.0 * n / t + 0.5) END)::BIGINT AS blame_dominant_author_pct, list(author ORDER BY r) FILTER (WHERE r <= 10) AS blame_authors, count(*) AS blame_contributor_count FROM r GROUP BY file""")
def author_ownership(spark: SparkSession, d: str) -> DataFrame:
    return history.blame(X.frame(spark, d, X.POINTS, "lineitem"))


_MERGES = "SELECT 'c' || CAST(p_partkey AS STRING) AS sha, CASE WHEN p_partkey % 50 = 0 THEN array('c' || CAST(p_partkey - 1 AS STRING), 'c' || CAST(p_partkey + 7 AS STRING)) WHEN p_partkey % 50 = 12 THEN array('c' || CAST(p_partkey + 37 AS STRING)) ELSE array('c' || CAST(p_partkey + 1 AS STRING)) END AS parents, CASE WHEN p_partkey % 100 = 0 THEN 'Merge branch ''fix/x''' WHEN p_partkey % 50 = 0 THEN 'Merge branch ''feature/x''' ELSE 'work' END AS body FROM part"


@query("""WITH RECURSIVE c AS (""" + _MERGES.replace("array(", "list_value(") + """), t AS (SELECT sha AS merge, parents[1] AS main, parents[2] AS sha FROM c WHERE len(parents) >= 2 AND regexp_matches(body, '(?i)Merge branch ''(?:fix|hotfix|bugfix)/')),
w AS (SELECT merge, main, t.sha FROM t JOIN c USING (sha) WHERE t.sha <> main UNION SELECT w.merge, w.main, p FROM w JOIN (SELECT sha, unnest(parents) AS p FROM c) e ON e.sha = w.sha WHERE p <> w.main AND p IN (SELECT sha FROM c))
SELECT DISTINCT sha FROM w""")
def fix_branch_commits(spark: SparkSession, d: str) -> DataFrame:
    return history.fix_branch_commits(X.frame(spark, d, _MERGES, "part"))


# -- graph ---------------------------------------------------------------------

_FANS = f"""e AS ({X.EDGES}), f AS (SELECT n_name AS rel_path, (SELECT count(*) FROM e WHERE dst = n_name) AS fan_in, (SELECT count(*) FROM e WHERE src = n_name) AS fan_out FROM nation)"""


@query(f"WITH {_FANS} SELECT * FROM f")
def fan_in_out(spark: SparkSession, d: str) -> DataFrame:
    return graph.fan(X.edges(spark, d), X.table(spark, d, "nation").select(F.col("n_name").alias("rel_path")))


@query(f"WITH {_FANS}, p AS (SELECT quantile_cont(fan_in, 0.95) AS p95 FROM f) SELECT rel_path, fan_in, fan_out, CASE WHEN fan_in + fan_out > 0 THEN fan_out / (fan_in + fan_out)::DOUBLE ELSE 0.0 END AS instability, fan_in + fan_out AS connection_count, fan_in > p95 AS is_hub, fan_out = 0 AND fan_in > 0 AS is_leaf FROM f, p")
def hub_leaf_instability(spark: SparkSession, d: str) -> DataFrame:
    return graph.file_signals(graph.fan(X.edges(spark, d), X.table(spark, d, "nation").select(F.col("n_name").alias("rel_path"))))


@query(f"""WITH RECURSIVE e AS ({X.SPARSE}), n AS (SELECT src AS x FROM e UNION SELECT dst FROM e), r AS (SELECT x AS root, x AS node, 0 AS k FROM n UNION SELECT root, src, k + 1 FROM r JOIN e ON dst = node WHERE k < 5)
SELECT root, count(DISTINCT CASE WHEN node <> root THEN node END) AS impact FROM r GROUP BY root""")
def transitive_impact(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(X.parts(spark, d, X.SPARSE))


def _page_rank_sql(rounds: int) -> str:
    steps = [f"e0 AS ({X.SPARSE}), n AS (SELECT src AS node FROM e0 UNION SELECT dst FROM e0), c AS (SELECT count(*)::DOUBLE AS n FROM n), e AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS share FROM e0), r0 AS (SELECT node, 1.0 / c.n AS r FROM n, c)"]
    for k in range(rounds):
        steps.append(f"r{k + 1} AS (SELECT n.node, 0.15 / c.n + 0.85 * (coalesce(g.g, 0) + (SELECT coalesce(sum(r), 0) FROM r{k} WHERE node NOT IN (SELECT src FROM e)) / c.n) AS r FROM n CROSS JOIN c LEFT JOIN (SELECT dst, sum(share * r) AS g FROM e JOIN r{k} ON src = node GROUP BY dst) g ON g.dst = n.node)")
    return f"WITH {', '.join(steps)} SELECT node, round(r, 8) AS rank FROM r{rounds}"


@query(_page_rank_sql(8))
def page_rank_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Eight rounds, so that SQL can follow them; without ``fixed`` it runs to 1e-6."""
    return graph.page_rank(X.parts(spark, d, X.SPARSE), iterations=8, fixed=True).select("node", F.round("rank", 8).alias("rank"))


@query()
def page_rank_converged(spark: SparkSession, d: str) -> DataFrame:
    return graph.page_rank(X.parts(spark, d, X.SPARSE)).select("node", F.round("rank", 6).alias("rank"))


@query(f"""WITH RECURSIVE e AS (SELECT * FROM ({X.SPARSE}) x WHERE src <> dst), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM r JOIN e ON src = b),
m AS (SELECT x.a AS node, x.b AS other FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b) SELECT node, least(node, min(other)) AS component FROM m GROUP BY node""")
def strong_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(X.parts(spark, d, X.SPARSE), few=0)


_TYPES = f"t AS ({X.TYPES})"


@query(f"WITH RECURSIVE {_TYPES}, r AS (SELECT source_fq_name AS name, 1 AS depth FROM t WHERE ancestor_fq_name = 'T2' UNION SELECT source_fq_name, depth + 1 FROM r JOIN t ON ancestor_fq_name = name WHERE depth < 20) SELECT name, min(depth) AS depth FROM r GROUP BY name")
def transitive_subtypes(spark: SparkSession, d: str) -> DataFrame:
    return graph.subtypes(X.parts(spark, d, X.TYPES), "T2")


@query(f"WITH {_TYPES}, n AS (SELECT source_fq_name AS name FROM t UNION SELECT ancestor_fq_name FROM t) SELECT name, coalesce((SELECT list(ancestor_fq_name ORDER BY ordinal, ancestor_fq_name) FROM t WHERE source_fq_name = name), []) AS supertypes, coalesce((SELECT list(DISTINCT source_fq_name ORDER BY source_fq_name) FROM t WHERE ancestor_fq_name = name), []) AS subtypes FROM n")
def type_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return graph.hierarchy(X.parts(spark, d, X.TYPES))


_VISIBLE = "NOT (edge_kind = 'dynamic' AND confidence < 1)"


@query(f"""WITH e AS ({X.CALLS}), {_TYPES}, x AS (SELECT *, 0 AS via FROM e WHERE target_symbol_id = 'T5#m2' UNION ALL SELECT *, 1 FROM e WHERE edge_kind = 'poly-base' AND target_symbol_id IN (SELECT ancestor_fq_name || '#m2' FROM t WHERE source_fq_name = 'T5')),
r AS (SELECT *, row_number() OVER (PARTITION BY source_symbol_id, call_expression ORDER BY via, source_rel_path, target_symbol_id) AS n FROM x WHERE {_VISIBLE})
SELECT source_symbol_id, source_rel_path, target_symbol_id, call_expression, edge_kind FROM r WHERE n = 1 ORDER BY source_rel_path, source_symbol_id, call_expression LIMIT 50""")
def callers(spark: SparkSession, d: str) -> DataFrame:
    """Direct callers, and those of the same member of a base type."""
    return graph.callers(X.parts(spark, d, X.CALLS), X.parts(spark, d, X.TYPES), "T5#m2").select("source_symbol_id", "source_rel_path", "target_symbol_id", "call_expression", "edge_kind")


@query(f"""WITH e AS ({X.CALLS}), {_TYPES}, s AS ({X.SYMBOLS}), o AS (SELECT * FROM e WHERE source_symbol_id = 'T6#m1' AND {_VISIBLE}),
x AS (SELECT target_symbol_id, target_rel_path, call_expression FROM o UNION SELECT s.symbol_id, s.rel_path, call_expression FROM o JOIN t ON ancestor_fq_name = split_part(target_symbol_id, '#', 1) JOIN s ON s.symbol_id = source_fq_name || '#' || split_part(target_symbol_id, '#', 2) WHERE edge_kind = 'poly-base')
SELECT DISTINCT target_symbol_id, target_rel_path, call_expression FROM x ORDER BY target_rel_path, target_symbol_id, call_expression LIMIT 50""")
def callees(spark: SparkSession, d: str) -> DataFrame:
    return graph.callees(X.parts(spark, d, X.CALLS), X.parts(spark, d, X.TYPES), X.parts(spark, d, X.SYMBOLS), "T6#m1").select("target_symbol_id", "target_rel_path", "call_expression")


@query(f"WITH e AS ({X.CALLS}), b AS (SELECT target_symbol_id AS s, confidence AS i, 0.0 AS o FROM e UNION ALL SELECT source_symbol_id, 0.0, confidence FROM e) SELECT s AS symbol_id, floor(sum(i) * 100 + 0.5) / 100 AS fan_in, floor(sum(o) * 100 + 0.5) / 100 AS fan_out FROM b GROUP BY s")
def weighted_call_fan(spark: SparkSession, d: str) -> DataFrame:
    return graph.call_fan(X.parts(spark, d, X.CALLS))


@query(f"WITH e AS ({X.CALLS}) SELECT " + ", ".join(f"count(*) FILTER (WHERE edge_kind = '{k}') AS {k.replace('-', '_')}" for k in graph.EDGE_KINDS) + ", count(*) AS total, count(*) FILTER (WHERE edge_kind = 'exact') / count(*)::DOUBLE AS exact_ratio FROM e")
def edge_kinds(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_kinds(X.parts(spark, d, X.CALLS))


@query(f"""WITH r AS ({X.RUNS}), g AS (SELECT language, receiver_kind, grouping(language, receiver_kind) AS g, {', '.join(f'sum({c})::BIGINT AS {c}' for c in graph.RUN_COUNTS)} FROM r GROUP BY ROLLUP (language, receiver_kind)),
m AS (SELECT *, greatest(0, attempted - resolved - external_skipped - unresolvable - no_in_project_def - core_ambiguous) AS missed FROM g)
SELECT CASE g WHEN 0 THEN 'kind' WHEN 1 THEN 'language' ELSE 'total' END AS grain, language, receiver_kind, {', '.join(graph.RUN_COUNTS)}, resolved / (resolved + missed)::DOUBLE AS edge_recall, least(1.0, (resolved + ambiguous_fanout) / (resolved + missed)::DOUBLE) AS covered_recall, resolved / greatest(1, resolved + missed)::DOUBLE AS resolve_rate FROM m""")
def resolve_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve_summary(X.frame(spark, d, X.RUNS, "nation"))


@query(f"""WITH RECURSIVE e AS ({X.WEB}), p AS (SELECT [4::BIGINT] AS path, 4::BIGINT AS node, 0 AS steps UNION ALL SELECT list_append(path, dst), dst, steps + 1 FROM p JOIN e ON src = node WHERE steps < 8 AND NOT list_contains(path, dst) AND node <> 20)
SELECT path, steps FROM p WHERE node = 20 AND steps > 0 ORDER BY steps, path LIMIT 10""")
def trace_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.paths(X.parts(spark, d, X.WEB), 4, 20)


@query("WITH l AS (SELECT url, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages) SELECT link, count(*) AS n, count(DISTINCT url) AS pages FROM l GROUP BY link ORDER BY n DESC, link LIMIT 50")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    links = X.table(spark, d, "pages").select("url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))
    return links.groupBy("link").agg(F.count("*").alias("n"), F.countDistinct("url").alias("pages")).orderBy(F.col("n").desc(), "link").limit(50)


# -- interval joins ------------------------------------------------------------


@query(f"WITH r AS ({X.RANGES}), p AS ({X.POINTS}), m AS (SELECT point_id, chunk_id, start_line, row_number() OVER (PARTITION BY point_id ORDER BY end_line - start_line, depth DESC, chunk_id) AS n FROM p JOIN r ON p.file = r.file AND line BETWEEN start_line AND end_line) SELECT point_id, chunk_id FROM m WHERE n = 1")
def interval_innermost(spark: SparkSession, d: str) -> DataFrame:
    p, r = X.frame(spark, d, X.POINTS, "lineitem"), X.frame(spark, d, X.RANGES, "lineitem")
    return intervals.innermost(p, r, "file", "line", ("start_line", "end_line"), "point_id", "depth", "chunk_id").select("point_id", "chunk_id")


@query(f"WITH r AS ({X.RANGES}), h AS ({X.HUNKS}) SELECT hunk_id, chunk_id, depth, start_line FROM h JOIN r ON h.file = r.file AND hunk_start <= end_line AND hunk_end >= start_line")
def hunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    h, r = X.frame(spark, d, X.HUNK_ROWS, "lineitem"), X.frame(spark, d, X.RANGE_ROWS, "lineitem")
    met = intervals.overlap(h, r, "file", ("hunk_start", "hunk_end"), ("start_line", "end_line"), 256, distinct=True)
    return met.select("hunk_id", "chunk_id", "depth", "start_line")


@query(f"""WITH r AS (SELECT DISTINCT file, chunk_id, min(start_line) AS start_line, max(end_line) AS end_line FROM ({X.RANGES}) q GROUP BY file, chunk_id), p AS ({X.POINTS}), n AS (SELECT r.chunk_id * 1000 + r.file AS chunk_id, author, count(*) AS n FROM p JOIN r ON p.file = r.file AND line BETWEEN start_line AND end_line GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, author) AS r, sum(n) OVER (PARTITION BY chunk_id) AS t FROM n)
SELECT chunk_id, max(CASE WHEN r = 1 THEN author END) AS blame_dominant_author, max(CASE WHEN r = 1 THEN floor(100.0 * n / t + 0.5) END)::BIGINT AS blame_dominant_author_pct, count(*) AS blame_contributor_count FROM k GROUP BY chunk_id""")
def chunk_blame(spark: SparkSession, d: str) -> DataFrame:
    r = X.frame(spark, d, X.RANGES, "lineitem").groupBy("file", "chunk_id").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    r = r.withColumn("chunk_id", F.col("chunk_id") * 1000 + F.col("file"))
    return history.chunk_blame(X.frame(spark, d, X.POINTS, "lineitem"), r).select("chunk_id", "blame_dominant_author", "blame_dominant_author_pct", "blame_contributor_count")


# -- sync ----------------------------------------------------------------------


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = X.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    new = docs.where("path % 11 > 0").select("path", F.when(F.col("path") % 7 == 0, F.sha2(F.concat("hash", F.lit("x")), 256)).otherwise(F.col("hash")).alias("hash"))
    return docs, new.unionByName(docs.where("path % 13 = 0").select((F.col("path") + 1_000_000).alias("path"), "hash"))


@query("""WITH o AS (SELECT doc_id AS path, sha256(text) AS hash FROM documents), n AS (SELECT path, CASE WHEN path % 7 = 0 THEN sha256(hash || 'x') ELSE hash END AS hash FROM o WHERE path % 11 > 0 UNION ALL SELECT path + 1000000, hash FROM o WHERE path % 13 = 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.path = n.path""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return sync.diff(*_snapshots(spark, d))


@query("""WITH o AS (SELECT doc_id AS path, sha256(text) AS hash FROM documents), n AS (SELECT path, CASE WHEN path % 5 = 0 THEN NULL WHEN path % 7 = 0 THEN 'old' ELSE hash END AS hash FROM o WHERE path % 11 > 0 UNION ALL SELECT path + 1000000, hash FROM o WHERE path % 13 = 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'orphan' ELSE 'repair' END AS action FROM o FULL JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR n.hash IS NULL OR o.hash <> n.hash""")
def extraction_repair(spark: SparkSession, d: str) -> DataFrame:
    docs = X.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    have = docs.where("path % 11 > 0").select("path", F.when(F.col("path") % 5 == 0, None).when(F.col("path") % 7 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    return sync.repair(docs, have.unionByName(docs.where("path % 13 = 0").select((F.col("path") + 1_000_000).alias("path"), "hash")))


SHARDS = [f"shard{k}" for k in range(8)]


@query("WITH ring AS (SELECT s, ('0x' || substr(md5('shard' || s || ':' || v), 1, 8))::BIGINT AS pos FROM range(8) a(s), range(150) b(v)), k AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT AS k FROM documents), f AS (SELECT doc_id, coalesce((SELECT min(pos) FROM ring WHERE pos >= k), (SELECT min(pos) FROM ring)) AS pos FROM k) SELECT doc_id, 'shard' || min(s) AS shard FROM f JOIN ring USING (pos) GROUP BY doc_id")
def ring_shards(spark: SparkSession, d: str) -> DataFrame:
    ids = X.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("k"))
    return ids.select("doc_id", sync.shard("k", SHARDS).alias("shard"))


@query()
def merkle_root(spark: SparkSession, d: str) -> DataFrame:
    docs = X.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"))
    return spark.createDataFrame([(sync.merkle_root(docs),)], "root string")


# -- texts, symbols, segments --------------------------------------------------


@query(f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct FROM (SELECT doc_id, {TOKENS.format(t='text')} AS t FROM documents) x")
def code_tokens(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").select("doc_id", S.code_tokens("text").alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"SELECT p_partkey, {FNV.format(t='p_name')}::INT AS bucket FROM part")
def feature_hash(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "part").select("p_partkey", S.feature_hash("p_name").alias("bucket"))


@query("SELECT doc_id, 'chunk_' || substr(sha256(source || ':' || doc_id || ':' || n_chars || ':' || lang || ':' || text), 1, 16) AS chunk_id FROM documents")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").select("doc_id", S.chunk_id("source", "doc_id", "n_chars", "lang", "text").alias("chunk_id"))


def _symbol_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = X.chunks(spark, d)
    return c.select(F.col("id").alias("chunk_id"), F.col("relativePath").alias("relative_path"), F.col("symbolId").alias("symbol_id"), F.col("parentSymbolId").alias("parent_symbol_id"), F.col("startLine").alias("start_line"), F.col("endLine").alias("end_line"), F.col("chunkIndex").alias("chunk_index"), F.col("chunkType").alias("chunk_type"), F.col("contentSize").alias("content_size"))


@query(f"WITH c AS ({X.CHUNKS}) SELECT id AS chunk_id, lag(symbolId) OVER w AS previous_symbol, lead(symbolId) OVER w AS next_symbol FROM c WINDOW w AS (PARTITION BY relativePath ORDER BY id)")
def chunk_navigation(spark: SparkSession, d: str) -> DataFrame:
    return symbols.navigation(_symbol_chunks(spark, d), order="chunk_id").select("chunk_id", "previous_symbol", "next_symbol")


@query(f"WITH c AS ({X.CHUNKS}), n AS (SELECT id, symbolId, row_number() OVER (PARTITION BY relativePath, symbolId ORDER BY id) AS n FROM c) SELECT id AS chunk_id, CASE WHEN n = 1 THEN symbolId ELSE symbolId || '~' || n END AS symbol_id FROM n")
def symbol_disambiguation(spark: SparkSession, d: str) -> DataFrame:
    return symbols.disambiguated(_symbol_chunks(spark, d), order="chunk_id").select("chunk_id", "symbol_id")


@query(f"WITH c AS ({X.CHUNKS}) SELECT id AS chunk_id, symbolId AS symbol_id FROM c WHERE string_split_regex(symbolId, '::|[#.]')[-1] = 'm7' OR parentSymbolId = 'm7' ORDER BY CASE WHEN lower(symbolId) = 'c3#m7' THEN 0 ELSE 1 END, relativePath, startLine, id LIMIT 200")
def find_symbol(spark: SparkSession, d: str) -> DataFrame:
    return symbols.find(_symbol_chunks(spark, d), "C3#m7").select("chunk_id", "symbol_id")


@query(f"WITH c AS ({X.CHUNKS}) SELECT relativePath AS relative_path, parentSymbolId AS symbol_id, sum(contentSize)::BIGINT AS content_size, count(*) AS chunk_count FROM c WHERE parentSymbolId IS NOT NULL GROUP BY ALL")
def class_outlines(spark: SparkSession, d: str) -> DataFrame:
    return symbols.class_outline(_symbol_chunks(spark, d)).select("relative_path", "symbol_id", "content_size", "chunk_count")


@query(f"WITH c AS ({X.CHUNKS}), m AS (SELECT relativePath, parentSymbolId AS container, count(DISTINCT symbolId) AS member_count FROM c WHERE parentSymbolId IS NOT NULL GROUP BY ALL), f AS (SELECT relativePath, count(DISTINCT CASE WHEN chunkType = 'function' THEN symbolId END) AS module_method_count, max(endLine) AS module_lines FROM c GROUP BY ALL) SELECT relativePath AS relative_path, container AS container_id, member_count, module_method_count, module_lines FROM m JOIN f USING (relativePath)")
def symbol_mass(spark: SparkSession, d: str) -> DataFrame:
    c = _symbol_chunks(spark, d)
    return symbols.symbol_mass(c, c.where("parent_symbol_id IS NOT NULL").select("relative_path", F.col("parent_symbol_id").alias("container_id")).distinct())


_CAND = "SELECT l_orderkey AS call_id, l_partkey AS target, l_linenumber % 3 AS n_args, l_suppkey % 2 AS min_args, l_suppkey % 4 AS max_args, l_suppkey % 10 = 0 AS splat, CASE WHEN l_partkey % 9 = 0 THEN 'private' ELSE 'public' END AS visibility, l_orderkey % 2 = 0 AS has_block, l_partkey % 4 = 0 AS accepts_block FROM lineitem"


@query(f"""WITH c AS ({_CAND}), f AS (SELECT * FROM c WHERE n_args >= min_args AND (splat OR n_args <= max_args) AND visibility <> 'private'), b AS (SELECT *, max(accepts_block::INT) OVER (PARTITION BY call_id) AS any_block FROM f), k AS (SELECT * FROM b WHERE NOT (has_block AND any_block = 1) OR accepts_block),
n AS (SELECT *, count(*) OVER (PARTITION BY call_id) AS n FROM k) SELECT call_id, target, n AS n_candidates, CASE WHEN n = 1 THEN 1.0 WHEN n > 3 THEN NULL ELSE 0.9 / n END AS confidence, n > 3 AS ambiguous FROM n""")
def narrowed_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of calls narrowed by arity, visibility and block, then fanned out."""
    c = X.frame(spark, d, _CAND, "lineitem")
    return dispatch.fan_out(dispatch.narrowed(c), 3, 0.9).select("call_id", "target", "n_candidates", "confidence", "ambiguous")


_CALLS2 = "SELECT DISTINCT p_partkey AS call_id, 'T' || CAST(p_partkey % 20 AS STRING) AS receiver_type, 'm' || CAST(p_partkey % 7 AS STRING) AS member FROM part"


@query(f"""WITH c AS ({_CALLS2}), {_TYPES}, s AS (SELECT DISTINCT symbol_id FROM ({X.SYMBOLS}) x), o AS (SELECT call_id, source_fq_name || '#' || member AS target FROM c JOIN t ON ancestor_fq_name = receiver_type WHERE source_fq_name || '#' || member IN (SELECT symbol_id FROM s)),
n AS (SELECT *, count(*) OVER (PARTITION BY call_id) AS n FROM o) SELECT call_id, target, 'cone' AS edge_kind, 1.0 / n AS confidence FROM n WHERE n <= 1 UNION ALL SELECT call_id, receiver_type || '#' || member, 'poly-base', 1.0 FROM c WHERE call_id NOT IN (SELECT call_id FROM n WHERE n <= 1)""")
def cone_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return dispatch.cone(X.parts(spark, d, _CALLS2), X.parts(spark, d, X.TYPES), X.parts(spark, d, X.SYMBOLS), cone_max=1)


_VERDICTS = "SELECT l_orderkey AS call_id, l_linenumber AS priority, CASE (l_partkey + l_linenumber) % 7 WHEN 0 THEN 'resolved' WHEN 1 THEN 'drop' WHEN 2 THEN 'deferred' ELSE 'continue' END AS verdict, l_partkey AS target FROM lineitem"


@query(f"""WITH v AS (SELECT DISTINCT * FROM ({_VERDICTS}) x), s AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY priority, verdict, target) AS n FROM v WHERE verdict IN ('resolved', 'drop')),
k AS (SELECT v.call_id, target, priority, row_number() OVER (PARTITION BY v.call_id ORDER BY priority, target) AS n FROM v WHERE verdict = 'deferred'), c AS (SELECT DISTINCT call_id FROM v),
j AS (SELECT c.call_id, s.verdict, s.target, k.target AS parked, k.call_id IS NOT NULL AND (s.priority IS NULL OR k.priority < s.priority) AS early FROM c LEFT JOIN s ON s.call_id = c.call_id AND s.n = 1 LEFT JOIN k ON k.call_id = c.call_id AND k.n = 1)
SELECT call_id, CASE WHEN verdict = 'resolved' OR early THEN 'resolved' WHEN verdict = 'drop' THEN 'dropped' ELSE 'unresolved' END AS outcome, CASE WHEN verdict = 'resolved' THEN target WHEN early THEN parked END AS target FROM j""")
def resolver_chain(spark: SparkSession, d: str) -> DataFrame:
    return dispatch.first_verdict(X.frame(spark, d, _VERDICTS, "lineitem"))


@query("WITH n AS (SELECT count(*) AS n FROM part GROUP BY p_name), s AS (SELECT list_sort(list(n)) AS v FROM n) SELECT greatest(16, v[least(floor(len(v) * 0.99)::BIGINT, len(v) - 1) + 1])::INT AS cap FROM s")
def fan_out_cap(spark: SparkSession, d: str) -> DataFrame:
    return dispatch.fan_out_cap(X.table(spark, d, "part").select(F.col("p_name").alias("short_name")))


@query()
def character_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All documents cut into chunks (their borders and sizes are tested by property)."""
    files = X.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(None).cast("string").alias("language"), "text")
    return segment.chunks(files).select("path", "chunk_index", "start_line", "end_line", F.length("content").alias("n_chars"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily_windows(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.incremental import windowed_counts

    out = windowed_counts(X.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def sql_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Spark SQL over the same tables: the engine's collections are plain tables."""
    X.register(spark, d, "lineitem")
    return spark.sql("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus")


# -- call resolution ---------------------------------------------------------------


def _resolve_query(language: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = resolution.chain(resolution_fixture.facts(spark, d, language), language)
        return found.withColumnRenamed("by", "strategy")

    run.__name__ = f"resolve_{language}"
    run.__doc__ = f"Every call's verdict by the {language} chain, and the strategy that gave it."
    query(resolution_fixture.sql(language))(run)


for _language in resolution_fixture.EXTENSION:
    _resolve_query(_language)


@query(ruby_fixture.sql())
def resolve_ruby(spark: SparkSession, d: str) -> DataFrame:
    """Every call's verdict by Ruby's chain of fifteen strategies, and the strategy that gave it."""
    return resolution.chain(ruby_fixture.facts(spark, d), "ruby").withColumnRenamed("by", "strategy")


@query(macro_fixture.DECLARED)
def macro_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Methods that the macros of all frameworks declare."""
    return macros.declared(macro_fixture.calls(spark, d), macros.rules(spark))


@query(macro_fixture.LINKED)
def macro_links(spark: SparkSession, d: str) -> DataFrame:
    """What macros refer to: own methods, models, aliases, delegates, actions, policies, subjects."""
    return macros.linked(macro_fixture.calls(spark, d), macros.rules(spark))


@query(ruby_fixture.fan_out_sql())
def ruby_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Calls that Ruby's chain leaves open: the gate that holds each back, or its candidates, or that it has too many."""
    t = ruby_fixture.facts(spark, d).settled()
    c = t.of("ruby")
    open_ = written(c.join(resolution.chain(t, "ruby").where("outcome = 'resolved'").select("call_id"), "call_id", "left_anti"), "open-calls")
    none = F.lit(None)
    held = resolution.gates(t, open_).select("call_id", "gate", none.cast("bigint").alias("n_candidates"), none.cast("string").alias("target"), none.cast("double").alias("confidence"))
    wide = resolution.dynamic(t, open_)
    return held.unionByName(wide.select("call_id", none.cast("string").alias("gate"), F.when(~F.col("ambiguous"), F.when(F.col("edge_kind") == "exact", 1).otherwise(F.round(resolution.DYNAMIC_DISCOUNT / F.col("confidence")))).cast("bigint").alias("n_candidates"), "target", "confidence"))


@query(folding_fixture.sql())
def folded_types(spark: SparkSession, d: str) -> DataFrame:
    """Calls that mean something once their receivers, which are parameters, are typed by the calls of their functions."""
    t, targets, arguments, parameters = folding_fixture.facts(spark, d)
    made = resolution.folded(t, targets, arguments, parameters)
    on = t.calls.select("call_id", F.col("source_symbol_id").alias("function"), F.col("receiver").alias("name"))
    gained = made["edges"].join(on.hint("merge"), "call_id").join(made["types"].hint("merge"), ["function", "name"])
    n = made["evidence"].agg(F.count("*").alias("evidence"))  # one row
    return gained.select("call_id", "target", "function", "position", "type").crossJoin(F.broadcast(n))


_SOURCE = """SELECT 'pkg/t' || CAST(k AS STRING) || '.py' AS path, 'python' AS language, concat(CASE WHEN k > 1 THEN concat('from pkg.t', CAST(j AS STRING), ' import T', CAST(j AS STRING), chr(10)) ELSE '' END, 'class T', CAST(k AS STRING), CASE WHEN k > 1 THEN concat('(T', CAST(j AS STRING), ')') ELSE '' END, ':', chr(10),
'    def m', CAST(k % 5 AS STRING), '(self):', chr(10), '        self.m', CAST((k + 1) % 5 AS STRING), '()', chr(10), '        x = T', CAST(j AS STRING), '()', chr(10), '        x.m', CAST(j % 5 AS STRING), '(1, 2)', chr(10), '        super().m', CAST((k + 2) % 5 AS STRING), '()', chr(10), '        print(x)', chr(10)) AS text
FROM (SELECT DISTINCT p_partkey % 64 AS k, CAST(floor(p_partkey % 64 / 2) AS BIGINT) AS j FROM part WHERE p_partkey % 64 > 0) t"""


@query("""WITH RECURSIVE t AS (SELECT DISTINCT p_partkey % 64 AS k, (p_partkey % 64) // 2 AS j FROM part WHERE p_partkey % 64 > 0), a AS (SELECT k, k AS up, 0 AS d FROM t UNION ALL SELECT k, up // 2, d + 1 FROM a WHERE up // 2 > 0),
q AS (SELECT k, 'self.m' || ((k + 1) % 5) AS call, (k + 1) % 5 AS m, 0 AS least FROM t UNION ALL SELECT k, 'super().m' || ((k + 2) % 5), (k + 2) % 5, 1 FROM t),
r AS (SELECT q.k, q.call, up, m, row_number() OVER (PARTITION BY q.k, q.call ORDER BY d) AS n FROM q JOIN a ON a.k = q.k AND a.d >= q.least AND up % 5 = m)
SELECT 'T' || k || '#m' || (k % 5) AS source_symbol_id, call AS call_expression, 'T' || up || '#m' || m AS target_symbol_id, 'pkg/t' || up || '.py' AS target_rel_path FROM r WHERE n = 1
UNION ALL SELECT 'T' || k || '#m' || (k % 5), 'x.m' || (j % 5), 'T' || j || '#m' || (j % 5), 'pkg/t' || j || '.py' FROM t WHERE j > 0
UNION ALL SELECT 'T' || k || '#m' || (k % 5), 'T' || j, 'T' || j, 'pkg/t' || j || '.py' FROM t WHERE j > 0""")
def python_source_calls(spark: SparkSession, d: str) -> DataFrame:
    """From source files to the edges of their calls: walked by the parser, resolved by the chain."""
    found = walkers.facts(walkers.walk(X.frame(spark, d, _SOURCE, "part")))
    edges = resolution.chain(found, "python").where("target IS NOT NULL").join(found.calls, "call_id")
    return edges.select("source_symbol_id", F.concat_ws(".", "receiver", "member").alias("call_expression"), F.col("target").alias("target_symbol_id"), F.col("file").alias("target_rel_path"))


@query("""WITH t AS (SELECT DISTINCT p_partkey % 64 AS k FROM part WHERE p_partkey % 64 > 0) SELECT 'python' AS language, receiver_kind, count(*) AS attempted, count(*) FILTER (WHERE outcome = 'resolved') AS resolved, count(*) FILTER (WHERE outcome = 'no_in_project_def') AS no_in_project_def FROM (
WITH RECURSIVE a AS (SELECT k, k AS up, 0 AS d FROM t UNION ALL SELECT k, up // 2, d + 1 FROM a WHERE up // 2 > 0)
SELECT 'selfMember' AS receiver_kind, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.k = t.k AND up % 5 = (t.k + 1) % 5) THEN 'resolved' ELSE 'missed' END AS outcome FROM t
UNION ALL SELECT 'super', CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.k = t.k AND d > 0 AND up % 5 = (t.k + 2) % 5) THEN 'resolved' ELSE 'missed' END FROM t
UNION ALL SELECT 'localVar', CASE WHEN k > 1 THEN 'resolved' ELSE 'missed' END FROM t UNION ALL SELECT 'bareCall', CASE WHEN k > 1 THEN 'resolved' ELSE 'no_in_project_def' END FROM t UNION ALL SELECT 'bareCall', 'no_in_project_def' FROM t UNION ALL SELECT 'bareCall', 'no_in_project_def' FROM t) x GROUP BY receiver_kind""")
def python_run_statistics(spark: SparkSession, d: str) -> DataFrame:
    """From source files to the statistics of the run."""
    found = walkers.facts(walkers.walk(X.frame(spark, d, _SOURCE, "part")))
    out = resolution.statistics(resolution.resolve(found, "python")["outcomes"])
    return out.select("language", "receiver_kind", "attempted", "resolved", "no_in_project_def")


# -- enrichment --------------------------------------------------------------------


@query(f"""WITH {_ALL}, m AS ({_metrics_sql('a')}), c AS (SELECT doc_id, (doc_id % 120)::VARCHAR AS path FROM documents)
SELECT doc_id AS id, commit_count AS "git_file_commitCount", bug_fix_rate AS "git_file_bugFixRate", commit_count IS NULL AS "git_file_missing" FROM c LEFT JOIN m ON m.file = c.path""")
def enrichment_join(spark: SparkSession, d: str) -> DataFrame:
    """History metrics of files joined onto all chunks of each."""
    c = X.table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 120).cast("string").alias("path"))
    made = history.file_metrics(commits(spark, d).withColumn("added", F.floor("churn")).withColumn("deleted", F.floor(F.col("churn") / 3)), X.AS_OF)
    out = enrichment.overlays(c, made, now=1, path="path")
    return out.select("id", "git_file_commitCount", "git_file_bugFixRate", "git_file_missing")


@query(f"""WITH {_ALL}, m AS ({_metrics_sql('a')}), c AS (SELECT doc_id, (doc_id % 120)::VARCHAR AS path FROM documents), e AS (SELECT doc_id, coalesce(commit_count, 0)::DOUBLE AS n, coalesce(bug_fix_rate, 0)::DOUBLE AS f, commit_count AS raw, bug_fix_rate AS rawf FROM c LEFT JOIN m ON m.file = c.path),
b AS (SELECT greatest(coalesce(list_sort(list(raw) FILTER (WHERE raw > 0))[least(floor(count(raw) FILTER (WHERE raw > 0) * 0.95)::BIGINT, count(raw) FILTER (WHERE raw > 0) - 1) + 1], 1), {DERIVED['churn'].bound}) AS p FROM e)
SELECT doc_id AS id, round(least(1.0, n / p), 6) AS rank_score FROM e, b ORDER BY rank_score DESC, doc_id LIMIT 20""")
def enriched_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Index, enrich, rank: chunks by the churn that enrichment has joined."""
    c = X.table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 120).cast("string").alias("path"))
    made = history.file_metrics(commits(spark, d).withColumn("added", F.floor("churn")).withColumn("deleted", F.floor(F.col("churn") / 3)), X.AS_OF)
    out = rank.score(enrichment.overlays(c, made, now=1, path="path").withColumn("score", F.lit(0.0)), {"custom": {"churn": 1.0}})
    return rank.top(out.withColumn("rank_score", F.round("rank_score", 6)), 20, "id").select("id", "rank_score")


@query(f"""WITH c AS ({X.CHUNKS}), k AS (SELECT relativePath AS rel_path, symbolId AS symbol_id, max(startLine * 1000000 + id) % 1000000 AS chunk_id FROM c GROUP BY ALL), s AS (SELECT DISTINCT relativePath AS rel_path, 'C' || (id % 97) || '#m' || (id % 31) AS symbol_id FROM c)
SELECT s.rel_path, s.symbol_id, k.chunk_id::BIGINT AS chunk_id FROM s LEFT JOIN k USING (rel_path, symbol_id)""")
def symbol_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Symbols with the chunk that holds each; of several the last one counts."""
    c = X.chunks(spark, d)
    wanted = c.select(F.col("relativePath").alias("rel_path"), F.concat(F.lit("C"), F.col("id") % 97, F.lit("#m"), F.col("id") % 31).alias("symbol_id")).distinct()
    have = c.select(F.col("relativePath").alias("rel_path"), F.col("id").alias("chunk_id"), F.col("symbolId").alias("symbol_id"), F.col("startLine").alias("start_line"), F.col("endLine").alias("end_line"))
    return enrichment.attach_chunks(wanted, have)


@query(f"WITH c AS ({X.CHUNKS}), a AS (SELECT id, 'hub' AS list FROM c WHERE codegraph_file_isHub), b AS (SELECT id, 'leaf' AS list FROM c WHERE codegraph_file_isLeaf OR id % 5 = 0) SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)")
def merged_scroll(spark: SparkSession, d: str) -> DataFrame:
    """Two scrolls as one; a chunk that both hold is the first one's."""
    c = X.chunks(spark, d)
    return enrichment.merged([c.where("codegraph_file_isHub").select("id", F.lit("hub").alias("list")), c.where("codegraph_file_isLeaf OR id % 5 = 0").select("id", F.lit("leaf").alias("list"))])


@query(f"""WITH c AS ({X.CHUNKS}) SELECT id, map_from_entries(list_filter([('commitCount', git_file_commitCount::VARCHAR), ('blameDominantAuthor', git_file_blameDominantAuthor)], lambda x: x[2] IS NOT NULL))::VARCHAR AS file, CASE WHEN git_chunk_commitCount IS NULL THEN '{{}}' ELSE '{{commitCount=' || git_chunk_commitCount || '}}' END AS chunk FROM c""")
def overlay_mask(spark: SparkSession, d: str) -> DataFrame:
    """Raw values behind a result, by a mask of fields per level."""
    out = enrichment.overlay(X.chunks(spark, d), {"file": ["commitCount", "blameDominantAuthor"], "chunk": ["commitCount"]})
    shown = lambda c: F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "), F.lit("}"))
    return out.select("id", shown("overlay.file").alias("file"), shown("overlay.chunk").alias("chunk"))


def _adaptive_sql() -> str:
    made = {c.key: c.key.replace(".", "_") for cs in catalog.FILTER_PRESETS.values() for c in cs if c.percentile is not None}
    known = ", ".join(f"round(quantile_cont({col}, {p / 100}) FILTER (WHERE {col} > 0), 6) AS t{p}_{col}" for key, col in made.items() for p in sorted({c.percentile for cs in catalog.FILTER_PRESETS.values() for c in cs if c.key == key and c.percentile is not None}))
    parts = []
    for name, cs in catalog.FILTER_PRESETS.items():
        if any(c.percentile is not None for c in cs):
            one = lambda c: f"coalesce({c.key.replace('.', '_')} {'>=' if c.op == 'gte' else '<='} {('t%d_%s' % (c.percentile, made[c.key])) if c.percentile is not None else c.value}, false)"
            must, should = [one(c) for c in cs if c.kind == "must"], [one(c) for c in cs if c.kind == "should"]
            parts.append(f"SELECT '{name}' AS preset, count(*) AS n, coalesce(sum(id), 0)::BIGINT AS ids FROM c, q WHERE " + " AND ".join([*must, *([f"({' OR '.join(should)})"] if should else [])]))
    return f"WITH c AS ({X.CHUNKS}), q AS (SELECT {known} FROM c) " + " UNION ALL ".join(parts)


@query(_adaptive_sql())
def filter_presets_adaptive(spark: SparkSession, d: str) -> DataFrame:
    """Filter presets whose thresholds are the collection's own percentiles."""
    c = X.chunks(spark, d)
    names = [k for k, cs in catalog.FILTER_PRESETS.items() if any(x.percentile is not None for x in cs)]
    keys = sorted({x.key for k in names for x in catalog.FILTER_PRESETS[k] if x.percentile is not None})
    known = stats.as_mapping(stats.signal_percentiles(c.withColumn("scope", stats.scope(c)), keys))
    one = c.select(*[F.when(filters.preset(c, k, known), F.col("id")).alias(k) for k in names]).agg(*[F.struct(F.lit(k).alias("preset"), F.count(k).alias("n"), F.coalesce(F.sum(k), F.lit(0)).alias("ids")).alias(k) for k in names])
    return one.select(F.explode(F.array(*names)).alias("r")).select("r.preset", "r.n", "r.ids")


# -- outlines, chunk metrics, paths, sync ---------------------------------------------


@query(f"WITH c AS ({X.CHUNKS}), l AS (SELECT relativePath, startLine, id, (CASE WHEN parentSymbolId IS NULL THEN '' ELSE '  ' END) || symbolId AS line FROM c), f AS (SELECT relativePath, line, min(startLine * 10000000 + id) AS pos FROM l GROUP BY ALL) SELECT relativePath AS relative_path, array_to_string(list(line ORDER BY pos), chr(10)) AS outline FROM f GROUP BY 1")
def file_outlines(spark: SparkSession, d: str) -> DataFrame:
    return symbols.file_outline(_symbol_chunks(spark, d))


@query(f"""WITH c AS ({X.CHUNKS}), h AS (SELECT relativePath, startLine, id, 1 AS depth, heading1 AS text FROM c WHERE heading1 IS NOT NULL UNION ALL SELECT relativePath, startLine, id, 2, heading2 FROM c WHERE heading2 IS NOT NULL),
f AS (SELECT relativePath, depth, text, min((startLine * 10000000 + id) * 10 + depth) AS pos FROM h GROUP BY ALL) SELECT relativePath AS relative_path, array_to_string(list(repeat('  ', depth - 1) || text ORDER BY pos), chr(10)) AS toc FROM f GROUP BY 1""")
def document_contents(spark: SparkSession, d: str) -> DataFrame:
    """Tables of contents of all files by the first place of each heading."""
    c = X.chunks(spark, d).select(F.col("relativePath").alias("relative_path"), F.col("startLine").alias("start_line"), F.col("id").alias("chunk_id"), F.col("headingPath").alias("heading_path"))
    return symbols.doc_toc(c).select("relative_path", "toc")


_TOUCH = f"SELECT file AS path, file || ':' || CAST(event_id % 3 AS STRING) AS chunk_id, CAST(event_id AS STRING) AS id, author, ts, churn, is_fix FROM (SELECT *, id AS event_id, {_FIX} AS is_fix FROM ({COMMITS_SQL}) x) y"


@query(f"""WITH a AS ({_TOUCH}), u AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY chunk_id ORDER BY ts, id)) / 86400.0 AS gap FROM a), f AS (SELECT path, count(*) AS n FROM a GROUP BY path)
SELECT chunk_id, count(*) AS commit_count, floor(count(*) / max(f.n)::DOUBLE * 100 + 0.5) / 100 AS churn_ratio, floor(({X.AS_OF} - max(ts)) / 86400)::BIGINT AS age_days, floor(100 * avg(is_fix::INT) + 0.5)::BIGINT AS bug_fix_rate,
floor(sum(exp(-0.1 * ({X.AS_OF} - ts) / 86400.0)) * 100 + 0.5) / 100 AS recency_weighted_freq, floor(coalesce(stddev_pop(gap), 0.0) * 100 + 0.5) / 100 AS churn_volatility FROM u JOIN f USING (path) GROUP BY chunk_id""")
def chunk_churn_metrics(spark: SparkSession, d: str) -> DataFrame:
    """History metrics of chunks from the commits that touched them."""
    return _chunk_metrics(spark, d)


def _chunk_metrics(spark: SparkSession, d: str, squash: bool = False) -> DataFrame:
    c = commits(spark, d)
    touched = c.select(F.concat_ws(":", "file", (F.col("id") % 3).cast("string")).alias("chunk_id"), F.col("id").cast("string").alias("id"), "author", "ts", F.lit(1).alias("added"), F.lit(0).alias("deleted"), "is_fix", F.col("file").alias("_file"))
    chunks = touched.select("chunk_id", F.col("_file").alias("file"), F.lit(10).alias("lines")).distinct()
    files = c.groupBy("file").agg(F.count("*").alias("commit_count"), F.countDistinct("author").alias("contributors"))
    made = history.chunk_metrics(touched.drop("_file"), chunks, files, X.AS_OF, squash, 1440)
    return made.select("chunk_id", "commit_count", "churn_ratio", "age_days", "bug_fix_rate", "recency_weighted_freq", "churn_volatility")


@query(f"""WITH RECURSIVE e AS ({X.WEB}), p AS (SELECT [11::BIGINT] AS path, 11::BIGINT AS node, 0 AS steps UNION ALL SELECT list_append(path, dst), dst, steps + 1 FROM p JOIN e ON src = node WHERE steps < 8 AND NOT list_contains(path, dst) AND node <> 20),
f AS (SELECT path FROM p WHERE node = 20 AND steps > 0 ORDER BY steps, path LIMIT 10) SELECT path, list_max(list_transform(path, lambda x: (x * 7 % 13)::DOUBLE)) AS danger FROM f""")
def path_danger(spark: SparkSession, d: str) -> DataFrame:
    """Paths with the score of their worst step."""
    e = X.parts(spark, d, X.WEB)
    scored = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("rank_score", (F.col("node") * 7 % 13).cast("double"))
    return graph.danger(graph.paths(e, 11, 20), scored).select("path", "danger")


@query(f"WITH e AS ({X.CALLS}) SELECT source_rel_path, source_symbol_id, call_expression, member FROM (SELECT *, split_part(target_symbol_id, '#', 2) AS member FROM e) x WHERE member = 'm1' AND edge_kind = 'dynamic' ORDER BY source_rel_path, source_symbol_id, call_expression LIMIT 50")
def ambiguous_callers(spark: SparkSession, d: str) -> DataFrame:
    """Calls that may mean a member, of which there are several."""
    wide = X.parts(spark, d, X.CALLS).where("edge_kind = 'dynamic'").withColumn("member", F.split("target_symbol_id", "#")[1])
    return graph.ambiguous_callers(wide, "m1").select("source_rel_path", "source_symbol_id", "call_expression", "member")


_IMPORTS = f"SELECT DISTINCT 'src/t' || CAST(p_partkey % kk AS STRING) || '.py' AS src, 'pkg.t' || CAST((p_partkey * 3 + 1) % (kk + 16) AS STRING) AS import_text, p_partkey AS position FROM part, {X.NAMES}"


@query(f"WITH i AS ({_IMPORTS}), f AS (SELECT DISTINCT rel_path FROM ({X.SYMBOLS}) s), m AS (SELECT src, rel_path AS dst, import_text, row_number() OVER (PARTITION BY src, rel_path ORDER BY position) AS n FROM i JOIN f ON 'src/' || split_part(import_text, '.', 2) || '.py' = rel_path WHERE src <> rel_path) SELECT src, dst, import_text FROM m WHERE n = 1")
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    """File edges from the last part of each import."""
    return dispatch.import_edges(X.parts(spark, d, _IMPORTS), X.parts(spark, d, X.SYMBOLS).select("rel_path").distinct())


@query("""SELECT 'retry' AS kind, doc_id FROM documents WHERE doc_id % 4 = 0 AND (doc_id % 3 = 0 OR doc_id <= 300) UNION ALL SELECT 'unenriched', doc_id FROM documents WHERE doc_id % 6 = 5
UNION ALL SELECT CASE WHEN doc_id % 2 = 0 THEN 'newly_ignored' ELSE 'newly_unignored' END, doc_id FROM documents WHERE doc_id % 7 = 0""")
def sync_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Files to try again, chunks that enrichment has missed, and changes that ignore rules have made."""
    docs = X.table(spark, d, "documents").select(F.col("doc_id").alias("path"))
    again = sync.retry(docs.where("path % 4 = 0").withColumn("next_retry", F.col("path")), docs.where("path % 3 = 0"), 300)
    missed = sync.unenriched(docs.withColumn("mark", F.when(F.col("path") % 6 != 5, 1)), "mark")
    changes = docs.withColumn("change", F.when(F.col("path") % 2 == 0, "deleted").otherwise("added"))
    seven = F.col("path") % 7 == 0
    moved = sync.ignore_changes(changes, seven & (F.col("change") == "added"), seven & (F.col("change") == "deleted")).where(F.col("change").startswith("newly"))
    one = lambda df, kind: df.select(kind.alias("kind"), F.col("path").alias("doc_id"))
    return one(again, F.lit("retry")).unionByName(one(missed, F.lit("unenriched"))).unionByName(one(moved, F.col("change")))


@query(f"WITH c AS ({X.CHUNKS}) SELECT id, CASE WHEN contentSize > 0 AND endLine >= startLine THEN floor(contentSize / (endLine - startLine + 1)::DOUBLE * least(1.0, (endLine - startLine + 1) / greatest(2.0, ceil(sqrt(methodLines)))) + 0.5) ELSE 0 END::BIGINT AS density FROM c")
def method_densities(spark: SparkSession, d: str) -> DataFrame:
    c = X.chunks(spark, d).withColumn("lines", F.col("endLine") - F.col("startLine") + 1)
    return c.select("id", S.method_density("contentSize", "lines", "methodLines").cast("bigint").alias("density"))


# -- state over time -------------------------------------------------------------

_STEP = """list_reduce(h, lambda a, x: struct_pack(
  s := CASE WHEN x.fin THEN greatest({s}, 1) ELSE {s} END, e := CASE WHEN x.fin THEN greatest({e}, greatest({s}, 1)) ELSE {e} END,
  s0 := CASE WHEN x.fin THEN greatest({s}, 1) ELSE a.s0 END, e0 := CASE WHEN x.fin THEN greatest({e}, greatest({s}, 1)) ELSE a.e0 END,
  n := a.n + {hit}::BIGINT, commits := a.commits + ({hit} AND a.last IS DISTINCT FROM x.id)::BIGINT, last := CASE WHEN {hit} THEN x.id ELSE a.last END,
  added := a.added + CASE WHEN {hit} THEN {lines} ELSE 0 END, deleted := a.deleted + CASE WHEN {hit} AND x.new > 0 THEN floor(x.old * {lines} / x.new::DOUBLE + 0.5)::BIGINT ELSE 0 END,
  fixes := a.fixes + ({hit} AND x.is_fix)::BIGINT), struct_pack(s := start_line, e := end_line, s0 := start_line, e0 := end_line, n := 0::BIGINT, commits := 0::BIGINT, last := NULL::BIGINT, added := 0::BIGINT, deleted := 0::BIGINT, fixes := 0::BIGINT))"""
_BELOW, _INSIDE = "(a.s > x.stop)", "(x.start >= a.s AND x.stop <= a.e)"
_STEP = _STEP.format(
    s=f"(CASE WHEN {_BELOW} THEN a.s - x.new + x.old ELSE a.s END)", e=f"(CASE WHEN {_BELOW} OR {_INSIDE} THEN a.e - x.new + x.old ELSE a.e END)",
    hit="(x.start <= a.e0 AND x.stop >= a.s0)", lines="(least(x.stop, a.e0) - greatest(x.start, a.s0) + 1)",
)


@query(f"""WITH h AS ({X.CHANGES}), o AS (SELECT *, row_number() OVER (PARTITION BY file, ts, id ORDER BY new_start, old_start DESC, new_lines DESC, old_lines DESC) = 1 AS fin FROM h),
l AS (SELECT file, list(struct_pack(id := id, start := new_start, stop := new_start + greatest(new_lines - 1, 0), new := new_lines, old := old_lines, is_fix := is_fix, fin := fin) ORDER BY ts DESC, id, new_start DESC, old_start, new_lines, old_lines) AS h FROM o GROUP BY file),
w AS (SELECT file, chunk_id, {_STEP} AS r FROM ({X.SPANS}) s JOIN l USING (file))
SELECT file, chunk_id, r.n AS touches, r.commits AS commits, r.added AS lines_added, r.deleted AS lines_deleted, r.fixes AS fixes FROM w WHERE r.n > 0""")
def commit_walk(spark: SparkSession, d: str) -> DataFrame:
    """Touches of all chunks, walked back through all commits of their files; the busiest file in several stretches."""
    hunks, spans = X.frame(spark, d, X.CHANGES, "lineitem"), X.frame(spark, d, X.SPANS, "lineitem")
    met = history.walk_hunks(hunks.withColumn("file", F.col("file").cast("string")), spans.withColumn("file", F.col("file").cast("string")), block=20_000)
    sums = met.groupBy("file", "chunk_id").agg(F.count("*").alias("touches"), F.countDistinct("id").alias("commits"), F.sum("added").alias("lines_added"), F.sum("deleted").alias("lines_deleted"), F.sum(F.col("is_fix").cast("bigint")).alias("fixes"))
    return sums.select(F.col("file").cast("bigint").alias("file"), F.col("chunk_id").cast("bigint").alias("chunk_id"), "touches", "commits", "lines_added", "lines_deleted", "fixes")


@query(f"""WITH t AS ({_TOUCH}), c AS (SELECT *, ts AS at FROM t), g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= 86400 THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY chunk_id, author ORDER BY ts, id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY chunk_id, author ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS session FROM g), z AS (SELECT any_value(path) AS path, chunk_id, author || '#' || session AS id, max(ts) AS ts, bool_or(is_fix) AS is_fix FROM s GROUP BY chunk_id, author, session),
u AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY chunk_id ORDER BY ts, id)) / 86400.0 AS gap FROM z), f AS (SELECT path, count(*) AS n FROM t GROUP BY path)
SELECT chunk_id, count(*) AS commit_count, floor(count(*) / max(f.n)::DOUBLE * 100 + 0.5) / 100 AS churn_ratio, floor(({X.AS_OF} - max(ts)) / 86400)::BIGINT AS age_days, floor(100 * avg(is_fix::INT) + 0.5)::BIGINT AS bug_fix_rate,
floor(sum(exp(-0.1 * ({X.AS_OF} - ts) / 86400.0)) * 100 + 0.5) / 100 AS recency_weighted_freq, floor(coalesce(stddev_pop(gap), 0.0) * 100 + 0.5) / 100 AS churn_volatility FROM u JOIN f USING (path) GROUP BY chunk_id""")
def chunk_session_metrics(spark: SparkSession, d: str) -> DataFrame:
    """History metrics of chunks with bursts of one author's commits squashed to sessions."""
    return _chunk_metrics(spark, d, squash=True)


_T, _SIZE, _LEAST = 86_400_000, 5, 3


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS "at", event_id AS id FROM events), w AS (SELECT max("at") AS w FROM e),
l AS (SELECT key, any_value(w) AS w, list(struct_pack(t := "at", id := id) ORDER BY "at", id) AS x FROM e, w WHERE "at" < w GROUP BY key),
r AS (SELECT key, 1::BIGINT AS nxt, 0::BIGINT AS seq, 0::BIGINT AS n, NULL::BIGINT AS first_id, NULL::BIGINT AS last_id, NULL::BIGINT AS "at", NULL::VARCHAR AS reason FROM l
UNION ALL SELECT key, nxt + n, seq + 1, n, x[nxt].id, x[nxt + n - 1].id, "at", reason FROM (
  SELECT key, nxt, seq, x, w, CASE WHEN full_at < due THEN {_SIZE} ELSE len(list_filter(part, lambda y: y.t < due)) END AS n, CASE WHEN full_at < due THEN full_at ELSE due END AS "at", CASE WHEN full_at < due THEN 'size' ELSE 'time' END AS reason FROM (
    SELECT key, nxt, seq, x, w, part, part[{_SIZE}].t AS full_at, list_filter([part[1].t + {_T}, part[1].t + {_T + _T // 2}, part[1].t + {2 * _T}, part[1].t + {2 * _T + _T // 2}], lambda t: t = part[1].t + {2 * _T + _T // 2} OR len(list_filter(part, lambda y: y.t < t)) >= {_LEAST})[1] AS due
    FROM (SELECT r.key, r.nxt, r.seq, l.x, l.w, l.x[r.nxt : r.nxt + {_SIZE - 1}] AS part FROM r JOIN l ON l.key = r.key WHERE r.nxt <= len(l.x)) a) b) c WHERE "at" < w)
SELECT key AS user_id, seq, n::INT AS n, first_id, last_id, "at", reason FROM r WHERE seq > 0""")
def micro_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of every user's events by size and time, made by the stream."""
    events = X.stream(spark, d, "events")
    out = machines.drained(events, machines.Accumulator(_SIZE, _T, _LEAST), "user_id")
    return out.select(F.col("key").alias("user_id"), "seq", "n", "first_id", "last_id", "at", "reason")


_DELAY, _LONGEST = 6 * 3_600_000, 4 * 86_400_000


@query(f"""WITH a AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS "at", event_id AS id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'failed' WHEN 'signup' THEN 'changed' ELSE 'ok' END AS kind FROM events), w AS (SELECT max("at") AS w FROM a),
e AS (SELECT *, coalesce(sum((kind = 'ok')::INT) OVER (PARTITION BY key ORDER BY "at", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM a, w WHERE "at" < w),
f AS (SELECT *, count(*) FILTER (WHERE kind = 'failed') OVER o AS attempts, min("at") FILTER (WHERE kind = 'failed') OVER o AS first_failed, max("at") FILTER (WHERE kind = 'failed') OVER o AS last_failed, last_value(CASE WHEN kind = 'failed' THEN id END IGNORE NULLS) OVER o AS last_id, lead("at") OVER (PARTITION BY key, episode ORDER BY "at", id) AS next_at
  FROM e WINDOW o AS (PARTITION BY key, episode ORDER BY "at", id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, CASE WHEN kind = 'failed' THEN "at" + least({_DELAY} * (2 ** least(attempts - 1, 40)), {_LONGEST})::BIGINT END AS due FROM f WHERE attempts > 0),
x AS (SELECT key, CASE kind WHEN 'ok' THEN 'cleared' ELSE kind END AS what, "at", attempts, first_failed, last_failed, due, last_id FROM d
UNION ALL SELECT key, 'due', due, attempts, first_failed, last_failed, NULL, last_id FROM d WHERE kind = 'failed' AND due < w AND (next_at IS NULL OR due <= next_at))
SELECT key AS user_id, what, "at", attempts::INT AS attempts, first_failed, last_failed, due, last_id FROM x""")
def quarantine_log(spark: SparkSession, d: str) -> DataFrame:
    """Failures of every user's events, replays after rising delays, and recoveries, made by the stream."""
    events = X.stream(spark, d, "events")
    machine = machines.Quarantine(_DELAY, _LONGEST, ("error", "click"), ("signup",))
    out = machines.drained(events, machine, "user_id", kind="event_type")
    return out.select(F.col("key").alias("user_id"), "what", "at", "attempts", "first_failed", "last_failed", "due", "last_id")


@query(f"""WITH c AS ({COMMITS_SQL}), f AS (SELECT id AS sha, author, ts, 'src/d' || (id % 4) || '/k' || file AS file, 0 AS z FROM c WHERE ts BETWEEN 1704412800 AND 1705622400)
SELECT sha, author, ts, array_to_string(list_sort(list(DISTINCT file)), ',') AS files FROM f WHERE starts_with(file, 'src/d1/') OR file IN ('src/d2/k3', 'src/d0/k12') GROUP BY sha, author, ts""")
def commits_touching(spark: SparkSession, d: str) -> DataFrame:
    """Commits on a folder and some files within two weeks."""
    c = commits(spark, d).select(F.col("id").alias("sha"), "author", "ts", F.concat(F.lit("src/d"), F.col("id") % 4, F.lit("/k"), "file").alias("file"))
    wanted = spark.createDataFrame([("src/d1/",), ("src/d2/k3",), ("src/d0/k12",), ("src/d",)], "path string")
    return gitlog.touching(c, wanted, 1_704_412_800, 1_705_622_400).select("sha", "author", "ts", F.array_join("files", ",").alias("files"))
