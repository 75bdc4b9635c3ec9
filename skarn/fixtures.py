"""Entities of the engine derived from the supplied tables, in SQL that Spark and DuckDB share.

The tables hold no code history, so chunk payloads, symbols and graphs are made from
their keys by arithmetic; texts, vectors, times and orders are used as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = 1_706_745_600  # the end of the events' month

CHUNKS = """
SELECT doc_id AS id, lang AS language, source || CASE (doc_id % 97) % 10 WHEN 3 THEN '/auth' WHEN 7 THEN '/lib/token' ELSE '' END || '/f' || CAST(doc_id % 97 AS STRING) || '.' || lang AS relativePath, '.' || lang AS fileExtension,
  (doc_id % 50) * 10 + 1 AS startLine, (doc_id % 50) * 10 + 1 + doc_id % 40 AS endLine, doc_id % 50 AS chunkIndex,
  CASE doc_id % 7 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'block' WHEN 3 THEN 'test' WHEN 4 THEN 'interface' ELSE 'function' END AS chunkType,
  doc_id % 11 = 0 AS isDocumentation, doc_id % 13 = 0 AS isTest, n_chars AS contentSize,
  'C' || CAST(doc_id % 97 AS STRING) || '#m' || CAST(doc_id % 29 AS STRING) AS symbolId, CASE WHEN doc_id % 5 > 0 THEN 'C' || CAST(doc_id % 97 AS STRING) END AS parentSymbolId,
  CAST(floor(n_chars / 40) AS BIGINT) AS methodLines, n_chars % 160 AS methodDensity, (doc_id % 97) % 41 AS moduleMethodCount, (doc_id % 97) % 23 AS memberCount, (doc_id % 97) * 31 AS moduleLines,
  split(substr('a,b,c,d,e,f,g,h', 1, CAST(doc_id % 8 * 2 + 1 AS INT)), ',') AS imports, CASE doc_id % 4 WHEN 0 THEN 'Install Guide' WHEN 1 THEN 'The install' WHEN 2 THEN 'Other topic' END AS heading1, CASE doc_id % 3 WHEN 0 THEN 'user-guide_notes' ELSE 'misc' END AS heading2,
  CASE WHEN doc_id % 3 = 0 THEN split('TD-' || CAST(doc_id % 7 AS STRING) || ',#' || CAST(doc_id % 11 AS STRING), ',') END AS git_file_taskIds,
  2e-1 + (doc_id * 37 % 101) / 2e2 AS score,
  (doc_id % 97) % 40 + 1 AS git_file_commitCount, (doc_id % 97) * 5 % 400 AS git_file_ageDays, (doc_id % 97) * 13 % 100 AS git_file_bugFixRate, (doc_id % 97) % 9 / 20e-1 AS git_file_relativeChurn,
  (doc_id % 97) % 17 / 15e-1 AS git_file_recencyWeightedFreq, (doc_id % 97) % 25 / 30e-1 AS git_file_changeDensity, (doc_id % 97) * 3 % 120 / 10e-1 AS git_file_churnVolatility,
  (doc_id % 97) % 5 AS git_file_blameContributorCount, (doc_id % 97) * 7 % 101 AS git_file_blameDominantAuthorPct, (doc_id % 97) * 11 % 101 AS git_file_recentDominantAuthorPct, (doc_id % 97) % 6 AS git_file_recentContributorCount,
  'a' || CAST((doc_id % 97) % 8 AS STRING) AS git_file_recentDominantAuthor, 'a' || CAST((doc_id % 97) % 8 AS STRING) || '@x.org' AS git_file_recentDominantAuthorEmail, 'b' || CAST((doc_id % 97) % 12 AS STRING) AS git_file_blameDominantAuthor,
  1700000000 + (doc_id % 97) * 50000 AS git_file_lastModifiedAt, 1690000000 + (doc_id % 97) * 1000 AS git_file_firstCreatedAt,
  CASE WHEN doc_id % 3 > 0 THEN doc_id * 13 % 23 END AS git_chunk_commitCount, CASE WHEN doc_id % 3 > 0 THEN doc_id * 7 % 300 END AS git_chunk_ageDays, CASE WHEN doc_id % 3 > 0 THEN doc_id * 17 % 100 END AS git_chunk_bugFixRate,
  CASE WHEN doc_id % 3 > 0 THEN doc_id % 10 / 100e-1 END AS git_chunk_churnRatio, CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 / 20e-1 END AS git_chunk_relativeChurn, CASE WHEN doc_id % 3 > 0 THEN doc_id % 13 / 15e-1 END AS git_chunk_recencyWeightedFreq,
  CASE WHEN doc_id % 3 > 0 THEN doc_id % 19 / 30e-1 END AS git_chunk_changeDensity, CASE WHEN doc_id % 3 > 0 THEN doc_id * 3 % 110 / 10e-1 END AS git_chunk_churnVolatility, CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 END AS git_chunk_blameContributorCount,
  1700000000 + doc_id * 300 AS git_chunk_lastModifiedAt,
  (doc_id % 97) % 31 AS codegraph_file_fanIn, (doc_id % 97) % 19 AS codegraph_file_fanOut, (doc_id % 97) % 11 / 100e-1 AS codegraph_file_instability, (doc_id % 97) % 8 AS codegraph_file_connectionCount,
  (doc_id % 97) % 31 > 27 AS codegraph_file_isHub, (doc_id % 97) % 19 = 0 AS codegraph_file_isLeaf, (doc_id % 97) % 61 AS codegraph_file_transitiveImpact,
  doc_id % 43 AS codegraph_chunk_fanIn, doc_id % 37 AS codegraph_chunk_fanOut, doc_id % 89 / 80000e-1 AS codegraph_chunk_pageRank
FROM documents"""

# customer nation -> supplier nation, where any order links them
EDGES = """
SELECT DISTINCT cn.n_name AS src, sn.n_name AS dst
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey"""

# graphs whose nodes and edges grow with the table: so many nodes for so many parts, and a least number
def _nodes(parts: int, least: int) -> str:
    return f"(SELECT greatest({least}, CAST(floor(count(*) / {parts}) AS BIGINT)) AS kk FROM part) k"


# a sparse graph with chains, joints and cycles
SPARSE = f"SELECT DISTINCT p_partkey % kk AS src, (p_partkey * p_partkey + 7) % kk AS dst FROM part, {_nodes(5, 40)}"

# two ways on from each node
WEB = f"SELECT DISTINCT p_partkey % kk AS src, CASE WHEN CAST(floor(p_partkey / kk) AS BIGINT) % 2 = 0 THEN (p_partkey * 3 + 1) % kk ELSE (p_partkey * 7 + 2) % kk END AS dst FROM part, {_nodes(66, 30)}"

# types below types: each above 1 extends its half
NAMES = _nodes(31, 64)
TYPES = f"SELECT 'T' || CAST(k AS STRING) AS source_fq_name, 'T' || CAST(CAST(floor(k / 2) AS BIGINT) AS STRING) AS ancestor_fq_name, 'extends' AS kind, 0 AS ordinal FROM (SELECT DISTINCT p_partkey % kk AS k FROM part, {NAMES}) t WHERE k > 1"

SYMBOLS = f"SELECT DISTINCT 'src/t' || CAST(p_partkey % kk AS STRING) || '.py' AS rel_path, 'T' || CAST(p_partkey % kk AS STRING) || '#m' || CAST(p_partkey % 5 AS STRING) AS symbol_id, 'm' || CAST(p_partkey % 5 AS STRING) AS short_name FROM part, {NAMES}"

CALLS = f"""
SELECT DISTINCT 'T' || CAST(p_partkey % kk AS STRING) || '#m' || CAST(p_partkey % 5 AS STRING) AS source_symbol_id, 'src/t' || CAST(p_partkey % kk AS STRING) || '.py' AS source_rel_path,
  'T' || CAST((p_partkey * 3 + 1) % kk AS STRING) || '#m' || CAST(p_partkey % 3 AS STRING) AS target_symbol_id, 'src/t' || CAST((p_partkey * 3 + 1) % kk AS STRING) || '.py' AS target_rel_path,
  'call' || CAST(p_partkey % 20 AS STRING) AS call_expression,
  CASE p_partkey % 6 WHEN 0 THEN 'poly-base' WHEN 1 THEN 'dynamic' WHEN 2 THEN 'cone' ELSE 'exact' END AS edge_kind, CASE p_partkey % 6 WHEN 1 THEN 5e-1 WHEN 2 THEN 25e-2 ELSE 1e0 END AS confidence
FROM part, {NAMES}"""

RUNS = """
SELECT n_name AS language, CASE n_nationkey % 3 WHEN 0 THEN 'chain' WHEN 1 THEN 'constant' ELSE 'bareCall' END AS receiver_kind, 100 + n_nationkey AS attempted, 60 + n_nationkey AS resolved,
  n_nationkey % 4 AS external_skipped, n_nationkey % 3 AS unresolvable, n_nationkey % 5 AS no_in_project_def, n_nationkey % 7 AS ambiguous_fanout, n_nationkey % 2 AS core_ambiguous FROM nation"""

# ranges of lines per order, and single lines in them
_LINE_KEY = "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)"
RANGE_ROWS = "SELECT l_orderkey % 5000 AS file, l_partkey AS chunk_id, l_partkey % 80 AS start_line, l_partkey % 80 + l_linenumber * 9 AS end_line, l_linenumber AS depth FROM lineitem"
RANGES = RANGE_ROWS.replace("SELECT", "SELECT DISTINCT", 1)
POINTS = f"SELECT DISTINCT {_LINE_KEY} AS point_id, l_orderkey % 5000 AS file, (l_partkey * 7 + l_suppkey) % 120 AS line, 'w' || CAST(l_suppkey % 9 AS STRING) AS author FROM lineitem"
HUNK_ROWS = f"SELECT {_LINE_KEY} AS hunk_id, l_orderkey % 5000 AS file, l_suppkey % 100 AS hunk_start, l_suppkey % 100 + l_linenumber AS hunk_end FROM lineitem"
HUNKS = HUNK_ROWS.replace("SELECT", "SELECT DISTINCT", 1)


# a history of line changes: each supplier is a file, each order a commit, and one file is much busier
CHANGES = """
SELECT CASE WHEN l_partkey % 20 = 0 THEN 0 ELSE l_suppkey END AS file, l_orderkey AS id, 'a' || CAST(l_suppkey % 9 AS STRING) AS author, l_orderkey * 60 AS ts, l_returnflag = 'R' AS is_fix,
  l_partkey % 170 + 1 AS old_start, CAST(l_quantity AS BIGINT) % 5 AS old_lines, l_partkey % 170 + 1 AS new_start, CAST(l_linenumber AS BIGINT) - 1 AS new_lines FROM lineitem"""
SPANS = "SELECT DISTINCT CASE WHEN l_partkey % 20 = 0 THEN 0 ELSE l_suppkey END AS file, CAST(l_linenumber AS BIGINT) AS chunk_id, CAST(l_linenumber AS BIGINT) * 24 - 20 AS start_line, CAST(l_linenumber AS BIGINT) * 24 + 3 AS end_line FROM lineitem"


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; a pattern, as a source of streams takes no single file by name."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def frame(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A fixture as a DataFrame over the tables it names."""
    register(spark, sf_dir, *names)
    return spark.sql(sql)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = frame(spark, sf_dir, CHUNKS, "documents")
    headings = F.array(*[F.struct(F.lit(k).alias("depth"), F.col(f"heading{k}").alias("text")) for k in (1, 2)])
    return made.withColumn("headingPath", F.filter(headings, lambda h: h["text"].isNotNull()))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, EDGES, "lineitem", "orders", "customer", "supplier", "nation")


def parts(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return frame(spark, sf_dir, sql, "part")
