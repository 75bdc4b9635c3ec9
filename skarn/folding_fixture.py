"""Calls that hand their parameters on, made from ``part``, and their types in DuckDB SQL.

The number of functions and calls grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .operators.resolution import Facts

#: Rounds that the SQL unrolls; fewer are needed at all sizes (a test looks).
ROUNDS = 12
_K = "(SELECT CAST(floor(count(*) / 12) AS BIGINT) + 12 AS kk FROM part)"
_CALLS = f"(SELECT DISTINCT p_partkey AS n, p_partkey % kk AS a, (p_partkey * 7 + 3) % kk AS o, kk FROM part, {_K} k)"
_FILE = "'app/t' || CAST({} AS STRING) || '.rb'"


def tables() -> dict[str, str]:
    """SQL that Spark and DuckDB share."""
    members = f"(SELECT DISTINCT p_partkey % kk AS a, kk FROM part, {_K} k) t CROSS JOIN (SELECT DISTINCT p_partkey % 3 AS j FROM part) u"
    own = "'T' || CAST(a AS STRING) || '#g' || CAST(n % 3 AS STRING)"
    return {
        "calls": f"SELECT n AS call_id, 'ruby' AS language, {_FILE.format('a')} AS rel_path, 10 AS line, {own} AS source_symbol_id, 'T' || CAST(a AS STRING) AS scope, CASE WHEN n % 4 < 2 THEN NULL ELSE 'p' || CAST(n % 2 AS STRING) END AS receiver, 'g' || CAST(n * 5 % 3 AS STRING) AS member FROM {_CALLS} c",
        "symbols": f"SELECT 'ruby' AS language, {_FILE.format('a')} AS rel_path, 'T' || CAST(a AS STRING) || '#g' || CAST(j AS STRING) AS symbol_id, 'g' || CAST(j AS STRING) AS short_name, 'T' || CAST(a AS STRING) AS scope FROM {members} WHERE (a + j) % 4 > 0",
        "inheritance": f"SELECT DISTINCT 'ruby' AS language, 'T' || CAST(a AS STRING) AS source_fq_name, 'T' || CAST(CAST(floor(a / 2) AS BIGINT) AS STRING) AS ancestor_fq_name, 'extends' AS kind, 0 AS ordinal FROM {members} WHERE a > 1",
        "targets": f"SELECT n AS call_id, 'T' || CAST(o AS STRING) || '#g' || CAST(n % 3 AS STRING) AS target FROM {_CALLS} c WHERE n % 4 < 2",
        "arguments": f"""SELECT n AS call_id, j AS position, CASE WHEN (n + j) % 5 < 2 THEN 'T' || CAST(CASE WHEN n % 11 = 0 THEN (n * 3) % kk ELSE (o * 2 + j) % kk END AS STRING) END AS type, CASE WHEN (n + j) % 5 IN (2, 3) THEN 'p' || CAST((n + j) % 2 AS STRING) END AS name
FROM {_CALLS} c CROSS JOIN (SELECT DISTINCT p_partkey % 2 AS j FROM part) v""",
        "parameters": f"SELECT 'T' || CAST(a AS STRING) || '#g' || CAST(j AS STRING) AS function, q AS position, 'p' || CAST(q AS STRING) AS name FROM {members} CROSS JOIN (SELECT DISTINCT p_partkey % 2 AS q FROM part) v",
    }


def facts(spark: SparkSession, sf_dir: str) -> tuple[Facts, DataFrame, DataFrame, DataFrame]:
    """(facts, targets, arguments, parameters)."""
    made = {k: X.frame(spark, sf_dir, sql, "part") for k, sql in tables().items()}
    none = lambda schema: spark.createDataFrame([], schema)
    t = Facts(
        calls=made["calls"], symbols=made["symbols"], inheritance=made["inheritance"], imports=none("language string, rel_path string, position int, import_text string, names array<string>"),
        bindings=none("rel_path string, owner string, name string, line int, type string, is_class boolean"), fields=none("language string, scope string, field string, type string"),
        returns=none("language string, function string, type string"), call_bindings=none("rel_path string, owner string, name string, line int, function string"),
    )
    cast = lambda c: made[c].withColumn("position", F.col("position").cast("int"))
    return t, made["targets"], cast("arguments"), cast("parameters")


def sql() -> str:
    """(call_id, target, function, position, type) of the calls gained, by rounds that each look at all that is known."""
    t = tables()
    out = f"""WITH RECURSIVE c AS MATERIALIZED ({t['calls']}), s AS MATERIALIZED ({t['symbols']}), h AS ({t['inheritance']}), g AS MATERIALIZED ({t['targets']}), a AS MATERIALIZED ({t['arguments']}), p AS MATERIALIZED ({t['parameters']}),
up AS (SELECT DISTINCT source_fq_name AS type, source_fq_name AS above, 0 AS d FROM h UNION SELECT source_fq_name, ancestor_fq_name, 1 FROM h UNION SELECT type, ancestor_fq_name, d + 1 FROM up JOIN h ON h.source_fq_name = above WHERE d < 30),
roots AS (SELECT scope AS type, scope AS above, 0 AS d FROM s UNION SELECT type, above, d FROM up),
m AS MATERIALIZED (SELECT type, short_name AS member, arg_min(symbol_id, d) AS target FROM roots JOIN s ON s.scope = above GROUP BY ALL),
o AS MATERIALIZED (SELECT c.call_id, c.member, c.source_symbol_id AS function, p.position FROM c JOIN p ON p.function = c.source_symbol_id AND p.name = c.receiver WHERE c.call_id NOT IN (SELECT call_id FROM g)),
w AS MATERIALIZED (SELECT a.call_id, a.position, c.source_symbol_id AS f, p.position AS q FROM a JOIN c USING (call_id) JOIN p ON p.function = c.source_symbol_id AND p.name = a.name WHERE a.type IS NULL),
e0 AS MATERIALIZED (SELECT DISTINCT target AS function, position, type FROM g JOIN a USING (call_id) WHERE type IS NOT NULL)"""
    out += ",\nt0 AS (SELECT call_id, target FROM g), s0 AS (SELECT * FROM e0 WHERE false)"
    for k in range(1, ROUNDS + 1):
        out += f""",
n{k} AS MATERIALIZED (SELECT function, position, min(type) AS type FROM e{k - 1} WHERE (function, position) NOT IN (SELECT (function, position) FROM s{k - 1}) GROUP BY ALL HAVING count(DISTINCT type) = 1), s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM n{k}),
t{k} AS MATERIALIZED (SELECT * FROM t{k - 1} UNION ALL SELECT o.call_id, m.target FROM o JOIN n{k} n USING (function, position) JOIN m ON m.type = n.type AND m.member = o.member),
e{k} AS MATERIALIZED (SELECT * FROM e{k - 1} UNION SELECT target, position, type FROM t{k} JOIN a USING (call_id) WHERE type IS NOT NULL UNION SELECT t.target, w.position, s{k}.type FROM t{k} t JOIN w USING (call_id) JOIN s{k} ON s{k}.function = w.f AND s{k}.position = w.q)"""
    return f"""{out}, n AS (SELECT function, position, min(type) AS type FROM e{ROUNDS} GROUP BY ALL HAVING count(DISTINCT type) = 1)
SELECT o.call_id, m.target, o.function, o.position::INT AS position, n.type, (SELECT count(*) FROM e{ROUNDS})::BIGINT AS evidence FROM o JOIN n USING (function, position) JOIN m ON m.type = n.type AND m.member = o.member"""
