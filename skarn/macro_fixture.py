"""Calls of class-body macros made from ``part``, and what they declare and mean in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .plans import ruby_vocabulary as V

_ALL = [(f["framework"], name, m) for f in V.FRAMEWORKS for name, m in f["macros"].items()]
_LISTED = ", ".join(f"({i}, '{name}')" for i, (_, name, _) in enumerate(_ALL))
_WORD = "CASE {} % 6 WHEN 0 THEN 'companies' WHEN 1 THEN 'boxes' WHEN 2 THEN 'users' WHEN 3 THEN 'glass' WHEN 4 THEN 'line_items' ELSE 'status' END"

#: call_id, rel_path, scope, macro and three arguments (kind, value), in SQL that Spark and DuckDB share.
CALLS = f"""SELECT p_partkey AS call_id, 'app/t' || CAST(p_partkey % 50 AS STRING) || '.rb' AS rel_path, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'T' || CAST(p_partkey % 50 AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN 'Serializer' ELSE '' END END AS scope, macro,
CASE WHEN p_partkey % 5 = 4 THEN 'string' ELSE 'symbol' END AS k1, CASE WHEN p_partkey % 7 = 3 THEN 'admin/' || {_WORD.format('p_partkey')} || '#show' ELSE {_WORD.format('p_partkey')} END AS v1,
CASE p_partkey % 3 WHEN 0 THEN 'symbol' WHEN 1 THEN 'class_name:' ELSE 'to:' END AS k2, CASE p_partkey % 3 WHEN 0 THEN 'other_name' WHEN 1 THEN 'Firm' ELSE 'owners' END AS v2,
CASE WHEN p_partkey % 4 = 1 THEN 'constant' ELSE 'symbol' END AS k3, CASE WHEN p_partkey % 4 = 1 THEN 'Report' ELSE 'extra' END AS v3
FROM part JOIN (VALUES {_LISTED}) AS m(i, macro) ON p_partkey % {len(_ALL)} = i"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = X.frame(spark, sf_dir, CALLS, "part")
    return made.withColumn("args", F.array(*[F.struct(F.col(f"k{i}").alias("kind"), F.col(f"v{i}").alias("value")) for i in (1, 2, 3)]))


def _singular(w: str) -> str:
    return f"CASE WHEN ends_with({w}, 'ies') THEN left({w}, -3) || 'y' WHEN regexp_matches({w}, '(xes|ses|shes|ches)$') THEN left({w}, -2) WHEN ends_with({w}, 's') AND NOT ends_with({w}, 'ss') THEN left({w}, -1) ELSE {w} END"


def _camel(w: str) -> str:
    return f"array_to_string(list_transform(string_split({w}, '_'), lambda z: upper(left(z, 1)) || lower(substr(z, 2))), '')"


_RULES = ", ".join(f"('{f}', '{name}', {repr(m['operands']) if m['operands'] else 'NULL'}, {repr(m['links']) if m['links'] else 'NULL'}, {m['makes']}::VARCHAR[])" for f, name, m in _ALL)
_BASE = f"""c AS (SELECT *, [{{'k': k1, 'v': v1}}, {{'k': k2, 'v': v2}}, {{'k': k3, 'v': v3}}] AS args FROM ({CALLS}) x), r(framework, macro, operands, links, makes) AS (VALUES {_RULES}),
o AS (SELECT *, list_transform(list_filter(args, lambda a: a.k IN ('symbol', 'string')), lambda a: a.v) AS plain, CASE WHEN k2 NOT IN ('symbol', 'string') THEN [v1] WHEN k3 NOT IN ('symbol', 'string') THEN [v1, v2] ELSE [v1, v2, v3] END AS front FROM c JOIN r USING (macro))"""

DECLARED = f"""WITH {_BASE}, n AS (SELECT call_id, framework, rel_path, scope, pattern, unnest(CASE WHEN NOT contains(pattern, '{{') THEN [''] WHEN operands IN ('first', 'name') THEN plain[1:1] WHEN operands = 'rest' THEN plain[2:] ELSE front END) AS w FROM (SELECT *, unnest(makes) AS pattern FROM o WHERE scope IS NOT NULL) y),
m AS (SELECT *, replace(replace(pattern, '{{one}}', {_singular('w')}), '{{}}', w) AS made FROM n) SELECT DISTINCT call_id, framework, rel_path, scope || made AS symbol_id, substr(made, 2) AS short_name, scope FROM m"""

LINKED = f"""WITH {_BASE}, p AS (SELECT *, CASE WHEN k2 = 'to:' THEN v2 END AS through, CASE WHEN k2 = 'class_name:' THEN v2 END AS klass, CASE WHEN k3 = 'constant' THEN v3 END AS constant, coalesce(CASE WHEN k2 = 'to:' THEN v2 END, list_filter(plain, lambda z: contains(z, '#'))[1]) AS spec FROM o WHERE links IS NOT NULL AND (scope IS NOT NULL OR links = 'route')),
q AS (SELECT *, coalesce(constant, {_camel(_singular('plain[1]'))}) AS subject, array_to_string(list_transform(string_split(split_part(spec, '#', 1), '/'), lambda y: {_camel('y')}), '::') AS controller FROM p),
t AS (SELECT call_id, links, unnest(CASE links WHEN 'own-method' THEN list_transform(front, lambda w: scope || '#' || w) WHEN 'model' THEN list_transform(front, lambda w: coalesce(klass, {_camel(_singular('w'))})) WHEN 'second-symbol' THEN CASE WHEN len(plain) >= 2 THEN [scope || '#' || plain[2]] END
WHEN 'delegate' THEN CASE WHEN through IS NOT NULL THEN list_transform(front, lambda w: {_camel(_singular('through'))} || '#' || w) END WHEN 'route' THEN CASE WHEN contains(spec, '#') THEN [controller || 'Controller#' || split_part(spec, '#', 2)] END
WHEN 'policy' THEN [subject || 'Policy'] WHEN 'ability' THEN [subject] WHEN 'ability-subject' THEN [subject] WHEN 'serialized' THEN list_transform(front, lambda w: regexp_replace(scope, 'Serializer$', '') || '#' || w) END) AS target FROM q)
SELECT DISTINCT call_id, links AS link, target FROM t WHERE target IS NOT NULL"""
