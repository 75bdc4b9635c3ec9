"""Ruby calls, definitions and types made from ``part``, and Ruby's chain over them in DuckDB SQL.

The number of files, types and calls grows with the table: a type and its file for each 25 parts.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .operators.resolution import CONSTANT, DUCK_MEMBERS, ENQUEUE, RELATION_BUILDERS, RUNTIME_HOOKS, Facts
from .resolution_fixture import _rows

# K is the number of types, made from the table's size
_K = "(SELECT CAST(floor(count(*) / 25) AS BIGINT) + 12 AS kk FROM part)"
_HOME = "'app/d' || CAST({0} % 7 AS STRING) || '/t' || CAST({0} AS STRING) || '.rb'"
_T = "'T' || CAST({} AS STRING)"


def tables() -> dict[str, str]:
    """SQL of the facts' tables, in a form that Spark and DuckDB share."""
    calls = f"(SELECT DISTINCT p_partkey AS n, p_partkey % kk AS a, (p_partkey * 7 + 3) % kk AS o, kk FROM part, {_K} k)"
    types = f"(SELECT DISTINCT p_partkey % kk AS a, kk FROM part, {_K} k)"
    members = f"{types} t CROSS JOIN (SELECT DISTINCT p_partkey % 5 AS j FROM part) u"
    receiver = f"""CASE n % 17 WHEN 0 THEN NULL WHEN 1 THEN 'self' WHEN 2 THEN '@fld' || CAST(n % 4 AS STRING) WHEN 3 THEN 'v' || CAST(n % 3 AS STRING) WHEN 4 THEN {_T.format('o')} WHEN 5 THEN 'super' WHEN 6 THEN 'w' || CAST(n % 3 AS STRING)
WHEN 7 THEN 't' || CAST(o AS STRING) WHEN 8 THEN {_T.format('o')} WHEN 9 THEN 'lib' || CAST(n % 4 AS STRING) WHEN 10 THEN {_T.format('o')} || '.new' WHEN 11 THEN 'v' || CAST(n % 3 AS STRING) || '.m' || CAST(n % 13 AS STRING) WHEN 12 THEN 'v1.where(x)'
WHEN 13 THEN '@t' || CAST(o AS STRING) WHEN 14 THEN NULL WHEN 15 THEN CASE n % 4 WHEN 0 THEN 'In' WHEN 1 THEN 'rows[k]' WHEN 2 THEN 'Gem::Client.thing' ELSE 'thing' END ELSE {_T.format('o')} END"""
    member = "CASE WHEN n % 17 = 8 THEN 'perform_later' WHEN n % 17 = 14 THEN 'hook' || CAST(a % 4 AS STRING) WHEN n % 17 = 16 THEN 'run' WHEN n % 17 = 5 AND n % 2 = 0 THEN 'inherited' WHEN n % 17 = 0 AND n % 2 = 0 THEN 'col' || CAST(n % 6 AS STRING) ELSE 'm' || CAST(n % 13 AS STRING) END"
    owner = f"CASE WHEN n % 9 = 0 THEN NULL ELSE {_T.format('a')} || CASE WHEN n % 17 = 14 THEN '.run' ELSE '#m0' END END"
    return {
        "calls": f"SELECT n AS call_id, 'ruby' AS language, {_HOME.format('a')} AS rel_path, CAST(n % 50 AS INT) AS line, {owner} AS source_symbol_id, CASE WHEN n % 9 = 0 THEN NULL ELSE {_T.format('a')} END AS scope, {receiver} AS receiver, {member} AS member, CAST(n % 3 AS INT) AS n_args, n % 7 = 0 AS has_block FROM {calls} c",
        "symbols": f"""SELECT 'ruby' AS language, {_HOME.format('a')} AS rel_path, {_T.format('a')} || CASE WHEN (a + j) % 3 > 0 THEN '#' ELSE '.' END || 'm' || CAST((a * 3 + j) % 13 AS STRING) AS symbol_id, 'm' || CAST((a * 3 + j) % 13 AS STRING) AS short_name, {_T.format('a')} AS scope, false AS is_column FROM {members}
UNION ALL SELECT 'ruby', {_HOME.format('a')}, {_T.format('a')}, {_T.format('a')}, CAST(NULL AS STRING), false FROM {types} t
UNION ALL SELECT 'ruby', {_HOME.format('a')}, {_T.format('a')} || '#perform', 'perform', {_T.format('a')}, false FROM {types} t WHERE a % 3 = 0
UNION ALL SELECT 'ruby', {_HOME.format('a')}, {_T.format('a')} || '#hook' || CAST(j AS STRING), 'hook' || CAST(j AS STRING), {_T.format('a')}, false FROM {members} WHERE a % 2 = 1 AND j < 4
UNION ALL SELECT 'ruby', 'lib/lib' || CAST(j AS STRING) || '.rb', 'lm' || CAST(j AS STRING), 'm' || CAST(j AS STRING), CAST(NULL AS STRING), false FROM (SELECT DISTINCT p_partkey % 3 AS j FROM part) u
UNION ALL SELECT 'ruby', {_HOME.format('a')}, {_T.format('a')} || '#col' || CAST(j AS STRING), 'col' || CAST(j AS STRING), {_T.format('a')}, true FROM {members} WHERE a % 4 < 2""",
        "imports": f"SELECT DISTINCT 'ruby' AS language, {_HOME.format('a')} AS rel_path, CAST(j AS INT) AS position, CASE WHEN j = 2 THEN 'lib9' ELSE 'lib' || CAST(j AS STRING) END AS import_text, 'x' AS name FROM {members} WHERE j < 3",
        "bindings": f"SELECT DISTINCT {_HOME.format('a')} AS rel_path, CASE WHEN z = 2 THEN NULL ELSE {_T.format('a')} || '#m0' END AS owner, 'v' || CAST(j AS STRING) AS name, CAST(z * 20 AS INT) AS line, {_T.format('(a * 7 + j + z * 3) % (kk + 3)')} AS type, (a + j) % 4 = 0 AS is_class FROM {members} CROSS JOIN (SELECT DISTINCT p_partkey % 3 AS z FROM part) r WHERE j < 3",
        "fields": f"SELECT DISTINCT 'ruby' AS language, {_T.format('a')} AS scope, '@fld' || CAST(j AS STRING) AS field, {_T.format('(a * 5 + j) % (kk + 3)')} AS type FROM {members} WHERE j < 3",
        "inheritance": f"SELECT DISTINCT 'ruby' AS language, {_T.format('a')} AS source_fq_name, {_T.format('CAST(floor(a / 2) AS BIGINT)')} AS ancestor_fq_name, 'extends' AS kind, 0 AS ordinal FROM {types} t WHERE a > 1 UNION ALL SELECT 'ruby', {_T.format('a')}, {_T.format('CAST(floor(a / 3) AS BIGINT)')}, 'include', 1 FROM {types} t WHERE a > 5 AND a % 2 = 0",
        "returns": f"SELECT DISTINCT 'ruby' AS language, 'make' || CAST(a AS STRING) AS function, {_T.format('(a * 3) % kk')} AS type FROM {types} t UNION ALL SELECT 'ruby', {_T.format('a')} || '#m' || CAST((a * 3 + j) % 13 AS STRING), {_T.format('(a + j) % kk')} FROM {members}",
        "call_bindings": f"SELECT DISTINCT {_HOME.format('a')} AS rel_path, {_T.format('a')} || '#m0' AS owner, 'w' || CAST(j AS STRING) AS name, CAST(5 AS INT) AS line, 'make' || CAST((a + j) % (kk + 2) AS STRING) AS function FROM {members} WHERE j < 3",
    }


#: What definitions take, by the digits in their ids.
ARITY = "SELECT *, CAST(length(symbol_id) % 2 AS INT) AS min_args, CAST(length(symbol_id) % 2 + 1 AS INT) AS max_args, length(symbol_id) % 5 = 0 AS splat, length(rel_path) % 3 = 0 AS accepts_block, CASE WHEN length(symbol_id) % 4 = 3 AND length(rel_path) % 2 = 0 THEN 'private' ELSE 'public' END AS visibility FROM ({}) s"


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    made = {k: X.frame(spark, sf_dir, ARITY.format(sql) if k == "symbols" else sql, "part") for k, sql in tables().items()}
    none = F.lit(None).cast("array<string>")
    made["symbols"] = made["symbols"].withColumn("required_keywords", none).withColumn("declared_keywords", none)
    made["calls"] = made["calls"].withColumn("given_keywords", none).withColumn("keyword_splat", F.lit(False))
    made["imports"] = made["imports"].withColumn("names", F.array("name")).drop("name")
    return Facts(**made)


# -- the chain in SQL ------------------------------------------------------------------


def _one(candidates: str) -> str:
    """Calls with one candidate (file, target) in the first ``o`` that has just one."""
    return f"(SELECT call_id, file, target FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY o) AS nth FROM (SELECT call_id, o, min(file) AS file, min(target) AS target FROM (SELECT DISTINCT call_id, o, file, target FROM ({candidates}) q1) q2 GROUP BY call_id, o HAVING count(*) = 1) q3) q4 WHERE nth = 1)"


def _along(calls: str, kinds: str = "#", itself: bool = True) -> str:
    """The member on the type ``start`` of each call, or on the nearest type above it that has it."""
    own = f" UNION ALL SELECT call_id, member, start, 0, []::INT[] FROM ({calls}) z2" if itself else ""
    steps = ", ".join(f"({i}, '{k}')" for i, k in enumerate(kinds))
    above = f"SELECT z1.call_id, z1.member, anc.ancestor AS type, len(anc.rank) AS lvl, anc.rank AS place FROM ({calls}) z1 JOIN anc ON anc.scope = z1.start{own}"
    return _one(f"SELECT z.call_id, {{'l': lvl, 'p': place, 's': step}} AS o, s.file, s.target FROM ({above}) z CROSS JOIN (VALUES {steps}) st(step, k) JOIN s ON s.target = z.type || st.k || z.member")


def _bound(table: str, value: str, rows: str = "c") -> str:
    return f"(SELECT * EXCLUDE (nth) FROM (SELECT x.*, t.{value} AS found, {'t.is_class' if table == 'b' else 'false'} AS klass, row_number() OVER (PARTITION BY x.call_id ORDER BY t.line DESC, t.{value}) AS nth FROM {rows} x JOIN {table} t ON t.rel_path = x.rel_path AND t.owner IS NOT DISTINCT FROM x.source_symbol_id AND t.name = x.receiver AND t.line <= x.line) y WHERE nth = 1)"


def _camel(name: str) -> str:
    return f"array_to_string(list_transform(string_split({name}, '_'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')"


def _both(*parts: str) -> str:
    """The first part's rows, then those of calls that no part before has."""
    out, seen = [], []
    for k, p in enumerate(parts):
        rest = " AND ".join(f"call_id NOT IN (SELECT call_id FROM {q} n{k}{i})" for i, q in enumerate(seen)) or "true"
        out.append(f"SELECT call_id, file, target FROM {p} u{k} WHERE {rest}")
        seen.append(p)
    return "(" + " UNION ALL ".join(out) + ")"


def _chain() -> list[tuple[str, str, str]]:
    """(name, helper tables, rows) of each strategy, in order."""
    sup = "SELECT *, scope AS start FROM c WHERE receiver = 'super'"
    hooks = ", ".join(f"'{h}'" for h in RUNTIME_HOOKS)
    near = f"(SELECT call_id, file, NULL AS target FROM (SELECT x.call_id, s.file, row_number() OVER (PARTITION BY x.call_id ORDER BY len(anc.rank), anc.rank, s.file) AS nth FROM ({sup}) x JOIN anc ON anc.scope = x.scope JOIN s ON s.target = anc.ancestor AND s.in_scope IS NULL WHERE x.member NOT IN ({hooks})) y WHERE nth = 1)"
    me = "SELECT *, scope AS start FROM c WHERE receiver = 'self' AND scope IS NOT NULL"
    local = _bound("b", "type")
    ivar = "SELECT c.*, fld.type FROM c LEFT JOIN fld ON fld.scope = c.scope AND fld.field = c.receiver WHERE regexp_full_match(c.receiver, '@\\w+') AND c.scope IS NOT NULL"
    guess = _camel("regexp_replace(receiver, '^@', '')")
    known = "(SELECT target FROM every)"
    ivars = _both(_along(f"SELECT *, type AS start FROM ({ivar}) f1 WHERE type IS NOT NULL", "#."), _along(f"SELECT *, {guess} AS start FROM ({ivar}) f2 WHERE type IS NULL AND {guess} IN {known}"))
    verbs = ", ".join(f"'{v}'" for v in ENQUEUE)
    job = "CASE member " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ENQUEUE.items()) + " END"
    const = f"regexp_matches(receiver, '{CONSTANT}')".replace("(?:", "(?:")
    hook = "(SELECT DISTINCT i.scope AS base, regexp_extract(i.source_symbol_id, '[.#]([^.#]+)$', 1) AS entry, i.member AS hook FROM c i WHERE i.scope IS NOT NULL AND (i.receiver IS NULL OR i.receiver IN ('self', 'new')) AND NOT EXISTS (SELECT 1 FROM every e WHERE e.in_scope = i.scope AND e.member = i.member) AND EXISTS (SELECT 1 FROM anc JOIN every e ON e.in_scope = anc.scope WHERE anc.ancestor = i.scope AND e.member = i.member))"
    entry = _one(f"SELECT x.call_id, 0 AS o, s.file, s.target FROM c x JOIN anc ON anc.scope = x.receiver JOIN {hook} k ON k.base = anc.ancestor AND k.entry = x.member AND k.entry <> '' JOIN s ON s.target = x.receiver || '#' || k.hook WHERE {const.replace('receiver', 'x.receiver')}")
    at = f"(SELECT call_id, m.constant AS constant, m.file AS file, member FROM (SELECT x.call_id, any_value(x.member) AS member, min({{'d': x.depth, 'constant': x.constant, 'file': e.file}}) AS m FROM (SELECT call_id, member, len(p) - k AS depth, regexp_replace(array_to_string(list_append(p[1:k], receiver), '::'), '^::', '') AS constant FROM (SELECT *, string_split(coalesce(scope, ''), '::') AS p FROM c WHERE {const}) x1, unnest(range(0, len(p) + 1)) r(k)) x JOIN every e ON e.target = x.constant GROUP BY x.call_id) y)"
    named = _one(f"SELECT a.call_id, 0 AS o, s.file, s.target FROM homes a JOIN s ON s.member = a.member AND s.file = a.file WHERE s.target = a.member OR ends_with(s.target, '.' || a.member)")
    up = _along(f"SELECT call_id, member, constant AS start FROM homes WHERE call_id NOT IN (SELECT call_id FROM {named} nn)", ".", False)
    found = _both(named, up)
    weak = f"SELECT call_id, 'deferred', file, NULL FROM homes WHERE call_id NOT IN (SELECT call_id FROM {found} ff)"
    req = "(SELECT call_id, member, min(wanted) AS goal FROM (SELECT x.call_id, x.member, i.import_text || '.rb' AS wanted, row_number() OVER (PARTITION BY x.call_id ORDER BY i.position) AS nth FROM c x JOIN i ON i.rel_path = x.rel_path AND i.import_text = x.receiver) y WHERE nth = 1 GROUP BY ALL)"
    files = f"(SELECT q.call_id, q.member, arg_min(f.file, {{'n': length(f.file), 'f': f.file}}) AS file FROM {req} q JOIN (SELECT DISTINCT file FROM every UNION SELECT DISTINCT rel_path FROM c) f ON f.file = q.goal OR ends_with(f.file, '/' || q.goal) GROUP BY q.call_id, q.member)"
    lib = _one("SELECT q.call_id, 0 AS o, s.file, s.target FROM rq q JOIN s ON s.member = q.member AND s.file = q.file")
    made = "SELECT call_id, member, regexp_extract(receiver, '^([A-Z][\\w:]*)\\.new', 1) AS start FROM c WHERE regexp_matches(receiver, '^[A-Z][\\w:]*\\.new(\\(.*\\))?$')"
    pair = "(SELECT * REPLACE (regexp_extract(receiver, '^(\\w+)\\.', 1) AS receiver), regexp_extract(receiver, '\\.(\\w+[?!]?)$', 1) AS through FROM c WHERE regexp_matches(receiver, '^\\w+\\.\\w+[?!]?$'))"
    chained = f"SELECT call_id, member, start FROM ({made}) m1 UNION ALL SELECT x.call_id, x.member, r.type FROM {_bound('b', 'type', pair)} x JOIN r ON r.function = x.found || '#' || x.through"
    builders = "|".join(RELATION_BUILDERS)
    nothing = f"SELECT call_id, 'drop', NULL, NULL FROM c WHERE regexp_matches(receiver, '\\.(?:{builders})\\(')"
    conv = f"SELECT call_id, member, {_camel('receiver')} AS start FROM c WHERE regexp_matches(receiver, '^[a-z_]\\w*$') AND receiver <> 'self' AND call_id NOT IN (SELECT call_id FROM {local} lo) AND {_camel('receiver')} IN {known}"
    own = _along("SELECT *, scope AS start FROM c WHERE receiver IS NULL AND scope IS NOT NULL")
    hosts = "SELECT x.call_id, x.member, h.source_fq_name AS host FROM c x JOIN h ON h.ancestor_fq_name = x.scope AND h.kind IN ('include', 'prepend', 'extend') WHERE x.receiver IS NULL AND x.call_id NOT IN (SELECT call_id FROM ow)"
    each = _along(f"SELECT call_id || '|' || host AS call_id, member, host AS start FROM ({hosts}) hh")
    agreed = _one(f"SELECT split_part(call_id, '|', 1)::BIGINT AS call_id, 0 AS o, file, target FROM {each} ea")
    rest = _one("SELECT x.call_id, unnest(CASE WHEN ends_with(s.target, '#' || x.member) OR s.target = x.member THEN [0, 1] ELSE [1] END) AS o, s.file, s.target FROM c x JOIN s ON s.member = x.member WHERE x.receiver IS NULL AND x.call_id NOT IN (SELECT call_id FROM ow) AND x.call_id NOT IN (SELECT call_id FROM ag)")
    column = _one("SELECT z.call_id, z.lvl AS o, e.file, e.target FROM (SELECT call_id, member, scope AS type, 0 AS lvl FROM c WHERE receiver IS NULL AND scope IS NOT NULL UNION ALL SELECT x.call_id, x.member, anc.ancestor, len(anc.rank) FROM c x JOIN anc ON anc.scope = x.scope WHERE x.receiver IS NULL) z JOIN every e ON e.is_column AND e.in_scope = z.type AND e.member = z.member")
    returned = f"SELECT x.call_id, x.member, r.type AS start FROM {_bound('cb', 'function')} x JOIN r ON r.function = x.found"
    types = f"(SELECT * FROM {_along(f'SELECT *, found AS start FROM {local} l1 WHERE NOT klass')} la UNION ALL SELECT * FROM {_along(f'SELECT *, found AS start FROM {local} l2 WHERE klass', '.')} lb)"
    return [
        ("super", f"su AS MATERIALIZED {_both(_along(sup, '#', False), near)}", _rows("su", sup, "drop")), ("selfMember", "", _rows(_along(me, "#."), me, "drop")), ("localType", f"lt AS MATERIALIZED {types}", _rows("lt", f"SELECT * FROM {local} l3", "drop")),
        ("ivarField", f"iv AS MATERIALIZED {ivars}", _rows("iv", ivar, "drop")), ("returnTypeBinding", "", _rows(_along(returned, "#."))), ("enqueueDispatch", "", _rows(_along(f"SELECT call_id, {job} AS member, receiver AS start FROM c WHERE receiver IS NOT NULL AND member IN ({verbs})"))),
        ("selfDispatchEntry", "", _rows(entry)), ("constant", f"homes AS MATERIALIZED {at}", f"{_rows(found)} UNION ALL {weak}"), ("explicitRequire", f"rq AS MATERIALIZED {files}", f"{_rows(lib)} UNION ALL SELECT call_id, 'deferred', file, NULL FROM rq WHERE call_id NOT IN (SELECT call_id FROM {lib} li)"),
        ("chainType", f"ch AS MATERIALIZED ({chained})", _rows(_along("SELECT * FROM ch"), "SELECT * FROM ch", "drop")), ("arRelationGuard", "", nothing.replace("'drop', NULL, NULL", "'drop' AS v, NULL AS file, NULL AS target")), ("conventionReceiver", "", _rows(_along(conv))),
        ("receiverSetDrop", "", "SELECT call_id, 'drop' AS v, NULL AS file, NULL AS target FROM c WHERE receiver IS NOT NULL"), ("bareCall", f"ow AS MATERIALIZED {own}, ag AS MATERIALIZED {agreed}", f"{_rows('ow')} UNION ALL {_rows('ag')} UNION ALL {_rows(rest)}"), ("schemaColumn", "", _rows(column)),
    ]


def sql() -> str:
    """(call_id, outcome, file, target, strategy) of the chain."""
    t = tables()
    body = f"""WITH RECURSIVE c AS MATERIALIZED ({t['calls']}), every AS MATERIALIZED (SELECT rel_path AS file, symbol_id AS target, short_name AS member, scope AS in_scope, is_column FROM ({t['symbols']}) x), s AS MATERIALIZED (SELECT * FROM every WHERE NOT is_column), i AS MATERIALIZED ({t['imports']}),
b AS MATERIALIZED ({t['bindings']}), fld AS MATERIALIZED ({t['fields']}), h AS MATERIALIZED ({t['inheritance']}), r AS MATERIALIZED ({t['returns']}), cb AS MATERIALIZED ({t['call_bindings']}),
paths AS (SELECT source_fq_name AS scope, ancestor_fq_name AS ancestor, [ordinal + 1] AS rank FROM h WHERE source_fq_name <> ancestor_fq_name UNION SELECT paths.scope, h.ancestor_fq_name, list_append(rank, ordinal + 1) FROM paths JOIN h ON h.source_fq_name = paths.ancestor AND h.ancestor_fq_name <> paths.scope AND h.source_fq_name <> h.ancestor_fq_name WHERE len(rank) < 20),
anc AS MATERIALIZED (SELECT scope, ancestor, min({{'n': len(rank), 'rank': rank}}).rank AS rank FROM paths GROUP BY scope, ancestor)"""
    made = _chain()
    for k, (name, helpers, rows) in enumerate(made):
        body += (f",\n{helpers}" if helpers else "") + f",\nv{k} AS MATERIALIZED (SELECT call_id, {k} AS pr, v, file, target, '{name}' AS who FROM ({rows}) x)"
    every = " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(len(made)))
    return f"""{body}, v AS ({every}), stop AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY pr, v) AS nth FROM v WHERE v IN ('resolved', 'drop')), park AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY pr, file) AS nth FROM v WHERE v = 'deferred'),
j AS (SELECT c.call_id, a.v, a.file, a.target, a.who, p.file AS pfile, p.who AS pwho, p.call_id IS NOT NULL AND (a.pr IS NULL OR p.pr < a.pr) AS early FROM c LEFT JOIN stop a ON a.call_id = c.call_id AND a.nth = 1 LEFT JOIN park p ON p.call_id = c.call_id AND p.nth = 1)
SELECT call_id, CASE WHEN v = 'resolved' OR early THEN 'resolved' WHEN v = 'drop' THEN 'dropped' ELSE 'unresolved' END AS outcome, CASE WHEN v = 'resolved' THEN file WHEN early THEN pfile END AS file, CASE WHEN v = 'resolved' THEN target END AS target, CASE WHEN v = 'resolved' THEN who WHEN early THEN pwho END AS strategy FROM j"""


def fan_out_sql() -> str:
    """(call_id, gate, n_candidates, target, confidence) of calls that the chain leaves open."""
    t = tables()
    builders, duck = "|".join(RELATION_BUILDERS), ", ".join(f"'{m}'" for m in DUCK_MEMBERS)
    first = "[A-Z\"''\\[{0-9:@]"
    bound = "SELECT c.call_id FROM c JOIN b ON b.rel_path = c.rel_path AND b.owner IS NOT DISTINCT FROM c.source_symbol_id AND b.name = c.receiver AND b.line <= c.line"
    gate = f"""CASE WHEN receiver IS NULL THEN 'bare' WHEN receiver IN ('self', 'this', 'super') OR (regexp_matches(receiver, '^{first}') AND NOT contains(receiver, '.')) THEN 'shape' WHEN call_id IN ({bound}) THEN 'typed' WHEN regexp_matches(receiver, '\\.(?:{builders})\\(') THEN 'relation'
WHEN ends_with(receiver, ']') THEN 'index' WHEN contains(receiver, '.') AND regexp_matches(receiver, '^[A-Z]') AND split_part(receiver, '.', 1) NOT IN (SELECT target FROM every) THEN 'outside' WHEN regexp_matches(receiver, '^{first}') THEN 'shape' WHEN member IN ({duck}) THEN 'duck' END"""
    fits = "(s.min_args IS NULL OR (x.n_args >= s.min_args AND (s.splat OR x.n_args <= s.max_args))) AND s.visibility <> 'private'"
    return f"""WITH done AS MATERIALIZED (SELECT call_id FROM ({sql()}) d WHERE outcome = 'resolved'), c AS MATERIALIZED ({t['calls']}), every AS MATERIALIZED (SELECT rel_path AS file, symbol_id AS target, short_name AS member, scope AS in_scope, * EXCLUDE (rel_path, symbol_id, short_name, scope) FROM ({ARITY.format(t['symbols'])}) x), b AS ({t['bindings']}),
o AS MATERIALIZED (SELECT *, {gate} AS gate FROM c WHERE call_id NOT IN (SELECT call_id FROM done)),
k AS (SELECT greatest(16, list_sort(list(n))[least(ceil(count(*) * 0.990000000001)::INT, count(*))]) AS cap FROM (SELECT count(*) AS n FROM every GROUP BY member) z),
m AS MATERIALIZED (SELECT x.call_id, s.file, s.target, s.accepts_block, x.has_block, max(s.accepts_block::INT) OVER (PARTITION BY x.call_id) AS any_block FROM o x JOIN every s ON s.member = x.member AND s.in_scope IS NOT NULL AND NOT s.is_column WHERE x.gate IS NULL AND {fits}),
f AS MATERIALIZED (SELECT call_id, target, count(*) OVER (PARTITION BY call_id) AS n FROM m WHERE NOT (has_block AND any_block = 1) OR accepts_block)
SELECT call_id, gate, NULL::BIGINT AS n_candidates, NULL AS target, NULL::DOUBLE AS confidence FROM o WHERE gate IS NOT NULL
UNION ALL SELECT call_id, NULL, n, target, CASE WHEN n = 1 THEN 1.0 ELSE 0.5 / n END FROM f, k WHERE n <= cap UNION ALL SELECT DISTINCT call_id, NULL, NULL::BIGINT, NULL, NULL::DOUBLE FROM f, k WHERE n > cap"""
