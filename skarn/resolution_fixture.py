"""Calls, definitions and types made by arithmetic, and the chains of call resolution over them in DuckDB SQL.

The SQL is written for itself: no strategy of ``operators.resolution`` takes part in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fixtures as X
from .operators.resolution import JAVA_LANG, Facts

EXTENSION = {"bash": "sh", "go": "go", "java": "java", "javascript": "js", "python": "py", "rust": "rs", "typescript": "ts"}
OWN = {"java": "this", "javascript": "this", "typescript": "this", "python": "self", "rust": "self", "go": "s", "bash": "x"}
_T = "'T' || CAST({} AS STRING)"


def _tables(language: str) -> dict[str, str]:
    """SQL of the facts' tables over ``part``, in a form that Spark and DuckDB share."""
    e, own = EXTENSION[language], OWN[language]
    home = lambda a: f"'d' || CAST({a} % 5 AS STRING) || '/T' || CAST({a} AS STRING) || '.{e}'"
    types = "(SELECT DISTINCT p_partkey % 20 AS a FROM part) t CROSS JOIN (SELECT DISTINCT p_partkey % 4 AS j FROM part) u"
    funcs = "(SELECT DISTINCT p_partkey % 30 AS x FROM part) t"
    imported = {
        "go": "'proj/d' || CAST((n + k) % 5 AS STRING)", "java": "'d' || CAST((n * 3 + k) % 20 % 5 AS STRING) || '.T' || CAST((n * 3 + k) % 20 AS STRING)", "python": "'d' || CAST((n * 3 + k) % 20 % 5 AS STRING) || '.T' || CAST((n * 3 + k) % 20 AS STRING)",
        "rust": "'crate::d' || CAST((n * 3 + k) % 20 % 5 AS STRING) || '::T' || CAST((n * 3 + k) % 20 AS STRING)", "bash": "'../d' || CAST((n + k) % 5 AS STRING) || '/f' || CAST((n * 2 + k) % 12 AS STRING) || '.sh'",
        "typescript": "CASE WHEN k = 2 THEN 'outside' ELSE '../d' || CAST((n * 3 + k) % 20 % 5 AS STRING) || '/T' || CAST((n * 3 + k) % 20 AS STRING) END",
    }
    imported = imported["typescript" if language == "javascript" else language]
    path = f"CASE WHEN n % 10 = 0 THEN 'd0/main.{e}' ELSE {home('n % 20')} END"
    receiver = f"""CASE n % 9 WHEN 0 THEN NULL WHEN 1 THEN '{own}' WHEN 2 THEN '{own}.fld' || CAST(n % 4 AS STRING) WHEN 3 THEN 'v' || CAST(n % 3 AS STRING) WHEN 4 THEN 'T' || CAST(n % 23 AS STRING) WHEN 5 THEN 'd' || CAST(n % 6 AS STRING) WHEN 6 THEN 'super' WHEN 7 THEN 'w' || CAST(n % 3 AS STRING) ELSE 'String' END"""
    calls = "(SELECT DISTINCT p_partkey AS n FROM part) p"
    owner = "CASE WHEN n % 10 = 0 THEN NULL ELSE 'T' || CAST(n % 20 AS STRING) || '#m0' END"
    return {
        "calls": f"SELECT n AS call_id, '{language}' AS language, {path} AS rel_path, CAST(n % 50 AS INT) AS line, {owner} AS source_symbol_id, CASE WHEN n % 10 = 0 THEN NULL ELSE {_T.format('n % 20')} END AS scope, {receiver} AS receiver, CASE WHEN n % 4 = 3 THEN 'fn' || CAST(n % 20 AS STRING) ELSE 'm' || CAST(n % 11 AS STRING) END AS member FROM {calls}",
        "symbols": f"""SELECT '{language}' AS language, {home('a')} AS rel_path, {_T.format('a')} || CASE WHEN (a + j) % 3 > 0 THEN '#' ELSE '.' END || 'm' || CAST((a * 3 + j) % 11 AS STRING) AS symbol_id, 'm' || CAST((a * 3 + j) % 11 AS STRING) AS short_name, {_T.format('a')} AS scope FROM {types}
UNION ALL SELECT DISTINCT '{language}', {home('a')}, {_T.format('a')}, {_T.format('a')}, CAST(NULL AS STRING) FROM {types} UNION ALL SELECT '{language}', 'd' || CAST(x % 5 AS STRING) || '/f' || CAST(x % 12 AS STRING) || '.{e}', 'fn' || CAST(x % 17 AS STRING), 'fn' || CAST(x % 17 AS STRING), CAST(NULL AS STRING) FROM {funcs}""",
        "imports": f"SELECT DISTINCT '{language}' AS language, {path} AS rel_path, CAST(k AS INT) AS position, {imported} AS import_text, CASE WHEN k = 2 THEN 'm3' ELSE 'T' || CAST((n * 3 + k) % 20 AS STRING) END AS name FROM (SELECT DISTINCT CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_partkey % 20 END AS n FROM part) p CROSS JOIN (SELECT DISTINCT p_partkey % 3 AS k FROM part) q",
        "bindings": f"SELECT DISTINCT {path} AS rel_path, {owner} AS owner, 'v' || CAST(k AS STRING) AS name, CAST(z * 20 AS INT) AS line, {_T.format('(n * 7 + k + z * 3) % 24')} AS type, false AS is_class FROM (SELECT DISTINCT p_partkey % 20 AS n FROM part) p CROSS JOIN (SELECT DISTINCT p_partkey % 3 AS k FROM part) q CROSS JOIN (SELECT DISTINCT p_partkey % 2 AS z FROM part) r",
        "fields": f"SELECT DISTINCT '{language}' AS language, {_T.format('a')} AS scope, 'fld' || CAST(j AS STRING) AS field, {_T.format('(a * 5 + j) % 24')} AS type FROM {types} WHERE j < 3",
        "inheritance": f"SELECT DISTINCT '{language}' AS language, {_T.format('a')} AS source_fq_name, {_T.format('CAST(floor(a / 2) AS BIGINT)')} AS ancestor_fq_name, 'extends' AS kind, 0 AS ordinal FROM {types} WHERE a > 1",
        "returns": f"SELECT DISTINCT '{language}' AS language, 'make' || CAST(a % 9 AS STRING) AS function, {_T.format('a % 9 + 14')} AS type FROM {types}",
        "call_bindings": f"SELECT DISTINCT {path} AS rel_path, {owner} AS owner, 'w' || CAST(k AS STRING) AS name, CAST(5 AS INT) AS line, 'make' || CAST((n + k) % 11 AS STRING) AS function FROM (SELECT DISTINCT p_partkey % 20 AS n FROM part) p CROSS JOIN (SELECT DISTINCT p_partkey % 3 AS k FROM part) q",
    }


def facts(spark: SparkSession, sf_dir: str, language: str) -> Facts:
    from pyspark.sql import functions as F

    made: dict[str, DataFrame] = {k: X.frame(spark, sf_dir, sql, "part") for k, sql in _tables(language).items()}
    made["imports"] = made["imports"].withColumn("names", F.array("name")).drop("name")
    return Facts(**made)


# -- the same chains in SQL --------------------------------------------------------


def _sole(candidates: str, order: str = "0") -> str:
    """Calls with one candidate in the first order that has just one."""
    return f"(SELECT call_id, file, target FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY o) AS n FROM (SELECT call_id, {order} AS o, min(file) AS file, min(target) AS target FROM (SELECT DISTINCT * FROM ({candidates}) q0) q1 GROUP BY call_id, o HAVING count(*) = 1) q2) q3 WHERE n = 1)"


def _of_type(calls: str, order: str = "0") -> str:
    """The member of each call's type: the instance's before the class's."""
    return _sole(f"SELECT call_id, {order} * 2 + step AS o, s.file, s.target FROM (SELECT *, 0 AS step, type || '#' || member AS t FROM ({calls}) a0 UNION ALL SELECT *, 1, type || '.' || member FROM ({calls}) a1) a JOIN s ON s.target = a.t", "o")


def _up(calls: str, itself: bool) -> str:
    """The member on a type above (or on it), the nearest that has it; ``calls`` has ``start``."""
    own = f" UNION ALL SELECT *, start AS type, 0 AS depth FROM ({calls}) b0" if itself else ""
    return _of_type(f"SELECT b.*, anc.ancestor AS type, anc.depth FROM ({calls}) b JOIN anc ON anc.scope = b.start{own}", "depth")


def _bound(table: str, value: str) -> str:
    return f"(SELECT * FROM (SELECT c.*, t.{value} AS type, row_number() OVER (PARTITION BY c.call_id ORDER BY t.line DESC, t.{value}) AS n FROM c JOIN {table} t ON t.rel_path = c.rel_path AND t.owner IS NOT DISTINCT FROM c.source_symbol_id AND t.name = c.receiver AND t.line <= c.line) z WHERE n = 1)"


def _first(match: str) -> str:
    """Calls with the first import that matches."""
    return f"(SELECT * FROM (SELECT c.*, i.import_text, i.name, i.file AS wanted, row_number() OVER (PARTITION BY c.call_id ORDER BY i.position) AS n FROM c JOIN i ON i.rel_path = c.rel_path WHERE {match}) z WHERE n = 1)"


_OWN_FILE = "SELECT call_id, step AS o, s.file, s.target FROM (SELECT *, 0 AS step, scope || '#' || member AS t FROM c UNION ALL SELECT *, 1, scope || '.' || member FROM c) a JOIN s ON s.target = a.t AND s.file = a.rel_path WHERE {}"
_BARE, _WITH = "receiver IS NULL", "receiver IS NOT NULL"
_NAME = "SELECT c.call_id, s.file, s.target FROM c JOIN s ON s.member = c.member WHERE {}"


def _rows(found: str, applies: str | None = None, otherwise: str | None = None, verdict: str = "resolved") -> str:
    out = f"SELECT call_id, '{verdict}' AS v, file, target FROM {found} f"
    if applies and otherwise:
        out += f" UNION ALL SELECT DISTINCT call_id, '{otherwise}', NULL, NULL FROM ({applies}) g WHERE call_id NOT IN (SELECT call_id FROM {found} h)"
    return out


def _named(found: str, applies: str) -> str:
    """What is found, and for the rest the type's name with the member."""
    return f"(SELECT * FROM {found} f0 UNION ALL SELECT call_id, type, type || '#' || member FROM ({applies}) g0 WHERE call_id NOT IN (SELECT call_id FROM {found} h0))"


def _chain(language: str) -> list[tuple[str, str]]:
    own = OWN[language]
    fields = f"SELECT c.*, fld.type FROM c LEFT JOIN fld ON fld.scope = c.scope AND fld.field = substr(c.receiver, {len(own) + 2}) WHERE c.receiver LIKE '{own}.%' AND c.scope IS NOT NULL AND position('.' IN substr(c.receiver, {len(own) + 2})) = 0"
    known = f"SELECT * FROM ({fields}) k WHERE type IS NOT NULL"
    bound = f"SELECT * FROM {_bound('b', 'type')} y"
    returned = f"SELECT y.* EXCLUDE (type), r.type FROM {_bound('cb', 'function')} y JOIN r ON r.function = y.type"
    everywhere = _sole(_NAME.format("true"))
    if language == "bash":
        near = _sole(f"SELECT c.call_id, s.file, s.target FROM c JOIN s ON s.member = c.member JOIN i ON i.rel_path = c.rel_path AND i.file = s.file WHERE c.call_id NOT IN (SELECT call_id FROM {everywhere} e)")
        return [("globalShortName", f"{_rows(everywhere)} UNION ALL {_rows(near)}")]
    if language == "go":
        defined = f"SELECT * FROM ({returned}) d WHERE type IN (SELECT target FROM s UNION SELECT member FROM s)"
        package = _sole(f"SELECT p.call_id, s.file, s.target FROM {_first('split_part(i.import_text, chr(47), -1) = c.receiver')} p JOIN s ON s.member = p.member AND contains(s.file, regexp_replace(p.import_text, '^\\./', ''))")
        return [("localBinding", _rows(_of_type(bound), bound, "drop")), ("returnTypeBinding", _rows(_of_type(defined), defined, "drop")), ("importMatch", _rows(package)), ("receiverDrop", f"SELECT call_id, 'drop' AS v, NULL AS file, NULL AS target FROM c WHERE {_WITH}"), ("globalShortName", _rows(_sole(_NAME.format(_BARE))))]
    if language == "java":
        imp = _first("split_part(i.import_text, '.', -1) = c.receiver")
        inside = _sole(f"SELECT p.call_id, s.file, s.target FROM {imp} p JOIN s ON s.member = p.member AND (s.file = p.wanted OR ends_with(s.file, '/' || p.wanted))")
        a = f"(SELECT * FROM {inside} x1 UNION ALL SELECT call_id, wanted, NULL FROM {imp} x2 WHERE call_id NOT IN (SELECT call_id FROM {inside} x3))"
        scoped = f"(SELECT * FROM {_sole(_NAME.format('s.in_scope = c.receiver'))} x4 WHERE call_id NOT IN (SELECT call_id FROM {a} x5))"
        core = f"(SELECT call_id, receiver AS file, receiver || '.' || member AS target FROM c WHERE receiver IN ({', '.join(repr(x) for x in JAVA_LANG)}) AND call_id NOT IN (SELECT call_id FROM {a} x6) AND call_id NOT IN (SELECT call_id FROM {scoped} x7))"
        three = f"(SELECT * FROM {a} y1 UNION ALL SELECT * FROM {scoped} y2 UNION ALL SELECT * FROM {core} y3)"
        return [
            ("thisMember", _rows(_sole(_OWN_FILE.format("receiver = 'this'"), "o"))), ("fieldType", _rows(_named(_of_type(known), known))), ("localBinding", _rows(_named(_of_type(bound), bound))), ("importReceiver", _rows(three, f"SELECT * FROM c WHERE {_WITH}", "drop")),
            ("enclosingBareCall", _rows(_sole(_OWN_FILE.format(_BARE), "o"))), ("globalShortName", _rows(everywhere)),
        ]
    if language == "rust":
        both = f"SELECT call_id, step * 2 + mine AS o, file, target FROM (SELECT a.call_id, step, s.file, s.target, unnest(CASE WHEN s.file = a.rel_path THEN [0, 1] ELSE [1] END) AS mine FROM (SELECT *, 0 AS step, type || '#' || member AS t FROM ({bound}) a0 UNION ALL SELECT *, 1, type || '.' || member FROM ({bound}) a1) a JOIN s ON s.target = a.t) w"
        use = _first("split_part(i.import_text, '::', -1) = c.receiver")
        module = _sole(f"SELECT p.call_id, s.file, s.target FROM {use} p JOIN s ON s.member = p.member AND ends_with(s.file, replace(regexp_replace(p.import_text, '^crate::', ''), '::', '/') || '.rs')")
        field = _rows(_of_type(known), known, "drop") + f" UNION ALL SELECT call_id, 'drop', NULL, NULL FROM ({fields}) k2 WHERE type IS NULL"
        return [("selfMethod", _rows(_sole(_OWN_FILE.format("receiver = 'self'"), "o"))), ("selfField", field), ("localBinding", _rows(_sole(both, "o"), bound, "drop")), ("importMatch", _rows(module)), ("bareSelfMethod", _rows(_sole(_OWN_FILE.format(_BARE), "o"))), ("globalShortName", _rows(everywhere))]
    if language == "python":
        sup = "SELECT *, scope AS start FROM c WHERE receiver = 'super'"
        me = "SELECT *, scope AS start FROM c WHERE receiver = 'self' AND scope IS NOT NULL"
        field = _rows(_named(_of_type(known), known)) + f" UNION ALL SELECT call_id, 'drop', NULL, NULL FROM ({fields}) k2 WHERE type IS NULL"
        defs = f"SELECT y.call_id, y.rel_path, s.file FROM ({bound}) y JOIN s ON s.member = y.type"
        one = f"SELECT call_id, min(file) AS file FROM ({defs}) d GROUP BY call_id HAVING count(*) = 1"
        many = f"SELECT d.call_id, min(d.file) AS file FROM ({defs}) d WHERE d.call_id IN (SELECT call_id FROM ({defs}) d2 GROUP BY 1 HAVING count(*) > 1) AND (d.rel_path, d.file) IN (SELECT (rel_path, file) FROM i) GROUP BY d.call_id HAVING count(*) = 1"
        none = f"SELECT y.call_id, arg_min(i.file, i.position) AS file FROM ({bound}) y JOIN i ON i.rel_path = y.rel_path AND split_part(i.import_text, '.', -1) = y.type WHERE y.call_id NOT IN (SELECT call_id FROM ({defs}) d3) GROUP BY y.call_id"
        at = f"({one} UNION ALL {many} UNION ALL {none})"
        first = _sole(f"SELECT y.call_id, s.file, s.target FROM ({bound}) y JOIN {at} w ON w.call_id = y.call_id JOIN s ON s.member = y.member AND s.file = w.file AND s.in_scope = y.type")
        rest = f"SELECT y.*, y.type AS start, w.file AS home FROM ({bound}) y JOIN {at} w ON w.call_id = y.call_id WHERE y.call_id NOT IN (SELECT call_id FROM {first} f1)"
        above = _up(f"SELECT * EXCLUDE (type) FROM ({rest}) u", False)
        three = f"(SELECT * FROM {first} g1 UNION ALL SELECT * FROM {above} g2 UNION ALL SELECT call_id, home, NULL FROM ({rest}) g3 WHERE call_id NOT IN (SELECT call_id FROM {above} g4))"
        imp = _first("split_part(i.import_text, '.', -1) = c.receiver")
        mod = _sole(f"SELECT p.call_id, s.file, s.target FROM {imp} p JOIN s ON s.member = p.member AND s.file = p.wanted")
        either = f"(SELECT * FROM {mod} e1 UNION ALL SELECT call_id, wanted, NULL FROM {imp} e2 WHERE call_id NOT IN (SELECT call_id FROM {mod} e3))"
        return [("super", _rows(_up(sup, False), sup, "drop")), ("selfField", field), ("selfMember", _rows(_up(me, True), me, "drop")), ("localBinding", _rows(three, bound, "drop")), ("importMatch", _rows(either)), ("globalShortName", _rows(everywhere))]
    sup = "SELECT *, scope AS start FROM c WHERE receiver = 'super'"
    near = f"SELECT c.call_id, s.file, row_number() OVER (PARTITION BY c.call_id ORDER BY anc.depth, s.file) AS n FROM c JOIN anc ON anc.scope = c.scope JOIN s ON s.target = anc.ancestor AND s.in_scope IS NULL WHERE c.receiver = 'super' AND c.call_id NOT IN (SELECT call_id FROM {_up(sup, False)} u0)"
    supers = f"(SELECT * FROM {_up(sup, False)} u1 UNION ALL SELECT call_id, file, NULL FROM ({near}) u2 WHERE n = 1)"
    this = _sole(_OWN_FILE.format("receiver = 'this'"), "o")
    thing = f"(SELECT * FROM {this} t1 UNION ALL SELECT call_id, split_part(m, '|', 1), split_part(m, '|', 2) FROM (SELECT c.call_id, min(s.file || '|' || s.target) AS m FROM c JOIN s ON s.member = c.member AND s.file = c.rel_path WHERE c.receiver = 'this' AND c.scope IS NOT NULL AND c.call_id NOT IN (SELECT call_id FROM {this} t2) GROUP BY c.call_id) t3)"
    named = f"(SELECT * FROM {_first('i.name = c.receiver')} n0 WHERE wanted IS NOT NULL)"
    origin = f"SELECT p.*, coalesce((SELECT CASE WHEN count(DISTINCT s.file) = 1 AND max((s.file = p.wanted)::INT) = 0 THEN min(s.file) END FROM s WHERE s.target = p.receiver), p.wanted) AS goal FROM {named} p"
    inside = _sole(f"SELECT p.call_id, unnest(CASE WHEN s.in_scope = p.receiver THEN [0, 1] ELSE [1] END) AS o, s.file, s.target FROM ({origin}) p JOIN s ON s.member = p.member AND s.file = p.goal", "o")
    by_import = f"{_rows(inside)} UNION ALL SELECT call_id, 'deferred', goal, NULL FROM ({origin}) p9 WHERE call_id NOT IN (SELECT call_id FROM {inside} p8)"
    base = f"(SELECT * FROM {_first('lower(split_part(i.import_text, chr(47), -1)) = lower(c.receiver)')} n1 WHERE wanted IS NOT NULL)"
    based = _sole(f"SELECT p.call_id, s.file, s.target FROM {base} p JOIN s ON s.member = p.member AND s.file = p.wanted")
    by_base = f"{_rows(based)} UNION ALL SELECT call_id, 'deferred', wanted, NULL FROM {base} q9 WHERE call_id NOT IN (SELECT call_id FROM {based} q8)"
    homes = f"(SELECT c.call_id, c.member, c.receiver, min(s.file) AS wanted FROM c JOIN s ON s.target = c.receiver JOIN i ON i.rel_path = c.rel_path AND i.file = s.file WHERE {_WITH} GROUP BY ALL HAVING count(DISTINCT s.file) = 1)"
    there = _sole(f"SELECT p.call_id, s.file, s.target FROM {homes} p JOIN s ON s.member = p.member AND s.file = p.wanted AND s.in_scope = p.receiver")
    by_symbol = f"{_rows(there)} UNION ALL SELECT call_id, 'deferred', wanted, NULL FROM {homes} r9 WHERE call_id NOT IN (SELECT call_id FROM {there} r8)"
    inner = "(SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.rel_path = c.rel_path AND i.file IS NULL AND i.name = coalesce(regexp_extract(c.receiver, '^([^.]+)', 1), c.member)))"
    glob = _sole(f"SELECT x.call_id, s.file, s.target FROM {inner} x JOIN s ON s.member = x.member")
    narrow = _sole(f"SELECT x.call_id, s.file, s.target FROM {inner} x JOIN s ON s.member = x.member JOIN i ON i.rel_path = x.rel_path AND i.file = s.file")
    same = _sole(_NAME.format("s.file = c.rel_path AND (c.receiver IS NULL OR (regexp_matches(c.receiver, '^[A-Z]') AND s.in_scope = c.receiver))"))
    return [
        ("super", _rows(supers, sup, "drop")), ("thisMember", _rows(thing)), ("fieldType", _rows(_of_type(known))), ("localBinding", _rows(_of_type(bound))), ("namedImport", by_import), ("importBasename", by_base), ("receiverSymbol", by_symbol), ("sameFile", _rows(same)),
        ("globalShortName", _rows(glob)), ("importNarrowedFallback", _rows(narrow)), ("returnTypeInference", _rows(_of_type(returned))),
    ]


def sql(language: str) -> str:
    """(call_id, outcome, file, target, by) of the language's chain."""
    t, e = _tables(language), EXTENSION[language]
    file = {
        "python": "replace(import_text, '.', '/') || '.py'", "java": "replace(import_text, '.', '/') || '.java'", "bash": "regexp_replace(import_text, '^\\.\\./', '')", "rust": "NULL", "go": "NULL",
        "typescript": f"CASE WHEN import_text <> 'outside' THEN regexp_replace(import_text, '^\\.\\./', '') || '.{e}' END",
    }["typescript" if language == "javascript" else language]
    made = _chain(language)
    body = f"""WITH RECURSIVE c AS MATERIALIZED ({t['calls']}), s AS MATERIALIZED (SELECT rel_path AS file, symbol_id AS target, short_name AS member, scope AS in_scope FROM ({t['symbols']}) x), i AS MATERIALIZED (SELECT *, {file} AS file FROM ({t['imports']}) x),
b AS MATERIALIZED ({t['bindings']}), fld AS MATERIALIZED ({t['fields']}), h AS MATERIALIZED ({t['inheritance']}), r AS MATERIALIZED ({t['returns']}), cb AS MATERIALIZED ({t['call_bindings']}),
anc AS (SELECT source_fq_name AS scope, ancestor_fq_name AS ancestor, 1 AS depth FROM h UNION SELECT anc.scope, h.ancestor_fq_name, depth + 1 FROM anc JOIN h ON h.source_fq_name = anc.ancestor WHERE depth < 20)"""
    for k, (name, rows) in enumerate(made):
        body += f",\nv{k} AS MATERIALIZED (SELECT call_id, {k} AS pr, v, file, target, '{name}' AS who FROM ({rows}) x)"
    every = " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(len(made)))
    return f"""{body}, v AS ({every}), stop AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY pr, v) AS n FROM v WHERE v IN ('resolved', 'drop')), park AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY pr, file) AS n FROM v WHERE v = 'deferred'),
j AS (SELECT c.call_id, a.v, a.file, a.target, a.who, p.file AS pfile, p.who AS pwho, p.call_id IS NOT NULL AND (a.pr IS NULL OR p.pr < a.pr) AS early FROM c LEFT JOIN stop a ON a.call_id = c.call_id AND a.n = 1 LEFT JOIN park p ON p.call_id = c.call_id AND p.n = 1)
SELECT call_id, CASE WHEN v = 'resolved' OR early THEN 'resolved' WHEN v = 'drop' THEN 'dropped' ELSE 'unresolved' END AS outcome, CASE WHEN v = 'resolved' THEN file WHEN early THEN pfile END AS file, CASE WHEN v = 'resolved' THEN target END AS target, CASE WHEN v = 'resolved' THEN who WHEN early THEN pwho END AS strategy FROM j"""
