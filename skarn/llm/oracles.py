"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from . import license_scan
from .quality_rules import Rules

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first_id,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (k // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM d"""

OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[j : j + least(10, len(w)) - 1], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS j FROM i WHERE len(w) > 0) x),
ks AS (SELECT DISTINCT k FROM iw), dw AS (SELECT doc_id, k, j, array_to_string(w[j : j + k - 1], ' ') AS t FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, ks) x),
h AS (SELECT doc_id, j, k, item_id FROM dw JOIN iw USING (k, t)), n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM h) x GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def _op6(rules: Rules) -> str:
    lengths = sorted({rules.window, *(n for n, _ in rules.max_gram_share)})
    parts = []
    for n in lengths:
        parts.append(f"""g{n} AS (SELECT doc_id, j, count(*) OVER (PARTITION BY doc_id, hash(w[j : j + {n - 1}])) AS times FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS j FROM d) x),
c{n} AS (SELECT doc_id, count(*) AS words, sum(length(w[p])) AS chars FROM (SELECT DISTINCT doc_id, unnest(range(j, j + {n})) AS p FROM g{n} WHERE times > 1) x JOIN d USING (doc_id) GROUP BY doc_id)""")
    verdict = " AND ".join(f"coalesce(c{n}.chars, 0) / greatest(word_chars, 1)::DOUBLE <= {limit}" for n, limit in rules.max_gram_share)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents), {', '.join(parts)},
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS r, count(*) OVER (PARTITION BY doc_id, line) AS times FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) x WHERE regexp_matches(line, '{_SPACED}')),
k AS (SELECT doc_id, count(*) FILTER (WHERE r > 1) AS n_dup_lines, coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) FILTER (WHERE times > 1), 0) AS line_chars FROM l GROUP BY doc_id),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM d),
s AS (SELECT b.*, coalesce(k.n_dup_lines, 0) AS n_dup_lines, coalesce(c{rules.window}.words, 0) AS n_repeat_words, {verdict} AND coalesce(line_chars, 0) / greatest(word_chars, 1)::DOUBLE <= {rules.max_line_share} AND n_symbols <= {rules.max_symbol_share} * greatest(word_chars, 1)::DOUBLE AS fine
  FROM b LEFT JOIN k USING (doc_id) {' '.join(f'LEFT JOIN c{n} ON c{n}.doc_id = b.doc_id' for n in lengths)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
  fine AND NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words) AS kept FROM s"""


OP6 = _op6(Rules())

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[j : j + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS j FROM d) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)), f AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS node FROM d UNION SELECT r.doc_id, f.b FROM r JOIN f ON f.a = r.node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(node) AS component_id, min(node) = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n"""



def _op11() -> str:
    every = license_scan.BASE + license_scan.NOTICES
    rows = ", ".join(f"({i}, '{t.label}', {str(t.exact).lower()}, string_split('{' '.join(license_scan._words(t.text))}', ' '))" for i, t in enumerate(every))
    k = license_scan.GRAM
    return f"""
WITH t(template, label, exact, tw) AS (VALUES {rows}), d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS base_labels FROM (SELECT doc_id, label, unnest(range(0, len(w))) AS p, w, tw FROM d, t WHERE exact) x WHERE w[p + 1 : p + len(tw)] = tw GROUP BY doc_id),
tk AS (SELECT template, k, len(tw) AS size, q, array_to_string(tw[q + 1 : q + k], ' ') AS g FROM (SELECT template, tw, least({k}, len(tw)) AS k, unnest(range(0, len(tw) - least({k}, len(tw)) + 1)) AS q FROM t WHERE NOT exact) x),
dk AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + {k}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - {k - 1})) AS p FROM d WHERE len(w) >= {k}) x),
l AS (SELECT doc_id, template, size, p - q AS diag, count(*) AS votes, min(q) AS low, max(q) AS high, count(*) = any_value(size) - {k - 1} AS whole FROM dk JOIN tk USING (g) GROUP BY doc_id, template, size, diag),
n AS (SELECT *, CASE WHEN whole OR coalesce(lag(whole) OVER w, true) OR diag - lag(diag) OVER w > {license_scan.GAP} THEN 1 ELSE 0 END AS fresh FROM l WINDOW w AS (PARTITION BY doc_id, template ORDER BY diag)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diag) AS part FROM n), v AS (SELECT *, sum(votes) OVER (PARTITION BY doc_id, template, part) AS total FROM c),
g AS (SELECT doc_id, template, part, diag, unnest(range(low, high + {k})) AS q FROM v WHERE total >= {license_scan.MIN_VOTES} * (size - {k - 1})),
m AS (SELECT doc_id, label, part, count(DISTINCT q)::DOUBLE / any_value(len(tw)) AS share FROM g JOIN d USING (doc_id) JOIN t USING (template) WHERE w[diag + q + 1] = tw[q + 1] GROUP BY doc_id, template, label, part),
f AS (SELECT doc_id, list(DISTINCT label) AS found, max(share) AS score FROM m WHERE share >= {license_scan.MIN_SHARE} GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base_labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(found, [])))), ',') AS labels, greatest(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(score, 0.0)) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)"""


OP11 = _op11()


def _op13(k: int = 16, rounds: int = 3, dimensions: int = 64) -> str:
    near = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = []
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v.x) AS x, min({{'d': {near}::BIGINT, 'c': c.c}}) AS best FROM v, c{r} c GROUP BY vec_id)")
        if r < rounds:
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, CASE WHEN n.x IS NULL THEN c.x ELSE n.x END AS x FROM c{r} c LEFT JOIN (SELECT c, list(m ORDER BY i) AS x FROM (SELECT best.c AS c, i, floor(sum(x[i]) / count(*))::BIGINT AS m FROM a{r}, (SELECT unnest(range(1, {dimensions + 1})) AS i) y GROUP BY best.c, i) z GROUP BY c) n ON n.c = c.c)")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM v ORDER BY c LIMIT {k}), {', '.join(parts)},
s AS (SELECT c, sha256(array_to_string(x, ',')) AS centroid_sha256 FROM c{rounds})
SELECT vec_id, best.c::INT AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN s ON s.c = best.c"""


OP13 = _op13()

ORACLES = {"op1_warc": OP1, "op5_decontamination": OP5, "op6_quality_rules": OP6, "op10_near_dup": OP10, "op11_license_scan": OP11, "op13_centroids": OP13}
