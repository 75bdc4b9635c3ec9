"""Licence scan, whitening and delta Lloyd against plain versions and edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.llm import centroids, license_scan, whitening

SF = "/root/testdata/sf0.001"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


# -- licence scan ------------------------------------------------------------------


def plain_scan(text):
    """Base places by comparing at every position; notices by counting along diagonals."""
    w = words(text)
    base = [(p, t.label) for t in license_scan.BASE for p in range(len(w)) if w[p : p + len(words(t.text))] == words(t.text)]
    found, best = {x for _, x in base}, 1.0 if base else 0.0
    for t in license_scan.NOTICES:
        tw = words(t.text)
        k = min(license_scan.GRAM, len(tw))
        lines = {}
        for q in range(len(tw) - k + 1):
            for p in range(len(w) - k + 1):
                if w[p : p + k] == tw[q : q + k]:
                    lines.setdefault(p - q, set()).add(q)
        parts, before, whole_before = [], None, True
        for d in sorted(lines):
            whole = len(lines[d]) == len(tw) - k + 1
            if before is None or whole or whole_before or d - before > license_scan.GAP:
                parts.append([])
            parts[-1].append(d)
            before, whole_before = d, whole
        for part in parts:
            if sum(len(lines[d]) for d in part) < license_scan.MIN_VOTES * (len(tw) - k + 1):
                continue
            met = {q for d in part for q in range(min(lines[d]), max(lines[d]) + k) if 0 <= d + q < len(w) and w[d + q] == tw[q]}
            if len(met) / len(tw) >= license_scan.MIN_SHARE:
                found.add(t.label)
                best = max(best, len(met) / len(tw))
    return len(w), len(base), min((p for p, _ in base), default=None), max((p for p, _ in base), default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(found)), best


def noisy(text, seed, rate):
    """Words changed, left out and put in."""
    r = random.Random(seed)
    out = []
    for w in text.split():
        x = r.random()
        if x < rate:
            out.append(r.choice(["foo", "bar", "baz"]))
        elif x < 2 * rate:
            continue
        elif x < 3 * rate:
            out += [w, "extra"]
        else:
            out.append(w)
    return " ".join(out)


def cases():
    notices = [t.text for t in license_scan.NOTICES]
    rows = [None, "", " \n", "mit", "MIT License", "mit license mit license mit licenses", "the Apache-License of the GNU General\nPublic License", "x " * 3000 + "Released under the MIT license " + "y " * 3000]
    rows += notices + [" ".join(notices), " ".join(reversed(notices)), notices[1][:200], notices[1] + " " + notices[1]]
    rows += [f"before it {noisy(t, i, rate)} after it" for i, t in enumerate(notices) for rate in (0.01, 0.03, 0.1)]
    return rows


def test_licences_against_a_plain_scan(spark):
    rows = list(enumerate(cases()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in license_scan.scan(df).drop("spans").collect()}
    for i, text in rows:
        assert got[i][:6] == plain_scan(text)[:6], text
        assert got[i][6] == pytest.approx(plain_scan(text)[6])
    labels = [got[i][5] for i, t in rows if t and t.startswith("before it")]
    assert sum(x != "" for x in labels[::3]) >= 0.8 * len(labels[::3])  # one word in a hundred altered


def test_licence_spans_and_own_templates(spark):
    text = "intro words here. " + license_scan.NOTICES[1].text.replace("without limitation", "with no limits at all") + " the end"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    (r,) = license_scan.scan(df).collect()
    (s,) = [s for s in r.spans if s.label == "mit"]
    assert (s.start, s.end) == (3, len(words(text)) - 2) and 0.9 < s.share < 1 and r.labels == "mit" and r.n_base == 0
    own = [license_scan.Template("house", "all rights belong to the house of words and numbers")]
    (r,) = license_scan.scan(df.withColumn("text", F.lit("yes: ALL rights belong to the house of words, and numbers!")), own).collect()
    assert r.labels == "house" and r.score == 1.0 and [(s.start, s.end) for s in r.spans] == [(1, 11)]


def test_licence_edges(spark):
    """Null and repeated ids, repeated rows, clashing names, one text in many rows, empty table."""
    rows = [(None, "mit license"), (None, "gpl"), (1, "apache license"), (1, "apache license"), (1, "mit license")] + [(2, "the mit license")] * 300
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("found", F.lit(1)).withColumn("salt", F.lit("x")).withColumn("copy", F.lit(None).cast("int"))
    out = [tuple(r) for r in license_scan.scan(df).select("doc_id", "n_base", "labels").collect()]
    assert len(out) == len(rows) and out.count((1, 1, "apache")) == 2 and out.count((1, 1, "mit")) == 1 and out.count((None, 1, "mit")) == 1 and out.count((None, 0, "")) == 1 and out.count((2, 1, "mit")) == 300
    assert license_scan.scan(df.limit(0)).collect() == []
    named = spark.createDataFrame([("a", "mit license")], "k string, body string")
    assert license_scan.scan(named, id_col="k", text_col="body").first().labels == "mit"


# -- whitening ---------------------------------------------------------------------


def plain_whitening(x):
    x = np.floor(1024 * np.asarray(x, np.float64)) + 100_000
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    return x, c, e[::-1], u[:, ::-1]


def compare(out, ids, x, components=8):
    x, c, e, u = plain_whitening(x)
    n = len(x)
    big = [[int(v) for v in row] for row in x]
    sums = [sum(col) for col in zip(*big, strict=True)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in big]
    mine = {(r.vec_id, r.component): r for r in out}
    assert len(mine) == len(out) == n * components
    for k in range(components):
        want = c @ u[:, k] / math.sqrt(e[k])
        got = np.array([mine[(i, k + 1)].whitened for i in ids])
        assert np.allclose(got, want, atol=1e-8) or np.allclose(got, -want, atol=1e-8)
        assert mine[(ids[0], k + 1)].explained == pytest.approx(e[k] / e.sum(), rel=1e-9)
    for i, d in zip(ids, deviation, strict=True):
        assert int(mine[(i, 1)].deviation_exact) == d and mine[(i, 1)].deviation == (d if d < 1 << 63 else None)
    assert all(r.n == n and r.identity_error < 1e-9 for r in out)


def test_whitening_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    compare(whitening.whiten(df.repartition(5)).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


@pytest.mark.parametrize("gap", [True, False])
def test_the_range_finder_stops_or_expands(spark, gap):
    """A spectrum with a steep fall is found in the narrow block, a flat one in the whole space."""
    r = np.random.default_rng(1)
    scales = np.array([2.0 ** -i if gap and i < 16 else (2.0**-40 if gap else 1.0) for i in range(40)])
    x = r.standard_normal((600, 40)) * scales * 100
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    model = whitening.fit(whitening.kept_vectors(df, 1 << 20, 0), passes=6)
    assert model["width"] == (16 if gap else 40)
    y = np.floor(x * (1 << 20))
    y -= y.mean(0)
    e, u = np.linalg.eigh(y.T @ y / len(y))
    assert np.allclose(model["values"], e[::-1][:8], rtol=1e-9)
    assert np.allclose(np.abs((model["vectors"] * u[:, ::-1][:, :8]).sum(0)), 1, atol=1e-10)


def test_whitening_edges(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((30, 3)).tolist()
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0])]
    df = spark.createDataFrame(list(enumerate(x)) + odd, "vec_id bigint, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("v", F.lit(0))
    compare(whitening.whiten(df).collect(), list(range(30)), x, components=3)
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id = 3")).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0])] * 5 + [(None, [1.0, 3.0])], "vec_id bigint, embedding array<float>")
    out = whitening.whiten(same).collect()
    assert len(out) == 6 and {r.component for r in out} == {1} and sum(r.vec_id is None for r in out) == 1
    far = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])], "vec_id bigint, embedding array<double>")
    assert all(r.deviation is None and r.deviation_exact > 2**63 for r in whitening.whiten(far).collect() if r.vec_id < 3)


# -- delta Lloyd -------------------------------------------------------------------


def plain_lloyd(rows, k, rounds, scale=64):
    x = [(i, [math.floor(scale * c) for c in v]) for i, v in rows]
    first = sorted(x, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [v for _, v in first]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    near = lambda v: min((dist(v, c), i) for i, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in x]
        for c in range(len(cents)):
            mine = [v for (_, v), o in zip(x, own, strict=True) if o == c]
            if mine:
                cents[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in x]
    total = sum(d for _, _, d in out)
    per = {c: sum(d for _, o, d in out if o == c) for c in range(len(cents))}
    return sorted([(i, c, d, per[c], total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in out], key=repr)


@pytest.mark.parametrize(("k", "rounds", "seed"), [(16, 3, 0), (5, 8, 1), (40, 2, 2), (3, 0, 3)])
def test_lloyd_against_plain_rounds(spark, k, rounds, seed):
    """Coarse grids make many ties and empty clusters; equal rows are many."""
    r = np.random.default_rng(seed)
    x = np.round(r.standard_normal((300, 6)) * (0.5 if seed else 2)) / 4
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    got = centroids.cluster(df, k=k, rounds=rounds, dimensions=6).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain_lloyd(rows, k, rounds)


def test_lloyd_edges(spark):
    rows = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (1, [0.0, 1.0]), (None, [3.0, -3.0])]
    odd = [(7, None), (8, [1.0]), (9, [1.0, None]), (10, [float("nan"), 0.0]), (11, [0.0, float("-inf")])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumn("cluster", F.lit("clash")).withColumn("x", F.lit(1)).withColumn("h", F.lit(2))
    got = centroids.cluster(df, k=16, dimensions=2).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain_lloyd(rows, 16, 3)
    assert centroids.cluster(df.limit(0), dimensions=2).collect() == []
    far = spark.createDataFrame([(i, [1e300 * (-1) ** i, 0.0]) for i in range(6)], "vec_id bigint, embedding array<double>")
    assert all(r.distance < 1 << 62 for r in centroids.cluster(far, k=2, dimensions=2).collect())


def test_lloyd_moves_only_what_changed(spark):
    """Settled clusters send nothing on: after a round without moves no row is compared again."""
    r = np.random.default_rng(5)
    x = r.standard_normal((200, 4)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    steps = []
    real = centroids._assign
    try:
        centroids._assign = lambda state, c, moved: (steps.append(moved.tolist()), real(state, c, moved))[1]
        got = centroids.cluster(df, k=12, rounds=40, dimensions=4).collect()
    finally:
        centroids._assign = real
    assert len(steps) < 40 and any(not all(m) for m in steps[1:])
    assert sorted([tuple(r) for r in got], key=repr) == plain_lloyd([(i, v.tolist()) for i, v in enumerate(x)], 12, 40)
