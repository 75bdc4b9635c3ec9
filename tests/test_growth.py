"""Operators whose work grows with their rows, against plain versions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skarn import queries, ruby_fixture
from skarn.functions import text as T
from skarn.operators import history, intervals, inverted, resolution, retrieval, stats


def _ranges(seed, n, files="fg"):
    g = random.Random(seed)
    made = []
    for k in range(n):
        a = g.randrange(-40, 300)
        made.append((g.choice(files), a, a + g.choice([-1, 0, 0, 1, 5, 17, 64, 200]), g.randrange(3), f"r{k % (n - 3):03d}"))
    return made


def _no_pairs(*_, **__):
    raise AssertionError("pairs of points and ranges are made")


def test_innermost_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(intervals, "contained", _no_pairs)
    g = random.Random(1)
    ranges, points = _ranges(2, 90), [(f"p{k}", g.choice("fgh"), g.randrange(-60, 520)) for k in range(150)] + [("none", "f", None)]
    r = spark.createDataFrame(ranges, "file string, a int, b int, depth int, id string")
    p = spark.createDataFrame(points, "pid string, file string, line int")
    got = intervals.innermost(p, r, "file", "line", ("a", "b"), "pid", "depth", "id")
    assert set(got.columns) == {"pid", "file", "line", "a", "b", "depth", "id"}
    want = {}
    for pid, file, line in points:
        held = [(b - a, -depth, i) for f, a, b, depth, i in ranges if f == file and line is not None and a <= line <= b]
        if held:
            want[pid] = min(held)
    assert {x.pid: (x.b - x.a, -x.depth, x.id) for x in got.collect()} == want and len(want) > 50
    assert intervals.innermost(p, r.limit(0), "file", "line", ("a", "b"), "pid", "depth", "id").count() == 0


@pytest.mark.parametrize(("bucket", "block"), [(256, 50_000), (16, 7), (64, 1)])
def test_overlap_deals_busy_buckets(spark, bucket, block):
    """Pairs are those of a plain loop, equal rows kept or counted once, whatever the buckets and blocks."""
    g = random.Random(3)
    hunks = [(g.choice("fffg"), a := g.randrange(-40, 300), a + g.choice([-1, 0, 3, 7, 70]), f"h{k % 70}") for k in range(90)] + [(None, 1, 2, "n"), ("f", None, 2, "n"), ("f", 5, 9, "same"), ("f", 5, 9, "same")]
    ranges = [(f, a, b, i) for f, a, b, _, i in _ranges(4, 80)] + [(None, 1, 2, "n"), ("f", 3, None, "n"), ("f", 0, 300, "twice"), ("f", 0, 300, "twice")]
    h, r = spark.createDataFrame(hunks, "file string, x int, y int, h string"), spark.createDataFrame(ranges, "file string, a int, b int, id string")
    for distinct in (False, True):
        once = (lambda rows: sorted(set(rows), key=str)) if distinct else list
        want = sorted((hf, x, y, hid, a, b, i) for hf, x, y, hid in once(hunks) for f, a, b, i in once(ranges) if hf is not None and hf == f and None not in (x, y, a, b) and x <= y and a <= b and x <= b and y >= a)
        met = intervals.overlap(h, r, "file", ("x", "y"), ("a", "b"), bucket, distinct=distinct, block=block)
        assert met.columns == ["file", "x", "y", "h", "a", "b", "id"]
        assert sorted(tuple(p) for p in met.collect()) == want and len(want) > 500
    x, y = intervals._dealt(h.withColumn("_b", F.lit(0)), r.withColumn("_b", F.lit(0)), ["file", "_b"], 7)
    for rows in (x, y):
        assert rows.where("file = 'f'").groupBy("_pair").count().agg(F.max("count")).first()[0] < 25


def test_hunk_overlap_moves_rows_once(spark, tmp_path):
    """Each side is shuffled once, by its place; rows that are there twice count once."""
    rows = [(k % 3 * 5000 + k % 2, k * 7 % 200, k * 11 % 100, k % 7 + 1) for k in range(60)]
    spark.createDataFrame(rows + rows[:20], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    met = queries.hunk_overlap(spark, f"file://{tmp_path}")
    dealt = [x for x in met._jdf.queryExecution().executedPlan().toString().splitlines() if " Exchange hashpartitioning(" in x]
    assert sum("_pair" in x for x in dealt) == 2 and not any("hunk_id" in x or "chunk_id" in x for x in dealt)
    h = {(f"{o}-{n}-{p}-{s}", o % 5000, s % 100, s % 100 + n) for o, p, s, n in rows}
    r = {(o % 5000, p, p % 80, p % 80 + n * 9, n) for o, p, _, n in rows}
    want = sorted((i, c, depth, a) for i, f, x, y in h for g, c, a, b, depth in r if f == g and x <= b and y >= a)
    assert sorted(tuple(x) for x in met.collect()) == want and len(want) > 100


def test_chunk_blame_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(history, "contained", _no_pairs, raising=False)
    g = random.Random(3)
    ranges, lines = _ranges(4, 60), [(g.choice("fgh"), g.randrange(-60, 520), g.choice("xyz")) for _ in range(400)]
    c = spark.createDataFrame(ranges, "file string, start_line int, end_line int, depth int, chunk_id string")
    got = {x.chunk_id: x for x in history.chunk_blame(spark.createDataFrame(lines, "file string, line int, author string"), c).collect()}
    want = {}
    for f, a, b, _, chunk in ranges:  # some chunks have two ranges
        for file, line, author in lines:
            if file == f and a <= line <= b:
                of = want.setdefault(chunk, {})
                of[author] = of.get(author, 0) + 1
    assert set(got) == set(want) and len(ranges) > len({r[4] for r in ranges})
    for chunk, of in want.items():
        order = sorted(of, key=lambda x: (-of[x], x))
        x = got[chunk]
        assert (x.blame_dominant_author, x.blame_authors, x.blame_contributor_count) == (order[0], order, len(of))
        assert x.blame_dominant_author_pct == int(100 * of[order[0]] / sum(of.values()) + 0.5)


def test_background_of_all_vectors(spark):
    """Pairs beyond the first 20,000 ids count, wherever partitions end."""
    v = spark.range(0, 20_101 * 3, 3, 7).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 60_000, F.array(F.lit(1.0), F.lit(0.0))).when(F.col("id") % 2 == 0, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("embedding"))
    row = stats.score_background(v.repartition(5)).first()
    assert (row.pairs, row.mean) == (10_050, round(10_000 / 10_050, 6))
    assert stats.score_background(v, sample=200).first().pairs == 100


def _branches(rows):
    """Commits of the walks of all merges, one walk at a time."""
    parents, found = {s: p for s, p, _ in rows}, set()
    for _, p, body in rows:
        if len(p) >= 2 and body.startswith("Merge branch 'fix/") and p[1] != p[0] and p[1] in parents:
            todo, seen = [p[1]], {p[1]}
            while todo:
                new = [q for q in parents[todo.pop()] if q in parents and q != p[0] and q not in seen]
                todo += new
                seen |= set(new)
            found |= seen
    return found


def test_fix_branches_that_share_commits(spark, monkeypatch):
    """Merges whose branches go on into each other's do not each walk to the end."""
    calls, plain = [], history.written
    monkeypatch.setattr(history, "written", lambda *a, **k: calls.append(1) or plain(*a, **k))
    rows = []
    for k in range(40):
        rows += [(f"m{k}", [f"main{k}", f"c{k}.0"], "Merge branch 'fix/x'"), (f"main{k}", [f"m{k}"], "work")]
        rows += [(f"c{k}.{j}", [f"c{k}.{j + 1}"] if j < 5 else [f"m{k + 1}"], "work") for j in range(6)]
    df = spark.createDataFrame(rows, "sha string, parents array<string>, body string")
    assert {r.sha for r in history.fix_branch_commits(df).collect()} == _branches(rows)
    assert len(calls) < 40


def test_fix_branches_of_any_form(spark):
    """Walks end at the first parent of their own merge only, however many meet there."""
    for seed in range(3):
        g = random.Random(seed)
        n, rows = 40, []
        for k in range(n):
            p = [f"c{g.randrange(n + 2)}" for _ in range(g.choice([0, 1, 1, 1, 2]))]
            rows.append((f"c{k}", p, g.choice(["Merge branch 'fix/x'", "work"]) if len(p) > 1 else "work"))
        # a row of first parents on one way, each walk ends at its own
        ends = [f"e{k}" for k in range(5)]
        rows += [("s", ["e0"], "work"), *[(e, [f"e{k + 1}"] if k < 4 else ["last"], "work") for k, e in enumerate(ends)], ("last", ["end"], "work"), ("end", [], "work")]
        rows += [(f"x{k}", [e, "s"], "Merge branch 'fix/x'") for k, e in enumerate(ends[: 3 + seed])]
        df = spark.createDataFrame(rows, "sha string, parents array<string>, body string")
        assert {r.sha for r in history.fix_branch_commits(df).collect()} == _branches(rows)


def test_ruby_names_make_no_pairs(spark, monkeypatch):
    """Calls meet definitions in the file they want, or names that only one definition has."""
    t = ruby_fixture.facts(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(resolution, "by_name", _no_pairs)
    for name in ("constant", "explicitRequire", "bareCall"):
        assert resolution.strategy(t, "ruby", name).columns == ["call_id", "verdict", "file", "target"]


def test_terms_of_odd_texts(spark):
    """Tokens counted on arrays of bytes are those of the plain functions, and no row carries a text's tokens."""
    g = random.Random(5)
    texts = ["", " ", None, "A", "ab", "ABc", "ABCdef1x2YZ the", "the The tHe", "é12ab√CDe", "x" * 300, "notNot not", "HTTPServer2Go", "if", "ß", "a" * 5 + "B" * 5]
    texts += ["".join(g.choice("abABz019 _é\n") for _ in range(g.randrange(1, 60))) for _ in range(300)]
    texts += ["worthless " * 20_000 + " ".join(f"w{k}" for k in range(20_000))]
    rows = [(k % 290, t) for k, t in enumerate(texts)]  # some ids repeat
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    tokens = df.select("doc_id", T.code_tokens("text").alias("t")).select("doc_id", F.explode(F.transform("t", lambda w: F.struct(F.size("t").alias("length"), w.alias("w")))).alias("x"))
    want = tokens.groupBy("doc_id", "x.length", T.feature_hash("x.w").alias("bucket")).agg(F.count("*").alias("tf"))
    got = retrieval.postings(df)
    assert sorted(tuple(r) for r in got.select("doc_id", "length", "bucket", "tf").collect()) == sorted(tuple(r) for r in want.collect())
    assert got.where("part != bucket % 64").isEmpty()
    plan = retrieval.sparse(df, "worthless w77", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "regexp_extract_all" not in plan
    stored = retrieval.stored_sparse(got, df.count(), "worthless w77", 5).collect()
    assert retrieval.sparse(df, "worthless w77", 5).collect() == stored and len(stored) == 1
    assert retrieval.sparse(df.limit(0), "worthless", 5).count() == retrieval.postings(df.limit(0)).count() == 0


def test_queries_are_sent_in_pieces():
    """However many queries and lists there are, a worker holds a bounded number of their rows."""
    g = np.random.default_rng(3)
    centroids, asked = g.normal(size=(300, 4)), g.normal(size=(1000, 4))
    df = pd.DataFrame({"query_id": range(1000), "q": list(asked)})
    sent = list(inverted._probed(iter([df, df[:0]]), centroids, 225))
    assert max(map(len, sent)) <= inverted.SENT and sum(map(len, sent)) == 225_000
    want = np.argsort(-inverted._cosines(asked, centroids), axis=1, kind="stable")[:, :225]
    every = pd.concat(sent)
    assert every["list"].tolist() == want.ravel().tolist() and every["query_id"].tolist() == np.repeat(range(1000), 225).tolist()
    assert (every["q"].iloc[-1] == asked[-1]).all()
    assert [len(x) for x in inverted._pieces(iter([df[:5], df[:0], df[:2]]), 2)] == [2, 2, 1, 2] and len(next(inverted._pieces(iter([df]), 0))) == 1


def test_rounds_of_a_walk_do_not_grow(spark, monkeypatch):
    """Twice the history of a busy file is not twice the rounds once all stretches are there."""
    g, rounds, plain = random.Random(7), [], history.written
    monkeypatch.setattr(history, "STRETCHES", 6)
    monkeypatch.setattr(history, "written", lambda df, name="step", *a, **k: rounds.append(name) or plain(df, name, *a, **k))
    schema = "file string, id string, author string, ts bigint, is_fix boolean, old_start bigint, old_lines bigint, new_start bigint, new_lines bigint"
    chunks = spark.createDataFrame([("hot", "x", 10, 60), ("hot", "y", 61, 90), ("cold", "z", 1, 9)], "file string, chunk_id string, start_line bigint, end_line bigint")
    hunks = [("hot" if k % 2 else "cold", f"c{k:05d}", "a", k, False, 1, g.randrange(4), g.randrange(1, 90), g.randrange(4)) for k in range(800)]
    counts, found = [], []
    for rows, block in ((hunks[:400], 10), (hunks, 10), (hunks, 10_000)):
        rounds.clear()
        found.append(sorted(tuple(r) for r in history.walk_hunks(spark.createDataFrame(rows, schema), chunks, block).collect()))
        counts.append(rounds.count("walked"))
    assert found[1] == found[2] and counts[2] == 1 < counts[1] and max(counts) <= 6


def test_facts_are_made_once_a_run(spark):
    """Strategies read tables that the run has written; none of them makes the definitions again."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        made.add(1)
        return name

    rows = lambda schema, *found: spark.createDataFrame(list(found), schema)
    symbols = rows("language string, rel_path string, symbol_id string, short_name string, scope string", ("java", "A.java", "A#m", "m", "A"), ("java", "B.java", "B#n", "n", "B"))
    t = resolution.Facts(
        calls=rows("call_id int, language string, rel_path string, line int, source_symbol_id string, scope string, receiver string, member string", (1, "java", "A.java", 3, "A#m", "A", "this", "m"), (2, "java", "A.java", 4, "A#m", "A", None, "n")),
        symbols=symbols.withColumn("short_name", counted.asNondeterministic()("short_name")), imports=rows("language string, rel_path string, position int, import_text string, names array<string>"),
        bindings=rows("rel_path string, owner string, name string, line int, type string, is_class boolean"), fields=rows("language string, scope string, field string, type string"),
        inheritance=rows("language string, source_fq_name string, ancestor_fq_name string, kind string, ordinal int", ("java", "A", "B", "extends", 0)), returns=rows("language string, function string, type string"),
        call_bindings=rows("rel_path string, owner string, name string, line int, function string"),
    )
    assert {x.call_id: x.target for x in resolution.chain(t, "java").collect()} == {1: "A#m", 2: "B#n"}
    assert made.value == 2


def test_steps_of_a_strategy_are_written(spark):
    """A task pays for every sort of its plan, so the long strategies leave few joins to one plan."""
    rows = lambda schema: spark.createDataFrame([], schema)
    t = resolution.Facts(
        calls=rows("call_id int, language string, rel_path string, line int, source_symbol_id string, scope string, receiver string, member string"),
        symbols=rows("language string, rel_path string, symbol_id string, short_name string, scope string"), imports=rows("language string, rel_path string, position int, import_text string, names array<string>"),
        bindings=rows("rel_path string, owner string, name string, line int, type string, is_class boolean"), fields=rows("language string, scope string, field string, type string"),
        inheritance=rows("language string, source_fq_name string, ancestor_fq_name string, kind string, ordinal int"), returns=rows("language string, function string, type string"),
        call_bindings=rows("rel_path string, owner string, name string, line int, function string"),
    )
    for run, language in ((resolution.python_binding, "python"), (resolution.java_import, "java")):
        plan = run(t, t.of(language))._jdf.queryExecution().analyzed().toString()
        assert plan.count("Join ") <= 8, (language, plan.count("Join "))


def test_folding_sends_no_table_to_the_driver(spark, monkeypatch):
    """Tables that grow with the calls are not broadcast, however small their files are."""
    plans, put = [], resolution.written

    def seen(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(df, *args, **kwargs)

    monkeypatch.setattr(resolution, "written", seen)
    rows = lambda schema, *found: spark.createDataFrame(list(found), schema)
    t = resolution.Facts(
        calls=rows("call_id int, language string, rel_path string, line int, source_symbol_id string, scope string, receiver string, member string", (1, "ruby", "b.rb", 3, "B#x", "B", None, "f"), (2, "ruby", "b.rb", 4, "B#f", "B", "p", "g")),
        symbols=rows("language string, rel_path string, symbol_id string, short_name string, scope string", ("ruby", "a.rb", "A#g", "g", "A"), ("ruby", "b.rb", "B#f", "f", "B")), imports=rows("language string, rel_path string, position int, import_text string, names array<string>"),
        bindings=rows("rel_path string, owner string, name string, line int, type string, is_class boolean"), fields=rows("language string, scope string, field string, type string"),
        inheritance=rows("language string, source_fq_name string, ancestor_fq_name string, kind string, ordinal int", ("ruby", "B", "A", "extends", 0)), returns=rows("language string, function string, type string"),
        call_bindings=rows("rel_path string, owner string, name string, line int, function string"),
    )
    made = resolution.folded(t, rows("call_id int, target string", (1, "B#f")), rows("call_id int, position int, type string, name string", (1, 0, "B", None)), rows("function string, position int, name string", ("B#f", 0, "p")))
    assert [tuple(x) for x in made["edges"].collect()] == [(2, "a.rb", "A#g")]
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("BroadcastExchange" in p for p in plans)
