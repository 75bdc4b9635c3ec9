"""Operators on small literal tables, with the properties they promise."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skarn import storage
from skarn.operators import dispatch, graph, history, intervals, retrieval, segment, symbols, sync
from skarn.plans import filters, rank
from skarn.sources import gitlog, tree
from skarn.streaming.incremental import Index


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_page_rank(spark):
    r = {x.node: x.rank for x in graph.page_rank(edges(spark, [("a", "b"), ("b", "a")])).collect()}
    assert r == pytest.approx({"a": 0.5, "b": 0.5})
    r = {x.node: x.rank for x in graph.page_rank(edges(spark, [("a", "hub"), ("b", "hub"), ("c", "hub")])).collect()}
    assert r["hub"] > r["a"] and sum(r.values()) == pytest.approx(1, abs=1e-4)
    assert graph.page_rank(edges(spark, [])).collect() == []


def test_strong_components(spark):
    got = lambda pairs: sorted((r.component, r.node) for r in graph.strong_components(edges(spark, pairs)).collect())
    assert got([("a", "b"), ("c", "d")]) == []
    assert got([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("y", "x"), ("s", "s")]) == [("a", "a"), ("a", "b"), ("a", "c"), ("x", "x"), ("x", "y")]


def test_impact_and_paths(spark):
    e = edges(spark, [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("a", "e")])
    r = {x.root: x.impact for x in graph.impact(e).collect()}
    assert r["a"] == 4
    assert [x.path for x in graph.paths(e, "d", "a").collect()] == [["d", "b", "a"], ["d", "c", "a"]]
    assert [x.path for x in graph.paths(e, "d", "d").collect()] == [["d"]]


def test_fix_branch_of_any_depth(spark):
    rows = [("m", ["main", "c0"], "Merge branch 'fix/x'")] + [(f"c{k}", [f"c{k + 1}"], "work") for k in range(207)] + [("main", ["c203"], "work")]
    df = spark.createDataFrame(rows, "sha string, parents array<string>, body string")
    assert {r.sha for r in history.fix_branch_commits(df).collect()} == {f"c{k}" for k in range(207)}


def test_sessions(spark):
    rows = [("1", "x", 0, "a", True), ("2", "x", 1799, "b", False), ("3", "x", 3599, "c", False), ("4", "x", 3600, "Merge branch", True), ("5", "y", 10, "z", False)]
    got = history.sessions(spark.createDataFrame(rows, "sha string, author string, ts bigint, body string, is_fix boolean")).orderBy("author", "session").collect()
    assert [(r.author, r.commits, r.ts, r.is_fix) for r in got] == [("x", 2, 1799, True), ("x", 1, 3599, False), ("y", 1, 10, False)]


def test_hunk_walk(spark):
    chunks = spark.createDataFrame([("f", "c1", 1, 10), ("f", "c2", 20, 30)], "file string, chunk_id string, start_line int, end_line int")
    hunks = spark.createDataFrame([("f", "new", "a", 200, False, 12, 0, 12, 5), ("f", "old", "b", 100, True, 16, 1, 16, 2)], "file string, id string, author string, ts bigint, is_fix boolean, old_start int, old_lines int, new_start int, new_lines int")
    got = history.walk_hunks(hunks, chunks).collect()
    assert [(r.chunk_id, r.id, r.added) for r in got] == [("c2", "old", 2)]


def test_diff_hunks(spark):
    v = spark.createDataFrame([("f", "1", "a\nb\nc", "a\nx\ny\nc"), ("g", "2", None, "z")], "file string, id string, old string, new string")
    assert [(r.file, r.old_start, r.old_lines, r.new_start, r.new_lines) for r in history.diff_hunks(v).collect()] == [("f", 2, 1, 2, 2)]


def test_intervals(spark):
    r = spark.createDataFrame([("f", 1, 100, 0, "out"), ("f", 10, 20, 1, "in"), ("f", 10, 20, 2, "deep")], "file string, a int, b int, depth int, id string")
    p = spark.createDataFrame([("p1", "f", 15), ("p2", "f", 50), ("p3", "f", 500)], "pid string, file string, line int")
    got = {x.pid: x.id for x in intervals.innermost(p, r, "file", "line", ("a", "b"), "pid", "depth", "id").collect()}
    assert got == {"p1": "deep", "p2": "out"}
    own = intervals.owner(spark.createDataFrame([("A.B#c",), ("AB",)], "parent_id string"), spark.createDataFrame([("A",), ("A.B",)], "container_id string"))
    assert [(x.parent_id, x.owner) for x in own.collect()] == [("A.B#c", "A.B")]


def test_merkle_and_ring(spark):
    s = spark.createDataFrame([("b", "2"), ("a", "1"), ("c", "3")], "path string, hash string")
    import hashlib

    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    leaves = [h("a:1"), h("b:2"), h("c:3")]
    assert sync.merkle_root(s) == h(h(leaves[0] + leaves[1]) + h(leaves[2] + leaves[2]))
    assert sync.merkle_root(s.limit(0)) == h("")
    names = [f"s{k}" for k in range(5)]
    keys = spark.range(300).select(F.concat(F.lit("k"), "id").alias("k"))
    for r in keys.select("k", sync.shard("k", names).alias("s")).collect():
        assert r.s == sync.shard_of(r.k, names)


def test_detect(spark):
    old = spark.createDataFrame([("a", 1.0, 3, "h"), ("b", 1.0, 3, "h"), ("gone", 1.0, 1, "h")], "path string, mtime double, size bigint, hash string")
    new = spark.createDataFrame([("a", 1.5, 3, "xyz"), ("b", 9.0, 3, "xyz"), ("c", 1.0, 1, "q")], "path string, mtime double, size bigint, content string")
    assert {r.path: r.change for r in sync.detect(old, new).collect()} == {"a": "unchanged", "b": "modified", "c": "added", "gone": "deleted"}


def test_storage(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string")
    assert sorted(map(tuple, storage.upsert(old, new, "id").collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, storage.patch(old, new, "id").collect())) == [(1, "a"), (2, "B")]
    assert sorted(map(tuple, storage.delete(old, new.select("id"), "id").collect())) == [(1, "a")]


def test_segment(spark):
    text = "\n".join(f"line {i} " + "x" * 40 for i in range(200))
    made = segment.by_characters(text)
    assert made[0][0] == 1 and made[-1][1] == 200
    assert all(b[0] <= a[1] + 1 for a, b in zip(made, made[1:], strict=False))
    md = "# A\n" + "y" * 60 + "\n## B\n" + "z" * 60 + "\n```python\n" + "print(1)\n" * 10 + "```\n"
    assert [(c["name"], c["start_line"]) for c in segment.by_markdown(md)] == [("A", 1), ("B", 3), ("Code: python", 6)]
    py = "class A:\n    def f(self):\n        return 1\n    @staticmethod\n    def g():\n        pass\n\ndef h():\n    pass\n"
    assert [(c["symbol_id"], c["start_line"], c["end_line"]) for c in segment.by_python(py)] == [("A", 1, 6), ("A#f", 2, 3), ("A.g", 4, 6), ("h", 8, 9)]
    big = {"content": "\n".join(["x" * 90] * 30), "name": "n", "symbol_id": "s", "start_line": 1, "end_line": 30}
    parts = segment.oversized(big, 1000)
    assert len(parts) == 3 and parts[0]["symbol_id"] == "s#part1" and parts[-1]["end_line"] == 30
    files = spark.createDataFrame([("a.py", "python", py), ("b.md", "markdown", md), ("c.txt", None, text), ("d", None, None)], "path string, language string, text string")
    rows = segment.chunks(files).collect()
    assert {r.path for r in rows} == {"a.py", "b.md", "c.txt"}


def test_symbols(spark):
    rows = [("f", "A#m#part1", "A", 1, 3, "x", 1), ("f", "A#m#part2", "A", 4, 6, "y", 2), ("f", "A#n", "A", 8, 9, "z", 3)]
    c = spark.createDataFrame(rows, "relative_path string, symbol_id string, parent_symbol_id string, start_line int, end_line int, content string, chunk_id int").withColumn("content_size", F.length("content"))
    merged = {r.symbol_id: r for r in symbols.merge_fragments(c, joined=True).collect()}
    assert merged["A#m"].content == "x\ny" and merged["A#m"].end_line == 6 and merged["A#m"].merged_chunk_ids == [1, 2]
    assert symbols.class_outline(c).first().outline == "A\n  A#m\n  A#n"
    small = spark.createDataFrame([("f", 1, 2, "block", "a", 1), ("f", 4, 5, "block", "b", 2), ("f", 20, 21, "block", "c", 3)], "relative_path string, start_line int, end_line int, chunk_type string, content string, chunk_id int")
    assert sorted(r.chunk_ids for r in symbols.merge_small(small).collect()) == [[1, 2], [3]]


def test_filters(spark):
    df = spark.createDataFrame([("ts", 0, True), ("py", 40, None), ("py", None, False)], "language string, age int, isTest boolean").select("language", F.struct(F.struct(F.col("age").alias("ageDays")).alias("file")).alias("git"), "isTest")
    assert df.where(filters.typed(df, minAgeDays=0)).count() == 1
    assert df.where(filters.typed(df, testFile="exclude")).count() == 2
    with pytest.raises(filters.FilterError):
        filters.typed(df, author="x")
    with pytest.raises(filters.FilterError):
        filters.resolve(df, {"presets": "nope"})
    assert filters.merge({"must": [1], "should": [2]}, {"must": [3], "should": [4]}) == {"must": [1, 3], "should": [4]}


def test_labels_and_confidence(spark):
    labels, t = {50: "healthy", 75: "concerning", 95: "critical"}, {50: 25, 75: 38, 95: 53}
    below = ((10, 5.0, "healthy"), (25, 10.0, "concerning"))
    got = [spark.range(1).select(rank.label(F.lit(63), labels, t, F.lit(n), below)).first()[0] for n in (3, 7, 20)]
    assert got == ["healthy", "concerning", "critical"]
    found = spark.createDataFrame([(0.82, "a/x"), (0.65, "a/y"), (0.62, "a/z")], "score double, relativePath string")
    noise = spark.createDataFrame([(0.47, "a/x"), (0.46, "b/y"), (0.45, "c/z")], "score double, relativePath string")
    a, b = (rank.confidence(x, 0.25, 0.15, 600).first() for x in (found, noise))
    assert a.confidence > b.confidence and b.label == "low" and a.label == "high"
    assert rank.confidence(found, 0.25, 0.15, 10).collect() == []


def test_recommend_rules(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id int, embedding array<double>")
    with pytest.raises(retrieval.RecommendError):
        retrieval.recommend(v, [], [[1.0, 0.0]], "average_vector")
    assert retrieval.recommend(v, [], [[1.0, 0.0]], "best_score").first().score == -1.0


def test_dispatch(spark):
    v = spark.createDataFrame([(1, 1, "continue", 5), (1, 2, "deferred", 6), (1, 3, "resolved", 7), (2, 1, "deferred", 8), (3, 1, "drop", 9)], "call_id int, priority int, verdict string, target int")
    assert {r.call_id: (r.outcome, r.target) for r in dispatch.first_verdict(v).collect()} == {1: ("resolved", 7), 2: ("resolved", 8), 3: ("dropped", None)}


def test_git_log(spark):
    sha, other = "a" * 40, "b" * 40
    log = "\0".join(["", sha, other, "Ann", "ann@x", "100", "fix: a", "\n3\t1\tsrc/a.py\n-\t-\timg.png\n", other, "", "Bob", "bob@x", "50", "init", "\n10\t0\tsrc/a.py\n"])
    c = gitlog.commits(spark, log)
    assert [(r.sha[0], r.author, r.ts, r.parents) for r in c.orderBy("ts").collect()] == [("b", "Bob", 50, []), ("a", "Ann", 100, [other])]
    assert sorted((r.author, r.file, r.added) for r in gitlog.numstat(c).collect()) == [("Ann", "src/a.py", 3), ("Bob", "src/a.py", 10)]
    blame = f"{sha} 1 1 2\nauthor Ann\nauthor-mail <a@x>\nauthor-time 5\n\tx\n{sha} 2 2\n\ty"
    assert [(r.line, r.author, r.email, r.ts) for r in gitlog.blame(spark, blame).orderBy("line").collect()] == [(1, "Ann", "a@x", 5), (2, "Ann", "a@x", 5)]


def test_tree(spark, tmp_path):
    for name, text in {"src/a.py": "def f(): pass", "tests/test_a.py": "x", "node_modules/x.js": "y", "b.log": "z", "package.json": "{}", "data.json": "{}", ".gitignore": "src/gen/\n", "src/gen/g.py": "q"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: r.kind for r in tree.scan(spark, f"file://{tmp_path}").collect()}
    assert got == {"src/a.py": "source", "tests/test_a.py": "test", "package.json": "source"}


def test_incremental_index(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index")
    schema = "path string, language string, text string, deleted boolean, seq int"
    src = f"{tmp_path}/in"
    spark.createDataFrame([("a.py", "python", "def f():\n    pass\n", False, 1), ("b.py", "python", "def g():\n    pass\n", False, 1)], schema).write.parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    index.follow(stream(), f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.symbol_id for r in index.read().collect()) == ["f", "g"]
    spark.createDataFrame([("a.py", "python", "def h():\n    pass\n", False, 2), ("b.py", None, None, True, 2)], schema).write.mode("append").parquet(src)
    index.follow(stream(), f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.symbol_id for r in index.read().collect()) == ["h"]


def test_pandas_free_plans(spark):
    """Scoring stays inside the JVM."""
    df = spark.createDataFrame(pd.DataFrame({"id": [1, 2], "score": [0.1, 0.9], "methodLines": [10, 20], "chunkType": ["function", "block"]}))
    plan = rank.score(df, {"custom": {"similarity": 0.5, "chunkSize": 0.5}})._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_index_restart(spark, tmp_path):
    """Another index on the same folder goes on where the first one ended; a replayed batch changes nothing."""
    files = lambda *rows: spark.createDataFrame(rows, "path string, language string, text string, deleted boolean, seq bigint")
    body = lambda name: f"def {name}():\n    return 1\n"
    names = lambda i: sorted((r.path, r.symbol_id) for r in i.read().where("symbol_id IS NOT NULL").collect())
    first = Index(spark, f"file://{tmp_path}/index")
    with pytest.raises(LookupError):
        first.read()
    first.apply(files(("a.py", "python", body("a"), False, 1), ("b.py", "python", body("b"), False, 1)), 0)
    second = Index(spark, f"file://{tmp_path}/index")
    assert names(second) == [("a.py", "a"), ("b.py", "b")]
    second.apply(files(("b.py", "python", body("old"), False, 2), ("b.py", "python", body("new"), False, 3), ("c.py", "python", body("c"), False, 2)), 1)
    second.apply(files(("z.py", "python", body("z"), False, 9)), 1)  # replayed: already there
    assert names(Index(spark, f"file://{tmp_path}/index")) == [("a.py", "a"), ("b.py", "new"), ("c.py", "c")]
    # a batch lost before its commit leaves chunks that nobody reads, and is written again
    second.chunker(files(("a.py", "python", body("lost"), False, 4))).write.parquet(f"file://{tmp_path}/index/chunks/batch=2")
    assert ("a.py", "lost") not in names(second)
    second.apply(files(("a.py", "python", None, True, 5)), 2)
    assert names(first) == [("b.py", "new"), ("c.py", "c")]
    small = first.compact(f"file://{tmp_path}/small")
    assert names(small) == names(first)
    small.apply(files(("d.py", "python", body("d"), False, 6)), 3)
    assert ("d.py", "d") in names(Index(spark, f"file://{tmp_path}/small"))


@pytest.mark.parametrize(
    ("ranges", "hunks", "want"),
    [
        ([[10, 20]], [(0, 3, 4)], [[6, 16]]),  # four lines added above
        ([[10, 20]], [(4, 3, 0)], [[14, 24]]),  # four removed above
        ([[10, 20]], [(0, 12, 3)], [[10, 17]]),  # added inside
        ([[10, 20]], [(3, 12, 0)], [[10, 23]]),  # removed inside
        ([[10, 20]], [(0, 8, 4)], [[10, 20]]),  # begins above, ends inside: left alone
        ([[10, 20]], [(2, 18, 6)], [[10, 20]]),  # begins inside, ends below: left alone
        ([[10, 20]], [(0, 30, 5)], [[10, 20]]),  # below
        ([[10, 20]], [(1, 9, 0)], [[11, 21]]),  # a deletion stands at its own line
        ([[10, 20]], [(1, 10, 0)], [[10, 21]]),  # at the first line: inside
        ([[3, 4]], [(0, 1, 2), (0, 3, 9)], [[1, 2]]),  # from the last hunk to the first
        ([[2, 3]], [(0, 1, 1), (0, 2, 2)], [[1, 1]]),  # held at line 1
    ],
)
def test_ranges_move_back(ranges, hunks, want):
    history.shift(ranges, hunks)
    assert ranges == want


def test_walk_hunks(spark):
    """Two commits of one file, newest first; the older one meets the ranges as they were then."""
    chunks = spark.createDataFrame([("f", "top", 1, 10), ("f", "low", 14, 24)], "file string, chunk_id string, start_line bigint, end_line bigint")
    hunks = spark.createDataFrame(
        [("f", "c2", "ann", 200, False, 3, 0, 3, 4), ("f", "c1", "bob", 100, True, 11, 1, 11, 2)],
        "file string, id string, author string, ts bigint, is_fix boolean, old_start bigint, old_lines bigint, new_start bigint, new_lines bigint",
    )
    got = sorted((r.chunk_id, r.id, r.added, r.deleted) for r in history.walk_hunks(hunks, chunks).collect())
    # c2 adds four lines inside top; before it low stood at 10..20, where c1 wrote lines 11 and 12
    assert got == [("low", "c1", 2, 1), ("top", "c2", 4, 0)]


def test_strong_components_both_ways(spark):
    r = random.Random(3)
    pairs = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(90)] + [(100, 101), (101, 100), (200, 200)]
    e = spark.createDataFrame(pairs, "src bigint, dst bigint")
    few, many = (sorted((x.node, x.component) for x in graph.strong_components(e, few=k).collect()) for k in (10**6, 0))
    assert few == many and (101, 100) in few and all(n != 200 for n, _ in few)


def test_quantised_recall(spark):
    """Of the exact nearest vectors, the search on codes finds at least nine in ten."""
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    codes = retrieval.coded(e).cache()
    found = whole = 0
    for i in range(0, 500, 50):
        q = retrieval.vector_of(e, i)
        exact = {r.vec_id for r in retrieval.dense(e, q, 10).collect()}
        found += len(exact & {r.vec_id for r in retrieval.quantised(e, codes, q, 10, 2.0).collect()})
        whole += len(exact)
    assert found >= 0.9 * whole


def test_external_calls(spark):
    calls = spark.createDataFrame([(1, None, "print"), (2, "os", "getcwd"), (3, "os.path", "join"), (4, "x", "print"), (5, None, "mine")], "call_id bigint, receiver string, member string")
    names = spark.createDataFrame([("print",), ("os",), ("os.path.join",)] + [(f"n{k}",) for k in range(20_000)], "name string")
    assert {r.call_id for r in dispatch.external_calls(calls, names).where("external").collect()} == {1, 2, 3}


def test_verdicts_end_with_what_is_parked(spark):
    v = spark.createDataFrame([(1, 1, "deferred", "p"), (1, 2, "drop", None), (2, 1, "drop", None), (2, 2, "deferred", "late"), (3, 1, "deferred", "p"), (3, 2, "resolved", "r"), (4, 1, "continue", None), (5, 1, "deferred", "a"), (5, 2, "deferred", "b")], "call_id bigint, priority int, verdict string, target string")
    got = {r.call_id: (r.outcome, r.target) for r in dispatch.first_verdict(v).collect()}
    assert got == {1: ("resolved", "p"), 2: ("dropped", None), 3: ("resolved", "r"), 4: ("unresolved", None), 5: ("resolved", "a")}


def test_script_scopes():
    """Classes without their methods, comments with what they stand above, assignments and tests."""
    text = (
        "import x from 'y';\n\n/** Doc of A. */\nexport class A {\n  n = 1;\n\n  // about run\n  @decorated\n  run(a: string): void {\n    if (a) {\n    }\n  }\n\n  static make() {\n    return new A();\n  }\n}\n\n"
        "function top() {\n  return '}';\n}\n\nexports.late = function (z) {\n  return z;\n};\n\nB.prototype.go = function () {\n};\n\ndescribe('A', () => {\n  let a;\n  beforeEach(() => {\n    a = new A();\n  });\n  describe('run', () => {\n    it('works well', () => {\n      a.run();\n    });\n  });\n});\n"
    )
    got = {m["symbol_id"]: m for m in segment.chunk_file(text, "typescript") if m.get("symbol_id")}
    assert set(got) == {"A", "A#run", "A.make", "top", "late", "B#go", "A > beforeEach", "A > setup", "A > run > works well"}
    assert got["A"]["content"].startswith("/** Doc of A. */") and "n = 1" in got["A"]["content"] and "run(a" not in got["A"]["content"] and got["A#run"]["content"].strip().startswith("// about run")
    assert got["A#run"]["parent_symbol_id"] == "A" and got["A > run > works well"]["chunk_type"] == "test" and got["A > run > works well"]["parent_symbol_id"] == "A > run" and got["A > beforeEach"]["chunk_type"] == "test_setup"
    assert segment.chunk_file(text, "typescript")[0]["content"] == "import x from 'y';"


def test_ruby_scopes():
    text = (
        "require 'x'\n\nmodule M\n  # About B.\n  class B < A\n    has_many :as\n    has_many :bs\n    validates :c\n\n    # about run\n    def run(x)\n      if x\n        1\n      end\n    end\n\n    def self.make = new\n\n    def last\n      [1].each do |y|\n        y\n      end\n    end\n  end\nend\n\n"
        "RSpec.describe B do\n  let(:b) { B.new }\n  context 'when on' do\n    before do\n      b.on\n    end\n    it 'runs' do\n      b.run(1)\n    end\n  end\nend\n"
    )
    made = segment.chunk_file(text, "ruby")
    got = {m["symbol_id"]: m for m in made if m.get("symbol_id")}
    assert {"M", "M::B", "M::B#run", "M::B#last", "B > when on > runs", "B > when on > before"} <= set(got)
    assert "# about run" in got["M::B#run"]["content"] and "has_many" not in got["M::B"]["content"] and any(m["chunk_type"] == "block" and m.get("name") == "has_many" for m in made)
    assert got["B > when on > runs"]["chunk_type"] == "test" and "b.run(1)" in got["B > when on > runs"]["content"] and got["M::B#last"]["end_line"] - got["M::B#last"]["start_line"] == 4


def test_ignored_folders_are_not_read(spark, tmp_path):
    """Files below dropped folders are not even opened; what is kept is the same as without that."""
    for p in ("src/a.py", "src/deep/b.py", "node_modules/x/c.js", "pkg/one/node_modules/d.js", "pkg/one/e.py", "top.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    root = f"file://{tmp_path}"
    roots = tree.kept_roots(spark, root, ["node_modules/"])
    assert not any("node_modules" in r for r in roots) and any(r.endswith("/src") for r in roots)
    assert tree.kept_roots(spark, root, ["node_modules/", "!node_modules/x"]) == [root] == tree.kept_roots(spark, root, ["absent/"])
    assert {r.path for r in tree.scan(spark, root).collect()} == {"src/a.py", "src/deep/b.py", "pkg/one/e.py", "top.py"}
    assert tree.scan(spark, root, ["*.py", "*.js"]).count() == 0
