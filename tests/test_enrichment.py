"""Enrichment, the registry, and a collection from its sources to a ranking."""

import pytest
from pyspark.sql import functions as F

from skarn import registry
from skarn.__main__ import run
from skarn.operators import enrichment, graph, history
from skarn.plans import catalog, filters, rank
from skarn.workspace import Workspace, WorkspaceError

SOURCES = {
    "pkg/base.py": "class Base:\n    def shared(self):\n        return 1\n",
    "pkg/main.py": "from pkg.base import Base\n\nclass Main(Base):\n    def run(self):\n        self.shared()\n        self.own()\n\n    def own(self):\n        return 2\n\n    def loop(self):\n        self.back()\n\n    def back(self):\n        self.loop()\n",
    "pkg/test_main.py": "def test_run():\n    assert True\n",
    "docs/guide.md": "# Install guide\n\nHow to install this thing, in enough words to make a section of its own.\n\n## Use\n\nHow to use it, again in enough words to make a section of its own, and more.\n",
}


@pytest.fixture
def tree(tmp_path):
    for p, text in SOURCES.items():
        (tmp_path / "src" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / p).write_text(text)
    return f"{tmp_path}/src"


def commits(spark):
    rows = [(f"c{k}", "ann" if k % 3 else "bob", "pkg/main.py", 1_700_000_000 + k * 86_400, "fix: it" if k % 2 else "add", 5, 1) for k in range(12)] + [("d1", "bob", "pkg/base.py", 1_699_000_000, "add", 3, 0)]
    df = spark.createDataFrame(rows, "id string, author string, file string, ts bigint, body string, added bigint, deleted bigint")
    return df.withColumn("is_fix", F.col("body").startswith("fix"))


def test_collection_from_source_to_ranking(spark, tmp_path, tree):
    w = Workspace(spark, f"file://{tmp_path}/w")
    assert w.status("c")["status"] == "not_indexed"
    w.index("c", tree)
    assert w.status("c", tree)["status"] == "indexed" and {r["state"] for r in w.status("c")["enrichment"]} == {"absent"}
    sizes = w.graph("c", tree)
    assert sizes["edges"] == 4 and sizes["runs"] >= 1
    cycles = {(r.kind, r.member) for r in w.read("c", "cycles").collect()}
    assert cycles == {("method", "Main#loop"), ("method", "Main#back")}
    located = {r.symbol_id: r.chunk_id for r in w.read("c", "symbols").collect()}
    assert located["Base#shared"].startswith("pkg/base.py:")
    health = {(r.family, r.level): r for r in w.enrich("c", history.file_metrics(commits(spark), 1_701_500_000), None, 99).collect()}
    assert health["git", "file"].state == "healthy" and health["git", "file"].missing == w.read("c", "chunks").where("path NOT IN ('pkg/main.py', 'pkg/base.py')").count()
    assert health["codegraph", "chunk"].state == "healthy" and health["git", "chunk"].state == "absent"
    c = w.collection("c")
    top = c.rank_chunks({"custom": {"churn": 1.0}}, 50).select("relativePath", "rank_score").collect()
    assert top[0].relativePath == "pkg/main.py" and top[0].rank_score > 0
    called = c.rank_chunks({"custom": {"chunkFanIn": 1.0}}, 1).first()
    assert called.symbolId in {"Base#shared", "Main#own", "Main#loop", "Main#back"}
    assert {r.source_symbol_id for r in c.callers("Base#shared").collect()} == {"Main#run"} and {r.target_symbol_id for r in c.callees("Main#run").collect()} == {"Base#shared", "Main#own"}
    assert c.rank_chunks("hotspots", 5).count() <= 5 and c.find_similar_text("def own(self): return 2", 3).count() == 3
    # percentiles are stored with the collection, and made anew only for other chunks
    known = w._get("collections.json")["c"]["versions"]["statistics"]
    w.statistics("c")
    assert w._get("collections.json")["c"]["versions"]["statistics"] == known
    (tmp_path / "src" / "pkg" / "new.py").write_text("def fresh():\n    return 3\n")
    assert w.status("c", tree)["status"] == "stale"
    w.index("c", tree)
    w.statistics("c")
    assert w._get("collections.json")["c"]["versions"]["statistics"] == known + 1
    assert enrichment.pending(w.read("c", "chunks"), "git", "file").select("path").distinct().collect()[0].path == "pkg/new.py"
    assert "chunks of" in w.prime("c") and "python selfMember" in w.prime("c")
    w.copy("c", "branch")
    w.save("branch", f"file://{tmp_path}/backup")
    w.clear("branch")
    w.recover("branch", f"file://{tmp_path}/backup")
    assert w.read("branch", "chunks").count() == w.read("c", "chunks").count()
    with pytest.raises(WorkspaceError):
        w.recover("nothing", f"file://{tmp_path}/backup")
    w.guard("c", "one")
    with pytest.raises(WorkspaceError):
        w.guard("c", "two")
    out = run(spark, [f"file://{tmp_path}/w", "callers", "c", "Base#shared"])
    assert out[0]["source_symbol_id"] == "Main#run" and run(spark, [f"file://{tmp_path}/w", "list"])["collections"] == ["branch", "c"]
    assert run(spark, [f"file://{tmp_path}/w", "search", "c", "own return", "--limit", "2"])[0]["relativePath"].startswith("pkg/")


def test_index_resumes(spark, tmp_path, tree, monkeypatch):
    """A run that breaks off goes on where it was; what was committed is not made again."""
    from skarn import workspace

    w = Workspace(spark, f"file://{tmp_path}/w")
    made = []

    class Breaking(workspace.Index):
        def apply(self, batch, batch_id):
            if not self.applied(batch_id):
                made.append(batch_id)
            if batch_id == 5 and made.count(5) == 1:
                raise RuntimeError("lost")
            super().apply(batch, batch_id)

    monkeypatch.setattr(workspace, "Index", Breaking)
    with pytest.raises(RuntimeError):
        w.index("c", tree)
    assert w.status("c")["status"] == "indexing"
    w.index("c", tree)
    assert made == [0, 1, 2, 3, 4, 5, 5, 6, 7] and w.status("c")["status"] == "indexed"
    assert {r.path for r in w.read("c", "chunks").select("path").collect()} == set(SOURCES)


def test_join_again_replaces(spark):
    c = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id bigint, path string")
    s = spark.createDataFrame([("a", 5)], "file string, git_file_commitCount bigint")
    once = enrichment.join(c, s, "file", "git", "file", 10, "path")
    again = enrichment.join(once, s.withColumn("git_file_commitCount", F.lit(7)), "file", "git", "file", 20, "path")
    got = {r.id: (r.git_file_commitCount, r.git_file_enrichedAt, r.git_file_missing) for r in again.collect()}
    assert got == {1: (7, 20, False), 2: (None, 20, True), 3: (7, 20, False)} and len(set(again.columns)) == len(again.columns)
    assert enrichment.pending(once, "git", "file", 15).count() == 3 and enrichment.pending(once, "git", "file", 5).count() == 0


def test_projections(spark):
    df = spark.createDataFrame([(1, 0.5, "x", 7, 3, "ann", 2.0)], "id bigint, rank_score double, content string, git_file_commitCount bigint, git_chunk_commitCount bigint, git_file_blameDominantAuthor string, git_file_relativeChurn double")
    shown = enrichment.overlay(df, {"file": ["commitCount", "blameDominantAuthor", "gone"], "chunk": []}).first().overlay
    assert shown.file == {"commitCount": "7", "blameDominantAuthor": "ann"} and shown.chunk == {}
    active = enrichment.overlay(df, None, {"churn": 1.0, "similarity": 0.5}).first().overlay
    assert active.file == {"commitCount": "7"} and active.chunk == {"commitCount": "3"}
    some = enrichment.essential(df)
    assert some.columns == ["id", "rank_score", "content", "git"] and "relativeChurn" not in some.schema.simpleString() and some.first().git.file.commitCount == 7
    assert enrichment.document_preset(None, "markdown") == enrichment.document_preset(None, None, "only") == "documentationRelevance" and enrichment.document_preset("recent", "markdown") == "recent" and enrichment.document_preset(None) is None
    a, b = spark.createDataFrame([(1, "a")], "id bigint, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "id bigint, v string")
    assert sorted((r.id, r.v) for r in enrichment.merged([a, b]).collect()) == [(1, "a"), (2, "b")]


def test_attach_chunks(spark):
    chunks = spark.createDataFrame([("f", "c1", "A", 1, 20), ("f", "c2", "A#m", 5, 9), ("f", "c3", "A", 21, 30)], "rel_path string, chunk_id string, symbol_id string, start_line bigint, end_line bigint")
    symbols = spark.createDataFrame([("f", "A", 1), ("f", "A#m", 5), ("f", "A#inner", 7), ("f", "gone", 99), ("g", "A", 1)], "rel_path string, symbol_id string, line bigint")
    got = {(r.rel_path, r.symbol_id): r.chunk_id for r in enrichment.attach_chunks(symbols, chunks).collect()}
    assert got == {("f", "A"): "c3", ("f", "A#m"): "c2", ("f", "A#inner"): "c2", ("f", "gone"): None, ("g", "A"): None}


def test_registry(spark):
    r = registry.Registry()
    size = registry.Trajectory(
        "size", payload=[catalog.Signal("size.lines", "number", {50: "mid"}, (50,))], derived={"bulk": (catalog.Derived("bulk", ("contentSize",), 100.0, None, False), lambda x: F.least(F.lit(1.0), x.payload["contentSize"] / 100.0))},
        filters={"minSize": lambda p, v, level: p["contentSize"] >= v}, filter_presets={"big": [catalog.Condition("must", "contentSize", "gte", 50.0)]}, presets=[catalog.Preset("size", "largest", ("rank_chunks",), None, None, None, {"bulk": 1.0})],
        accumulators={"total": lambda c: F.sum("contentSize")}, provider=lambda c: c.withColumn("size_lines", F.lit(1)),
    )
    r.register(size)
    for bad in (size, registry.Trajectory("x", derived={"churn": (None, None)}), registry.Trajectory("x", presets=[catalog.Preset("x", "p", (), None, None, None, {"nothing": 1.0})]), registry.Trajectory("x", filter_presets={"q": [catalog.Condition("must", "git.file.commitCount", "gte", 1.0, 33)]}), registry.Trajectory("x", filters={"language": None})):
        with pytest.raises(registry.RegistryError):
            r.register(bad)
    c = spark.createDataFrame([(1, 20, 0.0), (2, 80, 0.0), (3, 500, 0.0)], "id bigint, contentSize bigint, score double")
    with r.installed():
        assert [round(x.rank_score, 2) for x in rank.score(c, "largest").orderBy("id").collect()] == [0.2, 0.8, 1.0]
        assert c.where(filters.typed(c, minSize=80)).count() == 2 and c.where(filters.preset(c, "big")).count() == 2
    assert "bulk" not in catalog.DERIVED and "largest" not in catalog.presets() and r.accumulate(c).first().total == 600 and "size_lines" in r.enrich(c).columns
    registry.validate()


def test_run_statistics_feed_the_summary(spark):
    runs = spark.createDataFrame([("python", "bareCall", 4, 3, 0, 0, 1, 0, 0)], "language string, receiver_kind string, " + ", ".join(f"{c} bigint" for c in graph.RUN_COUNTS))
    assert graph.resolve_summary(runs).where("grain = 'total'").first().edge_recall == 1.0
