import pytest

from skarn.workspace import Workspace, WorkspaceError, describe, drift, find_cycles


def test_collections(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/w")
    w.create("c", "cosine")
    with pytest.raises(WorkspaceError):
        w.create("c")
    with pytest.raises(WorkspaceError):
        w.create("d", "taxicab")
    w.add_documents("c", spark.createDataFrame([(1, "parse the xml file"), (2, "open a socket"), (3, "")], "id int, text string"))
    w.add_documents("c", spark.createDataFrame([(2, "close a socket")], "id int, text string"))
    assert w.info("c")["rows"] == {"documents": 3}
    assert w.search("c", "closeSocket", 1).first().text == "close a socket"
    w.delete_documents("c", [1, 3])
    assert [r.id for r in w.read("c", "documents").collect()] == [2]
    assert w.list() == ["c"]
    w.delete("c")
    assert w.list() == []


def test_index(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def f():\n    pass\n")
    (src / "b.py").write_text("def g():\n    pass\n")
    w = Workspace(spark, f"file://{tmp_path}/w")
    assert w.status("p") == {"status": "not_indexed"}
    w.index("p", f"file://{src}")
    (src / "a.py").write_text("def h():\n    pass\n")
    (src / "b.py").unlink()
    (src / "c.py").write_text("def k():\n    pass\n")
    assert {r.change: r.files for r in w.index("p", f"file://{src}").collect()} == {"modified": 1, "deleted": 1, "added": 1}
    assert sorted(r.symbol_id for r in w.read("p", "chunks").collect()) == ["h", "k"]
    assert {k: v for k, v in w.status("p").items() if k != "enrichment"} == {"status": "indexed", "chunks": 2, "files": 2}
    assert w.metrics("p").first().chunks == 2
    w.register("proj", str(src), "p")
    assert w.resolve(project="proj") == w.resolve(path=f"{src}/a.py") == "p"
    w.unregister("proj")
    with pytest.raises(WorkspaceError):
        w.resolve(project="proj")
    w.clear("p")
    assert w.status("p")["status"] == "not_indexed"


def test_stored_vectors(spark, tmp_path, monkeypatch):
    """Vectors are kept with the collection; a new version hashes the contents that changed and no others."""
    from skarn.operators import retrieval

    src = tmp_path / "src"
    src.mkdir()
    for k in range(4):
        (src / f"f{k}.py").write_text(f"def f{k}():\n    return {k}\n")
    w = Workspace(spark, f"file://{tmp_path}/w")
    w.index("p", f"file://{src}")
    first = {r.id: r.vector for r in w.vectors("p").collect()}
    assert len(first) == 4 and w.info("p")["rows"]["vectors"] == 4
    hashed, real = [], retrieval.hashed_embedding
    monkeypatch.setattr(retrieval, "hashed_embedding", lambda text, width=64: hashed.append(text) or real(text, width))
    assert {r.id: r.vector for r in w.vectors("p").collect()} == first and not hashed
    (src / "f1.py").write_text("def g():\n    return 'other'\n")
    w.index("p", f"file://{src}")
    again = {r.id: r.vector for r in w.vectors("p").collect()}
    assert len(again) == 4 and hashed == ["content"] and sum(again[k] != v for k, v in first.items() if k in again) <= 1
    c = w.collection("p")
    text = "def g():\n    return 'other'\n"
    best = c.find_similar_to(positive_code=[text, "  "], limit=2).first()
    assert "other" in best.content
    ids = [r.id for r in c.find_similar_to(positive_ids=[best.id], limit=5).collect()]
    assert best.id not in ids and len(ids) == 3
    assert {r.relativePath for r in c.find_similar_to(positive_code=[text], negative_ids=[ids[0]], level="file", extensions=[".py"], limit=2).collect()} <= {f"f{k}.py" for k in range(4)}
    with pytest.raises(KeyError):
        c.find_similar_to(positive_ids=["nowhere"])
    assert [r.order_value for r in c.ordered("startLine", 2, ascending=True).collect()] == [1, 1]
    assert len(w.vectors("p", 16).first().vector) == 16


def test_descriptions(spark):
    assert len(describe()["signals"]) == 33 and "hotspots" in describe("rank_chunks")["presets"] and "relevance" not in describe("trace_path")["presets"]
    assert drift(["content"])["undeclared"] == ["content"]
    e = spark.createDataFrame([("a/x", "a/y"), ("a/y", "a/x"), ("b/x", "b/y"), ("b/y", "b/x")], "src string, dst string")
    assert {r.member for r in find_cycles(e, "a/*").collect()} == {"a/x", "a/y"}
