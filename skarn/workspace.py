"""Collections and projects in a folder: create, fill, index, describe, drop.

A collection is a folder of tables (``documents``, ``chunks``, ``snapshot``) in versions,
with a small JSON file that says which version of each counts.  A version is complete
before the file names it, so a broken job leaves the collection as it was.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Collection
from .functions.text import matches_glob
from .operators import enrichment, graph, resolution, retrieval, stats, sync
from .plans.catalog import DERIVED, FILTER_PRESETS, SIGNALS, presets
from .plans.filters import PARAMETERS
from .sources import tree, walkers
from .storage import upsert
from .streaming.incremental import Index

DISTANCES = ("cosine", "dot", "euclid")
#: The name of the embedding that ``retrieval.hashed_embedding`` makes.
MODEL = "hashed"
#: Groups of files that an index run commits one after another.
RUN_STEPS = 8


class WorkspaceError(ValueError):
    pass


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- small files and folders, in any store Spark knows ----------------------

    def _path(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _get(self, name: str) -> dict:
        p, fs = self._path(name)
        if not fs.exists(p):
            return {}
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, value: dict) -> None:
        p, fs = self._path(name)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()

    def _drop(self, name: str) -> None:
        p, fs = self._path(name)
        fs.delete(p, True)

    # -- collections -------------------------------------------------------------

    def create(self, name: str, distance: str = "cosine", hybrid: bool = True, width: int = 64) -> None:
        if distance not in DISTANCES:
            raise WorkspaceError(f"distance is one of {DISTANCES}")
        known = self._get("collections.json")
        if name in known:
            raise WorkspaceError(f"collection {name} exists")
        self._put("collections.json", known | {name: {"distance": distance, "hybrid": hybrid, "width": width, "versions": {}}})

    def list(self) -> list[str]:
        return sorted(self._get("collections.json"))

    def info(self, name: str) -> dict:
        known = self._get("collections.json")
        if name not in known:
            raise WorkspaceError(f"no collection {name}")
        sizes = {t: self.read(name, t).count() for t in known[name]["versions"]}
        return known[name] | {"rows": sizes}

    def delete(self, name: str) -> None:
        known = self._get("collections.json")
        known.pop(name, None)
        self._put("collections.json", known)
        self._drop(name)

    def read(self, name: str, table: str) -> DataFrame:
        versions = self._get("collections.json").get(name, {}).get("versions", {})
        if table not in versions:
            raise WorkspaceError(f"{name} has no {table}")
        return self.spark.read.parquet(f"{self.folder}/{name}/{table}/v{versions[table]}")

    def write(self, name: str, tables: dict[str, DataFrame]) -> None:
        """New versions of tables; all of them count from the same moment."""
        known = self._get("collections.json")
        if name not in known:
            raise WorkspaceError(f"no collection {name}")
        versions = dict(known[name]["versions"])
        for t, df in tables.items():
            new = versions.get(t, 0) + 1
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/{t}/v{new}")
            versions[t] = new
        self._put("collections.json", known | {name: known[name] | {"versions": versions}})

    # -- documents ----------------------------------------------------------------

    def add_documents(self, name: str, documents: DataFrame) -> None:
        """Insert or replace documents (id, text, more); their vectors are hashed from the text."""
        width = self._get("collections.json").get(name, {}).get("width", 64)
        new = documents.withColumn("vector", retrieval.hashed_embedding("text", width))
        has = "documents" in self._get("collections.json").get(name, {}).get("versions", {})
        self.write(name, {"documents": upsert(self.read(name, "documents"), new, "id") if has else new})

    def delete_documents(self, name: str, ids: Sequence) -> None:
        self.write(name, {"documents": self.read(name, "documents").where(~F.col("id").isin(list(ids)))})

    def guard(self, name: str, model: str) -> None:
        """A collection's vectors are of one model: the first one asked for, if none is noted."""
        known = self._get("collections.json")
        if name not in known:
            raise WorkspaceError(f"no collection {name}")
        if known[name].setdefault("model", model) != model:
            raise WorkspaceError(f"{name} holds vectors of {known[name]['model']}, not of {model}")
        self._put("collections.json", known)

    def search(self, name: str, text: str, limit: int = 5, model: str = MODEL) -> DataFrame:
        """Documents near a text, by the collection's distance."""
        self.guard(name, model)
        meta = self._get("collections.json")[name]
        q = self.spark.createDataFrame([(text,)], "t string").select(retrieval.hashed_embedding("t", meta["width"]).alias("v")).first().v
        return retrieval.dense(self.read(name, "documents"), q, limit, vec_col="vector", id_col="id", distance=meta["distance"])

    # -- code ----------------------------------------------------------------------

    def index(self, name: str, root: str, force: bool = False, languages: Sequence[str] | None = None, ignore: Iterable[str] = ()) -> DataFrame:
        """Index a source tree, or what changed in it since; (change, files) comes back."""
        if name not in self._get("collections.json"):
            self.create(name)
        self._mark(name, state="indexing", root=root)
        files = tree.scan(self.spark, root, list(ignore), list(languages) if languages else None)
        now = files.select("path", F.sha2("text", 256).alias("hash"))
        has = "snapshot" in self._get("collections.json")[name]["versions"] and not force
        if not has:
            self.write(name, {"chunks": self._resumed(name, files), "snapshot": now})
            self._drop(f"{name}/run")
            self._mark(name, state="indexed")
            return now.agg(F.lit("added").alias("change"), F.count("*").alias("files"))
        old = self.read(name, "snapshot")
        change = sync.diff(old, now)
        stale = change.where(F.col("change").isin("added", "modified", "deleted")).select("path")
        fresh = files.join(stale, "path", "left_semi")
        kept = self.read(name, "chunks").join(stale, "path", "left_anti")
        counts = self.spark.createDataFrame(change.groupBy("change").agg(F.count("*").alias("files")).collect(), "change string, files bigint")  # four rows at most
        new = self._resumed(name, fresh)
        self.write(name, {"chunks": kept.unionByName(new, allowMissingColumns=True), "snapshot": now})
        self._drop(f"{name}/run")
        self._mark(name, state="indexed")
        return counts

    def _mark(self, name: str, **values) -> None:
        known = self._get("collections.json")
        self._put("collections.json", known | {name: known[name] | values})

    def _resumed(self, name: str, files: DataFrame) -> DataFrame:
        """The chunks of files, made in steps: a run that broke off goes on with the steps it has not committed.

        The steps are groups of paths; the run's folder is named by what the files hold, so
        another state of the tree starts anew.
        """
        state = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "text").cast("decimal(38,0)")).alias("h")).first()
        run = Index(self.spark, f"{self.folder}/{name}/run/{state.n}-{abs(int(state.h or 0))}")
        group = F.pmod(F.xxhash64("path"), F.lit(RUN_STEPS))
        rows = files.select("path", "language", "text", F.lit(False).alias("deleted"), F.lit(0).cast("bigint").alias("seq"))
        for k in range(RUN_STEPS):
            run.apply(rows.where(group == k), k)
        return run.read()

    def status(self, name: str, root: str | None = None) -> dict:
        """not_indexed, indexing (or broken off), stale (with a root whose files have changed) or indexed."""
        known = self._get("collections.json")
        if name not in known or not known[name].get("versions", {}).get("chunks"):
            return {"status": "indexing" if known.get(name, {}).get("state") == "indexing" else "not_indexed"}
        out = {"status": known[name].get("state", "indexed"), "chunks": self.read(name, "chunks").count(), "files": self.read(name, "snapshot").count(), "enrichment": [r.asDict() for r in enrichment.health(self.read(name, "chunks")).collect()]}
        if root is not None and out["status"] == "indexed":
            now = tree.scan(self.spark, root).select("path", F.sha2("text", 256).alias("hash"))
            if not sync.diff(self.read(name, "snapshot"), now).where("change != 'unchanged'").isEmpty():
                out["status"] = "stale"
        return out

    def graph(self, name: str, root: str) -> dict[str, int]:
        """Resolve the calls of a source tree: the collection's edges, inheritance, symbols and run statistics."""
        files = tree.scan(self.spark, root)
        files = files.where(~enrichment.graph_exclusion("path"))
        facts = walkers.facts(walkers.walk(files))
        runs = [resolution.resolve(facts, r.language) for r in facts.calls.select("language").distinct().collect()]  # one row per language
        if not runs:
            return {}
        union = lambda key: reduce(DataFrame.unionByName, [r[key] for r in runs])
        located = enrichment.attach_chunks(facts.symbols.select("rel_path", "symbol_id", "language", "short_name", "scope").distinct(), self.read(name, "chunks").select(F.col("path").alias("rel_path"), F.concat_ws(":", "path", "chunk_index").alias("chunk_id"), "symbol_id", "start_line", "end_line"))
        tables = {"edges": union("edges"), "inheritance": facts.inheritance, "symbols": located, "runs": resolution.statistics(union("outcomes"))}
        self.write(name, tables)
        cycles = find_cycles(self.read(name, "edges").where("source_rel_path != target_rel_path"), None, "source_rel_path", "target_rel_path")
        methods = find_cycles(self.read(name, "edges").where("source_symbol_id IS NOT NULL AND target_symbol_id IS NOT NULL"), None, "source_symbol_id", "target_symbol_id")
        self.write(name, {"cycles": cycles.withColumn("kind", F.lit("file")).unionByName(methods.withColumn("kind", F.lit("method")))})
        return {t: self.read(name, t).count() for t in (*tables, "cycles")}

    def payload(self, name: str) -> DataFrame:
        """A collection's chunks under the names of the payload, with vectors hashed from their text."""
        c = self.read(name, "chunks")
        lines = F.col("end_line") - F.col("start_line") + 1
        extension = F.regexp_extract("path", r"(\.[^./]+)$", 1)
        made = {
            "id": F.concat_ws(":", "path", "chunk_index"), "relativePath": F.col("path"), "fileExtension": extension, "startLine": F.col("start_line"), "endLine": F.col("end_line"), "chunkIndex": F.col("chunk_index"), "isDocumentation": F.col("is_documentation"),
            "isTest": F.coalesce(tree.kind("path", F.col("content")) == "test", F.lit(False)), "chunkType": F.col("chunk_type"), "parentSymbolId": F.col("parent_symbol_id"), "parentType": F.col("parent_type"), "symbolId": F.col("symbol_id"), "headingPath": F.col("heading_path"), "methodLines": lines.cast("bigint"),
            "methodDensity": F.floor(F.length("content") / F.greatest(lines, F.lit(1))), "contentSize": F.length("content").cast("bigint"),
        }
        raw = {"path", "chunk_index", "chunk_type", "symbol_id", "parent_symbol_id", "parent_type", "heading_path", "is_documentation", "start_line", "end_line"}
        return c.select(*[v.alias(k) for k, v in made.items()], *[F.col(f"`{x}`") for x in c.columns if x not in raw and x not in made])

    def enrich(self, name: str, git_file: DataFrame | None = None, git_chunk: DataFrame | None = None, now: int = 0) -> DataFrame:
        """Join history metrics, and the graph's signals if there is one, onto the chunks; the health of each family comes back.

        git_file: as ``history.file_metrics`` with ``file``; git_chunk: as ``history.chunk_metrics``
        with ids ``path:index``.
        """
        c = self.read(name, "chunks").withColumn("_id", F.concat_ws(":", "path", "chunk_index"))
        versions = self._get("collections.json")[name]["versions"]
        calls = self.read(name, "edges") if "edges" in versions else None
        files = calls.where("target_rel_path IS NOT NULL AND source_rel_path != target_rel_path").select(F.col("source_rel_path").alias("src"), F.col("target_rel_path").alias("dst")).distinct() if calls is not None else None
        done = enrichment.overlays(c, git_file, git_chunk, files, calls, now, "path", "_id", "symbol_id")
        self.write(name, {"chunks": done.drop("_id")})
        return enrichment.health(self.read(name, "chunks"))

    def statistics(self, name: str) -> DataFrame:
        """The collection's percentiles: stored with it, and made anew when its chunks are of another version."""
        known = self._get("collections.json")[name]
        version = known["versions"].get("chunks")
        if known.get("statistics_of") != version or "statistics" not in known["versions"]:
            c = self.payload(name)
            self.write(name, {"statistics": stats.signal_percentiles(c.withColumn("scope", stats.scope(c)))})
            self._mark(name, statistics_of=version)
        return self.read(name, "statistics")

    def vectors(self, name: str, width: int = 64) -> DataFrame:
        """(id, vector): stored with the collection; of a new version of its chunks only changed contents are hashed."""
        known = self._get("collections.json")[name]
        of = [known["versions"].get("chunks"), width]
        if known.get("vectors_of") != of or "vectors" not in known["versions"]:
            c = self.payload(name).select("id", "content", F.sha2("content", 256).alias("hash"))
            make = lambda df: df.select("id", "hash", retrieval.hashed_embedding("content", width).alias("vector"))
            if "vectors" in known["versions"] and known.get("vectors_of", [None, None])[1] == width:
                old = self.read(name, "vectors")
                made = c.select("id", "hash").join(old, ["id", "hash"]).unionByName(make(c.join(old, ["id", "hash"], "left_anti")))
            else:
                made = make(c)
            self.write(name, {"vectors": made})
            self._mark(name, vectors_of=of)
        return self.read(name, "vectors").select("id", "vector")

    def collection(self, name: str, width: int = 64) -> Collection:
        """What is stored, for queries: chunks, vectors, statistics and, where there is one, the graph."""
        c = self.payload(name)
        versions = self._get("collections.json")[name]["versions"]
        some = lambda t: self.read(name, t) if t in versions else None
        return Collection(c, self.vectors(name, width), self.statistics(name), some("edges"), some("inheritance"))

    def copy(self, name: str, to: str) -> None:
        """A collection's tables under another name (a branch's index begins as a copy)."""
        known = self._get("collections.json")
        if to in known:
            raise WorkspaceError(f"collection {to} exists")
        for table, v in known[name]["versions"].items():
            self.spark.read.parquet(f"{self.folder}/{name}/{table}/v{v}").write.parquet(f"{self.folder}/{to}/{table}/v{v}")
        self._put("collections.json", known | {to: known[name]})

    def save(self, name: str, folder: str) -> None:
        """A snapshot of a collection in a folder of its own."""
        other = Workspace(self.spark, folder)
        meta = self._get("collections.json")[name]
        for table, v in meta["versions"].items():
            self.read(name, table).write.mode("overwrite").parquet(f"{other.folder}/{name}/{table}/v{v}")
        other._put("collections.json", other._get("collections.json") | {name: meta})

    def recover(self, name: str, folder: str) -> None:
        """A collection as its snapshot has it, in place of what is here."""
        other = Workspace(self.spark, folder)
        meta = other._get("collections.json").get(name)
        if meta is None:
            raise WorkspaceError(f"no snapshot of {name} in {folder}")
        self._drop(name)
        for table, v in meta["versions"].items():
            other.read(name, table).write.parquet(f"{self.folder}/{name}/{table}/v{v}")
        self._put("collections.json", self._get("collections.json") | {name: meta})

    def prime(self, name: str) -> str:
        """A short text about a collection: what it holds, its health, how well calls resolve."""
        s = self.status(name)
        lines = [f"{name}: {s['status']}"]
        if "chunks" in s:
            lines.append(f"{s['chunks']} chunks of {s['files']} files")
            lines += [f"{r['family']} {r['level']}: {r['state']} ({r['enriched']} of {r['chunks']}, {r['missing']} without signals)" for r in s["enrichment"]]
            lines += [f"{r.language} {r.chunk_type}: {r.chunks} chunks of {r.files} files" for r in self.metrics(name).orderBy("language", "chunk_type").collect()]  # a row per language and type
        if "runs" in self._get("collections.json").get(name, {}).get("versions", {}):
            runs = self.read(name, "runs")
            lines += [f"{r.language} {r.receiver_kind}: {r.resolved} of {r.attempted} calls, recall {r.edge_recall:.2f}" for r in graph.resolve_summary(runs).where("grain = 'kind'").orderBy("language", "receiver_kind").collect()]  # a row per language and kind
        return "\n".join(lines)

    def metrics(self, name: str) -> DataFrame:
        """Chunks and files per language and chunk type."""
        return self.read(name, "chunks").groupBy("language", "chunk_type").agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("files"))

    def clear(self, name: str) -> None:
        known = self._get("collections.json")
        if name in known:
            self._drop(name)
            self._put("collections.json", known | {name: known[name] | {"versions": {}}})

    # -- projects --------------------------------------------------------------------

    def register(self, project: str, path: str, collection: str | None = None) -> None:
        self._put("projects.json", self._get("projects.json") | {project: {"path": path, "collection": collection or project}})

    def unregister(self, project: str) -> None:
        known = self._get("projects.json")
        known.pop(project, None)
        self._put("projects.json", known)

    def projects(self) -> dict:
        return self._get("projects.json")

    def resolve(self, collection: str | None = None, project: str | None = None, path: str | None = None) -> str:
        """A named collection counts before a project, and that before a path."""
        if collection:
            return collection
        known = self.projects()
        if project:
            if project not in known:
                raise WorkspaceError(f"no project {project}")
            return known[project]["collection"]
        hit = [p["collection"] for p in known.values() if path and (path == p["path"] or path.startswith(p["path"].rstrip("/") + "/"))]
        if not hit:
            raise WorkspaceError("name a collection, a project or a path of one")
        return hit[0]


def find_cycles(edges: DataFrame, path_pattern: str | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """Cycles of two members and more; with a pattern, those with any member that matches."""
    found = graph.cycles(graph.strong_components(edges, src, dst))
    if path_pattern is None:
        return found
    return found.join(found.where(matches_glob("member", path_pattern)).select("cycle_id").distinct(), "cycle_id", "left_semi")


def drift(stored: Sequence[str]) -> dict[str, list[str]]:
    """Declared signals that a stored table lacks, and columns of it that are not declared."""
    return {"missing": sorted(set(SIGNALS) - set(stored)), "undeclared": sorted(set(stored) - set(SIGNALS))}


def describe(tool: str | None = None) -> dict[str, list[str]]:
    """Names of presets (those that one tool offers), signals, filters and their presets."""
    chosen = [n for n, p in presets().items() if tool is None or tool in p.tools]
    return {"presets": sorted(chosen), "signals": sorted(DERIVED), "payload": sorted(SIGNALS), "filters": sorted(PARAMETERS), "filter_presets": sorted(FILTER_PRESETS)}


def percentile_metrics(collection_chunks: DataFrame) -> DataFrame:
    """What each label begins at, per collection, language and scope."""
    scoped = collection_chunks.withColumn("scope", stats.scope(collection_chunks))
    return stats.thresholds(stats.signal_percentiles(scoped))
