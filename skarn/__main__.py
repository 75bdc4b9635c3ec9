"""Command line: ``python -m skarn FOLDER COMMAND ...`` on a folder of collections."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans.catalog import FILTER_PRESETS, presets
from .workspace import Workspace, WorkspaceError, describe


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skarn", description=__doc__)
    p.add_argument("folder", help="where collections are kept, in any store Spark knows")
    c = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args, **opts: [(s := c.add_parser(name, **opts)), [s.add_argument(a) for a in args]][0]
    add("index", "collection", "root", help="index a source tree, or what changed in it").add_argument("--force", action="store_true")
    add("graph", "collection", "root", help="resolve the calls of a source tree")
    for name, text in (("status", "state and health"), ("metrics", "chunks per language and type"), ("prime", "a short text about it"), ("clear", "drop its tables"), ("delete", "drop it"), ("cycles", "cycles of files and methods")):
        add(name, "collection", help=text)
    s = add("search", "collection", "text", help="chunks near a text")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--rerank", choices=sorted(presets()))
    s = add("rank", "collection", "preset", help="chunks by a preset, without a query")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--filter", choices=sorted(FILTER_PRESETS))
    for name, text in (("callers", "calls of a symbol"), ("callees", "calls by a symbol"), ("symbol", "chunks of a symbol")):
        add(name, "collection", "name", help=text)
    add("register", "project", "path", help="name a project")
    add("unregister", "project", help="forget a project")
    c.add_parser("list", help="collections and projects")
    c.add_parser("describe", help="presets, signals and filters")
    return p


def run(spark: SparkSession, argv: list[str]) -> object:
    """What a command line gives: text, a dictionary, or rows."""
    a = parser().parse_args(argv)
    w = Workspace(spark, a.folder)
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731  reports of bounded length
    named = getattr(a, "collection", None)
    match a.command:
        case "index":
            return rows(w.index(named, a.root, a.force))
        case "graph":
            return w.graph(named, a.root)
        case "status" | "prime":
            return getattr(w, a.command)(named)
        case "metrics":
            return rows(w.metrics(named))
        case "clear" | "delete":
            return getattr(w, a.command)(named)
        case "cycles":
            return rows(w.read(named, "cycles").orderBy("kind", "cycle_id", "position"))
        case "search":
            c = w.collection(named)
            q = c.chunks.sparkSession.createDataFrame([(a.text,)], "t string")
            from .operators.retrieval import hashed_embedding

            v = q.select(hashed_embedding("t", 64).alias("v")).first().v
            return rows(c.semantic_search(v, a.limit, rerank=a.rerank, text=a.text).select("id", "relativePath", "symbolId", "rank_score"))
        case "rank":
            c = w.collection(named)
            return rows(c.rank_chunks(a.preset, a.limit, filter={"presets": a.filter} if a.filter else None).select("id", "relativePath", "symbolId", "rank_score"))
        case "callers" | "callees":
            return rows(getattr(w.collection(named), a.command)(a.name))
        case "symbol":
            c = w.read(named, "chunks")
            from pyspark.sql import functions as F

            from .operators import symbols

            c = c.select(F.concat_ws(":", "path", "chunk_index").alias("chunk_id"), F.col("path").alias("relative_path"), "symbol_id", "parent_symbol_id", "start_line", "end_line")
            return rows(symbols.find(c, a.name))
        case "register":
            return w.register(a.project, a.path)
        case "unregister":
            return w.unregister(a.project)
        case "list":
            return {"collections": w.list(), "projects": w.projects()}
        case _:
            return describe()


def main() -> int:
    spark = SparkSession.builder.appName("skarn").getOrCreate()
    try:
        out = run(spark, sys.argv[1:])
    except WorkspaceError as e:
        print(e, file=sys.stderr)
        return 1
    if out is not None:
        print(out if isinstance(out, str) else json.dumps(out, default=str, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
