"""The public entry point: a collection of chunks and vectors and its queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph, retrieval, stats, symbols
from .plans import filters, rank
from .plans.catalog import SIGNALS
from .plans.payload import Payload


class Collection:
    """Chunks with payload, vectors, and the collection's statistics.

    ``chunks`` and ``vectors`` share the column ``id``; vectors have ``vector``.
    """

    def __init__(self, chunks: DataFrame, vectors: DataFrame | None = None, statistics: DataFrame | None = None, edges: DataFrame | None = None, inheritance: DataFrame | None = None, post: DataFrame | None = None):
        self.chunks, self.vectors, self.edges, self.inheritance, self.post = chunks, vectors, edges, inheritance, post
        self.statistics = stats.as_mapping(statistics) if statistics is not None else None

    def _filtered(self, df: DataFrame, params: Mapping | None, spec, default: str | None, level: str | None) -> DataFrame:
        kept = df.where(filters.typed(df, level, **(params or {})))
        return kept.where(filters.resolve(kept, spec, default, self.statistics))

    def semantic_search(self, query: Sequence[float], limit: int = 10, offset: int = 0, rerank=None, params: Mapping | None = None, filter=None, level: str | None = None, text: str | None = None) -> DataFrame:
        """Dense search, reranked by a preset or custom weights."""
        _, preset = rank.resolve_mode(rerank)
        level = level or (preset.level if preset else None)
        rows = self._filtered(self.chunks.join(self.vectors, "id"), params, filter, preset.filter if preset else None, level)
        hits = retrieval.dense(rows, query, rank.fetch_size(limit, offset, rerank is not None), vec_col="vector", id_col="id")
        return self._ranked(hits, rerank, limit, offset, level, text, preset)

    def hybrid_search(self, text: str, query: Sequence[float], limit: int = 10, rerank=None, dense_weight: float | None = None, params: Mapping | None = None, filter=None) -> DataFrame:
        """Dense and BM25 lists fused, then reranked."""
        _, preset = rank.resolve_mode(rerank)
        rows = self._filtered(self.chunks, params, filter, preset.filter if preset else None, None)
        kept = self.vectors.join(rows.select("id"), "id", "left_semi").withColumnRenamed("vector", "embedding")
        post = self.post.join(rows.select("id"), "id", "left_semi") if self.post is not None else None
        fused = retrieval.hybrid(rows.withColumnRenamed("content", "text"), kept, text, query, rank.fetch_size(limit), dense_weight, "id", "id", post)
        return self._ranked(rows.join(fused, "id"), rerank, limit, 0, None, text, preset)

    def _embedded(self, texts: Sequence[str], width: int) -> list[list[float]]:
        """Hashed embeddings of some texts; blank ones have none."""
        rows = [(k, t) for k, t in enumerate(texts) if t and t.strip()]
        made = self.chunks.sparkSession.createDataFrame(rows, "k int, t string").select("k", retrieval.hashed_embedding("t", width).alias("v")) if rows else None
        return [r.v for r in made.orderBy("k").collect()] if made is not None else []  # one row a text given

    def find_similar_to(self, positive_ids: Sequence = (), positive_code: Sequence[str] = (), negative_ids: Sequence = (), negative_code: Sequence[str] = (), strategy: str = "best_score", limit: int = 10, offset: int = 0, extensions: Sequence[str] = (), level: str | None = None, rerank=None, width: int = 64) -> DataFrame:
        """Chunks like some chunks and blocks of code and unlike others; with level ``file``, files by their best chunk.

        Chunks that are given by id are not among the results; an unknown id is an error.
        """
        given = [*positive_ids, *negative_ids]
        stored = {r.id: [float(x) for x in r.vector] for r in self.vectors.where(F.col("id").isin(given)).select("id", "vector").collect()} if given else {}  # one row an id given
        missing = [i for i in given if i not in stored]
        if missing:
            raise KeyError(f"no chunk {missing[0]}")
        positive = [*[stored[i] for i in positive_ids], *self._embedded(positive_code, width)]
        negative = [*[stored[i] for i in negative_ids], *self._embedded(negative_code, width)]
        rows = self.chunks.where(F.col("fileExtension").isin(list(extensions))) if extensions else self.chunks
        fetch = (limit + offset) * 3 if level == "file" else rank.fetch_size(limit, offset, rerank is not None)
        hits = retrieval.recommend(rows.join(self.vectors, "id"), positive, negative, strategy, fetch, given, "vector", "id")
        if level == "file":
            return retrieval.file_level(hits, "relativePath", "id", limit)
        return self._ranked(hits, rerank, limit, offset, level, None, rank.resolve_mode(rerank)[1])

    def find_similar_text(self, code: str, limit: int = 10, rerank=None, width: int = 64) -> DataFrame:
        """Chunks like a block of code, by the hashed embedding of its text."""
        return self.find_similar_to(positive_code=[code], limit=limit, rerank=rerank, width=width)

    def ordered(self, source: str, limit: int = 10, level: str = "file", ascending: bool = False, params: Mapping | None = None) -> DataFrame:
        """Chunks in order of one signal's payload field; those without it are left out.

        ``source`` is a declared path or, for a signal of history, its part below the level (``commitCount``).
        """
        name = next((k for k in (source, f"git.{level}.{source}", f"codegraph.{level}.{source}") if k in SIGNALS), source)
        value = Payload(self.chunks)[name]
        rows = self._filtered(self.chunks, params, None, None, level).withColumn("order_value", value).where("order_value IS NOT NULL")
        order = F.col("order_value").asc() if ascending else F.col("order_value").desc()
        return rows.orderBy(order, "id").limit(limit)

    def find_similar(self, positive: Sequence[Sequence[float]], negative: Sequence[Sequence[float]] = (), strategy: str = "best_score", limit: int = 10, rerank=None) -> DataFrame:
        hits = retrieval.recommend(self.chunks.join(self.vectors, "id"), positive, negative, strategy, rank.fetch_size(limit), vec_col="vector", id_col="id")
        return self._ranked(hits, rerank, limit, 0, None, None, rank.resolve_mode(rerank)[1])

    def rank_chunks(self, rerank, limit: int = 10, params: Mapping | None = None, filter=None, level: str | None = None) -> DataFrame:
        """All chunks by a preset's signals, without a query: similarity has no part."""
        weights, preset = rank.resolve_mode(rerank)
        weights.pop("similarity", None)
        level = level or (preset.level if preset else None)
        rows = self._filtered(self.chunks, params, filter, preset.filter if preset else None, level).withColumn("score", F.lit(0.0))
        scored = rank.score(rows, {"custom": weights}, self.statistics, level)
        if level == "file":
            scored = rank.group_top(scored, "relativePath", "id")
        return rank.top(scored, limit, "id")

    def _ranked(self, hits: DataFrame, rerank, limit: int, offset: int, level: str | None, text: str | None, preset) -> DataFrame:
        scored = rank.score(hits, rerank, self.statistics, level, text)
        if level == "file":
            scored = rank.group_top(scored, "relativePath", "id")
        elif preset is not None and preset.group_by and preset.group_by in scored.columns:
            scored = rank.group_top(scored, preset.group_by, "id")
        return rank.top(scored, limit, "id", offset)

    def labelled(self, df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
        """Columns ``label_KEY`` for signals with labels, by the collection's statistics."""
        chosen = keys or [k for k, s in SIGNALS.items() if s.labels]
        return df.withColumns({f"label_{k.replace('.', '_')}": rank.signal_label(df, k, self.statistics or {}) for k in chosen})

    def find_symbol(self, symbol: str, exact: bool = False) -> DataFrame:
        return symbols.find(self.chunks, symbol, exact)

    def callers(self, symbol: str, limit: int = graph.CALLERS_LIMIT) -> DataFrame:
        return graph.callers(self.edges, self.inheritance, symbol, limit)

    def callees(self, symbol: str, limit: int = graph.CALLERS_LIMIT) -> DataFrame:
        known = self.chunks.select(F.col("symbolId").alias("symbol_id"), F.col("relativePath").alias("rel_path")).where("symbol_id IS NOT NULL").distinct()
        return graph.callees(self.edges, self.inheritance, known, symbol, limit)

    def trace_path(self, start: str, end: str, depth: int = graph.TRACE_DEPTH, limit: int = graph.TRACE_PATHS, rerank=None) -> DataFrame:
        """Simple paths of calls; with a preset or weights, by the worst of their steps' scores."""
        found = graph.paths(self.edges, start, end, depth, limit, "source_symbol_id", "target_symbol_id")
        if rerank is None:
            return found
        weights, _ = rank.resolve_mode(rerank)
        weights.pop("similarity", None)
        steps = self.chunks.join(found.select(F.explode("path").alias("symbolId")).distinct(), "symbolId", "left_semi").withColumn("score", F.lit(0.0))
        scored = rank.score(steps, {"custom": weights}, self.statistics).groupBy(F.col("symbolId").alias("node")).agg(F.max("rank_score").alias("rank_score"))
        return graph.danger(found, scored)

    @staticmethod
    def meta_only(df: DataFrame) -> DataFrame:
        """Results without contents: ids, scores and declared payload columns."""
        known = {k.replace(".", "_") for k in SIGNALS} | set(SIGNALS) | {"id", "score", "rank_score", "git", "codegraph", "members"}
        return df.select(*[c for c in df.columns if c in known])
