"""Symbol lookup, outlines, navigation and chunk merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import doc_symbol_id, last_segment

# Merging of small chunks.
SMALL_LINES, MERGE_GAP, MERGED_TYPES = 5, 2, ("block", "interface")
FETCH = 200


def _is_part(c: str = "symbol_id") -> Column:
    return F.regexp_replace(c, r"#part\d+$", "")


def find(chunks: DataFrame, query: str, exact: bool = False, limit: int = FETCH) -> DataFrame:
    """Chunks of a symbol and its members: exact ids first, then by path.

    Without ``exact`` the last segment of a symbol or its parent decides.
    """
    q = F.lit(query)
    base, parent = _is_part("symbol_id"), F.coalesce("parent_symbol_id", F.lit(""))
    full = (base == q) | (parent == q) | (parent == last_segment(q))
    near = (last_segment(base) == last_segment(q)) | (last_segment(parent) == last_segment(q))
    hits = chunks.where(full if exact else near)
    order = F.when(F.lower(base) == query.lower(), 0).otherwise(1)
    return hits.orderBy(order, "relative_path", "start_line", "chunk_id").limit(limit)


def merge_fragments(chunks: DataFrame, joined: bool = False) -> DataFrame:
    """Parts of one symbol folded into one row: lines from the first to the last part."""
    order = F.struct("start_line", "chunk_id", "content")
    parts = F.sort_array(F.collect_list(order))
    content = F.array_join(F.transform("parts", lambda p: p["content"]), "\n") if joined else F.element_at("parts", 1)["content"]
    out = chunks.groupBy("relative_path", _is_part().alias("symbol_id")).agg(parts.alias("parts"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    return out.select("relative_path", "symbol_id", "start_line", "end_line", content.alias("content"), F.transform("parts", lambda p: p["chunk_id"]).alias("merged_chunk_ids"))


def class_outline(chunks: DataFrame) -> DataFrame:
    """(relative_path, symbol_id, outline, content_size, chunk_count) of each container."""
    members = chunks.where(F.col("parent_symbol_id").isNotNull())
    order = F.sort_array(F.collect_list(F.struct("start_line", "symbol_id")))
    out = members.groupBy("relative_path", "parent_symbol_id").agg(order.alias("m"), F.sum("content_size").alias("content_size"), F.count("*").alias("chunk_count"))
    lines = F.array_distinct(F.transform("m", lambda x: F.concat(F.lit("  "), F.regexp_replace(x["symbol_id"], r"#part\d+$", ""))))
    return out.select("relative_path", F.col("parent_symbol_id").alias("symbol_id"), F.array_join(F.concat(F.array("parent_symbol_id"), lines), "\n").alias("outline"), "content_size", "chunk_count")


def file_outline(chunks: DataFrame) -> DataFrame:
    """(relative_path, outline): a file's symbols in order, members indented."""
    line = F.concat(F.when(F.col("parent_symbol_id").isNull(), "").otherwise("  "), _is_part())
    order = F.sort_array(F.collect_list(F.struct("start_line", "chunk_id", line.alias("line"))))
    return chunks.groupBy("relative_path").agg(F.array_join(F.array_distinct(F.transform(order, lambda x: x["line"])), "\n").alias("outline"))


def doc_toc(chunks: DataFrame) -> DataFrame:
    """(relative_path, symbol_id, toc): headings by first appearance, indented by depth."""
    heads = chunks.select("relative_path", "start_line", "chunk_id", F.posexplode("heading_path").alias("at", "h"))
    w = Window.partitionBy("relative_path", "h.depth", "h.text").orderBy("start_line", "chunk_id", "at")
    first = heads.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    order = F.sort_array(F.collect_list(F.struct("start_line", "chunk_id", "at", "h.depth", "h.text")))
    line = F.transform(order, lambda x: F.concat(F.repeat(F.lit("  "), x["depth"] - 1), x["text"]))
    return first.groupBy("relative_path").agg(F.array_join(line, "\n").alias("toc"), doc_symbol_id("relative_path", F.transform(order, lambda x: x["text"])).alias("symbol_id"))


def navigation(chunks: DataFrame, path: str = "relative_path", order: str = "chunk_index") -> DataFrame:
    """Each chunk with the symbols before and after it in its file."""
    w = Window.partitionBy(path).orderBy(order)
    return chunks.withColumn("previous_symbol", F.lag("symbol_id").over(w)).withColumn("next_symbol", F.lead("symbol_id").over(w))


def disambiguated(symbols: DataFrame, path: str = "relative_path", symbol: str = "symbol_id", order: str = "start_line") -> DataFrame:
    """The second and later symbols of one id in a file get ``~2``, ``~3``."""
    n = F.row_number().over(Window.partitionBy(path, symbol).orderBy(order))
    return symbols.withColumn(symbol, F.when(n == 1, F.col(symbol)).otherwise(F.concat(F.col(symbol), F.lit("~"), n)))


def merge_small(chunks: DataFrame, small: int = SMALL_LINES, gap: int = MERGE_GAP, max_chars: int = 2500) -> DataFrame:
    """Neighbouring small chunks of the kinds that may merge, folded into one.

    A run goes on while the next small chunk begins at most ``gap`` lines on; runs of one
    or too large in sum stay as they are.
    """
    can = F.col("chunk_type").isin(*MERGED_TYPES) & (F.col("end_line") - F.col("start_line") + 1 <= small)
    w = Window.partitionBy("relative_path").orderBy("start_line", "chunk_id")
    before, before_can = F.lag("end_line").over(w), F.lag("_can").over(w)
    rows = chunks.withColumn("_can", can)
    new = F.when(F.col("_can") & F.coalesce(before_can, F.lit(False)) & (F.col("start_line") - before - 1 <= gap), 0).otherwise(1)
    rows = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("relative_path", "_run")
    rows = rows.withColumn("_fits", (F.count("*").over(run) >= 2) & (F.sum(F.length("content")).over(run) <= max_chars))
    rows = rows.withColumn("_key", F.when(F.col("_fits"), F.concat(F.lit("run"), "_run")).otherwise(F.col("chunk_id").cast("string")))
    parts = F.sort_array(F.collect_list(F.struct("start_line", "chunk_id", "content")))
    out = rows.groupBy("relative_path", "_key").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.min("chunk_type").alias("chunk_type"), parts.alias("p"))
    return out.select("relative_path", "start_line", "end_line", "chunk_type", F.array_join(F.transform("p", lambda x: x["content"]), "\n").alias("content"), F.transform("p", lambda x: x["chunk_id"]).alias("chunk_ids"))


def symbol_mass(chunks: DataFrame, containers: DataFrame) -> DataFrame:
    """(relative_path, member_count, module_methods, module_lines) per file and container.

    containers: relative_path, container_id; chunks: relative_path, parent_symbol_id,
    symbol_id, chunk_type, end_line.
    """
    members = chunks.where("parent_symbol_id IS NOT NULL").groupBy("relative_path", F.col("parent_symbol_id").alias("container_id")).agg(F.countDistinct("symbol_id").alias("member_count"))
    files = chunks.groupBy("relative_path").agg(F.countDistinct(F.when(F.col("chunk_type") == "function", F.col("symbol_id"))).alias("module_method_count"), F.max("end_line").alias("module_lines"))
    return containers.join(members, ["relative_path", "container_id"], "left").join(files, "relative_path", "left").select("relative_path", "container_id", F.coalesce("member_count", F.lit(0)).alias("member_count"), "module_method_count", "module_lines")
