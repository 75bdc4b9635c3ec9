"""Benchmark decontamination by winnowing.

Fingerprints of a text are the smallest hash of each run of ``t`` consecutive k-gram
hashes.  A shared span of at least ``k + t - 1`` words has a run of hashes in common,
hence the same smallest one in both texts: no such span is missed.  With windows of
``w`` words, ``k = w // 2`` and ``t = w - k + 1`` give that guarantee.  Items shorter
than ``w`` words are one window of their own length and get their own k and t.

1. The benchmark becomes two tables: its distinct fingerprints (w, key), and its distinct
   windows (w, hash, words) with the items that have them.
2. Every document is fingerprinted.  Those of its fingerprints that a Bloom filter of the
   benchmark's (of bounded size, so that it may be sent to all) lets through are
   candidates: each carries the windows that hold it, that is the words around it, up to a
   window's length to both sides.
3. Candidates meet the fingerprints in a semi-join; what is left is extended: its windows
   meet the benchmark's distinct windows in a join on hash and words.  A long shared span
   has a fingerprint in each of its windows, so all of them are found.
4. Hits are counted per word and per item; the result joins back to the documents.

All joins are Spark's: a benchmark's side is broadcast while its files are small and
shuffled beyond that, so no benchmark is too large.  Each side of a join has one row per
distinct fingerprint or window of the benchmark, so a passage that many items share costs
no more than one; items are listed only for documents that are hit.

Defined results: null or empty texts have no words and no hits; an item without words
has no window; repeated items all count; a null item id counts as an empty string; an empty
benchmark hits nothing; repeated rows get equal results, one each; other columns are ignored
(``scan``) or passed on whatever their names (``drop_contaminated``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._jobs import arrow_stage, free_names, text_of, written


def _winnow(keys: np.ndarray, counts: np.ndarray, t: int) -> np.ndarray:
    """Marks of the k-gram positions chosen: the rightmost smallest of every t in a text.

    A text with fewer than t k-grams keeps its smallest one.
    """
    n = len(keys)
    chosen = np.zeros(n, bool)
    if not n:
        return chosen
    doc = np.repeat(np.arange(len(counts)), counts)
    length = max(n - t + 1, 1)
    best = np.arange(length)
    for j in range(1, t):
        other = np.minimum(np.arange(length) + j, n - 1)
        better = keys[other] <= keys[best]
        best = np.where(better, other, best)
    whole = doc[np.minimum(np.arange(length) + t - 1, n - 1)] == doc[:length]
    if n >= t:
        chosen[best[whole]] = True
    first = np.cumsum(counts) - counts
    for d in np.flatnonzero((counts > 0) & (counts < t)):
        a = first[d]
        chosen[a + counts[d] - 1 - int(np.argmin(keys[a : a + counts[d]][::-1]))] = True
    return chosen


def _shape(w: int) -> tuple[int, int]:
    """k and t for windows of w words."""
    k = max(1, w // 2)
    return k, w - k + 1


def _fingerprints(words: T.Words, counts: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, index of their first word) of the texts with these word counts."""
    k, t = _shape(w)
    keys, at, made = T.grams(words.hash, counts, k)
    mark = _winnow(keys, made, t)
    return keys[mark], at[mark]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


WINDOWS = "item string, w int, hash bigint, words string, key bigint"


def _windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """Rows of the benchmark: (item, w, hash, words) per window, and (w, key) per fingerprint."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            for raw in T.chunks(b.column(1)):
                c = raw.lowered()
                words = T.words(c, T.ALNUM)
                text = [c.text(x, y).decode() for x, y in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]
                size = np.minimum(words.counts, window)
                for w in np.unique(size[size > 0]).tolist():
                    counts = np.where(size == w, words.counts, 0)
                    mine = T.Words(*[x[np.repeat(size == w, words.counts)] for x in (words.starts, words.ends, words.doc, words.hash)], counts)
                    place = np.flatnonzero(np.repeat(size == w, words.counts))
                    hashes, at, _ = T.grams(mine.hash, counts, w)
                    n = len(hashes)
                    first = place[at].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([names[c.first + d] for d in mine.doc[at].tolist()], pa.string()), pa.array(np.full(n, w, np.int32)), pa.array(_signed(hashes)), pa.array([" ".join(text[i : i + w]) for i in first], pa.string()), pa.nulls(n, pa.int64())], ["item", "w", "hash", "words", "key"])
                    keys, _ = _fingerprints(mine, counts, w)
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.array(np.full(n, w, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array(_signed(keys))], ["item", "w", "hash", "words", "key"])

    return arrow_stage(rows, run, WINDOWS)


#: The Bloom filter of fingerprints has some 16 bits a key, within these powers of two.
FILTER_BITS = (16, 27)


def _filter(keys: DataFrame) -> tuple[int, bytes]:
    """Bits of a Bloom filter over ``key``; more keys than it holds only let more through."""
    bits = min(max((16 * keys.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    place = F.explode(F.array(*[F.pmod(F.shiftright("key", s), F.lit(1 << bits)) for s in (0, 32)])).alias("at")
    got = keys.select(place).groupBy((F.col("at") / 32).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(at, 32) as int))")).alias("bits")).toArrow()  # at most 2**22 rows
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return bits, table.tobytes()


CANDIDATES = "n_words bigint, w int, key bigint, windows array<struct<start:bigint,hash:bigint,words:string>>"
_WINDOW = pa.list_(pa.struct([("start", pa.int64()), ("hash", pa.int64()), ("words", pa.string())]))


def _candidates(rows: DataFrame, lengths: list[int], bits: int, table: bytes) -> DataFrame:
    """Per text one row with its words counted, and one per likely fingerprint with its windows."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(sent.value, np.uint32)
        low = np.int64((1 << bits) - 1)
        has = lambda x: ((seen[x >> 5] >> (x & 31).astype(np.uint32)) & np.uint32(1)).astype(bool)
        names = ["doc_id", "copy", "n_words", "w", "key", "windows"]
        for b in batches:
            for raw in T.chunks(b.column(2)):
                c = raw.lowered()
                words = T.words(c, T.ALNUM)
                mine = [b.column(i).slice(c.first, c.n) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*mine, pa.array(words.counts), pa.nulls(c.n, pa.int32()), pa.nulls(c.n, pa.int64()), pa.nulls(c.n, _WINDOW)], names)
                firsts = words.first
                for w in lengths:
                    keys, at = _fingerprints(words, words.counts, w)
                    keys = _signed(keys)
                    likely = has(keys & low) & has((keys >> 32) & low)
                    keys, at = keys[likely], at[likely]
                    if not len(keys):
                        continue
                    k, _ = _shape(w)
                    hashes, places, made = T.grams(words.hash, words.counts, w)
                    lists = []
                    for i in at.tolist():
                        d = int(words.doc[i])
                        begin, end = max(i - (w - k), int(firsts[d])), min(i, int(firsts[d + 1]) - w)
                        found = np.searchsorted(places, begin)
                        lists.append([{"start": p - int(firsts[d]), "hash": h, "words": " ".join(c.text(int(words.starts[x]), int(words.ends[x])).decode() for x in range(p, p + w))} for p, h in zip(range(begin, end + 1), _signed(hashes[found : found + max(end - begin + 1, 0)]).tolist(), strict=True)])
                    doc = pa.array(words.doc[at])
                    yield pa.RecordBatch.from_arrays([mine[0].take(doc), mine[1].take(doc), pa.nulls(len(at), pa.int64()), pa.array(np.full(len(at), w, np.int32)), pa.array(keys), pa.array(lists, _WINDOW)], names)

    return arrow_stage(rows, run, f"doc_id {kind}, copy bigint, {CANDIDATES}")


def _hits(rows: DataFrame, benchmark: DataFrame, window: int, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counted, hit, windows): (doc_id, copy, n_words) per row, (doc_id, copy, start, w, hash, words) per window hit, and the benchmark's."""
    made = written(_windows(benchmark, window, item_col, item_text_col), "benchmark")
    keys = written(made.where("key IS NOT NULL").select("w", "key").distinct(), "fingerprints")
    windows = made.where("key IS NULL").select("item", "w", "hash", "words")
    distinct = written(windows.select("w", "hash", "words").distinct(), "windows")
    lengths = sorted(r.w for r in keys.select("w").distinct().collect())  # at most ``window`` of them
    found = written(_candidates(rows, lengths, *_filter(keys)), "candidates")
    matched = found.where("key IS NOT NULL").join(keys, ["w", "key"], "left_semi").select("doc_id", "copy", "w", F.explode("windows").alias("x")).select("doc_id", "copy", "w", "x.*").distinct()
    hit = matched.join(distinct, ["w", "hash", "words"], "left_semi")
    return found.where("key IS NULL").select("doc_id", "copy", "n_words"), written(hit, "hits"), windows


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, copy, text): rows with an equal id and text are one text."""
    return text_of(docs, {"doc_id": id_col, "text": text_col}).select("doc_id", _copy(F.col("text")).alias("copy"), "text")


def _copy(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: words, words hit, the items whose windows occur in it.

    A word is hit if it lies inside any occurrence of a window.  ``items`` lists the
    item ids as strings in order; ``items_sha256`` is the digest of that list.
    """
    counted, hit, windows = _hits(_keyed(docs, id_col, text_col), benchmark, window, item_col, item_text_col)
    place = F.explode(F.sequence("start", F.col("start") + F.col("w") - 1)).alias("word")
    n_hit = hit.select("doc_id", "copy", place).distinct().groupBy("doc_id", "copy").agg(F.count("*").alias("n_hit"))
    of = hit.select("doc_id", "copy", "w", "hash", "words").distinct().join(windows.distinct(), ["w", "hash", "words"])
    items = of.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = written(n_hit.join(items, [n_hit.doc_id.eqNullSafe(items.doc_id), n_hit.copy == items.copy]).select(n_hit.doc_id.alias("hit_id"), n_hit.copy.alias("hit_copy"), "n_hit", "items"), "hit-documents")
    out = counted.join(both, [F.col("doc_id").eqNullSafe(F.col("hit_id")), F.col("copy") == F.col("hit_copy")], "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"), listed.alias("items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    _, hit, _ = _hits(_keyed(docs, id_col, text_col), benchmark, window, item_col, item_text_col)
    mine, bad_id, bad_copy = free_names(docs, "_copy", "_bad_id", "_bad_copy")
    bad = written(hit.select(F.col("doc_id").alias(bad_id), F.col("copy").alias(bad_copy)).distinct(), "contaminated")
    kept = docs.withColumn(mine, _copy(F.col(f"`{text_col}`")))
    return kept.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col(bad_id)) & (F.col(mine) == F.col(bad_copy)), "left_anti").drop(mine)
