"""Token ids in a range-asymmetric-numeral-system (rANS) file format.

A file holds segments.  Each segment has one static frequency table, shared by its
blocks; a block is an independent stream of ``block`` ids (the last may be shorter) with
its own state.  All blocks of a segment are coded side by side: step t codes id t of
every block in a few array operations.  The checkpoints list where each block's words
start, so a reader may decode any range of blocks alone; a CRC-32 guards the header and
each block.

Layout (little-endian)::

    segment: magic "RANS" | u32 header length | u32 crc of header | header | words
    header (zlib): u32 n_ids, block, n_symbols, n_docs | symbols u32 | frequencies u32
                   | states u64 per block | words u32 per block | crc u32 per block
                   | document lengths u32

``write_tokens`` deals texts by range of doc_id, so that file order is id order, and each
task encodes its texts once.  Its manifest has one row per segment with its place in the
file, so ``read_tokens`` deals segments: a reader takes a range of bytes and decodes the
segment's blocks side by side, and a file of many segments is read by many tasks.

Words are encoded once per worker and remembered: a tokenizer that drops white space and
never joins across it gives a text the ids of its white-space-separated parts (``remember``
bounds how many are kept; others are just encoded again).  Whether the given tokenizer is
of that kind is tried on probes, and again on the first text of each chunk; one that is not
encodes whole texts.

Defined results: a null or empty text has only the end id; equal ids (and null, which
come first) are ordered by text, ties between equal rows do not matter; an empty table gives
no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._jobs import arrow_stage, fresh_dir, text_of, written
from ._known import Known

SCALE = 20  # frequencies add up to 2**SCALE
LOW = np.uint64(1 << 31)
SEGMENT_IDS = 2_000_000
MANIFEST = "part bigint, segment bigint, file string, at bigint, bytes bigint, side_at bigint, side_bytes bigint, docs bigint, ids bigint"


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that add up to 2**SCALE."""
    total = 1 << SCALE
    f = np.maximum(1, counts * (total / counts.sum())).astype(np.int64)
    over = int(f.sum()) - total
    if over:
        order = np.argsort(-f, kind="stable")
        for i in order if over > 0 else order[:1]:
            step = min(over, int(f[i]) - 1) if over > 0 else over
            f[i] -= step
            over -= step
            if not over:
                break
    return f


def encode(ids: np.ndarray, lengths: np.ndarray, block: int = 4096) -> bytes:
    """One segment: the ids of documents with these lengths, in order."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    inverse = np.zeros(int(symbols[-1]) + 1 if n else 0, np.int64)
    inverse[symbols] = np.arange(len(symbols))
    freq = quantised(counts) if n else np.zeros(0, np.int64)
    start = np.cumsum(freq) - freq
    blocks = -(-n // block)
    grid = np.zeros(blocks * block, np.int64)
    grid[:n] = inverse[ids]
    grid = np.ascontiguousarray(grid.reshape(blocks, block).T) if blocks else grid.reshape(0, 0)
    last = n - (blocks - 1) * block if blocks else 0
    f64, s64 = freq.astype(np.uint64), start.astype(np.uint64)
    state = np.full(blocks, LOW, np.uint64)
    words = np.empty((blocks, block + 1), np.uint32)
    used = np.zeros(blocks, np.int64)
    room = np.uint64(31 - SCALE + 32)
    for t in range(block - 1 if blocks else -1, -1, -1):
        live = blocks if t < last else blocks - 1  # all blocks but the last are full
        s = grid[t, :live]
        f, x = f64[s], state[:live]
        full = np.flatnonzero(x >= (f << room))
        if len(full):
            words[full, used[full]] = (x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            used[full] += 1
            x[full] >>= np.uint64(32)
        q = x // f
        state[:live] = (q << np.uint64(SCALE)) + (x - q * f) + s64[s]
    streams = [words[b, : used[b]][::-1].tobytes() for b in range(blocks)]
    crc = np.array([zlib.crc32(ids[b * block : (b + 1) * block].astype("<u4").tobytes()) for b in range(blocks)], "<u4")
    header = zlib.compress(
        struct.pack("<4I", n, block, len(symbols), len(lengths)) + symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes()
        + state.astype("<u8").tobytes() + used.astype("<u4").tobytes() + crc.tobytes() + np.asarray(lengths).astype("<u4").tobytes(), 1,
    )
    return b"RANS" + struct.pack("<2I", len(header), zlib.crc32(header)) + header + b"".join(streams)


class Segment:
    """A parsed segment; ``ids(first, last)`` decodes a range of blocks."""

    def __init__(self, raw: bytes, at: int = 0):
        if raw[at : at + 4] != b"RANS":
            raise ValueError("not a token segment")
        size, crc = struct.unpack_from("<2I", raw, at + 4)
        header = raw[at + 12 : at + 12 + size]
        if zlib.crc32(header) != crc:
            raise ValueError("the header's checksum differs")
        h = zlib.decompress(header)
        self.n, self.block, k, docs = struct.unpack_from("<4I", h)
        self.blocks = -(-self.n // self.block)
        at += 12 + size
        shapes = (("symbols", "<u4", k), ("freq", "<u4", k), ("state", "<u8", self.blocks), ("used", "<u4", self.blocks), ("crc", "<u4", self.blocks), ("lengths", "<u4", docs))
        p = 16
        for name, kind, count in shapes:
            setattr(self, name, np.frombuffer(h, kind, count, p))
            p += np.dtype(kind).itemsize * count
        total = int(self.used.sum())
        self.words = np.frombuffer(raw, "<u4", total, at)
        self.end = at + 4 * total
        self.checkpoints = np.concatenate(([0], np.cumsum(self.used.astype(np.int64))))

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of blocks first .. last (exclusive), checked against their sums."""
        last = self.blocks if last is None else last
        n = last - first
        if n <= 0:
            return np.zeros(0, np.uint32)
        freq = self.freq.astype(np.uint64)
        start = np.cumsum(freq) - freq
        slots = np.repeat(np.arange(len(freq), dtype=np.uint32), self.freq)
        state = self.state[first:last].astype(np.uint64)
        at = self.checkpoints[first:last].copy()
        tail = self.n - (self.blocks - 1) * self.block if last == self.blocks else self.block
        out = np.zeros((self.block, n), np.uint32)
        low = np.uint64((1 << SCALE) - 1)
        for t in range(self.block):
            live = n if t < tail else n - 1
            if not live:
                break
            x = state[:live]
            slot = x & low
            s = slots[slot]
            out[t, :live] = s
            x = freq[s] * (x >> np.uint64(SCALE)) + slot - start[s]
            need = np.flatnonzero(x < LOW)
            if len(need):
                if int(at[need].max()) >= len(self.words):
                    raise ValueError("a block's words end too early")
                x[need] = (x[need] << np.uint64(32)) | self.words[at[need]].astype(np.uint64)
                at[need] += 1
            state[:live] = x
        ids = self.symbols[out.T.ravel()[: (n - 1) * self.block + tail]].astype(np.uint32)
        for b in range(n):
            if zlib.crc32(ids[b * self.block : (b + 1) * self.block].astype("<u4").tobytes()) != self.crc[first + b]:
                raise ValueError(f"the checksum of block {first + b} differs")
        return ids


_PROBES = ["it's", "Don't", "a.b", "x1y22", "中文ab", "naïve,", "--", "<|endoftext|>", "é́", "don", "'t", "12", "3", "İs", "a_b", "!?"]

#: A word of letters with ASCII punctuation after it: the two are pieces of their own.
_PLAIN = re.compile(r"([^\W\d_]+)([^\w\s']*)\Z")


class Encoder:
    """Ids of whole chunks of text by the tokenizers library, each distinct word once.

    Words between ASCII white space are told apart by their 64-bit hashes and looked up
    in sorted arrays; only words not seen before are strings and meet the library.  The
    tokenizer lower-cases and splits letters from punctuation, so new words share pieces.
    A word outside the plain form is encoded by the library as it is.
    """

    def __init__(self, path: str, remember: int = 2_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([str(self.tokenizer.id_to_token(i)).endswith("</w>") for i in range(n)])
        self.known = Known(remember)
        self.pieces: dict[str, np.ndarray] = {}
        self.by_words = self._splits_at_white_space()

    def _splits_at_white_space(self) -> bool:
        """On the probes, any text has the ids of its words one after another."""
        each = self._whole(_PROBES)
        for space in (" ", "  ", "\n", "\t", "\r\n", "\x0b\x0c"):
            for edge in ("", space):
                for k in range(len(_PROBES)):  # every word follows every other
                    turned = [*range(k, len(_PROBES)), *range(k)][:: 1 if k % 2 else -1]
                    text = edge + space.join(_PROBES[i] for i in turned) + edge
                    if not np.array_equal(self._whole([text])[0], np.concatenate([each[i] for i in turned])):
                        return False
        return not self._whole(["", " ", "\n\t "])[0].size and all(np.array_equal(a, b) for a, b in zip(self.words(_PROBES), each, strict=True))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, new: list[str]) -> None:
        """Encode pieces many at a time; a piece ends with the only end-of-word id."""
        for k in range(0, len(new), 2000):
            part = new[k : k + 2000]
            ids = self._whole([" ".join(part)])[0]
            cuts = np.flatnonzero(self.ends[ids]) + 1
            self.pieces.update(zip(part, np.split(ids, cuts[:-1]) if len(cuts) == len(part) else self._whole(part), strict=True))

    def words(self, words: list[str]) -> list[np.ndarray]:
        plain = []
        for w in words:
            m = _PLAIN.match(w)
            low = m[1].lower() if m else ""
            plain.append((low, m[2]) if low.isalpha() and max(w) < "\u0250" and m[2].isascii() else None)
        self._pieces(list({p for x in plain if x for p in x if p and p not in self.pieces}))
        odd = iter(self._whole([w for w, x in zip(words, plain, strict=True) if x is None]))
        return [next(odd) if x is None else np.concatenate([self.pieces[x[0]], self.pieces[x[1]]]) if x[1] else self.pieces[x[0]] for x in plain]

    def encode(self, c: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after another, ids per document)."""
        w = T.words(c, T.SPACED)
        if len(self.pieces) > 400_000:
            self.pieces = {}
        if not self.by_words:
            whole = self._whole([c.text(int(a), int(b)).decode() for a, b in zip(c.borders[:-1], c.borders[1:], strict=True)])
            return np.concatenate([np.zeros(0, np.uint32), *whole]), np.array([len(x) for x in whole], np.int64)
        ids, size = self.known.ids(w.hash, lambda new: self.words([c.text(int(w.starts[i]), int(w.ends[i])).decode() for i in new]))
        counts = np.bincount(w.doc, weights=size, minlength=c.n).astype(np.int64)
        first = int(np.flatnonzero(w.counts)[0]) if len(w.hash) else 0
        if counts.any() and not np.array_equal(ids[counts[:first].sum() : counts[: first + 1].sum()], self._whole([c.text(int(c.borders[first]), int(c.borders[first + 1])).decode()])[0]):
            self.by_words = False
            return self.encode(c)
        return ids, counts

    def encode_texts(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Chunk by chunk (first row, ids with the end id after each text, ids per text)."""
        for c in T.chunks(texts):
            ids, counts = self.encode(c)
            yield c.first, np.insert(ids, np.cumsum(counts), end_id), counts + 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder; a Python worker keeps it from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", base: str | None = None, segment_ids: int = SEGMENT_IDS, block: int = 2048) -> DataFrame:
    """Encode all texts and write the files; the manifest (one row per segment) comes back.

    The documents' ids go to a file beside it, one Arrow stream per segment.
    """
    spark = docs.sparkSession
    base = base or fresh_dir(spark, "tokens")
    rows = text_of(docs, {"doc_id": id_col, "text": text_col}).withColumn("text", F.coalesce("text", F.lit("")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        name = f"{base}/{uuid.uuid4().hex}.rans"
        fs, path = pafs.FileSystem.from_uri(name)
        files: list = []
        at = [0, 0]
        held, lengths, doc_ids, size, segments = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, lengths, doc_ids, size, segments
            ids, counts = np.concatenate(held), np.concatenate(lengths)
            side = pa.BufferOutputStream()
            column = pa.concat_arrays(doc_ids)
            with pa.ipc.new_stream(side, pa.schema([("doc_id", column.type)])) as out:
                out.write_batch(pa.RecordBatch.from_arrays([column], ["doc_id"]))
            raw = [encode(ids, counts, block), side.getvalue().to_pybytes()]
            if not files:
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                files.extend(fs.open_output_stream(path + x, compression=None) for x in ("", ".ids"))
            row = {"part": TaskContext.get().partitionId(), "segment": segments, "file": name, "at": at[0], "bytes": len(raw[0]), "side_at": at[1], "side_bytes": len(raw[1]), "docs": len(counts), "ids": len(ids)}
            for i in (0, 1):
                files[i].write(raw[i])
                at[i] += len(raw[i])
            segments += 1
            held, lengths, doc_ids, size = [], [], [], 0
            return pa.RecordBatch.from_pylist([row])

        listed = []
        for b in batches:
            if b.num_rows:
                for first, ids, counts in enc.encode_texts(b.column(1), end_id):
                    held.append(ids)
                    lengths.append(counts)
                    doc_ids.append(b.column(0).slice(first, len(counts)))
                    size += len(ids)
                    if size >= segment_ids:
                        listed.append(flush())
        if held:
            listed.append(flush())
        for f in files:
            f.close()
        yield from listed  # only when the file is whole

    manifest = written(arrow_stage(dealt, run, MANIFEST), "tokens-manifest")
    # ids before a file (one row per file), and before a segment in its file
    files = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).withColumn("before", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.join(files.select("part", "before"), "part").withColumn("start", (F.col("before") + inside).cast("bigint")).drop("before")


def read_tokens(manifest: DataFrame, id_type: str = "bigint", ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (and its ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, at, size, side_at, side_size, start in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                fs, path = pafs.FileSystem.from_uri(name)
                with fs.open_input_file(path) as f, fs.open_input_file(path + ".ids") as g:
                    f.seek(at)
                    seg = Segment(f.read(size))
                    g.seek(side_at)
                    doc_ids = pa.ipc.open_stream(g.read(side_size)).read_all().column(0).combine_chunks()
                if seg.end != size or len(doc_ids) != len(seg.lengths):
                    raise ValueError("the segment has more than its documents")
                got = seg.ids().astype("<u4")
                raw = memoryview(got.tobytes())
                to = np.cumsum(seg.lengths.astype(np.int64))
                begin = to - seg.lengths
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(begin.tolist(), to.tolist(), strict=True)]
                cols = [doc_ids, pa.array(begin + start), pa.array(seg.lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], to)).astype(np.int32)), pa.array(got.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    return arrow_stage(manifest.select("file", "at", "bytes", "side_at", "side_bytes", "start").repartition(n, "file", "at"), run, schema)
