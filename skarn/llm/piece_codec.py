"""SentencePiece encoding and decoding by one walk over the trie of distinct words.

A text is cut into marked words (runs of spaces, written as the mark, and what follows).
The distinct new words of a chunk are sorted, which lays them out as the leaves of a trie
in depth-first order; the walk keeps the forward values of the current path and only
recomputes what lies below the prefix shared with the word before.

Forward value of a prefix:

* unigram models: the best score, with the piece that ends there (Viterbi);
* BPE models: the last piece of the prefix's segmentation.  Merging never reaches over a
  border of the final segmentation, so a prefix's segmentation is that of a shorter prefix
  plus one piece, and the piece is right exactly if it and the piece before it stay apart
  when merged alone.  That test on pairs is remembered.

The public 32k model is a BPE, so a walk for the best sum of scores would give other ids
than the model defines (the README has figures); the BPE form of the forward value gives its
ids exactly.

Words never join: no piece holds a mark after another character (checked on loading).
Characters outside the vocabulary become their bytes' pieces.

Defined results: a null or empty text has no ids and decodes to an empty text; a text
that holds the mark character itself decodes with spaces instead; repeated rows are encoded
one each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as T
from ._jobs import arrow_stage, text_of
from ._known import Known

MARK = "▁"


class Pieces:
    """Vocabulary of a SentencePiece model file and its two directions."""

    def __init__(self, path: str, unigram: bool = False, remember: int = 1_500_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        self.unigram = unigram
        self.ids = {p: i for i, p in enumerate(names) if plain[i]}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.names = names
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece joins two words")
        self.longest = max(map(len, self.ids))
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(names) if model.is_byte(i)}
        self.unknown = model.unk_id()
        raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() if plain[i] else b"" for i, p in enumerate(names)]
        raw[self.unknown] = " ⁇ ".encode()
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.apart: dict[tuple[str, str], bool] = {}
        self.known = Known(remember)

    def merged(self, text: str) -> list[str]:
        """BPE of a short string: merge the best pair, the leftmost of equals, until none."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay_apart(self, a: str, b: str) -> bool:
        got = self.apart.get((a, b))
        if got is None:
            if len(self.apart) > 300_000:
                self.apart.clear()
            got = self.apart[a, b] = self.merged(a + b) == [a, b]
        return got

    def _step(self, word: str, i: int, last: list[str], best: list[float]) -> None:
        """The forward value of word[:i]."""
        if self.unigram:
            top, piece = -np.inf, word[i - 1]
            for k in range(1, min(self.longest, i) + 1):
                p = word[i - k : i]
                s = self.score.get(p, -1e9 if k == 1 else None)
                if s is not None and best[i - k] + s > top:
                    top, piece = best[i - k] + s, p
            best[i], last[i] = top, piece
            return
        for k in range(min(self.longest, i), 0, -1):
            p = word[i - k : i]
            if p not in self.ids and k > 1:
                continue
            if self._stay_apart(last[i - k], p) if k < i else k == 1 or self.merged(p) == [p]:
                last[i] = p
                return
        raise ValueError(f"no piece ends {word[:i]!r}")

    def _words(self, words: list[str]) -> list[np.ndarray]:
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list = [None] * len(words)
        last, best, before = [""], [0.0], ""
        for k in order:
            word = words[k]
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            last += [""] * (len(word) - shared)
            best += [0.0] * (len(word) - shared)
            for i in range(shared + 1, len(word) + 1):
                self._step(word, i, last, best)
            pieces, i = [], len(word)
            while i:
                pieces.append(last[i])
                i -= len(last[i])
            ids: list[int] = []
            for p in reversed(pieces):
                i = self.ids.get(p)
                ids += [i] if i is not None else [self.bytes.get(x, self.unknown) for x in p.encode()] if self.bytes else [self.unknown]
            out[k] = np.array(ids, np.uint32)
            before = word
        return out

    def encode(self, c: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after another, ids per document)."""
        n = len(c.data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(c.n, np.int64)
        space = c.data == 32
        cut = space & ~np.concatenate(([False], space[:-1]))
        heads = c.borders[:-1][np.diff(c.borders) > 0]
        cut[heads] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        head = np.zeros(n, bool)
        head[heads] = True
        head = head[starts]  # a text's first word has a mark more
        keys = T.span_hashes(c.data, starts, ends) ^ np.where(head, np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0))
        name = lambda i: MARK * bool(head[i]) + c.text(int(starts[i]), int(ends[i])).decode().replace(" ", MARK)
        ids, size = self.known.ids(keys, lambda new: self._words([name(i) for i in new]))
        doc = np.searchsorted(c.borders, starts, "right") - 1
        return ids, np.bincount(doc, weights=size, minlength=c.n).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of each document (bytes that are no UTF-8 stay as they are)."""
        size = (self.first[1:] - self.first[:-1])[ids]
        to = np.cumsum(size)
        raw = self.flat[np.repeat(self.first[:-1][ids] - to + size, size) + np.arange(to[-1] if len(to) else 0)].tobytes()
        total = np.concatenate(([0], to))[np.concatenate(([0], np.cumsum(counts)))]
        return [raw[a:b].removeprefix(b" ") for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True)]


_loaded: dict[tuple[str, bool], Pieces] = {}


def pieces(path: str, unigram: bool = False) -> Pieces:
    """This process's codec; a Python worker keeps it from task to task."""
    if (path, unigram) not in _loaded:
        _loaded[path, unigram] = Pieces(path, unigram)
    return _loaded[path, unigram]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_crc32 (of the ids as little-endian u32), round_trip, ids.

    ``round_trip``: decoding the ids gives the text back (null: as an empty text).
    """
    rows = text_of(docs, {"doc_id": id_col, "text": text_col})
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pieces(model)
        for b in batches:
            for c in T.chunks(b.column(1)):
                flat, counts = codec.encode(c)
                to = np.cumsum(counts)
                raw = flat.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip((to - counts).tolist(), to.tolist(), strict=True)]
                texts = codec.decode(flat, counts)
                same = [c.text(int(c.borders[i]), int(c.borders[i + 1])) == texts[i] for i in range(c.n)]
                cols = [b.column(0).slice(c.first, c.n), pa.array(counts), pa.array(crc, pa.int64()), pa.array(same)]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], to)).astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_crc32", "round_trip", "ids"][: len(cols)])

    return arrow_stage(rows, run, f"doc_id {kind}, n_tokens bigint, ids_crc32 bigint, round_trip boolean" + ", ids array<int>" * ids)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row of ids: doc_id and text."""
    rows = text_of(encoded, {"doc_id": id_col, "ids": ids_col})
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pieces(model)
        for b in batches:
            lists = b.column(1).fill_null([])
            counts = np.array([len(x) for x in lists], np.int64)
            texts = codec.decode(np.concatenate([np.zeros(0, np.int64), *[np.array(x, np.int64) for x in lists.to_pylist()]]), counts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode(errors="replace") for t in texts], pa.string())], ["doc_id", "text"])

    return arrow_stage(rows, run, f"doc_id {kind}, text string")
