"""Quality rules by repetition coverage.

Every text is measured whole.  The counts of the base rules and the method's own
measures come from rolling hashes over all words of a chunk of documents at once:
for several n-gram lengths, the share of word characters that lie inside n-grams
found twice or more in the same text, and the share inside repeated lines.

Defined results: a null or empty text has zero counts and fails the base rule of ten
words; repeated rows give equal results; an empty table gives no rows; a null doc_id is
passed through; other columns are ignored (``measure``) or passed on (``keep_good``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as T
from ._jobs import arrow_stage, batch, text_of


@dataclass(frozen=True)
class Rules:
    """Base limits and the largest shares of characters in repeated spans."""

    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    #: n-gram length in words -> largest share of word characters inside repeated ones.
    max_gram_share: tuple[tuple[int, float], ...] = ((2, 0.90), (3, 0.60), (7, 0.25), (10, 0.25))
    max_line_share: float = 0.40
    max_symbol_share: float = 0.10  # symbols per code point of words


_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, gram_share double, line_share double"


def _measure_chunk(c: T.Chunk, rules: Rules) -> dict[str, np.ndarray]:
    n = c.n
    w = T.words(c, T.SPACED)
    lead = (c.data & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(lead)))
    length = chars[w.ends] - chars[w.starts]
    out = {"n_words": w.counts.astype(np.int64), "word_chars": T.by_document(length, w.doc, n)}
    symbols = np.concatenate(([0], np.cumsum(_SYMBOLS[c.data])))
    out["n_symbols"] = np.diff(symbols[c.borders])

    # lines with a word: borders at every \n and at the ends of documents
    ends = np.union1d(np.flatnonzero(c.data == 10), c.borders[1:])
    starts = np.concatenate(([0], ends[:-1]))
    starts = starts + ((starts < len(c.data)) & (c.data[np.minimum(starts, max(len(c.data) - 1, 0))] == 10) if len(c.data) else 0)
    first, last = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
    some = last > first
    starts, ends, first, last = starts[some], ends[some], first[some], last[some]
    line_doc = w.doc[first]
    salt = T.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    keys = T.span_hashes(c.data, starts, ends) ^ salt[line_doc]
    again = T.later(keys)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n)
    total = np.concatenate(([0], np.cumsum(length)))
    twice = T.repeated(keys)
    line_chars = T.by_document((total[last] - total[first])[twice], line_doc[twice], n)

    shares = np.zeros(n)
    verdict = np.ones(n, bool)
    words_all = np.maximum(out["word_chars"], 1)
    limits = dict(rules.max_gram_share)
    for k in sorted({rules.window, *limits}):
        keys, at, made = T.grams(w.hash, w.counts, k)
        twice = T.repeated(keys ^ salt[np.repeat(np.arange(n), made)])
        inside = T.covered(len(w.hash), at[twice], k)
        if k == rules.window:
            out["n_repeat_words"] = np.bincount(w.doc[inside], minlength=n)
        if k in limits:
            share = T.by_document(length[inside], w.doc[inside], n) / words_all
            shares = np.maximum(shares, share / limits[k])
            verdict &= share <= limits[k]
    out["gram_share"] = shares
    out["line_share"] = line_chars / words_all
    verdict &= out["line_share"] <= rules.max_line_share
    verdict &= out["n_symbols"] <= rules.max_symbol_share * words_all
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"])
    out["kept"] = verdict & ~out["base_failed"]
    return out


def _measured(texts: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    parts = [_measure_chunk(c, rules) for c in T.chunks(texts)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def measure(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the counts, ``base_failed`` and ``kept``.

    ``gram_share`` is the largest share of characters in repeated n-grams, each relative
    to its limit (over 1: rejected); ``line_share`` the share in repeated lines.
    """
    rows = text_of(docs, {"doc_id": id_col, "text": text_col})
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _measured(b.column(1), rules)
                names = [x.split()[0] for x in COLUMNS.split(", ")]
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(m[k]) for k in names]], ["doc_id", *names])

    return arrow_stage(rows, run, f"doc_id {kind}, {COLUMNS}")


def keep_good(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows that pass, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(_measured(b.column(at), rules)["kept"]))

    return arrow_stage(docs, run, docs.schema)
