"""Tokens of many texts at once, counted by bucket: ``code_tokens`` and ``feature_hash`` on arrays of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .text import FNV_OFFSET, FNV_PRIME, HASH_SPACE, STOP_WORDS, WORD

#: Bytes of text taken at a time, or one longer text.
CHUNK_BYTES = 1 << 20

# signs 0, lower 1, upper 2, digits 3; bytes beyond ASCII are signs
_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONGEST_STOP = max(map(len, STOP_WORDS))
_STOP = np.array(sorted(int.from_bytes(w.encode(), "little") for w in STOP_WORDS), np.uint64)


def _spans(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts (see ``text.PARTS``) of texts that stand one after another."""
    kind = _KIND[data]
    before, after = np.zeros_like(kind), np.zeros_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    inner = borders[(borders > 0) & (borders < len(data))]
    before[inner], after[inner - 1] = 0, 0
    start = (kind > 0) & (((kind != before) & ~((before == 2) & (kind == 1))) | ((kind == 2) & (before == 2) & (after == 1)))
    starts = np.flatnonzero(start)
    # a part ends where the next one starts or where a sign or a text's end comes first
    last = np.flatnonzero((kind > 0) & (after == 0))
    ends = np.minimum(np.append(starts[1:], len(data)), last[np.searchsorted(last, starts)] + 1) if len(starts) else starts
    return starts, ends


def _hashed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """FNV-1a of each span, one character of all spans at a time; spans in order of falling length drop out."""
    order = np.argsort(-lengths, kind="stable")
    at, size = starts[order], lengths[order]
    h = np.full(len(at), FNV_OFFSET, np.uint64)
    for i in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -i, "left"))  # spans longer than i
        h[:n] = ((h[:n] ^ data[at[:n] + i]) * np.uint64(FNV_PRIME)) & np.uint64(WORD)
    out = np.empty_like(h)
    out[order] = h
    return out


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, borders) of chunks of whole texts."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def term_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, text from there, its number of tokens, bucket, tokens in it) of chunks of a column of texts."""
    for first, data, borders in _texts(column):
        starts, ends = _spans(data, borders)
        lengths = ends - starts
        keep = lengths >= 2
        starts, lengths = starts[keep], lengths[keep]
        low = _LOWER[data]
        short = np.flatnonzero(lengths <= _LONGEST_STOP)
        packed = np.zeros(len(short), np.uint64)
        for i in range(_LONGEST_STOP):
            more = lengths[short] > i
            packed[more] |= low[starts[short[more]] + i].astype(np.uint64) << np.uint64(8 * i)
        keep = np.ones(len(starts), bool)
        keep[short[np.isin(packed, _STOP)]] = False
        starts, lengths = starts[keep], lengths[keep]
        doc = np.searchsorted(borders, starts, "right") - 1
        bucket = (_hashed(low, starts, lengths) & np.uint64(HASH_SPACE - 1)).astype(np.int64)
        found, tf = np.unique(doc * HASH_SPACE + bucket, return_counts=True)
        size = np.bincount(doc, minlength=len(borders) - 1)
        doc = found // HASH_SPACE
        yield first, doc, size[doc], found % HASH_SPACE, tf
