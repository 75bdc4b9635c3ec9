"""Vectorised text kernel shared by the corpus operators.

Texts arrive as Arrow string arrays.  All work is done on the UTF-8 bytes of a
bounded chunk of documents at once: a 256-entry table classifies each byte,
word borders come from a difference of that mask, and the hash of any byte span
is read off two running sums of ``byte * B**i``, one modulo 2**64 and one modulo a
prime, so hashing words, lines and n-grams costs the same few array passes whatever
their number.  Each sum makes up for what is weak in the other: modulo a power of two
some spans collide whatever the base (the Thue-Morse words), modulo a prime of 31 bits
alone there would be too few values.

Memory: one chunk holds at most ``CHUNK_BYTES`` of text (or a single longer
document); the arrays made from it take about 40 bytes per byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
_PRIME = (1 << 31) - 1
_SMALL_BASE = 1_103_515_245
#: So many terms below 2**39 add up without overflow.
_SMALL_RUN = 1 << 24


def _table(separators: set[int]) -> np.ndarray:
    out = np.ones(256, bool)
    out[sorted(separators)] = False
    return out


#: True for bytes of a word ``[^\x20\x09-\x0D]+``.
SPACED = _table({0x20, *range(0x09, 0x0E)})
#: True for bytes of a word ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z).
ALNUM = _table({*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``B**i`` and ``B**-i`` (mod 2**64) for i < n."""
    if len(_powers.get("p", ())) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for key, base in (("p", _BASE), ("q", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["p"][:n], _powers["q"][:n]


def small_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same modulo the prime, by doubling."""
    if len(_powers.get("sp", ())) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for key, base in (("sp", _SMALL_BASE), ("sq", pow(_SMALL_BASE, -1, _PRIME))):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate((out, out * np.uint64(pow(base, len(out), _PRIME)) % np.uint64(_PRIME)))
            _powers[key] = out[:size]
    return _powers["sp"][:n], _powers["sq"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64-bit result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Chunk:
    """Documents ``first .. first + n`` of a batch: bytes and document borders."""

    first: int
    data: np.ndarray  # uint8, the texts one after another
    borders: np.ndarray  # int64, n + 1 offsets into data

    @property
    def n(self) -> int:
        return len(self.borders) - 1

    def lowered(self) -> Chunk:
        """The same with A-Z lower-cased."""
        return Chunk(self.first, _LOWER[self.data], self.borders)

    def text(self, start: int, end: int) -> bytes:
        return self.data[start:end].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks; a null text has no bytes.

    Every document falls in exactly one chunk, whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield Chunk(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


@dataclass
class Words:
    """Words of a chunk in order: byte spans, document index, hash."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    counts: np.ndarray  # words per document

    @property
    def first(self) -> np.ndarray:
        """Index of each document's first word, and the number of words last."""
        return np.concatenate(([0], np.cumsum(self.counts)))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span ``[start, end)``; it depends on the bytes alone."""
    n = len(data)
    values = data.astype(np.uint64) + np.uint64(1)
    total = np.zeros(n + 1, np.uint64)
    p, q = powers(n + 1)
    np.cumsum(values * p[:-1], out=total[1:])
    out = (total[ends] - total[starts]) * q[starts]
    p, q = small_powers(n + 1)
    terms = values * p[:-1]
    prime = np.uint64(_PRIME)
    if n > _SMALL_RUN:
        terms %= prime
    np.cumsum(terms, out=total[1:])
    small = (total[ends] - total[starts]) % prime * q[starts] % prime
    return mix(out + mix(small + np.uint64(1)) + (ends - starts).astype(np.uint64))


def words(chunk: Chunk, table: np.ndarray, hashed: bool = True) -> Words:
    """The maximal runs of word bytes within each document."""
    inside = table[chunk.data]
    edge = np.empty(len(inside) + 1, bool)
    edge[1:] = inside
    edge[0] = False
    starts = inside & ~edge[:-1]
    cuts = chunk.borders[1:-1]
    cuts = cuts[cuts < len(inside)]
    starts[cuts] |= inside[cuts]  # a word never crosses documents
    ends = edge[1:].copy()
    ends[:-1] &= ~inside[1:] if len(inside) else ends[:-1]
    inner = cuts[cuts > 0] - 1
    ends[inner] |= inside[inner]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(starts, chunk.borders)
    counts = np.diff(first)
    doc = np.repeat(np.arange(chunk.n), counts)
    return Words(starts, ends, doc, span_hashes(chunk.data, starts, ends) if hashed else np.zeros(0, np.uint64), counts)


def grams(values: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-word windows that lie within one document.

    Returns (hash, index of the first word, windows per document).
    """
    made = np.maximum(counts - n + 1, 0)
    if not made.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), made
    length = len(values) - n + 1
    out = np.zeros(length, np.uint64)
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += values[k : k + length]
    out = mix(out)
    first = np.cumsum(counts) - counts
    keep = np.repeat(first, made) + (np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made))
    return out[keep], keep, made


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice


def later(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands earlier."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order][1:] == keys[order][:-1]
    return out


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """True at positions inside any window [start, start + width)."""
    delta = np.bincount(starts, minlength=n + width + 1) - np.bincount(starts + width, minlength=n + width + 1)
    return np.cumsum(delta)[:n] > 0


def by_document(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sum of values per document."""
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)
