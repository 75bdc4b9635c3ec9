"""Quality classifier: random-indexing vectors, pooled, into a small calibrated network.

1. A text is cut into pieces: runs of lower-case letters (and any byte from 0x80), runs of
   capitals, runs of digits, runs of other signs.  A piece has a hash bucket.
2. Random indexing: every bucket has a fixed sparse index vector of +1 and -1; a bucket's
   word vector is the sum of the index vectors of the pieces within two places of it, over
   the whole corpus.  Each task sums its texts; Spark adds the sums up, bucket by bucket.
3. A document is the mean and the spread of its pieces' unit vectors over the whole text,
   and the mean likeness (cosine) of pieces a few places apart, which monotony raises.
4. A two-layer network in numpy is fitted on at most ``max_rows`` labelled documents (those
   with the smallest hash of their id), and its logits are divided by a temperature chosen
   on a part of them it was not fitted on.

The word vectors are ``BUCKETS x WIDTH`` numbers whatever the corpus, and so is what is
sent to workers.

Defined results: a null or empty text has zero features and the network's score for those;
without any labelled row, or with one class only, scores are the share of label 1 (or
0.5); several labels for one id all count; repeated rows are scored one each.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._jobs import arrow_stage, crc_mod, text_of

BUCKETS = 8192
WIDTH = 32
SIGNS = 4
REACH = 2
LAGS = (1, 2, 3, 4, 6)
FEATURES = 2 * WIDTH + len(LAGS)
MAX_ROWS = 16_000

_KIND = np.full(256, 4, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3


def pieces(c: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of each piece of the chunk."""
    if not len(c.data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[c.data]
    cut = np.concatenate(([True], kind[1:] != kind[:-1]))
    cut[c.borders[:-1][np.diff(c.borders) > 0]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(kind))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    bucket = (T.span_hashes(c.data, starts, ends) >> np.uint64(20)).astype(np.int64) % BUCKETS
    return bucket, np.searchsorted(c.borders, starts, "right") - 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the non-zero entries of each bucket's index vector."""
    h = T.mix(np.arange(BUCKETS * SIGNS, dtype=np.uint64) + np.uint64(77)).reshape(BUCKETS, SIGNS)
    return (h % np.uint64(WIDTH)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def _contexts(rows: DataFrame) -> np.ndarray:
    """The word vectors of all buckets from the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        total = np.zeros(BUCKETS * WIDTH)
        for b in batches:
            for c in T.chunks(b.column(0)):
                at, doc = pieces(c)
                for off in range(1, REACH + 1):
                    same = doc[off:] == doc[:-off]
                    x, y = at[off:][same], at[:-off][same]
                    for j in range(SIGNS):
                        total += np.bincount(x * WIDTH + place[y, j], weights=sign[y, j], minlength=len(total))
                        total += np.bincount(y * WIDTH + place[x, j], weights=sign[x, j], minlength=len(total))
        table = total.reshape(BUCKETS, WIDTH)
        some = np.flatnonzero(table.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(table[some, k].astype(np.float32)) for k in range(WIDTH)]], ["bucket", *[f"v{k}" for k in range(WIDTH)]])

    sums = arrow_stage(rows.select("text"), run, "bucket int, " + ", ".join(f"v{k} float" for k in range(WIDTH))).groupBy("bucket").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(WIDTH)])
    got = sums.toArrow()  # BUCKETS rows at most
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for k in range(WIDTH):
        out[got.column(0).to_numpy(), k] = got.column(k + 1).to_numpy()
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def features(c: T.Chunk, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread and likeness at several lags of the pieces' vectors of each document."""
    at, doc = pieces(c)
    out = np.zeros((c.n, FEATURES), np.float32)
    counts = np.bincount(doc, minlength=c.n)
    some = np.flatnonzero(counts)
    if len(some):
        first = (np.cumsum(counts) - counts)[some]
        for k in range(0, len(some), 2000):
            part = slice(first[k], first[k + 2000] if k + 2000 < len(some) else len(at))
            v = vectors[at[part]]
            begin = first[k : k + 2000] - first[k]
            n = counts[some[k : k + 2000], None]
            mean = np.add.reduceat(v, begin, axis=0) / n
            square = np.add.reduceat(v * v, begin, axis=0) / n
            out[some[k : k + 2000], : 2 * WIDTH] = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0))])
            of = doc[part]
            for j, lag in enumerate(LAGS):
                like = np.einsum("ij,ij->i", v[lag:], v[:-lag]) * (of[lag:] == of[:-lag])
                out[:, 2 * WIDTH + j] += np.bincount(of[lag:], weights=like, minlength=c.n)
        out[:, 2 * WIDTH :] /= np.maximum(counts, 1)[:, None]
    return out


class Network:
    """Two layers, fitted with Adam; scores are calibrated by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 5):
        self.constant = float(y.mean()) if len(y) and len(set(y.tolist())) < 2 else 0.5 if not len(y) else None
        self.temperature = 1.0
        if self.constant is not None:
            return
        g = np.random.default_rng(seed)
        order = g.permutation(len(y))
        held, used = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.std = x[used].mean(0), x[used].std(0) + 1e-4
        z, t = (x - self.mean) / self.std, y.astype(np.float32)
        w = [g.standard_normal((z.shape[1], hidden)).astype(np.float32) / np.sqrt(z.shape[1]), np.zeros(hidden, np.float32), g.standard_normal((hidden, 1)).astype(np.float32) / np.sqrt(hidden), np.zeros(1, np.float32)]
        m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(epochs):
            g.shuffle(used)
            for k in range(0, len(used), 128):
                at = used[k : k + 128]
                a = np.tanh(z[at] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-(a @ w[2] + w[3]))) - t[at, None]) / len(at)
                da = (d @ w[2].T) * (1 - a * a)
                grads = [z[at].T @ da + 1e-4 * w[0], da.sum(0), a.T @ d + 1e-4 * w[2], d.sum(0)]
                step += 1
                for i, grad in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad * grad
                    w[i] = (w[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.w = w
        if len(held):
            logits, label = self.logits(x[held]), t[held]
            loss = lambda s: np.logaddexp(0, -np.where(label > 0.5, 1, -1) * logits / s).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh((x - self.mean) / self.std @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3])[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -50, 50)))


def labelled(rows: DataFrame, labels: DataFrame, label_col: str, held_out: tuple[int, int], max_rows: int, label_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, label) of the training rows: at most ``max_rows`` labels by hash of id.

    Labels are cut to the bound before they meet the texts, so the join sends a table of
    bounded size and no text is moved.
    """
    y = text_of(labels, {"doc_id": label_id, "label": label_col}).where("label IS NOT NULL").where(crc_mod("doc_id", held_out[0]) != held_out[1])
    y = y.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "label").limit(max_rows)
    return rows.join(F.broadcast(y), "doc_id").select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out: tuple[int, int] = (3, 1), max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, Network]:
    """Word vectors from all documents and the network from labelled ones."""
    rows = text_of(docs, {"doc_id": id_col, "text": text_col})
    vectors = _contexts(rows)
    spread = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in T.chunks(b.column(1)):
                x = features(c, spread.value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.n).cast(pa.string()), b.column(2).slice(c.first, c.n).cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    made = arrow_stage(labelled(rows, labels, label_col, held_out, max_rows), run, "doc_id string, label int, x binary")
    got = made.orderBy("doc_id", "label", "x").limit(max_rows).toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, FEATURES)
    return vectors, Network(x, got.column("label").to_numpy())


def score(docs: DataFrame, vectors: np.ndarray, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and score."""
    rows = text_of(docs, {"doc_id": id_col, "text": text_col})
    kind = rows.schema["doc_id"].dataType.simpleString()
    spread = docs.sparkSession.sparkContext.broadcast(pickle.dumps((vectors, network)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = pickle.loads(spread.value)
        for b in batches:
            for c in T.chunks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.n), pa.array(network.score(features(c, vectors)))], ["doc_id", "score"])

    return arrow_stage(rows, run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out: tuple[int, int] = (3, 1), threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    vectors, network = fit(docs, labels, label_col, held_out)
    out = score(docs, vectors, network)
    return out.select("doc_id", (crc_mod("doc_id", held_out[0]) == held_out[1]).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
