"""Log-bilinear language model: noise-contrastive training, normalised scoring.

Vocabulary.  Counts of all training words come from one aggregation over the whole
corpus.  Every word of ``MIN_COUNT`` occurrences or more has an embedding as context and
one as target, as long as ``MAX_WORDS`` of them fit into a worker's memory; the words of a
larger vocabulary are taken by count, ties by hash.  All other words have, as contexts, the
embedding of one of ``BUCKETS`` hash buckets, and as targets a class of their own in which
each has its share of the smoothed counts.

Model.  The two words before a token predict it: ``q = C1 r(w-1) + C2 r(w-2)``.  A word's
probability is that of its class times that of the word within its class; both are
softmaxes, of ``q . u(class) + b(class)`` and ``q . t(word) + b(word)``.  A class holds
words of like count, some ``1 / sqrt(p)`` of them for words of probability p, which is
the cheapest cut.  The probabilities of all words, the end and one unseen word add up to one.

Training.  Each task trains on its part of the whole training corpus with noise-contrastive
estimation: noise classes are drawn by frequency and shared by a minibatch, noise words
evenly from the target's class.  All starts from the smoothed frequencies.  After each
round the parameters are averaged in Spark, row by row and weighted by how often a task
has used a row, in a tree: blocks of rows of some tasks are averaged, then those means.

Scoring.  Matrix products over blocks of tokens give the normalised log-probabilities.
Words beyond the table of the most frequent ones meet their counts in a join.

Words are known by 64-bit hashes of their bytes; two words that share one would share
their counts.  Training and scoring read whole texts.

Defined results: a null or empty text has the end token only; with no training text all
counts are zero and the formulas still hold; repeated rows are scored one each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._jobs import arrow_stage, discard, release, text_of, written

#: Occurrences from which a word has embeddings of its own.
MIN_COUNT = 50
#: Words with counts in the table that every worker holds, and at most as many with embeddings: 12 and 140 bytes each.
MAX_WORDS = 1 << 19
#: Context embeddings shared by all other words.
BUCKETS = 4096
WIDTH = 15
NOISE_CLASSES = 24
NOISE_WORDS = 2
BATCH = 8192
RATE = 0.15
#: Leading bits of a word's hash that are looked up at once.
INDEX_BITS = 20
#: Rows of parameters that are averaged together, and tasks in the first step of the tree.
BLOCK = 4096
FAN = 32
#: Chunks (of half a megabyte of text) that one training task takes, and bytes of a row group of them.
TASK_CHUNKS = 128
GROUP_BYTES = 4 << 20


def class_sizes(p: np.ndarray) -> np.ndarray:
    """Words per class for words in order of falling probability."""
    out, at = [], 0
    while at < len(p):
        size = min(max(1, int(1 / np.sqrt(p[at]) + 0.5)), len(p) - at)
        out.append(size)
        at += size
    return np.array(out, np.int64)


class Model:
    """What a worker needs: frequent words with counts, classes, parameters.

    Ids: ``0 .. v - 1`` words by falling count, then ``BUCKETS`` for other words, then the
    end.  Classes: those of the words, then other words, then the end.  ``flat`` has a row
    per context id, target word, class, and row of the two matrices; a row's last number is
    its bias.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, docs: int, total: int, distinct: int, min_count: int, seed: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.docs = docs
        self.total = total + docs  # N
        self.distinct = distinct + (docs > 0)  # V
        best = np.lexsort((self.hashes, -self.counts))
        best = best[self.counts[best] >= min_count]
        self.v = len(best)
        self.ids = np.full(len(hashes), -1, np.int32)
        self.ids[best] = np.arange(self.v)
        own = self.counts[best].astype(np.float64)
        self.rare_total = total - int(own.sum())
        self.rare_distinct = distinct - self.v
        sizes = class_sizes((own + 0.5) / max(self.total, 1))
        self.hi = np.cumsum(sizes)
        self.lo = self.hi - sizes
        self.class_of = np.repeat(np.arange(len(sizes)), sizes)
        mass = np.concatenate((np.add.reduceat(own, self.lo) if len(sizes) else [], [self.rare_total, docs])) + 0.5
        self.log_class = np.log(mass / mass.sum())
        self.log_word = np.log((own + 0.5) / np.repeat(np.add.reduceat(own + 0.5, self.lo), sizes)) if self.v else np.zeros(0)
        self.index = np.searchsorted(self.hashes >> np.uint64(64 - INDEX_BITS), np.arange((1 << INDEX_BITS) + 1, dtype=np.uint64)).astype(np.int32)
        self.flat = self.start(seed)

    @property
    def rare(self) -> int:
        return len(self.lo)

    @property
    def end(self) -> int:
        """The id of the end of a text (and of what is before one)."""
        return self.v + BUCKETS

    def shapes(self) -> list[int]:
        """Rows of contexts, words, classes and matrices."""
        return [self.v + BUCKETS + 1, self.v, self.rare + 2, 2 * WIDTH]

    def start(self, seed: int) -> np.ndarray:
        r, t, u, _ = self.shapes()
        out = np.zeros((sum(self.shapes()), WIDTH + 1), np.float32)
        out[:r, :WIDTH] = 0.1 * np.random.default_rng(seed).standard_normal((r, WIDTH))
        out[r : r + t, WIDTH] = self.log_word
        out[r + t : r + t + u, WIDTH] = self.log_class
        out[r + t + u :, :WIDTH] = np.tile(np.eye(WIDTH), (2, 1))
        return out

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        """Views of the contexts, words, classes and matrices."""
        return np.split(flat, np.cumsum(self.shapes())[:-1])

    def base_norm(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def rare_norm(self) -> float:
        return self.rare_total + 0.5 * (self.rare_distinct + 1)

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the table, is in the table) of word hashes."""
        n = len(self.hashes)
        if not n:
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        top = (h >> np.uint64(64 - INDEX_BITS)).astype(np.int32)
        at, end = np.take(self.index, top), np.take(self.index, top + 1)
        found = np.take(self.hashes, np.minimum(at, n - 1)) == h
        left = np.flatnonzero(~found & (end - at > 1))
        while len(left):  # as often as the fullest slot has words
            at[left] += 1
            hit = self.hashes[at[left]] == h[left]
            found[left[hit]] = True
            left = left[~hit]
            left = left[end[left] - at[left] > 1]
        return np.minimum(at, n - 1), found & (end > 0)

    def sequence(self, w: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids with an end after each text, each text's first token, place, known)."""
        at, known = self.place(w.hash)
        ids = np.where(known, self.ids[at] if len(self.ids) else -1, -1)
        ids = np.where(ids < 0, self.v + (w.hash % np.uint64(BUCKETS)).astype(np.int64), ids).astype(np.int32)
        to = np.cumsum(w.counts)
        return np.insert(ids, to, self.end), to - w.counts + np.arange(len(w.counts)), at, known

    def classes(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate((self.class_of, np.full(BUCKETS, self.rare), [self.rare + 1]))[ids]


def contexts(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids before last and last of each token; the end stands before a text."""
    edge = np.array([end, end], ids.dtype)
    last = np.concatenate((edge[:1], ids[:-1]))
    far = np.concatenate((edge, ids[:-2]))[: len(ids)]
    last[first] = end
    far[first] = end
    far[first[first + 1 < len(ids)] + 1] = end
    return far, last


def _sums(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct ids, sums of their rows, how many)."""
    key = np.sort((ids.astype(np.int64) << 24) | np.arange(len(ids)))
    at = key >> 24
    begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[begin], np.add.reduceat(np.take(rows, key & 0xFFFFFF, 0), begin, axis=0), np.diff(np.append(begin, len(ids)))


def _predicted(ra: np.ndarray, rf: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(q with a one for the bias, the two matrices with a row and column of zeros)."""
    both = np.zeros((2, WIDTH + 1, WIDTH + 1), np.float32)
    both[:, :WIDTH, :WIDTH] = c[:, :WIDTH].reshape(2, WIDTH, WIDTH)
    q = ra @ both[0].T
    q += rf @ both[1].T
    q[:, WIDTH] = 1
    return q, both


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.minimum(x, np.float32(60), out=x)
    np.exp(x, out=x)
    x += np.float32(1)
    return np.reciprocal(x, out=x)


class Training:
    """Parameters of one task with their step sizes and how often each row was used."""

    def __init__(self, model: Model):
        self.m, self.flat = model, model.flat.copy()
        self.squares = np.ones(len(self.flat), np.float32)
        self.used = np.zeros(len(self.flat), np.float32)
        self.from_ = np.concatenate(([0], np.cumsum(model.shapes())))
        p = np.exp(model.log_class)
        self.draw = np.cumsum(p / p.sum())
        self.shift = (np.log(NOISE_CLASSES) + model.log_class).astype(np.float32)

    def step(self, part: int, ids: np.ndarray, rows: np.ndarray) -> None:
        """Descend along the sums of the rows of equal ids."""
        at, d, n = _sums(ids, rows)
        at = at + self.from_[part]
        self.squares[at] += np.einsum("ij,ij->i", d, d)
        self.flat[at] -= np.float32(RATE) * d / np.sqrt(self.squares[at])[:, None]
        self.used[at] += n

    def epoch(self, ids: np.ndarray, first: np.ndarray, seed: int) -> None:
        """One pass of noise-contrastive estimation over the tokens."""
        m, g = self.m, np.random.default_rng(seed)
        far, last = contexts(ids, first, m.end)
        classes = m.classes(ids)
        sizes = np.append(m.hi - m.lo, [1, 1])
        lo = np.append(m.lo, [0, 0])
        shift = np.log(NOISE_WORDS / sizes).astype(np.float32)
        r, t, u, c = m.parts(self.flat)
        order = g.permutation(len(ids))
        for k in range(0, len(order), BATCH):
            at = order[k : k + BATCH]
            w, k1, a, f = ids[at], classes[at], last[at], far[at]
            ra, rf = np.take(r, a, 0), np.take(r, f, 0)
            q, both = _predicted(ra, rf, c)
            # the class, against classes drawn by frequency
            noise = np.minimum(np.searchsorted(self.draw, g.random(NOISE_CLASSES)), len(self.draw) - 1)
            uw, un = np.take(u, k1, 0), np.take(u, noise, 0)
            gd = _sigmoid(np.einsum("ij,ij->i", q, uw) - self.shift[k1]) - np.float32(1)
            gn = _sigmoid(q @ un.T - self.shift[noise])
            dq = gd[:, None] * uw + gn @ un
            # the word, against words drawn evenly from its class
            some = np.flatnonzero(sizes[k1] > 1)
            if len(some):
                ks, qs, n = k1[some], np.take(q, some, 0), len(some)
                drawn = lo[ks][:, None] + (g.random((n, NOISE_WORDS), np.float32) * sizes[ks][:, None]).astype(np.int64)
                every = np.concatenate((w[some][:, None], np.minimum(drawn, (lo + sizes)[ks][:, None] - 1)), 1)
                rows = np.take(t, every, 0)
                gw = _sigmoid(np.einsum("ijk,ik->ij", rows, qs) - shift[ks][:, None])
                gw[:, 0] -= 1
                dq[some] += np.einsum("ij,ijk->ik", gw, rows)
                self.step(1, every.ravel(), (gw[:, :, None] * qs[:, None, :]).reshape(-1, WIDTH + 1))
            self.step(2, np.concatenate((k1, noise)), np.concatenate((gd[:, None] * q, gn.T @ q)))
            self.step(0, np.concatenate((a, f)), np.concatenate((dq @ both[0], dq @ both[1])))
            self.step(3, np.arange(2 * WIDTH), np.concatenate(((dq.T @ ra)[:WIDTH], (dq.T @ rf)[:WIDTH])))

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """Used rows by block of parameters: (block, packed sums)."""
        rows = np.flatnonzero(self.used)
        for b in np.unique(rows // BLOCK).tolist():
            at = rows[rows // BLOCK == b]
            yield b, pack(at - b * BLOCK, self.used[at], self.flat[at] - self.m.flat[at])


def pack(at: np.ndarray, n: np.ndarray, mean: np.ndarray) -> bytes:
    """Rows of a block, how often they were used, and how far they have moved (halves are exact enough for that)."""
    return at.astype("<u2").tobytes() + n.astype("<f4").tobytes() + mean.astype("<f2").tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = len(raw) // (6 + 2 * (WIDTH + 1))
    return np.frombuffer(raw, "<u2", k), np.frombuffer(raw, "<f4", k, 2 * k).astype(np.float64), np.frombuffer(raw, "<f2", k * (WIDTH + 1), 6 * k).reshape(k, WIDTH + 1).astype(np.float64)


def _added(parts: DataFrame, key: list[str]) -> DataFrame:
    """Packed means (block, task, raw) of equal keys, weighted by use, in order of task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, sums, first = None, None, None, 0

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([first], pa.int64()), pa.array([pack(at, n[at], sums[at] / n[at, None])], pa.binary())], ["block", "task", "raw"])

        for b in batches:
            for *k, task, raw in zip(*[b.column(i).to_pylist() for i in range(len(key) + 2)], strict=True):
                if k != now:
                    yield from done()
                    now, n, sums, first = k, np.zeros(BLOCK), np.zeros((BLOCK, WIDTH + 1)), task
                at, more, mean = unpack(raw)
                n[at] += more
                sums[at] += more[:, None] * mean
        yield from done()

    cols = [F.col("block"), *([F.expr(f"task div {FAN}").alias("fan")] if "fan" in key else [])]
    dealt = parts.select(*cols, "task", "raw").repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key, "task")
    return arrow_stage(dealt, run, "block int, task bigint, raw binary")


def _training(doc_id: str, held_out_mod: tuple[int, int]) -> Column:
    n, out = held_out_mod
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n != out


def _counts(rows: DataFrame) -> DataFrame:
    """(h, c) of every distinct training word; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def packed():
            h, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            u, inverse = np.unique(h, return_inverse=True)
            return u, np.bincount(inverse, weights=n).astype(np.int64)

        emit = lambda u, n: pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["h", "c"])
        for b in batches:
            for c in T.chunks(b.column(0)):
                u, n = np.unique(T.words(c.lowered(), T.SPACED).hash, return_counts=True)
                held.append((u, n))
                size += len(u)
            if size > 2_000_000:
                held = [packed()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield emit(*held[0])
                    held, size = [], 0
        if held:
            yield emit(*packed())

    return arrow_stage(rows.select("text"), run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the most frequent words, at most ``most``; ties are cut by hash.

    Whole levels of counts are taken while they fit, then of the next level those words
    whose hash is small enough, so a corpus with a flat distribution has as many as any.
    """
    level, slot = F.floor(F.log2("c") * 8), F.expr("shiftright(h, 48) + 32768")
    steps = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)  # at most 8 * 63 rows
    kept, least, partly = 0, None, F.lit(False)
    for k, n in steps:
        if kept + n > most:
            slots = sorted((r.s, r.n) for r in counts.where(level == k).groupBy(slot.alias("s")).agg(F.count("*").alias("n")).collect())  # at most 65,536 rows
            fits = np.flatnonzero(kept + np.cumsum([n for _, n in slots]) <= most)
            if len(fits):
                partly = (level == k) & (slot <= slots[fits[-1]][0])
            break
        kept, least = kept + n, k
    top = counts.where(partly if least is None else partly | (level >= least)).toArrow()  # at most ``most`` rows
    return top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()


def _sequences(rows: DataFrame, model: Model) -> DataFrame:
    spread = rows.sparkSession.sparkContext.broadcast(pickle.dumps((model.__class__, {k: v for k, v in model.__dict__.items() if k != "flat"})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _unpacked(spread)
        for b in batches:
            for c in T.chunks(b.column(0)):
                seq, _, _, _ = m.sequence(T.words(c.lowered(), T.SPACED))
                yield pa.RecordBatch.from_arrays([pa.array([seq.astype("<i4").tobytes()], pa.binary())], ["seq"])

    return arrow_stage(rows.select("text"), run, "seq binary")


def _unpacked(spread) -> Model:
    kind, values = pickle.loads(spread.value)
    m = kind.__new__(kind)
    m.__dict__.update(values)
    return m


def _round(sequences: DataFrame, model: Model, seed: int) -> None:
    """Each task trains from the same start over its tokens; the weighted mean becomes the model's."""
    spread = sequences.sparkSession.sparkContext.broadcast(pickle.dumps((model.__class__, model.__dict__)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        t = None
        for b in batches:
            for raw in b.column(0).to_pylist():
                seq = np.frombuffer(raw, "<i4")
                t = t or Training(_unpacked(spread))
                if len(seq):
                    t.epoch(seq, np.concatenate(([0], np.flatnonzero(seq[:-1] == t.m.end) + 1)), seed + task)
        for block, raw in t.blocks() if t else ():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([task], pa.int64()), pa.array([raw], pa.binary())], ["block", "task", "raw"])

    made = arrow_stage(sequences, run, "block int, task bigint, raw binary")
    got = _added(_added(made, ["block", "fan"]), ["block"]).toArrow()  # as many rows as the model has blocks
    for block, raw in zip(got.column("block").to_pylist(), got.column("raw").to_pylist(), strict=True):
        at, _, mean = unpack(raw)
        model.flat[at.astype(np.int64) + block * BLOCK] += mean.astype(np.float32)
    spread.destroy()


def fit(rows: DataFrame, rounds: int = 1, seed: int = 3, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[Model, DataFrame]:
    """Train on all rows (column ``text``); the model and the table of all counts."""
    counts = written(_counts(rows), "word-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    model = Model(*_frequent(counts, max_words), rows.count(), total.n or 0, total.v, min_count, seed)
    sequences = written(_sequences(rows, model), "sequences", row_group_bytes=GROUP_BYTES)
    # as much text to a task whatever the corpus; partitions are joined, not moved
    tasks = sequences.coalesce(max(1, -(-sequences.count() // TASK_CHUNKS)))
    for k in range(rounds):
        _round(tasks, model, seed + 1000 * k)
    discard(sequences)
    return model, counts


def log_probabilities(m: Model, seq: np.ndarray, first: np.ndarray, step: int = 1024) -> np.ndarray:
    """log10 of the probability of each token's class and, for words of the model, word."""
    far, last = contexts(seq, first, m.end)
    classes = m.classes(seq)
    r, t, u, c = m.parts(m.flat)
    sizes = np.append(m.hi - m.lo, [1, 1])
    q = np.empty((len(seq), WIDTH + 1), np.float32)
    out = np.empty(len(seq))
    for k in range(0, len(seq), step):
        s = slice(k, k + step)
        q[s] = _predicted(np.take(r, last[s], 0), np.take(r, far[s], 0), c)[0]
        out[s] = _picked(q[s], u, classes[s])
    some = np.flatnonzero(sizes[classes] > 1)
    some = some[np.argsort(classes[some], kind="stable")]
    cuts = np.flatnonzero(np.diff(classes[some])) + 1
    for part in np.split(some, cuts) if len(some) else ():
        k = int(classes[part[0]])
        rows = t[m.lo[k] : m.hi[k]]
        size = max(1, (1 << 17) // len(rows))
        for i in range(0, len(part), size):
            at = part[i : i + size]
            out[at] += _picked(q[at], rows, seq[at] - m.lo[k])
    return out / np.log(10)


def _picked(q: np.ndarray, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Natural log of the softmax at one place a row; ``q`` ends in a one for the bias."""
    z = q @ rows.T
    mine = z[np.arange(len(z)), which].astype(np.float64)
    top = 0.0
    if z.max() > 60:  # sums of powers would leave the range of their type
        top = z.max(axis=1)
        z -= top[:, None]
    np.exp(z, out=z)
    return mine - top - np.log(z @ np.ones(z.shape[1], np.float32))


def score(rows: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Per row (doc_id, text): doc_id, n_tokens, n_known, base_score, score."""
    spread = rows.sparkSession.sparkContext.broadcast(pickle.dumps((model.__class__, model.__dict__)))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m = _unpacked(spread)
        base = np.append(np.log10((m.counts + 0.5) / m.base_norm()), 0)
        rare = np.append(np.log10((m.counts + 0.5) / m.rare_norm()), 0)
        end = float(np.log10((m.docs + 0.5) / m.base_norm()))
        key = TaskContext.get().partitionId() << 33
        names = ["doc_id", "key", "h", "n", "n_known", "base", "lm"]
        for b in batches:
            for c in T.chunks(b.column(1)):
                w = T.words(c.lowered(), T.SPACED)
                seq, first, at, known = m.sequence(w)
                of = np.repeat(np.arange(c.n), w.counts + 1)
                add = lambda x, d, n=c.n: np.bincount(d, weights=x, minlength=n)
                lm = add(log_probabilities(m, seq, first), of)
                at = np.where(known, at, len(m.counts))
                n_base = add(base[at], w.doc) + end
                if len(m.ids):
                    alone = np.flatnonzero(known)
                    alone = alone[m.ids[at[alone]] < 0]  # its share of the class of other words
                    lm += add(rare[at[alone]], w.doc[alone])
                n_known = add(known, w.doc) + (m.docs > 0)
                keys = key + np.arange(c.n)
                key += c.n
                none = pa.nulls(c.n, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.n), pa.array(keys), none, pa.array(w.counts + 1), pa.array(n_known.astype(np.int64)), pa.array(n_base), pa.array(lm)], names)
                if not known.all():
                    far_h, far_d = w.hash[~known], w.doc[~known]
                    order = np.lexsort((far_h, far_d))
                    far_h, far_d = far_h[order], far_d[order]
                    new = np.concatenate(([True], (far_h[1:] != far_h[:-1]) | (far_d[1:] != far_d[:-1])))
                    begin = np.flatnonzero(new)
                    times = np.diff(np.append(begin, len(far_h)))
                    k = len(begin)
                    yield pa.RecordBatch.from_arrays([pa.nulls(k, b.schema.field(0).type), pa.array(keys[far_d[begin]]), pa.array(far_h[begin].view(np.int64)), pa.array(times), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64())], names)

    parts = written(arrow_stage(rows.select("doc_id", "text"), run, f"doc_id {kind}, key bigint, h bigint, n bigint, n_known bigint, base double, lm double"), "scored")
    c = F.coalesce("c", F.lit(0))
    logs = lambda norm: F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(float(norm))))
    tails = parts.where("h IS NOT NULL").select("key", "h", "n").join(counts, "h", "left")
    tails = tails.groupBy("key").agg(logs(model.base_norm()).alias("tail_base"), logs(model.rare_norm()).alias("tail_lm"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    out = parts.where("h IS NULL").join(tails, "key", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias
    return out.select("doc_id", F.col("n").alias("n_tokens"), plus("n_known", "tail_known")("n_known"), plus("base", "tail_base")("base_score"), plus("lm", "tail_lm")("score"))


def score_corpus(docs: DataFrame, held_out_mod: tuple[int, int] = (5, 1), id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """Train on the documents whose crc32(id) mod n is not the given one; score all."""
    rows = text_of(docs, {"doc_id": id_col, "text": text_col})
    training = _training("doc_id", held_out_mod)
    model, counts = fit(rows.where(training), **fitting)
    out = score(rows, model, counts)
    release(docs.sparkSession)
    return out.select("doc_id", (~training).alias("held_out"), "n_tokens", "n_known", F.lit(int(model.total)).cast("bigint").alias("train_tokens"), "base_score", "score")
