"""Toxicity: a convolutional text classifier in numpy with thresholds by language.

A word (letters lower-cased, other signs cut off) is three rows of hashed embeddings: of
the word, of its first four bytes and of its first five.  An inflected word has its stem's
rows, and one shared bucket alone does not pass for another word.
Filters of several widths run over the whole text, the largest response of each filter is
kept, and a logistic layer makes the score.  Training follows each filter's largest place
only, which keeps it cheap whatever the text's length.

Fitted on all labelled documents, whatever their number (``max_rows`` and ``max_bytes``
bound them only where a caller gives them; rows then count in order of the hash of their
id, whole texts).  The rows are dealt to tasks of about ``TASK_BYTES``; each trains several
times from the same start, in different orders, as the order decides where labels are few.  That
is so whatever the number of rows and tasks.  The means of how far the parameters and the sums of their squared
gradients have moved, weighted by use, are the start of the next round.

A fifth of the labelled documents is set apart: the net never sees it, and the thresholds
are chosen on its scores, as the score that keeps
``clean_share`` of the clean documents of a language below it with the usual correction
for few (the k-th of n with k = ceil((n + 1) * share)).  A language with too few clean
documents for that has the general threshold; if all together are too few, the largest
clean score counts.  The language picks the threshold, never the score.

Defined results: a null or empty text scores as one without any response; without labels
or with one class only the score is the share of label 1 (or 0); a null language has the
general threshold; repeated rows score alike; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._jobs import arrow_stage, crc_mod, discard, release, text_of, written

BUCKETS = 1 << 16
HALF = 6  # width of each of the three embeddings
HEADS = (4, 5)  # bytes of a word that are hashed as its stem
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Bytes of word rows (six a word) that one training task takes.
TASK_BYTES = 32 << 20
#: Rounds over all training rows, and passes of a task over its rows in each.
ROUNDS = 4
PASSES = 2
#: A task trains on its rows so many times, each in an order of its own; the results are averaged like those of tasks.
ORDERS = 3
#: Texts and words of a training step; a longer text is a step of its own.
STEP_TEXTS = 48
STEP_WORDS = 1 << 18
#: Rows of embeddings that are averaged together, and tasks whose moves meet at once.
BLOCK = 1 << 12
FAN = 32
#: Every fifth labelled document calibrates the thresholds and does not train.
APART = 5
#: Letters, digits and bytes from 0x80 make words here; all else separates.
LETTERS = T.ALNUM


def buckets(c: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the embeddings as words x 3, words per document)."""
    low = c.lowered()
    w = T.words(low, LETTERS)
    hashes = [w.hash, *[T.span_hashes(low.data, w.starts, np.minimum(w.starts + n, w.ends)) for n in HEADS]]
    return np.stack([h & np.uint64(BUCKETS - 1) for h in hashes], 1).astype(np.uint16), w.counts


class Net:
    def __init__(self, seed: int = 11):
        g = np.random.default_rng(seed)
        draw = lambda s, *shape: (s * g.standard_normal(shape)).astype(np.float32)
        self.e = [draw(0.01, BUCKETS, HALF) for _ in range(1 + len(HEADS))]
        self.k = [draw(0.4, w, len(self.e) * HALF, FILTERS) for w in WIDTHS]
        self.kb = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.o = draw(0.3, len(WIDTHS) * FILTERS)
        self.ob = np.full(1, -2.0, np.float32)
        self.constant: float | None = None

    def forward(self, h: np.ndarray, counts: np.ndarray):
        """Largest responses (documents x filters) and, per filter, where they are."""
        n, pad = len(counts), max(WIDTHS) - 1
        # pad places after each text, so that windows never reach into the next
        to = np.cumsum(counts + pad)
        first = to - counts - pad
        x = np.zeros((int(to[-1]) + pad if n else pad, len(self.e) * HALF), np.float32)
        at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(h))
        for i, e in enumerate(self.e):
            x[at, i * HALF : (i + 1) * HALF] = e[h[:, i]]
        word = np.zeros(len(x), bool)
        word[at] = True
        best = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        some = np.flatnonzero(counts)
        ys = []
        for j, w in enumerate(WIDTHS):
            y = x[: len(x) - w + 1] @ self.k[j][0]
            for d in range(1, w):
                y += x[d : len(x) - w + 1 + d] @ self.k[j][d]
            y += self.kb[j]
            y = np.maximum(y, 0)
            y[~word[: len(y)]] = 0  # a window that starts on padding would reach into the next text
            if len(some):
                # windows that start on a word; a text's padding belongs to its last ones
                r = np.maximum.reduceat(y[: int(to[-1])], first, axis=0)
                best[:, j * FILTERS : (j + 1) * FILTERS] = np.where(counts[:, None] > 0, r, 0)
            ys.append(y)
        return best, ys, x, first, to

    def score(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        best = self.forward(h, counts)[0]
        return 1 / (1 + np.exp(-np.clip((best @ self.o + self.ob).astype(np.float64), -50, 50)))

    def sums(self) -> dict:
        """The start of the sums of squared gradients, by parameter."""
        named = {"o": self.o} | {(n, j): p for n in ("k", "kb", "e") for j, p in enumerate(getattr(self, n))}
        return {n: np.full(p.shape, 1e-3, np.float32) for n, p in named.items()}

    def train(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int, sums: dict, rate: float = 0.05, seed: int = 1) -> tuple[int, np.ndarray]:
        """Passes over the texts; how many steps were taken, and how many of them used each row of the embeddings."""
        g = np.random.default_rng(seed)
        used, steps = np.zeros((len(self.e), BUCKETS), np.float32), 0

        def step(name, p: np.ndarray, d: np.ndarray, at=None) -> None:
            s = sums[name]
            if at is None:
                s += d * d
                p -= rate * d / np.sqrt(s)
            else:
                u, inv = np.unique(at, return_inverse=True)
                total = np.stack([np.bincount(inv, weights=d[:, k], minlength=len(u)) for k in range(d.shape[1])], 1).astype(np.float32)
                s[u] += total * total
                p[u] -= rate * total / np.sqrt(s[u])
                used[name[1], u] += 1

        for _ in range(epochs):
            for ids in _steps(g.permutation(len(texts)), texts):
                part = [texts[i] for i in ids]
                counts = np.array([len(t) for t in part])
                steps += 1
                h = np.concatenate([np.zeros((0, len(self.e)), np.uint16), *part])
                best, ys, x, first, to = self.forward(h, counts)
                p = 1 / (1 + np.exp(-np.clip(best @ self.o + self.ob, -30, 30)))
                d = ((p - labels[ids]) / len(ids)).astype(np.float32)
                db = d[:, None] * self.o[None, :] * (best > 0)
                slot = np.full(len(x), -1, np.int64)
                at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(h))
                slot[at] = np.arange(len(h))
                rows, grads = [], []
                doc = np.repeat(np.arange(len(counts)), to - first)
                for j, w in enumerate(WIDTHS):
                    top = best[:, j * FILTERS : (j + 1) * FILTERS]
                    at, f = np.nonzero((ys[j][: len(doc)] == top[doc]) & (top > 0)[doc])
                    _, one = np.unique(doc[at] * FILTERS + f, return_index=True)  # the first of equals
                    pos, f = at[one], f[one]
                    gr = db[doc[pos], j * FILTERS + f]
                    dk = np.zeros_like(self.k[j])
                    for o in range(w):
                        one_hot = np.zeros((len(pos), FILTERS), np.float32)
                        one_hot[np.arange(len(pos)), f] = gr
                        dk[o] = x[pos + o].T @ one_hot
                        rows.append(pos + o)
                        grads.append(gr[:, None] * self.k[j][o].T[f])
                    step(("k", j), self.k[j], dk)
                    step(("kb", j), self.kb[j], np.bincount(f, weights=gr, minlength=FILTERS).astype(np.float32))
                step("o", self.o, best.T @ d)
                self.ob -= np.float32(rate * d.sum())
                if rows:
                    pos, dx = slot[np.concatenate(rows)], np.concatenate(grads)
                    real = pos >= 0
                    for i, e in enumerate(self.e):
                        step(("e", i), e, dx[real][:, i * HALF : (i + 1) * HALF], h[pos[real], i])
        return steps, used

    def layers(self, sums: dict) -> list[np.ndarray]:
        """The parameters that every text uses, and their sums."""
        return [*self.k, *self.kb, self.o, self.ob, *[sums["k", j] for j in range(len(self.k))], *[sums["kb", j] for j in range(len(self.kb))], sums["o"]]

    def flat(self, sums: dict) -> tuple[np.ndarray, np.ndarray]:
        """All parameters beside their sums: one row of the layers', and the rows of the embeddings."""
        rows = np.concatenate((np.concatenate(self.e), np.concatenate([sums["e", i] for i in range(len(self.e))])), 1)
        return np.concatenate([x.ravel() for x in self.layers(sums)])[None], rows

    def move(self, sums: dict, layers: np.ndarray, rows: np.ndarray) -> None:
        """Add moves in the form of ``flat``."""
        at = 0
        for p in self.layers(sums):
            p += layers[0, at : at + p.size].reshape(p.shape)
            at += p.size
        for i, e in enumerate(self.e):
            part = rows[i * BUCKETS : (i + 1) * BUCKETS]
            e += part[:, :HALF]
            sums["e", i] += part[:, HALF:]


def _steps(order: np.ndarray, texts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The order cut to steps of few texts and few words."""
    first, words = 0, 0
    for k, i in enumerate(order.tolist()):
        if k > first and (k - first == STEP_TEXTS or words + len(texts[i]) > STEP_WORDS):
            yield order[first:k]
            first, words = k, 0
        words += len(texts[i])
    if first < len(order):
        yield order[first:]


def cut(scores: np.ndarray, share: float) -> float | None:
    """The score that a further clean document stays below with at least this chance; None if there are too few to say."""
    k = int(np.ceil((len(scores) + 1) * share))
    return float(np.sort(scores)[k - 1]) if 0 < k <= len(scores) else None


class Model:
    """A net, a general threshold and thresholds by language."""

    def __init__(self, net: Net, scores: np.ndarray, labels: np.ndarray, langs: np.ndarray, clean_share: float):
        clean = labels == 0
        found = {str(x): cut(scores[clean & (langs == x)], clean_share) for x in set(langs.tolist()) if x is not None}
        self.given(net, cut(scores[clean], clean_share), scores[clean].max(initial=0.0), {k: v for k, v in found.items() if v is not None})

    def given(self, net: Net, general: float | None, largest: float, by_lang: dict[str, float]) -> Model:
        """The model of these cuts; without a general one the largest clean score counts."""
        # just above: a document that scores the same is not flagged
        above = lambda x: float(np.nextafter(x, 2))
        self.net = net
        self.threshold = above(general if general is not None else max(largest, 0.5))
        self.by_lang = {k: above(v) for k, v in by_lang.items()}
        return self


def cuts(scores: DataFrame, share: float) -> dict[str, float]:
    """``cut`` of each key's scores in (key, bits), the scores' bits as integers; exact whatever their number.

    Numbers from 0 are in the order of their bits, so sixteen bits are settled at a time by
    counting: a level keeps one value a key, and no list of scores is held anywhere.
    """
    spark = scores.sparkSession
    n = scores.groupBy("key").agg(F.count("*").alias("n")).select("key", "n", F.ceil((F.col("n") + 1) * F.lit(share)).alias("k"))
    # one row a key with some hundred scores or more
    found = [(r.key, 0, r.k) for r in n.where("k > 0 AND k <= n").collect()]
    for shift in (48, 32, 16, 0):
        if not found:
            break
        want = spark.createDataFrame(found, "key string, upper bigint, k bigint")
        upper = F.shiftright(F.shiftright("bits", shift), 16)
        bins = scores.join(want, "key").where(upper == F.col("upper")).groupBy("key", "k", F.shiftright("bits", shift).alias("bin")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # at most 65,536 rows a key
        hit = bins.withColumn("upto", upto).where("upto >= k AND upto - n < k")
        found = [(r.key, r.bin, r.k - (r.upto - r.n)) for r in hit.collect()]
    return {key: float(np.int64(bits).view(np.float64)) for key, bits, _ in found}


def _pack(at: np.ndarray, n: np.ndarray, mean: np.ndarray) -> bytes:
    return at.astype("<u2").tobytes() + n.astype("<f4").tobytes() + mean.astype("<f4").tobytes()


def _unpack(raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = len(raw) // (6 + 4 * width)
    return np.frombuffer(raw, "<u2", k), np.frombuffer(raw, "<f4", k, 2 * k).astype(np.float64), np.frombuffer(raw, "<f4", k * width, 6 * k).reshape(k, width).astype(np.float64)


def _added(parts: DataFrame, key: list[str], layers: int) -> DataFrame:
    """Packed means (block, task, raw) of equal keys, weighted by use, in order of task; block -1 has the layers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, sums, first = None, None, None, 0

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([first], pa.int64()), pa.array([_pack(at, n[at], sums[at] / n[at, None])], pa.binary())], ["block", "task", "raw"])

        for b in batches:
            for *k, task, raw in zip(*[b.column(i).to_pylist() for i in range(len(key) + 2)], strict=True):
                width = layers if k[0] < 0 else 2 * HALF
                if k != now:
                    yield from done()
                    now, n, sums, first = k, np.zeros(BLOCK if k[0] >= 0 else 1), np.zeros((BLOCK if k[0] >= 0 else 1, width)), task
                at, more, mean = _unpack(raw, width)
                n[at] += more
                sums[at] += more[:, None] * mean
        yield from done()

    cols = [F.col("block"), *([F.expr(f"task div {FAN}").alias("fan")] if "fan" in key else [])]
    dealt = parts.select(*cols, "task", "raw").repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key, "task")
    return arrow_stage(dealt, run, "block int, task bigint, raw binary")


def _round(dealt: DataFrame, net: Net, sums: dict, seed: int) -> None:
    """Each task trains from the same start on its rows (words, label), in each of ``ORDERS`` orders by itself; the weighted means become the net's."""
    spread = dealt.sparkSession.sparkContext.broadcast(pickle.dumps((net, sums)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, texts, labels = TaskContext.get().partitionId(), [], []
        for b in batches:
            texts += [np.array(t) for t in _texts(b.column(0))]
            labels += b.column(1).to_pylist()
        for k in range(task * ORDERS, (task + 1) * ORDERS if texts else 0):
            mine, its = pickle.loads(spread.value)
            layers, rows = mine.flat(its)
            steps, used = mine.train(texts, np.array(labels), PASSES, its, seed=seed + k)
            far, moved = mine.flat(its)
            moved -= rows
            out = [(-1, _pack(np.zeros(1), np.array([steps]), far - layers))]
            at = np.flatnonzero(used)
            for block in np.unique(at // BLOCK).tolist():
                some = at[at // BLOCK == block]
                out.append((block, _pack(some - block * BLOCK, used.ravel()[some], moved[some])))
            for block, raw in out:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([k], pa.int64()), pa.array([raw], pa.binary())], ["block", "task", "raw"])

    width = net.flat(sums)[0].size
    made = arrow_stage(dealt.select("words", "label"), run, "block int, task bigint, raw binary")
    got = _added(_added(made, ["block", "fan"], width), ["block"], width).toArrow()  # as many rows as the net has blocks
    layers, rows = np.zeros((1, width)), np.zeros((len(net.e) * BUCKETS, 2 * HALF), np.float32)
    for block, raw in zip(got.column("block").to_pylist(), got.column("raw").to_pylist(), strict=True):
        at, _, mean = _unpack(raw, width if block < 0 else 2 * HALF)
        if block < 0:
            layers = mean
        else:
            rows[at.astype(np.int64) + block * BLOCK] = mean
    net.move(sums, layers, rows)
    spread.destroy()


def _texts(words: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16).reshape(-1, 1 + len(HEADS)) for x in words]


def _apart(rows: DataFrame, net: Net) -> DataFrame:
    """(lang, label, bits): the scores of rows (words, lang, label), as the integers of their bits."""
    spread = rows.sparkSession.sparkContext.broadcast(pickle.dumps(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: Net = pickle.loads(spread.value)
        for b in batches:
            texts = _texts(b.column(0))
            scores = [np.zeros(0), *[mine.score(np.concatenate([texts[i] for i in ids]), np.array([len(texts[i]) for i in ids])) for ids in _steps(np.arange(len(texts)), texts)]]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(np.concatenate(scores).astype(np.float64).view(np.int64))], ["lang", "label", "bits"])

    return arrow_stage(rows.select("words", "lang", "label"), run, "lang string, label int, bits bigint")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out: tuple[int, int] = (4, 2), max_rows: int | None = None, max_bytes: int | None = None, clean_share: float = 0.995, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on labelled documents and choose the thresholds on those set apart."""
    rows = text_of(docs, {"doc_id": id_col, "text": text_col, "lang": lang_col})
    learns = crc_mod("doc_id", held_out[0]) != held_out[1]
    y = text_of(labels, {"doc_id": "doc_id", "label": label_col}).where("label IS NOT NULL").where(learns)
    # texts of labels move, as there is no bound on the labels; filtered on both sides first
    near = rows.where(learns).join(y.hint("merge"), "doc_id").select("doc_id", "text", "lang", "label", F.xxhash64(F.col("doc_id").cast("string")).alias("at"))
    if max_rows is not None or max_bytes is not None:
        # ids in order of their hash while their texts fit together
        order = ["at", "doc_id", "label", F.xxhash64("text")]
        near = near.orderBy(*order).limit(max_rows) if max_rows is not None else near
        so_far = F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        near = near.withColumn("so_far", so_far).where(F.col("so_far") <= max_bytes).drop("so_far") if max_bytes is not None else near
    near = near.select(F.xxhash64("doc_id", "text", "label").alias("key"), "text", "lang", F.col("label").cast("int").alias("label"), "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in T.chunks(b.column(1)):
                h, counts = buckets(c)
                to = np.cumsum(counts)
                words = pa.array([h[x:y].tobytes() for x, y in zip(to - counts, to, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(i).slice(c.first, c.n) if i != 1 else words for i in range(5)], ["key", "words", "lang", "label", "at"])

    made = written(arrow_stage(near, run, "key bigint, words binary, lang string, label int, at bigint"), "toxicity-labelled")
    apart = F.expr(f"pmod(shiftright(at, 7), {APART}) = 0")
    net, train = Net(), made.where(~apart)
    sums = net.sums()
    seen = train.agg(F.count("*").alias("n"), F.avg("label").alias("share"), F.min("label").alias("least"), F.max("label").alias("most"), F.sum(F.octet_length("words")).alias("bytes")).first()
    if seen.n == 0 or seen.least == seen.most:
        net.constant = float(seen.share or 0.0)
    else:
        # dealt by hash, not by place in the input; in a fixed order within a task
        tasks = max(1, -(-seen.bytes // TASK_BYTES))
        dealt = train.select("key", "words", "label").repartition(tasks, "key").sortWithinPartitions("key", "label")
        for k in range(ROUNDS):
            # what moved before: the texts, then the rows of each round
            release(docs.sparkSession)
            _round(dealt, net, sums, 1 + 100_000 * k)
    scored = written(_apart(made.where(apart), net), "toxicity-apart").where("label = 0")
    discard(made)
    # the empty key stands for all languages
    keyed = scored.select(F.explode(F.array(F.lit(""), F.concat(F.lit("="), F.col("lang")))).alias("key"), "bits").where("key IS NOT NULL")
    found = cuts(keyed, clean_share)
    largest = scored.agg(F.max("bits")).first()[0]
    return Model.__new__(Model).given(net, found.pop("", None), float(np.int64(largest or 0).view(np.float64)), {k[1:]: v for k, v in found.items()})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, score, and ``flagged`` by the threshold of the row's language."""
    rows = text_of(docs, {"doc_id": id_col, "text": text_col, "lang": lang_col})
    kind = rows.schema["doc_id"].dataType.simpleString()
    spread = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = pickle.loads(spread.value)
        for b in batches:
            for c in T.chunks(b.column(1)):
                s = m.net.score(*buckets(c))
                cut = np.array([m.by_lang.get(x, m.threshold) for x in b.column(2).slice(c.first, c.n).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.n), pa.array(s), pa.array(s >= cut)], ["doc_id", "score", "flagged"])

    return arrow_stage(rows, run, f"doc_id {kind}, score double, flagged boolean")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out: tuple[int, int] = (4, 2), threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, flagged."""
    out = score(docs, fit(docs, labels, label_col, held_out))
    return out.select("doc_id", (crc_mod("doc_id", held_out[0]) == held_out[1]).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "flagged")
