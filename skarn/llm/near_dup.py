"""Near-duplicate documents: MinHash, banding, verification, connected components.

1. Every text becomes its set of distinct word shingles (64-bit hashes) and a signature:
   the low byte of the minimum of each of ``bands * rows`` universal hashes.
2. Texts with equal sets form one class, found by a grouping with map-side combine; from
   here on only one member of a class takes part, however many copies there are.
3. A band of ``rows`` signature bytes is a bucket.  Classes that share a bucket are
   candidates.  A bucket is never expanded into all its pairs: first each class meets the
   bucket's pivot, then what is linked is joined to components, and only classes of
   *different* components in one bucket are compared further.  A link inside a component
   cannot change the result, one between components is always tested.
4. A candidate is compared by signatures first: of all the bytes at least so many must
   agree that a pair at the threshold falls short with a probability of ``MARGIN``.  Only
   texts that pass with some partner have their sets made, moved and compared in full.
5. Components come from alternating large-star and small-star on the links.

``plan(threshold)`` picks bands and rows so that a pair at the threshold is missed with a
probability of about one in a million.  Members and queries of a group meet in blocks of
bounded size, so neither a bucket that all texts share nor a very long text makes a task
that grows with the corpus.

Defined results: a null text or one without words is linked with nothing and is its own
component; a null doc_id never names a component that has another id; repeated rows get
equal results, one each; an empty table gives no rows; other columns are ignored
(``near_duplicates``) or passed on whatever their names (``keep_first``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._jobs import arrow_stage, bloom, free_names, in_bloom, release, text_of, written

MISS = 1e-6
MARGIN = 1e-7


def least_agreement(threshold: float, size: int, margin: float = MARGIN) -> int:
    """Bytes of two signatures that must agree: a pair at the threshold has fewer with chance ``margin``."""
    p = threshold + (1 - threshold) / 256  # equal minima, or two bytes that are equal by chance
    if p >= 1:
        return size
    k = np.arange(size + 1)
    chance = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, size + 1)))))
    pmf = np.exp(chance[size] - chance[k] - chance[size - k] + k * np.log(p) + (size - k) * np.log1p(-p))
    return int(np.searchsorted(np.cumsum(pmf), margin))


def plan(threshold: float, miss: float = MISS, budget: int = 384) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands stay within the budget."""
    found = None
    for rows in range(1, 9):
        bands = int(np.ceil(np.log(miss) / np.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if found is None or bands * rows <= budget:
            found = (bands, rows)
    return found


def _hashes(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return (r.integers(0, 1 << 31, n, dtype=np.uint32) << np.uint32(1)) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """The low byte of each hash's minimum over the set."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 1024):
        values = a[:, None] * x[None, k : k + 1024]
        values += b[:, None]
        np.minimum(low, values.min(axis=1), out=low)
    return (low & np.uint32(255)).astype(np.uint8).tobytes()


def shingle_sets(c: T.Chunk, size: int) -> list[np.ndarray]:
    """Per document the sorted distinct shingle hashes; a shorter text is one shingle."""
    w = T.words(c.lowered(), T.SPACED)
    keys, _, made = T.grams(w.hash, w.counts, size)
    to = np.cumsum(made)
    short = {k: T.grams(w.hash, w.counts, k) for k in range(1, size) if (w.counts == k).any()}
    out = []
    for d in range(c.n):
        n = int(w.counts[d])
        if n >= size:
            out.append(np.unique(keys[to[d] - made[d] : to[d]]))
        elif n:
            k, _, m = short[n]
            end = int(m[: d + 1].sum())
            out.append(k[end - 1 : end] + np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def signatures(rows: DataFrame, size: int, bands: int, rows_: int, seed: int = 7) -> DataFrame:
    """(doc_id, copy, key, n, s1, s2, sig): text hashes, set size, hashes of the set, signature."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hashes(bands * rows_, seed)
        for batch in batches:
            key, n, s1, s2, sig = [], [], [], [], []
            for c in T.chunks(batch.column(1)):
                key.append(T.span_hashes(c.data, c.borders[:-1], c.borders[1:]))
                for s in shingle_sets(c, size):
                    n.append(len(s))
                    s1.append(T.mix(s + np.uint64(11)).sum(dtype=np.uint64))
                    s2.append(T.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                    sig.append(signature(s, a, b) if len(s) else b"")
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(_signed(np.concatenate(key))), pa.array(n, pa.int64()), pa.array(_signed(np.array(s1, np.uint64))), pa.array(_signed(np.array(s2, np.uint64))), pa.array(sig, pa.binary())],
                    ["doc_id", "copy", "key", "n", "s1", "s2", "sig"],
                )

    return arrow_stage(rows, run, f"doc_id {kind}, copy bigint, key bigint, n bigint, s1 bigint, s2 bigint, sig binary")


def _buckets(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, node, n): one row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = T.mix(np.arange(bands, dtype=np.uint64) + np.uint64(1))
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, bands, rows)
            wide = np.zeros((b.num_rows, bands, 8), np.uint8)
            wide[:, :, :rows] = sig
            keys = T.mix(wide.view("<u8")[:, :, 0] ^ salt[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(_signed(keys.ravel())), pa.array(np.repeat(b.column(0).to_numpy(), bands)), pa.array(np.repeat(b.column(1).to_numpy(), bands))], ["bucket", "node", "n"])

    return arrow_stage(classes.select("node", "n", "sig"), run, "bucket bigint, node bigint, n bigint")


#: (id, text) pairs that a task remembers, so that their repetitions don't move.
REMEMBER = 1 << 18


def _sets(rows: DataFrame, active: DataFrame, size: int) -> DataFrame:
    """(node, set) of the classes in ``active`` (node, doc_id, key), from the texts.

    A class is found again by the id and the hash of its first text, so rows that share an
    id (or have none) meet only the class of their own text, and repeated rows move once a task.
    """
    spark = rows.sparkSession
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    wanted = active.select("node", "key", name.alias("k"))
    ids, texts = bloom(wanted, *[F.xxhash64("k", F.lit(s)) for s in (1, 2)]), bloom(wanted, F.col("key"), F.shiftright("key", 32))
    sent = [spark.sparkContext.broadcast(t) for _, t in (ids, texts)]
    low = (1 << texts[0]) - 1
    keyed = rows.withColumn("k", name).select("k", "text", *[F.pmod(F.xxhash64("k", F.lit(s)), F.lit(1 << ids[0])).alias(f"b{s}") for s in (1, 2)])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id, by_text = (np.frombuffer(b.value, np.uint32) for b in sent)
        has = in_bloom
        met: set[tuple[str, int]] = set()
        for b in batches:
            b = b.filter(pa.array(has(by_id, b.column(2).to_numpy()) & has(by_id, b.column(3).to_numpy())))
            for c in T.chunks(b.column(1)):
                key = _signed(T.span_hashes(c.data, c.borders[:-1], c.borders[1:]))
                k = b.column(0).slice(c.first, c.n)
                mine = np.flatnonzero(has(by_text, key & low) & has(by_text, (key >> 32) & low))
                if len(met) > REMEMBER:
                    met.clear()
                new = []
                for i in mine.tolist():
                    pair = (k[i].as_py(), int(key[i]))
                    if pair not in met:
                        met.add(pair)
                        new.append(i)
                take = pa.array(new, pa.int64())
                yield pa.RecordBatch.from_arrays([k.take(take), pa.array(key[new]), b.column(1).slice(c.first, c.n).take(take)], ["k", "key", "text"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in T.chunks(b.column(0)):
                sets = [s.tobytes() for s in shingle_sets(c, size)]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(c.first, c.n), pa.array(sets, pa.binary())], ["node", "set"])

    found = arrow_stage(keyed, likely, "k string, key bigint, text string")
    return arrow_stage(found.join(wanted, ["k", "key"]).select("text", "node"), build, "node bigint, set binary").groupBy("node").agg(F.first("set").alias("set"))


#: Shingles of a block of members, and of a block of queries that meets it; and rows.
BLOCK = 100_000
BLOCK_ROWS = 256


def _alike(rows: list[tuple], least: int) -> list[int]:
    """Which rows (role, node, comp, sig) of a block agree well enough with one of the other role and another component."""
    at = [np.array([i for i, r in enumerate(rows) if r[0] == role]) for role in (0, 1)]
    if not len(at[0]) or not len(at[1]):
        return []
    sigs = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
    comps = np.array([r[2] for r in rows])
    members, found = sigs[at[0]], np.zeros(len(rows), bool)
    for q in at[1]:
        hit = ((members == sigs[q]).sum(1) >= least) & (comps[at[0]] != comps[q])
        if hit.any():
            found[q] = True
            found[at[0][hit]] = True
    return np.flatnonzero(found).tolist()


def _meet(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between the queries and members of one block; one for each two components."""
    members = [r for r in rows if r[0] == 0]
    queries = [r for r in rows if r[0] == 1]
    if not members or not queries:
        return []
    sets = [np.frombuffer(r[3], np.uint64) for r in members]
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    comps = np.array([r[2] for r in members])
    out = []
    for _, node, comp, raw in queries:
        s = np.frombuffer(raw, np.uint64)
        lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        times = hi - lo
        at = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        hit = np.flatnonzero((100 * both >= percent * (sizes + len(s) - both)) & (comps != comp))
        if len(hit):
            _, one = np.unique(comps[hit], return_index=True)
            out += [(node, members[i][1]) for i in hit[one]]
    return out


def _by_block(grid: DataFrame, values: DataFrame, value: str, use, schema: str) -> DataFrame:
    """``use(block, rows)`` for every block of the grid joined with a value per node; rows are (role, node, comp, value)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(7)]
            out = []
            for *block, role, node, comp, raw in zip(*cols, strict=True):
                if block != now:
                    out += use(now, rows)
                    now, rows = block, []
                rows.append((role, node, comp, raw))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out, strict=True), strict=True)))
        out = use(now, rows)
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out, strict=True), strict=True)))

    full = grid.join(values, "node").select("group", "part", "qpart", "role", "node", "comp", value)
    n = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = full.repartition(n, "group", "part", "qpart").sortWithinPartitions("group", "part", "qpart", "role", "node")
    return arrow_stage(dealt, run, schema)


GRID = "group bigint, part bigint, qpart bigint, role bigint, node bigint, comp bigint"


def _likely(grid: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """The rows of the grid that pass by signature with some partner in their block."""
    use = lambda block, rows: [(*block, *rows[i][:3]) for i in _alike(rows, least)]
    return _by_block(grid, sigs, "sig", use, GRID)


def _verify(grid: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) from rows (group, part, qpart, role, node, comp): role 0 members, 1 queries."""
    return _by_block(grid, sets, "set", lambda _, rows: _meet(rows, percent), "a bigint, b bigint").distinct()


def _deal(column: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(column), parts)


def _grid(members: DataFrame, queries: DataFrame) -> DataFrame:
    """Blocks of members x blocks of queries of each group, so that no task is unbounded.

    members and queries: (group, node, comp, n).  A set goes to as many blocks as the
    other side has, which is one but for very large groups.
    """
    blocks = lambda df, name: df.groupBy("group").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("*") / BLOCK_ROWS)).alias(name))
    sizes = blocks(members, "parts").join(blocks(queries, "qparts"), "group")
    m = members.join(sizes, "group").withColumn("part", _deal("node", F.col("parts"))).withColumn("qpart", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("qparts") - 1)))
    q = queries.join(sizes, "group").withColumn("qpart", _deal("node", F.col("qparts"))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    pick = lambda df, role: df.select("group", "part", "qpart", F.lit(role).cast("bigint").alias("role"), "node", "comp")
    return pick(m, 0).unionByName(pick(q, 1))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node of each node's component, for all nodes on edges.

    Alternating large-star and small-star; each round is written to the shared folder.
    A node's neighbours are only ever reduced to their minimum (with map-side combine)
    and joined back, never gathered.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    mark = before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars", instead_of=before)
        before = now
        seen = now.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("bigint")).alias("h")).first()
        if (seen.n, seen.h) == mark:
            break
        mark = (seen.n, seen.h)
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two texts are linked if 100 * shared shingles >= percent * all their shingles.
    """
    out = _placed(docs, shingle, percent, id_col, text_col, seed).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _placed(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str, seed: int = 7) -> DataFrame:
    """(doc_id, copy, n, comp, component_id) of each row; a text without words has no comp."""
    bands, rows_ = plan(percent / 100)
    rows = text_of(docs, {"doc_id": id_col, "text": text_col}).withColumn("copy", _copy("text"))
    sigs = written(signatures(rows, shingle, bands, rows_, seed), "signatures")
    some = sigs.where("n > 0")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    classes = written(
        some.groupBy("s1", "s2").agg(best.alias("best"), F.first("n").alias("n"), F.first("sig").alias("sig")).select(F.col("s1").alias("node"), "n", "sig", "best.doc_id", "best.key"),
        "classes",
    )
    buckets = _buckets(classes, bands, rows_)
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("times")).where("times > 1").drop("times")
    hot = written(buckets.join(shared, "bucket"), "buckets")
    sig = classes.select("node", "sig")
    least = least_agreement(percent / 100, bands * rows_)
    found = lambda grid: grid.select("node").distinct().join(classes.select("node", "doc_id", "key"), "node")

    # every class meets the pivots of its buckets
    stars = hot.where("node != pivot").select(F.col("pivot").alias("group"), "node", F.col("node").alias("comp"), "n").distinct()
    heads = stars.select("group").distinct().select("group", F.col("group").alias("node"), F.col("group").alias("comp"), F.lit(1).alias("n"))
    likely = written(_likely(_grid(stars, heads), sig, least), "likely")
    sets = written(_sets(rows, found(likely), shingle), "sets")
    links = written(_verify(likely, sets, percent), "links")
    comps = written(components(links), "components")

    # in buckets that still hold several components, all others meet all the rest
    placed = hot.join(comps, "node", "left").select(F.col("bucket").alias("group"), "node", F.coalesce("comp", "node").alias("comp"), "n")
    of = placed.groupBy("group", "comp").agg(F.count("*").alias("k")).groupBy("group").agg(F.max(F.struct("k", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    mixed = written(placed.join(of.select("group", F.col("main.comp").alias("main")), "group"), "mixed")
    others = mixed.where("comp != main").drop("main")
    likely = written(_likely(_grid(mixed.drop("main"), others), sig, least), "likely")
    new = found(likely).join(sets.select("node"), "node", "left_anti")
    if not new.isEmpty():
        sets = sets.unionByName(written(_sets(rows, new, shingle), "sets"))
    more = _verify(likely, sets, percent)
    every = more.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")))
    comps = written(components(written(every, "links")), "components")

    # the smallest id of each component, back to every row through its class
    named = comps.join(classes.select("node", "doc_id"), "node").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    known = classes.select(F.col("node").alias("s1"), F.col("doc_id").alias("own")).join(comps.join(named, "comp").select(F.col("node").alias("s1"), "comp", "component_id"), "s1", "left")
    known = written(known.select("s1", F.coalesce("comp", "s1").alias("comp"), F.when(F.col("comp").isNull(), F.col("own")).otherwise(F.col("component_id")).alias("component_id")), "named")
    out = some.select("doc_id", "copy", "n", "s1").join(known, "s1").select("doc_id", "copy", "n", "comp", "component_id")
    out = out.unionByName(sigs.where("n = 0").select("doc_id", "copy", "n", F.lit(None).cast("bigint").alias("comp"), F.col("doc_id").alias("component_id")))
    release(docs.sparkSession)
    return out


def _copy(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates stays, with all its columns.

    It is a row with the group's smallest id, and of several texts under that id in one
    group the one of smallest hash.  Texts of different groups stay whatever their ids; rows
    that repeat id and text are one document.  A text without words is a group per id.
    """
    rows = _placed(docs, shingle, percent, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    times = written(rows.groupBy("comp", "doc_id", "copy").agg(F.count("*").alias("times")), "kept")
    found = times.where("comp IS NOT NULL").groupBy("comp", "doc_id").agg(F.min(F.struct("copy", "times")).alias("m")).select("doc_id", "m.copy", "m.times")
    found = found.unionByName(times.where("comp IS NULL").select("doc_id", "copy", "times"))
    mine, kept_id, kept_copy, n = free_names(docs, "_copy", "_kept_id", "_kept_copy", "_times")
    found = found.select(F.col("doc_id").alias(kept_id), F.col("copy").alias(kept_copy), F.col("times").alias(n))
    kept = docs.withColumn(mine, _copy(text_col))
    kept = kept.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col(kept_id)) & (F.col(mine) == F.col(kept_copy)), "left_semi")
    if not found.where(F.col(n) > 1).isEmpty():
        kept = kept.dropDuplicates([id_col, mine])
    return kept.drop(mine)
