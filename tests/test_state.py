"""Walks, sessions, machines over time and inverted files against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn import storage
from skarn.operators import graph, history, inverted, retrieval
from skarn.streaming import machines

SF = "/root/testdata/sf0.001"
HUNK = "file string, id string, author string, ts bigint, is_fix boolean, old_start bigint, old_lines bigint, new_start bigint, new_lines bigint"


# -- commit walk --------------------------------------------------------------------


def plain_walk(hunks, chunks):
    """Each file's commits from newest to oldest, ranges moved by ``shift``."""
    out = []
    for file in {h[0] for h in hunks}:
        ranges = {c: [a, b] for f, c, a, b in chunks if f == file}
        for ts, sha in sorted({(h[3], h[1]) for h in hunks if h[0] == file}, key=lambda x: (-x[0], x[1])):
            part = [h for h in hunks if (h[0], h[3], h[1]) == (file, ts, sha)]
            for h in part:
                last = h[7] + max(h[8] - 1, 0)
                for c, (a, b) in ranges.items():
                    if h[7] <= b and last >= a:
                        n = min(last, b) - max(h[7], a) + 1
                        out.append((file, c, sha, h[2], ts, h[4], n, int(h[6] * n / h[8] + 0.5) if h[8] else 0))
            history.shift(ranges.values(), [(h[6], h[7], h[8]) for h in sorted(part, key=lambda h: (h[7], h[5], h[8], h[6]))])
    return sorted(out)


def some_history(seed, commits, lines=120):
    r = random.Random(seed)
    hunks = []
    for k in range(commits):
        file = "hot" if k % 3 == 0 else f"f{k % 7}"
        for _ in range(r.randint(1, 3)):
            at = r.randint(1, lines)
            hunks.append((file, f"c{k // 2}", f"a{k % 4}", 1000 + k // 5, k % 6 == 0, at, r.randint(0, 6), at, r.randint(0, 6)))
    chunks = [(f, f"{f}-{i}", a, a + r.randint(0, 25)) for f in ["hot", *[f"f{k}" for k in range(8)]] for i, a in enumerate(range(1, lines, 12))]
    return hunks, chunks


@pytest.mark.parametrize(("block", "together"), [(10**6, 256), (40, 3)])
def test_walk_in_stretches(spark, block, together):
    """A third of all commits in one file: walked in many stretches with the same touches as one walk."""
    hunks, chunks = some_history(block, 240)
    met = history.walk_hunks(spark.createDataFrame(hunks, HUNK).repartition(3), spark.createDataFrame(chunks, "file string, chunk_id string, start_line bigint, end_line bigint"), block, together)
    assert sorted(tuple(r) for r in met.collect()) == plain_walk(hunks, chunks)


def test_no_task_walks_a_busy_file(spark, monkeypatch):
    hunks, chunks = some_history(5, 600)
    sizes, real = spark.sparkContext.accumulator(0), history._walk
    whole = len([h for h in hunks if h[0] == "hot"])

    def counted(key, a, b):
        if len(a) > whole // 2:
            sizes.add(1)
        return real(key, a, b)

    monkeypatch.setattr(history, "_walk", counted)
    history.walk_hunks(spark.createDataFrame(hunks, HUNK), spark.createDataFrame(chunks, "file string, chunk_id string, start_line bigint, end_line bigint"), 60).count()
    assert sizes.value == 0 and whole > 300


def test_walk_edges(spark):
    """No hunks, no chunks, files without the other, null files."""
    hunks, chunks = spark.createDataFrame([("f", "c", "a", 1, False, 1, 0, 1, 2), (None, "c", "a", 1, False, 1, 0, 1, 2), ("g", "c", "a", 1, False, 1, 0, 1, 2)], HUNK), spark.createDataFrame([("f", "x", 1, 5), ("h", "y", 1, 2)], "file string, chunk_id string, start_line bigint, end_line bigint")
    assert [(r.file, r.chunk_id, r.added) for r in history.walk_hunks(hunks, chunks).collect()] == [("f", "x", 2)]
    assert history.walk_hunks(hunks.limit(0), chunks).count() == history.walk_hunks(hunks, chunks.limit(0)).count() == 0


# -- sessions -----------------------------------------------------------------------


def test_merged_sessions(spark):
    """A gap of exactly the limit begins a new session; authors and chunks have their own."""
    rows = [("c", "a", 0, False), ("c", "a", 1799, True), ("c", "a", 1799 + 1800, False), ("c", "b", 10, False), ("d", "a", 20, False)]
    df = spark.createDataFrame(rows, "chunk_id string, author string, ts bigint, is_fix boolean")
    got = sorted(tuple(r) for r in history.merged_sessions(df, 30).collect())
    assert got == [("c", "a", 0, 1799, 2, True), ("c", "a", 3599, 3599, 1, False), ("c", "b", 10, 10, 1, False), ("d", "a", 20, 20, 1, False)]
    assert history.merged_sessions(df.limit(0)).count() == 0


def test_sessions_equal_the_window_form(spark):
    r = random.Random(3)
    rows = [(f"c{r.randint(0, 4)}", f"a{r.randint(0, 2)}", r.randint(0, 60) * 600, r.random() < 0.2, f"s{k}") for k in range(400)]
    df = spark.createDataFrame(rows, "chunk_id string, author string, ts bigint, is_fix boolean, sha string")
    plain = history.sessions(df, 30, ("chunk_id", "author"), drop_merges=False).select("chunk_id", "author", "first_ts", "ts", "commits", "is_fix")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, history.merged_sessions(df, 30).collect()))


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [(k, "c", "a", 1_700_000_000 + t, False) for k, t in enumerate([0, 60, 5000, 5060, 90000])]
    df = spark.createDataFrame(rows, "event_id bigint, chunk_id string, author string, s bigint, is_fix boolean").withColumn("ts", F.timestamp_seconds("s"))
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    machines.follow(history.merged_sessions(s, 30), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    closed = sorted((r.first_ts - 1_700_000_000, r.touches) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert closed == [(0, 2), (5000, 2)]  # the last one may still grow


# -- machines -----------------------------------------------------------------------


def plain_batches(rows, size, timeout, least, horizon, defers=3):
    """One key's (time, id) in order, with a clock that is looked at before every row."""
    out, held, due, deferred = [], [], None, 0

    def clock(now):
        nonlocal held, due, deferred
        while due is not None and due <= now:
            if len(held) < least and deferred < defers:
                deferred, due = deferred + 1, due + timeout // 2
            else:
                out.append((len(held), held[0], held[-1], due, "time"))
                held, due, deferred = [], None, 0

    for t, i in sorted(rows):
        if t >= horizon:
            break
        clock(t)
        held.append(i)
        if due is None:
            due = t + timeout
        if len(held) == size:
            out.append((len(held), held[0], held[-1], t, "size"))
            held, due, deferred = [], None, 0
    clock(horizon - 1)
    return [(k + 1, *x) for k, x in enumerate(out)]


def events_of(spark, seed, n=500, keys=6):
    r = random.Random(seed)
    rows = [(k, f"u{r.randint(0, keys - 1)}", r.randint(0, 400) * 10, r.choice(["error", "view", "click", "signup"])) for k in range(n)]
    df = spark.createDataFrame(rows, "event_id bigint, user string, s bigint, kind string").withColumn("ts", F.timestamp_millis(F.col("s") + 1_700_000_000_000)).drop("s")
    return df, [(k, u, 1_700_000_000_000 + s, kind) for k, u, s, kind in rows]


@pytest.mark.parametrize(("size", "timeout", "least"), [(5, 300, 3), (4, 1000, None), (1, 50, 1), (100, 200, 0)])
def test_accumulator(spark, size, timeout, least):
    df, rows = events_of(spark, size)
    horizon = max(t for _, _, t, _ in rows)
    got = machines.batch(df, machines.Accumulator(size, timeout, least), "user").collect()
    for u in {r[1] for r in rows}:
        mine = sorted(tuple(x)[2:] for x in got if x.key == u)
        assert mine == plain_batches([(t, k) for k, v, t, _ in rows if v == u], size, timeout, size // 2 if least is None else least, horizon)


@pytest.mark.parametrize("type_", ["string", "bigint", "double", "timestamp", "binary", "decimal(20,2)"])
def test_keys_of_a_stream_share_groups(spark, tmp_path, monkeypatch, type_):
    """A lane holds many keys, of any plain type and null, and gives each its own rows."""
    df, _ = events_of(spark, 3, keys=40)
    number = F.substring("user", 2, 9).cast("bigint")
    keys = {"binary": F.col("user").cast("binary"), "timestamp": F.timestamp_micros(number), "bigint": number}
    df = df.withColumn("user", F.when(number > 0, keys.get(type_, F.col("user") if type_ == "string" else number / 4).cast(type_)))
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    used = []
    real = machines.follow
    monkeypatch.setattr(machines, "follow", lambda *a: used.append(real(*a)) or used[-1])
    machine = machines.Accumulator(4, 300, 2)
    streamed = machines.drained(s, machine, "user", lanes=3)
    got, want = ([tuple(r) for r in x.collect()] for x in (streamed, machines.batch(df, machine, "user")))
    order = lambda r: (str(r[0]), r[1:3])
    assert sorted(got, key=order) == sorted(want, key=order) and streamed.schema["key"].dataType == df.schema["user"].dataType and len({r[0] for r in got}) == 40
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in used[0].recentProgress if p["stateOperators"]) <= 3


@pytest.mark.parametrize("kind", ["accumulator", "quarantine"])
def test_streams_equal_tables_after_restarts(spark, tmp_path, kind):
    """Rows come out of order in three runs from one checkpoint; shards too."""
    df, _ = events_of(spark, 9)
    machine = machines.Accumulator(4, 300, 2) if kind == "accumulator" else machines.Quarantine(100, 1000, ("error", "click"), ("signup",))
    options = {"kind": "kind", "delay": 1500, "shards": 2}
    parts = [df.where((F.unix_millis("ts") - 1_700_000_000_000).between(a, b) & (F.col("event_id") % 2 == odd)) for a, b, odd in ((0, 1400, 0), (0, 2800, 1), (1401, 4000, 0), (2801, 4000, 1))]
    folder = tmp_path / "in"
    for k, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(str(folder))
        s = spark.readStream.schema(df.schema).parquet(str(folder))
        machines.follow(machines.stream(s, machine, "user", **options), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    streamed = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert streamed == sorted(tuple(r) for r in machines.batch(df, machine, "user", **options).collect()) and len(streamed) > 50


def test_quarantine(spark):
    """Delays double up to the longest; a change is tried at once; success clears; what is left is listed."""
    rows = [(1, "p", 0, "error"), (2, "p", 50, "error"), (3, "p", 1000, "ok"), (4, "q", 10, "error"), (5, "q", 60, "edit"), (6, "q", 70, "error"), (7, "r", 5, "ok"), (8, "s", 5000, "ok")]
    df = spark.createDataFrame(rows, "event_id bigint, path string, s bigint, kind string").withColumn("ts", F.timestamp_millis("s"))
    log = machines.batch(df, machines.Quarantine(100, 150, ("error",), ("edit",)), "path", kind="kind")
    got = sorted((r.key, r.seq, r.what, r.at, r.attempts, r.due) for r in log.collect())
    assert got == [
        ("p", 1, "failed", 0, 1, 100), ("p", 2, "failed", 50, 2, 200), ("p", 3, "due", 200, 2, None), ("p", 4, "cleared", 1000, 2, None),
        ("q", 1, "failed", 10, 1, 110), ("q", 2, "changed", 60, 1, None), ("q", 3, "failed", 70, 2, 220), ("q", 4, "due", 220, 2, None),
    ]
    assert [(r.key, r.attempts, r.first_failed, r.last_failed) for r in machines.quarantined(log).collect()] == [("q", 2, 10, 70)]
    assert machines.batch(df.limit(0), machines.Quarantine(1, 2), "path", kind="kind").count() == 0


# -- inverted file ------------------------------------------------------------------


def clustered(spark, n=3000, seed=1):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((25, 16)) * 2
    x = centres[r.integers(0, 25, n)] + r.standard_normal((n, 16)) * 0.5
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>"), x


def test_inverted_file(spark):
    df, x = clustered(spark)
    index = inverted.build(df)
    assert index.rows.count() == 3000 and len(index.centroids) == 54
    asked = df.where("vec_id % 20 = 0")
    found = inverted.search_all(index, asked, 10, 6)
    exact = inverted.exact_all(df, asked, 10)
    assert inverted.recall(found, exact).first().recall >= 0.9
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    plain = {q: np.argsort(-np.round(u[q] @ u.T, 6), kind="stable")[:10].tolist() for q in range(0, 3000, 20)}
    got = {}
    for r in exact.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == plain
    one = [r.vec_id for r in inverted.search(index, x[40].tolist(), 10, 6).collect()]
    assert one == [r.vec_id for r in found.where("query_id = 40").orderBy("rank").collect()]


def test_inverted_search_reads_less(spark):
    """Only folders of probed lists are listed, and codes are read before vectors."""
    df, x = clustered(spark)
    index = inverted.build(df)
    query = x[7].tolist()
    near = index.rows.where(F.col("list").isin(index.nearest(query, 6))).select("vec_id", "codes")

    def scanned(df):
        df.collect()
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return leaf.metrics().apply("filesSize").value(), leaf.toString()

    (some, text), (whole, _) = scanned(near), scanned(index.rows.select("vec_id", "vector"))
    assert some < 0.4 * whole and "codes:array<tinyint>" in text and "vector" not in text.split("ReadSchema")[1]
    last = inverted.search(index, query, 5, 6)
    last.collect()
    assert "PushedFilters: [In(vec_id" in last._jdf.queryExecution().toString()
    assert [r.vec_id for r in inverted.search(index, query, 5, 54).collect()] == [r.vec_id for r in retrieval.dense(df, query, 5).collect()]


def test_blocks_of_an_inverted_list(spark, monkeypatch):
    """One very common vector fills a list: its members and queries meet in blocks with the same result."""
    df, _ = clustered(spark, 400)
    df = df.unionByName(spark.range(1000, 1600).select(F.col("id").alias("vec_id"), F.array(*[F.lit(1.0).cast("float")] * 16).alias("embedding")))
    index = inverted.build(df, lists=5)
    asked = df.where("vec_id % 20 = 0")
    want = sorted(map(tuple, inverted.search_all(index, asked, 7, 2).collect()))
    monkeypatch.setattr(inverted, "MEMBERS", 64)
    monkeypatch.setattr(inverted, "QUERIES", 8)
    assert sorted(map(tuple, inverted.search_all(index, asked, 7, 2).collect())) == want and len(want) == 7 * asked.count()


# -- adjacency ----------------------------------------------------------------------


def test_steps_leave_edges_where_they_are(spark):
    """From the first step on only the rows move: no exchange stands above the scan of the edges."""
    r = random.Random(4)
    e = spark.createDataFrame([(r.randint(0, 50), r.randint(0, 50)) for _ in range(400)], "s bigint, d bigint").distinct()
    a = graph.Adjacency(e, "s", "d")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(40).select(F.col("id").alias("node"))
        step = a.step(rows, "node").select(F.col("d").alias("node")).distinct()
        again = a.step(step, "node")
        plan = again._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Bucketed: true") == 2
        for part in plan.split("Bucketed: true")[:-1]:  # the lines above each scan, up to its join
            above = part[part.rindex("SortMergeJoin") :].split("\n") if "SortMergeJoin" in part else []
            depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
            at, chain = len(above) - 1, []
            for line in reversed(above[:-1]):
                if depth(line) < depth(above[at]):
                    at = above.index(line)
                    chain.append(line)
            assert not any("Exchange" in line for line in chain[: next((k for k, x in enumerate(chain) if "SortMergeJoin" in x), len(chain))])
        got = sorted(tuple(x) for x in again.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    pairs = [tuple(x) for x in e.collect()]
    first = {d for s, d in pairs if s < 40}
    assert got == sorted((s, d) for s, d in pairs if s in first)


def test_busy_nodes_are_spread(spark):
    """Edges of a node beyond the limit lie in several buckets; steps find all of them once."""
    pairs = [(0, d) for d in range(300)] + [(d, d + 1) for d in range(1, 100)]
    e = spark.createDataFrame(pairs, "s bigint, d bigint")
    a = graph.Adjacency(e, "s", "d", hot=50)
    assert a.edges.where("s = 0").select("_salt").distinct().count() == 6 and a.edges.where("s > 0").agg(F.max("_salt")).first()[0] == 0
    rows = spark.createDataFrame([(0,), (5,)], "node bigint")
    assert sorted(tuple(r) for r in a.step(rows, "node").select("s", "d").collect()) == sorted([(0, d) for d in range(300)] + [(5, 6)])


def test_listing_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    first = storage.listing(spark, path)
    assert first == storage.listing(spark, path)
    spark.range(2).write.mode("append").parquet(path)
    assert first != storage.listing(spark, path)
