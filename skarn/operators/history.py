"""Version-history operators: sessions, file and chunk metrics, ownership, branches, hunks."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.numeric import age_days, round0, round2
from ..functions.text import is_fix, is_merge_subject, subject, task_ids
from ..storage import discard, written
from .intervals import blocks, holders

# History windows and session gap.
SESSION_MINUTES, DECAY, TOP_AUTHORS = 30, 0.1, 10
MONTH_DAYS, ALL_MONTHS = 30, 120
#: Generations of parents followed in one job.
STEPS = 6
# Subjects of merges of bug-fix branches.
FIX_BRANCHES = (r"(?i)Merge branch '(?:fix|hotfix|bugfix)/", r"(?i)Merge pull request #\d+ from [^/]+/(?:fix|hotfix|bugfix)[/-]")


def window_start(as_of: int, months: int) -> int:
    """First second of a history window; 0 months means ten years."""
    return as_of - (months or ALL_MONTHS) * MONTH_DAYS * 86400


def sessions(commits: DataFrame, gap_minutes: float = SESSION_MINUTES, keys: tuple[str, ...] = ("author",), drop_merges: bool = True, id_col: str = "sha") -> DataFrame:
    """(keys, session, ts, first_ts, commits, is_fix): bursts of one author's commits.

    A gap of exactly ``gap_minutes`` begins a new session.  commits: author, ts (seconds),
    is_fix and, to drop merges, body.
    """
    rows = commits.where(~is_merge_subject("body")) if drop_merges else commits
    w = Window.partitionBy(*keys).orderBy("ts", id_col)
    before = F.lag("ts").over(w)
    new = F.when(before.isNull() | (F.col("ts") - before >= gap_minutes * 60), 1).otherwise(0)
    numbered = rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "session").agg(F.max("ts").alias("ts"), F.min("ts").alias("first_ts"), F.count("*").alias("commits"), F.max("is_fix").alias("is_fix"))


def merged_sessions(touches: DataFrame, gap_minutes: float = SESSION_MINUTES, keys: tuple[str, ...] = ("chunk_id", "author"), time: str = "ts") -> DataFrame:
    """(keys, first_ts, ts, touches, is_fix): bursts of touches, as Spark's session windows.

    A gap of exactly ``gap_minutes`` begins a new session, and a session is a fix if any touch in
    it is.  Windows that meet are merged row by row as they come sorted, so a busy chunk is never
    gathered.  ``time`` may be seconds, or a timestamp: a stream with a watermark on it gives
    each session once, when it is closed.
    """
    whole = isinstance(touches.schema[time].dataType, NumericType)
    at = F.timestamp_seconds(time) if whole else F.col(time)
    w = F.session_window(at, f"{round(gap_minutes * 60_000_000) - 1} microseconds")  # windows that only touch are merged too
    second = F.col(time) if whole else F.col(time).cast("bigint")
    made = touches.withColumn("_s", second).groupBy(*keys, w).agg(F.min("_s").alias("first_ts"), F.max("_s").alias("ts"), F.count("*").alias("touches"), F.max("is_fix").alias("is_fix"))
    return made.drop("session_window")


def _units(units: DataFrame, key: str, as_of: int) -> DataFrame:
    """Metrics of a file's or chunk's units (commits or sessions) with ts and is_fix."""
    w = Window.partitionBy(key).orderBy("ts", "id")
    gap = (F.col("ts") - F.lag("ts").over(w)) / 86400
    days = (F.lit(as_of) - F.col("ts")) / 86400
    n, span = F.count("*"), F.max("ts") - F.min("ts")
    return (
        units.withColumn("_gap", gap).groupBy(key).agg(
            n.alias("commit_count"), round2(F.sum(F.exp(-DECAY * days))).alias("recency_weighted_freq"), round2(n / F.greatest(span / (30 * 86400), F.lit(1.0))).alias("change_density"),
            round2(F.coalesce(F.stddev_pop("_gap"), F.lit(0.0))).alias("churn_volatility"), round0(100 * F.avg(F.col("is_fix").cast("double"))).cast("bigint").alias("bug_fix_rate"),
        )
    )


def authors(changes: DataFrame, key: str, author: str = "author") -> DataFrame:
    """(key, dominant author, share in per cent, top authors, number of authors)."""
    counts = changes.groupBy(key, author).agg(F.count("*").alias("n"), F.min(F.struct("ts", "id")).alias("first"))
    w = Window.partitionBy(key)
    placed = counts.withColumn("rank", F.row_number().over(w.orderBy(F.col("n").desc(), "first"))).withColumn("total", F.sum("n").over(w))
    top = F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= TOP_AUTHORS, F.struct("rank", F.col(author).alias("a"))))), lambda x: x["a"])
    return placed.groupBy(key).agg(F.max(F.when(F.col("rank") == 1, F.col(author))).alias("dominant_author"), F.max(F.when(F.col("rank") == 1, round0(100 * F.col("n") / F.col("total")))).cast("bigint").alias("dominant_pct"), top.alias("authors"), F.count("*").alias("contributors"))


def file_metrics(changes: DataFrame, as_of: int, lines: DataFrame | None = None, squash: bool = False, gap_minutes: float = SESSION_MINUTES) -> DataFrame:
    """All metrics of each file from its changes (file, id, author, ts, added, deleted, is_fix, body).

    With ``squash`` the counting metrics use sessions, the others commits.
    """
    units = changes
    if squash:
        units = sessions(changes, gap_minutes, ("file", "author"), True, "id").withColumn("id", F.concat_ws("#", "author", "session"))
    counted = _units(units.select("file", "id", "ts", "is_fix"), "file", as_of)
    plain = changes.groupBy("file").agg(
        F.max("ts").alias("last_modified_at"), F.min("ts").alias("first_created_at"), F.max_by("id", F.struct("ts", "id")).alias("last_commit"), age_days(F.lit(as_of), F.max("ts")).alias("age_days"),
        F.sum("added").alias("lines_added"), F.sum("deleted").alias("lines_deleted"), F.sort_array(F.array_distinct(F.flatten(F.collect_set(task_ids("body"))))).alias("task_ids"),
    )
    out = plain.join(counted, "file").join(authors(changes, "file"), "file")
    if lines is not None:
        out = out.join(lines.select("file", "lines"), "file", "left")
    size = F.greatest(F.coalesce("lines", F.lit(1)) if lines is not None else F.lit(1), F.lit(1))
    churn = F.col("lines_added") + F.col("lines_deleted")
    return out.withColumn("file_churn_count", churn).withColumn("relative_churn", round2(churn / size))


def chunk_metrics(touches: DataFrame, chunks: DataFrame, files: DataFrame, as_of: int, squash: bool = False, gap_minutes: float = SESSION_MINUTES) -> DataFrame:
    """Metrics of each chunk from its touches (chunk_id, id, author, ts, added, deleted, is_fix).

    chunks: chunk_id, file, lines; files: file, commit_count, contributors.  A chunk that
    was never touched has zeros and no age.  With ``squash`` the counting metrics, and the share of
    fixes with them, use sessions of an author instead of commits.
    """
    once = touches.groupBy("chunk_id", "id").agg(F.max("ts").alias("ts"), F.max("is_fix").alias("is_fix"), F.min("author").alias("author"), F.sum(F.col("added") + F.col("deleted")).alias("churn"))
    units = merged_sessions(once, gap_minutes).withColumn("id", F.concat_ws("#", "author", F.col("first_ts"))) if squash else once
    counted = _units(units.select("chunk_id", "id", "ts", "is_fix"), "chunk_id", as_of)
    plain = once.groupBy("chunk_id").agg(F.max("ts").alias("last_modified_at"), age_days(F.lit(as_of), F.max("ts")).alias("age_days"), F.sum("churn").alias("churn"), F.countDistinct("author").alias("chunk_authors"))
    f = files.select("file", F.col("commit_count").alias("file_commits"), F.col("contributors").alias("file_authors"))
    out = chunks.select("chunk_id", "file", "lines").join(plain, "chunk_id", "left").join(counted, "chunk_id", "left").join(f, "file", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    size = F.greatest("lines", F.lit(1)).cast("double")
    return out.select(
        "chunk_id", "file", zero("commit_count").alias("commit_count"), round2(zero("commit_count") / F.greatest(zero("file_commits"), F.lit(1))).alias("churn_ratio"), F.least(zero("chunk_authors"), zero("file_authors")).alias("recent_contributor_count"),
        zero("bug_fix_rate").alias("bug_fix_rate"), "age_days", "last_modified_at", round2(zero("churn") / size * (1 - F.exp(-size / 30))).alias("relative_churn"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("recency_weighted_freq", "change_density", "churn_volatility")],
    )


def blame(lines: DataFrame, key: str = "file", author: str = "author") -> DataFrame:
    """(key, dominant author, share, authors, contributors) by live lines; ties by name."""
    return _owned(lines.groupBy(key, author).agg(F.count("*").alias("n")), [key], author)


def _owned(counts: DataFrame, keys: list[str], author: str) -> DataFrame:
    """``blame`` from the number ``n`` of lines of each author."""
    w = Window.partitionBy(*keys)
    placed = counts.withColumn("rank", F.row_number().over(w.orderBy(F.col("n").desc(), author))).withColumn("total", F.sum("n").over(w))
    top = F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= TOP_AUTHORS, F.struct("rank", F.col(author).alias("a"))))), lambda x: x["a"])
    return placed.groupBy(*keys).agg(F.max(F.when(F.col("rank") == 1, F.col(author))).alias("blame_dominant_author"), F.max(F.when(F.col("rank") == 1, round0(100 * F.col("n") / F.col("total")))).cast("bigint").alias("blame_dominant_author_pct"), top.alias("blame_authors"), F.count("*").alias("blame_contributor_count"))


def chunk_blame(lines: DataFrame, chunks: DataFrame, author: str = "author") -> DataFrame:
    """Ownership of each chunk: live lines (file, line, author) within its range.

    Lines are counted by author once for each aligned block of lines, and a range adds up the
    blocks it is made of; chunks of one range take what was found for that range.
    """
    spans = ["file", "start_line", "end_line"]
    known = chunks.select("chunk_id", *spans).where("start_line <= end_line")
    known = written(known.withColumn("_k", F.count("*").over(Window.partitionBy("chunk_id"))), "chunks")
    parts = written(known.select(*spans).distinct().select("*", F.explode(blocks("start_line", "end_line")).alias("_at")).select(*spans, "_at.level", "_at.block"), "blocks")
    top = parts.agg(F.max("level")).first()[0] or 0
    counts = lines.groupBy("file", "line", author).agg(F.count("*").alias("n")).select("file", author, "n", F.explode(holders("line", top)).alias("_at"))
    counts = counts.groupBy("file", "_at.level", "_at.block", author).agg(F.sum("n").alias("n"))
    inside = written(parts.join(counts, ["file", "level", "block"]).groupBy(*spans, author).agg(F.sum("n").alias("n")), "inside")
    single = known.where("_k = 1").select("chunk_id", *spans).join(_owned(inside, spans, author), spans).drop(*spans)
    several = known.where("_k > 1").join(inside, spans).groupBy("chunk_id", author).agg(F.sum("n").alias("n"))
    return single.unionByName(_owned(several, ["chunk_id"], author))


#: Merges that a commit remembers to be reached from; two, as a commit may be the first parent of one.
WITNESSES = 2


def _walk_branches(start: DataFrame, parents: DataFrame, keep: int | None) -> DataFrame:
    """(main, sha) reached from the rows of ``start`` through ``parents`` without entering ``main``.

    With ``keep``, a commit that so many rows have reached hands no further ones on.
    """
    def first(rows: DataFrame, n: DataFrame | None = None) -> DataFrame:
        if keep is None:
            return rows
        taken = rows.withColumn("_n", F.row_number().over(Window.partitionBy("sha").orderBy("main")))
        if n is not None:
            taken = taken.join(n, "sha", "left").withColumn("_n", F.col("_n") + F.coalesce("_seen", F.lit(0)))
        return taken.where(F.col("_n") <= keep).select("main", "sha")

    frontier = seen = written(first(start.select("main", "sha").distinct()), "branch")
    while not frontier.isEmpty():
        steps = [frontier]
        for _ in range(STEPS):  # several generations in one job
            steps.append(steps[-1].join(parents, "sha").where("parent != main").select("main", F.col("parent").alias("sha")).distinct())
        met = reduce(DataFrame.unionByName, steps[1:]).distinct()
        frontier = written(first(met.join(seen, ["main", "sha"], "left_anti").select("main", "sha"), seen.groupBy("sha").agg(F.count("*").alias("_seen"))), "branch")
        seen = written(seen.unionByName(frontier), "branch", instead_of=seen if seen is not frontier else None)
    return seen


def fix_branch_commits(commits: DataFrame) -> DataFrame:
    """(sha): commits merged from bug-fix branches.

    From the second parent of such a merge through the parents, up to the first parent or
    a commit that is not known.  commits: sha, parents, body.

    A merge matters to a commit only by its first parent, where its walk ends.  So walks of many
    merges go on as those of two, and where they leave out a parent, the walks of all merges
    that lead there are made in full.
    """
    merge = subject("body").rlike(FIX_BRANCHES[0]) | subject("body").rlike(FIX_BRANCHES[1])
    tips = commits.where((F.size("parents") >= 2) & merge).select(F.element_at("parents", 1).alias("main"), F.element_at("parents", 2).alias("sha"))
    parents = commits.select("sha", F.explode_outer("parents").alias("parent"))
    known = commits.select("sha")
    tips = written(tips.where("sha != main").join(known, "sha", "left_semi").select("main", "sha").distinct(), "tips")
    parents = written(parents.where("parent IS NOT NULL").join(known.select(F.col("sha").alias("parent")), "parent", "left_semi").select("sha", "parent").distinct(), "parents")
    reached = written(_walk_branches(tips, parents, WITNESSES).select("sha").distinct(), "reached")
    left = parents.join(reached, "sha", "left_semi").join(reached.select(F.col("sha").alias("parent")), "parent", "left_anti").select("sha", "parent")
    left = written(left, "left")
    if left.isEmpty():
        return reached
    # what lies behind a parent left out, and what leads to it: all that a walk that adds a commit can pass
    nowhere = F.lit("").alias("main")
    behind = _walk_branches(left.select(nowhere, F.col("parent").alias("sha")), parents, 1).select("sha").join(reached, "sha", "left_anti")
    inside = written(reached.unionByName(behind), "inside")
    on = parents.join(inside, "sha", "left_semi").join(inside.select(F.col("sha").alias("parent")), "parent", "left_semi")
    back = written(on.select(F.col("parent").alias("sha"), F.col("sha").alias("parent")), "back")
    leads = written(_walk_branches(left.select(nowhere, F.col("parent").alias("sha")), back, 1).select("sha").unionByName(inside.join(reached, "sha", "left_anti")).distinct(), "leads")
    some = written(parents.join(leads, "sha", "left_semi").join(leads.select(F.col("sha").alias("parent")), "parent", "left_semi").select("sha", "parent"), "some")
    whole = _walk_branches(tips.join(leads, "sha", "left_semi"), some, None)
    return reached.unionByName(whole.select("sha")).distinct()


def with_fix(commits: DataFrame) -> DataFrame:
    """Commits with ``is_fix``: by message, or as part of a bug-fix branch."""
    branch = fix_branch_commits(commits).withColumn("_branch", F.lit(True))
    return commits.join(branch, "sha", "left").withColumn("is_fix", F.coalesce("_branch", F.lit(False)) | is_fix("body")).drop("_branch")


def shift(ranges: Iterable[list[int]], hunks: Iterable[tuple[int, int, int]]) -> None:
    """Ranges [start, end] moved back over a commit's hunks (old lines, new start, new lines), in place.

    From the last hunk to the first: a range wholly below a hunk moves by its change in
    length, one that holds the whole hunk shrinks or grows by it, others stay.  In the end
    no range begins before line 1 or ends before it begins.
    """
    ranges = list(ranges)
    for old_lines, start, new_lines in sorted(hunks, key=lambda h: -h[1]):
        delta, last = new_lines - old_lines, start + max(new_lines - 1, 0)
        for r in ranges if delta else ():
            if r[0] > last:
                r[0] -= delta
                r[1] -= delta
            elif start >= r[0] and last <= r[1]:
                r[1] -= delta
    for r in ranges:
        r[0] = max(r[0], 1)
        r[1] = max(r[1], r[0])


#: Hunks of one file that a task walks, and chunks that it walks them for.
WALK_HUNKS, WALK_CHUNKS = 50_000, 256
#: Stretches that all hunks are cut into at most, and so rounds; beyond that stretches grow with the table.
STRETCHES = 128
_WALKED = "file string, chunk_id string, id string, author string, ts bigint, is_fix boolean, added bigint, deleted bigint, start_line bigint, end_line bigint"


def _walk(key: tuple, hunks: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
    """Touches of some chunks by a stretch of one file's commits, newest first.

    The rows without an id are the ranges as they stood before the oldest of these commits.
    """
    names = [c.split()[0] for c in _WALKED.split(", ")]
    if not len(chunks):
        return pd.DataFrame([], columns=names)
    ids, met = chunks["chunk_id"].tolist(), []
    ranges = [list(r) for r in zip(chunks["start_line"].tolist(), chunks["end_line"].tolist(), strict=True)]
    placed = list(zip(ids, ranges, strict=True))
    ordered = hunks.sort_values(["ts", "id", "new_start", "old_start", "new_lines", "old_lines"], ascending=[False, True, True, True, True, True], kind="stable")
    rows = zip(*[ordered[c].tolist() for c in ("ts", "id", "author", "is_fix", "new_start", "old_lines", "new_lines")], strict=True)
    # few chunks and millions of hunks: plain numbers are quicker than arrays of few entries
    for (ts, sha), part in groupby(rows, key=lambda r: r[:2]):
        moves = []
        for _, _, author, fix, first, old, new in part:
            last = first + new - 1 if new > 1 else first
            for name, (start, end) in placed:
                if first <= end and last >= start:
                    lines = min(last, end) - max(first, start) + 1
                    met.append((key[0], name, sha, author, ts, fix, lines, math.floor(old * lines / new + 0.5) if new > 0 else 0, None, None))
            moves.append((old, first, new))
        shift(ranges, moves)
    kept = [(key[0], c, None, None, None, None, None, None, a, b) for c, (a, b) in placed]
    return pd.DataFrame(met + kept, columns=names)


def walk_hunks(hunks: DataFrame, chunks: DataFrame, block: int = WALK_HUNKS, together: int = WALK_CHUNKS) -> DataFrame:
    """Touches of chunks by hunks, walking each file's commits from newest to oldest.

    A chunk's range is where it stands now; going back over a commit moves it as ``shift``
    does.  hunks: file, id, author, ts, is_fix, old_start, old_lines, new_start, new_lines;
    chunks: file, chunk_id, start_line, end_line.  The result has one row per chunk and hunk
    that meets it: lines added are those of the hunk inside the chunk, lines deleted its share
    of the old ones.

    Where a chunk stands depends on every newer commit of its file, and on nothing of other
    chunks.  So all hunks are dealt by ranges of (file, time, commit), which cuts the history
    of a busy file into stretches of some ``block`` hunks; round k walks the k-th stretch of
    every file, ``together`` chunks to a task, and hands on where the chunks stood before it.
    A file whose commits fit one stretch is done in the first round, later rounds read only
    stretches of the busy ones.  A commit is never cut.  A round costs a few jobs however few hunks it
    walks, so there are ``STRETCHES`` of them at most: a file of a twentieth of all hunks takes seven or eight,
    whatever the size of the table.
    """
    spark = hunks.sparkSession
    rows = hunks.select("file", F.col("id").cast("string").alias("id"), "author", F.col("ts").cast("bigint").alias("ts"), "is_fix", *[F.col(c).cast("bigint").alias(c) for c in ("old_start", "old_lines", "new_start", "new_lines")]).where("file IS NOT NULL")
    n = min(max(1, -(-rows.count() // block)), STRETCHES)
    dealt = written(rows.repartitionByRange(n, "file", F.col("ts").desc(), "id").withColumn("part", F.spark_partition_id()), "dealt")
    parts = dealt.groupBy("file").agg(F.min("part").alias("first"), F.max("part").alias("last"))
    busy = written(parts.where("first < last"), "busy")  # at most one file for each border of stretches
    placed = dealt.join(busy.drop("last"), "file", "left").withColumn("k", F.coalesce(F.col("part") - F.col("first"), F.lit(0))).drop("part", "first")
    placed = written(placed, "stretches", by=["k"])
    discard(dealt)
    rounds = busy.agg(F.max(F.col("last") - F.col("first"))).first()[0] or 0

    stand = chunks.select("file", F.col("chunk_id").cast("string").alias("chunk_id"), F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))
    groups = stand.groupBy("file").agg(F.ceil(F.count("*") / together).alias("groups"))
    stand = stand.join(groups, "file").withColumn("group", F.pmod(F.xxhash64("chunk_id"), "groups"))
    groups = written(stand.select("file", "group").distinct(), "groups")
    stand = written(stand.drop("groups"), "standing")
    touches = []
    for k in range(rounds + 1):
        now = placed.where(F.col("k") == k).drop("k").join(groups, "file")
        ranges = stand if k == 0 else stand.join(busy.where(F.col("last") - F.col("first") >= k), "file", "left_semi")
        met = written(now.groupBy("file", "group").cogroup(ranges.groupBy("file", "group")).applyInPandas(lambda key, a, b: _walk(key, a, b).assign(group=key[1]), _WALKED + ", group bigint"), "walked")
        touches.append(met.where("id IS NOT NULL").drop("start_line", "end_line", "group"))
        stand = met.where("id IS NULL").select("file", "chunk_id", "start_line", "end_line", "group")
    return reduce(DataFrame.unionByName, touches)


def diff_hunks(versions: DataFrame, max_lines: int = 10_000) -> DataFrame:
    """(file, id, old_start, old_lines, new_start, new_lines) of old and new texts.

    A first version has no hunks, and texts over ``max_lines`` lines are not compared,
    which is the operator's rule for generated files.  versions: file, id, old, new.
    """
    import difflib

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            out = []
            for r in df.itertuples():
                if r.old is None or r.new is None:
                    continue
                a, b = r.old.splitlines(), r.new.splitlines()
                if max(len(a), len(b)) <= max_lines:
                    out += [(r.file, r.id, i + 1, j - i, k + 1, m - k) for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag != "equal"]
            yield pd.DataFrame(out, columns=["file", "id", "old_start", "old_lines", "new_start", "new_lines"])

    return versions.select("file", F.col("id").cast("string").alias("id"), "old", "new").mapInPandas(run, "file string, id string, old_start bigint, old_lines bigint, new_start bigint, new_lines bigint")
