"""Keyed machines over event time: the same result for a table and for a stream of it.

A machine takes the rows of one key in order of time and sets deadlines of its own.  Rows reach a
stream in any order within the watermark's delay, so they are kept until the watermark has passed them,
and only then handed on in order; a deadline fires once the watermark has passed it.  How the
rows were cut into micro-batches therefore makes no difference, nor does a restart from the
checkpoint.  For a table the last watermark is known from the start: its latest time less the delay.

``Accumulator`` gathers rows into batches by size and time; ``Quarantine`` keeps failing rows apart and
replays them after rising delays.  Times are milliseconds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import fresh_path

#: Groups that a stream deals its keys to, by hash.
LANES = 1024


@dataclass(frozen=True)
class Accumulator:
    """Batches of ``size`` rows, or of what there is when time is up.

    The clock starts with a batch's first row.  When it runs out on fewer than ``least`` rows the batch
    waits half as long again, ``defers`` times at most, before it goes as it is.
    """

    size: int
    timeout: int
    least: int | None = None
    defers: int = 3
    output = "seq bigint, n int, first_id bigint, last_id bigint, at bigint, reason string"

    def start(self) -> dict:
        return {"ids": [], "due": None, "deferred": 0, "seq": 0}

    def _flush(self, s: dict, at: int, reason: str) -> tuple:
        s["seq"] += 1
        out = (s["seq"], len(s["ids"]), s["ids"][0], s["ids"][-1], at, reason)
        s.update(ids=[], due=None, deferred=0)
        return out

    def fire(self, s: dict) -> list[tuple]:
        least = self.size // 2 if self.least is None else self.least
        if len(s["ids"]) < least and s["deferred"] < self.defers:
            s["deferred"] += 1
            s["due"] += self.timeout // 2
            return []
        return [self._flush(s, s["due"], "time")]

    def take(self, s: dict, at: int, row_id: int, kind: str) -> list[tuple]:
        s["ids"].append(row_id)
        if len(s["ids"]) >= self.size:
            return [self._flush(s, at, "size")]
        if s["due"] is None:
            s["due"] = at + self.timeout
        return []


@dataclass(frozen=True)
class Quarantine:
    """A log of failures, replays and recoveries of each key.

    A failure is due for another try after ``delay`` times 2 for each failure before it in a row, at most
    ``longest``; a change is tried at once; success clears the key.  ``kinds`` maps the kinds of
    rows to "failed", "changed" or "ok"; others count as ok.
    """

    delay: int
    longest: int
    failed: tuple[str, ...] = ("error",)
    changed: tuple[str, ...] = ()
    output = "seq bigint, what string, at bigint, attempts int, first_failed bigint, last_failed bigint, due bigint, last_id bigint"

    def start(self) -> dict:
        return {"seq": 0, "attempts": 0, "first": None, "last": None, "due": None, "id": None}

    def _row(self, s: dict, what: str, at: int) -> tuple:
        s["seq"] += 1
        return (s["seq"], what, at, s["attempts"], s["first"], s["last"], s["due"], s["id"])

    def fire(self, s: dict) -> list[tuple]:
        at, s["due"] = s["due"], None
        return [self._row(s, "due", at)]

    def take(self, s: dict, at: int, row_id: int, kind: str) -> list[tuple]:
        if kind in self.failed:
            s["attempts"] += 1
            s.update(first=at if s["attempts"] == 1 else s["first"], last=at, id=row_id, due=at + min(self.delay * 2 ** min(s["attempts"] - 1, 40), self.longest))
            return [self._row(s, "failed", at)]
        if not s["attempts"]:
            return []
        s["due"] = None
        if kind in self.changed:
            return [self._row(s, "changed", at)]
        out = [self._row(s, "cleared", at)]
        s.update(self.start() | {"seq": s["seq"]})
        return out


Machine = Accumulator | Quarantine


def _until(m: Machine, s: dict, t: int) -> list[tuple]:
    """What fires up to a time, the time itself included."""
    out = []
    while s["due"] is not None and s["due"] <= t:
        out += m.fire(s)
    return out


def _rows(events: DataFrame, key: str, time: str, id_col: str, kind: str | None, shards: int) -> DataFrame:
    """(key, shard, at, row_id, kind, ts): what machines see."""
    shard = F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int") if shards > 1 else F.lit(0)
    stamp = F.col(time).cast("timestamp")
    return events.where(F.col(time).isNotNull()).select(
        F.col(key).alias("key"), shard.alias("shard"), F.unix_millis(stamp).alias("at"), F.col(id_col).cast("bigint").alias("row_id"), (F.col(kind) if kind else F.lit("")).alias("kind"), stamp.alias("ts")
    )


def batch(events: DataFrame, machine: Machine, key: str, time: str = "ts", id_col: str = "event_id", kind: str | None = None, delay: int = 0, shards: int = 1) -> DataFrame:
    """A machine's output over a whole table: key, shard and the machine's columns.

    Each key's rows pass by in order, sorted by Spark; a task holds a machine's state and no group.
    ``shards`` splits every key by the rows' ids, for machines whose keys may be hot.
    """
    rows = _rows(events, key, time, id_col, kind, shards).drop("ts")
    last = rows.agg(F.max("at")).first()[0]
    horizon = (last if last is not None else 0) - delay
    type_ = rows.schema["key"].dataType.simpleString()
    names = ["key", "shard", *[c.split()[0] for c in machine.output.split(", ")]]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, machine.start(), []

        def emit(made: list[tuple]) -> None:
            out.extend((*now, *row) for row in made)

        for df in parts:
            for r in df.itertuples(index=False):
                mine = (r.key if not pd.isna(r.key) else None, r.shard)
                if mine != now:
                    if now is not None:
                        emit(_until(machine, state, horizon - 1))
                    now, state = mine, machine.start()
                emit(_until(machine, state, r.at))
                emit(machine.take(state, r.at, int(r.row_id), r.kind))
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if now is not None:
            emit(_until(machine, state, horizon - 1))
        if out:
            yield pd.DataFrame(out, columns=names)

    dealt = rows.where(F.col("at") < horizon).repartition("key", "shard").sortWithinPartitions("key", "shard", "at", "row_id")
    return dealt.mapInPandas(run, f"key {type_}, shard int, {machine.output}")


def _texts(type_: str) -> tuple[Column, Column]:
    """A key's column as a string, and back."""
    if type_ in ("string", "tinyint", "smallint", "int", "bigint", "boolean", "date", "timestamp_ntz") or type_.startswith("decimal"):
        return F.col("key").cast("string"), F.col("key").cast(type_)
    if type_ == "timestamp":
        return F.unix_micros("key").cast("string"), F.timestamp_micros(F.col("key").cast("bigint"))
    if type_ in ("float", "double"):
        return (F.col("key") + F.lit(0).cast(type_)).cast("string"), F.col("key").cast(type_)  # one zero
    if type_ == "binary":
        return F.base64("key"), F.unbase64("key")
    raise ValueError(f"no stream is keyed by {type_}")


def stream(events: DataFrame, machine: Machine, key: str, time: str = "ts", id_col: str = "event_id", kind: str | None = None, delay: int = 0, shards: int = 1, lanes: int = LANES) -> DataFrame:
    """The same over a stream, to be written in append mode.

    The state of a key is the machine's and the rows that the watermark has not passed yet.  A call of
    Python costs milliseconds whatever it holds, so keys share a lane: its state is one of Spark's, its
    keys do not meet.  More keys want more lanes; a checkpoint keeps the number it was made with.
    """
    rows = _rows(events, key, time, id_col, kind, shards).withWatermark("ts", f"{delay} milliseconds")
    type_ = rows.schema["key"].dataType.simpleString()
    names = ["key", "shard", *[c.split()[0] for c in machine.output.split(", ")]]
    text, back = _texts(type_)

    def advance(_: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        held = {(k, shard): (state, waiting) for k, shard, state, waiting in json.loads(group.get[0])} if group.exists else {}
        if not group.hasTimedOut:
            for df in parts:
                for k, shard, *row in zip(*[df[c].tolist() for c in ("key", "shard", "at", "row_id", "kind")], strict=True):
                    if (k, shard) not in held:
                        held[k, shard] = (machine.start(), [])
                    held[k, shard][1].append(row)
        mark, out, kept, wake = group.getCurrentWatermarkMs(), [], [], []
        for mine, (state, waiting) in held.items():
            waiting.sort(key=lambda r: (r[0], r[1]))
            made, done = [], 0
            for at, row_id, what in waiting:
                if at >= mark:
                    break
                made += _until(machine, state, at)
                made += machine.take(state, at, row_id, what)
                done += 1
            made += _until(machine, state, mark - 1)
            out += [(*mine, *row) for row in made]
            kept.append((*mine, state, waiting[done:]))
            wake += [t for t in (state["due"], waiting[done][0] if done < len(waiting) else None) if t is not None]
        group.update((json.dumps(kept),))
        if wake:
            group.setTimeoutTimestamp(max(min(wake), mark) + 1)
        if out:
            yield pd.DataFrame(out, columns=names)

    lane = F.pmod(F.xxhash64("key", "shard"), F.lit(lanes)).cast("int")
    dealt = rows.withColumn("key", text).withColumn("lane", lane)
    made = dealt.groupBy("lane").applyInPandasWithState(advance, f"key string, shard int, {machine.output}", "state string", "append", GroupStateTimeout.EventTimeTimeout)
    return made.withColumn("key", back)


def follow(df: DataFrame, folder: str, checkpoint: str, once: bool = True):
    """Append a machine's stream to a folder; with ``once``, what is there now."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def drained(events: DataFrame, machine: Machine, key: str, **options) -> DataFrame:
    """Run a machine over all that a stream has now, and read what it has written."""
    spark = events.sparkSession
    folder, checkpoint = fresh_path(spark, "stream"), fresh_path(spark, "stream-checkpoint")
    made = stream(events, machine, key, **options)
    follow(made, folder, checkpoint).awaitTermination()
    return spark.read.schema(made.schema).parquet(folder)


def quarantined(log: DataFrame) -> DataFrame:
    """The entries of a quarantine from its log: keys whose latest row is not a recovery."""
    last = log.groupBy("key").agg(F.max_by(F.struct("what", "attempts", "first_failed", "last_failed", "due", "last_id"), "seq").alias("x"))
    return last.select("key", "x.*").where("what != 'cleared'")
