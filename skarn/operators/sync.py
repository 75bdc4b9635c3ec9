"""Snapshots, change detection, sharding and repair."""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ring_position
from ..storage import written

VIRTUAL_NODES = 150
SAME_SECONDS = 1.0


def diff(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """(key, change): added, modified, deleted or unchanged, by digest."""
    a = old.select(key, F.col(digest).alias("_old"), F.lit(1).alias("_in_old"))
    b = new.select(key, F.col(digest).alias("_new"), F.lit(1).alias("_in_new"))
    c = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("modified")
    return a.join(b, key, "full").select(key, c.alias("change"))


def detect(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change, hash): files of equal size and time keep their hash, others take the new one.

    previous: path, mtime, size, hash; current: path, mtime, size, content.  Only content
    of files that may have changed is hashed.
    """
    p = previous.select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), F.col("hash").alias("_hash"))
    same = (F.abs(F.col("mtime") - F.col("_mtime")) <= SAME_SECONDS) & (F.col("size") == F.col("_size"))
    digest = F.when(F.coalesce(same, F.lit(False)), F.col("_hash")).otherwise(F.sha2(F.col("content").cast("binary"), 256))
    out = current.join(p, "path", "full").withColumn("hash", digest)
    change = F.when(F.col("size").isNull(), "deleted").when(F.col("_hash").isNull(), "added").when(F.col("hash") == F.col("_hash"), "unchanged").otherwise("modified")
    return out.select("path", change.alias("change"), F.when(F.col("size").isNotNull(), F.col("hash")).alias("hash"))


def ignore_changes(changes: DataFrame, ignored_before: Column, ignored_now: Column) -> DataFrame:
    """Deletions that are newly ignored files, and additions that are no longer ignored."""
    kind = F.when((F.col("change") == "deleted") & ignored_now & ~ignored_before, "newly_ignored").when((F.col("change") == "added") & ignored_before & ~ignored_now, "newly_unignored").otherwise(F.col("change"))
    return changes.withColumn("change", kind)


def merkle_root(snapshot: DataFrame, key: str = "path", digest: str = "hash") -> str:
    """The root over leaves sha256(path:hash) in order of path; an odd last node pairs with itself.

    Levels are halved in Spark, written one after another, until few enough are left.
    """
    leaf = F.sha2(F.concat_ws(":", key, digest), 256)
    placed = snapshot.select(F.col(key).alias("i"), leaf.alias("h"))
    # positions without one task for all rows: count rows by range partition first
    parts = placed.repartitionByRange("i").withColumn("p", F.spark_partition_id())
    parts = written(parts, "merkle")
    before = {r.p: r.n for r in parts.groupBy("p").agg(F.count("*").alias("n")).collect()}  # a row per partition
    offset, run = {}, 0
    for p in sorted(before):
        offset[p], run = run, run + before[p]
    if not run:
        return hashlib.sha256(b"").hexdigest()
    start = F.create_map(*[x for p, o in offset.items() for x in (F.lit(p), F.lit(o))])
    level = parts.select((start[F.col("p")] + F.row_number().over(Window.partitionBy("p").orderBy("i")) - 1).alias("i"), "h")
    while run > 4096:
        pair = level.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("h"))).alias("a"), F.max(F.when(F.col("i") % 2 == 1, F.col("h"))).alias("b"))
        level = written(pair.select("i", F.sha2(F.concat("a", F.coalesce("b", "a")), 256).alias("h")), "merkle")
        run = -(-run // 2)
    nodes = [r.h for r in level.orderBy("i").collect()]  # 4096 rows at most
    while len(nodes) > 1:
        nodes = [hashlib.sha256((nodes[k] + (nodes[k + 1] if k + 1 < len(nodes) else nodes[k])).encode()).hexdigest() for k in range(0, len(nodes), 2)]
    return nodes[0]


def ring(shards: list[str], virtual: int = VIRTUAL_NODES) -> list[tuple[int, str]]:
    """(position, shard) of all virtual nodes in order."""
    at = lambda k: int.from_bytes(hashlib.md5(k.encode()).digest()[:4], "big")
    return sorted((at(f"{s}:{v}"), s) for s in shards for v in range(virtual))


def shard(column: str, shards: list[str], virtual: int = VIRTUAL_NODES) -> Column:
    """The shard of a key: the first node at or after its position, around the ring.

    The ring is a literal: the nodes by the upper bits of their position, each slice with
    the first node after it, so a row looks at a few nodes.  Its size is that of the shards.
    """
    nodes = ring(shards, virtual)
    bits = 32 - max(len(nodes).bit_length(), 1)
    slices, k = [], 0
    for b in range(1 << (32 - bits)):
        while k < len(nodes) and nodes[k][0] < b << bits:
            k += 1
        last = next((j for j in range(k, len(nodes)) if nodes[j][0] >= (b + 1) << bits), None)
        own = nodes[k : len(nodes) if last is None else last + 1]
        slices.append(own if last is not None else [*own, (1 << 32, nodes[0][1])])
    table = F.expr("array(" + ", ".join("array(" + ", ".join(f"named_struct('p', {p}L, 's', '{s}')" for p, s in own) + ")" for own in slices) + ")")
    at = ring_position(column)
    near = F.element_at(table, F.shiftright(at, bits).cast("int") + 1)
    return F.element_at(F.filter(near, lambda n: n["p"] >= at), 1)["s"]


def shard_of(key: str, shards: list[str], virtual: int = VIRTUAL_NODES) -> str:
    nodes = ring(shards, virtual)
    at = int.from_bytes(hashlib.md5(key.encode()).digest()[:4], "big")
    return nodes[bisect.bisect_left([p for p, _ in nodes], at) % len(nodes)][1]


def repair(eligible: DataFrame, persisted: DataFrame, force: bool = False, key: str = "path", digest: str = "hash") -> DataFrame:
    """(key, action): repair what is missing or differs (or all), drop what is no longer eligible."""
    a = eligible.select(key, F.col(digest).alias("_want"), F.lit(1).alias("_e"))
    b = persisted.select(key, F.col(digest).alias("_have"), F.lit(1).alias("_p"))
    action = F.when(F.col("_e").isNull(), "orphan").when(F.lit(force) | F.col("_p").isNull() | ~F.col("_want").eqNullSafe(F.col("_have")) | F.col("_have").isNull(), "repair")
    return a.join(b, key, "full").select(key, action.alias("action")).where("action IS NOT NULL")


def retry(failures: DataFrame, changed: DataFrame, now: int, key: str = "path") -> DataFrame:
    """Quarantined files to try again: changed since, or due."""
    c = changed.select(key).distinct().withColumn("_changed", F.lit(True))
    return failures.join(c, key, "left").where(F.coalesce("_changed", F.lit(False)) | (F.col("next_retry") <= now)).drop("_changed")


def unenriched(points: DataFrame, marker: str) -> DataFrame:
    """Points that lack an enrichment's marker."""
    return points.where(F.col(marker).isNull())
