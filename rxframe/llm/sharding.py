"""Shards of near equal bytes by Karmarkar-Karp differencing of indivisible groups.

Groups (here: rows with equal texts) must not be split.  Differencing keeps a
heap of partial partitions, each a row of ``k`` sums; the two with the largest
spread are combined, the heaviest part of one with the lightest of the other,
until one is left.

Spark shape: rows are pre-aggregated to one item per group, so a group of copies
of any size is one item.  Items are dealt by hash to buckets of about
``bucket_items``; each bucket is differenced in its own task to one partial
partition of ``k`` sums; these are the items of the next level, combined by the
same rule, until one bucket is left (``log(n) / log(bucket_items)`` levels).  The
choices are then carried down by joins.  No task holds more than a bucket.

Defined results: null and empty texts are one group of size 1 a row.  An input
without rows gives no rows.  Equal ids and equal rows are rows of their own with
slots of their own.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxframe.session import materialize, ship_package

BUCKET_ITEMS = 20_000


def difference(items: list[tuple[object, list[int]]], k: int) -> tuple[list[int], dict]:
    """Differencing of ``(key, sums)`` items, sums in falling order.

    Returns the final ``k`` sums, falling, and per key the place of each of its
    parts among them.  Ties go by the order of the items.
    """
    heap, nodes = [], []
    for key, sums in items:
        sums = list(sums) + [0] * (k - len(sums))
        nodes.append((key, None, None, None))
        heap.append((sums[-1] - sums[0], len(nodes) - 1, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        raw = [p + q for p, q in zip(x, reversed(y))]
        order = sorted(range(k), key=raw.__getitem__, reverse=True)
        sums = [raw[j] for j in order]
        nodes.append((None, a, b, order))
        heapq.heappush(heap, (sums[-1] - sums[0], len(nodes) - 1, sums))
    if not heap:
        return [0] * k, {}
    places, out = {heap[0][1]: list(range(k))}, {}
    for at in range(len(nodes) - 1, -1, -1):
        key, a, b, order = nodes[at]
        mine = places.pop(at)
        if order is None:
            out[key] = mine
            continue
        where = [0] * k
        for place, j in zip(mine, order):
            where[j] = place
        places[a], places[b] = where, where[::-1]
    return heap[0][2], out


def _level(items: DataFrame, k: int, buckets: int, level: int) -> DataFrame:
    """(key, sums) -> per item (bucket, key, places) and per bucket (bucket, sums)."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(group["key"], group["sums"]), key=lambda r: r[0])
        sums, places = difference([(key, [int(v) for v in s]) for key, s in rows], k)
        bucket = group["bucket"].iloc[0]
        out = [(bucket, key, places[key], None) for key, _ in rows] + [(bucket, None, None, sums)]
        return pd.DataFrame(out, columns=["bucket", "key", "places", "sums"])

    bucket = F.format_string(f"{level}-%d", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return materialize(items.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(
        run, "bucket string, key string, places array<int>, sums array<bigint>"), "kk-level")


def partition_groups(groups: DataFrame, k: int, bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """(``key`` string, ``size`` long), one row per group -> ``key``, ``shard``."""
    ship_package(groups.sparkSession)
    items = groups.select("key", F.array("size").alias("sums"))
    count, levels = groups.count(), []
    while True:
        buckets = max(1, math.ceil(count / bucket_items))
        levels.append(_level(items, k, buckets, len(levels)))
        if buckets == 1:
            break
        items = levels[-1].where("sums is not null").select(F.col("bucket").alias("key"), "sums")
        count = buckets
    # from the top: the last bucket's places are the shards themselves
    down = levels.pop().where("key is not null").select("key", F.col("places").alias("shards"))
    while levels:
        here = levels.pop().where("key is not null").select("bucket", "key", "places")
        down = here.join(down.withColumnRenamed("key", "bucket"), "bucket") \
            .select("key", F.transform("places", lambda p: F.get(F.col("shards"), p)).alias("shards"))
    return down.select("key", F.get("shards", F.lit(0)).alias("shard"))


def shard_table(docs: DataFrame, k: int = 8, id_col: str = "doc_id", text_col: str = "text",
                bucket_items: int = BUCKET_ITEMS, slot_rows: int = 100_000) -> DataFrame:
    """One row per document: id, ``size`` (UTF-8 bytes plus 1), ``text_crc32``,
    ``law``, ``shard``, ``slot`` (0, 1, ... in each shard), ``grown_shard`` (null:
    this law balances bytes, it does not keep rows in place when shards are added).

    Slots are prefix sums: row counts per (shard, hash of the row) give offsets,
    and only rows of one such bucket are numbered together.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = materialize(docs.select(
        F.col(f"`{id_col}`").alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.md5(text).alias("key")), "shard-rows")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "shard-groups")
    n = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    d = rows.join(partition_groups(groups.select("key", "size"), k, bucket_items), "key")
    d = materialize(d.withColumn("_b", F.pmod(F.xxhash64("_id", "key"), F.lit(max(1, n // slot_rows)))), "shard-placed")
    offsets = d.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select("shard", "_b", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_b"))
                                             - F.col("_n")).alias("_off"))
    number = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_id", "key", "size"))
    d = d.withColumn("_k", number).join(offsets, ["shard", "_b"])
    return d.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("_off") + F.col("_k") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"))
