"""Sharding by fixed virtual slots.

Every record belongs to one of some thousands of virtual slots by the hash of its key. Bytes are summed per slot, and a
versioned map says which shard holds each slot: version 1 deals slots out in turn, and each later version is an edit that
moves a few slots. Rebalancing moves whole slots from shards above the mean to shards below it until sizes are near equal;
growing moves slots to the new shard only. The map has one row per slot whatever the input, so it is edited on the driver
and stored as a small table; records are never looked at again.

Defined results: a null text has no bytes; a null key is replaced by the text's hash, so that such rows spread over the
slots too. Repeated rows get one slot and neighbouring positions. An empty table gives no rows (and a map all the same).
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOTS = 16384


def with_slot(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """The key, ``size`` (bytes of the text plus 8), ``text_crc32`` and ``vslot``."""
    code = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    lead = F.xxhash64(F.lit("slot"), F.col(key), F.when(F.col(key).isNull(), F.col(text)))
    return df.select(
        F.col(key),
        (F.octet_length(code).cast("long") + 8).alias("size"),
        F.crc32(code).alias("text_crc32"),
        F.pmod(lead, F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_bytes(slotted: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that has any: at most as many entries as there are slots."""
    rows = slotted.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    return {r["vslot"]: (r["bytes"], r["rows"]) for r in rows}


def first_map(slots: int, shards: int) -> list[int]:
    """Version 1: slot to shard, in turn."""
    return [slot % shards for slot in range(slots)]


def rebalance(old: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """The next version: slots leave shards above the mean, largest first as far as they fit, for the emptiest shards."""
    new, load = list(old), [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(old):
        load[shard] += sizes.get(slot, 0)
        if sizes.get(slot, 0):
            held[shard].append((sizes[slot], slot))
    mean, moved = sum(load) / shards, []
    for shard in range(shards):
        for size, slot in sorted(held[shard], reverse=True):
            if load[shard] - size >= mean:
                load[shard] -= size
                moved.append((size, slot))
        # one more slot, the smallest, so that the shard can be filled up to the mean exactly by small ones
        if load[shard] > mean and held[shard]:
            left = [x for x in held[shard] if x not in set(moved)]
            if left:
                size, slot = min(left)
                load[shard] -= size
                moved.append((size, slot))
    heap = [(load[shard], shard) for shard in range(shards)]
    heapq.heapify(heap)
    for size, slot in sorted(moved, key=lambda x: (-x[0], x[1])):
        used, shard = heapq.heappop(heap)
        new[slot] = shard
        heapq.heappush(heap, (used + size, shard))
    return new


def grow(old: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """The next version with shard number ``shards`` added: it takes slots from the fullest shards, no other slot moves."""
    new, load = list(old), [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(old):
        load[shard] += sizes.get(slot, 0)
        held[shard].append((sizes.get(slot, 0), slot))
    goal, taken = sum(load) / (shards + 1), 0
    for x in held:
        x.sort()
    while True:
        full = max(range(shards), key=load.__getitem__)
        if not held[full] or taken + held[full][-1][0] > goal or load[full] <= goal:
            return new
        size, slot = held[full].pop()
        if not size:
            return new
        new[slot], taken, load[full] = shards, taken + size, load[full] - size


def map_table(spark: SparkSession, versions: list[list[int]], counts: dict[int, tuple[int, int]]) -> DataFrame:
    """All versions of the map as rows (version, vslot, shard) with the bytes and rows that the edit was based on."""
    rows = [(v + 1, slot, shard, *counts.get(slot, (0, 0))) for v, m in enumerate(versions) for slot, shard in enumerate(m)]
    return spark.createDataFrame(rows, "version int, vslot int, shard int, bytes long, rows long")


def shard(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """Place every row: key, size, text_crc32, vslot, shard, and slot, its gapless position in the shard.

    ``store``: folder for the versioned map. One shuffle, of narrow rows by virtual slot; positions are a rank in the
    virtual slot behind the rows of the shard's earlier slots.
    """
    spark = df.sparkSession
    slotted = with_slot(df, key, text, slots)
    counts = slot_bytes(slotted)
    versions = [first_map(slots, shards)]
    versions.append(rebalance(versions[0], {k: v[0] for k, v in counts.items()}, shards))
    if store:
        map_table(spark, versions, counts).coalesce(1).write.mode("overwrite").parquet(store)
    before, places = [0] * shards, []
    for slot, place in enumerate(versions[-1]):
        if slot in counts:
            places.append((slot, place, before[place]))
            before[place] += counts[slot][1]
    # One row for each slot, some hundred KB: bounded by the number of slots.
    lookup = spark.createDataFrame(places, "vslot int, shard int, before long")
    ranked = slotted.withColumn("__at", F.row_number().over(W.partitionBy("vslot").orderBy(key, "text_crc32", "size")))
    return ranked.join(F.broadcast(lookup), "vslot").select(
        key, "size", "text_crc32", "vslot", "shard", (F.col("before") + F.col("__at") - 1).alias("slot")
    )
