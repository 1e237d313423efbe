"""Sharding over fixed virtual slots.

Every record falls into one of thousands of virtual slots by a hash. Bytes and rows are
summed per slot, and a table with a version number says which shard holds which slot. To
rebalance, or to add a shard, the table is edited and the records of the moved slots move;
the hash of no record changes. The table has as many rows as there are slots, a fixed
number, so it may pass through the driver.

Defined results: a null text counts as empty; null ids and repeated rows are records like
any other; an empty input gives no rows; columns other than ``doc_id`` and ``text`` are
ignored. Ties between slots go to the lower slot, between shards to the lower shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notewell.llm.tables import keyed_texts, settle

SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int, n_bytes long, n_rows long"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes plus 1), ``text_crc32`` and ``virtual_slot``.

    The slot follows from id, text checksum and a row's number among its repeats in one input
    partition. So rows with the same or no id spread, repeats of one row spread too, and the slot of a row
    that occurs once depends on the row alone.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    out = keyed_texts(docs).select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    repeats = Window.partitionBy("doc_id", "text_crc32", "size", "part").orderBy("part")  # rows of one input partition at most
    numbered = out.withColumn("part", F.spark_partition_id()).withColumn("copy", F.row_number().over(repeats))
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text_crc32", "copy"), F.lit(slots)).cast("int")
    return numbered.withColumn("virtual_slot", slot).drop("part", "copy")


def slot_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows"))


def first_map(sizes: list, shards: int, slots: int = SLOTS) -> list[tuple]:
    """Version 1: the largest slots first, each to the shard with the fewest bytes so far."""
    known = {r["virtual_slot"]: (r["n_bytes"], r["n_rows"]) for r in sizes}
    load = [(0, s) for s in range(shards)]
    out = []
    for slot in sorted(range(slots), key=lambda v: (-known.get(v, (0, 0))[0], v)):
        n_bytes, n_rows = known.get(slot, (0, 0))
        held, shard = heapq.heappop(load)
        heapq.heappush(load, (held + n_bytes, shard))
        out.append((1, slot, shard, n_bytes, n_rows))
    return sorted(out)


def grow_map(current: list[tuple], shards: int) -> list[tuple]:
    """The next version, with shard number ``shards`` added: slots only move into the new shard.

    The fullest shard gives its largest slot that brings the new shard no further than an even share.
    """
    version, share = current[0][0] + 1, sum(r[3] for r in current) / (shards + 1)
    held: dict[int, list] = {s: [] for s in range(shards)}
    for r in current:
        held[r[2]].append((r[3], -r[1]))
    total = {s: sum(b for b, _ in v) for s, v in held.items()}
    for v in held.values():
        v.sort()
    moved, new, open_shards = set(), 0, set(held)
    while open_shards:
        giver = max(open_shards, key=lambda s: (total[s], -s))
        fit = next((i for i in range(len(held[giver]) - 1, -1, -1) if 0 < held[giver][i][0] <= share - new), None)
        if fit is None or total[giver] <= share:
            open_shards.discard(giver)
            continue
        n_bytes, slot = held[giver].pop(fit)
        total[giver] -= n_bytes
        new += n_bytes
        moved.add(-slot)
    return [(version, slot, shards if slot in moved else shard, b, n) for _, slot, shard, b, n in current]


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """Each record with its shard by the slot table, its place there and its shard after one more shard is added.

    Returns ``doc_id, size, text_crc32, virtual_slot, shard, slot, map_version, next_shard,
    next_version``; ``slot`` counts the records of a shard from 0 without gaps. Sizes of the
    shards are near equal as long as no virtual slot holds more than a small part of a shard.
    """
    spark = docs.sparkSession
    rows = settle(records(docs, slots), "shard-records")
    first = first_map(slot_sizes(rows).collect(), shards, slots)  # one row per virtual slot at most
    grown = grow_map(first, shards)
    stored = settle(spark.createDataFrame(first + grown, MAP_SCHEMA), "slot-map")  # all versions; one row per slot and version
    ahead = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    now = stored.where(F.col("version") == first[0][0]).select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(ahead), F.lit(0)).alias("begins"), F.col("version").alias("map_version"))
    then = stored.where(F.col("version") == grown[0][0]).select("virtual_slot", F.col("shard").alias("next_shard"), F.col("version").alias("next_version"))
    where = F.broadcast(now.join(then, "virtual_slot"))
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(order))
        .join(where, "virtual_slot")
        .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("begins") + F.col("nth") - 1).alias("slot"), "map_version", "next_shard", "next_version")
    )
