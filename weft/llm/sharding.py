"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots by their id, the checksum of their text and, of equal records, their
number, so an id that many rows share is spread over the slots as well. The bytes of each slot are summed,
and a table with a version says which shard a slot belongs to. Rebalancing edits the table:
it moves as few slots as it can from shards above the mean to those below, and stores the
result as the next version. Records never move but with their slot.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Virtual slots. The map has one entry for each, so it is of a fixed size.
SLOTS = 4096
#: Equal rows that a task numbers at once.
COPIES = 4096


def first_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Version 0: slots dealt out in turn."""
    return {s: s % shards for s in range(slots)}


def rebalanced(slot_map: dict[int, int], size: dict[int, int], shards: int) -> dict[int, int]:
    """The next version of slot_map, for the sizes of the slots; shards may be more or fewer than before.

    Only shards below the mean take slots, so of balanced shards and a new one the new one takes all that move;
    where no shard is new, single slots then even out all shards.
    """
    new = dict(slot_map)
    load = [0] * shards
    owned: dict[int, list[int]] = {k: [] for k in range(shards)}
    loose = []
    for s, k in sorted(new.items()):
        if k < shards:
            load[k] += size.get(s, 0)
            owned[k].append(s)
        else:
            loose.append(s)
    mean = sum(size.get(s, 0) for s in new) / shards
    new_shard = any(not owned[k] for k in range(shards))
    for k in range(shards):
        for s in sorted(owned[k], key=lambda s: (-size.get(s, 0), s)):
            if size.get(s, 0) and load[k] - size[s] >= mean:
                load[k] -= size[s]
                loose.append(s)
    takers = [k for k in range(shards) if load[k] < mean] or list(range(shards))
    heap = [(load[k], k) for k in takers]
    heapq.heapify(heap)
    for s in sorted(loose, key=lambda s: (-size.get(s, 0), s)):
        total, k = heapq.heappop(heap)
        new[s] = k
        heapq.heappush(heap, (total + size.get(s, 0), k))
    for total, k in heap:
        load[k] = total
    if not new_shard:
        takers = list(range(shards))
    for _ in range(len(new)):  # then one slot after the other from the fullest shard to the emptiest, while that narrows the gap
        high, low = max(range(shards), key=lambda k: (load[k], k)), min(takers, key=lambda k: (load[k], k))
        gap = load[high] - load[low]
        best = min((abs(gap - 2 * size.get(s, 0)), s) for s, k in new.items() if k == high) if gap > 0 else (0, 0)
        if gap <= 0 or best[0] >= gap:
            break
        new[best[1]] = low
        load[high] -= size.get(best[1], 0)
        load[low] += size.get(best[1], 0)
    return new


def map_table(spark, versions: list[dict[int, int]]) -> DataFrame:
    """The stored slot-to-shard map: version, virtual_slot, shard."""
    rows = [(v, s, k) for v, m in enumerate(versions) for s, k in sorted(m.items())]
    return stored(spark.createDataFrame(rows, "version int, virtual_slot int, shard int"), "slot-map")


def sharded(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """docs(doc_id, text) to doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot.

    The law is `bytes`: the shards' sums of size (UTF-8 bytes of the text and 1; null text: 1) are
    nearly equal, also where many rows share a doc_id or are equal. slot is the row's place in its shard, from 0 without gaps. Null doc_ids are hashed as
    nulls are, equal rows get slots of their own, and which of them gets which makes no
    difference to the result. An empty table gives an empty result. Other columns play no part.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    record = ["doc_id", "size", "text_crc32"]
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
    )
    # equal rows are counted and made again with a number each: of one record first runs of COPIES, which are dealt out, then each
    rows = rows.groupBy(*record).agg(F.count("*").alias("n")).select(*record, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(COPIES))).alias("run"))
    rows = rows.repartition(*record, "run").select(*record, F.explode(F.sequence("run", F.least(F.col("run") + COPIES, "n") - 1)).alias("copy"))
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "copy"), F.lit(slots)).cast("int")
    rows = rows.select(*record, slot.alias("virtual_slot"))
    rows = stored(rows, "sized")
    found = {r.virtual_slot: (r.bytes, r.n) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}  # at most `slots` rows
    start = first_map(shards, slots)
    edited = rebalanced(start, {s: b for s, (b, _) in found.items()}, shards)
    table = map_table(spark, [start, edited])
    offset, at = {}, [0] * shards
    for s in range(slots):
        offset[s] = at[edited[s]]
        at[edited[s]] += found.get(s, (0, 0))[1]
    offsets = spark.createDataFrame(sorted(offset.items()), "virtual_slot int, offset long")
    current = table.where(F.col("version") == 1).join(offsets, "virtual_slot").select("virtual_slot", "shard", "offset")
    place = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("nth", F.row_number().over(place)).join(F.broadcast(current), "virtual_slot")  # `slots` rows
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
