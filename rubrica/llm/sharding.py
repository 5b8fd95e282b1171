"""Sharding through fixed virtual slots.

A record's id hashes into one of ``SLOTS`` virtual slots, for good. Bytes and rows are summed by slot,
and a small versioned table maps slots to shards. Rebalancing edits that table: it moves slots, or
swaps two, from the heaviest shard to the lightest until no such move narrows the gap, and stores the
result as the next version; rows never change their slot. A version is a Parquet folder of ``SLOTS``
rows in the shared folder; earlier versions stay readable.

The law of this method is ``bytes``: shards are nearly equal in size, as near as slots allow.
``place`` gives each row its gapless position in its shard: the rows of the slots before it in that
shard, plus its rank in its own slot, so no window is larger than a slot.

Null and empty texts have no bytes beyond ``ROW_BYTES`` and CRC 0. Rows that repeat an id share a slot
and lie side by side. Null ids hash like any value. An empty table makes an empty result.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from . import shared

SLOTS, SHARDS, ROW_BYTES = 1 << 13, 24, 8


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """docs with vslot int, size long and text_crc32 long."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({
        "vslot": F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(slots)).cast("int"),
        "size": F.octet_length(text).cast("long") + ROW_BYTES,
        "text_crc32": F.crc32(text.cast("binary")),
    })


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of the slots that have any: at most as many as there are slots."""
    return {r["vslot"]: (r["bytes"], r["n"]) for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}


def initial(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    return [s % shards for s in range(slots)]


def rebalanced(mapped: list[int], sizes: dict[int, tuple[int, int]], shards: int = SHARDS) -> list[int]:
    """An edit of the map: few slots move. shards may be more or fewer than before."""
    out = [s if s < shards else i % shards for i, s in enumerate(mapped)]
    load, held = [0] * shards, [[] for _ in range(shards)]
    for slot, (size, _) in sorted(sizes.items()):
        load[out[slot]] += size
        held[out[slot]].append((size, slot))
    for h in held:
        h.sort()

    def move(slot: tuple[int, int], a: int, b: int) -> None:
        held[a].remove(slot)
        bisect.insort(held[b], slot)
        load[a] -= slot[0]
        load[b] += slot[0]
        out[slot[1]] = b

    for _ in range(8 * len(mapped)):
        a, b = max(range(shards), key=lambda s: (load[s], s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[a] - load[b]
        # the slot nearest half the gap
        at = bisect.bisect_right(held[a], (gap // 2, len(mapped)))
        best = min((x for x in held[a][max(0, at - 1) : at + 1] if 0 < x[0] < gap), key=lambda x: abs(2 * x[0] - gap), default=None)
        if best and gap - abs(gap - 2 * best[0]) > gap // 8:
            move(best, a, b)
            continue
        swap, left = None, gap
        for x in held[a]:  # the pair whose difference is nearest half the gap
            at = bisect.bisect_left(held[b], (x[0] - gap // 2, -1))
            for y in held[b][max(0, at - 1) : at + 1]:
                if 0 < x[0] - y[0] < gap and (r := abs(gap - 2 * (x[0] - y[0]))) < left:
                    swap, left = (x, y), r
        if best and abs(gap - 2 * best[0]) <= left:
            move(best, a, b)
        elif swap:
            move(swap[0], a, b)
            move(swap[1], b, a)
        else:
            break
        if max(load) - min(load) <= 1:
            break
    return out


def save_map(spark: SparkSession, path: str, version: int, mapped: list[int], sizes: dict[int, tuple[int, int]]) -> None:
    rows = [(slot, shard, *sizes.get(slot, (0, 0))) for slot, shard in enumerate(mapped)]
    spark.createDataFrame(rows, "vslot int, shard int, bytes long, n long").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int, bytes long, n long").parquet(f"{path}/version={version}")


def place(rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """rows (with vslot, size, text_crc32) with shard int and slot long, the position in the shard. The map has a fixed number of rows, so it is broadcast."""
    ahead = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = mapped.select("vslot", "shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("_inside", inside).join(F.broadcast(starts), "vslot").withColumn("slot", F.col("_start") + F.col("_inside")).drop("_start", "_inside")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slotted(shared.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    path, sizes, first = shared.fresh_path(spark, "slots"), slot_sizes(rows), initial()
    save_map(spark, path, 1, first, sizes)
    save_map(spark, path, 2, rebalanced(first, sizes), sizes)
    placed = place(rows, load_map(spark, path, 2))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
