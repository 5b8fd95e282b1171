"""Mixing sources to target weights by Pfair scheduling.

A source's rows are cut into blocks of about ``block_bytes``. With integer weights p of a frame of P
slots, block k (from 1) of a source may not run before slot floor((k-1)P/p) and must have run before
ceil(kP/p); the earliest deadline among the released blocks runs in each slot. The weights add up to
the frame, so every deadline is met, and at any slot each source has had its share to within less
than one block. Releases and deadlines repeat from frame to frame, so one frame is scheduled, on the
driver: the sum of the weights, which neither rows nor blocks change. A block's slot then follows from
its number alone.

Rows within a source are ordered by the MD5 of their id (then id), so that neighbours aren't read
together. Their byte offsets are prefix sums in two levels: inside ``BUCKETS`` parts of each source,
then over the parts, so a source that holds most rows is still spread over thousands of groups. A row
belongs to the block where it starts; one longer than a block takes up the slots of all it covers,
and the slots of a source that has run out stay empty: nothing is dropped or repeated.

Null sources and empty ones are one source, without a name. Null and empty texts count ``ROW_BYTES``.
Rows that repeat an id lie side by side. Columns of docs that have the names of the new ones are
replaced. Sources that ``weights`` doesn't name get ``DEFAULT``; a weight below 1 is an error.
"""

from __future__ import annotations

import heapq
from functools import reduce
from math import gcd

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from . import shared

BLOCK_BYTES, BUCKETS, ROW_BYTES, DEFAULT = 1 << 16, 4096, 8, 50
#: Target weights by source; the share is the weight over the sum of the weights of the sources present.
WEIGHTS = {"src0": 120, "src1": 80, "src2": 80, "src3": 20}
NEW = ["n_bytes", "source_offset", "block", "weight", "frame", "release", "deadline", "slot", "rank_in_block"]


def frame_schedule(weights: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, k, slot) of one frame, k and slots from 0; weights are integers that add up to the frame's length."""
    if any(w < 1 for w in weights.values()):
        raise ValueError("a weight must be a positive integer")
    frame = sum(weights.values())
    soon = [(0, -(-frame // w), s, 1) for s, w in sorted(weights.items())]  # release, deadline, source, block
    heapq.heapify(soon)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(frame):
        while soon and soon[0][0] <= slot:
            _, deadline, s, k = heapq.heappop(soon)
            heapq.heappush(ready, (deadline, s, k))
        _, s, k = heapq.heappop(ready)
        out.append((s, k - 1, slot))
        if k < weights[s]:
            heapq.heappush(soon, (k * frame // weights[s], -(-(k + 1) * frame // weights[s]), s, k + 1))
    return out


def present_weights(sources: list[str], weights: dict[str, int], default: int = DEFAULT) -> dict[str, int]:
    """Of the sources present, divided by their greatest common divisor."""
    raw = {s: weights.get(s, default) for s in sources}
    by = reduce(gcd, raw.values(), 0) or 1
    return {s: w // by for s, w in raw.items()}


def mix(docs: DataFrame, weights: dict[str, int] = WEIGHTS, default: int = DEFAULT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with NEW: (slot, rank_in_block) is the mixed order."""
    spark, had = docs.sparkSession, [c for c in docs.columns if c not in NEW]
    whole = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in had)).alias("_row")  # no column of docs stands beside the operator's own
    rows = docs.select(whole, F.col("doc_id").alias("_doc"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES).alias("n_bytes"))
    digest = F.md5(F.coalesce(F.col("_doc").cast("string"), F.lit("")).cast("binary"))
    rows = rows.withColumn("_order", digest).withColumn("_bucket", F.conv(F.substring(digest, 1, 3), 16, 10).cast("int") % BUCKETS)
    by = ["_source", "_bucket"]
    totals = rows.groupBy(*by).agg(F.sum("n_bytes").alias("_sum"), F.count("*").alias("_rows"))
    ahead = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by).orderBy("_order", "_doc", "n_bytes")
    placed = rows.withColumn("_inside", F.sum("n_bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_bytes"))
    placed = placed.join(starts, by).withColumn("source_offset", F.col("_start") + F.col("_inside"))
    placed = placed.withColumn("block", F.floor(F.col("source_offset") / block_bytes).cast("long"))
    # the sources' names: their number is a property of the corpus's make-up, not of its size
    present = present_weights(sorted(r[0] for r in totals.select("_source").distinct().collect()), weights, default)
    frame = sum(present.values())
    # Arrow tables: lists would make RDDs in Python, for which each executor starts a second set of Python workers
    kinds = pa.schema([("_source", pa.string()), ("weight", pa.int64()), ("_k", pa.int64()), ("_at", pa.int64())])
    slots = spark.createDataFrame(pa.Table.from_pylist([{"_source": s, "weight": present[s], "_k": k, "_at": at} for s, k, at in frame_schedule(present)], kinds))
    sized = spark.createDataFrame(pa.Table.from_pylist([{"_source": s, "weight": w} for s, w in present.items()], pa.schema(list(kinds)[:2])))
    placed = placed.join(F.broadcast(sized), "_source").withColumn("_k", F.col("block") % F.col("weight"))
    placed = placed.join(F.broadcast(slots) if frame <= 100_000 else slots, ["_source", "weight", "_k"])
    turn = F.expr("block div weight") * frame
    k = F.col("block") + 1
    return placed.select(
        *(F.col(f"_row.`{c}`") for c in had), "n_bytes", "source_offset", "block", "weight", F.lit(frame).cast("long").alias("frame"),
        F.expr(f"(block * {frame}) div weight").alias("release"), F.expr(f"((block + 1) * {frame} + weight - 1) div weight").alias("deadline"),
        (turn + F.col("_at")).alias("slot"), (F.col("source_offset") - F.col("block") * block_bytes).alias("rank_in_block"),
    )


def in_slots(docs: DataFrame, **how) -> DataFrame:
    """All rows of docs with slot and rank_in_block, sorted by the schedule over ranges of it."""
    order = ["slot", "rank_in_block", "doc_id"]
    kept = [c for c in docs.columns if c not in NEW]
    return mix(docs, **how).select(*(F.col(f"`{c}`") for c in kept), "slot", "rank_in_block").repartitionByRange(*order).sortWithinPartitions(*order)


def in_order(docs: DataFrame, **how) -> DataFrame:
    """All rows of docs, sorted by the schedule over ranges of it: files written from this, read by name, are the mixture."""
    return mix(docs, **how).repartitionByRange("slot", "rank_in_block", "doc_id").sortWithinPartitions("slot", "rank_in_block", "doc_id").select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(shared.table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", *NEW)


def _weight_sql() -> str:
    return "CASE source " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in WEIGHTS.items()) + f" ELSE {DEFAULT} END"


#: The schedule is simulated slot by slot: of the released blocks the one with the earliest deadline.
OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS s, coalesce(strlen(text), 0)::BIGINT + {ROW_BYTES} AS n_bytes, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
raw AS (SELECT s, {_weight_sql().replace("CASE source", "CASE s")} AS w FROM (SELECT DISTINCT s FROM d)),
g AS (SELECT list_reduce(list(w), lambda a, b: gcd(a, b)) AS q FROM raw),
present AS (SELECT s, (w // q)::BIGINT AS weight FROM raw, g),
f AS (SELECT sum(weight)::BIGINT AS frame FROM present),
names AS (SELECT list(s ORDER BY s) AS ss, list(weight ORDER BY s) AS ws FROM present),
run AS (
  SELECT 0::BIGINT AS tick, (SELECT list_transform(ws, lambda w: 0::BIGINT) FROM names) AS done, NULL::BIGINT AS pick, NULL::BIGINT AS k
  UNION ALL
  SELECT tick + 1, list_transform(range(1, len(done) + 1), lambda i: done[i] + (i = p)::BIGINT), p, done[p]
  FROM (
    SELECT r.tick, r.done, list_sort(list_transform(list_filter(range(1, len(ws) + 1), lambda i: done[i] < ws[i] AND done[i] * frame // ws[i] <= tick),
      lambda i: {{'deadline': ((done[i] + 1) * frame + ws[i] - 1) // ws[i], 'i': i}}))[1].i AS p
    FROM run r, names, f WHERE tick < frame
  )
),
slots AS (SELECT ss[pick] AS s, k, tick - 1 AS tick FROM run, names WHERE pick IS NOT NULL),
o AS (SELECT *, (sum(n_bytes) OVER (PARTITION BY s ORDER BY ('0x' || substr(h, 1, 3))::INT, h, doc_id, n_bytes ROWS UNBOUNDED PRECEDING) - n_bytes)::BIGINT AS source_offset FROM d),
b AS (SELECT *, source_offset // {BLOCK_BYTES} AS block FROM o)
SELECT doc_id, source, n_bytes, source_offset, block, weight, frame, (block * frame) // weight AS release, ((block + 1) * frame + weight - 1) // weight AS deadline,
  (block // weight) * frame + slots.tick AS slot, source_offset - block * {BLOCK_BYTES} AS rank_in_block
FROM b JOIN present USING (s) CROSS JOIN f JOIN slots ON slots.s = b.s AND slots.k = b.block % weight
"""
