"""Importance resampling toward a target: hashed n-gram features, log-ratio gains, Gumbel top-k.

Features are all runs of one to three consecutive words. The words of a stretch of text (up to
``PIECE`` bytes, several short documents or part of a long one) are put into a trie of three levels: a
node is a parent and a word, holds the CRC-32 state of its run and, in the first pass, how often it
occurs. A child's state follows from its parent's and the word's own CRC, so no run is ever spelled
out. The counts of the nodes go to their buckets, the buckets of all tries to one total per task, and
these to the corpus's; only bucket totals are shuffled. In the second pass the same tries carry each
node's gain, and a document's weight is the sum along its paths.

Drawing takes the documents with the highest scores: weights plus Gumbel noise that the id decides.
Scores are narrow rows; they are put in order over ranges, numbered inside each range, and get the
range's offset. Rows that agree in score, id and features travel as one row with a count (for each file
split, so that one count is bounded).

Null and empty texts have no features, weight 0 and a score, and are never drawn. Documents of the same
id share their noise; equal rows get ranks one after the other. An id that is null counts as no text in
the noise and comes last among ties. Empty tables give empty results; without target texts all t are 0.
Only the columns named are returned, so others can't clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from . import shared, words as w

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED, PIECE = 10_000, 3, 20, 5, 42, 1 << 20
#: Words up to so many bytes, with the space before them, move a CRC state by table.
BY_TABLE = 64


def _shifts() -> np.ndarray:
    """[k, j, b]: what byte j of a CRC state, being b, is after k zero bytes."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = (crc >> 1) ^ np.where(crc & 1, np.uint32(0xEDB88320), np.uint32(0))
    out = np.empty((BY_TABLE + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(BY_TABLE):
        out[k + 1] = crc[out[k] & 255] ^ (out[k] >> 8)
    return out


SHIFTS = _shifts()


class Trie:
    """Of the words of some stretches. Level n has, for each run of n words that occurs, one node."""

    def __init__(self, stretches: list[tuple[list[bytes], int]]):
        """(words, how many of the first ones are only carried over: runs that end in them aren't counted)."""
        ws = [x for some, _ in stretches for x in some]
        self.number = dict.fromkeys(ws)
        for k, x in enumerate(self.number):
            self.number[x] = k
        ids = np.fromiter(map(self.number.__getitem__, ws), np.int64, len(ws))
        sizes = np.array([len(some) for some, _ in stretches], np.int64)
        starts = np.cumsum(sizes) - sizes
        self.stretch = np.repeat(np.arange(len(stretches)), sizes)
        new = np.arange(len(ws)) - starts[self.stretch] >= np.array([c for _, c in stretches], np.int64)[self.stretch]
        #: By level: CRC states of the nodes; (node, last word's place) of the runs that count.
        self.states: list[np.ndarray] = []
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        spaced = [b" " + x for x in self.number]
        width = np.array([len(x) for x in spaced], np.int64)
        own = np.array([zlib.crc32(x) for x in spaced], np.uint32)
        at, node = np.arange(len(ws)), ids
        self.states.append(np.array([zlib.crc32(x) for x in self.number], np.uint32))
        self.runs.append((node[new], at[new]))
        for _ in range(RUN - 1):
            # a run ends one word further on, in the same stretch
            on = at + 1 < len(ws)
            at, node = at[on] + 1, node[on]
            same = self.stretch[at] == self.stretch[at - 1]
            at, node = at[same], node[same]
            keys, node = np.unique(node * max(len(self.number), 1) + ids[at], return_inverse=True)
            parent, word = np.divmod(keys, max(len(self.number), 1))
            self.states.append(self._moved(self.states[-1][parent], word, width, own, spaced))
            self.runs.append((node[new[at]], at[new[at]]))

    @staticmethod
    def _moved(state: np.ndarray, word: np.ndarray, width: np.ndarray, own: np.ndarray, spaced: list[bytes]) -> np.ndarray:
        k = np.minimum(width[word], BY_TABLE)
        out = own[word].copy()
        for j in range(4):
            out ^= SHIFTS[k, j, (state >> np.uint32(8 * j)) & np.uint32(255)]
        for i in np.flatnonzero(width[word] > BY_TABLE).tolist():
            out[i] = zlib.crc32(spaced[word[i]], int(state[i]))
        return out

    def totals(self, buckets: int = BUCKETS) -> np.ndarray:
        """Features by bucket."""
        out = np.zeros(buckets, np.int64)
        for state, (node, _) in zip(self.states, self.runs):
            counts = np.bincount(node, minlength=len(state))
            out += np.bincount(state % np.uint32(buckets), weights=counts, minlength=buckets).astype(np.int64)
        return out

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """The gains along the paths of each stretch."""
        out = np.zeros(int(self.stretch[-1]) + 1 if len(self.stretch) else 0, np.int64)
        for state, (node, at) in zip(self.states, self.runs):
            gain = gains[state % np.uint32(len(gains))]
            out += np.bincount(self.stretch[at], weights=gain[node], minlength=len(out)).astype(np.int64)
        return out


def stretches(texts: list[bytes], size: int = PIECE) -> Iterator[tuple[list[int], list[tuple[list[bytes], int]]]]:
    """Groups of about size bytes: places of texts, and for each its words with how many were carried over."""
    places: list[int] = []
    held: list[tuple[list[bytes], int]] = []
    full = 0
    for i, x in enumerate(texts):
        carry: list[bytes] = []
        for some in w.pieces(x, size):
            if some:
                places.append(i)
                held.append((carry + some, len(carry)))
                carry = (carry + some)[-(RUN - 1) :]
            full += min(len(x), size)
            if full >= size:
                if held:
                    yield places, held
                places, held, full = [], [], 0
    if held:
        yield places, held


def bucket_totals(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of a column text fall into each bucket; each task sends at most one row a bucket."""
    shared.small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.release()
        out = np.zeros(buckets, np.int64)
        for b in batches:
            for _, some in stretches(b.column("raw").to_pylist()):
                out += Trie(some).totals(buckets)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], ["bucket", "n"])

    counts = rows.select(w.raw(F.col("text")).alias("raw")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of each bucket, in doubles."""
    all_s, all_t, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (all_s + n) / ((float(s) + 1) * (all_t + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """From (doc_id, text): doc_id, n_words, n_features, weight and score of every row."""
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.release()
        for b in batches:
            n, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for places, some in stretches(b.column("raw").to_pylist()):
                np.add.at(n, places, [len(ws) - c for ws, c in some])
                np.add.at(weight, places, Trie(some).sums(gain))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "weight"])

    rows = docs.select(F.col("doc_id").cast("long"), w.raw(F.col("text")).alias("raw")).mapInArrow(run, "doc_id long, n_words long, weight long")
    features = sum((F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(RUN)), F.lit(0)).cast("long")
    return rows.select("doc_id", "n_words", features.alias("n_features"), "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def ranked(rows: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """rows of scored with rank: 1, 2, 3... of those drawn, else null. rows is read several times, so it should be a stored table."""
    spark, kinds = rows.sparkSession, "doc_id long, n_features long, weight long, score long"
    own = [x.split()[0] for x in kinds.split(", ")]
    able, rest = rows.where(F.col("n_words") >= least), rows.where(F.col("n_words") < least)
    most = percent * able.count() // 100

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            ends = done + np.cumsum(b.column("m").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(ends)], [*b.schema.names, "part", "upto"])
            done = int(ends[-1]) if b.num_rows else done

    same = able.groupBy(*own, F.spark_partition_id().alias("_split")).agg(F.count("*").alias("m")).select(*own, "m")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("m")]
    path = shared.fresh_path(spark, "resample-order")
    same.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{kinds}, m long, part int, upto long").write.parquet(path)
    placed = spark.read.parquet(path)
    sizes = placed.groupBy("part").agg(F.sum("m").alias("n"))  # one row a range
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    each = placed.join(F.broadcast(before), "part").withColumn("rank", F.explode(F.sequence(F.col("before") + F.col("upto") - F.col("m") + 1, F.col("before") + F.col("upto"))))
    drawn = each.select(*own, F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))
    return drawn.union(rest.select(*own, F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Every row of docs (doc_id, text) as doc_id, n_features, weight, score and rank toward target (text)."""
    gain = gains(bucket_totals(docs, buckets), bucket_totals(target, buckets))
    path = shared.fresh_path(docs.sparkSession, "resample-scores")
    scored(docs, gain, seed).write.parquet(path)
    return ranked(docs.sparkSession.read.parquet(path), percent, least)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
