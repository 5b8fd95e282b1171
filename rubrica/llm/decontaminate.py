"""Benchmark decontamination: one Aho-Corasick automaton over the words of all test questions and answers.

A window is ten consecutive words of a benchmark item; an item of fewer words, but not none, is one
window. The windows, each with the items that hold it, are the automaton's patterns; every text runs
through it once, whole, and a document word inside any occurrence of a window is hit. Words are the
automaton's letters: each is written in three symbols, so that no node has many children. Offsets are
mapped back to the original text.

What goes to the tasks is the benchmark, a query set, never the documents: its distinct (window, item)
pairs, measured first. Up to ``PART_BYTES`` of them make one automaton and documents aren't shuffled
at all. A larger benchmark is cut into parts by hash, each of which passes through the driver and scans
the texts on its own; hits of a text are then merged by the text's SHA-256, in SQL.

Null and empty texts have no words and are never contaminated. Repeated documents keep a row each;
repeated items are one item of their id, and their windows are counted once. An item without an id is
named by the empty string. A very long text is read piece by piece with nine words carried over. Columns
of docs named like the new ones are replaced.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import shared, words as w

WINDOW, PART_BYTES = 10, 16 << 20
SPANS = "array<struct<first:long,last:long,start:long,end:long>>"
SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
NEW = ["n_words", "n_hit", "n_items", "items", "spans"]


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct (window, item) of benchmark (item_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                item, carry = b.column("item")[i].as_py(), []
                n = 0
                for some in w.pieces(b.column("raw")[i].as_py()):
                    n, ws = n + len(some), carry + some
                    found = [b" ".join(ws[k : k + window]) for k in range(len(ws) - window + 1)]
                    carry = ws[max(len(ws) - window + 1, 0) :]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([item] * len(found))], ["window", "item"])
                if 0 < n < window:
                    yield pa.RecordBatch.from_arrays([pa.array([b" ".join(carry)], pa.binary()), pa.array([item])], ["window", "item"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), w.raw(F.col("text")).alias("raw"))
    return rows.mapInArrow(run, "window binary, item string").distinct()


class Scanner:
    """The automaton of a table (window, item)."""

    def __init__(self, found: pa.Table):
        items = found.column("item").to_pylist()
        self.items, self.of, lengths = sorted(set(items)), [], []
        place = {x: k for k, x in enumerate(self.items)}
        number: dict[bytes, int] = {}
        for x, item in zip(found.column("window").to_pylist(), items):
            k = number.setdefault(x, len(number))
            if k == len(self.of):
                self.of.append([])
                lengths.append(x.count(b" ") + 1)
            self.of[k].append(place[item])
        self.lengths, self.longest = lengths, max(lengths, default=1)
        vocabulary = dict.fromkeys(x for text in number for x in text.split(b" "))
        r = max(2, math.ceil(len(vocabulary) ** (1 / 3)))
        self.code = {x: chr(1 + k % r) + chr(1 + r + k // r % r) + chr(1 + 2 * r + k // r // r) for k, x in enumerate(vocabulary)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for x, k in number.items():
            self.automaton.add_word("".join(map(self.code.get, x.split(b" "))), k)
        if number:
            self.automaton.make_automaton()
        else:
            self.code = {}

    def scan(self, raw: bytes, size: int = w.PIECE) -> tuple[int, list[list[int]], set[int]]:
        """Words, hit runs of words as [first, last], numbers of the items found."""
        n, spans, hit, tail = 0, [], set(), ""
        for some in w.pieces(raw, size):
            if self.code:
                text = tail + "".join(map(self.code.get, some, repeat("\0\0\0")))
                base = n - len(tail) // 3
                for end, k in self.automaton.iter(text):
                    last = base + end // 3
                    first = last - self.lengths[k] + 1
                    while spans and spans[-1][1] >= first:
                        a, b = spans.pop()
                        first, last = min(a, first), max(b, last)
                    spans.append([first, last])
                    hit.add(k)
                tail = text[len(text) - 3 * (self.longest - 1) :] if len(text) > 3 * (self.longest - 1) else text
            n += len(some)
        return n, spans, {x for k in hit for x in self.of[k]}


def offsets(raw: bytes, spans: list[list[int]]) -> list[dict]:
    """Runs of words with the half-open run of characters of the original text that they cover."""
    if not spans:
        return []
    starts, ends = w.bounds(raw)
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    out, at, chars = [], 0, 0
    for first, last in spans:
        a, b = int(starts[first]), int(ends[last])
        chars += int(np.count_nonzero(lead[at:a]))
        wide = int(np.count_nonzero(lead[a:b]))
        out.append({"first": first, "last": last, "start": chars, "end": chars + wide})
        at, chars = b, chars + wide
    return out


_made: dict[str, Scanner] = {}


def scanner(number: str, held) -> Scanner:
    """In a Python worker: the automaton of a part, made once; another part's goes."""
    shared.holding(f"decontaminate-{number}", _made.clear)
    if number not in _made:
        _made.clear()
        _made[number] = Scanner(pa.ipc.open_stream(held.value).read_all())
    return _made[number]


def _scanned(rows: DataFrame, held) -> DataFrame:
    """rows with n_words, items and spans for their column _raw, which goes."""
    number = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(number, held)
        for b in shared.slices(batches):
            raws = b.column("_raw").to_pylist()
            found = [s.scan(x) for x in raws]
            more = [
                pa.array([n for n, _, _ in found], pa.int64()), pa.array([[s.items[k] for k in sorted(items)] for _, _, items in found], pa.list_(pa.string())),
                pa.array([offsets(x, spans) for x, (_, spans, _) in zip(raws, found)], SPAN),
            ]
            own = [c for c in b.schema.names if c != "_raw"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *more], [*own, "n_words", "items", "spans"])

    more = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.DataType.fromDDL(SPANS))])
    return rows.mapInArrow(run, T.StructType([f for f in rows.schema if f.name != "_raw"] + more.fields))


def _joined(spans):
    """Sorted runs, those that share a word made one."""
    def add(out, x):
        last = F.element_at(out, -1)
        one = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["last"] >= x["first"]), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(one))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), add)


def marked(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs (all columns, or those to keep) with NEW: n_words, n_hit, n_items, items (their ids, sorted as text) and spans (runs of hit words, by word and by character)."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    had = [c for c in (docs.columns if keep is None else keep) if c not in NEW]
    pairs = shared.cut(windows(benchmark, window))
    size = pairs.agg(F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item") + 16), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / part_bytes))

    def held(k: int):
        mine = pairs if parts == 1 else pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == k)
        found, out = mine.toArrow(), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, found.schema) as to:
            to.write_table(found)
        return spark.sparkContext.broadcast(out.getvalue().to_pybytes())

    # no column of docs stands beside the operator's own
    rows = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in had)).alias("_row"), w.raw(F.col("text")).alias("_raw"))
    if parts == 1:
        out = _scanned(rows, held(0))
    else:
        keyed = rows.withColumn("_key", F.sha2("_raw", 256))
        each = [_scanned(keyed.select("_key", "_raw"), held(k)).where(F.size("spans") > 0).distinct() for k in range(parts)]
        hits = each[0]
        for x in each[1:]:
            hits = hits.union(x)
        hits = hits.groupBy("_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), _joined(F.flatten(F.collect_list("spans"))).alias("spans"))
        none = spark.sparkContext.broadcast(_nothing())
        out = _scanned(keyed, none).drop("items", "spans").join(hits, "_key", "left")
        out = out.withColumns({"items": F.coalesce("items", F.array().cast("array<string>")), "spans": F.coalesce("spans", F.array().cast(SPANS))})
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return out.select(*(F.col(f"_row.`{c}`") for c in had), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")


def _nothing() -> bytes:
    out, schema = pa.BufferOutputStream(), pa.schema([("window", pa.binary()), ("item", pa.string())])
    with pa.ipc.new_stream(out, schema):
        pass
    return out.getvalue().to_pybytes()


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that no window hits, with their own columns."""
    return marked(docs.withColumn("_whole", F.struct(*(F.col(f"`{c}`") for c in docs.columns))), benchmark, ["_whole"], **how).where("n_hit = 0").select("_whole.*")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = marked(shared.table(spark, sf_dir, "documents").select("doc_id", "text"), shared.table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{w.UPPER}', '{w.LOWER}'), '{w.WORD}')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, {_WORDS} AS ws FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(len(ws), {WINDOW}) AS n, array_to_string(ws[k:k + {WINDOW - 1}], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
p AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM d),
run AS (SELECT r, k, list(word) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS ahead FROM p),
gram AS (SELECT r, k, n, array_to_string(ahead[1:n], ' ') AS win FROM run, (SELECT DISTINCT n FROM win) WHERE len(ahead) >= n),
occ AS (SELECT DISTINCT r, k, n, win FROM gram SEMI JOIN win USING (win, n)),
hit AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS spot FROM occ) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, list_sort(list(DISTINCT item)) AS items FROM occ JOIN win USING (win, n) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
