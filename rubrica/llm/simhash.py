"""SimHash near-duplicates through an inverted index on byte positions with count filtering.

Two 64-bit fingerprints that differ in at most two bits share at least six of their eight positional
bytes. The index therefore posts each distinct fingerprint under six compound positions (pairs of
two-byte groups): of four groups at most two can be hit by two bits, so a linked pair always meets in
at least one list. Inside a list the shared positional bytes of a pair are tallied, pairs under the
guaranteed six are dropped, the rest is verified by counting differing bits.

A list longer than ``LIST`` holds a large family of near copies. Tallying all its pairs would be
quadratic, so its members are linked exactly through one-bit neighbours instead: two fingerprints
differ in at most two bits exactly if some value lies within one bit of both. Such a value has at
most 65 fingerprints around it, so no group is ever larger than that.

Nulls, empty texts and texts without words have fingerprint zero, linked like any other. Repeated
rows share a fingerprint and a component. Null ids are kept; they never become a component's id
unless a component has no other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from xxhash import xxh64_intdigest

from . import shared

LIST = 128
BITS = 2
SHARED_BYTES = 8 - BITS
GROUPS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def fingerprint(text: str | None) -> int:
    """Bit is 1 if set in over half the XXH64 values of the 3-word shingles, repeats included; unsigned."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [b" ".join(words)]
    hashes = np.array([xxh64_intdigest(s, 42) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shared.release()
    for b in batches:
        fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long: the 64 bits)."""
    shared.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def tally(a: Column, b: Column) -> Column:
    """Positional bytes that two fingerprints share."""
    x = a.bitwiseXOR(b)
    return sum((F.when(x.bitwiseAND(F.lit((255 << 8 * i) - (1 << 64 if i == 7 else 0))) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))


def _near(a: Column, b: Column) -> Column:
    return (tally(a, b) >= SHARED_BYTES) & (F.bit_count(a.bitwiseXOR(b)) <= BITS)


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; they connect exactly what pairs within two bits connect."""
    word = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(65535)) for i in range(4)]
    posts = fps.select("fp", F.explode(F.array(*(F.lit(n << 32).bitwiseOR(F.shiftleft(word[i], 16)).bitwiseOR(word[j]) for n, (i, j) in enumerate(GROUPS)))).alias("key"))
    sizes = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    posted = shared.cut(posts.join(sizes, "key"))
    listed = posted.where(F.col("n") <= LIST).groupBy("key").agg(F.collect_list("fp").alias("all"))
    pairs = listed.select("all", F.explode("all").alias("a")).select("a", F.explode(F.filter("all", lambda y: (y > F.col("a")) & _near(F.col("a"), y))).alias("b"))
    around = posted.where(F.col("n") > LIST).select("fp").distinct().select(
        "fp", F.explode(F.concat(F.array("fp"), F.array(*(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64))))).alias("mid")
    )
    stars = around.groupBy("mid").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where((F.col("a") < F.col("b")) & _near(F.col("a"), F.col("b")))
    return pairs.union(stars)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    each = shared.cut(fingerprints(docs))
    fps = shared.cut(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = shared.components(links(fps))
    joined = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = joined.join(least, "root").select("fp", "component_id")
    return each.join(of, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Near copies by similarity of shingle sets: what the byte-position index of fingerprints links, checked on the sets;
# then, for the pairs whose fingerprints differ in more bits, an index of shingles with wide fingerprints as a filter.

WIDE, NEAR_WORDS, SIMILARITY = 128, 5, 0.8
#: Longest list whose pairs are compared directly, rows of a block of a longer one, and rounds of comparing one's members with one of them.
SHORT, BLOCK, PIVOTS = 64, 512, 2
#: Sets with fewer shingles are compared without fingerprints, whose errors are only known for larger ones: they travel themselves.
FEW = 64
#: One text in SAMPLE is counted for common shingles; seen OFTEN there they come last in the order. No more than COMMON are kept.
SAMPLE, OFTEN, COMMON = 16, 16, 1 << 17


def bounds(similarity: float = SIMILARITY, slack: float = 8.0) -> int:
    """Bits in which a pair of that similarity differs at most, but for chance (slack: deviations above the mean)."""
    flip = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(8 * WIDE * flip + slack * math.sqrt(8 * WIDE * flip * (1 - flip)))


def shingle_set(text: str | None, size: int = NEAR_WORDS) -> np.ndarray:
    """XXH64 values of the distinct shingles, ascending; none for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, "<u8")
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) > size else [b" ".join(words)]
    return np.unique(np.array([xxh64_intdigest(s, 42) for s in shingles], dtype="<u8"))


def wide_fingerprint(base: np.ndarray) -> bytes:
    """1024 bits, of a set of shingles; zeros for none."""
    ones = np.zeros(8 * WIDE, dtype=np.int32)
    steps = np.arange(1, WIDE // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(base), 255):
        x = base[at : at + 255, None] + steps
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(base), bitorder="little").tobytes()


def _share(n: int, similarity: float) -> int:
    """The least whole number that isn't under similarity times n."""
    return -(-n * round(similarity * 10**6) // 10**6)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets have that Jaccard similarity, exactly."""
    if min(len(a), len(b)) < _share(max(len(a), len(b)), similarity):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared_ = int((both[1:] == both[:-1]).sum())
    return shared_ >= _share(len(both) - shared_, similarity)


def _print(base: np.ndarray) -> int:
    return int(np.array(xxh64_intdigest(base.tobytes(), 7), np.uint64).view(np.int64))


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of shingles that are common in a sample of rows (th, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.release()
        for b in batches:
            for some in shared.slices(iter([b])):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, "<u8"), *map(shingle_set, some.column("text").to_pylist())]).view(np.int64))], ["h"])

    some = rows.where(F.pmod("th", F.lit(SAMPLE)) == 0).dropDuplicates(["th"]).select("text").mapInArrow(run, "h long")
    found = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(COMMON).collect()
    hashes = np.array([r["h"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["n"] for r in found], np.int64)[order]


def prefix(base: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set in the order (times counted as common, hash). Two sets of that similarity share at least one of these."""
    n = len(base) - _share(len(base), similarity) + 1
    if not len(base):
        return base
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], base), len(common[0]) - 1)
        times = np.where(common[0][at] == base, common[1][at], 0)
        base = base[np.argsort(times, kind="stable")]
    return base[:n]


def _with_prints(rows: DataFrame, common: tuple[np.ndarray, np.ndarray], similarity: float) -> DataFrame:
    """(doc, th, id, size, fp, keys) of rows (doc, th, text): id stands for the set of shingles, fp is the fingerprint, keys are the set's prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.release()
        for whole in batches:
            for b in shared.slices(iter([whole])):
                texts = b.column("text").to_pylist()
                sets = [shingle_set(t) for t in texts]
                fp = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
                keys = [prefix(x, common, similarity).view(np.int64) for x in sets]
                yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("th"), pa.array([_print(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), fp, pa.array(keys, pa.list_(pa.int64()))], ["doc", "th", "id", "size", "fp", "keys"])

    return rows.select("doc", "th", "text").mapInArrow(run, "doc long, th long, id long, size int, fp long, keys array<long>")


def fingerprint_links(each: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids of rows (id, fp) whose fingerprints are equal or linked by the byte-position index; some of each fingerprint's ids stand for all."""
    both = shared.cut(each.select("fp", "id").distinct())
    fps = shared.cut(both.groupBy("fp").agg(F.min("id").alias("least")))
    equal = both.join(fps, "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    found = links(fps.select("fp"))
    for c in "ab":
        found = found.join(fps.select(F.col("fp").alias(c), F.col("least").alias(f"i{c}")), c)
    return equal.union(found.where("ia <> ib").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))).distinct()


def bitmap(base: np.ndarray) -> np.ndarray:
    """A bit for the low digits of each hash: 8 * WIDE bits, or the power of two that is four times the set and more."""
    bits = max(8 * WIDE, 1 << max(0, 4 * len(base) - 1).bit_length())
    out = np.zeros(bits >> 3, np.uint8)
    at = (base & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def folded(bits: np.ndarray, n: int) -> np.ndarray:
    """The bitmap that n bytes would have held."""
    return np.bitwise_or.reduce(bits.reshape(-1, n), axis=0)


def possible(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets with these bitmaps and sizes can have the similarity: each bit that only one has is a shingle that the other lacks. Never wrongly no."""
    most = np.minimum(nx - np.bitwise_count(x & ~y).sum(axis=-1, dtype=np.int64), ny - np.bitwise_count(y & ~x).sum(axis=-1, dtype=np.int64))
    return most * 10**6 >= round(similarity * 10**6) * (nx + ny - most)


def _with_sets(rows: DataFrame, wide: bool) -> DataFrame:
    """(id, size, wide) or (id, size, base) of rows (id, text): the fingerprint and behind it the set where that is small, else its bitmap; or the set."""
    name = "wide" if wide else "base"
    value = (lambda x: wide_fingerprint(x) + (x if len(x) < 2 * FEW else bitmap(x)).tobytes()) if wide else np.ndarray.tobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.release()
        for whole in batches:
            for b in shared.slices(iter([whole])):
                sets = [shingle_set(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x) for x in sets], pa.int32()), pa.array([value(x) for x in sets], pa.binary())], ["id", "size", name])

    return rows.select("id", "text").mapInArrow(run, f"id long, size int, {name} binary")


def _sized(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of these sizes can have the similarity (a little is left for rounding; sets are compared in whole numbers)."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-3


class _Sets:
    """Fingerprints and what travels with them, of sets of these sizes."""

    def __init__(self, wide: list[bytes], size: np.ndarray):
        self.size = size.astype(np.int64)
        self.prints = np.frombuffer(b"".join(x[:WIDE] for x in wide), np.uint8).reshape(-1, WIDE)
        self.sets = [np.frombuffer(x, "<u8", offset=WIDE) if n < 2 * FEW else None for x, n in zip(wide, self.size.tolist())]
        self.maps = [np.frombuffer(x, np.uint8, offset=WIDE) if y is None else bitmap(y) for x, y in zip(wide, self.sets)]
        self.small = np.array([folded(m, WIDE) for m in self.maps], np.uint8).reshape(-1, WIDE)


def _may(x: _Sets, y: _Sets, i: np.ndarray, j: np.ndarray, similarity: float, most: int) -> np.ndarray:
    """Which pairs (i of x, j of y) fingerprints, bitmaps and, for small sets, the sets themselves don't drop."""
    near = possible(x.small[i], y.small[j], x.size[i], y.size[j], similarity)
    near &= (np.minimum(x.size[i], y.size[j]) < FEW) | (np.bitwise_count(x.prints[i] ^ y.prints[j]).sum(axis=-1) <= most)
    for k in np.flatnonzero(near):
        a, b = x.sets[i[k]], y.sets[j[k]]
        if a is not None and b is not None:
            near[k] = similar(a, b, similarity)
        else:
            p, q = x.maps[i[k]], y.maps[j[k]]
            n = min(len(p), len(q))
            near[k] = n == WIDE or possible(folded(p, n), folded(q, n), x.size[i[k]], y.size[j[k]], similarity)
    return near


def _close(pairs: DataFrame, fps: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that fps (id, size, wide) don't drop."""
    most = bounds(similarity)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.release()
        for b in batches:
            x, y = (_Sets(b.column(f"w{c}").to_pylist(), b.column(f"n{c}").to_numpy()) for c in "ab")
            at = np.arange(b.num_rows)
            yield b.select(["a", "b"]).filter(pa.array(_may(x, y, at, at, similarity, most)))

    both = pairs
    for c in "ab":
        both = both.join(fps.select(F.col("id").alias(c), F.col("size").alias(f"n{c}"), F.col("wide").alias(f"w{c}")), c)
    return both.mapInArrow(close, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose sets have the similarity, exactly; texts are (id, text)."""
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.release()
        for b in batches:
            yield b.select(["a", "b"]).filter(pa.array([similar(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), similarity) for x, y in zip(b.column("sa"), b.column("sb"))], pa.bool_()))

    pairs = shared.cut(pairs)
    sets = _with_sets(_of(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), ["id"]), False)
    for c in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(c), F.col("base").alias(f"s{c}")), c)
    return pairs.mapInArrow(exact, "a long, b long")


def _of(rows: DataFrame, some: DataFrame, by: list[str], how: str = "left_semi") -> DataFrame:
    """rows joined with some; a small table goes to the rows, so that texts aren't shuffled."""
    some = shared.cut(some)
    return rows.join(F.broadcast(some) if some.count() <= 1_000_000 else some, by, how)


def set_links(found: DataFrame, listed: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Edges between ids that connect exactly what the pairs of that similarity connect, from pairs found (a, b), listed (key, id, size), no row twice, and texts (id, text).

    The pairs found by fingerprints are checked first; what they connect is not compared again. The lists are
    the exact way for the rest. The pairs of a short list are compared. The members of a long one are first compared with one of
    them, then with ``PIVOTS`` others, which differ from list to list; then, in blocks, those that aren't connected yet, with all others: what is connected already
    needs no comparison, so large families of copies cost little more than their size.
    """
    most = bounds(similarity)
    spark = listed.sparkSession
    fps = shared.cut(_with_sets(texts, True))
    shared.tidy(spark)
    edges = shared.cut(_verified(_close(found, fps, similarity), texts, similarity))
    roots = shared.components(edges)
    shared.tidy(spark)
    listed = listed.join(roots, listed["id"] == roots["node"], "left").select("key", "id", "size", F.coalesce("root", "id").alias("root"))
    sizes = listed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "size", "root")).alias("first"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "n", "first")
    listed = shared.cut(listed.join(sizes, "key"))
    short = listed.where(F.col("n") <= SHORT).groupBy("key").agg(F.collect_list(F.struct("id", "size", "root")).alias("all"))
    apart = lambda x, y: (y["id"] > x["id"]) & (y["root"] != x["root"]) & _sized(y["size"], x["size"], similarity)
    pairs = short.select("all", F.explode("all").alias("x")).select(F.col("x.id").alias("a"), F.explode(F.filter("all", lambda y: apart(F.col("x"), y))).alias("y")).select("a", F.col("y.id").alias("b"))
    long = listed.where(F.col("n") > SHORT)
    stars = long.where("root <> first.root").where(_sized(F.col("size"), F.col("first.size"), similarity)).select(F.col("first.id").alias("a"), F.col("id").alias("b"))
    long = long.drop("root")
    edges = shared.cut(edges.union(_verified(_close(pairs.union(stars).distinct(), fps, similarity), texts, similarity)))
    shared.tidy(spark)
    if long.isEmpty():
        return edges
    for turn in range(PIVOTS + 1):
        roots = shared.components(edges)
        shared.tidy(spark)
        of = shared.cut(long.join(roots, long["id"] == roots["node"], "left").select("key", "n", "id", "size", F.coalesce("root", "id").alias("root")))
        mixed = of.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(F.xxhash64("id", "key", F.lit(turn)).alias("h"), "id", "size", "root")).alias("p")).where("lo < hi").select("key", "p")
        if turn == PIVOTS:
            break
        stars = of.join(mixed, "key").where("root <> p.root").where(_sized(F.col("size"), F.col("p.size"), similarity)).select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"))
        edges = shared.cut(edges.union(_verified(_close(stars.distinct(), fps, similarity), texts, similarity)))
        shared.tidy(spark)
    mixed = mixed.select("key")
    rest = of.join(mixed, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "root").join(fps, "id")

    def compare(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        shared.release()
        root, own, ids, size = (g[c].to_numpy() for c in ("root", "own", "id", "size"))
        sets = _Sets(list(g["wide"]), size)
        left, right, out = np.flatnonzero(own == key[1]), np.flatnonzero(own == key[2]), []
        for x in left:
            y = right[root[right] != root[x]]
            if key[1] == key[2]:
                y = y[y > x]
            y = y[np.minimum(size[y], size[x]) >= similarity * np.maximum(size[y], size[x]) - 1e-3]
            y = y[_may(sets, sets, np.full(len(y), x), y, similarity, most)]
            out.append(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], axis=1))
        return pd.DataFrame(np.concatenate([np.zeros((0, 2), np.int64), *out]), columns=["a", "b"])

    # two of these that are similar may meet in many lists
    more = rest.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct()
    return edges.union(_verified(more, texts, similarity))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near copies, the one with the smallest id; null ids are larger than all others.

    Near copies: pairs whose sets of distinct five-word shingles have that Jaccard similarity, and what such
    pairs connect. Texts without words are copies of each other. Pairs come from the byte-position index of
    the fingerprints, as in ``near_duplicates``; every link is verified on the sets (of 64-bit hashes, like
    their ids). Pairs that differ in more bits than the index reaches are the rest, for which there is an
    exact way: two sets of the similarity share one of their first shingles in any common order; rare ones
    come first, so the lists of an index of these are short. It compares only what fingerprints haven't
    connected, and no pair is missed.
    Columns of any name come back as they were.
    """
    shared.small_batches(docs.sparkSession)
    large = F.lit((1 << 63) - 1)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")  # no column of docs stands beside the stage's own
    marked = docs.select(F.coalesce(F.col("doc_id").cast("long"), large).alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_th"), whole)
    rows = marked.select(F.col("_doc").alias("doc"), F.col("_th").alias("th"), F.col("_row.text").cast("string").alias("text"))
    each = shared.cut(_with_prints(rows, common_shingles(rows), similarity))
    found = shared.cut(fingerprint_links(each))
    posts = each.select("id", "size", F.explode("keys").alias("key")).repartition("key")
    meet = posts.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    shared.tidy(docs.sparkSession)
    listed = shared.cut(posts.join(meet, "key").select("key", "id", "size").distinct())
    shared.tidy(docs.sparkSession)
    # of rows that repeat (doc, th) one; only those are shuffled with their texts
    repeated = shared.cut(each.groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).count().where("count > 1").select("_doc", "_th"))
    once = _of(marked, repeated, ["_doc", "_th"], "left_anti").union(_of(marked, repeated, ["_doc", "_th"]).dropDuplicates(["_doc", "_th"]))
    chosen = each.join(listed.select("id").union(found.select(F.explode(F.array("a", "b")))).distinct(), "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc", "th")).alias("one"))
    texts = _of(once, chosen.select("id", F.col("one.doc").alias("_doc"), F.col("one.th").alias("_th")), ["_doc", "_th"], "inner").select("id", F.col("_row.text").cast("string").alias("text"))
    edges = set_links(found, listed, texts, similarity)
    shared.tidy(docs.sparkSession)
    roots = shared.components(edges)
    shared.tidy(docs.sparkSession)
    of = each.join(roots, each["id"] == roots["node"], "left").select("doc", "th", F.coalesce("root", "id").alias("root"))
    best = of.groupBy("root").agg(F.min(F.struct("doc", "th")).alias("best"))
    lost = of.join(best, "root").where("doc <> best.doc or th <> best.th").select(F.col("doc").alias("_doc"), F.col("th").alias("_th")).distinct()
    return _of(once, lost, ["_doc", "_th"], "left_anti").select("_row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
