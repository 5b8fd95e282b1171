"""Token-id files compressed by Re-Pair grammars.

Documents are tokenized, an end id is appended to each, and the ids are stored in ascending order of
doc_id. A shard holds about ``SHARD_TOKENS`` ids of whole documents. Its sequence is rewritten round by
round: the neighbouring pairs that occur ``FREQUENT`` times or more become nonterminals, until there are
none. (One pair at a time would be a pass over the shard for each rule; a round replaces many at once,
the most frequent winning where occurrences overlap, and looks again only at places that changed.) A shard stores its rules, each rule's expansion length, the final sequence,
the documents' ids and their token counts. ``decode_range`` reads any span of a shard without
expanding the rest.

The files are Parquet tables of one row a shard: the blob in the layout of ``pack``, and the document
columns beside it, so that Spark's readers and writers carry them to and from any store.

Null and empty texts hold the end id alone. Rows that repeat an id stay, ordered by their text. Null
ids come first. Strings of added tokens in a text become their ids, as the library has it by default.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from . import shared

END = 2
#: Ids of a shard, and how often a pair must occur in it to become a rule.
SHARD_TOKENS, FREQUENT = 1 << 20, 8
MAGIC = b"RPG2"
KEPT, KEPT_CHARS = 1_200_000, 64
#: Latin letters, all of which the tokenizer's pattern takes for letters, and marks behind them.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!\"#$%&()*+,./:;<=>?@\\\\\\[\\]^_`{|}~-]*)").fullmatch
#: The same marks.
MARKS = "!\"#$%&()*+,./:;<=>?@\\[]^_`{|}~-"
#: How a byte-level vocabulary spells the bytes: printable ones of Latin-1 as they are, the others from U+0100 on.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in _OWN} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(_OWN))}


def grammar(ids: np.ndarray, frequent: int = FREQUENT, base: int | None = None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(base, rules (n, 2), expansion lengths n, sequence): symbol base + i stands for rules[i]; base is above every id.

    When it ends, no two neighbouring symbols occur side by side ``frequent`` times or more; occurrences that
    overlap (a run of three equal symbols holds two) count as what of them can be replaced at once. Plain
    Re-Pair is ``frequent`` 2.
    """
    base = base or (int(ids.max()) + 1 if len(ids) else 1)
    seq = ids.astype(np.uint32)
    rules, lengths, made = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)], base
    # Places are taken by index, not by mask: masks of no pattern cost a mispredicted branch an element.
    # A pair's places are all awake or none: a pair that was counted and isn't frequent has no new ones later, as new pairs hold new symbols.
    awake = np.arange(max(0, len(seq) - 1))
    while len(awake):
        bits = max(8, int(len(awake)).bit_length())
        keys = seq[awake].astype(np.uint64)
        keys <<= np.uint64(32)
        keys |= seq[awake + 1]
        bins = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)
        # a bin stands for one of its pairs; the others stay awake
        seen = np.zeros(1 << bits, np.uint64)
        seen[bins] = keys
        mine = seen[bins] == keys
        counts = np.bincount(bins[np.flatnonzero(mine)], minlength=1 << bits)
        flag = np.zeros(len(seq), bool)
        flag[awake[np.flatnonzero(~mine)]] = True
        often = (counts >= frequent)[bins]
        often &= mine
        often = np.flatnonzero(often)
        at, of = awake[often], bins[often]
        flag[at] = True
        if not len(at):
            awake = np.flatnonzero(flag)
            continue
        # where frequent pairs overlap the most frequent wins (of equals the larger bin); of a run of one pair every other place
        rank = counts[of] << bits | of
        beside = np.diff(at) == 1
        begins = np.concatenate([[True], ~beside | (rank[1:] != rank[:-1])])
        group = np.cumsum(begins) - 1
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(at)) - 1
        beaten = np.zeros(len(first), bool)
        beaten[1:] = beside[first[1:] - 1] & (rank[first[1:] - 1] > rank[first[1:]])
        beaten[:-1] |= beside[last[:-1]] & (rank[last[:-1] + 1] > rank[last[:-1]])
        wins = ~beaten[group] & ((np.arange(len(at)) - first[group]) & 1 == 0)
        won = np.bincount(of[np.flatnonzero(wins)], minlength=1 << bits)
        chosen = np.flatnonzero(won >= max(2, (frequent + 1) // 2))
        if not len(chosen):
            # What won once or lost to such a pair: a pair that lost nowhere stays as it is, so it sleeps; the one with the highest rank is among them, so this ends.
            lost = np.zeros(1 << bits, bool)
            lost[of[beaten[group]]] = True
            flag[at[~lost[of]]] = False
            awake = np.flatnonzero(flag)
            continue
        name = np.zeros(1 << bits, np.uint32)
        name[chosen] = np.arange(made, made + len(chosen))
        symbol = name[of]
        wins &= symbol > 0
        wins = np.flatnonzero(wins)
        at, symbol = at[wins], symbol[wins]
        pairs = np.stack([seen[chosen] >> np.uint64(32), seen[chosen] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.int64)
        known = np.concatenate(lengths)
        size = np.where(pairs >= base, known[np.maximum(pairs - base, 0)] if len(known) else 1, 1)
        rules.append(pairs)
        lengths = [known, size.sum(axis=1)]
        made += len(chosen)
        if made >= 1 << 32:
            raise ValueError("more symbols than a shard holds")
        seq[at] = symbol
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        if 16 * len(at) > len(seq):  # few gaps are quick by mask
            stays = np.flatnonzero(stays)
        seq, flag = seq[stays], flag[stays]
        at = at - np.arange(len(at))
        flag[at] = True
        flag[at[at > 0] - 1] = True
        flag[-1] = False
        awake = np.flatnonzero(flag)
    return base, np.concatenate(rules), np.concatenate(lengths), seq.astype(np.int64)


def expand(base: int, rules: np.ndarray, lengths: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """The ids a sequence stands for; work is in proportion to them."""
    size = np.ones(len(seq), np.int64)
    small, big = np.flatnonzero(seq < base), np.flatnonzero(seq >= base)
    size[big] = lengths[seq[big] - base]
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    place = ends - size
    out[place[small]] = seq[small]
    symbol, place = seq[big] - base, place[big]
    while len(symbol):
        left, right = rules[symbol, 0], rules[symbol, 1]
        long = left >= base
        behind = place + np.where(long, lengths[np.maximum(left - base, 0)], 1)
        both, at = np.concatenate([left, right]), np.concatenate([place, behind])
        small, big = np.flatnonzero(both < base), np.flatnonzero(both >= base)
        out[at[small]] = both[small]
        symbol, place = both[big] - base, at[big]
    return out


def pack(ids: np.ndarray) -> bytes:
    """MAGIC; ids, rules, symbols, base (u32 each); left and right symbols of the rules, their expansion lengths, the sequence (u32 each)."""
    base, rules, lengths, seq = grammar(ids)
    return b"".join([MAGIC, struct.pack("<4I", len(ids), len(rules), len(seq), base), *(x.astype("<u4").tobytes() for x in (rules[:, 0], rules[:, 1], lengths, seq))])


def unpack(blob: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of ids, base, rules, expansion lengths, symbols."""
    if blob[:4] != MAGIC:
        raise ValueError("not a grammar shard")
    n, r, s, base = struct.unpack_from("<4I", blob, 4)
    left, right, lengths, seq = (np.frombuffer(blob, "<u4", k, 20 + 4 * at).astype(np.int64) for k, at in ((r, 0), (r, r), (r, 2 * r), (s, 3 * r)))
    return n, base, np.stack([left, right], axis=1), lengths, seq


def decode(blob: bytes) -> np.ndarray:
    n, base, rules, lengths, seq = unpack(blob)
    ids = expand(base, rules, lengths, seq)
    if len(ids) != n:
        raise ValueError("a shard's ids are incomplete")
    return ids


def decode_range(blob: bytes, start: int, stop: int) -> np.ndarray:
    """ids[start:stop], expanding only the symbols that cover it."""
    n, base, rules, lengths, seq = unpack(blob)
    start, stop = max(0, start), min(n, stop)
    if start >= stop:
        return np.zeros(0, np.uint32)
    ends = np.cumsum(np.where(seq >= base, lengths[np.maximum(seq - base, 0)] if len(lengths) else 1, 1))
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
    before = int(ends[a - 1]) if a else 0
    return expand(base, rules, lengths, seq[a : b + 1])[start - before : stop - before]


class Encoder:
    """The tokenizers library, called once for each distinct word.

    The byte-level pattern starts a new token at every space that a non-space follows, so cutting there
    never changes the ids (Python's white space includes all of the library's). A word here is what stands
    between two spaces; texts with other white space after a space, or a space at an end, are cut more carefully.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        #: Ids of words after a space.
        self.kept: dict[str, bytes] = {}
        self.cut = re.compile(r"(?= \S)").split
        added = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        # tokens that begin with a space, which byte-level vocabularies write so
        vocabulary = self.tok.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.marks, self.line = {"": b""}, self.whole("\n")

    def letters(self, run: str, space: str = "\u0120") -> bytes:
        """Ids of a run of letters after a space (or of one that none precedes), from the library's model."""
        spelt = run if run.isascii() else "".join(map(BYTES.__getitem__, run.encode()))
        return array("I", [t.id for t in self.model.tokenize(space + spelt)]).tobytes()

    def plain(self, word: str) -> bytes | None:
        """Ids of a word after a space that is lines of letters with marks behind them: tokens end where letters, marks and lines do. None for other words."""
        out, kept, space = [], self.kept, "\u0120"
        for line in word.split("\n"):
            if (m := PLAIN(line)) is None:
                return None
            run, marks = m.groups()
            key = run if space else "\n" + run  # of letters behind a line's end; no other word is kept under it
            if key not in kept:
                kept[key] = self.letters(run, space)
            out += [kept[key], self.marks[marks] if marks in self.marks else self.marks.setdefault(marks, self.whole(marks))]
            space = ""
        return self.line.join(map(b"".join, zip(out[::2], out[1::2])))

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, fresh: set[str]) -> None:
        """Keeps the ids of new words; many go through the library as one text, in which each begins with the only token that begins with a space."""
        kept, ends = self.kept, self.marks
        some = []
        tokenize = self.model.tokenize
        for w in fresh:
            run = w.rstrip(MARKS)
            if run.isalpha() and (run.isascii() or PLAIN(run)):  # most words: one run of letters, and marks
                if (x := kept.get(run)) is None:
                    x = kept[run] = array("I", [t.id for t in tokenize("\u0120" + run)]).tobytes() if run.isascii() else self.letters(run)
                if run != w:
                    marks = w[len(run) :]
                    if marks not in ends:
                        ends[marks] = self.whole(marks)
                    kept[w] = x + ends[marks]
            elif "\n" in w and (x := self.plain(w)) is not None:
                kept[w] = x
            elif w and not w[0].isspace() and not w[-1].isspace():
                some.append(w)
        groups = [some[at : at + 1024] for at in range(0, len(some), 1024)]
        for group, e in zip(groups, self.tok.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(group) and not starts[0]:
                raw, begin = ids.tobytes(), 0
                for w, end in zip(group, [*(4 * starts[1:]).tolist(), 4 * len(ids)]):
                    kept[w] = raw[begin:end]
                    begin = end
            else:
                kept.update((w, self.whole(" " + w)) for w in group)

    def _carefully(self, text: str) -> bytes:
        return b"".join(self.kept[c[1:]] if c[:1] == " " and c[1:] in self.kept else self.whole(c) for c in self.cut(text))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id."""
        end, kept = struct.pack("<I", END), self.kept
        texts = [_clean(t) if t else "" for t in texts]
        parts = [[] if self.added(t) else t.split(" ") for t in texts]  # an added token's string isn't cut like other text
        if len(kept) > KEPT:
            kept.clear()
        fresh = set().union(*(p[1:] for p in parts)).difference(kept)
        self.learn(fresh)
        out = []
        for t, p in zip(texts, parts):
            if not t:
                out.append(end)
            elif not p:
                out.append(self.whole(t) + end)
            elif p[0] and p[0][-1].isspace():
                out.append(self._carefully(t) + end)
            else:
                try:
                    out.append((self.whole(p[0]) if p[0] else b"") + b"".join(map(kept.__getitem__, p[1:])) + end)
                except KeyError:
                    out.append(self._carefully(t) + end)
        for w in fresh:
            if len(w) > KEPT_CHARS:
                kept.pop(w, None)
        return out


def _clean(text: str) -> str:
    try:
        text.encode("utf-8")
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode("utf-8")


@lru_cache(2)
def load(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


STORE = "part int, shard int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, blob binary"


def write(docs: DataFrame, path: str, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the shards of docs (doc_id, text). (part, shard) ascends with doc_id."""
    vocabulary = tokenizer or default_tokenizer()
    fields = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard = load(vocabulary), TaskContext.get().partitionId(), 0
        ids, held, n = [], [], 0

        def full() -> pa.RecordBatch:
            row = {"part": part, "shard": shard, "n_tokens": n, "doc_ids": ids, "doc_tokens": [len(x) // 4 for x in held], "blob": pack(np.frombuffer(b"".join(held), "<u4"))}
            return pa.RecordBatch.from_pylist([row], fields)

        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                for i, x in zip(some.column("doc_id").to_pylist(), enc.ids(some.column("text").to_pylist())):
                    if n and n + len(x) // 4 > shard_tokens:
                        yield full()
                        ids, held, n, shard = [], [], 0, shard + 1
                    ids.append(i)
                    held.append(x)
                    n += len(x) // 4
        if held:
            yield full()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("tie", F.xxhash64("text"))
    rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text").mapInArrow(run, STORE).write.mode("error").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    store = spark.read.schema(STORE).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {k: b.column(k)[i].as_py() for k in ("part", "shard", "doc_ids", "doc_tokens", "blob")}
                raw, ns = memoryview(decode(row["blob"]).astype("<u4").tobytes()), np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(ns)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), ns.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(ns), pa.int32()), pa.array([row["shard"]] * len(ns), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - ns), pa.array(ns), pa.array(crc, pa.int64())], ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"])

    each = store.select("part", "shard", "doc_ids", "doc_tokens", "blob").mapInArrow(run, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    sizes = store.select("part", "shard", "n_tokens")
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a write task
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead(Window.orderBy("part"))), F.lit(0)).alias("before_part"))
    starts = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(ahead(Window.partitionBy("part").orderBy("shard"))), F.lit(0)).alias("before"))
    starts = starts.join(parts, "part").select("part", "shard", (F.col("before_part") + F.col("before")).alias("before"))
    return each.join(starts, ["part", "shard"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op10_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.fresh_path(spark, "repair")
    write(shared.table(spark, sf_dir, "documents"), path)
    return read(spark, path)
