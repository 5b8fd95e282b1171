"""SentencePiece encoding and decoding of merge-type (BPE) models by a prefix table.

A merge-type encoding has one property the encoder rests on: every prefix of a text has a unique last
token. For each position the automaton gives the pieces that end there; a piece is the last token of
that prefix exactly if it encodes to itself and is compatible with the last token of the prefix before
it, that is, if the two side by side encode to themselves. The table of last tokens is filled from
left to right, the ids are then recovered backwards.

No piece holds the space mark after another character (checked when the model is loaded), so nothing
merges across the start of a word: texts are cut before each run of spaces and each distinct chunk is
encoded once and kept in a bounded table. The pieces that are only space marks share one score, so ties
break by position and a last token isn't unique; runs of two and more spaces are merged directly.
Characters that no piece holds become their UTF-8 bytes.

Words are invented faster than a table of them fills, so new chunks are encoded many at a time: the
automaton (a trie) runs from every position of all of them in step, the table of last tokens is filled
for all of them column by column, and known pair tests are kept in a hash table of integers.

Null and empty texts have no ids and decode to the empty text. Lone surrogates can't be UTF-8 and are
read as U+FFFD. The model's normaliser must be the identity (checked).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from . import shared

MARK = "▁"
#: Chunks kept by a Python worker, the longest that is kept, and the pair tests kept (they fit 2**20 places of an IntMap).
KEPT, KEPT_CHARS, PAIRS = 200_000, 64, 300_000
#: New chunks that are encoded at a time.
TOGETHER = 1 << 13


class IntMap:
    """From non-negative 64-bit keys to small values, in open-addressed arrays; -1 for what it doesn't hold."""

    def __init__(self, bits: int = 16):
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        mask = (1 << self.bits) - 1
        while len(left):
            at[left] = (at[left] + 1) & mask
            held = self.keys[at[left]]
            same = held == keys[left]
            out[left[same]] = self.values[at[left[same]]]
            left = left[~same & (held >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't in yet."""
        if 3 * (self.n + len(keys)) > 1 << self.bits:
            full = self.keys >= 0
            old, was, bits = self.keys[full], self.values[full], self.bits
            while 3 * (len(old) + len(keys)) > 1 << bits:
                bits += 1
            self.clear(bits)
            keys, values = np.concatenate([old, keys]), np.concatenate([was, values])
        self.n += len(keys)
        at, left, mask = self._slots(keys), np.arange(len(keys)), (1 << self.bits) - 1
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            won = free[self.keys[at[free]] == keys[free]]
            self.values[at[won]] = values[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & mask


class MergePieces:
    def __init__(self, model: bytes):
        m = proto.ModelProto()
        m.ParseFromString(model)
        n = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not (n.add_dummy_prefix and n.escape_whitespaces and m.trainer_spec.byte_fallback):
            raise ValueError("a merge-type model with byte fallback and the identity normaliser is needed")
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        self.rank = {p.piece: p.score for p in m.pieces if p.type == 1}
        self.text = [p.piece for p in m.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.plain = {i for i, p in enumerate(m.pieces) if p.type == 1}
        self.unknown = next((i for i, p in enumerate(m.pieces) if p.type == 2), None)
        self.alphabet = {c for p in self.ids for c in p}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a space mark after another character")
        self.trees: dict[str, tuple[str, str] | None] = {}
        self.edges: dict[tuple[str, bool], list[tuple[str, float, float]]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.found = ahocorasick.Automaton()
        for p in self.ids:
            if self.is_whole(p):
                self.found.add_word(p, p)
        self.found.make_automaton()
        self.cuts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.longest = max(map(len, self.ids))
        self.lengths = np.ones(len(m.pieces) + 1, np.int64)
        self.barrier = len(m.pieces)  # stands for a character that no piece holds
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for p, i in self.ids.items():
            self.lengths[i] = len(p)
            if self.is_whole(p):
                node = 0
                for c in p:
                    node = nodes.setdefault((node, ord(c)), len(nodes) + 1)
                ends[node] = i
        self.next = IntMap()
        self.next.add(np.array([n << 21 | c for n, c in nodes]), np.array(list(nodes.values()), np.int32))
        self.ends = np.full(len(nodes) + 1, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())
        self.tested = IntMap()
        self.words: dict[str, bytes] = {}
        self.decimal = [str(i) for i in range(len(m.pieces))]
        self.shown = [p.replace(MARK, " ") if i in self.plain else " ⁇ " if i == self.unknown else chr(b) if (b := self.of_byte.get(i)) is not None and b < 128 else "" for i, p in enumerate(self.text)]
        self.high = np.zeros(len(m.pieces), bool)
        self.high[[i for i, b in self.of_byte.items() if b > 127]] = True

    def merged(self, text: str, stop: bool = False) -> list[str]:
        """By merging the best-scored neighbours again and again, the leftmost of equals first; stop: until two parts are left."""
        part: list[str | None] = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        rank, heap = self.rank, []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(part) and (r := rank.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-r, i, len(part[i]), len(part[j])))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, n, k = heapq.heappop(heap)
            if part[i] is None or len(part[i]) != n or (j := after[i]) >= len(part) or len(part[j]) != k:
                continue
            if stop and i == 0 and after[j] >= len(part):
                break
            part[i] += part[j]
            part[j] = None
            after[i] = after[j]
            if after[i] < len(part):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in part if p is not None]

    def tree(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last merge of a piece joins; None for a character, and for a piece that merging never makes."""
        if piece not in self.trees:
            parts = None
            if len(piece) > 1 and self.merged(piece) == [piece]:
                parts = tuple(self.merged(piece, stop=True))
            self.trees[piece] = parts
        return self.trees[piece]

    def is_whole(self, piece: str) -> bool:
        return len(piece) == 1 or self.tree(piece) is not None

    def edge(self, piece: str, right: bool) -> list[tuple[str, float, float]]:
        """The parts of a piece along one edge, itself first: (part, when it is made, when it is merged into the next). Times are negated scores."""
        key = (piece, right)
        if (out := self.edges.get(key)) is None:
            out, until, p = [], float("inf"), piece
            while True:
                made = -self.rank[p] if len(p) > 1 else float("-inf")
                out.append((p, made, until))
                if len(p) == 1:
                    break
                until, p = made, self.tree(p)[right]
            self.edges[key] = out
        return out

    def compatible(self, left: str, right: str) -> bool:
        """Whether left + right encodes to the two: no merge of a part at left's end with one at right's start comes before both are merged into their own piece."""
        if (ok := self.pairs.get((left, right))) is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            ok = self.pairs[left, right] = self._compatible(left, right)
        return ok

    def _compatible(self, left: str, right: str) -> bool:
        rank, starts = self.rank, self.edge(right, False)
        for x, made, until in self.edge(left, True):
            for y, made_y, until_y in starts:
                if (score := rank.get(x + y)) is not None and (at := max(-score, made, made_y)) < until and at <= until_y:
                    return False
        return True

    def last_pieces(self, text: str) -> list[str]:
        """At i the last piece of text[: i + 1]. A character that no piece holds stands for itself."""
        last, known, one = list(text), [False] * len(text), self.pairs.get
        for at, piece in self.found.iter(text):
            if not known[at]:
                start = at + 1 - len(piece)
                if start == 0 or ((ok := one((last[start - 1], piece))) is None and self.compatible(last[start - 1], piece)) or ok:
                    last[at], known[at] = piece, True
        return last

    def split(self, text: str) -> list[str]:
        """The pieces of a chunk."""
        if MARK * 2 in text:
            return self.merged(text)
        last, i, out = self.last_pieces(text), len(text) - 1, []
        while i >= 0:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def to_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            else:
                out += (self.bytes[b] for c in p for b in c.encode("utf-8"))
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for c in self.cut(text):
            out += self.to_ids(self.split(c))
        return out

    def cut(self, text: str) -> list[str]:
        return self.cuts.findall(MARK + text.replace(" ", MARK)) if text else []

    def _tests(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 20 | right
        got = self.tested.get(keys)
        if (got < 0).any():
            fresh = np.unique(keys[got < 0])
            if self.tested.n > PAIRS:
                self.tested.clear()
            t = self.text
            self.tested.add(fresh, np.array([self._compatible(t[k >> 20], t[k & 0xFFFFF]) for k in fresh.tolist()], np.int32))  # kept here, in few bytes
            return self._tests(left, right)
        return got > 0

    def split_all(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids of all chunks one after another (-1 - code point for a character that no piece holds), and how many each has. No chunk is empty or has two space marks side by side."""
        c = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        first = np.cumsum(size) - size
        start = np.repeat(first, size)
        stop = np.repeat(first + size, size)
        # all pieces at all places
        at, node, found = np.arange(len(c)), np.zeros(len(c), np.int64), []
        for k in range(self.longest):
            node = self.next.get(node << 21 | c[at + k]).astype(np.int64)
            alive = node >= 0
            at, node = at[alive], node[alive]
            piece = self.ends[node]
            hit = piece >= 0
            found.append((at[hit], at[hit] + k, piece[hit]))
            more = at + k + 1 < stop[at]
            at, node = at[more], node[more]
            if not len(at):
                break
        begin, end, piece = (np.concatenate(x) for x in zip(*found))
        column = end - start[end]
        order = np.argsort(column, kind="stable")
        begin, end, piece, column = begin[order], end[order], piece[order], column[order]
        last = np.full(len(c), self.barrier, np.int64)
        edges = np.searchsorted(column, np.arange((column[-1] if len(column) else -1) + 2))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            i, e, p = begin[a:b], end[a:b], piece[a:b]
            ok = i == start[e]
            inner = np.flatnonzero(~ok)
            before = last[i[inner] - 1]
            free = before == self.barrier
            ok[inner[free]] = True
            inner, before = inner[~free], before[~free]
            ok[inner] = self._tests(before, p[inner])
            last[e[ok]] = p[ok]
        # backwards
        where, pos, steps = np.arange(len(chunks)), first + size - 1, []
        count = np.zeros(len(chunks), np.int64)
        while len(where):
            token = last[pos]
            steps.append((where, np.where(token == self.barrier, -1 - c[pos], token)))
            count[where] += 1
            pos = pos - self.lengths[token]
            stays = pos >= first[where]
            where, pos = where[stays], pos[stays]
        out = np.empty(int(count.sum()), np.int64)
        ends = np.cumsum(count)
        for k, (w, token) in enumerate(steps):
            out[ends[w] - 1 - k] = token
        return out, count

    def learn(self, fresh: list[str]) -> None:
        """Keeps the ids of the chunks that a space mark and these words make; those with further marks in them aren't words."""
        for at in range(0, len(fresh), TOGETHER):
            some = fresh[at : at + TOGETHER]
            ids, count = self.split_all([MARK + w for w in some])
            raw, end = ids.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
            odd = set(np.repeat(np.arange(len(some)), count)[ids < 0].tolist())
            begin = 0
            for i, (w, e) in enumerate(zip(some, end)):
                self.words[w] = raw[begin:e] if i not in odd else self.with_bytes(ids[begin // 4 : e // 4])
                begin = e

    def with_bytes(self, ids: np.ndarray) -> bytes:
        """Ids as split_all gives them, with the bytes of characters that no piece holds."""
        out: list[int] = []
        for i in ids.tolist():
            if i >= 0:
                out.append(i)
            else:
                out += (self.bytes[b] for b in chr(-1 - i).encode("utf-8"))
        return np.array(out, "<u4").tobytes()

    def forget(self) -> None:
        self.words.clear()
        self.pairs.clear()
        self.tested.clear()

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        kept, cut = self.words, []
        for t in texts:
            t = _valid(t)
            if not t:
                cut.append([])
            elif "  " in t or MARK in t or t[0] == " " or t[-1] == " ":
                cut.append([c[1:] if len(c) > 1 and c[0] == MARK and c[1] != MARK else (c,) for c in self.cut(t)])
            else:
                cut.append(t.split(" "))
        fresh = list({w for words in cut for w in words if w not in kept and isinstance(w, str)})
        if len(kept) + len(fresh) > KEPT:
            kept.clear()
            fresh = list({w for words in cut for w in words if isinstance(w, str)})
        self.learn(fresh)
        out = []
        for words in cut:
            out.append(np.frombuffer(b"".join([kept[w] if isinstance(w, str) else np.array(self.to_ids(self.split(w[0])), "<u4").tobytes() for w in words] if any(isinstance(w, tuple) for w in words) else map(kept.__getitem__, words)), "<u4"))
        for w in fresh:
            if len(w) > KEPT_CHARS:
                del kept[w]
        return out

    def raw(self, ids: list[int]) -> str:
        """The decoded text before the leading space is dropped."""
        out, held = [], bytearray()
        for i in ids:
            if (b := self.of_byte.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            out.append(self.text[i].replace(MARK, " ") if i in self.plain else " ⁇ " if i == self.unknown else "")
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.raw(ids).removeprefix(" ")

    def shown_text(self, ids: np.ndarray) -> str:
        """What decode gives."""
        return self.decode(ids.tolist()) if self.high[ids].any() else "".join(map(self.shown.__getitem__, ids.tolist())).removeprefix(" ")

    def decimals(self, ids: np.ndarray) -> str:
        return ",".join(map(self.decimal.__getitem__, ids.tolist()))


def _valid(text: str | None) -> str:
    try:
        (text or "").encode("utf-8")
        return text or ""
    except UnicodeEncodeError:
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


@lru_cache(2)
def load(path: str) -> MergePieces:
    """A Python worker loads a model once; the vocabulary file is part of the installation on every machine."""
    with open(path, "rb") as f:
        return MergePieces(f.read())


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs with n_tokens long, piece_ids array<int> and decoded string. The general form; one pass, no shuffle."""
    shared.small_batches(docs.sparkSession)
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(path)
        shared.holding("pieces", m.forget)
        for b in shared.slices(batches):
            ids = m.encode_all(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([m.shown_text(x) for x in ids], pa.string())], [*b.schema.names, "n_tokens", "piece_ids", "decoded"])

    kept = docs.drop("n_tokens", "piece_ids", "decoded")
    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "n_tokens long, piece_ids array<int>, decoded string"]))


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    shared.small_batches(docs.sparkSession)
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(path)
        shared.holding("pieces", m.forget)
        for b in shared.slices(batches):
            rows = [(len(x), hashlib.sha256(m.decimals(x).encode()).hexdigest(), hashlib.sha256(m.shown_text(x).encode()).hexdigest()) for x in m.encode_all(b.column("text").to_pylist())]
            n, a, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(shared.table(spark, sf_dir, "documents"))
