"""Language identification by interpolated Kneser-Ney character models.

One model per language predicts each character of a word and its end from the four characters before
it, inside the word and its boundary. An order's n-grams and contexts lie in sorted arrays of 64-bit
hashes with their probabilities and back-off weights beside them; looking up is a binary search, one
for all languages at a place, as their arrays are joined with a column for each language. A
text gets the language of the lowest cross-entropy in bits a character. A document is rejected if that
entropy lies further above what the language's own documents have than chance explains; the bound is
calibrated on labelled documents the models haven't seen.

Models are fitted on a bounded sample: of each language at most ``FIT`` documents, and ``CALIBRATE``
more for the bounds, taken by a hash of the id. Every other step covers all rows and whole texts.

Texts that are null or have no letter: ``und``, score 0, rejected. Equal entropies: the language first
in the alphabet. Without any labelled document everything is ``und``. Null ids aren't held out. Repeated rows get equal values.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from . import shared

FIT, CALIBRATE, ORDER = 300, 150, 5
#: Bits a character above a language's mean that are never rejected; chance deviations allowed; characters that a score counts at most.
SLACK, DEVIATIONS, SCORED = 2.0, 4.0, 200
WORDS = re.compile(r"[^\W\d_]+")
KEPT = 200_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def codes(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the padded words, and which of them are predicted."""
    pad = " " * (ORDER - 1)
    c = np.frombuffer("".join(f"{pad}{w} " for w in some).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    said = np.ones(len(c), dtype=bool)
    starts = np.cumsum([0, *(len(w) + ORDER for w in some)])[:-1]
    for k in range(ORDER - 1):
        said[starts + k] = False
    return c, said


def hashes(c: np.ndarray) -> list[np.ndarray]:
    """At k - 1 the hashes of the k-grams that end at each position; the first few positions have none that is used."""
    out = [(c + np.uint64(1)) * M1]
    for k in range(1, ORDER):
        h = np.zeros_like(c)
        h[k:] = (c[:-k] + np.uint64(1)) * M1
        x = (out[-1] ^ (h + np.uint64(k))) * M2
        out.append(x ^ (x >> np.uint64(29)))
    return out


@dataclass
class CharacterModel:
    """grams[k], probs[k], contexts[k], weights[k]: of order k + 1; floor: the weight of an unseen character."""

    grams: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: float

    @classmethod
    def fit(cls, counts: dict[str, int]) -> CharacterModel:
        some = sorted(counts)
        c, said = codes(some)
        hs = hashes(c)
        times = np.repeat(np.array([counts[w] for w in some], dtype=np.float64), [len(w) + ORDER for w in some])[said]
        at = np.flatnonzero(said)
        grams, probs, contexts, weights = [None] * ORDER, [None] * ORDER, [None] * ORDER, [None] * ORDER
        for k in range(ORDER - 1, -1, -1):
            gram = hs[k][at]
            before = hs[k - 1][at - 1] if k else np.zeros(len(at), dtype=np.uint64)
            if k == ORDER - 1:
                u, first, back = np.unique(gram, return_index=True, return_inverse=True)
                n = np.bincount(back, weights=times)
            else:
                # continuation counts: the distinct (k + 2)-grams that end in this one
                longer = np.unique(hs[k + 1][at], return_index=True)[1]
                u, first, back = np.unique(gram[longer], return_index=True, return_inverse=True)
                n, first = np.bincount(back).astype(np.float64), longer[first]
            ctx, where = np.unique(before[first], return_inverse=True)
            total, kinds = np.bincount(where, weights=n), np.bincount(where)
            ones, twos = (n == 1).sum(), (n == 2).sum()
            d = min(0.95, max(0.1, ones / max(1.0, ones + 2.0 * twos)))
            grams[k], probs[k] = u, np.maximum(n - d, 0) / total[where]
            contexts[k], weights[k] = ctx, d * kinds / total
        return cls(grams, probs, contexts, weights, 1 / (len(grams[0]) + 1))

    def bits(self, hs: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Of each predicted character."""
        p = np.full(len(at), self.floor)
        for k in range(ORDER):
            before = hs[k - 1][at - 1] if k else np.zeros(len(at), dtype=np.uint64)
            p = self._at(self.grams[k], self.probs[k], hs[k][at], 0.0) + p * self._at(self.contexts[k], self.weights[k], before, 1.0)
        return -np.log2(np.maximum(p, 1e-12))

    @staticmethod
    def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[i] == wanted, values[i], default)


class JointModels:
    """The models of several languages over one sorted array of hashes an order, a column for each language.

    keys[k] holds the (k + 1)-grams that any language predicts or predicts from; one search finds the row of
    probs[k] (its own, as an n-gram) and of weights[k] (of order k + 2, whose context it is). The last row is for what isn't there.
    """

    def __init__(self, models: list[CharacterModel]):
        self.first, self.floor = np.array([m.weights[0][0] for m in models]), np.array([m.floor for m in models])
        self.keys, self.probs, self.weights = [], [], []
        for k in range(ORDER):
            told = [m.contexts[k + 1] for m in models] if k + 1 < ORDER else []
            keys = np.unique(np.concatenate([*(m.grams[k] for m in models), *told]))
            p, w = np.zeros((len(keys) + 1, len(models))), np.ones((len(keys) + 1, len(models)))
            for i, m in enumerate(models):
                p[np.searchsorted(keys, m.grams[k]), i] = m.probs[k]
                if told:
                    w[np.searchsorted(keys, m.contexts[k + 1]), i] = m.weights[k + 1]
            self.keys.append(keys)
            self.probs.append(p)
            self.weights.append(w if told else None)

    def bits(self, hs: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Of each predicted character under each model."""
        p = np.broadcast_to(self.floor, (len(at), len(self.floor)))
        weight = self.first
        for k, keys in enumerate(self.keys):
            i = np.minimum(np.searchsorted(keys, hs[k]), len(keys) - 1)
            i[keys[i] != hs[k]] = len(keys)
            p = self.probs[k][i[at]] + p * weight
            if k + 1 < ORDER:
                weight = self.weights[k][i[at - 1]]
        return -np.log2(np.maximum(p, 1e-12))


class Identifier:
    """The models of all languages and the bounds of what they accept: of each language (mean, scale)."""

    def __init__(self, models: dict[str, CharacterModel], bounds: dict[str, tuple[float, float]] | None = None):
        self.langs, self.bounds = sorted(models), bounds or {}
        self.joint = JointModels([models[x] for x in self.langs]) if models else None
        self.forget()

    def forget(self) -> None:
        """Words seen so far: the row of each, and in the rows its bits under each model and its characters."""
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.langs) + 1))

    def __getstate__(self):
        return {"langs": self.langs, "joint": self.joint, "bounds": self.bounds, "known": {}, "rows": np.zeros((0, len(self.langs) + 1))}

    def _word_bits(self, some: list[str]) -> np.ndarray:
        out = np.empty((len(some), len(self.langs) + 1))
        for at in range(0, len(some), 20_000):
            part = some[at : at + 20_000]
            c, said = codes(part)
            starts = np.cumsum([0, *(len(w) + 1 for w in part)])[:-1]
            out[at : at + len(part), :-1] = np.add.reduceat(self.joint.bits(hashes(c), np.flatnonzero(said)), starts, axis=0)
            out[at : at + len(part), -1] = [len(w) + 1 for w in part]
        return out

    def entropies(self, texts: list[str | None]) -> list[tuple[np.ndarray, float]]:
        """Of each text: bits a character under each model, and the characters."""
        counted = [Counter(words(t)) for t in texts]
        fresh = list(dict.fromkeys(w for c in counted for w in c if w not in self.known))
        if len(self.known) + len(fresh) > KEPT:
            self.forget()
            fresh = list(dict.fromkeys(w for c in counted for w in c))
        if fresh:
            at = len(self.known)
            self.known.update((w, at + i) for i, w in enumerate(fresh))
            self.rows = np.vstack([self.rows, self._word_bits(fresh)])
        out = []
        for c in counted:
            i = np.fromiter(map(self.known.__getitem__, c), dtype=np.int64, count=len(c))
            sums = np.fromiter(c.values(), dtype=np.float64, count=len(c)) @ self.rows[i] if c else np.zeros(len(self.langs) + 1)
            out.append((sums[:-1] / max(1.0, sums[-1]), float(sums[-1])))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """Language, score, bits a character, rejected."""
        out = []
        for t, (h, n) in zip(texts, self.entropies(texts) if self.langs else [(None, 0.0)] * len(texts)):
            if not n or not has_letter(t):
                out.append(("und", 0.0, None, True))
                continue
            best = int(np.argmin(h))
            score = 1 / float(np.exp2(-(h - h[best]) * min(n, SCORED)).sum())
            mean, scale = self.bounds.get(self.langs[best], (np.inf, 0.0))
            out.append((self.langs[best], score, float(h[best]), bool(h[best] > mean + SLACK + DEVIATIONS * scale / np.sqrt(n))))
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, fit: int = FIT, calibrate: int = CALIBRATE) -> Identifier:
    """From the rows of docs (doc_id, text, lang) that have a text and a lang and aren't held out; reads no other column."""
    rows = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Identifier({})
    order, wanted = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), fit + calibrate
    taken = F.lit(False)
    for lang, n in sizes.items():
        taken = taken | ((F.col("lang") == lang) & (order < int(min(1.0, (1.5 * wanted + 50) / n) * (1 << 30))))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id", "text"))
    sample = shared.cut(rows.withColumn("order", order).where(taken).withColumn("place", place).where(F.col("place") <= wanted).withColumn("fits", F.col("place") % (fit + calibrate) % 3 != 2))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, Counter] = defaultdict(Counter)
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                by[lang].update(words(t))
            flat = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(flat, columns=["lang", "word", "n"]).astype({"n": "int64"}), pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]), preserve_index=False)

    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in sample.where("fits").select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["lang"]][r["word"]] = r["n"]
    made = Identifier({lang: CharacterModel.fit(c) for lang, c in counts.items()})
    if not made.langs:
        return made

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.slices(batches):
            got, at = made.entropies(b.column("text").to_pylist()), [made.langs.index(x) if x in made.langs else -1 for x in b.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([float(h[i]) for (h, _), i in zip(got, at)], pa.float64()), pa.array([n for _, n in got], pa.float64())], ["lang", "h", "n"])

    unseen = sample.where("not fits").select("lang", "text").mapInArrow(measure, "lang string, h double, n double").where("n > 0").toPandas()
    for lang, g in unseen.groupby("lang"):
        h, n = g["h"].to_numpy(), g["n"].to_numpy()
        made.bounds[lang] = (float(np.average(h, weights=n)), float(np.sqrt(np.mean((h - np.average(h, weights=n)) ** 2 * n))))
    return made


SCHEMA = "lang_pred string, score double, bits_per_char double, rejected boolean"


def identify(docs: DataFrame, learned: Identifier) -> DataFrame:
    """docs with lang_pred, score, bits_per_char and rejected, from the text alone; one pass, no shuffle.

    The models, bounded by the sample they were fitted on, travel in a broadcast variable.
    """
    shared.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        shared.holding("language", m.forget)
        for b in shared.slices(batches):
            lang, score, bits, no = zip(*m.predict(b.column("text").to_pylist())) if b.num_rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(no, pa.bool_())], [*b.schema.names, "lang_pred", "score", "bits_per_char", "rejected"])

    kept = docs.drop("lang_pred", "score", "bits_per_char", "rejected")
    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), SCHEMA]))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_char", "rejected")
