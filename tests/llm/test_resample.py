"""Importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from rubrica.llm import resample, words

DOCS = "doc_id long, text string, rank string, weight string"


def word_list(text):
    return re.findall(words.WORD, (text or "").translate(str.maketrans(words.UPPER, words.LOWER)))


def buckets(text, n=10000):
    ws = word_list(text)
    return [zlib.crc32(" ".join(ws[i : i + k]).encode()) % n for k in (1, 2, 3) for i in range(len(ws) - k + 1)]


def brute(docs, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(buckets(x))
    for x in target:
        t.update(buckets(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)}
    rows = []
    for i, x in docs:
        f = buckets(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(word_list(x))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1]))
    most = percent * len(able) // 100
    return sorted(((*r[:4], k + 1 if k < most else None) for k, r in enumerate(able)), key=str), sorted(((*r[:4], None) for r in rows if r[4] < least), key=str)


def compare(got, docs, target, **how):
    able, rest = brute(docs, target, **how)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(able + rest, key=str)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet").collect()
    got = resample.op13_resample(spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {k for _, k in got.dtypes} == {"bigint"}
    compare(got, [(r["doc_id"], r["text"]) for r in read("documents")], [r["text"] for r in read("benchmark")])
    assert got.where("rank is not null").count() > 0


def test_odd_rows(spark):
    hot = "the very same text of twenty words " * 4
    docs = [(7, hot)] * 60 + [(i, hot) for i in range(100, 160)] + [(1, None), (2, ""), (3, "?!"), (4, "one"), (5, "Éa B-c 日本 " * 30), (None, hot), (None, None), (6, "long " * 3000 + "w" * 200 + " " + "x" * 70 + " end here")]
    target = ["the very same words", None, "日本 éa", "w" * 200 + " " + "x" * 70]
    d = spark.createDataFrame([(i, x, "r", "w") for i, x in docs], DOCS).repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    compare(resample.resampled(d, t, percent=30), docs, target, percent=30)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c " * 10, "r", "w")], DOCS)
    t = spark.createDataFrame([("x",)], "text string")
    assert resample.resampled(d.where("false"), t).count() == 0
    compare(resample.resampled(d, t.where("false"), percent=100), [(1, "a b c " * 10)], [], percent=100)


@given(st.lists(st.lists(st.sampled_from([b"a", b"bb", b"\xc3\xa9", b"x" * 63, b"x" * 64, b"long" * 30]), min_size=1, max_size=12), min_size=1, max_size=4), st.integers(0, 2))
@settings(max_examples=150, deadline=None)
def test_trie(texts, carried):
    held = [(x, min(carried, len(x) - 1)) for x in texts]
    trie = resample.Trie(held)
    want, gain, sums = Counter(), np.arange(10000) - 4000, []
    for x, c in held:
        runs = [zlib.crc32(b" ".join(x[i : i + k])) % 10000 for k in (1, 2, 3) for i in range(len(x) - k + 1) if i + k > c]
        want.update(runs)
        sums.append(sum(int(gain[b]) for b in runs))
    got = trie.totals()
    assert {b: int(n) for b, n in enumerate(got) if n} == dict(want) and trie.sums(gain).tolist() == sums


@given(st.text(alphabet="aB é\n", max_size=300), st.integers(1, 50))
@settings(max_examples=100, deadline=None)
def test_stretches_count_each_run_once(text, size):
    total = np.zeros(10000, np.int64)
    for _, held in resample.stretches([text.encode()], size):
        total += resample.Trie(held).totals()
    assert {b: int(n) for b, n in enumerate(total) if n} == dict(Counter(buckets(text)))
