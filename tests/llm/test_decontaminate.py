"""Benchmark decontamination against brute force."""

import hashlib
import re
from pathlib import Path

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rubrica.llm import decontaminate, words

DOCS = "doc_id long, text string, items string, _raw int"
LONG = "start " + "filler word " * 4000 + "one two three four five six seven eight nine ten eleven. " + "Other Text, " * 3000
ITEMS = [
    (1, "One two, three; four five six seven eight nine TEN eleven?"), (2, "short item"), (3, None), (4, ""), (5, "?!"), (1, "One two, three; four five six seven eight nine TEN eleven?"),
    (12, "two three four five six seven eight nine ten eleven"), (None, "no id here"), (6, "Éa été 日本 x9"),
]
TEXTS = [
    (1, None, "x", 1), (2, "", "x", 1), (3, "nothing of the kind", "x", 1), (4, "a Short  ITEM, and a short\nitem again", "x", 1), (5, LONG, "x", 1),
    (5, LONG, "x", 1), (None, "short item", "x", 1), (6, "one two three four five six seven eight nine", "x", 1), (7, "é\x00Éa été 日本 X9! no id here", "x", 1),
    (8, "0 one two three four five six seven eight nine ten one two three four five six seven eight nine ten eleven", "x", 1), (9, "shortitem short-item", "x", 1),
]


def word_list(text):
    return re.findall(words.WORD, (text or "").translate(str.maketrans(words.UPPER, words.LOWER)))


def brute(items, text):
    ws, hit, names = word_list(text), set(), set()
    for i, item in items:
        iw = word_list(item)
        for win in {tuple(iw[k : k + 10]) for k in range(max(len(iw) - 9, 1))} if iw else ():
            for k in range(len(ws) - len(win) + 1):
                if tuple(ws[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    names.add("" if i is None else str(i))
    return len(ws), len(hit), sorted(names)


@pytest.mark.parametrize("part_bytes", [1 << 24, 60])
def test_against_brute_force(spark, part_bytes):
    docs, items = spark.createDataFrame(TEXTS, DOCS).repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.marked(docs.withColumn("k", F.col("text")), items, part_bytes=part_bytes).collect()
    assert len(got) == len(TEXTS) and got[0].__fields__[:4] == ["doc_id", "text", "_raw", "k"]
    for r in got:
        n, hit, names = brute(ITEMS, r["text"])
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items"]) == (n, hit, len(names), names), r["doc_id"]
        covered = [word_list(r["text"][s["start"] : s["end"]]) for s in r["spans"]]
        assert covered == [word_list(r["text"])[s["first"] : s["last"] + 1] for s in r["spans"]] and sum(map(len, covered)) == hit
        assert all(not re.match(words.WORD, x) for s in r["spans"] for x in (r["text"][s["end"] : s["end"] + 1],) if x and x.isascii())
    if part_bytes == 60:  # several parts: each window counts 16 bytes and its text
        assert decontaminate.windows(items).count() * 16 > part_bytes
    left = decontaminate.clean(docs, items, part_bytes=part_bytes)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 6]


@given(st.text(alphabet="aB é\n", max_size=200), st.lists(st.text(alphabet="ab é.", max_size=60), max_size=4), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_pieces_find_what_whole_texts_do(text, items, size):
    import pyarrow as pa

    rows = [(x, str(i)) for i, item in enumerate(items) if (iw := word_list(item)) for x in {" ".join(iw[k : k + 10]).encode() for k in range(max(len(iw) - 9, 1))}]
    s = decontaminate.Scanner(pa.table({"window": pa.array([x for x, _ in rows], pa.binary()), "item": pa.array([i for _, i in rows], pa.string())}))
    raw = text.encode()
    n, spans, found = s.scan(raw, size)
    assert (n, sum(b - a + 1 for a, b in spans), sorted(s.items[k] for k in found)) == brute(list(enumerate(items)), text)
    assert [x for p in words.pieces(raw, size) for x in p] == [x.encode() for x in word_list(text)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(TEXTS, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.marked(docs.where("false"), items).count() == 0
    assert decontaminate.marked(docs, items.where("false")).where("n_hit = 0 and n_items = 0").count() == len(TEXTS)


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    for name, rows, kinds in (("documents", TEXTS, DOCS), ("benchmark", ITEMS, "item_id long, text string")):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    for sf in (Path("/root/testdata/sf0.001"), tmp_path):
        got = decontaminate.op11_decontaminate(spark, str(sf))
        for name in ("documents", "benchmark"):
            con.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{sf / name}.parquet{'' if sf != tmp_path else '/*.parquet'}'")
        want = con.sql(decontaminate.OP11_SQL)
        key = lambda r: tuple(str(x) for x in r)
        assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)
    one = got.where("doc_id = 7").first()
    assert one["items_sha256"] == hashlib.sha256(b",6").hexdigest() and one["contaminated"]
