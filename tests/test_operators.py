import json
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rubrica.functions import text as t, vocab as v
from rubrica.operators import evaluate, extract, metrics, passages as ps, prompts
from rubrica.sources import files
from rubrica.streaming import incremental

RAW = [
    (None, None, None), ("   ", None, None), ("QUESTION: a b\nANSWER: c", "a b", "c"), ("ANSWER: c\nQUESTION: a", "a", "c\nQUESTION: a".replace("\n", " ")), ("question: a answer: c", "a", "c"),
    ("QUESTION: only", "only", None), ("Q: x\nA: y", "x", "y"), ("What is it? Rest here", "What is it?", "Rest here"), ("What?", "What?", None), ("? x", "? x", None),
    ("one\n\ntwo\nthree", "one", "two three"), ("single line", "single line", None), ('"quoted"', "quoted", None), ("1. numbered", "numbered", None), ('QUESTION: Question: a\nANSWER: 2) b', "a", "b"), ('"', None, None),
    ("'a' b", "'a' b", None), ("QUESTION:  \nANSWER: z", "z", "z"), ("QUESTION: 1.\u00a0Question: What is x?\nANSWER: \u0663) y", "What is x?", "y"), ("Q:\u3000a\u2003b\nA:\u00a0c", "a b", "c"),
]


def test_extraction(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(RAW)], "i int, r string")
    got = {x["i"]: (x["qa"]["question"], x["qa"]["answer"]) for x in df.select("i", extract.extract_qa(F.col("r")).alias("qa")).collect()}
    for i, (r, q, a) in enumerate(RAW):
        assert got[i] == (q, a), r


PASSAGES = "passage_id string, text string, key_concepts array<string>, methods_principles array<string>"


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_last_passage_of_an_id_wins(spark, parts):
    rows = [("p", "zz old", ["a"], [], 1), ("q", "other", [], [], 2), ("p", "new", ["b"], None, 9), ("p", "mid", ["c"], None, 3), (None, "none", [], [], 4)]
    known = spark.createDataFrame(rows, PASSAGES + ", read_order int").repartition(parts)
    gens = spark.createDataFrame([(7, "p", None), (8, "none", "standard"), (9, None, None)], "gen_id long, passage_id string, mode string")
    got = {r["gen_id"]: r for r in evaluate.bound(gens, known).collect()}
    assert len(got) == 3 and (got[7]["passage"], got[7]["key_concepts"], got[7]["mode"]) == ("new", ["b"], "standard") and got[8]["passage"] is None and got[9]["passage"] is None
    # without a reading order the greatest text wins, whatever the partitions
    assert evaluate.bound(gens, known.drop("read_order")).where("gen_id = 7").first()["passage"] == "zz old" and evaluate.bound(gens, known.drop("read_order")).count() == 3


def test_last_passage_as_read_from_files(spark, tmp_path):
    for folder, texts in (("physics", ["third", "fourth"]), ("biology", ["first", "second"]), ("zoology", ["fifth"])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "passages.json").write_text(json.dumps([{"passage_id": "x" if t != "second" else "y", "text": f"{t} Alpha Beta of {t}"} for t in texts]))
    gens = spark.createDataFrame([(1, "x", "standard"), (2, "y", "standard")], "gen_id long, passage_id string, mode string")
    for parts in (1, 5):
        known = ps.processed(files.read_passages(spark, str(tmp_path)).repartition(parts))
        got = {r["gen_id"]: r for r in evaluate.bound(gens, known).collect()}
        assert got[1]["passage"].startswith("fifth") and got[2]["passage"].startswith("second") and got[1]["key_concepts"] == ["alpha beta", "fifth"]
    (tmp_path / "zoology" / "passages.json").unlink()
    assert evaluate.bound(gens, files.read_passages(spark, str(tmp_path))).where("gen_id = 1").first()["passage"].startswith("fourth")  # the subjects' order, not the paths'


def test_concepts_need_no_shuffle(spark):
    docs = spark.createDataFrame([("a", "alpha alpha words words", [], []), ("a", "beta beta words words", None, None), ("b", "", ["kept"], None), ("c", None, None, ["m"])], PASSAGES)
    plan = ps.processed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Exchange" not in ps.key_concepts(docs)._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["passage_id"], r["key_concepts"], r["methods_principles"]) for r in ps.processed(docs).collect())
    assert got == [("a", ["alpha", "words"], []), ("a", ["beta", "words"], []), ("b", ["kept"], []), ("c", [], ["m"])]


@given(st.lists(st.sampled_from(["cell", "wall", "energy", "that", "abc", "Cell"]), max_size=30))
@settings(max_examples=15, deadline=None)
def test_concepts_against_counting(spark, words):
    stop = set(v.CONCEPT_STOP_WORDS)
    counts = Counter(w for w in (x.lower() for x in words) if len(w) >= 4 and w not in stop)
    want = [w for w, n in counts.most_common(16) if n >= 2][:8]
    assert spark.createDataFrame([(" ".join(w.lower() for w in words),)], "x string").select(ps.concepts(F.col("x"))).first()[0] == want


def test_think_blocks(spark):
    df = spark.createDataFrame([("<think>a\nb</think>  c", "deepseek-r1:14b"), ("<think>a</think> c", "phi4:14b")], "r string, m string")
    assert [x[0] for x in df.select(extract.strip_think(F.col("r"), F.col("m"))).collect()] == ["c", "<think>a</think> c"]


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(t.stem(F.lit("running"))) == "runn" and one(t.stem(F.lit("sing"))) == "sing" and one(t.stem(F.lit("boxes"))) == "box"
    assert one(t.tokens(F.lit("Été a_b 3x-y"))) == ["été", "a_b", "3x", "y"]
    assert one(t.ascii_tokens(F.lit("a_b é1c"))) == ["a", "b", "c"]
    words = " ".join(f"w{i}" for i in range(900))
    assert one(t.cut_section(F.lit("a " * 299))) is None and one(t.cut_section(F.lit(words))) == " ".join(words.split()[:500])
    dotted = " ".join(f"w{i}." if i == 450 else f"w{i}" for i in range(900))
    assert one(t.cut_section(F.lit(dotted))).endswith("w450.")
    assert one(t.clean(F.lit("x " * 10))) is None and one(t.clean(F.lit("’ " + "x" * 160))).startswith("' x")
    assert one(t.first_of(F.lit("state who"), ["who", "state"])) == "who"


def test_concepts(spark):
    text = "The Golgi Apparatus and the Golgi Apparatus. Cells make energy; energy feeds cells, cells grow with energy cells."
    df = spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "passage_id string, text string")
    got = {r["passage_id"]: r["key_concepts"] for r in ps.key_concepts(df).collect()}
    assert got["a"] == ["the golgi apparatus", "golgi apparatus", "cells", "energy", "golgi", "apparatus"] and got["b"] == []
    m = spark.createDataFrame([("Newton's law and the theory of relative motion, then the scientific method.",)], "x string").select(ps.methods_principles(F.col("x"))).first()[0]
    assert "newton's law" in m and "relative motion" in m


def test_pages():
    html = "<main><nav><p>menu</p></nav><p>Hello <b>big</b> world</p><div class='exercise'><p>no</p></div><figure><p>no</p></figure></main>"
    assert ps.page_paragraphs(html) == ["Hello big world"]
    assert ps.page_paragraphs("<article><p>x</p></article>") is None and ps.page_paragraphs("<article><p>x</article>", ps.CONTAINERS) == ["x"] and ps.page_paragraphs(None) is None


def test_sampling_and_ids(spark):
    df = spark.createDataFrame([("biology", i) for i in range(40)] + [("art", i) for i in range(3)], "s string, k int")
    got = sorted(r["k"] for r in ps.evenly(df, 15, "s", "k").where("s = 'biology'").collect())
    assert got == [int(i * (40 / 15)) for i in range(15)] and sorted(r["k"] for r in ps.evenly(df.repartition(9), 15, "s", "k").where("s = 'biology'").collect()) == got and ps.evenly(df, 15, "s", "k").where("s = 'art'").count() == 3
    assert ps.with_ids(df, "s", "k").where("k = 2").orderBy("s").select("passage_id").collect()[1][0] == "bio_003"
    toc = spark.createDataFrame([("1-2-cells", "<b>Cells</b>"), ("1-introduction", "x"), ("2-key-terms", "y"), ("preface", "z")], "slug string, title string")
    assert [tuple(r) for r in ps.content_pages(toc).collect()] == [("1-2-cells", "Cells")]


def evaluations(spark, rows):
    schema = f"gen_id long, model string, mode string, level int, subject string, constraints {evaluate.RESULT}, all_passed boolean"
    return spark.createDataFrame(rows, schema)


def r(i, passed, score, tier="universal"):
    return (i, i, passed, score, "why", tier)


def test_metrics(spark):
    e = evaluations(spark, [
        (1, "m", "standard", 1, "s", [r("U1", True, 1.0), r("D2", True, 0.31, "structural")], True),
        (2, "m", "standard", 2, None, [], False), (3, "m", "standard", 1, "s", [r("U1", False, 0.5)], False), (4, "m", "adversarial", 1, "s", [r("U1", False, 0.0)], False),
    ])
    strict = {x["mode"]: x for x in metrics.prompt_strict(e).collect()}
    loose = {x["mode"]: x for x in metrics.prompt_loose(e).collect()}
    assert (strict["standard"]["n_pass"], strict["standard"]["n_total"]) == (1, 3)
    assert (loose["standard"]["n_pass"], loose["standard"]["n_empty"]) == (2, 1)  # the empty record and the 0.5; not the strict pass
    assert metrics.constraint_strict(e).where("mode='standard'").first()["n_total"] == 3
    g = metrics.gap(e, ["model"]).first()
    assert (g["standard"], g["adversarial"], g["gap"]) == (0.3333, 0.0, 0.3333) and metrics.by_subject(e).where("subject='unknown'").count() == 1
    assert metrics.prompt_strict(e.where("false")).count() == 0


def test_bootstrap(spark):
    e = evaluations(spark, [(i, "m", "standard", 1, "s", [], i % 3 == 0) for i in range(50)])
    got = metrics.bootstrap(e).first()
    x = np.array([i % 3 == 0 for i in range(50)], float)
    rng = np.random.RandomState(42)
    means = [rng.choice(x, size=50, replace=True).mean() for _ in range(1000)]
    assert (got["ci_low"], got["ci_high"]) == (np.percentile(means, 2.5), np.percentile(means, 97.5))
    assert (got["ci_low"], got["ci_high"]) == (0.22, 0.46)  # a stored result
    assert metrics.interval(np.array([1.0])) == (1.0, 1.0) and metrics.interval(np.array([])) == (0.0, 0.0)


def test_intervals_by_level_and_of_large_groups(spark):
    rows = [(i, m, "standard", i % 7, None, [], i % 3 == 0) for m in ("a", None) for i in range(3000)]
    e = evaluations(spark, rows).repartition(6)
    exact = {(r["model"], r["level"]): r for r in metrics.by_level_interval(e).collect()}
    assert len(exact) == 12 and all(r["n"] in (428, 429) and r["ci_low"] < r["rate"] < r["ci_high"] for r in exact.values())
    by = {r["model"]: r for r in metrics.bootstrap(e, exact=100).collect()}
    seen = {r["model"]: r for r in metrics.bootstrap(e).collect()}
    for m in ("a", None):  # the same distribution: ends agree to a tenth of the width
        assert by[m]["n"] == seen[m]["n"] == 3000 and by[m]["rate"] == seen[m]["rate"]
        assert abs(by[m]["ci_low"] - seen[m]["ci_low"]) < 0.1 * (seen[m]["ci_high"] - seen[m]["ci_low"]) and abs(by[m]["ci_high"] - seen[m]["ci_high"]) < 0.1 * (seen[m]["ci_high"] - seen[m]["ci_low"])
    both = metrics.bootstrap(e.where("level < 3 or model is not null"), ["model"], exact=2000).collect()
    assert sorted(r["n"] for r in both) == [1287, 3000]
    plan = metrics.bootstrap(e, exact=100)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan
    assert metrics.interval_of_counts(0, 0) == (0.0, 0.0) and metrics.interval_of_counts(1, 1) == (1.0, 1.0) and metrics.interval_of_counts(10**9, 0) == (0.0, 0.0)


def test_running_counts_over_ranges(spark):
    rows = [(i, m, "standard", 1, None, [], i % 3 == 0) for m in ("a", "b") for i in range(500)] + [(7, "c", "standard", 1, None, [], True)] * 60
    got = {(r["model"], r["done"]): r["passed"] for r in metrics.progress(evaluations(spark, rows).repartition(9), 50).collect()}
    assert got == {(m, n): sum(i % 3 == 0 for i in range(n)) for m in ("a", "b") for n in range(50, 501, 50)} | {("c", 50): 50}
    plan = metrics.placed(spark.createDataFrame(rows, "gen_id long, model string, mode string, level int, subject string, constraints array<string>, all_passed boolean").select("model", "gen_id"), ["model"], "gen_id")
    assert plan.where("model = 'c'").agg(F.max("_at")).first()[0] == 60 and sorted(r["_at"] for r in plan.where("model = 'a'").collect()) == list(range(1, 501))


@given(st.integers(0, 3000), st.integers(1, 3000))
@settings(max_examples=60, deadline=None)
def test_rounding_is_pythons(spark, n, total):
    xs = [n / total, (2 * n + 1) / 2e4, n / 20000, -n / total, n / 32]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", t.rounded(F.col("x")).alias("r")).collect()
    assert [r["r"] for r in got] == [round(r["x"], 4) for r in got]


def test_gates(spark):
    rows = [("a", "standard", None)] * 9 + [("a", "standard", "x")] + [("a", "adversarial", "")] * 10 + [("b", "standard", None)]
    g = spark.createDataFrame(rows, "model string, mode string, error string")
    assert {x["model"]: x["ready"] for x in metrics.ready(g).collect()} == {"a": True, "b": False}
    assert metrics.complete(g, 9).where("complete").count() == 2


def test_work_and_last_wins(spark):
    p = spark.createDataFrame([("x",), ("y",)], "passage_id string")
    done = spark.createDataFrame([("x", 1, "adversarial", None), ("x", 2, "adversarial", "bad")], "passage_id string, level int, mode string, error string")
    left = evaluate.work_list(p, "adversarial", done)
    assert left.count() == 11 and left.where("level = 2").first()["vocab_level"] == 1
    dup = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "id string, ord int, v string")
    assert evaluate.last_wins(dup, "id", order="ord").first()["v"] == "new"


def test_evaluation_defaults(spark):
    gens = spark.createDataFrame([(1, None, 1, None, "nope", "What is the name of it, define?", "x"), (2, "standard", 1, None, "p", "", None)], "gen_id long, mode string, level int, vocab_level int, passage_id string, question string, answer string")
    known = spark.createDataFrame([("p", "text", ["c"], [])], PASSAGES)
    e = {x["gen_id"]: x for x in evaluate.evaluated(gens, known).collect()}
    assert len(e[1]["constraints"]) == 8 and e[2]["constraints"] == [] and not e[2]["all_passed"] and e[2]["evaluation_error"]
    assert e[1]["constraints"][0].asDict() == {"id": "U1", "name": "is_question", "passed": True, "score": 1.0, "details": "Ends with '?'", "tier": "universal"}


def test_prompts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    p = one(prompts.adversarial(F.lit("TEXT"), F.lit(2), F.lit(1)))
    assert "Do NOT use verbs like explain, describe, summarize, interpret, paraphrase, illustrate." in p and "verbs like: define, list, recall, identify, name, state, what is, who." in p
    assert "Remember-level question" in one(prompts.standard(F.lit("TEXT"), F.lit(1)))
    assert one(prompts.backend(F.lit("claude-3-5-sonnet-20241022"))) == "ollama" and one(prompts.display_name(F.lit("phi4_14b")))["name"] == "Phi-4 14B"


def test_files(spark, tmp_path):
    (tmp_path / "gen_m_1_standard.json").write_text(json.dumps({"model": "m:1", "mode": "standard", "generations": [{"passage_id": "p", "level": 2, "question": "q"}]}))
    (tmp_path / "biology").mkdir()
    (tmp_path / "biology/passages.json").write_text(json.dumps([{"passage_id": "bio_001", "text": "x"}]))
    g = files.read_generations(spark, str(tmp_path)).first()
    assert (g["model"], g["mode"], g["model_safe"], g["file_mode"], g["level"]) == ("m:1", "standard", "m_1", "standard", 2)
    assert files.read_passages(spark, str(tmp_path)).count() == 1
    rows = spark.createDataFrame([("a", "standard", 1)], "model string, mode string, x int")
    files.append_generations(rows, str(tmp_path / "g"))
    files.append_generations(rows, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 2
    files.write_text(spark, str(tmp_path / "t.json"), "{}é")
    assert (tmp_path / "t.json").read_text() == "{}é"


def test_stream(spark, tmp_path):
    gens = spark.createDataFrame([(1, "standard", 1, None, "p", "What is it?", "x")], "gen_id long, mode string, level int, vocab_level int, passage_id string, question string, answer string")
    gens.write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("p", "text", ["c"], [])], "passage_id string, text string, key_concepts array<string>, methods_principles array<string>")
    q = incremental.evaluate_stream(spark.readStream.schema(gens.schema).parquet(str(tmp_path / "in")), known, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_six_levels_and_ready_gate(spark):
    rows = [("a", "standard", 1, True), ("a", "adversarial", 1, False), ("a", "standard", 3, False), ("b", "standard", 2, True)]
    e = spark.createDataFrame(rows, "model string, mode string, level int, all_passed boolean")
    got = {(r["model"], r["level"]): (r["standard"], r["adversarial"], r["gap"]) for r in metrics.gap_by_level(e).collect()}
    assert len(got) == 12 and got["a", 1] == (1.0, 0.0, 1.0) and got["a", 3] == got["b", 6] == (0.0, 0.0, 0.0) and got["b", 2] == (1.0, 0.0, 1.0)
    gens = spark.createDataFrame([(m, mode, "x" if m == "c" and i < 2 else None) for m in "ac" for mode in ("standard", "adversarial") for i in range(10)] + [("b", "standard", None)], "model string, mode string, error string")
    both = e.union(spark.createDataFrame([("c", "standard", 1, True)], e.schema))
    assert {r["model"] for r in metrics.of_ready(both, gens).collect()} == {"a"}
    empty = both.withColumns({"constraints": F.array().cast(evaluate.RESULT), "error": F.when(F.col("model") == "c", "x")})
    assert {r["model"] for r in metrics.leaderboard(empty).collect()} == {"a"}  # b lacks a mode, c has errors
    assert [r["model"] for r in metrics.leaderboard(empty, gated=False).orderBy("rank").collect()] == ["a", "b", "c"]
