"""Files: envelopes, documents, the evaluation manifest, tables of contents."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rubrica.operators import constraints, evaluate, metrics
from rubrica.sources import envelopes, files, toc

GEN = files.GENERATION
PASSAGES = "passage_id string, text string, key_concepts array<string>, methods_principles array<string>"


def gens(spark, rows):
    """(model, mode, passage_id, level, question, error)."""
    base = dict.fromkeys(x.split()[0] for x in GEN.split(", "))
    full = [tuple((base | {"model": m, "mode": mode, "passage_id": p, "subject": "s", "level": n, "level_name": "x", "question": q, "answer": "because é", "error": e, "latency_ms": 1.5}).values()) for m, mode, p, n, q, e in rows]
    return spark.createDataFrame(full, GEN)


def load(path):
    return json.loads(path.read_text())


def test_envelopes_round_trip_and_merge(spark, tmp_path):
    folder = str(tmp_path)
    first = gens(spark, [("m:1.a/b", "standard", "p", 1, "q1", None), ("m:1.a/b", "standard", "p", 2, None, "timed out"), ("n", "adversarial", "p", 1, 'say "x"\n', None)])
    envelopes.write_generations(first.repartition(5), folder)
    assert sorted(os.listdir(folder)) in (["_envelopes", "gen_m_1_a_b_standard.json", "gen_n_adversarial.json"], ["gen_m_1_a_b_standard.json", "gen_n_adversarial.json"])
    doc = load(tmp_path / "gen_m_1_a_b_standard.json")
    assert set(doc) == {"model", "mode", "timestamp", "generations", "n_generations"} and doc["n_generations"] == 2 and doc["model"] == "m:1.a/b" and set(doc["generations"][0]) == {x.split()[0] for x in GEN.split(", ")}
    untouched = (tmp_path / "gen_n_adversarial.json").read_bytes()
    envelopes.write_generations(gens(spark, [("m:1.a/b", "standard", "p", 2, "q2", None), ("m:1.a/b", None, "r", 1, "q3", None)]), folder)
    doc = load(tmp_path / "gen_m_1_a_b_standard.json")
    assert [(g["passage_id"], g["level"], g["question"]) for g in doc["generations"]] == [("p", 1, "q1"), ("p", 2, "q2"), ("r", 1, "q3")] and doc["n_generations"] == 3
    assert (tmp_path / "gen_n_adversarial.json").read_bytes() == untouched
    back = files.read_generations(spark, folder)
    assert back.count() == 4 and back.where("model = 'n'").first()["question"] == 'say "x"\n' and {r["model_safe"] for r in back.collect()} == {"m_1_a_b", "n"}
    envelopes.write_generations(gens(spark, [("m:1.a/b", "standard", "p", 1, "again", None)]), folder)
    assert [g["question"] for g in load(tmp_path / "gen_m_1_a_b_standard.json")["generations"]] == ["q2", "q3", "again"]


def test_a_killed_task_leaves_the_old_document(spark, tmp_path):
    folder = str(tmp_path)
    envelopes.write_generations(gens(spark, [("m", "standard", "p", 1, "old", None)]), folder)
    before = (tmp_path / "gen_m_standard.json").read_bytes()

    def broken(x):
        if x == "new 7":
            raise RuntimeError("killed")
        return x

    bad = gens(spark, [("m", "standard", f"p{i}", 1, f"new {i}", None) for i in range(9)]).withColumn("question", F.udf(broken)("question"))
    with pytest.raises(Exception):
        envelopes.write_generations(bad, folder)
    assert (tmp_path / "gen_m_standard.json").read_bytes() == before and not any((tmp_path / "_envelopes").glob("*/*")) and files.read_generations(spark, folder).count() == 1


def test_a_document_in_two_tasks_is_refused(spark, tmp_path):
    spark.dataSource.register(envelopes.Envelopes)
    rows = spark.createDataFrame([("f.json", '{"model":"m"}', "{}", None)] * 4, envelopes.ROWS).repartition(2)
    with pytest.raises(Exception, match="several tasks"):
        rows.write.format("envelopes").mode("append").save(str(tmp_path))
    assert not (tmp_path / "f.json").exists()


def evaluated(spark, rows):
    known = spark.createDataFrame([("p", "Alpha cells grow. Cells need energy.", ["cells", "energy"], [])], PASSAGES)
    return evaluate.evaluated(gens(spark, rows).withColumn("gen_id", F.monotonically_increasing_id()), known)


def test_evaluation_envelopes(spark, tmp_path):
    e = evaluated(spark, [("m", "standard", "p", 1, "What is the name of cells?", None), ("m", "standard", "p", 2, None, "bad"), ("m", "adversarial", "p", 1, "What?", None)])
    envelopes.write_evaluations(e.drop("read_order"), str(tmp_path))
    doc = load(tmp_path / "eval_m_standard.json")
    assert (doc["n_evaluated"], doc["model"], doc["mode"]) == (2, "m", "standard") and doc["prompt_pass_rate"] == sum(x["all_passed"] for x in doc["evaluations"]) / 2
    assert "evaluation_error" not in doc["evaluations"][0] and doc["evaluations"][1]["evaluation_error"] == "No question generated" and doc["evaluations"][1]["constraints"] == []
    assert list(doc["evaluations"][0]["constraints"][0]) == ["id", "name", "passed", "score", "details", "tier"] and doc["evaluations"][0]["pass_rate"] == round(doc["evaluations"][0]["pass_rate"], 4)
    back = files.read_evaluations(spark, str(tmp_path))
    assert back.count() == 3 and metrics.prompt_strict(back).count() == 2


@pytest.fixture(scope="module")
def stored(spark):
    """Two models, of which one has too many errors, and one with a single mode."""
    rows = [(m, mode, "p", n, "What is the name of cells?" if (n + len(mode)) % 2 else "Cells energy", "late" if m == "b.1" and n < 3 else None) for m in ("a", "b.1") for mode in ("standard", "adversarial") for n in range(1, 7)] + [("c", "standard", "p", 1, "What is it?", None)]
    made = evaluated(spark, rows)
    return spark.createDataFrame(made.collect(), made.schema)


def test_documents(spark, stored, tmp_path):
    doc = files.leaderboard_document(stored)
    assert [x["model_name"] for x in doc["leaderboard"]] == ["a"] and doc["stats"]["models_evaluated"] == 1
    free = files.leaderboard_document(stored, gated=False)
    assert {x["model_name"] for x in free["leaderboard"]} == {"a", "b.1"}
    strict = {(r["model"], r["mode"]): round(r["rate"], 4) for r in metrics.prompt_strict(stored).collect()}
    by = {(r["model"], r["mode"], r["id"]): round(r["rate"], 4) for r in metrics.by_constraint(stored).collect()}
    one = free["model_details"]["a"]
    assert one["prompt_strict"] == strict["a", "standard"] and one["adversarial_csr"] == strict["a", "adversarial"] and one["gap"] == round(strict["a", "standard"] - strict["a", "adversarial"], 4)
    assert one["per_constraint"] == {i: x for (m, mode, i), x in by.items() if (m, mode) == ("a", "standard")} and one["n_standard"] == 6 and set(one["per_level"]["standard"]) == set("123456")
    assert one["per_tier"] == {r["tier"]: round(r["rate"], 4) for r in metrics.by_tier(stored).where("model = 'a' and mode = 'standard'").collect()}
    loose = {(r["model"], r["mode"]): round(r["rate"], 4) for r in metrics.prompt_loose(stored).collect()}
    cons = {(r["model"], r["mode"]): round(r["rate"], 4) for r in metrics.constraint_loose(stored).collect()}
    assert one["prompt_loose"] == loose["a", "standard"] and one["constraint_loose"] == cons["a", "standard"]
    assert files.write_leaderboard(stored, str(tmp_path / "d.json")) == load(tmp_path / "d.json")
    board = {r["model"]: r for r in metrics.leaderboard(stored, gated=False).collect()}
    assert {x["model_name"]: (x["standard_csr"], x["adversarial_csr"], x["gap"], x["constraint_strict"], x["prompt_loose"]) for x in free["leaderboard"]} == {
        m: (r["standard"], r["adversarial"], r["gap"], r["constraint_strict"], r["standard_loose"]) for m, r in board.items() if m != "c"}


def test_summary_and_submission(spark, stored, tmp_path):
    doc = files.write_summary(stored, str(tmp_path))
    assert load(tmp_path / "benchmark_summary.json") == doc and set(doc["metrics"]) == {"a_standard", "a_adversarial", "b_1_standard", "b_1_adversarial", "c_standard"}
    one = doc["metrics"]["a_standard"]
    assert list(one) == ["prompt_level_strict", "prompt_level_loose", "constraint_level_strict", "constraint_level_loose", "by_level", "by_subject", "by_constraint", "by_tier"]
    for r in metrics.bootstrap(stored).collect():
        got = doc["metrics"][f"{r['model'].replace('.', '_')}_{r['mode']}"]["prompt_level_strict"]
        assert (got["rate"], got["n"], got["ci_low"], got["ci_high"]) == (round(r["rate"], 4), r["n"], round(r["ci_low"], 4), round(r["ci_high"], 4))
    flat = [c["passed"] for x in stored.where("model = 'a' and mode = 'standard'").orderBy("gen_id").collect() for c in x["constraints"]]
    low, high = metrics.interval(np.array(flat, float))
    assert one["constraint_level_strict"] == {"rate": round(sum(flat) / len(flat), 4), "n": len(flat), "n_pass": sum(flat), "ci_low": round(low, 4), "ci_high": round(high, 4)}
    assert one["by_level"]["1"]["name"] == "Remember" and one["by_level"]["1"]["n"] == 1 and one["by_subject"]["s"]["n"] == 6
    sent = files.submission_document(stored, "1")
    assert set(sent["models"]) == {"a"} and sent["submitter"] == "anonymous" and sent["models"]["a"]["total_generations"] == 6
    assert set(files.submission_document(stored, "1", gated=False)["models"]) == {"a", "b_1"}
    path = files.write_submission(stored, str(tmp_path), "1", "Some One", model="a")
    assert os.path.basename(path).startswith("submission_some_one_") and load(tmp_path / os.path.basename(path))["submitter"] == "Some One"
    with pytest.raises(ValueError):
        files.submission_document(stored, "1", model="zzz")


def test_documents_evaluate_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    e = spark.createDataFrame([(i, "m", ("standard", "adversarial")[i % 2], 1, "s", [], True, None) for i in range(20)], f"gen_id long, model string, mode string, level int, subject string, constraints {evaluate.RESULT}, all_passed boolean, error string")
    e = e.withColumn("subject", F.udf(count).asNondeterministic()("subject"))
    files.leaderboard_document(e)
    assert seen.value == 20
    files.summary_document(e)
    assert seen.value == 40


def test_only_what_changed_is_evaluated_again(spark, tmp_path):
    path = str(tmp_path / "e")
    known = spark.createDataFrame([("p", "Cells need energy.", ["cells"], [])], PASSAGES)
    rows = [(m, mode, "p", n, "What is the name of cells?", None) for m in ("a", "b") for mode in ("standard", "adversarial") for n in (1, 2)]
    asked = []

    def counting(g, p, nli=None):
        asked.append(sorted({(r["model"], r["mode"]) for r in g.select("model", "mode").distinct().collect()}))
        return evaluate.evaluated(g, p, nli)

    run = lambda rows, known=known: files.evaluations_or(gens(spark, rows), known, path, evaluated=counting)
    assert run(rows).count() == 8 and len(asked[0]) == 4
    assert run(rows[::-1]).count() == 8 and len(asked) == 1  # order doesn't matter
    changed = [*rows[:-1], (*rows[-1][:4], "What else is it?", None)]
    got = run(changed)
    assert asked[1] == [("b", "adversarial")] and got.where("question = 'What else is it?'").count() == 1 and got.count() == 8
    assert run(changed[:-2]).count() == 6 and len(asked) == 2  # a group that is gone isn't returned
    assert run(changed, known.withColumn("text", F.lit("Other text."))).count() == 8 and len(asked[2]) == 4
    constraints.register("X1", "own", "universal", [], lambda make: make(F.lit(True), F.lit(1.0), F.lit("x")))
    try:
        assert run(changed, known).count() == 8 and len(asked[3]) == 4
    finally:
        constraints.EXTRA.clear()


def test_tables_of_contents(spark, tmp_path):
    deep = {"slug": "9-9-deep", "title": "D"}
    for _ in range(400):
        deep = {"contents": [deep]}
    books = {
        "bio": {"tree": {"title": "Book", "contents": [{"slug": "preface", "title": "P"}, {"contents": []}, {"title": "One", "slug": "1-one", "contents": [{"slug": "1-1-cells", "title": "<b>Cells</b> &"}, {"slug": "1-key-terms", "title": "K"}, {"contents": [{"slug": "1-2-walls"}]}]}, {"slug": "2-1-late", "title": None}]}},
        "deep": deep, "empty": {"tree": {}}, "none": {"contents": []},
    }
    for name, tree in books.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(tree, indent=1))
    (tmp_path / "bad.json").write_text("{oops")
    got = toc.read_toc(spark, f"{tmp_path}/*.json")
    by = {}
    for r in got.orderBy("book", "place").collect():
        by.setdefault(r["book"], []).append((r["place"], r["depth"], r["slug"], r["title"]))
    assert by["bio"] == [(0, 1, "preface", "P"), (1, 2, "1-1-cells", "<b>Cells</b> &"), (2, 2, "1-key-terms", "K"), (3, 3, "1-2-walls", ""), (4, 1, "2-1-late", "")]
    assert by["deep"] == [(0, 400, "9-9-deep", "D")] and set(by) == {"bio", "deep", "bad"} and got.where("book = 'bad'").first()["error"]
    trees = spark.createDataFrame([(n, json.dumps(x)) for n, x in books.items()] + [("null", None), ("list", "[1]")], "book string, tree string").repartition(4)
    assert [tuple(r) for r in toc.content_sections(trees).where("book = 'bio'").orderBy("place").collect()] == [("bio", 1, "1-1-cells", "Cells &"), ("bio", 3, "1-2-walls", ""), ("bio", 4, "2-1-late", "")]
    assert toc.sections(trees).where("error is not null").count() == 2 and toc.sections(trees.where("false")).count() == 0
    books = spark.createDataFrame([(f"b{i}", json.dumps({"contents": [{"slug": f"{i}-{k}", "title": "t"} for k in range(30)]})) for i in range(50)], "book string, tree string").repartition(6)
    assert [(r["place"], r["slug"]) for r in toc.content_sections(books).where("book = 'b7'").orderBy("place").collect()] == [(k, f"7-{k}") for k in range(30)] and toc.sections(books).count() == 1500
