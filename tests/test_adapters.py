"""Generation and entailment: scripted callers, journals, scores that are made once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from rubrica.operators import adapters, evaluate

R = adapters.Request("ollama", "phi4:14b", "hi", 300.0, False)


def script(*steps):
    """A caller that returns or raises one step after the other."""
    left = list(steps)

    def call(request):
        x = left.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    call.left = left
    return call


@pytest.mark.parametrize("steps,pings,want,slept", [
    (["a"], [], ("a", None), []),
    ([ValueError("no"), "a"], [], ("a", None), [5.0]),
    ([ValueError("no"), ValueError("no"), "a"], [], ("a", None), [5.0, 10.0]),
    ([ValueError("1"), ValueError("2"), ValueError("3")], [], (None, "3"), [5.0, 10.0]),
    ([ConnectionError("reset"), "a"], ["up"], ("a", None), [15.0]),
    ([ValueError("Max retries exceeded"), "a"], [OSError("down"), OSError("down"), "up"], ("a", None), [15.0, 10.0, 10.0]),
    ([ValueError("Connection refused"), "a"], [OSError("down")] * 6, ("a", None), [15.0] + [10.0] * 6),  # still tried when it never answers
    ([ValueError("no"), ConnectionError("gone"), ValueError("last")], ["up"], (None, "last"), [5.0, 15.0]),
    ([ConnectionError("1"), ConnectionError("2"), ConnectionError("3")], ["up", "up"], (None, "3"), [15.0, 15.0]),  # no wait after the last try
])
def test_each_branch(steps, pings, want, slept):
    waits, call, ping = [], script(*steps), script(*pings)
    assert adapters.ask(R, call, ping, sleep=waits.append) == want
    assert waits == slept and not call.left and not ping.left


def test_other_backends_are_asked_once_and_a_missing_ping_is_no_poll():
    waits, call = [], script(ValueError("no"), "a")
    assert adapters.ask(adapters.Request("openai", "gpt-4o", "hi", 300.0, False), call, sleep=waits.append) == (None, "no") and waits == [] and call.left == ["a"]
    assert adapters.ask(R, script(ConnectionError("x"), "a"), None, sleep=waits.append) == ("a", None) and waits == [15.0]
    assert adapters.reasons("deepseek-r1:14b") and adapters.reasons("x:r1") and not adapters.reasons("phi4:14b")


WORK = "model string, prompt string, n int"
QUICK = adapters.Policy(wait=0, restart=0, poll=0)


def test_generation(spark):
    def call(r):
        if r.prompt == "bad":
            raise ValueError("no")
        return f"<think>x</think>QUESTION: {r.backend} {r.timeout:.0f} {r.reasoning}?\nANSWER: {r.prompt}"

    rows = [("gemini-2.5-flash", "hi", 1), ("deepseek-r1:14b", "hi", 2), ("x", "bad", 3), ("x", None, 4)]
    got = {x["n"]: x for x in adapters.generate(spark.createDataFrame(rows, WORK), call, policy=QUICK, groups=3, at_once=2).collect()}
    assert len(got) == 4 and got[1]["question"] == "<think>x</think>QUESTION: google 300 False?".split("QUESTION: ")[1] and got[1]["answer"] == "hi" and got[1]["raw_response"].startswith("<think>")
    assert got[2]["question"] == "ollama 600 True?" and got[2]["raw_response"].startswith("QUESTION") and got[3]["error"] == "no" and got[3]["question"] is None and got[3]["latency_ms"] >= 0 and got[4]["error"] is None


def test_finished_prompts_are_kept(spark, tmp_path):
    log = str(tmp_path / "asked")

    def call(r):
        with open(log, "a") as f:
            f.write(r.prompt + "\n")
        if r.prompt.startswith("bad"):
            raise ValueError("no")
        return f"QUESTION: {r.prompt}?\nANSWER: a"

    work = spark.createDataFrame([("x", f"{'bad' if i % 10 == 0 else 'p'}{i}", i) for i in range(60)] + [("x", "p1", 99)], WORK)
    run = lambda w: adapters.generate(w, call, policy=adapters.Policy(attempts=1), journal=str(tmp_path / "j"), groups=4, keep_every=3).collect()
    first = run(work)
    assert len(first) == 61 and sum(r["error"] is not None for r in first) == 6 and len(open(log).read().split()) == 60  # equal prompts once
    again = {r["n"]: r for r in run(work.repartition(9))}
    asked = open(log).read().split()[60:]
    assert sorted(asked) == sorted(f"bad{i}" for i in range(0, 60, 10))  # only errors are asked again
    assert again[5]["question"] == "p5?" and again[99]["question"] == "p1?" and {r["n"]: r["latency_ms"] for r in first if not r["error"]} == {n: r["latency_ms"] for n, r in again.items() if not r["error"]}
    part = next((tmp_path / "j").glob("*"))
    (part / "half.part").write_text('{"key": "cut o')  # of a task that died in writing
    assert len(run(work)) == 61


def test_a_task_that_runs_again_asks_for_the_rest_only(spark, tmp_path):
    """The task dies after some prompts; run again by hand it finds those in the journal."""
    log, once = str(tmp_path / "asked"), str(tmp_path / "died")

    def call(r):
        with open(log, "a") as f:
            f.write(r.prompt + "\n")
        if len(open(log).read().split()) == 8 and not os.path.exists(once):
            open(once, "w").close()
            raise KeyboardInterrupt  # ends the task, as the loss of its executor would
        return "QUESTION: q?\nANSWER: a"

    work = spark.createDataFrame([("x", f"p{i}", i) for i in range(20)], WORK).coalesce(1)
    run = lambda: adapters.generate(work, call, journal=str(tmp_path / "j"), groups=1, keep_every=2).collect()
    with pytest.raises(Exception):
        run()
    assert len(run()) == 20
    asked = open(log).read().split()
    assert 20 < len(asked) <= 22 and set(asked) == {f"p{i}" for i in range(20)}  # at most what wasn't yet written down is asked twice


def test_pairs_are_scored_once(spark, tmp_path):
    log, loads = str(tmp_path / "scored"), str(tmp_path / "loads")

    def load():
        with open(loads, "a") as f:
            f.write(f"{os.getpid()}\n")

        def score(premises, hypotheses):
            with open(log, "a") as f:
                f.writelines(h + "\n" for h in hypotheses)
            return [(0.1, 0.2, len(h) / 100) for h in hypotheses]

        return score

    kind = "gen_id long, kind string, premise string, hypothesis string"
    pairs = spark.createDataFrame([(i, "answer", "p", f"h{i % 5}") for i in range(40)] + [(50, "question", "p", None)], kind).repartition(6)
    store = str(tmp_path / "store")
    got = adapters.score_nli(pairs, load, "m1", store).collect()
    assert len(got) == 41
    scored = open(log).read().split()
    assert sorted(scored) == [f"h{i}" for i in range(5)]  # repeats once
    more = pairs.union(spark.createDataFrame([(60, "answer", "p", "new"), (61, "answer", "other", "h1")], kind))
    assert adapters.score_nli(more, load, "m1", store).count() == 43 and sorted(open(log).read().split()[5:]) == ["h1", "new"]
    assert adapters.score_nli(pairs, load, "m2", store).count() == 41 and len(open(log).read().split()) == 12  # another model, other scores
    pids = open(loads).read().split()
    assert len(pids) <= 3 * len(set(pids))  # m1, m2 and perhaps m1 again, each once a worker
    assert adapters.score_nli(pairs, load, "m1").count() == 41 and adapters.score_nli(pairs.where("false"), load, "m1", store).count() == 0


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    loads = str(tmp_path / "loads")

    def load():
        with open(loads, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda a, b: [(0.1, 0.2, 0.7)] * len(a)

    pairs = spark.createDataFrame([(i, "answer", "p", f"h{i}") for i in range(400)], "gen_id long, kind string, premise string, hypothesis string")
    for _ in range(3):  # many tasks, few workers
        assert adapters.score_nli(pairs.repartition(12), load, "one").count() == 400
    pids = open(loads).read().split()
    assert len(pids) == len(set(pids)) and len(pids) <= 8


def test_pairs_to_score(spark):
    gens = spark.createDataFrame([(1, None, 2, None, "p", "What?", "x"), (2, "standard", 3, None, "p", "How?", None)], "gen_id long, mode string, level int, vocab_level int, passage_id string, question string, answer string")
    known = spark.createDataFrame([("p", "text", ["c"], [])], "passage_id string, text string, key_concepts array<string>, methods_principles array<string>")
    pairs = adapters.nli_pairs(evaluate.bound(gens, known))
    assert sorted((r["gen_id"], r["kind"], r["hypothesis"]) for r in pairs.collect()) == [(1, "answer", "x"), (2, "question", "How?")]
    assert json.dumps([r.asDict() for r in adapters.score_nli(pairs, lambda: lambda a, b: [(0.1, 0.2, 0.7)] * len(a)).collect()]) and pairs.select(F.max("premise")).first()[0] == "text"
