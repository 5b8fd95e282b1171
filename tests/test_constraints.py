"""Constraints, a table of cases evaluated in one job."""

import pytest
from pyspark.sql import functions as F

from rubrica.functions import vocab as v
from rubrica.operators import constraints

PASSAGE = "Photosynthesis is the process by which plants convert light energy into chemical energy. Chlorophyll in the chloroplasts absorbs sunlight. The process makes glucose and oxygen from carbon dioxide and water."
CONCEPTS = ["photosynthesis", "chlorophyll", "chloroplast", "glucose", "oxygen", "light energy"]
BASE = {"question": "", "answer": "", "passage": PASSAGE, "key_concepts": CONCEPTS, "methods_principles": ["light reactions"], "level": 1, "mode": "standard", "vocab_level": None, "ne": None, "nn": None, "nc": None}
LONG = " ".join(["word%d" % i for i in range(200)])

#: id, changes, passed, score (None: not checked)
CASES = [
    ("U1", {"question": "What is photosynthesis?"}, True, 1.0), ("U1", {"question": "Evaluate this idea"}, True, 0.8), ("U1", {"question": "State your position."}, True, 0.7),
    ("U1", {"question": "Tell me who came"}, True, 0.6), ("U1", {"question": "Photosynthesis!"}, False, 0.0), ("U1", {"question": "   "}, False, 0.0), ("U1", {"question": "What is photosynthesis!"}, True, 0.6), ("U1", {"question": "show off"}, False, 0.0),
    ("U2", {"question": "one two three four"}, False, 0.8), ("U2", {"question": "one two three four five"}, True, 1.0), ("U2", {"question": "a b c d e f g h i", "level": 2}, False, 0.9), ("U2", {"question": "a b c d e f g h i j", "level": 2}, True, 1.0),
    ("U2", {"question": " ".join(LONG.split()[:150])}, True, 1.0), ("U2", {"question": " ".join(LONG.split()[:151])}, False, 150 / 151),
    ("U3", {"question": "What makes glucose?"}, True, 1.0), ("U3", {"question": "What makes glucose?", "level": 2}, False, 0.5), ("U3", {"question": "glucose and oxygen", "level": 2}, True, 1.0), ("U3", {"question": "nothing", "key_concepts": []}, True, 1.0),
    ("U3", {"question": "Energies and lighting", "level": 2}, False, None),
    ("U4", {"question": "cell cell cell is it"}, True, 1.0), ("U4", {"question": "cell cell cell cell"}, False, 0.75), ("U4", {"question": "the the the the the"}, True, 1.0), ("U4", {"question": "ab?"}, False, 0.0),
    ("R1", {"question": "Define it"}, True, 1.0), ("R1", {"question": "How many are there?"}, True, 0.9), ("R1", {"question": "Explain"}, False, 0.0), ("R1", {"question": "the statement"}, True, 1.0),
    ("R2", {"question": "glucose and oxygen"}, True, 1.0), ("R2", {"question": "glucose oxygen chlorophyll"}, False, 2 / 3), ("R2", {"question": "glucose oxygen chlorophyll", "key_concepts": []}, True, 1.0),
    ("R2", {"question": "light energy energy light", "key_concepts": ["light energy", "light", "energy"]}, True, 1.0), ("R2", {"question": "Cell cell x y", "key_concepts": ["Cell", "cell", "x", "y"]}, True, 1.0),
    ("R3", {"answer": " ".join(["w"] * 20)}, True, 1.0), ("R3", {"answer": " ".join(["w"] * 21)}, False, 20 / 21), ("R3", {"answer": None}, True, 1.0),
    ("R4", {"answer": "plants convert sunlight"}, True, 1.0), ("R4", {"answer": "quantum zebra flights"}, False, 0.0), ("R4", {"answer": "the of"}, True, 1.0), ("R4", {"answer": "plants water glucose zebra quark"}, True, 0.6),
    ("D1", {"question": "Explain it"}, True, 1.0), ("D1", {"question": "Why is it so"}, True, 0.9), ("D1", {"question": "List"}, False, 0.0),
    ("D2", {"answer": "plants convert light energy into chemical energy"}, False, 0.0), ("D2", {"answer": "plants convert light"}, True, 1.0), ("D2", {"answer": "green things turn rays into sugar for themselves"}, True, 1.0), ("D2", {"answer": None}, True, 1.0),
    ("D4", {"question": "how"}, True, 1.0), ("D4", {"question": "show"}, True, 1.0), ("D4", {"question": "list"}, False, 0.0),
    ("D3", {"answer": "x", "nc": 0.499, "nn": 0.2}, True, 0.501), ("D3", {"answer": "x", "nc": 0.5, "nn": 0.2}, False, 0.5), ("D3", {"answer": None}, True, 1.0), ("D3", {"answer": "x"}, False, 0.0), ("D3", {"answer": "x", "passage": None}, True, 1.0),
    ("P1", {"question": "Calculate x"}, True, 1.0), ("P1", {"question": "Suppose that x"}, True, 0.9), ("P1", {"question": "because"}, True, 1.0), ("P1", {"question": "list"}, False, 0.0),
    ("P2", {"question": "x", "nn": 0.25, "nc": 0.3}, True, 0.55), ("P2", {"question": "x", "nn": 0.2, "nc": 0.3}, False, 0.5), ("P2", {"question": ""}, True, 1.0),
    ("P3", {"question": "glucoses"}, True, 1.0), ("P3", {"question": "light reactions"}, True, 1.0), ("P3", {"question": "plants process water zebra"}, True, 0.8), ("P3", {"question": "zebra quark lepton"}, False, 0.0), ("P3", {"question": "zebra", "key_concepts": [], "methods_principles": [], "passage": ""}, True, 1.0),
    ("P4", {"answer": "It is 5"}, True, 1.0), ("P4", {"answer": "thus"}, True, 1.0), ("P4", {"answer": "nothing much"}, False, 0.0), ("P4", {"answer": None}, False, 0.0),
    ("A1", {"question": "Contrast these"}, True, 1.0), ("A1", {"question": "What factors matter"}, True, 0.9), ("A1", {"question": "list"}, False, 0.0),
    ("A2", {"question": "glucose"}, False, 0.5), ("A2", {"question": "glucose", "answer": "oxygen"}, True, 1.0), ("A2", {"question": "x", "key_concepts": []}, True, 1.0), ("A2", {"question": "ATP and glucose", "key_concepts": ["adenosine triphosphate", "glucose"]}, True, 1.0),
    ("A3", {"question": "difference between"}, True, 1.0), ("A3", {"question": "list"}, False, 0.0),
    ("A4", {"question": "glucose oxygen", "answer": "glucose"}, False, 0.5), ("A4", {"question": "glucose", "answer": "glucose"}, True, 1.0), ("A4", {"question": "zebra"}, True, 1.0),
    ("E1", {"question": "generate"}, True, 1.0), ("E1", {"question": "list"}, False, 0.0), ("E2", {"question": "do you agree"}, True, 1.0), ("E2", {"question": "shoulder"}, False, 0.0), ("E3", {"question": "give evidence"}, True, 1.0), ("E3", {"question": "x"}, False, 0.0),
    ("E4", {"answer": "good but bad"}, True, 1.0), ("E4", {"answer": "button"}, False, 0.0), ("E4", {"answer": None}, False, 0.0),
    ("C1", {"question": "Design"}, True, 1.0), ("C1", {"question": "plants"}, True, 1.0), ("C1", {"question": "x"}, False, 0.0),
    ("C3", {"question": "must include"}, True, 1.0), ("C3", {"question": "that includes"}, True, 1.0), ("C3", {"question": "must"}, False, 0.5),
    ("C4", {"answer": " ".join(["w"] * 50)}, False, 1.0), ("C4", {"answer": " ".join(["w"] * 51)}, True, 1.0), ("C2", {"answer": "x", "nn": 0.3, "nc": 0.3}, True, 0.6), ("C2", {"answer": "x", "nn": 0.3, "nc": 0.2}, False, 0.5),
    ("AV", {"question": "x"}, True, 1.0), ("AV", {"question": "Define", "mode": "adversarial", "vocab_level": 1, "level": 2}, True, 1.0), ("AV", {"question": "Explain", "mode": "adversarial", "vocab_level": 1, "level": 2}, False, 0.0), ("AV", {"question": "x", "mode": "adversarial"}, True, 1.0),
    ("AN", {"question": "Explain", "mode": "adversarial", "level": 2}, False, 0.5), ("AN", {"question": "Define", "mode": "adversarial", "level": 2}, True, 1.0), ("AN", {"question": "Define"}, True, 1.0),
]


@pytest.fixture(scope="module")
def outcomes(spark):
    schema = "n int, question string, answer string, passage string, key_concepts array<string>, methods_principles array<string>, level int, mode string, vocab_level int, ne double, nn double, nc double"
    rows = [(n, *(BASE | change).values()) for n, (_, change, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, schema)
    score = F.when(F.col("nc").isNotNull(), F.struct(F.lit(0.0).alias("entailment"), F.col("nn").alias("neutral"), F.col("nc").alias("contradiction")))
    df = constraints.prepared(df.withColumns({"nli_answer": score, "nli_question": score}))
    wanted = F.lit(None).cast("struct<passed:boolean,score:double,details:string>")
    for i in sorted({c[0] for c in CASES}):
        mine = [n for n, c in enumerate(CASES) if c[0] == i]
        wanted = F.when(F.col("n").isin(mine), constraints.RULES[i](constraints.plain)).otherwise(wanted)
    return {r["n"]: r["r"] for r in df.select("n", wanted.alias("r")).collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_case(outcomes, n):
    i, change, passed, score = CASES[n]
    assert outcomes[n]["passed"] == passed, (i, change, outcomes[n])
    if score is not None:
        assert outcomes[n]["score"] == pytest.approx(score)


def test_every_constraint_has_both_outcomes():
    seen = {(i, p) for i, _, p, _ in CASES}
    assert {i for i, *_ in v.CONSTRAINTS} == {i for i, p in seen if p} == {i for i, p in seen if not p}


@pytest.mark.parametrize("mode,n", [("standard", 8), ("adversarial", 9)])
def test_registry(mode, n):
    for level in v.LEVELS:
        ids = [c.id for c in constraints.applicable(level, mode)]
        assert len(ids) == n and ids[:4] == ["U1", "U2", "U3", "U4"]
    assert [c.id for c in constraints.applicable(2, "standard")][4:] == ["D1", "D2", "D4", "D3"]
    assert [c.id for c in constraints.applicable(5, "adversarial")][4:] == ["E2", "E3", "E4", "AV", "AN"]
    assert len(constraints.applicable(9, mode)) == (4 if mode == "standard" else 6) and len(constraints.applicable(1, "other")) == 4


def test_registering_a_constraint():
    constraints.register("X1", "own", "universal", [], lambda make: make(F.lit(True), F.lit(1.0), F.lit("own words")))
    try:
        assert constraints.applicable(3, "standard")[-1].id == "X1"
    finally:
        constraints.EXTRA.clear()


#: id, changes, the evidence word for word
EVIDENCE = [
    ("U1", {"question": " "}, "Empty question"), ("U1", {"question": "So?"}, "Ends with '?'"), ("U1", {"question": "Design it. Judge it"}, "Task prompt starting with 'design'"),
    ("U1", {"question": "State it from the passage."}, "Response-request ending: 'the passage'"), ("U1", {"question": "Tell who or what"}, "Contains question word 'what'"),
    ("U1", {"question": "No é"}, "Ends with 'é', not '?', and no task/question structure found"),
    ("U2", {"question": "one two"}, "Too short: 2 words (min 5)"), ("U2", {"question": "one two", "level": 3}, "Too short: 2 words (min 10)"), ("U2", {"question": LONG}, "Too long: 200 words (max 150)"), ("U2", {"question": "a b c d e"}, "5 words (valid range)"),
    ("U3", {"question": "glucose", "level": 2}, "Only 1/6 key terms in Q+A (need >=2). Found: ['glucose'], missing: ['photosynthesis', 'chlorophyll', 'chloroplast']"),
    ("U3", {"question": "glucose oxygen"}, "2/6 key terms in Q+A: ['glucose', 'oxygen']"), ("U3", {"key_concepts": []}, "No key concepts provided; skipped"),
    ("U3", {"question": "newton's a\"b c\\d golgi\nbody", "key_concepts": ["newton's", "a\"b", "it's \"x\"", "golgi\nbody", "e f"], "level": 2}, "3/5 key terms in Q+A: [\"newton's\", 'a\"b', 'golgi\\nbody']"),
    ("U3", {"question": "x", "key_concepts": ["it's \"y\"", "e f", "\x01​"], "level": 2}, "Only 0/3 key terms in Q+A (need >=2). Found: [], missing: ['it\\'s \"y\"', 'e\\xa0f', '\\x01\\u200b']"),
    ("U4", {"question": ""}, "Empty output"), ("U4", {"question": "ab?"}, "Output too short: 'ab?'"), ("U4", {"question": "b a b a b a b a"}, "Word 'b' repeated 4x (max 3)"), ("U4", {"question": "fine words"}, "No degenerate patterns detected"),
    ("R1", {"question": "Who is it, state it"}, "Contains Remember verb: 'state'"), ("R1", {"question": "How many, how much?"}, "Contains recall pattern: 'how many'"),
    ("R1", {"question": "Explain"}, "No Remember verbs or recall patterns found. Expected Bloom's verbs ['define', 'list', 'recall', 'identify']... or patterns like 'What is', 'How many', 'When did'..."),
    ("R2", {"question": "oxygen, glucose"}, "2 concept(s) found: ['glucose', 'oxygen'] (max 2)"), ("R2", {"question": "oxygen chlorophyll glucose"}, "3 concepts found: ['chlorophyll', 'glucose', 'oxygen'] (max 2). Remember questions should target a single concept."),
    ("R2", {"key_concepts": None}, "No key concepts provided; skipped"),
    ("R3", {"answer": "a b"}, "Answer is 2 words (max 20)"), ("R3", {"answer": " ".join(["w"] * 21)}, "Answer is 21 words (max 20). Remember answers should be short, factual."),
    ("R4", {"answer": "the of"}, "No content words in answer; skipped"), ("R4", {"answer": "plants water glucose zebra quark"}, "60% of answer words found in passage (threshold 60%)"),
    ("R4", {"answer": "plants w x y z v u t"}, "Only 12% of answer words found in passage (need >=60%). Remember answers should be directly extractable."),  # 12.5: to the even one
    ("D1", {"question": "why is it"}, "Contains comprehension pattern: 'why is'"), ("D1", {"question": "translate and describe"}, "Contains Understand verb: 'describe'"),
    ("D2", {"answer": "a b c d"}, "Answer too short to evaluate; skipped"), ("D2", {"answer": "green things turn rays into sugar"}, "0% trigram overlap with passage (max 70%). Answer is paraphrased."),
    ("D2", {"answer": "plants convert light energy into chemical energy"}, "100% trigram overlap with passage (max 70%). Understand answers should paraphrase, not copy."),
    ("D3", {"answer": "x", "nc": 0.4996, "nn": 0.2}, "Answer consistent with passage: contradiction=0.500 (threshold <0.5)"), ("D3", {"answer": "x", "nc": 0.5, "nn": 0.2}, "Answer contradicts passage: contradiction=0.500 (need <0.5). Understand answers must be consistent with the text."),
    ("D3", {"answer": ""}, "Missing passage or answer; skipped"), ("D3", {"answer": "x"}, "NLI error: no score"), ("P2", {"question": ""}, "Missing passage or question; skipped"),
    ("P2", {"question": "x", "nn": 0.25, "nc": 0.3}, "Question presents novel scenario: non-entailment=0.550 (threshold 0.55)"), ("C2", {"answer": "x", "nn": 0.0625, "nc": 0.0}, "Answer too similar to passage: non-entailment=0.062 (need >=0.6). Create answers should produce something new."),
    ("P3", {"question": "oxygens and glucose"}, "References passage concept: ['glucose', 'oxygen']"), ("P3", {"question": "light reactions"}, "References method/principle: light reactions"),
    ("P3", {"question": "plants process water zebra"}, "Q+A shares 75% vocabulary with passage"), ("P3", {"key_concepts": [], "methods_principles": [], "question": "zebra"}, "No concepts/methods provided; skipped"), ("P3", {"question": "zebra quark"}, "Q+A does not reference passage concepts or methods."),
    ("P4", {"answer": "Thus step 12 is next"}, "Answer contains specific result: '12'"), ("P4", {"answer": "thus it would be"}, "Answer contains specific result: 'thus'"),
    ("A2", {"question": "glucose oxygen"}, "2 concepts found: ['glucose', 'oxygen'] (min 2)"), ("A2", {"question": "glucose"}, "Only 1 concept(s) found: ['glucose'] (need >=2). Analyze questions must connect multiple ideas."),
    ("A2", {"question": "ATP, glucose and DNA", "key_concepts": ["adenosine triphosphate", "glucose", "Deoxyribonucleic Acid", "Adenosine"]}, "3 concepts found: ['glucose', 'Deoxyribonucleic Acid', 'adenosine triphosphate'] (min 2)"),
    ("A4", {"question": "zebra"}, "No passage concepts in question; skipped"), ("A4", {"question": "glucose oxygen", "answer": "glucose"}, "Answer missing concepts: ['oxygen']. Only covers 1/2."), ("A4", {"question": "glucose", "answer": "glucose"}, "Answer covers all 1 concepts: ['glucose']"),
    ("E1", {"question": "x"}, "No Evaluate verbs found. Expected one of: ['assess', 'critique', 'judge', 'justify', 'argue', 'defend']..."), ("E4", {"answer": "worse but better"}, "Answer contains contrastive marker: 'but '"),
    ("C3", {"question": "it must include at least using"}, "4 specification markers found: ['must', 'include', 'at least', 'using'] (min 2)"), ("C3", {"question": "must"}, "Only 1 spec marker(s): ['must'] (need >=2). Create questions should specify what to produce."),
    ("C4", {"answer": "w " * 51}, "Answer is 51 words (min 50)"), ("C4", {"answer": "w"}, "Answer is only 1 words (need >50). Create answers should be substantial."),
    ("AV", {"question": "x"}, "Not adversarial mode; skipped"), ("AV", {"question": "x", "mode": "adversarial", "vocab_level": 9}, "No verbs defined for level 9; skipped"),
    ("AV", {"question": "list it", "mode": "adversarial", "vocab_level": 1}, "Uses vocabulary from L1 (Remember): 'list'"),
    ("AV", {"question": "x", "mode": "adversarial", "vocab_level": 2}, "Does not use vocabulary from L2 (Understand). Expected one of: ['explain', 'describe', 'summarize', 'interpret', 'paraphrase']..."),
    ("AN", {"question": "x", "mode": "adversarial", "level": 7}, "No verbs defined for target level 7; skipped"), ("AN", {"question": "x", "mode": "adversarial", "level": 2}, "Avoids target L2 (Understand) vocabulary"),
    ("AN", {"question": "explain", "mode": "adversarial", "level": 2}, "Uses target vocabulary 'explain' from L2 (Understand). Adversarial mode should use only the specified vocabulary level."),
]


def test_evidence(spark):
    schema = "n int, question string, answer string, passage string, key_concepts array<string>, methods_principles array<string>, level int, mode string, vocab_level int, ne double, nn double, nc double"
    df = spark.createDataFrame([(n, *(BASE | change).values()) for n, (_, change, _) in enumerate(EVIDENCE)], schema)
    score = F.when(F.col("nc").isNotNull(), F.struct(F.lit(0.0).alias("entailment"), F.col("nn").alias("neutral"), F.col("nc").alias("contradiction")))
    df = constraints.prepared(df.withColumns({"nli_answer": score, "nli_question": score}))
    made = F.lit(None).cast("string")
    for i in sorted({c[0] for c in EVIDENCE}):
        made = F.when(F.col("n").isin([n for n, c in enumerate(EVIDENCE) if c[0] == i]), constraints.RULES[i](lambda p, s, d: d)).otherwise(made)
    got = {r["n"]: r["d"] for r in df.select("n", made.alias("d")).collect()}
    for n, (i, change, want) in enumerate(EVIDENCE):
        assert got[n] == want, (i, change)


def test_every_message_is_python_formatted_text():
    for i, ways in v.DETAILS.items():
        assert i in constraints.RULES and all(w.format(**{k: "" for k in ("found", "n", "least", "most", "total", "missing", "share", "score", "verbs", "level", "name")}) for w in ways.values())


def test_descriptions(spark):
    assert constraints.describe(1, "standard").splitlines()[0] == "- remember_vocabulary: R1: Uses Remember-level vocabulary or natural recall framing."
    assert [x.split(":")[1].strip() for x in constraints.describe(6, "adversarial").splitlines()] == ["C3", "C4", "C2", "AV", "AN"]
    rows = spark.createDataFrame([(n, m) for n in (0, *v.LEVELS) for m in ("standard", "adversarial", "other")], "level int, mode string")
    for r in rows.select("level", "mode", constraints.description().alias("d")).collect():
        assert r["d"] == constraints.describe(r["level"], r["mode"])
