"""The same results in DuckDB's SQL. Fixed values come from ``expected`` or stand here; none from the modules under test."""

from __future__ import annotations

import re

from . import expected as v, fixture as fx

W = r"[\p{L}\p{N}_]"
B, E = rf"(^|[^\p{{L}}\p{{N}}_])", rf"($|[^\p{{L}}\p{{N}}_])"
STEM = "^(.{3,}?)(?:" + "|".join(v.SUFFIXES) + ")$"


def s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def lst(xs) -> str:
    return "[" + ", ".join(s(x) for x in xs) + "]"


def has(col: str, xs: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {s(x)})" for x in xs) + ")"


def toks(x: str) -> str:
    return f"regexp_extract_all({x}, {s(W + '+')})"


def stems(x: str) -> str:
    return f"list_distinct(list_transform({x}, lambda w: regexp_replace(w, {s(STEM)}, '\\1')))"


def mentions(x: str, c: str) -> str:
    return f"regexp_matches({x}, {s(B)} || regexp_escape(lower({c})) || {s('(s|es|ed|ing)?' + E)})"


def concepts(x: str, xs: str = "kc") -> str:
    return f"list_filter({xs}, lambda c: {mentions(x, 'c')})"


def outer_(x: str) -> str:
    return f"list_filter({x}, lambda c: len(list_filter({x}, lambda o: c <> o AND contains(lower(o), lower(c)))) = 0)"


def overlap(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 THEN 0.0 ELSE len(list_intersect({stems(a)}, {stems(b)}))::DOUBLE / len({stems(a)}) END)"


def pick(xs: list, i: str) -> str:
    return f"({lst(xs) if isinstance(xs[0], str) else xs})[(({i}) % {len(xs)})::INT + 1]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


FOLD = r"regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{Ll}\p{Lu}\p{N}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"
WORDS = f"""
docs AS (SELECT doc_id AS passage_id, source AS subject, coalesce(text, '') AS text FROM documents),
toks AS (SELECT passage_id, {toks('lower(text)')} AS ws FROM docs),
wpos AS (SELECT passage_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM toks),
wn AS (SELECT passage_id, word, count(*) AS n, min(pos) AS pos FROM wpos WHERE regexp_full_match(word, '[a-z]{{4,}}') AND NOT list_contains({lst(v.CONCEPT_STOP_WORDS)}, word) GROUP BY ALL HAVING count(*) >= 2),
freq AS (SELECT passage_id, list(word ORDER BY n DESC, pos) [1:16] AS frequent FROM wn GROUP BY ALL),
named AS (SELECT passage_id, list_transform(regexp_extract_all({FOLD}, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b'), lambda x: lower(x)) AS named FROM docs),
every AS (SELECT passage_id, list_concat(named, coalesce(frequent, [])) AS l FROM named LEFT JOIN freq USING (passage_id)),
kcs AS (SELECT passage_id, (list_filter(l, lambda x, i: list_position(l, x) = i))[1:8] AS key_concepts FROM every),
mps AS (SELECT passage_id, list_concat({", ".join(rf"regexp_extract_all(text, {s('(?i)' + p.replace(chr(92) + 'w', chr(92) + 'p{L}' + chr(92) + 'p{N}_'))}, 1)" for p in v.METHOD_PATTERNS)}) AS l FROM docs),
mpt AS (SELECT passage_id, list_filter(list_transform(l, lambda x: lower({strip('x')})), lambda m: length(m) > 3 AND len(regexp_extract_all(m, '\\S+')) <= 5) AS l FROM mps),
fx_passages AS (SELECT passage_id, subject, text, key_concepts, (list_filter(l, lambda x, i: list_position(l, x) = i))[1:6] AS methods_principles FROM docs JOIN kcs USING (passage_id) JOIN mpt USING (passage_id))
"""


def words_of(x: str, n: str) -> str:
    return rf"array_to_string(regexp_extract_all({x}, '\S+')[1:{n}], ' ')"


_CON = "array_to_string(coalesce(key_concepts, [])[1:(gen_id % 4)::INT], ' and ')"
GENS = f"""
u AS (SELECT conv_id, turn, text AS asked FROM conversations WHERE role = 'user'),
d2 AS (SELECT conv_id, turn - 1 AS turn, text AS said FROM conversations WHERE role = 'assistant'),
g0 AS (SELECT *, conv_id * 1000 + turn AS gen_id, ((conv_id * 7 + turn // 2) % 6 + 1)::INT AS level, CASE WHEN conv_id % 2 = 0 THEN 'standard' ELSE 'adversarial' END AS mode,
  'm' || (conv_id % 3) AS model, (conv_id * 31 + turn) % (SELECT max(doc_id) + 2 FROM documents) AS passage_id FROM u JOIN d2 USING (conv_id, turn)),
g1 AS (SELECT g0.*, subject, text, key_concepts, methods_principles, CASE WHEN mode = 'adversarial' THEN CASE level {" ".join(f"WHEN {a} THEN {b}" for a, b in v.PAIRINGS.items())} END END::INT AS vocab_level FROM g0 LEFT JOIN fx_passages USING (passage_id)),
g2 AS (SELECT *, concat_ws(' ', {pick(fx.STARTERS, 'gen_id')}, {words_of('asked', '6')}, {_CON}) AS q0,
  concat_ws(' ', {pick(fx.CONNECTIVES, 'gen_id')}, {words_of("CASE WHEN gen_id % 2 = 0 THEN coalesce(text, '') ELSE said END", pick(fx.COUNTS, 'gen_id // 3'))}, CASE WHEN gen_id % 3 = 0 THEN {_CON} END) AS a0 FROM g1),
g3 AS (SELECT *, CASE WHEN gen_id % 37 = 0 THEN ' ' ELSE q0 || CASE WHEN gen_id % 11 = 0 THEN ' alpha alpha alpha alpha' ELSE '' END || {pick(fx.ENDINGS, 'gen_id // 5')} END AS _q, a0 AS _a FROM g2),
fx_gens AS (SELECT gen_id, model, mode, level, vocab_level, passage_id, subject, text AS passage, key_concepts, methods_principles,
  CASE WHEN gen_id % 23 <> 0 THEN _q END AS question, CASE WHEN gen_id % 29 <> 0 THEN _a END AS answer, CASE WHEN gen_id % 31 = 0 THEN 'timed out' END AS error,
  CASE gen_id % 8 WHEN 0 THEN 'QUESTION: ' || _q || chr(10) || 'ANSWER: ' || _a WHEN 1 THEN 'Q: 1. ' || _q || chr(10) || 'A: ' || _a WHEN 2 THEN _q || '? ' || _a WHEN 3 THEN _q || chr(10) || chr(10) || _a
    WHEN 4 THEN '"' || _q || '"' WHEN 5 THEN 'answer: ' || _a || chr(10) || 'question: Question: ' || _q WHEN 6 THEN '<think>hm ' || _q || '</think>' || chr(10) || ' ' || _a END AS raw_response FROM g3)
"""


def nli(kind: str, m: int) -> str:
    return f"(gen_id * {m}) % 101 AS c_{kind}, (gen_id * 53) % (101 - (gen_id * {m}) % 101) AS n_{kind}"


BOUND = f"""
b0 AS (SELECT *, lower(coalesce(question, '')) AS q, lower(coalesce(answer, '')) AS a, lower(coalesce(passage, '')) AS p, coalesce(key_concepts, []) AS kc, coalesce(methods_principles, []) AS mp, {nli('answer', 37)}, {nli('question', 41)} FROM fx_gens),
b AS (SELECT *, q || ' ' || a AS qa, {toks('q')} AS qw, {toks('a')} AS aw, {toks('p')} AS pw, {strip("coalesce(question, '')")} AS sq, regexp_extract_all(q || ' ' || a, '[a-z]+') AS qat FROM b0)
"""


def first(col: str, xs: list[str]) -> str:
    """The first of the list that a text holds; null for none."""
    return f"list_filter({lst(xs)}, lambda p: contains({col}, p))[1]"


def shown(xs: str, most: int | None = None) -> str:
    """A list of strings as Python shows it; the texts here have no control characters but line ends and tabs."""
    quote, double = "chr(39)", "chr(34)"
    escape = "replace(replace(replace(c, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't')"
    one = f"CASE WHEN NOT contains(c, {quote}) THEN {quote} || {escape} || {quote} WHEN NOT contains(c, {double}) THEN {double} || {escape} || {double} ELSE {quote} || replace({escape}, {quote}, chr(92) || {quote}) || {quote} END"
    return f"'[' || array_to_string(list_transform({xs if most is None else f'({xs})[1:{most}]'}, lambda c: {one}), ', ') || ']'"


def say(template: str, **values: str) -> str:
    """A message: its {names} are expressions."""
    parts = re.split(r"\{(\w+)\}", template)
    return "(" + " || ".join(s(x) if i % 2 == 0 else f"({values[x]})" for i, x in enumerate(parts) if i % 2 or x) + ")"


def percent(x: str) -> str:
    return f"round_even(({x}) * 100, 0)::BIGINT || '%'"


def when(*cases: tuple[str, str], last: str) -> str:
    return "(CASE " + " ".join(f"WHEN {c} THEN {x}" for c, x in cases) + f" ELSE {last} END)"


def once(value: str, body: str) -> str:
    """body, where x stands for a value that is computed once."""
    return f"(list_transform([{value}], lambda x: {body}))[1]"


#: passed, score and details.
Rule = tuple[str, str, str]


def marked(col: str, xs: list[str], yes: str, no: str) -> Rule:
    return has(col, xs), f"(CASE WHEN {has(col, xs)} THEN 1.0 ELSE 0.0 END)", when((has(col, xs), say(yes + " '{x}'", x=first(col, xs))), last=s(no))


def voc(level: int, name: str, xs: list[str] | None, kind: str, no: str) -> Rule:
    verb = has("q", v.VERBS[level])
    cases = [(verb, say(f"Contains {name} verb: '{{x}}'", x=first("q", v.VERBS[level])))]
    if not xs:
        return verb, f"(CASE WHEN {verb} THEN 1.0 ELSE 0.0 END)", when(*cases, last=s(no))
    cases.append((has("q", xs), say(f"Contains {kind} pattern: '{{x}}'", x=first("q", xs))))
    return f"({verb} OR {has('q', xs)})", f"(CASE WHEN {verb} THEN 1.0 WHEN {has('q', xs)} THEN 0.9 ELSE 0.0 END)", when(*cases, last=s(no))


def tri(x: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({x}) - 1, 1)), lambda i: {x}[i] || ' ' || {x}[i + 1] || ' ' || {x}[i + 2]))"


def acronyms() -> str:
    """The concepts found with their acronyms. All cover no more than what a single pass finds, as added concepts differ from found ones."""
    out = concepts("qa")
    for a, long in v.ACRONYMS.items():
        more = f"list_filter(kc, lambda c: NOT list_contains(list_transform(f, lambda x: lower(x)), lower(c)) AND (contains(lower(c), {s(a)}) OR contains({s(long)}, lower(c)) OR contains(lower(c), {s(long)})))"
        out = f"(list_transform([{out}], lambda f: CASE WHEN regexp_matches(qa, {s(B + a + E)}) THEN list_concat(f, {more}) ELSE f END))[1]"
    return out


def rules() -> dict[str, Rule]:
    low = "regexp_replace(lower(sq), '\\.+$', '')"
    starts = " OR ".join(f"starts_with(lower(sq), {s(x)})" for x in v.TASK_STARTERS)
    ends = " OR ".join(f"suffix({low}, {s(x)})" for x in v.RESPONSE_ENDINGS)
    asks = f"regexp_matches(lower(sq), {s(B + '(' + '|'.join(v.QUESTION_WORDS) + ')' + E)})"
    u1 = f"(CASE WHEN sq = '' THEN 0.0 WHEN suffix(sq, '?') THEN 1.0 WHEN {starts} THEN 0.8 WHEN {ends} THEN 0.7 WHEN {asks} THEN 0.6 ELSE 0.0 END)"
    word = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(lower(sq), {s(B + x + E)}) THEN {s(x)} END" for x in v.QUESTION_WORDS) + ")"
    d_u1 = when(
        ("sq = ''", s("Empty question")), ("suffix(sq, '?')", s("Ends with '?'")),
        (starts, say("Task prompt starting with '{x}'", x=f"list_filter({lst(v.TASK_STARTERS)}, lambda p: starts_with(lower(sq), p))[1]")),
        (ends, say("Response-request ending: '{x}'", x=f"list_filter({lst(v.RESPONSE_ENDINGS)}, lambda p: suffix({low}, p))[1]")),
        (asks, say("Contains question word '{x}'", x=word)), last=say("Ends with '{x}', not '?', and no task/question structure found", x="right(sq, 1)"),
    )
    least, terms = "(CASE WHEN level = 1 THEN 5 ELSE 10 END)", "(CASE WHEN level = 1 THEN 1 ELSE 2 END)"
    d_u2 = when((f"len(qw) < {least}", say("Too short: {n} words (min {m})", n="len(qw)", m=least)), ("len(qw) > 150", say("Too long: {n} words (max 150)", n="len(qw)")), last=say("{n} words (valid range)", n="len(qw)"))
    ct = "regexp_extract_all(lower(c), '[a-z]+')"
    rel = f"list_filter(kc, lambda c: {mentions('qa', 'c')} OR (len({ct}) > 0 AND list_has_all({stems('qat')}, {stems(ct)})))"
    missing = shown("list_filter(kc, lambda k: NOT list_contains(x, k))", 3)
    no_concepts = ("len(kc) = 0", s("No key concepts provided; skipped"))
    d_u3 = when(no_concepts, last=once(rel, when(
        (f"len(x) >= {terms}", say("{n}/{t} key terms in Q+A: {f}", n="len(x)", t="len(kc)", f=shown("x", 5))),
        last=say("Only {n}/{t} key terms in Q+A (need >={m}). Found: {f}, missing: {g}", n="len(x)", t="len(kc)", m=terms, f=shown("x"), g=missing),
    )))
    cont = f"list_filter(qw, lambda w: NOT list_contains({lst(v.STOP_WORDS)}, w))"
    often = f"list_transform({cont}, lambda w: len(list_filter({cont}, lambda y: y = w)))"
    most = f"coalesce(list_max({often}), 0)"
    d_u4 = when(
        ("sq = ''", s("Empty output")), ("length(sq) < 5", say("Output too short: '{x}'", x="sq")),
        (f"{most} > 3", say("Word '{w}' repeated {n}x (max 3)", w=f"{cont}[list_position({often}, {most})]", n=most)), last=s("No degenerate patterns detected"),
    )
    found2 = outer_(concepts("q"))
    d_r2 = when(no_concepts, last=once(found2, when(
        ("len(x) <= 2", say("{n} concept(s) found: {f} (max 2)", n="len(x)", f=shown("x"))), last=say("{n} concepts found: {f} (max 2). Remember questions should target a single concept.", n="len(x)", f=shown("x")))))
    ac = f"list_filter(aw, lambda w: NOT list_contains({lst(v.ANSWER_STOP_WORDS)}, w))"
    r4 = f"(CASE WHEN len({ac}) = 0 THEN 1.0 ELSE {overlap(ac, 'pw')} END)"
    d_r4 = when((f"len({ac}) = 0", s("No content words in answer; skipped")), last=once(r4, when(
        ("x >= 0.6", say("{p} of answer words found in passage (threshold 60%)", p=percent("x"))), last=say("Only {p} of answer words found in passage (need >=60%). Remember answers should be directly extractable.", p=percent("x")))))
    d2 = f"(CASE WHEN len(aw) < 5 THEN 0.0 ELSE len(list_intersect({tri('aw')}, {tri('pw')}))::DOUBLE / len({tri('aw')}) END)"
    d_d2 = when(("len(aw) < 5", s("Answer too short to evaluate; skipped")), last=once(d2, when(
        ("x < 0.7", say("{p} trigram overlap with passage (max 70%). Answer is paraphrased.", p=percent("x"))), last=say("{p} trigram overlap with passage (max 70%). Understand answers should paraphrase, not copy.", p=percent("x")))))

    def semantic(text: str, value: str, score: str, test: str, yes: str, no: str) -> Rule:
        skip, ok, number = f"(coalesce(passage, '') = '' OR coalesce({text}, '') = '')", f"({value}) {test}", f"printf('%.3f', {value})"
        return f"({skip} OR {ok})", f"(CASE WHEN {skip} THEN 1.0 ELSE {score} END)", when((skip, s(f"Missing passage or {text}; skipped")), (ok, say(yes, x=number)), last=say(no, x=number))

    con, foreign, novel = "c_answer / 100.0::DOUBLE", "(n_question / 100.0::DOUBLE + c_question / 100.0::DOUBLE)", "(n_answer / 100.0::DOUBLE + c_answer / 100.0::DOUBLE)"
    good = r"list_filter(mp, lambda m: len(regexp_extract_all(m, '\S+')) <= 5 AND length(m) > 3)"
    share, named, methods = overlap("qat", "pw"), concepts("qa"), concepts("qa", good)
    p3 = f"(CASE WHEN len({named}) > 0 OR len({methods}) > 0 THEN 1.0 WHEN len(pw) > 0 AND {share} >= 0.2 THEN 0.8 WHEN len(kc) = 0 AND len(mp) = 0 THEN 1.0 ELSE 0.0 END)"
    d_p3 = when(
        (f"len({named}) > 0", say("References passage concept: {f}", f=shown(named, 3))), (f"len({methods}) > 0", say("References method/principle: {f}", f=f"({methods})[1]")),
        (f"len(pw) > 0 AND {share} >= 0.2", say("Q+A shares {p} vocabulary with passage", p=percent(share))), ("len(kc) = 0 AND len(mp) = 0", s("No concepts/methods provided; skipped")),
        last=s("Q+A does not reference passage concepts or methods."),
    )
    p4 = f"regexp_matches(a, {s('|'.join(f'(?:{p})' for p in v.RESULTS))})"
    hit = "coalesce(" + ", ".join(f"nullif(regexp_extract(a, {s(p)}), '')" for p in v.RESULTS) + ")"
    d_p4 = when((p4, say("Answer contains specific result: '{x}'", x=hit)), last=s("Answer lacks specific result (no numbers, steps, or outcomes). Apply answers should contain concrete results."))
    a2 = f"(list_transform([{acronyms()}], lambda f: CASE WHEN len({outer_('f')}) > 0 THEN {outer_('f')} ELSE f END))[1]"
    d_a2 = when(no_concepts, last=once(a2, when(
        ("len(x) >= 2", say("{n} concepts found: {f} (min 2)", n="len(x)", f=shown("x", 4))), last=say("Only {n} concept(s) found: {f} (need >=2). Analyze questions must connect multiple ideas.", n="len(x)", f=shown("x")))))
    qc = concepts("q")
    both = concepts("a", qc)
    a4 = f"(CASE WHEN len({qc}) = 0 THEN 1.0 ELSE len({both})::DOUBLE / len({qc}) END)"
    lost = f"list_filter({qc}, lambda k: NOT list_contains({both}, k))"
    d_a4 = when(
        no_concepts, (f"len({qc}) = 0", s("No passage concepts in question; skipped")), (f"len({lost}) = 0", say("Answer covers all {n} concepts: {f}", n=f"len({qc})", f=shown(qc))),
        last=say("Answer missing concepts: {f}. Only covers {n}/{t}.", f=shown(lost), n=f"len({both})", t=f"len({qc})"),
    )
    specs = f"list_filter({lst(v.SPECS)}, lambda m: contains(q, m))"
    d_c3 = once(specs, when(
        ("len(x) >= 2", say("{n} specification markers found: {f} (min 2)", n="len(x)", f=shown("x", 4))), last=say("Only {n} spec marker(s): {f} (need >=2). Create questions should specify what to produce.", n="len(x)", f=shown("x"))))
    by = lambda col, f, none: f"(CASE {col} " + " ".join(f"WHEN {n} THEN {f(n, x)}" for n, x in v.VERBS.items()) + f" ELSE {none} END)"
    verb = lambda col: by(col, lambda n, x: has("q", x), "NULL")
    which = lambda col: by(col, lambda n, x: first("q", x), "NULL")
    name = lambda col: by(col, lambda n, x: s(v.LEVELS[n]), s("?"))
    an, av = f"(mode <> 'adversarial' OR NOT coalesce({verb('level')}, false))", f"(mode <> 'adversarial' OR coalesce({verb('vocab_level')}, true))"
    of_vocab, of_level = {"n": "vocab_level", "l": name("vocab_level")}, {"n": "level", "l": name("level")}
    d_av = when(
        ("mode <> 'adversarial' OR vocab_level IS NULL", s("Not adversarial mode; skipped")), (verb("vocab_level"), say("Uses vocabulary from L{n} ({l}): '{x}'", x=which("vocab_level"), **of_vocab)),
        last=say("Does not use vocabulary from L{n} ({l}). Expected one of: {f}...", f=by("vocab_level", lambda n, x: shown(lst(x), 5), "''"), **of_vocab),
    )
    d_an = when(
        ("mode <> 'adversarial'", s("Not adversarial mode; skipped")),
        (verb("level"), say("Uses target vocabulary '{x}' from L{n} ({l}). Adversarial mode should use only the specified vocabulary level.", x=which("level"), **of_level)), last=say("Avoids target L{n} ({l}) vocabulary", **of_level),
    )
    return {
        "U1": (f"({u1}) > 0", u1, d_u1),
        "U2": (f"(len(qw) >= {least} AND len(qw) <= 150)", f"(CASE WHEN len(qw) < {least} THEN len(qw)::DOUBLE / {least} WHEN len(qw) > 150 THEN 150::DOUBLE / len(qw) ELSE 1.0 END)", d_u2),
        "U3": (f"(len(kc) = 0 OR len({rel}) >= {terms})", f"(CASE WHEN len(kc) = 0 THEN 1.0 ELSE least(len({rel})::DOUBLE / {terms}, 1.0) END)", d_u3),
        "U4": (f"(length(sq) >= 5 AND {most} <= 3)", f"(CASE WHEN length(sq) < 5 THEN 0.0 WHEN {most} > 3 THEN 3::DOUBLE / {most} ELSE 1.0 END)", d_u4),
        "R1": voc(1, "Remember", v.RECALL, "recall", "No Remember verbs or recall patterns found. Expected Bloom's verbs ['define', 'list', 'recall', 'identify']... or patterns like 'What is', 'How many', 'When did'..."),
        "R2": (f"len({found2}) <= 2", f"(CASE WHEN len({found2}) <= 2 THEN 1.0 ELSE 2::DOUBLE / len({found2}) END)", d_r2),
        "R3": (
            "len(aw) <= 20", "(CASE WHEN len(aw) <= 20 THEN 1.0 ELSE 20::DOUBLE / len(aw) END)",
            when(("len(aw) <= 20", say("Answer is {n} words (max 20)", n="len(aw)")), last=say("Answer is {n} words (max 20). Remember answers should be short, factual.", n="len(aw)")),
        ),
        "R4": (f"({r4}) >= 0.6", r4, d_r4),
        "D1": voc(2, "Understand", v.COMPREHENSION, "comprehension", "No Understand verbs or comprehension patterns found. Expected Bloom's verbs ['explain', 'describe', 'summarize', 'interpret']... or patterns like 'Why is', 'How does', 'What is the purpose'..."),
        "D2": (f"{d2} < 0.7", f"(1 - {d2})", d_d2),
        "D4": marked("q", v.MEANING, "Contains meaning marker:", "No meaning markers found (how/why/explain/describe). Understand questions should ask about meaning."),
        "D3": semantic("answer", con, f"(1 - {con})", "< 0.5", "Answer consistent with passage: contradiction={x} (threshold <0.5)", "Answer contradicts passage: contradiction={x} (need <0.5). Understand answers must be consistent with the text."),
        "P1": voc(3, "Apply", v.APPLICATION, "application", "No Apply verbs or application patterns found. Expected Bloom's verbs ['calculate', 'solve', 'apply', 'demonstrate']... or patterns like 'If a...', 'Given that...', 'How would you...'..."),
        "P3": (f"({p3}) > 0", p3, d_p3), "P4": (p4, f"(CASE WHEN {p4} THEN 1.0 ELSE 0.0 END)", d_p4),
        "P2": semantic("question", foreign, foreign, ">= 0.55", "Question presents novel scenario: non-entailment={x} (threshold 0.55)", "Scenario too similar to passage: non-entailment={x} (need >=0.55). Apply questions should present a new scenario."),
        "A1": voc(4, "Analyze", v.ANALYSIS, "analytical", "No Analyze verbs or analytical patterns found. Expected Bloom's verbs ['compare', 'contrast', 'examine', 'differentiate']... or patterns like 'How do X differ', 'What is the relationship'..."),
        "A2": (f"(len(kc) = 0 OR len({a2}) >= 2)", f"(CASE WHEN len(kc) = 0 THEN 1.0 ELSE least(len({a2})::DOUBLE / 2, 1.0) END)", d_a2),
        "A3": marked("q", v.RELATIONSHIP, "Contains relationship marker:", "No relationship markers found (between/differ/compare/affect). Analyze questions should ask about relationships."),
        "A4": (f"({a4}) >= 1", a4, d_a4),
        "E1": voc(5, "Evaluate", None, "", "No Evaluate verbs found. Expected one of: ['assess', 'critique', 'judge', 'justify', 'argue', 'defend']..."),
        "E2": marked("q", v.CLAIM, "Contains claim/judgment prompt:", "No claim/judgment markers found. Evaluate questions should present something to evaluate."),
        "E3": marked("q", v.EVIDENCE, "Contains evidence request:", "No evidence markers found (based on/evidence/justify). Evaluate questions should ask for evidence-based reasoning."),
        "E4": marked("a", v.ARGUMENT, "Answer contains contrastive marker:", "Answer lacks contrastive markers (however/although/but). Evaluate answers should contain argumentation."),
        "C1": voc(6, "Create", None, "", "No Create verbs found. Expected one of: ['design', 'develop', 'propose', 'construct', 'formulate', 'synthesize']..."),
        "C3": (f"len({specs}) >= 2", f"least(len({specs})::DOUBLE / 2, 1.0)", d_c3),
        "C4": (
            "len(aw) > 50", "least(len(aw)::DOUBLE / 50, 1.0)",
            when(("len(aw) > 50", say("Answer is {n} words (min 50)", n="len(aw)")), last=say("Answer is only {n} words (need >50). Create answers should be substantial.", n="len(aw)")),
        ),
        "C2": semantic("answer", novel, novel, ">= 0.6", "Answer is novel: non-entailment={x} (threshold 0.6)", "Answer too similar to passage: non-entailment={x} (need >=0.6). Create answers should produce something new."),
        "AV": (av, f"(CASE WHEN {av} THEN 1.0 ELSE 0.0 END)", d_av), "AN": (an, f"(CASE WHEN {an} THEN 1.0 ELSE 0.5 END)", d_an),
    }


RULES = rules()


def constraint(i: str) -> str:
    ok, score, details = RULES[i]
    return f"WITH {WORDS}, {GENS}, {BOUND} SELECT gen_id, {ok} AS passed, ({score})::DOUBLE AS score, {details} AS details FROM b"


def _applies(tier: str, i: str, levels: list[int]) -> str:
    if tier == "universal":
        return "true"
    if tier == "adversarial":
        return "mode = 'adversarial'"
    return f"level = {levels[0]}" + (" AND mode = 'standard'" if tier == "structural" and i.endswith("1") else "")


#: One row for each result of each record, and one for each record.
RESULTS = "res AS (" + " UNION ALL ".join(
    f"SELECT gen_id, model, mode, level, subject, {n} AS ord, {s(i)} AS id, {s(tier)} AS tier, {RULES[i][0]} AS passed, ({RULES[i][1]})::DOUBLE AS score, {RULES[i][2]} AS details FROM b WHERE q <> '' AND {_applies(tier, i, levels)}"
    for n, (i, _, tier, levels, _) in enumerate(v.DESCRIBED)
) + f"""),
ev AS (SELECT b.gen_id, b.model, b.mode, b.level, b.subject, count(r.id) AS n, coalesce(count(r.id) > 0 AND bool_and(r.passed), false) AS all_passed, count_if(r.passed) AS n_pass, coalesce(bool_and(r.score >= 0.5), true) AS loose
  FROM b LEFT JOIN res r USING (gen_id) GROUP BY ALL)"""
BASE = f"WITH {WORDS}, {GENS}, {BOUND}, {RESULTS} "


OPENING = "You are generating an educational question from a textbook passage.\n\nPASSAGE:\n"
CLOSING = "\n\nRespond in this EXACT format (nothing else):\nQUESTION: [your question]\nANSWER: [a reference answer]"


TOC = """leaves AS (SELECT (page_id // 20)::VARCHAR AS book, (row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) - 1)::INT AS place, (page_id // 20 % 4 + 2)::INT AS depth, page_id,
  CASE WHEN page_id % 11 = 0 THEN 'preface' ELSE (page_id % 20 // 5) || '-' || (page_id % 5) || '-' || CASE WHEN page_id % 7 = 0 THEN 'key-terms' ELSE 'topic' || page_id END END AS slug, '<b>Page</b> ' || page_id AS title FROM pages)"""


#: Which constraints a level and mode call for, in order, with the line that describes each.
CALLED = "(VALUES " + ", ".join(
    f"({s(m)}, {n}, {o}, {s(i)}, {s(tier)}, {s(name)}, {s(said)})" for m in ("standard", "adversarial") for n in v.LEVELS for o, (i, name, tier, said) in enumerate(
        (i, name, tier, said) for i, name, tier, ls, said in v.DESCRIBED if tier == "universal" or (tier == "adversarial" and m == "adversarial") or (n in ls and not (m == "adversarial" and tier == "structural" and i.endswith("1"))))
) + ") AS t(mode, level, ord, id, tier, name, said)"


def rates(by: str, src: str = "ev", ok: str = "all_passed", where: str = "true", more: str = "") -> str:
    return f"{BASE} SELECT {by}, count(*) AS n_total, count_if({ok})::BIGINT AS n_pass, {more} count_if({ok})::DOUBLE / count(*) AS rate FROM {src} WHERE {where} GROUP BY ALL"


def gap(by: str) -> str:
    """Published rates have four digits; the gap is theirs."""
    one = lambda m: f"round(coalesce(count_if(mode = '{m}' AND all_passed)::DOUBLE / nullif(count_if(mode = '{m}'), 0), 0.0), 4)"
    return f"SELECT {by}, {one('standard')} AS standard, {one('adversarial')} AS adversarial, round({one('standard')} - {one('adversarial')}, 4) AS gap FROM ev GROUP BY ALL"


def sql() -> dict[str, str]:
    t = f"WITH {WORDS} "
    gx = f"WITH {WORDS}, {GENS}, {BOUND} "
    out = {f"c_{i.lower()}": constraint(i) for i in RULES}
    out |= {
        "tokenize_words": f"SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {toks('lower(text)')} AS w FROM documents)",
        "tokenize_ascii": "SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)",
        "stem_tokens": f"SELECT doc_id, md5(array_to_string(list_transform(w, lambda w: regexp_replace(w, {s(STEM)}, '\\1')), ' ')) AS digest FROM (SELECT doc_id, {toks('lower(text)')} AS w FROM documents)",
        "truncate_400": rf"SELECT doc_id, {words_of('text', '400')} AS text FROM documents",
        "section_cut": r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS ws FROM documents), c AS (SELECT *, array_to_string(ws[1:500], ' ') AS head FROM w),
            e AS (SELECT *, length(head) - instr(reverse(head), '.') AS dot FROM c)
            SELECT doc_id, CASE WHEN len(ws) < 300 THEN NULL WHEN len(ws) <= 800 THEN text WHEN contains(head, '.') AND dot > length(head) * 0.6 THEN head[1:dot + 1] ELSE head END AS section FROM e""",
        "clean_text": r"SELECT doc_id, CASE WHEN length(t) > 150 THEN t END AS text FROM (SELECT doc_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'), '’', ''''), '‘', ''''), '“', '""'), '”', '""'), '–', '-'), '—', '--') AS t FROM documents)".replace("'\"\"'", "'\"'"),
        "word_overlap": f"{gx} SELECT gen_id, {overlap('aw', 'pw')}::DOUBLE AS overlap FROM b",
        "trigram_overlap": f"{gx} SELECT gen_id, CASE WHEN len(aw) < 3 THEN 0.0 ELSE len(list_intersect({tri('aw')}, {tri('pw')}))::DOUBLE / len({tri('aw')}) END AS overlap FROM b",
        "key_concepts_simple": f"{t} SELECT passage_id, array_to_string(key_concepts, '|') AS key_concepts FROM kcs",
        "methods_principles": f"{t} SELECT passage_id, array_to_string(methods_principles, '|') AS methods_principles FROM fx_passages",
        "generations": f"{gx} SELECT gen_id, model, mode, level, vocab_level, passage_id, question, answer, error, raw_response FROM fx_gens",
        "evaluated_records": f"{BASE} SELECT gen_id, n AS n_constraints, all_passed, CASE WHEN n = 0 THEN 0.0 ELSE n_pass::DOUBLE / n END AS pass_rate, CASE WHEN n = 0 THEN 'No question generated' END AS evaluation_error FROM ev",
        "evaluated_results": f"{BASE} SELECT gen_id, id, tier, passed, score, details FROM res",
        "prompt_strict": rates("model, mode"), "prompt_loose": rates("model, mode", ok="loose", more="count_if(n = 0)::BIGINT AS n_empty,"),
        "prompt_pass_rate": rates("model, mode"),
        "constraint_strict": rates("model, mode", "res", "passed"), "constraint_loose": rates("model, mode", "res", f"score >= 0.5"),
        "by_level": rates("model, mode, level"), "by_subject": rates("model, mode, coalesce(subject, 'unknown') AS subject"),
        "by_constraint": rates("model, mode, id", "res", "passed"), "by_tier": rates("model, mode, tier", "res", "passed"),
        "constraint_breakdown": rates("id", "res", "passed", "mode = 'standard'"),
        "adversarial_gap": BASE + gap("model"), "gap_by_level": f"""{BASE}, g AS ({gap('model, level')}) SELECT model, level, coalesce(standard, 0) AS standard, coalesce(adversarial, 0) AS adversarial, coalesce(gap, 0) AS gap
            FROM (SELECT DISTINCT model FROM ev) CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6])::INT AS level) LEFT JOIN g USING (model, level)""",
        "leaderboard": f"""{BASE}, g AS ({gap('model')}), l AS (SELECT model, round(count_if(loose)::DOUBLE / count(*), 4) AS standard_loose FROM ev WHERE mode = 'standard' GROUP BY 1),
            c AS (SELECT model, round(count_if(passed)::DOUBLE / count(*), 4) AS constraint_strict, round(count_if(score >= 0.5)::DOUBLE / count(*), 4) AS constraint_loose FROM res WHERE mode = 'standard' GROUP BY 1),
            r AS (SELECT model FROM (SELECT model, mode, count_if(error IS NOT NULL)::DOUBLE / count(*) AS bad FROM fx_gens GROUP BY ALL) GROUP BY 1 HAVING count(*) = 2 AND max(bad) <= 0.1)
            SELECT g.*, standard_loose, constraint_strict, constraint_loose, row_number() OVER (ORDER BY gap, model)::INT AS rank FROM g SEMI JOIN r USING (model) LEFT JOIN l USING (model) LEFT JOIN c USING (model)""",
        "breakdown": f"""{BASE}, f AS (
            SELECT model, mode, 'prompt' AS kind, '' AS key, NULL AS tier, all_passed AS ok, loose, n = 0 AS empty, error IS NOT NULL AS bad FROM ev JOIN (SELECT gen_id, error FROM fx_gens) USING (gen_id)
            UNION ALL SELECT model, mode, 'level', level::VARCHAR, NULL, all_passed, loose, false, false FROM ev UNION ALL SELECT model, mode, 'subject', coalesce(subject, 'unknown'), NULL, all_passed, loose, false, false FROM ev
            UNION ALL SELECT model, mode, 'constraint', id, tier, passed, score >= 0.5, false, false FROM res)
            SELECT model, mode, kind, key, tier, count(*) AS n_total, count_if(ok)::BIGINT AS n_pass, count_if(loose)::BIGINT AS n_loose, count_if(empty)::BIGINT AS n_empty, count_if(bad)::BIGINT AS n_errors FROM f GROUP BY ALL""",
        "running_progress": f"{BASE} SELECT * FROM (SELECT model, mode, row_number() OVER w AS done, sum(all_passed::INT) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS passed FROM ev WINDOW w AS (PARTITION BY model, mode ORDER BY gen_id)) WHERE done % 10 = 0",
        "complete_files": f"{gx} SELECT model, mode, count(*) AS n, count_if(error IS NULL)::BIGINT AS n_ok, count_if(error IS NULL) >= 20 AS complete FROM fx_gens GROUP BY ALL",
        "ready_models": f"{gx} SELECT model, count(*)::BIGINT AS modes, max(error_rate) AS error_rate, count(*) = 2 AND max(error_rate) <= 0.1 AS ready FROM (SELECT model, mode, count_if(error IS NOT NULL)::DOUBLE / count(*) AS error_rate FROM fx_gens GROUP BY ALL) GROUP BY ALL",
        "work_list": "SELECT doc_id AS passage_id, level::INT AS level, 'standard' AS mode FROM documents, range(1, 7) r(level)",
        "resume_anti_join": f"{gx} SELECT p.passage_id, l::INT AS level, 'adversarial' AS mode FROM fx_passages p, range(1, 7) r(l) WHERE NOT EXISTS (SELECT 1 FROM fx_gens g WHERE g.passage_id = p.passage_id AND g.level = l AND g.mode = 'adversarial' AND g.error IS NULL)",
        "even_sample": "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE n <= 15 OR list_contains(list_transform(range(15), lambda k: floor(k * (n / 15.0::DOUBLE))::BIGINT), i)",
        "passage_ids": "SELECT doc_id, printf('%s_%03d', substr(source, 1, 3), i) AS passage_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE len(regexp_extract_all(text, '\\S+')) >= 300) WHERE i <= 15",
        "backend_router": "SELECT conv_id, model, backend, safe, name, params FROM (SELECT DISTINCT conv_id FROM conversations) JOIN (VALUES " + ", ".join(
            f"({k}, {s(m)}, {s(b if b in ('openai', 'google', 'together') else 'ollama')}, {s(m.translate(str.maketrans(':./', '___')))}, {s(n)}, {s(z)})" for k, (m, b, n, z) in enumerate(v.MODELS)
        ) + f", ({len(v.MODELS)}, 'my.model:x', 'ollama', 'my_model_x', 'my.model:x', '?'), ({len(v.MODELS) + 1}, 'gemini-9', 'google', 'gemini-9', 'gemini-9', '?')) AS t(k, model, backend, safe, name, params) ON conv_id % {len(v.MODELS) + 2} = k",
        "constraint_matrix": f"{gx} SELECT DISTINCT mode, level, ord, id, tier FROM fx_gens JOIN {CALLED} USING (mode, level)",
        "constraint_counts": f"{gx} SELECT mode, level, CASE mode WHEN 'standard' THEN 8 ELSE 9 END AS n FROM fx_gens GROUP BY ALL",
        "describe_constraints": f"{gx}, d AS (SELECT mode, level, string_agg('- ' || name || ': ' || said, chr(10) ORDER BY ord) AS description FROM {CALLED} WHERE tier <> 'universal' GROUP BY ALL) SELECT gen_id, description FROM fx_gens JOIN d USING (mode, level)",
        "last_passage": f"""{gx}, p AS (SELECT passage_id // 2 AS passage_id, arg_max(text, passage_id) AS text, arg_max(key_concepts, passage_id) AS kc FROM fx_passages GROUP BY 1)
            SELECT gen_id, md5(p.text) AS digest, array_to_string(kc, '|') AS key_concepts FROM (SELECT gen_id, passage_id // 2 AS passage_id FROM fx_gens) LEFT JOIN p USING (passage_id)""",
        "nli_pairs": f"""{gx}, n AS (SELECT gen_id, CASE WHEN level = 3 THEN 'question' ELSE 'answer' END AS kind, {words_of('passage', '400')} AS p, CASE WHEN level = 3 THEN question ELSE answer END AS hypothesis FROM fx_gens WHERE level IN (2, 3, 6) AND coalesce(passage, '') <> ''),
            m AS (SELECT *, sha256(sha256(p) || sha256(hypothesis)) AS pair FROM n WHERE coalesce(hypothesis, '') <> '')
            SELECT gen_id, kind, pair, md5(p) AS premise, hypothesis, count(*) OVER (PARTITION BY pair) AS n_equal FROM m""",
        # a document that the second go adds to loses its earlier errors; of records that repeat a passage and level the last stays
        "generation_files": f"""{gx}, h AS (SELECT *, CASE WHEN gen_id // 1000 % 3 = 0 OR gen_id // 2 % 2 = 0 THEN 0 ELSE 1 END AS half FROM fx_gens),
            k AS (SELECT * FROM h WHERE half = 1 OR error IS NULL OR NOT EXISTS (SELECT 1 FROM h o WHERE o.half = 1 AND o.model = h.model AND o.mode = h.mode))
            SELECT model, mode, model AS model_safe, mode AS file_mode, passage_id::VARCHAR AS passage_id, level, CASE level {" ".join(f"WHEN {n} THEN {s(x)}" for n, x in v.LEVELS.items())} END AS level_name, question, error, gen_id / 8.0 AS latency_ms, gen_id::VARCHAR AS timestamp
            FROM k QUALIFY row_number() OVER (PARTITION BY model, mode, passage_id, level ORDER BY half DESC, gen_id DESC) = 1""",
        "evaluation_files": f"{BASE} SELECT gen_id, model, mode, n AS n_constraints, all_passed, CASE WHEN n = 0 THEN 0.0 ELSE round(n_pass::DOUBLE / n, 4) END AS pass_rate, CASE WHEN n = 0 THEN 'No question generated' END AS evaluation_error FROM ev",
        "submission": f"""{BASE}, g AS ({gap('model')}), p AS (SELECT model, round(count_if(loose AND mode = 'standard')::DOUBLE / count_if(mode = 'standard'), 4) AS prompt_loose, count_if(mode = 'standard')::BIGINT AS n_standard, count_if(mode = 'adversarial')::BIGINT AS n_adversarial FROM ev GROUP BY 1),
            c AS (SELECT model, round(count_if(passed)::DOUBLE / count(*), 4) AS constraint_strict, round(count_if(score >= 0.5)::DOUBLE / count(*), 4) AS constraint_loose FROM res WHERE mode = 'standard' GROUP BY 1),
            r AS (SELECT model, count_if(error IS NOT NULL AND mode = 'standard')::BIGINT AS errors FROM fx_gens GROUP BY 1)
            SELECT model, standard AS standard_csr, adversarial AS adversarial_csr, gap, constraint_strict, constraint_loose, prompt_loose, n_standard, n_adversarial, errors FROM g JOIN p USING (model) JOIN c USING (model) JOIN r USING (model) WHERE n_standard > 0 AND n_adversarial > 0""",
        "toc_leaves": f"WITH {TOC} SELECT book, place, depth, slug, title, NULL::VARCHAR AS error FROM leaves",
        "toc_sections": f"WITH {TOC} SELECT book, place, slug, 'Page ' || page_id AS title FROM leaves WHERE regexp_matches(slug, '^\\d+-\\d+') AND NOT contains(slug, 'key-terms')",
        "prompt_standard": f"SELECT doc_id, level::INT AS level, {s(OPENING)} || text || chr(10) || chr(10) || 'TASK: Generate a ' || name || '-level question (Bloom''s Taxonomy) about this passage.' || chr(10) || chr(10) || 'At the ' || name || ' level, students should be able to ' || def || '.' || chr(10) || chr(10) || hint || {s(CLOSING)} AS prompt FROM documents, (VALUES "
        + ", ".join(f"({n}, {s(v.LEVELS[n])}, {s(v.DEFINITIONS[n])}, {s(v.HINTS[n])})" for n in v.LEVELS) + ") l(level, name, def, hint)",
        "prompt_adversarial": f"SELECT doc_id, level::INT AS level, {s(OPENING)} || text || chr(10) || chr(10) || 'TASK: Generate a ' || name || '-level question (Bloom''s Taxonomy), but you MUST use vocabulary from the ' || other || ' level.' || chr(10) || chr(10) || 'The cognitive demand of your question must be ' || name || ' (students should ' || def || '), even though the wording uses ' || other || '-level verbs like: ' || v8 || '.' || chr(10) || chr(10) || 'IMPORTANT: Do NOT use verbs like ' || f6 || '. Instead, use verbs like: ' || r6 || '.' || chr(10) || chr(10) || hint || {s(CLOSING)} AS prompt FROM documents, (VALUES "
        + ", ".join(f"({n}, {s(v.LEVELS[n])}, {s(v.LEVELS[k])}, {s(v.DEFINITIONS[n])}, {s(', '.join(v.VERBS[k][:8]))}, {s(', '.join(v.VERBS[n][:6]))}, {s(', '.join(v.VERBS[k][:6]))}, {s(v.HINTS[n])})" for n, k in sorted(v.PAIRINGS.items())) + ") l(level, name, other, def, v8, f6, r6, hint)",
        "extract_qa": f"""{gx}, r AS (SELECT gen_id, gen_id % 8 AS kind, {strip("coalesce(CASE WHEN gen_id % 8 = 6 THEN regexp_replace(raw_response, '<think>(?s:.*?)</think>' || chr(92) || 's*', '') ELSE raw_response END, '')")} AS t FROM fx_gens),
            m AS (SELECT *, regexp_extract(t, '(?is)QUESTION:\\s*(.+?)(?:ANSWER:|$)', 1) AS q1, regexp_extract(t, '(?is)ANSWER:\\s*(.+)', 1) AS a1, regexp_extract(t, '(?is)(?:^|\\n)\\s*Q:\\s*(.+?)(?:\\nA:|$)', 1) AS q2, regexp_extract(t, '(?is)(?:^|\\n)\\s*A:\\s*(.+)', 1) AS a2,
              length(t) - instr(reverse(t), '?') AS pos, list_filter(list_transform(string_split(t, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS ls FROM r),
            x AS (SELECT *, CASE WHEN t = '' THEN NULL WHEN q1 <> '' AND a1 <> '' THEN q1 WHEN q2 <> '' AND a2 <> '' THEN q2 WHEN contains(t, '?') AND pos > 0 THEN t[1:pos + 1] WHEN len(ls) >= 2 THEN ls[1] ELSE t END AS q,
              CASE WHEN t = '' THEN NULL WHEN q1 <> '' AND a1 <> '' THEN a1 WHEN q2 <> '' AND a2 <> '' THEN a2 WHEN contains(t, '?') AND pos > 0 THEN t[pos + 2:] WHEN len(ls) >= 2 THEN array_to_string(ls[2:], chr(10)) END AS a FROM m)
            SELECT gen_id, {clean('q')} AS question, {clean('a')} AS answer FROM x""",
    }
    return out


def clean(x: str) -> str:
    y = strip(x)
    y = f"CASE WHEN (starts_with({y}, '\"') AND suffix({y}, '\"')) OR (starts_with({y}, '''') AND suffix({y}, '''')) THEN {strip(f'({y})[2:-2]')} ELSE {y} END"
    y = rf"regexp_replace({y}, '^\d+[.)]\s*', '')"
    y = rf"regexp_replace({y}, '^(?i:Question|Answer|Q|A)\s*:\s*', '')"
    return f"nullif({strip(rf'''regexp_replace({y}, '\s+', ' ', 'g')''')}, '')"
