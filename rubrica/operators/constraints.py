"""The thirty constraints as columns.

A row has question, answer, passage (strings), key_concepts, methods_principles (arrays), level, mode,
vocab_level and the entailment scores nli_answer, nli_question (structs, null where there is none).
``prepared`` adds the lowered texts and tokens once; each constraint is then a struct of passed, score
and details. The evidence that details state (a pattern, concepts, counts) is looked for once and
decides the score as well.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as t, vocab as v

#: Makes the struct of a result from passed, score and details.
Make = Callable[[Column, Column, Column], Column]
Rule = Callable[[Make], Column]
LIST = "array<string>"


def plain(passed: Column, score: Column, details: Column) -> Column:
    """A result without its constraint."""
    return F.struct(passed.alias("passed"), score.cast("double").alias("score"), details.alias("details"))


def prepared(rows: DataFrame) -> DataFrame:
    """rows with q, a, qa, p (lowered), qw, aw, pw (tokens), kc, mp (never null)."""
    none = F.array().cast(LIST)
    return rows.withColumns({
        "q": t.lower(F.col("question")), "a": t.lower(F.col("answer")), "p": t.lower(F.col("passage")),
        "qa": F.concat(t.lower(F.col("question")), F.lit(" "), t.lower(F.col("answer"))),
        "qw": t.tokens(F.col("question")), "aw": t.tokens(F.col("answer")), "pw": t.tokens(F.col("passage")),
        "kc": F.coalesce("key_concepts", none), "mp": F.coalesce("methods_principles", none),
    })


def _c(name: str) -> Column:
    return F.col(name)


def _say(i: str, how: str, **values: Column | int | str) -> Column:
    return t.message(v.DETAILS[i][how], **values)


def _yes(score: float | Column = 1.0) -> tuple[Column, Column]:
    return F.lit(True), score if isinstance(score, Column) else F.lit(score)


def _no(score: float | Column = 0.0) -> tuple[Column, Column]:
    return F.lit(False), score if isinstance(score, Column) else F.lit(score)


def contains(i: str, column: str, patterns: list[str]) -> Rule:
    return lambda make: t.first_found([(t.first_of(_c(column), patterns), lambda x: make(*_yes(), _say(i, "ok", found=x)))], make(*_no(), _say(i, "none")))


def vocabulary(i: str, level: int, patterns: list[str] | None, shown: int) -> Rule:
    """A verb of the level, or a natural phrasing; shown: of the verbs in the message."""
    def rule(make: Make) -> Column:
        cases = [(t.first_of(_c("q"), v.VERBS[level]), lambda x: make(*_yes(), _say(i, "verb", found=x)))]
        if patterns:
            cases.append((t.first_of(_c("q"), patterns), lambda x: make(*_yes(0.9), _say(i, "pattern", found=x))))
        return t.first_found(cases, make(*_no(), _say(i, "none", verbs=str(v.VERBS[level][:shown]))))
    return rule


def u1(make: Make) -> Column:
    def judged(s: Column) -> Column:
        low = F.lower(s)
        first = lambda patterns, holds: F.get(F.filter(t.strings(patterns), holds), F.lit(0))
        word = F.coalesce(*(F.when(low.rlike(rf"(?U)\b{w}\b"), F.lit(w)) for w in v.QUESTION_WORDS))
        cases = [
            (first(v.TASK_STARTERS, lambda p: F.startswith(low, p)), lambda x: make(*_yes(0.8), _say("U1", "task", found=x))),
            (first(v.RESPONSE_ENDINGS, lambda p: F.endswith(F.regexp_replace(low, r"\.+$", ""), p)), lambda x: make(*_yes(0.7), _say("U1", "ending", found=x))),
            (word, lambda x: make(*_yes(0.6), _say("U1", "word", found=x))),
        ]
        rest = t.first_found(cases, make(*_no(), _say("U1", "none", found=F.substring(s, -1, 1))))
        return F.when(s == "", make(*_no(), _say("U1", "empty"))).when(s.endswith("?"), make(*_yes(), _say("U1", "mark"))).otherwise(rest)

    return t.let(t.strip(t.text(_c("question"))), judged)


def u2(make: Make) -> Column:
    n, least = F.size(_c("qw")), F.when(_c("level") == 1, F.lit(v.MIN_WORDS_REMEMBER)).otherwise(F.lit(v.MIN_WORDS))
    return (
        F.when(n < least, make(*_no(n / least), _say("U2", "short", n=n, least=least)))
        .when(n > v.MAX_WORDS, make(*_no(F.lit(v.MAX_WORDS) / n), _say("U2", "long", n=n, most=v.MAX_WORDS)))
        .otherwise(make(*_yes(), _say("U2", "ok", n=n)))
    )


def relevant(concepts: Column, qa: Column) -> Column:
    """Concepts that the text mentions, or whose stems it all has."""
    def found(stems: Column) -> Column:
        def has(c: Column) -> Column:
            parts = t.ascii_tokens(c)
            return t.mentions(qa, c) | ((F.size(parts) > 0) & (F.size(F.array_except(t.stems(parts), stems)) == 0))
        return F.filter(concepts, has)
    return t.let(t.stems(t.ascii_tokens(qa)), found)


def without(xs: Column, those: Column) -> Column:
    """Members of xs that are none of those; repeats stay."""
    return F.filter(xs, lambda x: ~F.array_contains(those, x))


def u3(make: Make) -> Column:
    least, total = F.when(_c("level") == 1, F.lit(v.MIN_TERMS_REMEMBER)).otherwise(F.lit(v.MIN_TERMS)), F.size(_c("kc"))

    def judged(found: Column) -> Column:
        n = F.size(found)
        poor = _say("U3", "none", n=n, total=total, least=least, found=t.listed(found), missing=t.listed(without(_c("kc"), found), 3))
        return F.when(n >= least, make(*_yes(F.least(n / least, F.lit(1.0))), _say("U3", "ok", n=n, total=total, found=t.listed(found, 5)))).otherwise(make(*_no(n / least), poor))

    return F.when(total == 0, make(*_yes(), _say("U3", "skipped"))).otherwise(t.let(relevant(_c("kc"), _c("qa")), judged))


def u4(make: Make) -> Column:
    def commonest(words: Column) -> Column:
        """struct(n, place, word): the first of the most frequent words; null if there are none."""
        each = lambda w, i: F.struct(F.size(F.filter(words, lambda x: x == w)).alias("n"), (-i).alias("place"), w.alias("word"))
        return F.array_max(F.transform(F.array_distinct(words), each))

    def judged(s: Column) -> Column:
        often = t.let(F.filter(_c("qw"), lambda w: ~w.isin(v.STOP_WORDS)), commonest)
        fine = make(*_yes(), _say("U4", "ok"))
        repeated = lambda x: make(*_no(F.lit(v.MAX_REPEAT) / x["n"]), _say("U4", "repeated", found=x["word"], n=x["n"], most=v.MAX_REPEAT))
        long = t.let(often, lambda x: F.when(x["n"] > v.MAX_REPEAT, repeated(x)).otherwise(fine))
        return F.when(s == "", make(*_no(), _say("U4", "empty"))).when(F.length(s) < v.MIN_CHARS, make(*_no(), _say("U4", "short", found=s))).otherwise(long)

    return t.let(t.strip(t.text(_c("question"))), judged)


def r2(make: Make) -> Column:
    def judged(found: Column) -> Column:
        n, how = F.size(found), {"found": t.listed(found), "most": v.MAX_CONCEPTS}
        return F.when(n <= v.MAX_CONCEPTS, make(*_yes(), _say("R2", "ok", n=n, **how))).otherwise(make(*_no(F.lit(v.MAX_CONCEPTS) / n), _say("R2", "none", n=n, **how)))

    return F.when(F.size(_c("kc")) == 0, make(*_yes(), _say("R2", "skipped"))).otherwise(t.let(t.outermost(t.concepts_in(_c("q"), _c("kc"))), judged))


def r3(make: Make) -> Column:
    n, most = F.size(_c("aw")), v.MAX_ANSWER_WORDS
    return F.when(n <= most, make(*_yes(), _say("R3", "ok", n=n, most=most))).otherwise(make(*_no(F.lit(most) / n), _say("R3", "none", n=n, most=most)))


def r4(make: Make) -> Column:
    least = f"{v.PASSAGE_OVERLAP:.0%}"

    def judged(x: Column) -> Column:
        return F.when(x >= v.PASSAGE_OVERLAP, make(*_yes(x), _say("R4", "ok", share=t.percent(x), least=least))).otherwise(make(*_no(x), _say("R4", "none", share=t.percent(x), least=least)))

    content = F.filter(_c("aw"), lambda w: ~w.isin(v.ANSWER_STOP_WORDS))
    return t.let(content, lambda ws: F.when(F.size(ws) == 0, make(*_yes(), _say("R4", "skipped"))).otherwise(t.let(t.overlap(ws, _c("pw")), judged)))


def d2(make: Make) -> Column:
    most = f"{v.MAX_TRIGRAMS:.0%}"

    def judged(x: Column) -> Column:
        return F.when(x < v.MAX_TRIGRAMS, make(*_yes(1 - x), _say("D2", "ok", share=t.percent(x), most=most))).otherwise(make(*_no(1 - x), _say("D2", "none", share=t.percent(x), most=most)))

    return F.when(F.size(_c("aw")) < v.MIN_TRIGRAM_WORDS, make(*_yes(), _say("D2", "skipped"))).otherwise(t.let(t.trigram_overlap(_c("aw"), _c("pw")), judged))


def _nli(i: str, text_column: str, scores: str, value: Callable[[Column], Column], passed: Callable[[Column], Column], score: Callable[[Column], Column]) -> Rule:
    """Skipped (passed) without a passage or a text; failed where there is no score."""
    def judged(make: Make) -> Callable[[Column], Column]:
        return lambda x: (
            F.when(x.isNull(), make(*_no(), _say(i, "error", found="no score")))
            .when(passed(x), make(*_yes(score(x)), _say(i, "ok", score=t.thousandths(x)))).otherwise(make(*_no(score(x)), _say(i, "none", score=t.thousandths(x))))
        )

    def rule(make: Make) -> Column:
        none = (t.text(_c("passage")) == "") | (t.text(_c(text_column)) == "")
        return F.when(none, make(*_yes(), _say(i, "skipped"))).otherwise(t.let(value(_c(scores)), judged(make)))
    return rule


def _foreign(x: Column) -> Column:
    """What isn't entailed."""
    return x["neutral"] + x["contradiction"]


def _same(x: Column) -> Column:
    return x


d3 = _nli("D3", "answer", "nli_answer", lambda x: x["contradiction"], lambda x: x < v.MAX_CONTRADICTION, lambda x: 1 - x)
p2 = _nli("P2", "question", "nli_question", _foreign, lambda x: x >= v.MIN_SCENARIO, _same)
c2 = _nli("C2", "answer", "nli_answer", _foreign, lambda x: x >= v.MIN_CREATION, _same)


def p3(make: Make) -> Column:
    some = lambda xs: t.let(xs, lambda f: F.when(F.size(f) > 0, f))
    good = F.filter(_c("mp"), lambda m: (F.size(t.split(m)) <= 5) & (F.length(m) > 3))
    share = F.when(F.size(_c("pw")) > 0, t.overlap(t.ascii_tokens(_c("qa")), _c("pw")))
    cases = [
        (some(t.concepts_in(_c("qa"), _c("kc"))), lambda f: make(*_yes(), _say("P3", "concept", found=t.listed(f, 3)))),
        (some(t.concepts_in(_c("qa"), good)), lambda f: make(*_yes(), _say("P3", "method", found=F.get(f, F.lit(0))))),
        (t.let(share, lambda x: F.when(x >= v.SHARED_VOCABULARY, x)), lambda x: make(*_yes(0.8), _say("P3", "shared", share=t.percent(x)))),
    ]
    none = (F.size(_c("kc")) == 0) & (F.size(_c("mp")) == 0)
    return t.first_found(cases, F.when(none, make(*_yes(), _say("P3", "skipped"))).otherwise(make(*_no(), _say("P3", "none"))))


def p4(make: Make) -> Column:
    return t.first_found([(t.first_match(_c("a"), [f"(?U){p}" for p in v.RESULTS]), lambda x: make(*_yes(), _say("P4", "ok", found=x)))], make(*_no(), _say("P4", "none")))


def with_acronyms(text: Column, concepts: Column) -> Column:
    """Concepts that the text mentions, then those that its acronyms stand for, acronym by acronym."""
    meaning = F.str_to_map(F.lit("|".join(f"{a}={x}" for a, x in v.ACRONYMS.items())), F.lit("[|]"), F.lit("="))

    def extended(found: Column, short: Column) -> Column:
        def more(long: Column) -> Column:
            stands = lambda c: F.contains(F.lower(c), short) | F.contains(long, F.lower(c)) | F.contains(F.lower(c), long)
            return F.filter(concepts, lambda c: ~F.exists(found, lambda x: F.lower(x) == F.lower(c)) & stands(c))

        # once a concept is added, its repeats (up to case) are in already
        first = t.let(t.let(F.element_at(meaning, short), more), lambda m: F.filter(m, lambda c, i: ~F.exists(F.slice(m, F.lit(1), i), lambda x: F.lower(x) == F.lower(c))))
        return F.concat(found, first)

    held = F.regexp_extract_all(text, F.lit(rf"(?U)\b(?:{'|'.join(v.ACRONYMS)})\b"), F.lit(0))
    short = t.let(held, lambda h: F.filter(t.strings(list(v.ACRONYMS)), lambda a: F.array_contains(h, a)))
    return F.aggregate(short, t.concepts_in(text, concepts), extended)


def a2(make: Make) -> Column:
    least = v.MIN_CONCEPTS

    def judged(f: Column) -> Column:
        n = F.size(f)
        return F.when(n >= least, make(*_yes(), _say("A2", "ok", n=n, found=t.listed(f, 4), least=least))).otherwise(make(*_no(n / least), _say("A2", "none", n=n, found=t.listed(f), least=least)))

    outer = t.let(with_acronyms(_c("qa"), _c("kc")), lambda f: t.let(t.outermost(f), lambda o: F.when(F.size(o) > 0, o).otherwise(f)))
    return F.when(F.size(_c("kc")) == 0, make(*_yes(), _say("A2", "skipped"))).otherwise(t.let(outer, judged))


def a4(make: Make) -> Column:
    def judged(asked: Column) -> Column:
        n = F.size(asked)

        def covered(said: Column) -> Column:
            missing = without(asked, said)
            full = make(*_yes(F.size(said) / n), _say("A4", "ok", n=n, found=t.listed(asked)))
            return F.when(F.size(missing) == 0, full).otherwise(make(*_no(F.size(said) / n), _say("A4", "none", missing=t.listed(missing), n=F.size(said), total=n)))

        return F.when(n == 0, make(*_yes(), _say("A4", "unasked"))).otherwise(t.let(t.concepts_in(_c("a"), asked), covered))

    return F.when(F.size(_c("kc")) == 0, make(*_yes(), _say("A4", "skipped"))).otherwise(t.let(t.concepts_in(_c("q"), _c("kc")), judged))


def c3(make: Make) -> Column:
    least = v.MIN_SPECS

    def judged(f: Column) -> Column:
        n = F.size(f)
        return F.when(n >= least, make(*_yes(), _say("C3", "ok", n=n, found=t.listed(f, 4), least=least))).otherwise(make(*_no(n / least), _say("C3", "none", n=n, found=t.listed(f), least=least)))

    return t.let(F.filter(t.strings(v.SPECS), lambda m: F.contains(_c("q"), m)), judged)


def c4(make: Make) -> Column:
    n, least = F.size(_c("aw")), v.MIN_ANSWER_WORDS
    return F.when(n > least, make(*_yes(), _say("C4", "ok", n=n, least=least))).otherwise(make(*_no(n / least), _say("C4", "none", n=n, least=least)))


def _verb_of(column: str) -> Column:
    """The first verb of the level in a column that q has; null for none and for no such level."""
    out = F.lit(None).cast("string")
    for n, verbs in v.VERBS.items():
        out = F.when(_c(column) == n, t.first_of(_c("q"), verbs)).otherwise(out)
    return out


def _name_of(column: str) -> Column:
    return _by_level(column, v.LEVELS)


def _by_level(column: str, values: dict[int, str]) -> Column:
    out = F.lit("?")
    for n, x in values.items():
        out = F.when(_c(column) == n, F.lit(x)).otherwise(out)
    return out


def av(make: Make) -> Column:
    level, where = _c("vocab_level"), {"level": _c("vocab_level"), "name": _name_of("vocab_level")}
    verbs = _by_level("vocab_level", {n: str(x[:5]) for n, x in v.VERBS.items()})
    found = t.first_found([(_verb_of("vocab_level"), lambda x: make(*_yes(), _say("AV", "ok", found=x, **where)))], make(*_no(), _say("AV", "none", verbs=verbs, **where)))
    idle = F.coalesce(_c("mode") != "adversarial", F.lit(True)) | level.isNull()
    return F.when(idle, make(*_yes(), _say("AV", "skipped"))).when(~level.isin(list(v.LEVELS)), make(*_yes(), _say("AV", "unknown", level=level))).otherwise(found)


def an(make: Make) -> Column:
    level, where = _c("level"), {"level": _c("level"), "name": _name_of("level")}
    found = t.first_found([(_verb_of("level"), lambda x: make(*_no(0.5), _say("AN", "none", found=x, **where)))], make(*_yes(), _say("AN", "ok", **where)))
    idle = F.coalesce(_c("mode") != "adversarial", F.lit(True))
    return F.when(idle, make(*_yes(), _say("AN", "skipped"))).when(F.coalesce(~level.isin(list(v.LEVELS)), F.lit(True)), make(*_yes(), _say("AN", "unknown", level=F.coalesce(level.cast("string"), F.lit("None"))))).otherwise(found)


RULES: dict[str, Rule] = {
    "U1": u1, "U2": u2, "U3": u3, "U4": u4,
    "R1": vocabulary("R1", 1, v.RECALL, 4), "R2": r2, "R3": r3, "R4": r4,
    "D1": vocabulary("D1", 2, v.COMPREHENSION, 4), "D2": d2, "D4": contains("D4", "q", v.MEANING), "D3": d3,
    "P1": vocabulary("P1", 3, v.APPLICATION, 4), "P3": p3, "P4": p4, "P2": p2,
    "A1": vocabulary("A1", 4, v.ANALYSIS, 4), "A2": a2, "A3": contains("A3", "q", v.RELATIONSHIP), "A4": a4,
    "E1": vocabulary("E1", 5, None, 6), "E2": contains("E2", "q", v.CLAIM), "E3": contains("E3", "q", v.EVIDENCE), "E4": contains("E4", "a", v.ARGUMENT),
    "C1": vocabulary("C1", 6, None, 6), "C3": c3, "C4": c4, "C2": c2,
    "AV": av, "AN": an,
}


@dataclass
class Registered:
    id: str
    name: str
    tier: str
    levels: list[int]
    rule: Rule
    description: str = ""


def registry() -> list[Registered]:
    return [Registered(i, n, tier, levels, RULES[i], v.DESCRIPTIONS[i]) for i, n, tier, levels in v.CONSTRAINTS] + EXTRA


#: Constraints that callers have registered; they come last.
EXTRA: list[Registered] = []


def register(id: str, name: str, tier: str, levels: list[int], rule: Rule, description: str = "") -> None:
    """The extension point: rule(make) gives make(passed, score, details) from the prepared columns; no levels: all."""
    EXTRA.append(Registered(id, name, tier, levels, rule, description))


def applicable(level: int, mode: str) -> list[Registered]:
    """In order of evaluation. An unknown mode has the universal ones only, an unknown level none of its own."""
    out = []
    for c in registry():
        mine = level in c.levels
        if c.tier == "universal" or (not c.levels and c.tier not in ("universal", "adversarial")):
            out.append(c)
        elif c.tier == "adversarial":
            out += [c] * (mode == "adversarial")
        elif mine and (mode == "standard" or mode == "adversarial" and not (c.tier == "structural" and c.id.endswith("1"))):
            out.append(c)
    return out


def describe(level: int, mode: str) -> str:
    """What a prompt tells a model of the rules: one line a constraint, without the universal ones."""
    return "\n".join(f"- {c.name}: {c.description}" for c in applicable(level, mode) if c.tier != "universal")


def result(c: Registered) -> Column:
    def make(passed: Column, score: Column, details: Column) -> Column:
        return F.struct(F.lit(c.id).alias("id"), F.lit(c.name).alias("name"), passed.alias("passed"), score.cast("double").alias("score"), details.alias("details"), F.lit(c.tier).alias("tier"))

    return c.rule(make)


def applies(c: Registered) -> Column:
    """As in applicable, for the row's level and mode."""
    std, adv = F.col("mode") == "standard", F.col("mode") == "adversarial"
    if c.tier == "adversarial":
        return adv
    if c.tier == "universal" or not c.levels:
        return F.lit(True)
    return F.col("level").isin(c.levels) & (std if c.tier == "structural" and c.id.endswith("1") else std | adv)


_built: dict[tuple, Column] = {}


def results() -> Column:
    """The results of the constraints that a row's level and mode call for, in order. Only those are computed.

    The column names no table, so it is built once for a Spark context and the constraints registered.
    """
    key = (SparkContext._active_spark_context.applicationId, *(id(c) for c in EXTRA))
    if key not in _built:
        _built.clear()
        _built[key] = F.filter(F.array(*(F.when(applies(c), result(c)) for c in registry())), lambda r: r.isNotNull())
    return _built[key]


def called_for() -> Column:
    """What results() has an entry for, without computing it: an array of struct(id, name, tier, description)."""
    one = lambda c: F.struct(F.lit(c.id).alias("id"), F.lit(c.name).alias("name"), F.lit(c.tier).alias("tier"), F.lit(c.description).alias("description"))
    return F.filter(F.array(*(F.when(applies(c), one(c)) for c in registry())), lambda r: r.isNotNull())


def description() -> Column:
    """describe() for the row's level and mode."""
    ruled = F.filter(called_for(), lambda c: c["tier"] != "universal")
    return F.array_join(F.transform(ruled, lambda c: F.concat(F.lit("- "), c["name"], F.lit(": "), c["description"])), "\n")
