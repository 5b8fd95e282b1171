"""Question and answer from raw model output; the first strategy that applies wins."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import text as t, vocab as v

def _marker(pattern: str) -> str:
    return "(?isU)" + pattern.replace(r"\s", t.SPACE)


QUESTION, ANSWER, Q, A = map(_marker, (v.QUESTION_MARKER, v.ANSWER_MARKER, v.SHORT_QUESTION_MARKER, v.SHORT_ANSWER_MARKER))


def strip_think(raw: Column, model: Column) -> Column:
    """Reasoning models' think blocks go."""
    reasons = model.contains("deepseek-r1") | F.substring_index(model, ":", -1).contains("r1")
    return F.when(reasons, t.strip(F.regexp_replace(raw, rf"(?s)<think>.*?</think>{t.SPACE}*", ""))).otherwise(raw)


def clean(x: Column) -> Column:
    """Surrounding quotes, a leading number, a leading label and repeated white space go; null if nothing is left."""
    y = t.strip(x)
    y = t.let(y, lambda s: F.when(s.rlike(r"""(?s)\A(?:".*"|'.*'|["'])\z"""), F.when(F.length(s) < 2, F.lit("")).otherwise(t.strip(F.substring(s, F.lit(2), F.length(s) - 2)))).otherwise(s))
    y = F.regexp_replace(y, rf"(?U)^\d+[.)]{t.SPACE}*", "")
    y = F.regexp_replace(y, rf"(?iU)^(?:Question|Answer|Q|A){t.SPACE}*:{t.SPACE}*", "")
    y = t.strip(F.regexp_replace(y, f"{t.SPACE}+", " "))
    return F.nullif(y, F.lit(""))


def extract_qa(raw: Column) -> Column:
    """struct(question, answer), each null where there is none."""
    def pair(q: Column, a: Column) -> Column:
        return F.struct(clean(q).alias("question"), clean(a).alias("answer"))

    none = F.lit(None).cast("string")

    def found(s: Column) -> Column:
        marked = s.rlike(QUESTION) & s.rlike(ANSWER)
        short = s.rlike(Q) & s.rlike(A)
        at = F.length(s) - F.locate("?", F.reverse(s))  # of the last question mark, from 0
        rest = t.strip(F.substring(s, at + 2, F.length(s)))
        lines = F.filter(F.transform(F.split(s, "\n"), lambda x: t.strip(x)), lambda x: x != "")
        return (
            F.when(s == "", F.struct(none.alias("question"), none.alias("answer")))
            .when(marked, pair(F.regexp_extract(s, QUESTION, 1), F.regexp_extract(s, ANSWER, 1)))
            .when(short, pair(F.regexp_extract(s, Q, 1), F.regexp_extract(s, A, 1)))
            .when(F.contains(s, F.lit("?")) & (at > 0), pair(F.substring(s, F.lit(1), at + 1), F.nullif(rest, F.lit(""))))
            .when(F.size(lines) >= 2, t.let(lines, lambda ls: pair(F.get(ls, F.lit(0)), F.array_join(F.slice(ls, F.lit(2), F.size(ls)), "\n"))))
            .otherwise(pair(s, none))
        )

    return t.let(t.strip(t.text(raw)), found)
