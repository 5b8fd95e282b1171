"""Column helpers for text. Null arrays and texts count as empty."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import vocab

#: White space as Python's str.split and str.strip see it.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NONSPACE = SPACE.replace("[", "[^", 1) + "+"
WORD = r"[\p{L}\p{N}_]"
STEM = "^(.{3,}?)(?:" + "|".join(vocab.SUFFIXES) + ")$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; a column used inside a lambda may be inlined and computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(xs: list[str]) -> Column:
    """An array literal. One expression instead of one for each member, which the optimizer folds."""
    return F.split(F.lit("\n".join(xs)), "\n")


def text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def lower(x: Column) -> Column:
    return F.lower(text(x))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def tokens(x: Column) -> Column:
    """Word tokens of a lowered text."""
    return F.regexp_extract_all(lower(x), F.lit(f"{WORD}+"), F.lit(0))


def ascii_tokens(x: Column) -> Column:
    return F.regexp_extract_all(lower(x), F.lit("[a-z]+"), F.lit(0))


def split(x: Column) -> Column:
    """White-space words."""
    return F.regexp_extract_all(text(x), F.lit(NONSPACE), F.lit(0))


def first_words(x: Column, n: int) -> Column:
    return F.array_join(F.slice(split(x), 1, n), " ")


def stem(w: Column) -> Column:
    return F.regexp_replace(w, STEM, "$1")


def stems(ws: Column) -> Column:
    """Distinct stems."""
    return F.array_distinct(F.transform(ws, lambda w: stem(w)))


def any_of(x: Column, patterns: list[str]) -> Column:
    """Whether x contains one of them; one alternation, inside generated code."""
    return x.rlike("|".join(re.escape(p).replace("\\ ", " ") for p in patterns))


def first_of(x: Column, patterns: list[str]) -> Column:
    """The first of the list that x contains, or null: the evidence. The list is gone through only where some pattern occurs."""
    return F.when(any_of(x, patterns), F.get(F.filter(strings(patterns), lambda p: F.contains(x, p)), F.lit(0)))


def first_match(x: Column, patterns: list[str]) -> Column:
    """What the first of the regular expressions that matches x matches, or null."""
    return F.coalesce(*(F.when(x.rlike(p), F.regexp_extract(x, p, 0)) for p in patterns))


def quoted(x: Column) -> Column:
    """A string as Python shows it in a list: quotes chosen by what it holds, control characters and odd white space as escapes."""
    def shown(c: Column) -> Column:
        code = F.ascii(c)  # the code point
        return (
            F.when(c == "\\", F.lit("\\\\")).when(c == "\n", F.lit("\\n")).when(c == "\r", F.lit("\\r")).when(c == "\t", F.lit("\\t"))
            .when(~c.rlike(r"^[\p{C}\p{Z}&&[^ ]]$"), c)
            .when(code < 256, F.format_string("\\x%02x", code)).when(code < 65536, F.format_string("\\u%04x", code)).otherwise(F.format_string("\\U%08x", code))
        )

    plain = F.when(x.rlike(r"[\\\p{C}\p{Z}&&[^ ]]"), F.array_join(F.transform(F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)), shown), "")).otherwise(x)
    return let(plain, lambda y: F.when(~F.contains(x, F.lit("'")), F.concat(F.lit("'"), y, F.lit("'"))).when(~F.contains(x, F.lit('"')), F.concat(F.lit('"'), y, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(y, F.lit("'"), F.lit("\\'")), F.lit("'"))))


def listed(xs: Column, most: int | None = None) -> Column:
    """An array of strings, or its first ones, as Python shows a list."""
    return F.concat(F.lit("["), F.array_join(F.transform(xs if most is None else F.slice(xs, 1, most), quoted), ", "), F.lit("]"))


def percent(x: Column) -> Column:
    """In whole per cent, halves to the even one."""
    return F.concat(F.rint(x * 100).cast("long").cast("string"), F.lit("%"))


def thousandths(x: Column) -> Column:
    """With three digits after the point; x isn't negative."""
    return let(F.rint(x * 1000).cast("long"), lambda n: F.format_string("%d.%03d", F.floor(n / 1000).cast("long"), n % 1000))


def rounded(x: Column, digits: int = 4) -> Column:
    """As Python rounds a double: by its exact value, exact halves to the even digit. x isn't negative enough to overflow."""
    scale = 10.0**digits

    def near(v: Column) -> Column:
        # v * scale is high + low, exactly (Dekker's product; scale has few bits)
        def parts(head: Column) -> Column:
            high = v * scale
            low = (head * scale - high) + (v - head) * scale
            base = F.floor(high)
            half = (high - base == 0.5) & (low != 0)
            return F.when(half, F.when(low > 0, base + 1).otherwise(base)).otherwise(F.rint(high)).cast("double") / scale

        return let(v * 134217729.0 - (v * 134217729.0 - v), parts)

    return let(x.cast("double"), near)


def message(template: str, **values: Column | int | str) -> Column:
    """template with its {names} filled in."""
    parts = re.split(r"\{(\w+)\}", template)
    filled = [F.lit(x) if i % 2 == 0 else values[x].cast("string") if isinstance(values[x], Column) else F.lit(str(values[x])) for i, x in enumerate(parts) if i % 2 or x]
    return F.concat(*filled) if len(filled) > 1 else filled[0]


def first_found(cases: list[tuple[Column, Callable[[Column], Column]]], last: Column) -> Column:
    """result(x) of the first case whose x isn't null; a case is only looked at where those before it found nothing."""
    if not cases:
        return last
    (found, result), *rest = cases
    return let(found, lambda x: F.when(x.isNotNull(), result(x)).otherwise(first_found(rest, last)))


def escaped(x: Column) -> Column:
    """For a regular expression."""
    return F.regexp_replace(x, r"([^\p{L}\p{N}_\s])", r"\\$1")


def mentions(x: Column, concept: Column) -> Column:
    return F.rlike(x, F.concat(F.lit(r"(?U)\b"), escaped(F.lower(concept)), F.lit(r"(?:s|es|ed|ing)?\b")))


def concepts_in(x: Column, concepts: Column) -> Column:
    """Those that x mentions, in their order, repeats included."""
    return let(x, lambda t: F.filter(F.coalesce(concepts, F.array().cast("array<string>")), lambda c: mentions(t, c)))


def outermost(found: Column) -> Column:
    """Without those that are part of another one."""
    return let(found, lambda all_: F.filter(all_, lambda c: ~F.exists(all_, lambda o: (c != o) & F.contains(F.lower(o), F.lower(c)))))


def share(part: Column, whole: Column) -> Column:
    """Of two counts; 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Distinct stems of a that b has, over those of a."""
    return let(stems(a), lambda sa: share(F.size(F.array_intersect(sa, stems(b))), F.size(sa)))


def trigrams(ws: Column) -> Column:
    """Distinct, as texts: sets of arrays would be compared pair by pair."""
    return F.when(F.size(ws) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(ws) - 2), lambda i: F.array_join(F.slice(ws, i, 3), " ")))).otherwise(F.array().cast("array<string>"))


def trigram_overlap(a: Column, b: Column) -> Column:
    return let(a, lambda x: let(trigrams(x), lambda ta: let(b, lambda y: share(F.size(F.array_intersect(ta, trigrams(y))), F.size(ta)))))


def cut_section(x: Column, target: int = 500, least: int = 300, most: int = 800) -> Column:
    """Null under least words; whole up to most; else the first target words, ended at the last full stop if that is in the last two fifths."""
    def cut(ws: Column) -> Column:
        def end(t: Column) -> Column:
            at = F.length(t) - F.locate(".", F.reverse(t))
            return F.when(F.contains(t, F.lit(".")) & (at > F.length(t) * 0.6), F.substring(t, F.lit(1), at + 1)).otherwise(t)
        return F.when(F.size(ws) < least, F.lit(None).cast("string")).when(F.size(ws) <= most, x).otherwise(let(F.array_join(F.slice(ws, 1, target), " "), end))
    return let(split(x), cut)


TYPOGRAPHIC = [("\u2019", "'"), ("\u2018", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\u2013", "-"), ("\u2014", "--")]


def clean(x: Column) -> Column:
    """White space collapsed, typographic characters mapped, null unless over 150 characters remain."""
    y = strip(F.regexp_replace(x, f"{SPACE}+", " "))
    for a, b in TYPOGRAPHIC:
        y = F.replace(y, F.lit(a), F.lit(b))
    return let(y, lambda z: F.when(F.length(z) > 150, z))
