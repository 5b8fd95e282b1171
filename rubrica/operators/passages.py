"""Passages: table-of-contents filter, sampling, page text, sections, concepts and methods."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as t, vocab as v
from . import metrics

CONCEPTS, METHODS = 8, 6
METHOD_PATTERNS = [f"(?iU){p}" for p in v.METHOD_PATTERNS]
METHOD_WORDS = [f"(?i){p}" for p in v.METHOD_WORDS]


def methods_principles(x: Column) -> Column:
    """Named laws, principles and methods, in the order of the patterns, the first six different ones."""
    # the lazy patterns are slow where none of their closing words occurs
    none = F.array().cast("array<string>")
    found = F.concat(*(F.when(t.text(x).rlike(closing), F.regexp_extract_all(t.text(x), F.lit(p), F.lit(1))).otherwise(none) for p, closing in zip(METHOD_PATTERNS, METHOD_WORDS)))
    tidy = F.transform(found, lambda m: F.lower(t.strip(m)))
    return F.slice(F.array_distinct(F.filter(tidy, lambda m: (F.length(m) > 3) & (F.size(t.split(m)) <= 5))), 1, METHODS)


def runs(words: Column) -> Column:
    """struct(n, place, word) of each different word: how often it occurs, and where first. The words are sorted and the runs counted, so a long text costs n log n."""
    def counted(s: Column) -> Column:
        at = F.transform(s, lambda x, i: F.struct(x["word"].alias("word"), x["place"].alias("place"), i.alias("at")))
        first = F.filter(at, lambda x: (x["at"] == 0) | (F.get(s, x["at"] - 1)["word"] != x["word"]))
        size = lambda f, x, k: F.coalesce(F.get(f, k + 1)["at"], F.size(s)) - x["at"]
        return t.let(first, lambda f: F.transform(f, lambda x, k: F.struct(size(f, x, k).alias("n"), x["place"].alias("place"), x["word"].alias("word"))))

    return t.let(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("place")))), counted)


def concepts(x: Column, most: int = CONCEPTS) -> Column:
    """Capitalised terms of a text in order, then its frequent words, most frequent first, ties by first place. All within the row: nothing is shuffled."""
    words = F.filter(F.regexp_extract_all(t.lower(x), F.lit(r"(?U)\b[a-z]{4,}\b"), F.lit(0)), lambda w: ~w.isin(v.CONCEPT_STOP_WORDS))
    ranked = F.sort_array(F.transform(F.filter(runs(words), lambda r: r["n"] >= 2), lambda r: F.struct((-r["n"]).alias("n"), r["place"].alias("place"), r["word"].alias("word"))))
    frequent = F.transform(F.slice(ranked, 1, 2 * most), lambda r: r["word"])
    named = F.transform(F.regexp_extract_all(t.text(x), F.lit(f"(?U){v.CAPITALISED}"), F.lit(0)), lambda n: F.lower(n))
    return F.slice(F.array_distinct(F.concat(named, frequent)), 1, most)


def key_concepts(passages: DataFrame, most: int = CONCEPTS) -> DataFrame:
    """(passage_id, key_concepts) of each row; rows that repeat an id have their own."""
    return passages.select("passage_id", concepts(F.col("text"), most).alias("key_concepts"))


def processed(passages: DataFrame) -> DataFrame:
    """passages (passage_id, text, ...) with key_concepts and methods_principles, row by row; a passage without text keeps those it has."""
    none = F.array().cast("array<string>")
    had = lambda c: F.coalesce(F.col(c), none) if c in passages.columns else none
    empty = t.text(F.col("text")) == ""
    made = {"methods_principles": methods_principles(F.col("text")), "key_concepts": concepts(F.col("text"))}
    return passages.withColumns({c: F.when(empty, had(c)).otherwise(x) for c, x in made.items()})


def content_pages(toc: DataFrame) -> DataFrame:
    """Numbered content leaves of a table of contents (slug, title)."""
    kept = toc.where(F.col("slug").rlike(r"^\d+-\d+") & ~t.any_of(F.col("slug"), v.SKIPPED_PAGES))
    return kept.withColumn("title", t.strip(F.regexp_replace("title", "<[^>]+>", "")))


def evenly(rows: DataFrame, n: int, by: str, key: str) -> DataFrame:
    """n rows of each group, evenly spaced in the order of key; all where there are no more. Places come in two levels, so a group isn't one task's."""
    count = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    ranked = metrics.placed(rows, [by], key).withColumn("_i", F.col("_at") - 1)
    ranked = ranked.join(count, F.col(by).eqNullSafe(F.col("_by"))).drop("_by", "_at")
    step = F.col("_n") / n
    # row i is taken if some k < n has floor(k * step) = i
    k = F.ceil(F.col("_i") / step).cast("long")
    hit = lambda k: (k >= 0) & (k < n) & (F.floor(k * step) == F.col("_i"))
    return ranked.where((F.col("_n") <= n) | hit(k) | hit(k - 1) | hit(k + 1)).drop("_i", "_n")


def with_ids(passages: DataFrame, subject: str, key: str, most: int = v.PASSAGES_PER_SUBJECT) -> DataFrame:
    """The first accepted passages of each subject, numbered like bio_001."""
    at = F.row_number().over(Window.partitionBy(subject).orderBy(key))
    return passages.withColumn("_n", at).where(F.col("_n") <= most).withColumn("passage_id", F.format_string("%s_%03d", F.substring(subject, 1, 3), F.col("_n"))).drop("_n")


DROPPED, DROPPED_CLASS = frozenset(v.DROPPED_TAGS), re.compile("|".join(v.DROPPED_CLASSES))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Paragraphs(HTMLParser):
    """Texts of the p elements in the first of the containers found."""

    def __init__(self, wanted):
        super().__init__(convert_charrefs=True)
        self.wanted, self.stack, self.inside, self.dropped, self.done = wanted, [], 0, 0, False
        self.open, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag in VOID or self.done:
            return
        at = dict(attrs)
        kind = "inside" if not self.inside and self.wanted(tag, at) else "dropped" if self.inside and (tag in DROPPED or DROPPED_CLASS.search(at.get("class") or "")) else ""
        self.inside += kind == "inside"
        self.dropped += kind == "dropped"
        if tag == "p" and self.inside and not self.dropped:
            self.open.append(parts := [])
            self.out.append(parts)
        self.stack.append((tag, kind, tag == "p" and self.inside and not self.dropped))

    def handle_endtag(self, tag):
        if not any(s[0] == tag for s in self.stack):
            return
        while self.stack:
            name, kind, paragraph = self.stack.pop()
            self.inside -= kind == "inside"
            self.dropped -= kind == "dropped"
            self.done |= kind == "inside"
            if paragraph and self.open:
                self.open.pop()
            if name == tag:
                break

    def handle_data(self, data):
        if self.inside and not self.dropped and data.strip():
            for parts in self.open:
                parts.append(data.strip())


#: Containers in order of preference; articles stand for pages of other sites.
CONTAINERS = [lambda tag, at: tag == "div" and at.get("data-type") == "page", lambda tag, at: tag == "main", lambda tag, at: tag == "article"]


def page_paragraphs(html: str | None, containers=CONTAINERS[:2]) -> list[str] | None:
    """None if the page has no container."""
    for wanted in containers:
        p = _Paragraphs(wanted)
        p.feed(html or "")
        p.close()
        if p.inside or p.done:
            return [" ".join(x) for x in p.out]
    return None


#: Pages that a task parses at a time.
PAGES = 64


def page_text(pages: DataFrame, containers=CONTAINERS) -> DataFrame:
    """(page_id, url, text): the long paragraphs of each page, cleaned; null where too little is left. The parser is the only Python; it sees a few pages at a time."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAGES):
                b = whole.slice(at, PAGES)
                found = [page_paragraphs(h.as_py(), containers) for h in b.column("html")]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.list_(pa.string()))], ["page_id", "url", "ps"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    found = rows.mapInArrow(parse, "page_id long, url string, ps array<string>")
    kept = F.filter("ps", lambda p: (F.length(p) > 40) & ~p.rlike(v.CAPTIONS))
    return found.select("page_id", "url", t.clean(F.array_join(kept, " ")).alias("text"))
