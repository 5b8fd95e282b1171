"""Tables of contents: one JSON tree a book, walked in tasks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as t
from ..operators import passages

LEAVES = "book string, place int, depth int, slug string, title string, error string"


def leaves(tree: dict) -> Iterator[tuple[int, str, str]]:
    """(depth, slug, title) of the nodes that have a slug and no contents, in order. The way down is a list, so depth is bounded by memory only."""
    way = [(0, tree)]
    while way:
        depth, node = way.pop()
        if not isinstance(node, dict):
            continue
        below = node.get("contents") or []
        if not below and node.get("slug"):
            yield depth, str(node["slug"]), str(node.get("title") or "")
        way += [(depth + 1, x) for x in reversed(below)]


def sections(trees: DataFrame) -> DataFrame:
    """From (book, tree): the leaves of every book's tree in their order, as LEAVES; place counts from 0.

    tree is a book's JSON, either the root node or an object that has it as "tree". A book whose tree can't be
    read (null, no JSON, nested too deeply for the parser) gives one row with the error and no slug.
    """
    names = [x.split()[0] for x in LEAVES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            for i in range(b.num_rows):
                book, text = b.column("book")[i].as_py(), b.column("tree")[i].as_py()
                try:
                    tree = json.loads(text or "null")
                    if not isinstance(tree, dict):
                        raise ValueError("no tree")
                    rows = [(book, k, d, slug, title, None) for k, (d, slug, title) in enumerate(leaves(tree.get("tree", tree)))]
                except (ValueError, RecursionError) as e:
                    rows = [(book, None, None, None, None, str(e)[:200] or type(e).__name__)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return trees.select(F.col("book").cast("string"), F.col("tree").cast("string")).mapInArrow(run, LEAVES)


def read_toc(spark: SparkSession, pattern: str) -> DataFrame:
    """The sections of all books, <book>.json by a glob; a file is read whole, by one task."""
    found = spark.read.text(pattern, wholetext=True)
    return sections(found.select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("book"), F.col("value").alias("tree")))


def content_sections(trees: DataFrame) -> DataFrame:
    """The numbered content leaves of every book, titles cleaned; place stays the leaf's own, so order is kept."""
    kept = passages.content_pages(sections(trees).where("slug is not null"))
    return kept.select("book", "place", "slug", t.text(F.col("title")).alias("title"))
