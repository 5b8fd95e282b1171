"""Passages and generations made from the documents and conversations tables, by integer arithmetic on ids; SQL makes the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as t, vocab as v
from ..operators import evaluate, passages as ps

STARTERS = [
    "What is", "Explain how", "Calculate the", "Compare the relationship between", "Evaluate the claim that, based on evidence,", "Design a plan that must include",
    "Which of", "Why does", "If a researcher", "In what way does", "To what extent should", "Propose using at least",
    "State when", "Describe", "Suppose", "Examine the difference between", "Justify", "Create", "Thing", "Th! an", "Ha", "Who",
]
CONNECTIVES = ["", "Therefore", "However, this shows", "Because", "The", "It is better", "Step 2", "As a result, the answer is"]
ENDINGS = ["?", ".", "", " from the passage.", "?", " your position", "?", "!"]
COUNTS = [3, 15, 40, 120]


def pick(values: list, index: Column) -> Column:
    return F.get(t.strings(values) if isinstance(values[0], str) else F.array(*map(F.lit, values)), (index % len(values)).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), F.col("source").alias("subject"), "text", F.col("doc_id").alias(evaluate.READ_ORDER))
    return ps.processed(docs)


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of contents for every twenty pages: chapters of five, an empty one, and as many levels above them as the book's number mod 4."""
    p = table(spark, sf_dir, "pages").select((F.expr("page_id div 20")).alias("book"), F.expr("page_id % 20 div 5").alias("chapter"), "page_id")
    slug = F.concat_ws("-", F.col("chapter"), F.col("page_id") % 5, F.when(F.col("page_id") % 7 == 0, F.lit("key-terms")).otherwise(F.concat(F.lit("topic"), F.col("page_id").cast("string"))))
    leaf = F.struct(F.col("page_id"), F.when(F.col("page_id") % 11 == 0, F.lit("preface")).otherwise(slug).alias("slug"), F.concat(F.lit("<b>Page</b> "), F.col("page_id").cast("string")).alias("title"))
    chapters = p.groupBy("book", "chapter").agg(F.sort_array(F.collect_list(leaf)).alias("leaves"))
    inner = F.concat(F.lit('{"title":"Chapter","contents":['), F.array_join(F.transform("leaves", lambda x: F.to_json(F.struct(x["slug"].alias("slug"), x["title"].alias("title")))), ","), F.lit("]}"))
    books = chapters.groupBy("book").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chapter", inner.alias("json")))), lambda x: x["json"]), ",").alias("inner"))
    deep = (F.col("book") % 4).cast("int")
    tree = F.concat(F.lit('{"tree":'), F.repeat(F.lit('{"title":"Part","contents":['), deep + 1), F.lit('{"title":"Empty","contents":[]},'), F.col("inner"), F.repeat(F.lit("]}"), deep + 1), F.lit("}"))
    return books.select("book", tree.alias("tree"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's turn and the assistant's next one."""
    c = table(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked"))
    said = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said"))
    return user.join(said, ["conv_id", "turn"])


def gens(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """gen_id, model, mode, level, vocab_level, passage_id, subject, raw_response, question, answer, error."""
    known = passages(spark, sf_dir) if known is None else known
    top = table(spark, sf_dir, "documents").agg((F.max("doc_id") + 2).alias("ids"))
    g = turns(spark, sf_dir).crossJoin(top)  # one row
    g = g.withColumn("gen_id", F.col("conv_id") * 1000 + F.col("turn"))
    gid, k = F.col("gen_id"), pick(COUNTS, F.expr("gen_id div 3"))
    level = ((F.col("conv_id") * 7 + F.expr("turn div 2")) % 6 + 1).cast("int")
    mode = F.when(F.col("conv_id") % 2 == 0, F.lit("standard")).otherwise(F.lit("adversarial"))
    paired = F.lit(None).cast("int")
    for n, x in v.PAIRINGS.items():
        paired = F.when(F.col("level") == n, F.lit(x)).otherwise(paired)
    g = g.withColumns({"mode": mode, "level": level, "model": F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")), "passage_id": (F.col("conv_id") * 31 + F.col("turn")) % F.col("ids")})
    g = g.withColumn("vocab_level", F.when(F.col("mode") == "adversarial", paired))
    g = g.join(known.select("passage_id", "subject", "text", "key_concepts"), "passage_id", "left")
    concepts = F.array_join(F.slice(F.coalesce("key_concepts", F.array().cast("array<string>")), F.lit(1), (gid % 4).cast("int")), " and ")
    question = F.concat_ws(" ", pick(STARTERS, gid), t.first_words(F.col("asked"), 6), concepts)
    question = F.when(gid % 37 == 0, F.lit(" ")).otherwise(F.concat(question, F.when(gid % 11 == 0, F.lit(" alpha alpha alpha alpha")).otherwise(F.lit("")), pick(ENDINGS, F.expr("gen_id div 5"))))
    copied = F.when(gid % 2 == 0, t.text(F.col("text"))).otherwise(F.col("said"))
    words = F.array_join(F.slice(t.split(copied), F.lit(1), k), " ")
    answer = F.concat_ws(" ", pick(CONNECTIVES, gid), words, F.when(gid % 3 == 0, concepts))
    g = g.withColumns({"_q": question, "_a": answer})
    return g.select(
        "gen_id", "model", "mode", "level", "vocab_level", "passage_id", "subject",
        F.when(gid % 23 == 0, F.lit(None).cast("string")).otherwise(F.col("_q")).alias("question"),
        F.when(gid % 29 == 0, F.lit(None).cast("string")).otherwise(F.col("_a")).alias("answer"),
        F.when(gid % 31 == 0, F.lit("timed out")).alias("error"), raw(gid).alias("raw_response"),
    )


def raw(gid: Column) -> Column:
    """A response in one of the forms that extraction knows."""
    q, a, n = F.col("_q"), F.col("_a"), gid % 8
    return (
        F.when(n == 0, F.concat(F.lit("QUESTION: "), q, F.lit("\nANSWER: "), a)).when(n == 1, F.concat(F.lit("Q: 1. "), q, F.lit("\nA: "), a))
        .when(n == 2, F.concat(q, F.lit("? "), a)).when(n == 3, F.concat(q, F.lit("\n\n"), a)).when(n == 4, F.concat(F.lit('"'), q, F.lit('"')))
        .when(n == 5, F.concat(F.lit("answer: "), a, F.lit("\nquestion: Question: "), q)).when(n == 6, F.concat(F.lit("<think>hm "), q, F.lit("</think>\n "), a)).otherwise(F.lit(None))
    )


def nli(g: DataFrame) -> DataFrame:
    """Stub scores, for thresholds only."""
    def side(kind: str, m: int) -> DataFrame:
        c = (F.col("gen_id") * m) % 101
        n = (F.col("gen_id") * 53) % (101 - c)
        return g.select("gen_id", F.lit(kind).alias("kind"), ((100 - c - n) / 100).alias("entailment"), (n / 100).alias("neutral"), (c / 100).alias("contradiction"))
    return side("answer", 37).union(side("question", 41))


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = passages(spark, sf_dir)
    g = gens(spark, sf_dir, known)
    return evaluate.evaluated(g, known, nli(g))
