"""Evaluation of generations: joins, constraint results, record-level folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import constraints

RESULT = "array<struct<id:string,name:string,passed:boolean,score:double,details:string,tier:string>>"


#: Where a row was read: a column that orders rows whatever partitions they are in (files.read_passages makes it).
READ_ORDER = "read_order"


def last_wins(rows: DataFrame, *keys: str, order: str) -> DataFrame:
    """One row of each key, the last by order, which must tell apart the rows of a key. Only keys and order are aggregated; the rows then meet their last order, by the same key."""
    last = rows.groupBy(*keys).agg(F.max(order).alias("_last")).where(F.col("_last").isNotNull())
    kept = rows.join(last, [*keys], "inner").where(F.col(order) == F.col("_last"))
    return kept.select(*rows.columns)


def last_read(passages: DataFrame) -> DataFrame:
    """Of passages that repeat an id the one read last, by READ_ORDER. Where there is no such column, the one with the greatest text, so that a task that runs again finds the same."""
    passages = passages.where(F.col("passage_id").isNotNull())
    if READ_ORDER in passages.columns:
        return last_wins(passages, "passage_id", order=READ_ORDER).drop(READ_ORDER)
    ordered = passages.withColumn(READ_ORDER, F.struct(F.coalesce("text", F.lit("")).alias("text"), F.to_json(F.struct("key_concepts", "methods_principles")).alias("rest")))
    return last_wins(ordered, "passage_id", order=READ_ORDER).drop(READ_ORDER).dropDuplicates(["passage_id"])


def bound(gens: DataFrame, passages: DataFrame, nli: DataFrame | None = None) -> DataFrame:
    """Generations with their passage (empty if unknown; of rows that repeat an id the last read) and entailment scores.

    The last order of an id is found on narrow rows and met by the id that the join needs, so texts are shuffled once.
    """
    kept = [c for c in ("passage_id", "text", "key_concepts", "methods_principles", READ_ORDER) if c in passages.columns]
    own = last_read(passages.select(*kept)).withColumnRenamed("text", "passage")
    out = gens.withColumn("mode", F.coalesce("mode", F.lit("standard"))).join(own, "passage_id", "left")
    if nli is None:
        none = F.lit(None).cast("struct<entailment:double,neutral:double,contradiction:double>")
        return out.withColumns({"nli_answer": none, "nli_question": none})
    scores = nli.groupBy("gen_id").agg(*(F.max(F.when(F.col("kind") == k, F.struct("entailment", "neutral", "contradiction"))).alias(f"nli_{k}") for k in ("answer", "question")))
    return out.join(scores, "gen_id", "left")


def evaluated(gens: DataFrame, passages: DataFrame, nli: DataFrame | None = None) -> DataFrame:
    """gens with constraints, all_passed, pass_rate and evaluation_error. No question: no results, not passed."""
    rows = constraints.prepared(bound(gens, passages, nli))
    rows = rows.withColumn("constraints", F.when(F.col("q") == "", F.array().cast(RESULT)).otherwise(constraints.results().cast(RESULT)))
    none = F.size("constraints") == 0
    return rows.select(
        *gens.columns, "constraints",
        (~none & F.forall("constraints", lambda c: c["passed"])).alias("all_passed"),
        F.when(none, F.lit(0.0)).otherwise(F.size(F.filter("constraints", lambda c: c["passed"])) / F.size("constraints")).alias("pass_rate"),
        F.when(none, F.lit("No question generated")).alias("evaluation_error"),
    )


def work_list(passages: DataFrame, mode: str, done: DataFrame | None = None) -> DataFrame:
    """(passage_id, level, vocab_level, mode) still to generate: every passage at each of the six levels, without what succeeded before."""
    from ..functions import vocab as v

    levels = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.lit(v.PAIRINGS[n] if mode == "adversarial" else None).cast("int").alias("vocab_level")) for n in v.LEVELS)))
    rows = passages.select("passage_id", levels.alias("l")).select("passage_id", "l.level", "l.vocab_level", F.lit(mode).alias("mode"))
    if done is None:
        return rows
    good = done.where(F.coalesce("error", F.lit("")) == "").select("passage_id", "level", "mode").distinct()
    return rows.join(good, ["passage_id", "level", "mode"], "left_anti")
