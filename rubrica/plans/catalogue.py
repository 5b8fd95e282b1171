"""One query for each operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import lineage, text as t, vocab as v
from ..operators import adapters, constraints, evaluate, extract, metrics, passages as ps, prompts
from ..sources import envelopes, files, toc
from . import fixture as fx

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.prompt_rates(fx.evaluations(spark, sf_dir), ["model", "mode", "level"])


def _docs(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: make(fx.table(spark, d, "documents"))


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    known = fx.passages(spark, d)
    g = fx.gens(spark, d, known)
    return constraints.prepared(evaluate.bound(g, known, fx.nli(g)))


def _constraint(i: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _prepared(spark, d).select("gen_id", constraints.RULES[i](constraints.plain).alias("r")).select("gen_id", "r.*")
    return run


def _eval(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: make(fx.evaluations(spark, d))


def _digest(ws) -> list:
    return [F.md5(F.array_join(ws, " ").cast("binary")).alias("digest")]


def _called(spark: SparkSession, d: str) -> DataFrame:
    """The constraints that each level and mode among the generations call for, in order."""
    kinds = fx.gens(spark, d).select("mode", "level").distinct()
    return kinds.select("mode", "level", F.posexplode(constraints.called_for()).alias("ord", "c")).select("mode", "level", "ord", "c.id", "c.tier")


def _router(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation routed by a model's name that its id picks, some of them unknown."""
    names = [x[0] for x in v.MODELS] + ["my.model:x", "gemini-9"]
    m = fx.table(spark, d, "conversations").select("conv_id").distinct().withColumn("model", fx.pick(names, F.col("conv_id")))
    shown = prompts.display_name(F.col("model"))
    return m.select("conv_id", "model", prompts.backend(F.col("model")).alias("backend"), prompts.safe_name(F.col("model")).alias("safe"), shown["name"].alias("name"), shown["params"].alias("params"))


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    """Generations whose passage id stands for two texts each: the one read last is theirs, with its own concepts."""
    known = fx.passages(spark, d).withColumn("passage_id", F.expr("passage_id div 2"))
    g = fx.gens(spark, d).withColumn("passage_id", F.expr("passage_id div 2"))
    out = evaluate.bound(g.select("gen_id", "passage_id", "mode"), known)
    return out.select("gen_id", F.md5(F.col("passage").cast("binary")).alias("digest"), F.array_join("key_concepts", "|").alias("key_concepts"))


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    g = fx.gens(spark, d)
    model = F.when(F.col("gen_id") % 8 == 6, F.lit("deepseek-r1:14b")).otherwise(F.lit("phi4:14b"))
    qa = extract.extract_qa(extract.strip_think(F.col("raw_response"), model))
    return g.select("gen_id", qa.alias("qa")).select("gen_id", "qa.question", "qa.answer")


def _resume(spark: SparkSession, d: str) -> DataFrame:
    known = fx.passages(spark, d)
    return evaluate.work_list(known, "adversarial", fx.gens(spark, d, known)).drop("vocab_level")


def _prompted(docs: DataFrame, mode: str) -> DataFrame:
    w = evaluate.work_list(docs.withColumnRenamed("doc_id", "passage_id"), mode).join(docs.select(F.col("doc_id").alias("passage_id"), "text"), "passage_id")
    p = prompts.standard(F.col("text"), F.col("level")) if mode == "standard" else prompts.adversarial(F.col("text"), F.col("level"), F.col("vocab_level"))
    return w.select(F.col("passage_id").alias("doc_id"), "level", p.alias("prompt"))


def _ids(docs: DataFrame) -> DataFrame:
    kept = docs.where(F.size(t.split(F.col("text"))) >= 300)
    return ps.with_ids(kept.select("doc_id", "source"), "source", "doc_id").select("doc_id", "passage_id")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """What an entailment model has to score: by generation and side, the address of premise and hypothesis, and how many share it."""
    known = fx.passages(spark, d)
    pairs = adapters.with_pair(adapters.nli_pairs(evaluate.bound(fx.gens(spark, d, known), known)))
    times = pairs.groupBy("pair").agg(F.count("*").alias("n_equal"))
    return pairs.join(times, "pair").select("gen_id", "kind", "pair", F.md5(F.col("premise").cast("binary")).alias("premise"), "hypothesis", "n_equal")


def _sent(spark: SparkSession, d: str) -> DataFrame:
    """The generations as files would hold them."""
    g = fx.gens(spark, d)
    own = {"passage_id": F.col("passage_id").cast("string"), "level_name": prompts.level_name(F.col("level")), "prompt": F.lit(None).cast("string"), "latency_ms": (F.col("gen_id") / 8), "timestamp": F.col("gen_id").cast("string")}
    return g.withColumns(own)


def _written(spark: SparkSession, d: str) -> DataFrame:
    """Generations written as envelopes, in two goes, and read back: the second go adds to the documents of the first."""
    folder = f"{lineage.shared_dir(spark)}/envelopes-{uuid.uuid4().hex}"
    g = _sent(spark, d)
    for half in (0, 1):
        envelopes.write_generations(g.where(F.expr(f"gen_id div 1000 % 3 = 0 and {half} = 0 or gen_id div 1000 % 3 <> 0 and gen_id div 2 % 2 = {half}")), folder)
    back = files.read_generations(spark, folder)
    return back.select("model", "mode", "model_safe", "file_mode", "passage_id", "level", "level_name", "question", "error", "latency_ms", "timestamp")


def _evaluated_files(spark: SparkSession, d: str) -> DataFrame:
    """Evaluations written as envelopes and read back."""
    folder = f"{lineage.shared_dir(spark)}/envelopes-{uuid.uuid4().hex}"
    envelopes.write_evaluations(fx.evaluations(spark, d).withColumns({"passage_id": F.col("passage_id").cast("string"), "timestamp": F.col("gen_id").cast("string")}), folder)
    back = files.read_evaluations(spark, folder)
    return back.select(F.col("timestamp").cast("long").alias("gen_id"), "model", "mode", F.size("constraints").cast("long").alias("n_constraints"), "all_passed", "pass_rate", "evaluation_error")


def _submission(spark: SparkSession, d: str) -> DataFrame:
    """The rates that a submission holds, a row a model."""
    doc = files.submission_document(fx.evaluations(spark, d), "1", gated=False)
    kinds = "model string, standard_csr double, adversarial_csr double, gap double, constraint_strict double, constraint_loose double, prompt_loose double, n_standard long, n_adversarial long, errors long"
    names = [x.split()[0] for x in kinds.split(", ")]
    return spark.createDataFrame([tuple(({"model": m} | x)[n] for n in names) for m, x in doc["models"].items()], kinds)


def queries() -> dict[str, Query]:
    text = F.col
    out: dict[str, Query] = {f"c_{i.lower()}": _constraint(i) for i in constraints.RULES}
    out |= {
        "tokenize_words": _docs(lambda x: x.select("doc_id", F.size(t.tokens(text("text"))).cast("long").alias("n"), *_digest(t.tokens(text("text"))))),
        "tokenize_ascii": _docs(lambda x: x.select("doc_id", F.size(t.ascii_tokens(text("text"))).cast("long").alias("n"), *_digest(t.ascii_tokens(text("text"))))),
        "stem_tokens": _docs(lambda x: x.select("doc_id", *_digest(F.transform(t.tokens(text("text")), lambda w: t.stem(w))))),
        "truncate_400": _docs(lambda x: x.select("doc_id", t.first_words(text("text"), v.NLI_WORDS).alias("text"))),
        "section_cut": _docs(lambda x: x.select("doc_id", t.cut_section(text("text")).alias("section"))),
        "clean_text": _docs(lambda x: x.select("doc_id", t.clean(text("text")).alias("text"))),
        "word_overlap": lambda s, d: _prepared(s, d).select("gen_id", t.overlap(F.col("aw"), F.col("pw")).alias("overlap")),
        "trigram_overlap": lambda s, d: _prepared(s, d).select("gen_id", t.trigram_overlap(F.col("aw"), F.col("pw")).alias("overlap")),
        "key_concepts_simple": _docs(lambda x: ps.key_concepts(x.withColumnRenamed("doc_id", "passage_id")).select("passage_id", F.array_join("key_concepts", "|").alias("key_concepts"))),
        "methods_principles": _docs(lambda x: x.select(F.col("doc_id").alias("passage_id"), F.array_join(ps.methods_principles(text("text")), "|").alias("methods_principles"))),
        "generations": lambda s, d: fx.gens(s, d).drop("subject"),
        "evaluated_records": _eval(lambda e: e.select("gen_id", F.size("constraints").cast("long").alias("n_constraints"), "all_passed", "pass_rate", "evaluation_error")),
        "evaluated_results": _eval(lambda e: metrics.exploded(e).select("gen_id", "id", "tier", "passed", "score", "details")),
        "prompt_strict": _eval(metrics.prompt_strict), "prompt_loose": _eval(metrics.prompt_loose), "prompt_pass_rate": _eval(metrics.prompt_strict),
        "constraint_strict": _eval(metrics.constraint_strict), "constraint_loose": _eval(metrics.constraint_loose),
        "by_level": _eval(metrics.by_level), "by_subject": _eval(metrics.by_subject), "by_constraint": _eval(metrics.by_constraint), "by_tier": _eval(metrics.by_tier),
        "constraint_breakdown": _eval(metrics.pooled), "adversarial_gap": _eval(lambda e: metrics.gap(e, ["model"])), "gap_by_level": _eval(metrics.gap_by_level),
        "leaderboard": _eval(metrics.leaderboard), "running_progress": _eval(lambda e: metrics.progress(e, 10)), "bootstrap_ci": _eval(metrics.bootstrap), "bootstrap_by_level": _eval(metrics.by_level_interval), "breakdown": _eval(metrics.breakdown),
        "complete_files": lambda s, d: metrics.complete(fx.gens(s, d), 20), "ready_models": lambda s, d: metrics.ready(fx.gens(s, d)),
        "work_list": _docs(lambda x: evaluate.work_list(x.withColumnRenamed("doc_id", "passage_id"), "standard").drop("vocab_level")), "resume_anti_join": _resume,
        "even_sample": _docs(lambda x: ps.evenly(x.select("source", "doc_id"), 15, "source", "doc_id")), "passage_ids": _docs(_ids),
        "backend_router": _router, "constraint_matrix": _called, "constraint_counts": lambda s, d: _called(s, d).groupBy("mode", "level").agg(F.count("*").cast("int").alias("n")),
        "describe_constraints": lambda s, d: fx.gens(s, d).select("gen_id", constraints.description().alias("description")), "last_passage": _repeated,
        "prompt_standard": _docs(lambda x: _prompted(x, "standard")), "prompt_adversarial": _docs(lambda x: _prompted(x, "adversarial")), "extract_qa": _extracted,
        "nli_pairs": _pairs, "generation_files": _written, "evaluation_files": _evaluated_files, "submission": _submission,
        "toc_sections": lambda s, d: toc.content_sections(fx.trees(s, d)), "toc_leaves": lambda s, d: toc.sections(fx.trees(s, d)),
        "page_text": lambda s, d: ps.page_text(fx.table(s, d, "pages")),
    }
    return out
