"""JSON files of passages, generations and evaluations; Parquet beside them."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vocab as v
from ..operators import constraints, evaluate, metrics

PASSAGE = "passage_id string, subject string, source string, section string, text string, key_concepts array<string>, methods_principles array<string>, url string, word_count int"
GENERATION = "model string, mode string, passage_id string, subject string, level int, level_name string, vocab_level int, prompt string, raw_response string, question string, answer string, latency_ms double, error string, timestamp string"
ENVELOPE = f"model string, mode string, n_generations int, timestamp string, generations array<struct<{', '.join(f'{n}:{k}' for n, k in (x.split() for x in GENERATION.split(', ')))}>>"


def read_passages(spark: SparkSession, folder: str) -> DataFrame:
    """<folder>/<subject>/passages.json of all subjects there are, with read_order: subjects in their published order (others after them, by path), then the place in the file.

    A file is read by one task, so a number that grows along the task grows along the file.
    """
    rows = spark.read.schema(PASSAGE).option("multiLine", True).json(f"{folder}/*/passages.json")
    path = F.col("_metadata.file_path")
    subject = F.array_position(F.array(*map(F.lit, v.SUBJECTS)), F.regexp_extract(path, "([^/]+)/[^/]+$", 1))
    rank = F.when(subject == 0, F.lit(len(v.SUBJECTS) + 1)).otherwise(subject)
    return rows.withColumn("read_order", F.struct(rank.cast("int").alias("subject"), path.alias("path"), F.monotonically_increasing_id().alias("at")))


def parse_name(name) -> tuple:
    """(model_safe, mode) columns from a file name column; nulls for other files."""
    pattern = r"^gen_(.*)_(standard|adversarial)\.json$"
    got = lambda n: F.nullif(F.regexp_extract(name, pattern, n), F.lit(""))
    return got(1), got(2)


def read_generations(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all gen_*.json, with model_safe and file_mode from the name; mode and model default to the envelope's, then to standard."""
    return read_generation_files(spark, [f"{folder}/gen_*.json"])


def read_generation_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """As read_generations, with read_order: path and place in the file's list."""
    found = spark.read.schema(ENVELOPE).option("multiLine", True).json(paths)
    safe, mode = parse_name(F.col("_metadata.file_name"))
    rows = found.select(F.col("model").alias("_model"), F.col("mode").alias("_mode"), safe.alias("model_safe"), mode.alias("file_mode"), F.col("_metadata.file_path").alias("_path"), F.posexplode("generations").alias("_at", "g"))
    rows = rows.select("*", "g.*").withColumn("read_order", F.struct(F.col("_path").alias("path"), F.col("_at").alias("at")))
    return rows.withColumns({"model": F.coalesce("model", "_model"), "mode": F.coalesce("mode", "_mode", F.lit("standard"))}).drop("_model", "_mode", "_path", "_at", "g")


def read_evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all eval_*.json."""
    kinds = ", ".join(f"{n}:{k}" for n, k in (x.split() for x in GENERATION.split(", ")))
    record = f"array<struct<{kinds}, constraints:{evaluate.RESULT}, all_passed:boolean, pass_rate:double, evaluation_error:string>>"
    found = spark.read.schema(f"model string, mode string, n_evaluated int, prompt_pass_rate double, timestamp string, evaluations {record}").option("multiLine", True).json(f"{folder}/eval_*.json")
    rows = found.select(F.col("model").alias("_model"), F.col("mode").alias("_mode"), F.col("_metadata.file_path").alias("_path"), F.posexplode("evaluations").alias("_at", "e"))
    rows = rows.select("*", "e.*").withColumn("read_order", F.struct(F.col("_path").alias("path"), F.col("_at").alias("at")))
    return rows.withColumns({"model": F.coalesce("model", "_model"), "mode": F.coalesce("mode", "_mode")}).drop("_model", "_mode", "_path", "_at", "e")


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that there are."""
    out = []
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            out.append(path)
    return out


def append_generations(rows: DataFrame, path: str) -> None:
    """Incremental sink: new records are added, none are rewritten."""
    rows.write.mode("append").partitionBy("model", "mode").parquet(path)


def write_evaluations(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "mode").parquet(path)


#: One row a model and mode: what its stored evaluations were made from.
MANIFEST = "model string, mode string, made_from string"


def registry_version() -> str:
    """Changes with the constraints: their order, levels, fixed values, and those that callers registered."""
    fixed = {k: x for k, x in vars(v).items() if k.isupper()}
    own = [(c.id, c.name, c.tier, c.levels, c.description) for c in constraints.EXTRA]
    return hashlib.sha256(repr((sorted(fixed.items()), own)).encode()).hexdigest()


def fingerprints(rows: DataFrame, *by: str) -> DataFrame:
    """by and made_from: the number of rows and a sum of their hashes, which no order or partitioning changes."""
    kept = [F.col(c) for c in rows.columns if c != evaluate.READ_ORDER]
    row = F.xxhash64(F.to_json(F.struct(*kept)))
    sums = (F.count("*").cast("string"), F.sum(row.cast("decimal(38,0)")).cast("string"), F.sum(F.hash(F.to_json(F.struct(*kept))).cast("long")).cast("string"))
    return rows.groupBy(*by).agg(F.concat_ws(":", *sums).alias("made_from"))


def evaluations_or(gens: DataFrame, passages: DataFrame, path: str, nli: DataFrame | None = None, evaluated=evaluate.evaluated) -> DataFrame:
    """Evaluations of gens from path; those of a model and mode are computed and stored first where its generations, the passages,
    the scores or the constraints aren't those that the stored ones were made from.

    A manifest beside the Parquet says what each model and mode was made from. It is written after the
    evaluations, so a job that dies in between computes again. Models and modes that gens lacks aren't returned.
    """
    spark = gens.sparkSession
    gens = gens.withColumn("mode", F.coalesce("mode", F.lit("standard")))
    whole = lambda df: "" if df is None else str(fingerprints(df).first()["made_from"])
    rest = hashlib.sha256("|".join([whole(passages), whole(nli), registry_version()]).encode()).hexdigest()
    now = fingerprints(gens, *metrics.BY).withColumn("made_from", F.concat("made_from", F.lit(f":{rest}")))
    now = spark.createDataFrame(now.collect(), MANIFEST)  # a row a model and mode
    manifest = f"{path}/_manifest"
    stored = spark.createDataFrame(spark.read.schema(MANIFEST).parquet(manifest).collect(), MANIFEST) if existing(spark, [manifest]) else spark.createDataFrame([], MANIFEST)
    stale = now.join(stored, MANIFEST.replace(" string", "").split(", "), "left_anti").select(*metrics.BY)
    if not stale.isEmpty():
        write_evaluations(evaluated(gens.join(F.broadcast(stale), metrics.BY, "left_semi"), passages, nli), path)
        now.coalesce(1).write.mode("overwrite").parquet(manifest)
    return spark.read.option("basePath", path).parquet(path).join(F.broadcast(now.select(*metrics.BY)), metrics.BY, "left_semi")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small document, through the file system the path names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def rates_of(rows: list) -> dict:
    """metrics.breakdown, gathered (a row a model, mode and level, subject or constraint), as nested counts by (model, mode)."""
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["kind"], r["key"])):
        one = out.setdefault((r["model"], r["mode"]), {"prompt": None, "level": {}, "subject": {}, "constraint": {}, "tier": {}, "all": [0, 0, 0]})
        counts = [r["n_total"], r["n_pass"], r["n_loose"]]
        if r["kind"] == "prompt":
            one["prompt"] = r
        else:
            one[r["kind"]][r["key"]] = counts
        if r["kind"] == "constraint":
            one["all"] = [a + b for a, b in zip(one["all"], counts)]
            one["tier"][r["tier"]] = [a + b for a, b in zip(one["tier"].get(r["tier"], [0, 0, 0]), counts)]
    return out


def _r4(n: int, total: int) -> float:
    return round(n / total, 4) if total else 0.0


def is_ready(std: dict, adv: dict) -> bool:
    """Few errors in both modes."""
    return all(x["prompt"]["n_errors"] / x["prompt"]["n_total"] <= v.MAX_ERRORS for x in (std, adv))


def _safe(model: str) -> str:
    return model.translate(str.maketrans(":./", "___"))


def complete_models(counts: dict, gated: bool) -> list[tuple[str, dict, dict]]:
    """Models that have both modes, by safe name; gated: that are ready as well."""
    both = sorted((m for m, mode in counts if mode == "standard" and (m, "adversarial") in counts), key=_safe)
    pairs = [(m, counts[m, "standard"], counts[m, "adversarial"]) for m in both]
    return [x for x in pairs if not gated or is_ready(*x[1:])]


def leaderboard_document(e: DataFrame, gens_stats: dict | None = None, gated: bool = True) -> dict:
    """The published document, from one pass over e. Rates are rounded here; the gap is taken from rounded rates.

    Only models that are ready are ranked: both modes, and (gated) at most a tenth of errors in each, by e's column error.
    """
    counts = rates_of(metrics.breakdown(e).collect())
    board, per_level, details, pool = [], {}, {}, {}
    for model, std, adv in complete_models(counts, gated):
        name, size, kind = next(((shown, size, k) for m, k, shown, size in v.MODELS if model in (m, _safe(m))), (model, "?", "ollama"))
        rates = {m: _r4(x["prompt"]["n_pass"], x["prompt"]["n_total"]) for m, x in (("standard", std), ("adversarial", adv))}
        levels = {m: {str(n): _r4(*x["level"].get(str(n), [0, 0])[1::-1]) for n in v.LEVELS} for m, x in (("standard", std), ("adversarial", adv))}
        share = lambda x: {k: _r4(n, total) for k, (total, n, _) in sorted(x.items())}
        gap = round(rates["standard"] - rates["adversarial"], 4)
        one = {
            "constraint_strict": _r4(std["all"][1], std["all"][0]), "prompt_strict": rates["standard"], "prompt_loose": _r4(std["prompt"]["n_loose"], std["prompt"]["n_total"]),
            "constraint_loose": _r4(std["all"][2], std["all"][0]),
        }
        board.append({"model_name": name, "model_params": size, "model_type": "local" if kind == "ollama" else "api", "standard_csr": rates["standard"], "adversarial_csr": rates["adversarial"], "gap": gap, **one})
        per_level[name] = levels["standard"]
        details[name] = {
            "per_level": levels, "per_constraint": share(std["constraint"]), "per_constraint_adv": share(adv["constraint"]), "per_subject": share(std["subject"]), "per_tier": share(std["tier"]), **one,
            "adversarial_csr": rates["adversarial"], "gap": gap, "n_standard": std["prompt"]["n_total"], "n_adversarial": adv["prompt"]["n_total"], "n_empty": std["prompt"]["n_empty"],
        }
        for i, (total, n, _) in std["constraint"].items():
            pool[i] = [pool.get(i, [0, 0])[0] + n, pool.get(i, [0, 0])[1] + total]
    board.sort(key=lambda x: x["gap"])
    stats = {"passages": 120, "subjects": 8, "bloom_levels": 6, "constraints": 28, "models_evaluated": len(board), "questions_per_model": 1440, "adversarial_pairings": 6}
    return {
        "stats": stats | (gens_stats or {}), "leaderboard": board, "per_level": per_level, "constraint_breakdown": {i: _r4(*pool[i]) for i in sorted(pool)}, "model_details": details,
        "metadata": {"version": "1.0", "last_updated": datetime.now(timezone.utc).strftime("%Y-%m-%d"), "note": f"Auto-generated from {len(board)} evaluated models"},
    }


def write_leaderboard(e: DataFrame, path: str, gated: bool = True) -> dict:
    doc = leaderboard_document(e, gated=gated)
    write_text(e.sparkSession, path, json.dumps(doc, indent=2))
    return doc


def summary_document(e: DataFrame, order: str = "gen_id") -> dict:
    """All metrics of every model and mode, with intervals. e is evaluated once: what the metrics read of it is kept on disk meanwhile, and made again where an executor is lost."""
    kept = ["model", "mode", "level", "subject", order, "all_passed", "constraints", *(["error"] if "error" in e.columns else [])]
    rows = e.select(*kept).persist(StorageLevel.DISK_ONLY)
    try:
        counts = rates_of(metrics.breakdown(rows).collect())
        results = metrics.exploded(rows, order)
        near = F.coalesce(F.col("score"), F.lit(0.0)) >= v.LOOSE
        pairs = {
            "prompt_level_strict": metrics.bootstrap(rows, order=order), "prompt_level_loose": metrics.bootstrap(rows, order=order, ok=metrics.loose_all()),
            "constraint_level_strict": metrics.bootstrap(results, order=[order, "pos"], ok=F.col("passed")), "constraint_level_loose": metrics.bootstrap(results, order=[order, "pos"], ok=near),
        }
        ends = {name: {(r["model"], r["mode"]): r for r in df.collect()} for name, df in pairs.items()}
        levels = {(r["model"], r["mode"], r["level"]): r for r in metrics.by_level_interval(rows, order).collect()}
    finally:
        rows.unpersist()
    out = {}
    for (model, mode), x in counts.items():
        name = {"prompt_level_strict": ("prompt", "n_pass"), "prompt_level_loose": ("prompt", "n_loose"), "constraint_level_strict": ("all", 1), "constraint_level_loose": ("all", 2)}
        one: dict = {}
        for k, (kind, at) in name.items():
            total, n = (x["prompt"]["n_total"], x["prompt"][at]) if kind == "prompt" else (x["all"][0], x["all"][at])
            ci = ends[k].get((model, mode))
            one[k] = {"rate": _r4(n, total), "n": total, "n_pass": n, "ci_low": round(ci["ci_low"], 4), "ci_high": round(ci["ci_high"], 4)} if total else {"rate": 0.0, "n": 0, "ci_low": 0.0, "ci_high": 0.0}
        one["by_level"] = {
            str(n): {"name": v.LEVELS[n], "prompt_strict": _r4(x["level"][str(n)][1], x["level"][str(n)][0]), "n": x["level"][str(n)][0], "n_pass": x["level"][str(n)][1], "ci_low": round(r["ci_low"], 4), "ci_high": round(r["ci_high"], 4)}
            for n in v.LEVELS if (r := levels.get((model, mode, n)))
        }
        one["by_subject"] = {k: {"prompt_strict": _r4(n, total), "n": total, "n_pass": n} for k, (total, n, _) in sorted(x["subject"].items())}
        for kind in ("constraint", "tier"):
            one[f"by_{kind}"] = {k: {"pass_rate": _r4(n, total), "n_pass": n, "n_total": total} for k, (total, n, _) in sorted(x[kind].items())}
        out[f"{_safe(model)}_{mode}"] = one
    return {"metrics": out}


def write_summary(e: DataFrame, folder: str, order: str = "gen_id") -> dict:
    doc = summary_document(e, order)
    write_text(e.sparkSession, f"{folder}/benchmark_summary.json", json.dumps(doc, indent=2))
    return doc


def submission_document(e: DataFrame, version: str, submitter: str | None = None, model: str | None = None, gated: bool = True) -> dict:
    """The rates of every model that is ready (not gated: that has both modes), or of one, from one pass over e."""
    counts = rates_of(metrics.breakdown(e).collect())
    models = {}
    for name, std, adv in complete_models(counts, gated):
        if model is None or _safe(model) == _safe(name):
            rates = [_r4(x["prompt"]["n_pass"], x["prompt"]["n_total"]) for x in (std, adv)]
            models[_safe(name)] = {
                "standard_csr": rates[0], "adversarial_csr": rates[1], "gap": round(rates[0] - rates[1], 4), "constraint_strict": _r4(std["all"][1], std["all"][0]), "constraint_loose": _r4(std["all"][2], std["all"][0]),
                "prompt_loose": _r4(std["prompt"]["n_loose"], std["prompt"]["n_total"]), "n_standard": std["prompt"]["n_total"], "n_adversarial": adv["prompt"]["n_total"],
                "total_generations": std["prompt"]["n_total"], "errors": std["prompt"]["n_errors"],
            }
    if model is not None and not models:
        raise ValueError(f"no complete evaluations of {model}")
    return {"version": version, "submitted_at": datetime.now(timezone.utc).isoformat(), "submitter": submitter or "anonymous", "models": models}


def write_submission(e: DataFrame, folder: str, version: str, submitter: str | None = None, **how) -> str:
    """Writes submission_<submitter>_<time>.json and returns its path."""
    doc = submission_document(e, version, submitter, **how)
    slug = (submitter or "anonymous").lower().replace(" ", "_")
    path = f"{folder}/submission_{slug}_{datetime.now(timezone.utc).strftime('%Y%m%d_%H%M%S')}.json"
    write_text(e.sparkSession, path, json.dumps(doc, indent=2))
    return path
