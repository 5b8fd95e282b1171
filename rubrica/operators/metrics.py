"""Pass rates, breakdowns, confidence intervals, gaps, leaderboard.

Rates stay unrounded but where a gap is taken: it is the difference of two published rates, which have
four digits. ``breakdown`` counts everything that documents need in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import lineage, text as t, vocab as v

BY = ["model", "mode"]


def loose_all(constraints: str = "constraints") -> Column:
    """True for no results."""
    return F.forall(constraints, lambda c: F.coalesce(c["score"], F.lit(0.0)) >= v.LOOSE)


def _rates(rows: DataFrame, by: list[str], ok: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n_total"), F.count_if(ok).alias("n_pass")).withColumn("rate", F.try_divide("n_pass", "n_total"))


def prompt_strict(e: DataFrame, by: list[str] = BY) -> DataFrame:
    return _rates(e, by, F.col("all_passed"))


def prompt_loose(e: DataFrame, by: list[str] = BY) -> DataFrame:
    """With the records that have no results, which count as passed."""
    return e.groupBy(*by).agg(F.count("*").alias("n_total"), F.count_if(loose_all()).alias("n_pass"), F.count_if(F.size("constraints") == 0).alias("n_empty")).withColumn("rate", F.try_divide("n_pass", "n_total"))


def exploded(e: DataFrame, *more: str) -> DataFrame:
    """A row for each result, with the record's own columns and more of them."""
    own = dict.fromkeys((*(c for c in ("gen_id", "model", "mode", "level", "subject") if c in e.columns), *more))
    return e.select(*own, F.posexplode("constraints").alias("pos", "c")).select("*", "c.*").drop("c")


def constraint_strict(e: DataFrame, by: list[str] = BY) -> DataFrame:
    return _rates(exploded(e), by, F.col("passed"))


def constraint_loose(e: DataFrame, by: list[str] = BY) -> DataFrame:
    return _rates(exploded(e), by, F.col("score") >= v.LOOSE)


def by_level(e: DataFrame) -> DataFrame:
    return prompt_strict(e.where(F.col("level").between(1, 6)), [*BY, "level"])


def by_subject(e: DataFrame) -> DataFrame:
    return prompt_strict(e.withColumn("subject", F.coalesce("subject", F.lit("unknown"))), [*BY, "subject"])


def by_constraint(e: DataFrame) -> DataFrame:
    return constraint_strict(e, [*BY, "id"])


def by_tier(e: DataFrame) -> DataFrame:
    return constraint_strict(e, [*BY, "tier"])


def pooled(e: DataFrame) -> DataFrame:
    """Constraint rates over all models, standard mode."""
    return constraint_strict(e.where("mode = 'standard'"), ["id"])


def _both(own: Column | None = None) -> tuple[Column, Column]:
    """The published strict rates of both modes, of those records of a group that own keeps; a missing one counts as 0."""
    def rate(mode: str) -> Column:
        m = (F.col("mode") == mode) if own is None else (F.col("mode") == mode) & own
        return t.rounded(F.coalesce(F.try_divide(F.count_if(m & F.col("all_passed")), F.count_if(m)), F.lit(0.0)))

    return rate("standard"), rate("adversarial")


def _gap(standard: Column, adversarial: Column) -> Column:
    return t.rounded(standard - adversarial)


def gap(e: DataFrame, by: list[str]) -> DataFrame:
    """Published strict rates of both modes side by side, and the gap. One aggregation, no join."""
    standard, adversarial = _both()
    rows = e.groupBy(*by).agg(standard.alias("standard"), adversarial.alias("adversarial"))
    return rows.withColumn("gap", _gap(F.col("standard"), F.col("adversarial")))


def gap_by_level(e: DataFrame) -> DataFrame:
    """The gap of every model at each of the six levels; one without records has rates of 0. One aggregation, no join."""
    def rates(n: int) -> Column:
        standard, adversarial = _both(F.col("level") == n)
        return F.struct(F.lit(n).alias("level"), standard.alias("standard"), adversarial.alias("adversarial"))

    rows = e.groupBy("model").agg(F.array(*map(rates, v.LEVELS)).alias("levels")).select("model", F.inline("levels"))
    return rows.withColumn("gap", _gap(F.col("standard"), F.col("adversarial")))


def interval(values: np.ndarray) -> tuple[float, float]:
    """Percentile bootstrap of the mean of 0/1 values in order, reseeded for each call."""
    if len(values) < 2:
        x = float(values.mean()) if len(values) else 0.0
        return x, x
    rng = np.random.RandomState(v.SEED)
    means = [values[rng.randint(0, len(values), size=len(values))].mean() for _ in range(v.RESAMPLES)]
    tail = (1 - v.CONFIDENCE) / 2 * 100
    return float(np.percentile(means, tail)), float(np.percentile(means, 100 - tail))


#: Up to so many records a group is resampled record by record, beyond it by its counts.
EXACT = 200_000


def interval_of_counts(n: int, n_pass: int) -> tuple[float, float]:
    """The same bootstrap by counts: of n draws with replacement from 0/1 values the passes are binomial, so the resampled means have the same distribution. Reseeded for each call."""
    if n < 2:
        return (n_pass / n, n_pass / n) if n else (0.0, 0.0)
    means = np.random.RandomState(v.SEED).binomial(n, n_pass / n, v.RESAMPLES) / n
    tail = (1 - v.CONFIDENCE) / 2 * 100
    return float(np.percentile(means, tail)), float(np.percentile(means, 100 - tail))


def bootstrap(e: DataFrame, by: list[str] = BY, order: str | list[str] = "gen_id", ok: Column | None = None, exact: int = EXACT) -> DataFrame:
    """The share of records for which ok holds (all_passed), with its confidence interval.

    Groups of up to exact records are resampled record by record, in their order, as the published figures
    are: their 0/1 values come to one task, one byte each. A larger group is never gathered: its interval
    follows from two counts that tasks sum. The groups are few; their counts decide which way each goes.
    """
    tail = "n long, rate double, ci_low double, ci_high double"
    order = [order] if isinstance(order, str) else order
    rows = e.select(*by, *order, F.coalesce(F.col("all_passed") if ok is None else ok, F.lit(False)).cast("tinyint").alias("ok"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in by)
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("long")).alias("n_pass"))

    def vector(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        x = df.sort_values(order, kind="stable")["ok"].to_numpy(dtype=np.float64)
        return pd.DataFrame([[*key, len(x), float(x.mean()), *interval(x)]], columns=[*by, "n", "rate", "ci_low", "ci_high"])

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            ends = [interval_of_counts(int(n), int(p)) for n, p in zip(df["n"], df["n_pass"])]
            yield df[[*by, "n"]].assign(rate=df["n_pass"] / df["n"], ci_low=[x for x, _ in ends], ci_high=[x for _, x in ends])

    many = counts.where(F.col("n") > exact)
    same = [F.col(f"r.{b}").eqNullSafe(F.col(f"c.{b}")) for b in by]
    few = rows.alias("r").join(many.alias("c"), same, "left_anti")
    return few.groupBy(*by).applyInPandas(vector, f"{kinds}, {tail}").union(many.mapInPandas(counted, f"{kinds}, {tail}"))


def by_level_interval(e: DataFrame, order: str = "gen_id") -> DataFrame:
    return bootstrap(e.where(F.col("level").between(1, 6)), [*BY, "level"], order)


def complete(gens: DataFrame, least: int = v.COMPLETE) -> DataFrame:
    ok = F.coalesce("error", F.lit("")) == ""
    return gens.groupBy(*BY).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok")).withColumn("complete", F.col("n_ok") >= least)


def ready(gens: DataFrame, most_errors: float = v.MAX_ERRORS) -> DataFrame:
    """Models with both modes and few errors in each."""
    bad = F.coalesce("error", F.lit("")) != ""
    modes = gens.groupBy(*BY).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).withColumn("error_rate", F.try_divide("bad", "n"))
    models = modes.groupBy("model").agg(F.count_distinct("mode").alias("modes"), F.max("error_rate").alias("error_rate"))
    return models.withColumn("ready", (F.col("modes") == 2) & (F.col("error_rate") <= most_errors))


def of_ready(e: DataFrame, gens: DataFrame) -> DataFrame:
    """The records of models that are ready to be ranked, by the generations that gens holds."""
    return e.join(ready(gens).where("ready").select("model"), "model", "left_semi")


def prompt_rates(e: DataFrame, by: list[str]) -> DataFrame:
    """Strict and loose rates in one aggregation."""
    n = F.count("*")
    return e.groupBy(*by).agg(
        n.alias("n_total"), F.count_if("all_passed").alias("n_pass"), F.try_divide(F.count_if("all_passed"), n).alias("strict"),
        F.try_divide(F.count_if(loose_all()), n).alias("loose"), F.count_if(F.size("constraints") == 0).alias("n_empty"),
    )


def _ready(bad: Column) -> Column:
    """Whether a group of one model's records has both modes, with few errors in each."""
    std, adv = F.col("mode") == "standard", F.col("mode") == "adversarial"
    few = lambda m: F.coalesce(F.try_divide(F.count_if(m & bad), F.count_if(m)) <= v.MAX_ERRORS, F.lit(False))
    return few(std) & few(adv)


def leaderboard(e: DataFrame, gated: bool = True) -> DataFrame:
    """Models by their published gap, ascending, then by safe name. One aggregation over the records; one row a model, so the ranking window is small.

    Gated, only models whose records have both modes and at most a tenth of errors in each are ranked; e then needs the generations' column error.
    """
    std = F.col("mode") == "standard"
    hits = lambda ok: F.sum(F.when(std, F.size(F.filter("constraints", ok))))
    total = F.sum(F.when(std, F.size("constraints")))
    standard, adversarial = _both()
    rows = e.groupBy("model").agg(
        standard.alias("standard"), adversarial.alias("adversarial"), t.rounded(F.try_divide(F.count_if(std & loose_all()), F.count_if(std))).alias("standard_loose"),
        t.rounded(F.try_divide(hits(lambda c: c["passed"]), total)).alias("constraint_strict"), t.rounded(F.try_divide(hits(lambda c: c["score"] >= v.LOOSE), total)).alias("constraint_loose"),
        (_ready(F.coalesce("error", F.lit("")) != "") if gated else F.lit(True)).alias("_ready"),
    )
    rows = rows.where("_ready").drop("_ready").withColumn("gap", _gap(F.col("standard"), F.col("adversarial")))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("gap", F.translate("model", ":./", "___"))))


def breakdown(e: DataFrame) -> DataFrame:
    """All counts that documents need, in one pass: (model, mode, kind, key, tier, n_total, n_pass, n_loose, n_empty, n_errors).

    A record becomes a row for itself, its level, its subject, and one for each result (kinds prompt, level,
    subject, constraint); tasks sum them before anything is shuffled. What comes out is a row a model,
    mode and level, subject or constraint.
    """
    one = lambda kind, key, ok, loose, tier=None, empty=False, bad=False: F.struct(
        F.lit(kind).alias("kind"), key.cast("string").alias("key"), (F.lit(None).cast("string") if tier is None else tier).alias("tier"), ok.cast("int").alias("ok"), loose.cast("int").alias("loose"),
        F.lit(empty).cast("int").alias("empty") if isinstance(empty, bool) else empty.cast("int").alias("empty"), F.lit(bad).cast("int").alias("bad") if isinstance(bad, bool) else bad.cast("int").alias("bad"),
    )
    passed, loose, none = F.coalesce("all_passed", F.lit(False)), loose_all(), F.size("constraints") == 0
    error = F.coalesce("error", F.lit("")) != "" if "error" in e.columns else F.lit(False)
    own = F.array(
        one("prompt", F.lit(""), passed, loose, empty=none, bad=error), one("level", F.when(F.col("level").between(1, 6), F.col("level")), passed, loose),
        one("subject", F.coalesce("subject", F.lit("unknown")), passed, loose),
    )
    each = F.transform("constraints", lambda c: one("constraint", c["id"], c["passed"], F.coalesce(c["score"], F.lit(0.0)) >= v.LOOSE, c["tier"]))
    rows = e.select(*BY, F.inline(F.concat(own, each))).where("key is not null")
    sums = {"n_pass": "ok", "n_loose": "loose", "n_empty": "empty", "n_errors": "bad"}
    return rows.groupBy(*BY, "kind", "key", "tier").agg(F.count("*").alias("n_total"), *(F.sum(F.col(c).cast("long")).alias(n) for n, c in sums.items()))


def placed(rows: DataFrame, by: list[str], order: str, sums: list[str] = ()) -> DataFrame:
    """rows with _at, their place (from 1) in their group's order, and _upto_<c>, the running sum of each of sums.

    In two levels: rows are dealt by ranges of (by, order), numbered inside each range, and get what the
    ranges before hold of their group, so a group of any size is spread over tasks. Ties are told apart at
    random, once: the dealt rows are kept.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = lineage.cut(tied.repartitionByRange(*by, order, "_tie").withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "_part").orderBy(order, "_tie")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({"_at": F.row_number().over(inside)} | {f"_upto_{c}": F.sum(c).over(upto) for c in sums})
    totals = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_sum_{c}") for c in sums))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = totals.select(*(F.col(b).alias(f"_{b}") for b in by), F.col("_part").alias("_range"), *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_before{c}") for c in ("_n", *(f"_sum_{c}" for c in sums))))
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by] + [F.col("_part") == F.col("_range")]
    out = local.join(before, same).withColumn("_at", F.col("_at") + F.col("_before_n"))
    out = out.withColumns({f"_upto_{c}": F.col(f"_upto_{c}") + F.col(f"_before_sum_{c}") for c in sums})
    return out.select(*rows.columns, "_at", *(f"_upto_{c}" for c in sums))


def progress(e: DataFrame, every: int = 50, order: str = "gen_id") -> DataFrame:
    """Running pass counts, every so many records of a model and mode."""
    rows = e.select(*BY, order, F.coalesce("all_passed", F.lit(False)).cast("long").alias("passed"))
    return placed(rows, BY, order, ["passed"]).where(F.col("_at") % every == 0).select(*BY, F.col("_at").alias("done"), F.col("_upto_passed").alias("passed"))
