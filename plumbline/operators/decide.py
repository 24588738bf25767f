"""Paired, variance-corrected decisions over score ledgers: one aggregate per set of comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGMA = 2.0         # fixed value: standard errors a mean delta must exceed
MIN_DELTA = 1e-4    # fixed value: smallest delta that can count
TIE = 1e-9          # fixed value: a difference below is none
NULL_MARGIN = 0.02  # fixed value: distance above the null band


def _num(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def mde(sd: Column, n: Column, ratio: float | Column = 0.0, sigma: float = SIGMA) -> Column:
    """Smallest mean delta that would have cleared the bar; infinite below two pairs."""
    return F.when(n >= 2, sigma * sd * F.sqrt(1 / n + _num(ratio))).otherwise(F.lit(float("inf")))


def accepts(mean: Column, sd: Column, n: Column, n_positive: Column, ratio: float | Column = 0.0) -> Column:
    """Mean beyond two corrected standard errors and a strict majority of pairs in favour."""
    return (n >= 2) & (mean > F.greatest(F.lit(MIN_DELTA), mde(sd, n, ratio))) & (n_positive * 2 > n)


def paired_summary(deltas: DataFrame, by: Sequence[str], ratio: float | Column = 0.0, delta: str = "delta") -> DataFrame:
    """Per comparison: ``n, mean_delta, sd, mde, better, worse``. ``ratio`` may use the ``by`` columns and ``n``."""
    d = F.col(delta)
    s = deltas.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_delta"), F.stddev_samp(d).alias("sd"),
                                F.count_if(d > 0).alias("_up"), F.count_if(d < 0).alias("_down"))
    n, m, sd = F.col("n"), F.col("mean_delta"), F.col("sd")
    return s.withColumns({"mde": mde(sd, n, ratio), "better": F.coalesce(accepts(m, sd, n, F.col("_up"), ratio), F.lit(False)),
                          "worse": F.coalesce(accepts(-m, sd, n, F.col("_down"), ratio), F.lit(False))}).drop("_up", "_down")


def fold_ratio(n_folds: Column) -> Column:
    """Test/train size ratio of k-fold replications."""
    return F.when(n_folds > 1, 1 / (n_folds - 1)).otherwise(0.0)


def signed(base: Column, trial: Column, higher_is_better: Column) -> Column:
    """Improvement of the trial, positive when better whatever the metric's direction."""
    return F.when(higher_is_better, trial - base).otherwise(base - trial)


def improves(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Does the trial beat the base beyond fold noise?

    ``pairs`` has ``base, trial, higher_is_better`` per fold. With fewer than two folds the rule falls
    back to the mean against the base's own spread, given as ``base_std``.
    """
    d = signed(F.col("base"), F.col("trial"), F.col("higher_is_better"))
    fallback = F.max("base_std") if "base_std" in pairs.columns else F.lit(0.0)
    s = pairs.withColumn("_d", d).groupBy(*by).agg(
        F.count("_d").alias("n"), F.avg("_d").alias("delta"), F.stddev_samp("_d").alias("_sd"),
        F.count_if(F.col("_d") > 0).alias("_up"), fallback.alias("_std"),
        F.bool_and(F.col("base") == F.col("trial")).alias("_same"))
    n, m = F.col("n"), F.col("delta")
    paired = accepts(m, F.col("_sd"), n, F.col("_up"), fold_ratio(n))
    alone = m > F.greatest(F.lit(MIN_DELTA), SIGMA * F.coalesce(F.col("_std"), F.lit(0.0)))
    return s.withColumn("accepted", F.when(n >= 2, paired).otherwise(alone)) \
            .withColumn("no_effect", F.col("_same") & ~F.col("accepted")).drop("_sd", "_up", "_std", "_same")


def outcome_reasons(pairs: DataFrame, by: Sequence[str], measured: str | None = None) -> DataFrame:
    """Outcome of every intervention: improved, no_improvement, no_effect or budget_exhausted."""
    src = pairs if measured is None else pairs.withColumns(
        {c: F.when(F.col(measured), F.col(c)) for c in ("base", "trial")})
    out = improves(src, by)
    ran = F.col("n") > 0
    return out.select(*by, F.when(ran, F.col("delta")).alias("cv_delta"), (ran & F.col("accepted")).alias("accepted"),
                      F.when(~ran, "budget_exhausted").when(F.col("accepted"), "improved")
                      .when(F.col("no_effect"), "no_effect").otherwise("no_improvement").alias("reason"))


def compare_verdict(pairs: DataFrame, by: Sequence[str], n_folds: int) -> DataFrame:
    """improved / no_improvement / underpowered over all (seed, fold) pairs of each comparison."""
    s = paired_summary(pairs.withColumn("delta", F.col("trial") - F.col("base")), by, 1 / (n_folds - 1) if n_folds > 1 else 0.0)
    return s.select(*by, "n", "mean_delta", "mde", F.when(F.col("n") < 2, "underpowered").when(F.col("better"), "improved")
                    .otherwise("no_improvement").alias("verdict"))


def multi_seed_verdict(runs: DataFrame, by: Sequence[str], holdout_frac: float = 0.25) -> DataFrame:
    """treatment / baseline / undecided per task; failed seeds are listed, a task where all failed is ``failed``.

    ``runs`` has ``seed, baseline, treatment, higher_is_better, error`` (error NULL for finished seeds).
    """
    d = F.when(F.col("error").isNull(), signed(F.col("baseline"), F.col("treatment"), F.col("higher_is_better")))
    ratio = holdout_frac / (1 - holdout_frac)
    s = paired_summary(runs.withColumn("delta", d), by, ratio)
    extra = runs.groupBy(*by).agg(
        F.avg(F.when(F.col("error").isNull(), F.col("treatment") - F.col("baseline"))).alias("raw_delta"),
        F.array_sort(F.collect_set(F.when(F.col("error").isNotNull(), F.col("seed")))).alias("failed_seeds"))
    verdict = F.when(F.col("n") == 0, "failed").when(F.col("better"), "treatment").when(F.col("worse"), "baseline").otherwise("undecided")
    return s.join(extra, list(by)).select(*by, F.col("n").alias("n_seeds"), F.col("raw_delta").alias("mean_delta"), "mde",
                                          verdict.alias("verdict"), "failed_seeds")


def winner(delta: Column, higher_is_better: Column) -> Column:
    return F.when(F.abs(delta) < TIE, "tie").when((delta > 0) == higher_is_better, "treatment").otherwise("baseline")


def direction(gap: Column) -> Column:
    """Sign of an optimism gap in words."""
    return F.when(gap > TIE, "optimistic (dangerous)").when(gap < -TIE, "pessimistic (safe)").otherwise("negligible")


def backtest_gap(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """How much a backtest without a gap overstates quality, over paired origins ``(naive, corrected)``."""
    d = signed(F.col("corrected"), F.col("naive"), F.col("higher_is_better"))
    s = paired_summary(pairs.withColumn("delta", d), by, fold_ratio(F.col("n")))
    return s.select(*by, F.col("n").alias("n_origins"), F.col("mean_delta").alias("mean_gap"), "mde",
                    F.when(F.col("better"), "optimistic (dangerous)").when(F.col("worse"), "pessimistic (safe)")
                    .otherwise("undecided").alias("direction"))


def optimism_gap(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Naive minus recommended CV mean, signed so that positive is optimistic. ``scores``: ``arm, score, higher_is_better``."""
    arm = F.col("arm")
    s = scores.groupBy(*by).agg(F.avg(F.when(arm == "naive", F.col("score"))).alias("naive_mean"),
                                F.avg(F.when(arm == "recommended", F.col("score"))).alias("recommended_mean"),
                                F.bool_and("higher_is_better").alias("_h"))
    gap = F.when(F.col("_h"), F.col("naive_mean") - F.col("recommended_mean")).otherwise(F.col("recommended_mean") - F.col("naive_mean"))
    return s.withColumn("gap", gap).withColumn("direction", direction(F.col("gap"))).drop("_h")


def cv_gap(runs: DataFrame) -> DataFrame:
    """Add ``gap``: CV score minus external score where the metric mode makes them comparable."""
    return runs.withColumn("gap", F.when(F.col("mode").isin("aligned", "oof", "proba"), F.col("cv_score") - F.col("external_score")))


def spend_budget(trials: DataFrame, run: str, order: str, limit: int) -> DataFrame:
    """Mark the first ``limit`` trials of every run ``measured``, the rest ``budget_exhausted``.

    The ranking window is cut to ``limit`` rows per run before its shuffle, so a run with most of the
    trials costs no more than any other.
    """
    if limit < 1:
        return trials.withColumn("status", F.lit("budget_exhausted"))
    place = F.row_number().over(Window.partitionBy(run).orderBy(order))
    last = (trials.select(run, order).withColumn("_p", place).where(F.col("_p") <= limit)
            .groupBy(run).agg(F.max(order).alias("_last")))
    return trials.join(last, run).withColumn(
        "status", F.when(F.col(order) <= F.col("_last"), "measured").otherwise("budget_exhausted")).drop("_last")


def cv_summary(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, population spread and number of folds."""
    return scores.groupBy(*by).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("score").alias("n_folds"))


def null_band(observed: DataFrame, null: DataFrame, by: Sequence[str]) -> DataFrame:
    """Observed score against the mean and 95th percentile of its own permutations."""
    band = null.groupBy(*by).agg(F.avg("score").alias("null_mean"), F.percentile("score", F.lit(0.95)).alias("null_p95"),
                                 F.count("score").alias("n_perm"))
    return observed.join(band, list(by)).withColumn(
        "verdict", F.when(F.col("observed") > F.col("null_p95") + NULL_MARGIN, "leaking").otherwise("not leaking"))


def backtest_risk(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """High with a future leak, a decided optimistic split or a leaking series; a plain boundary AUC never counts."""
    check, value = F.col("check"), F.col("detail")
    bad = ((check == "future_feature") | ((check == "split_design") & (value == "optimistic (dangerous)"))
           | ((check == "series_null") & (value == "leaking")))
    return findings.groupBy(*by).agg(F.when(F.bool_or(bad), "high").otherwise("low").alias("risk"), F.count_if(bad).alias("n_drivers"))


def factorial_verdict(scores: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Raw against log target within each design, the rule run once per metric space (higher is better)."""
    space = F.col("space")
    long = scores.select(*by, "fold", "space", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in metrics])))
    wide = long.groupBy(*by, "fold", "metric").agg(F.max(F.when(space == "raw", F.col("score"))).alias("base"),
                                                   F.max(F.when(space == "log1p", F.col("score"))).alias("trial"))
    s = paired_summary(wide.withColumn("delta", F.col("trial") - F.col("base")), [*by, "metric"], fold_ratio(F.col("n")))
    return s.select(*by, "metric", F.col("mean_delta").alias("delta"), "mde", F.col("better").alias("accepted"))


def truth_gap(cv: DataFrame, truth: DataFrame, task: Sequence[str]) -> DataFrame:
    """CV estimate of each arm minus the held-out truth, with the direction in words."""
    joined = cv.join(truth, list(task))
    gap = F.when(F.col("higher_is_better"), F.col("mean") - F.col("truth")).otherwise(F.col("truth") - F.col("mean"))
    return joined.withColumn("gap", gap).withColumn("direction", direction(F.col("gap")))
