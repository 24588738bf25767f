"""Questions asked of run ledgers: latest pairs, decided verdicts, boards, scores of proposals, run verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.decide import winner

DECIDED = ("treatment", "baseline")     # fixed values: an undecided verdict is no precedent
SNIPPET_CHARS, CONTENT_CHARS = 500, 6000    # fixed values
SHIFT_YELLOW, SHIFT_RED = 0.6, 0.8          # fixed values


def latest_pair(runs: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Metrics of the newest baseline and the newest treatment run side by side, shared metrics only.

    ``runs``: ``by``, ``arm``, ``metrics`` (map). One aggregate keeps the newest run per arm; nothing is sorted.
    """
    at = F.struct(*order)
    newest = runs.groupBy(*by).agg(*[F.max_by("metrics", F.when(F.col("arm") == a, at)).alias(a) for a in ("baseline", "treatment")])
    both = newest.where("baseline IS NOT NULL AND treatment IS NOT NULL")
    shared = F.array_intersect(F.map_keys("baseline"), F.map_keys("treatment"))
    out = both.select(*by, "baseline", "treatment", F.explode(shared).alias("metric"))
    b, t = F.col("baseline")[F.col("metric")], F.col("treatment")[F.col("metric")]
    return out.select(*by, "metric", b.alias("baseline"), t.alias("treatment"), (t - b).alias("delta"))


def decided(board: DataFrame, order: Sequence[Column | str], last: int = 5) -> DataFrame:
    """The most recent settled verdicts; undecided ones are never a precedent."""
    return board.where((F.col("kind") == "multi_seed") & F.col("verdict").isin(*DECIDED)).orderBy(*order).limit(last)


def board(rows: DataFrame) -> DataFrame:
    """One line per ledger row; single runs show the raw winner, replicated ones their verdict."""
    return rows.select("name", "metric", "baseline", "treatment", "delta",
                       F.coalesce("verdict", winner(F.col("delta"), F.coalesce("higher_is_better", F.lit(True)))).alias("winner"))


def fold_label(strategy: Column, group: Column, time: Column, period: Column) -> Column:
    """``strategy`` or ``strategy:column``; NULL when no design was chosen."""
    return F.when(strategy.isNotNull(), F.concat_ws(":", strategy, F.coalesce(group, time, period)))


def detection_score(predicted: DataFrame, acceptable: DataFrame, truth: DataFrame) -> DataFrame:
    """Per true class: tables, acceptable answers, recall and structure seen where there is none.

    ``predicted``: ``name, strategy, column``; ``acceptable``: the allowed ``(name, strategy, column)``
    pairs, column NULL for random; ``truth``: ``name, primary``.
    """
    allowed = acceptable.select("name", "strategy", F.col("column").alias("_c")).withColumn("_ok", F.lit(True))
    match = ((F.col("p.name") == F.col("a.name")) & (F.col("p.strategy") == F.col("a.strategy"))
             & ((F.col("p.strategy") == "random") | F.col("p.column").eqNullSafe(F.col("a._c"))))
    hits = predicted.alias("p").join(allowed.dropDuplicates().alias("a"), match, "left").groupBy("p.name", "p.strategy").agg(
        F.coalesce(F.bool_or("_ok"), F.lit(False)).alias("correct"))
    return hits.join(truth, "name").groupBy("primary").agg(
        F.count("*").alias("n"), F.count_if("correct").alias("n_correct"),
        F.avg(F.col("correct").cast("double")).alias("recall"),
        F.count_if((F.col("primary") == "random") & (F.col("strategy") != "random")).alias("n_false_alarms"))


def drop_plan_score(plans: DataFrame) -> DataFrame:
    """Per table: junk caught, and real columns wrongly dropped, traps among them.

    ``plans``: ``name, target, columns, must_drop, traps, proposed`` (arrays of column names).
    """
    real = F.array_except(F.col("columns"), F.array("target"))
    asked = F.array_intersect(real, F.col("proposed"))
    keep = F.array_except(real, F.col("must_drop"))
    return plans.withColumn("_asked", asked).select(
        "name", F.size(F.array_intersect("must_drop", "_asked")).cast("bigint").alias("n_caught"),
        F.size("must_drop").cast("bigint").alias("n_must_drop"),
        F.array_sort(F.array_intersect(keep, F.col("_asked"))).alias("keep_violations"),
        F.array_sort(F.array_intersect("traps", "_asked")).alias("trap_violations"))


def interventions(features: DataFrame, vetoes: DataFrame, framings: DataFrame) -> DataFrame:
    """Every measured proposal in one shape, rejected ones included."""
    cols = ["run", "name", "kind", "proposed_by", "delta", "reason", "accepted"]
    f = features.select("run", "name", F.lit("generated_feature").alias("kind"), F.concat(F.lit("codegen:"), "source").alias("proposed_by"),
                        F.col("cv_delta").alias("delta"), "reason", F.col("kept").alias("accepted"))
    v = vetoes.select("run", F.concat(F.lit("keep:"), "column").alias("name"), F.lit("drop_veto").alias("kind"), F.lit("reviewer").alias("proposed_by"),
                      F.col("cv_delta").alias("delta"), "reason", F.col("vetoed").alias("accepted"))
    t = framings.where("transform <> 'none'").select(
        "run", F.concat(F.lit("target:"), "transform").alias("name"), F.lit("target_framing").alias("kind"), F.lit("target_framing").alias("proposed_by"),
        F.col("cv_delta").alias("delta"), F.when(F.col("accepted"), "improved").otherwise("no_improvement").alias("reason"), "accepted")
    return f.select(cols).unionByName(v.select(cols)).unionByName(t.select(cols))


def run_light(has_model: Column, has_cv: Column, shift_auc: Column) -> Column:
    """Traffic light of a run."""
    return F.when(~has_model, "red").when(shift_auc >= SHIFT_RED, "red").when(shift_auc >= SHIFT_YELLOW, "yellow") \
            .when(~has_cv, "yellow").otherwise("green")


def run_limits(has_cv: Column, has_folds: Column, has_framing: Column, shift_auc: Column) -> Column:
    """What the number of a run cannot support."""
    return F.array_compact(F.array(
        F.when(~has_cv, "single holdout"), F.when(~has_folds, "fold design not checked"),
        F.when(~has_framing, "target framing not evaluated"), F.when(shift_auc >= SHIFT_YELLOW, "train and test differ")))


def first_seen(hits: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first hit per key in rank order, as a partial aggregate rather than a window over each key's hits."""
    rest = [c for c in hits.columns if c != key]
    return hits.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def evidence(hits: DataFrame) -> DataFrame:
    """Snippets and page texts cut to their limits; content stays NULL when the page was not read."""
    return hits.withColumns({"snippet": F.substring("snippet", 1, SNIPPET_CHARS),
                             "content": F.when(F.length("content") > 0, F.substring("content", 1, CONTENT_CHARS))})


def task_board(runs: DataFrame) -> DataFrame:
    """Baseline and treatment score per task with the treatment's thresholds, medal and gap."""
    t = F.col("arm") == "treatment"
    return runs.groupBy("task", "metric").agg(
        F.max(F.when(~t, F.col("score"))).alias("baseline"), F.max(F.when(t, F.col("score"))).alias("treatment"),
        *[F.max(F.when(t, F.col(c))).alias(c) for c in ("gold", "silver", "bronze", "medal", "gap")])


def run_facts(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """One record per run: folds, mean, population spread and the fold scores in fold order."""
    return scores.groupBy(*by).agg(
        F.count("score").alias("n_folds"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"),
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "score"))), lambda s: s["score"]).alias("fold_scores"))


def leaderboard(models: DataFrame, top: int = 5) -> DataFrame:
    return models.select("model", "score").orderBy(F.desc("score"), "model").limit(top)
