"""Naive Bayes cross-validation from counts: every fold's classifier out of one pass over the rows.

The rows are counted by (cell, column, level, class). What a fold has learned is the sum over its training cells, found by
subtracting its own cell from the total, so k fits cost one aggregate. A level adds to the score of a class

    log((n(level, class) + alpha) / alpha)

beyond what every unseen level adds; only the classes that were seen with a level are joined to a row, and the
best of all others is one number per fold. Levels and classes may be any number: both stay relations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import keyed_hash
from plumbline.operators.metrics import score_table

MISSING = "<missing>"


def _long(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column: its number and the level, gaps being a level of their own."""
    levels = F.array(*[F.struct(F.lit(i).alias("column"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING)).alias("level")) for i, c in enumerate(columns)])
    return rows.select("_key", "_fold", "_label", F.inline(levels))


def counted(long: DataFrame, k: int) -> DataFrame:
    """``(fold, column, level, label, n)``: what each fold has seen, from counts by cell; its own cell is subtracted."""
    cells = long.groupBy("_fold", "column", "level", "_label").agg(F.count("*").alias("own"))
    total = cells.groupBy("column", "level", "_label").agg(F.sum("own").alias("total"), F.map_from_entries(F.collect_list(F.struct("_fold", "own"))).alias("of"))
    seen = total.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))).alias("fold"))
    return seen.select("fold", "column", "level", F.col("_label").alias("label"), (F.col("total") - F.coalesce(F.col("of")[F.col("fold")], F.lit(0))).alias("n")).where("n > 0")


def class_bases(seen: DataFrame, n_columns: int, alpha: float) -> DataFrame:
    """``(fold, label, base)``: the score of a class for a row whose levels were never seen with it."""
    per_column = seen.groupBy("fold", "column").agg(F.count_distinct("level").alias("levels"))
    prior = seen.where("column = 0").groupBy("fold", "label").agg(F.sum("n").alias("n"))
    size = prior.groupBy("fold").agg(F.sum("n").alias("rows"))
    each = prior.join(per_column, "fold").withColumn("part", F.log(F.lit(alpha)) - F.log(F.col("n") + alpha * F.col("levels")))
    return each.groupBy("fold", "label", "n").agg(F.sum("part").alias("parts")).join(size, "fold").select("fold", "label", (F.log(F.col("n") / F.col("rows")) + F.col("parts")).alias("base"))


def oof_bayes(df: DataFrame, target: str, key: str, columns: Sequence[str], *, k: int = 5, seed: int = 42, alpha: float = 1.0, fold: Column | None = None) -> DataFrame:
    """``(key, fold, label, pred, score)`` of every row with a label, predicted by the fold that has not seen it.

    ``fold`` gives the rows' cells from 0 to k - 1 (random ones by the key if not given). Scores are compared to nine digits and
    ties go to the smaller class. Numbers count by their value; bin them first. Keys must be unique.
    """
    own = keyed_hash(seed, key) % k if fold is None else fold
    rows = df.where(F.col(f"`{target}`").isNotNull()).select(F.col(f"`{key}`").alias("_key"), own.cast("bigint").alias("_fold"), F.col(f"`{target}`").alias("_label"), *[F.col(f"`{c}`") for c in columns])
    long = _long(rows, columns)
    seen = counted(long, k)
    bases = class_bases(seen, len(columns), alpha)
    gains = seen.select(F.col("fold").alias("_fold"), "column", "level", F.col("label").alias("class"), F.log((F.col("n") + alpha) / alpha).alias("gain"))
    hits = long.join(gains, ["_fold", "column", "level"])
    scored = hits.groupBy("_key", "_fold", "_label", "class").agg(F.sum("gain").alias("gain"))
    scored = scored.join(bases.select(F.col("fold").alias("_fold"), F.col("label").alias("class"), "base"), ["_fold", "class"])
    best = bases.groupBy("fold").agg(F.min(F.struct((-F.col("base")).alias("cost"), F.col("label").alias("class"))).alias("best"))
    best_base = best.select(F.col("fold").alias("_fold"), F.col("best.class").alias("class"), (-F.col("best.cost")).alias("score"))
    # a class that was never seen with any level of the row scores its base; the best of those is enough
    any_row = rows.select("_key", "_fold", "_label").join(best_base, "_fold")
    every = scored.select("_key", "_fold", "_label", "class", (F.col("gain") + F.col("base")).alias("score")).unionByName(any_row.select("_key", "_fold", "_label", "class", "score"))
    top = every.groupBy("_key", "_fold", "_label").agg(F.min(F.struct((-F.round("score", 9)).alias("cost"), "class")).alias("top"))
    return top.select(F.col("_key").alias(key), F.col("_fold").alias("fold"), F.col("_label").alias("label"), F.col("top.class").alias("pred"), (-F.col("top.cost")).alias("score"))


def cv_bayes(df: DataFrame, target: str, key: str, columns: Sequence[str], *, metric: str = "accuracy", **options) -> DataFrame:
    """``(fold, n_validate, score)`` of the out-of-fold predictions."""
    oof = oof_bayes(df, target, key, columns, **options)
    return score_table(oof, metric, by=["fold"]).join(oof.groupBy("fold").agg(F.count("*").alias("n_validate")), "fold").select("fold", "n_validate", F.col(metric).alias("score"))
