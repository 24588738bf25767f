"""What a fitted model leans on: how much worse it scores when a column's values are permuted among the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.metrics import score_table
from plumbline.operators.permute import ranked, versions
from plumbline.plans.model import ERRORS, Fitted, default_metric


def permutation_drivers(df: DataFrame, target: str, key: str, columns: Sequence[str], predict: Callable[[DataFrame], DataFrame], metric: str, *,
                        classes: Sequence | None = None, seed: int | str = 0) -> DataFrame:
    """``(column, base, permuted, importance)``; importance is the loss of score, positive for columns the model needs.

    ``predict`` turns rows with ``version``, ``label`` and the columns into rows with ``version``, ``label`` and ``pred``
    (and ``proba`` where the metric needs it). All columns are permuted by maps of one ranking and scored in a single pass.
    Rows without a target take no part; a table without rows gives none.
    """
    known = df.where(F.col(f"`{target}`").isNotNull()).select(key, F.col(f"`{target}`").alias("label"), *columns)
    rows, n = ranked(known, key, seed)
    scored = predict(versions(rows, n, columns, ["label"], seed)).withColumn("version", F.coalesce("version", F.lit("")))
    sign = -1.0 if metric in ERRORS else 1.0
    table = score_table(scored, metric, classes, by=["version"]).select("version", (F.col(metric) * sign).alias("score"))
    base = table.where("version = ''").select(F.col("score").alias("base"))
    # one row per column
    return (table.where("version <> ''").join(F.broadcast(base)).select(F.col("version").alias("column"), "base", F.col("score").alias("permuted"), (F.col("base") - F.col("score")).alias("importance")))


def fitted_drivers(fitted: Fitted, df: DataFrame, key: str, metric: str | None = None, seed: int | str = 0) -> DataFrame:
    """The drivers of a fitted model over the rows of ``df``."""
    return permutation_drivers(df, fitted.target, key, fitted.features, lambda rows: fitted.predict(rows, ["version", "label"]), metric or default_metric(fitted.classes),
                               classes=fitted.classes, seed=seed)
