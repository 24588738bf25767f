"""Checking a proposed fold design against the data before it is used."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import period_expr, split_token, time_axis
from plumbline.operators.profile import MAX_UNPARSEABLE_FRAC

MIN_ENTITIES = 5        # fixed value: fewer groups earn a note
SHIFT_LOW, SHIFT_STRONG = 0.6, 0.8   # fixed values: shift bands


def check_folds(df: DataFrame, proposal: Mapping, target: str) -> DataFrame:
    """One row ``(proposed, strategy, column, period, n_values, status, reason)``.

    ``strategy`` is what to use: the proposal when it holds, else ``random`` with the reason.
    """
    wanted = proposal.get("strategy") or "random"
    column, period = proposal.get(f"{'group' if wanted == 'group' else 'time'}_column"), proposal.get("period_column")
    n_values: Column = F.lit(None).cast("bigint")
    static = defect = note = None
    row = None
    if wanted == "random":
        static = ""
    elif wanted not in ("group", "time", "time_local"):
        static = f"unknown strategy {wanted}"
    elif not column or column not in df.columns:
        static = f"{wanted} column {column} does not exist"
    elif column == target:
        static = f"{wanted} column is the target"
    elif wanted == "group":
        row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(f"`{column}`")).alias("u"))
        n_values = F.col("u")
        defect = F.when(F.col("u") >= F.col("n"), "no entity repeats").when(F.col("u") < 2, "fewer than 2 groups")
        note = F.when(F.col("u") < MIN_ENTITIES, "few entities: is this an entity or a design factor?")
    else:
        unparsed = F.avg(time_axis(df, column).isNull().cast("double")).alias("bad")
        defect = F.when(F.col("bad") > MAX_UNPARSEABLE_FRAC, "time column does not parse")
        if wanted == "time":
            row = df.agg(unparsed)
        else:
            source = split_token(period or "")
            if not period:
                static = "no period column"
            elif source and (source[1] not in df.columns or source[1] == target):
                static = f"period token {period} names no usable column"
            elif not source and period not in df.columns:
                static = f"period column {period} does not exist"
            elif not source and period == target:
                static = "period column is the target"
            else:
                row = df.agg(unparsed, F.count_distinct(period_expr(df, period)).alias("p"))
                n_values = F.col("p")
                defect = defect.when(F.col("p") < 2, "fewer than 2 periods")
    if row is None:
        row = df.sparkSession.range(1)
        defect = F.lit(static) if static else F.lit(None).cast("string")
        n_values = F.lit(None).cast("bigint")
    ok = defect.isNull()
    is_random = F.lit(wanted == "random")
    return row.select(
        F.lit(wanted).alias("proposed"), F.when(ok, F.lit(wanted)).otherwise("random").alias("strategy"),
        F.when(ok & ~is_random, F.lit(column).cast("string")).alias("column"),
        F.when(ok & F.lit(wanted == "time_local"), F.lit(period).cast("string")).alias("period"),
        n_values.alias("n_values"),
        F.when(~ok, "fallback").when(is_random, "default").otherwise("verified").alias("status"),
        F.coalesce(defect, note if note is not None else F.lit(None).cast("string"), F.lit("")).alias("reason"))


def verified_folds(df: DataFrame, proposal: Mapping, target: str) -> dict:
    """The checked design as a plan for :func:`plumbline.operators.folds.make_folds`."""
    r = check_folds(df, proposal, target).first()
    return {"strategy": r.strategy, "group_column": r["column"] if r.strategy == "group" else None,
            "time_column": r["column"] if r.strategy in ("time", "time_local") else None,
            "period_column": r.period, "status": r.status, "reason": r.reason,
            "leakage_warnings": list(proposal.get("leakage_warnings") or [])}


def shift_band(auc: Column) -> Column:
    return F.when(auc.isNull(), "not measured").when(auc < SHIFT_LOW, "low") \
            .when(auc < SHIFT_STRONG, "moderate").otherwise("strong")
