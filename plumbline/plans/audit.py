"""The audit before modelling: structure, leaks, fold design and shift as one findings table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.profile import leak_scan, profile, structural_flags
from plumbline.operators.verify import SHIFT_STRONG, check_folds

# What a reader should do about each finding.
ACTIONS = {
    "target_leak": "remove before any score is believed",
    "leakage_warning": "confirm the value is known at prediction time",
    "fold_design": "build folds this way",
    "shift": "expect the estimate not to transfer",
    "id_like": "drop",
    "constant": "drop",
    "high_missing": "impute or drop",
    "high_card_text": "extract features or drop",
}
# Worst first; the headline of a table is its first finding in this order.
SEVERITY_ORDER = ("target_leak", "leakage_warning", "fold_design", "shift",
                  "id_like", "constant", "high_missing", "high_card_text")


def severity_rank(check: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in SEVERITY_ORDER]), check)


def _severity(check: Column) -> Column:
    return F.when(check.isin("target_leak", "leakage_warning"), "high") \
            .when(check.isin("fold_design", "shift"), "elevated").otherwise("note")


def audit(df: DataFrame, target: str, *, proposal: Mapping | None = None, shift_auc: float | None = None) -> DataFrame:
    """Findings ``(check, column, value, severity, action)``.

    One scan for structure (distinct counts exact only where a flag is near), one for correlations,
    one for the proposed fold design.
    """
    if target not in df.columns:
        raise ValueError(f"target {target!r} is not a column of the table")
    proposal = dict(proposal or {})
    parts = [structural_flags(profile(df, target, distinct="screened")),
             leak_scan(df, target).select(F.lit("target_leak").alias("check"), "column", F.col("r_abs").alias("value"))]
    design = check_folds(df, proposal, target).where("strategy <> 'random'")
    parts.append(design.select(F.lit("fold_design").alias("check"),
                               F.concat_ws(":", "strategy", "column", "period").alias("column"),
                               F.col("n_values").cast("double").alias("value")))
    spark = df.sparkSession
    warned = [(w["column"],) for w in proposal.get("leakage_warnings") or [] if w.get("column")]
    if warned:
        parts.append(spark.createDataFrame(warned, "column string").select(
            F.lit("leakage_warning").alias("check"), "column", F.lit(None).cast("double").alias("value")))
    if shift_auc is not None and shift_auc >= SHIFT_STRONG:
        parts.append(spark.range(1).select(F.lit("shift").alias("check"), F.lit("train/test").alias("column"),
                                           F.lit(float(shift_auc)).alias("value")))
    rows = reduce(DataFrame.unionByName, parts)
    actions = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return rows.select("check", "column", "value", _severity(F.col("check")).alias("severity"),
                       F.try_element_at(actions, F.col("check")).alias("action"))


def risk_level(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``risk`` per audited table: any leak evidence is high, a design change or strong shift elevated."""
    worst = F.max(F.when(F.col("severity") == "high", 2).when(F.col("severity") == "elevated", 1).otherwise(0))
    grouped = findings.groupBy(*by) if by else findings.groupBy()
    out = grouped.agg(F.coalesce(worst, F.lit(0)).alias("_w"), F.count(F.lit(1)).alias("n_findings"))
    return out.withColumn("risk", F.element_at(F.array(F.lit("low"), F.lit("elevated"), F.lit("high")),
                                               F.col("_w") + 1)).drop("_w")


def worst_finding(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """The headline finding of every audited table."""
    return findings.groupBy(*by).agg(
        F.min_by(F.struct("check", "column", "value"), F.struct(severity_rank(F.col("check")), F.col("column"))).alias("w")
    ).select(*by, F.col("w.check").alias("check"), F.col("w.column").alias("column"), F.col("w.value").alias("value"))


def audit_many(catalog: Sequence[tuple[str, DataFrame, str, Mapping | None]]) -> DataFrame:
    """Findings of several tables in one relation keyed by table name."""
    return reduce(DataFrame.unionByName, [
        audit(df, target, proposal=proposal).withColumn("audited", F.lit(name)) for name, df, target, proposal in catalog])
