"""Joining submissions to answer keys, arms to arms and references to evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.metrics import METRICS, score_table


def pair(answer: DataFrame, submission: DataFrame, key: str, target: str) -> DataFrame:
    """``(key, label, pred)`` over the keys both sides have."""
    return answer.select(key, F.col(target).alias("label")).join(submission.select(key, F.col(target).alias("pred")), key)


def uncovered(answer: DataFrame, submission: DataFrame, key: str) -> DataFrame:
    """Answer rows the submission does not cover."""
    return answer.join(submission.select(key), key, "left_anti")


def coverage(answer: DataFrame, submission: DataFrame, key: str, target: str) -> DataFrame:
    """One row per key of the answer: ``(key, label, pred, given)`` with the number of submitted rows."""
    sent = submission.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.count(F.lit(1)).alias("given"), F.first(f"`{target}`").alias("pred"))
    return answer.select(key, F.col(f"`{target}`").alias("label")).join(sent, F.col(f"`{key}`").eqNullSafe(F.col("_key")), "left").drop("_key").fillna({"given": 0})


def grade(answer: DataFrame, submission: DataFrame, key: str, target: str, metric: str) -> DataFrame:
    """The metric over the whole answer key; a missing or repeated key of the submission is an error."""
    if metric not in METRICS and metric != "f1":
        raise ValueError(f"unknown metric {metric!r}, known: {sorted([*METRICS, 'f1'])}")
    matched = coverage(answer, submission, key, target)
    found = matched.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("given") == 0).alias("missing"), F.count_if(F.col("given") > 1).alias("repeated")).first()
    if found.missing or found.repeated:
        raise ValueError(f"of {found.n} rows of the answer key, the submission misses {found.missing} and repeats {found.repeated}")
    return score_table(matched, metric).withColumn("n", F.lit(found.n).cast("bigint"))


def common_support(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows both arms predicted: ``(key, label, pred_a, pred_b)``."""
    return (a.where("pred IS NOT NULL").select(key, "label", F.col("pred").alias("pred_a"))
            .join(b.where("pred IS NOT NULL").select(key, F.col("pred").alias("pred_b")), key))


def paired_arms(ledger: DataFrame, keys: Sequence[str], base: str = "baseline", trial: str = "treatment") -> DataFrame:
    """Long ledger ``(keys, arm, score)`` to one row per pair; pairs missing an arm are left out."""
    arm = F.col("arm")
    wide = ledger.groupBy(*keys).agg(F.max(F.when(arm == base, F.col("score"))).alias("base"),
                                     F.max(F.when(arm == trial, F.col("score"))).alias("trial"))
    return wide.where("base IS NOT NULL AND trial IS NOT NULL")


def ground_references(references: DataFrame, evidence: DataFrame, by: str = "brief", url: str = "url") -> DataFrame:
    """Per brief: references backed by evidence, dropped ones, and whether anything is left."""
    known = evidence.select(url).distinct().withColumn("_known", F.lit(True))
    checked = references.join(known, url, "left")
    return checked.groupBy(by).agg(F.count_if("_known").alias("n_kept"), F.count_if(F.col("_known").isNull()).alias("n_dropped"),
                                   F.coalesce(F.bool_or("_known"), F.lit(False)).alias("grounded"))


def dropped_references(references: DataFrame, evidence: DataFrame, url: str = "url") -> DataFrame:
    return references.join(evidence.select(url), url, "left_anti")
