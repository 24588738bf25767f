"""Auditing an existing forecasting backtest: future features, missing gaps, series identity."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import decide as D
from plumbline.operators.encode import check_framing
from plumbline.operators.folds import boundary_split, origin_masks
from plumbline.operators.metrics import roc_auc
from plumbline.operators.permute import permuted, ranked
from plumbline.operators.profile import correlations, looks_like_classes
from plumbline.plans.model import CONCURRENT_FITS, Learner, adversarial_auc, class_list, default_metric, fit, forest, hold_out, score_frame, side_scores, tree
from plumbline.session import kept

PART_ROWS = 50_000      # least rows of a part of the ranked table


def future_features(df: DataFrame, target: str, suspects: Sequence[str]) -> DataFrame:
    """Named suspects that exist, each with its correlation with the target where one can be computed."""
    known = [c for c in dict.fromkeys(suspects) if c in df.columns and c != target]
    return correlations(df, target, known, min_pairs=3)


def split_design(df: DataFrame, target: str, time: str, key: str, *, n_origins: int = 3, test_frac: float = 0.1,
                 embargo_frac: float = 0.05, learner: Learner | None = None, metric: str | None = None) -> DataFrame | None:
    """One row: how much a backtest without a gap overstates quality. None when no origin is possible."""
    masks = origin_masks(df, time, key, n_origins=n_origins, test_frac=test_frac, embargo_frac=embargo_frac)
    if not masks.sides:
        return None
    classes = class_list(df, target) if looks_like_classes(df, target) else None
    metric = metric or default_metric(classes)

    def one(side: tuple[int, str]) -> float:
        i, role = side
        fitted = fit(masks.part(i, role), target, learner or forest(), key=key, classes=classes)
        pred = fitted.predict(masks.part(i, "test"), [key, F.col(f"`{target}`").alias("label")])
        return float(score_frame(pred, metric, classes).first().score)

    origins = sorted(masks.sides)
    with kept(masks.table), ThreadPoolExecutor(CONCURRENT_FITS) as pool:
        scores = list(pool.map(one, [(i, role) for i in origins for role in ("naive_train", "embargo_train")]))
    rows = [(i, *scores[2 * at:2 * at + 2], True) for at, i in enumerate(origins)]
    pairs = df.sparkSession.createDataFrame(rows, "origin bigint, naive double, corrected double, higher_is_better boolean")
    return D.backtest_gap(pairs.withColumn("metric", F.lit(metric)), ["metric"])


def _sides(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return marked.where("NOT after").drop("after"), marked.where("after").drop("after")


def series_boundary(df: DataFrame, target: str, time: str, key: str, series: str, *, test_frac: float = 0.2,
                    learner: Learner | None = None) -> float | None:
    """AUC of telling the two sides of the time cut apart without the series column. Plain trend makes it
    high, so it is shown but never decides."""
    marked = boundary_split(df, time, key, test_frac)
    if marked is None:
        return None
    before, after = _sides(marked)
    return adversarial_auc(before, after, target, key, learner=learner, exclude=[series])


def series_null(df: DataFrame, target: str, time: str, key: str, series: str, *, n_perm: int = 20, test_frac: float = 0.2,
                learner: Learner | None = None, seed: int = 0, exclude: Sequence[str] = ()) -> DataFrame | None:
    """One row: AUC with the true series labels against a band of permuted labels.

    The rows are ranked once and kept in parts by rank; a permutation moves ranks and labels only and is joined once.
    What a model says of the held-out rows is a table of counts, and all areas are measured together.
    """
    marked = boundary_split(df, time, key, test_frac)
    if marked is None:
        return None
    rows, n = ranked(marked, key, seed)
    spark = df.sparkSession
    unseen = [c for c in dict.fromkeys((target, *exclude)) if c not in (key, series)]
    if not set(marked.columns) - {"after", key, target, *exclude}:
        return None
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // PART_ROWS))
    rows = hold_out(rows.withColumn("is_test", F.col("after").cast("int")).drop("after", *unseen), key).repartition(parts, "_rank")

    def one(i: int) -> DataFrame:
        both = (rows if i < 0 else permuted(rows, n, series, f"{seed}/{i}")).drop("_rank", *[c for c in (target, *exclude) if c != key])
        with kept(both):
            return side_scores(both, key, learner=learner).withColumn("version", F.lit(i))

    with kept(rows), ThreadPoolExecutor(CONCURRENT_FITS) as pool:
        scores = reduce(DataFrame.unionByName, pool.map(one, range(-1, n_perm)))
        aucs = {r.version: r.roc_auc for r in roc_auc(scores, ["version"], F.col("n")).collect()}
    observed = aucs.get(-1)
    null = [(aucs[i],) for i in range(n_perm) if aucs.get(i) is not None]
    if observed is None or not null:
        return None
    one = spark.createDataFrame([("all", observed)], "_k string, observed double")
    return D.null_band(one, spark.createDataFrame(null, "score double").withColumn("_k", F.lit("all")), ["_k"]).drop("_k")


def audit_backtest(df: DataFrame, target: str, time: str, key: str, *, suspects: Sequence[str] = (), series: str | None = None,
                   n_origins: int = 3, n_perm: int = 20, learner: Learner | None = None) -> DataFrame:
    """Findings ``(check, subject, value, detail)`` closed by a ``risk`` row."""
    for c in (target, time):
        if c not in df.columns:
            raise ValueError(f"column {c!r} is not in the table")
    with kept(df):
        return _findings(df, target, time, key, suspects, series, n_origins, n_perm, learner)


def _findings(df: DataFrame, target: str, time: str, key: str, suspects: Sequence[str], series: str | None, n_origins: int, n_perm: int,
              learner: Learner | None) -> DataFrame:
    spark = df.sparkSession
    rows: list[tuple] = []
    for r in future_features(df, target, suspects).collect():
        rows.append(("future_feature", r["column"], r.r_abs, "not known at forecast time"))
    design = split_design(df, target, time, key, n_origins=n_origins, learner=learner)
    if design is not None:
        r = design.first()
        rows.append(("split_design", time, r.mean_gap, r.direction))
    if series is not None and series in df.columns:
        auc = series_boundary(df, target, time, key, series)
        if auc is not None:
            rows.append(("series_auc", series, auc, "diagnostic only"))
        null = series_null(df, target, time, key, series, n_perm=n_perm)
        if null is not None:
            r = null.first()
            rows.append(("series_null", series, r.observed, r.verdict))
    framing = check_framing(df, target).first()
    rows.append(("framing", target, None, "log1p eligible" if framing.eligible else framing.reason))
    findings = spark.createDataFrame([(c, s, None if v is None else float(v), d) for c, s, v, d in rows],
                                     "check string, subject string, value double, detail string")
    risk = D.backtest_risk(findings.withColumn("_k", F.lit(1)), ["_k"])
    return findings.unionByName(risk.select(F.lit("risk").alias("check"), F.lit(target).alias("subject"),
                                            F.col("n_drivers").cast("double").alias("value"), F.col("risk").alias("detail")))
