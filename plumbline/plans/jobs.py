"""Whole runs composed of the operators: cross-validated and holdout runs, paired arms, graded tasks, feasibility."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import decide as D
from plumbline.operators import grading as J
from plumbline.operators import metrics as M
from plumbline.operators.clean import fit_cleaning, without_drop
from plumbline.operators.encode import TargetTransform, clip_nonnegative, fit_ordinals
from plumbline.operators.features import fit_features
from plumbline.operators.folds import carve_key, holdout
from plumbline.operators.profile import looks_like_classes
from plumbline.operators.userfeatures import UserFeature, add_features
from plumbline.operators.verify import verified_folds
from plumbline.plans import audit as A
from plumbline.plans.gates import Climb
from plumbline.plans.model import (
    CVResult, Fitted, Learner, adversarial_auc, class_list, cross_validate, default_metric, fit, forest, score_frame)
from plumbline.session import dealt, kept
from plumbline.sources.load import guard_inputs, infer_task


@dataclass
class Plans:
    """Everything a user may propose for a run; all of it is verified or measured before use."""

    folds: Mapping = field(default_factory=dict)
    ordinals: Sequence = ()
    cleaning: Mapping | None = None
    risky_drops: Sequence[str] = ()
    features: Mapping | None = None
    user_features: Sequence[UserFeature] = ()
    try_log_target: bool = False
    budget: int | None = None


@dataclass
class Run:
    """What a run found out, as small frames and one optional prediction table."""

    cv: CVResult
    folds: dict
    interventions: DataFrame
    fitted: Fitted
    log: list[tuple]
    columns: tuple[int, int, int]       # before, after cleaning, after features
    shift_auc: float | None = None
    submission: DataFrame | None = None
    trials_spent: int = 0


def label_submission(pred: DataFrame, key: str, target: str, clip: bool = False) -> DataFrame:
    value: Column = clip_nonnegative(F.col("pred")) if clip else F.col("pred")
    return pred.select(key, value.alias(target))


def proba_submission(pred: DataFrame, key: str, classes: Sequence, columns: Sequence[str], positive: Any = None) -> DataFrame:
    """Probabilities under the column names asked for: every class by its name, or a single column for one class (the last by default)."""
    by_class = F.map_from_arrays(F.array(*[F.lit(str(c)) for c in classes]), F.col("proba"))
    wanted = {c: c for c in columns} if len(columns) > 1 or columns[0] in map(str, classes) and len(classes) == 1 else \
        {columns[0]: str(classes[-1] if positive is None else positive)}
    if len(columns) > 1 and sorted(columns) != sorted(map(str, classes)) or set(wanted.values()) - set(map(str, classes)):
        raise ValueError(f"columns {list(columns)} are neither the classes {list(classes)} nor one probability")
    return pred.select(key, *[by_class[c].alias(name) for name, c in wanted.items()])


def top_k_long(wide: DataFrame, key: str, classes: Sequence[str], k: int, out: str = "choice") -> DataFrame:
    """The ``k`` most probable classes per row, best first, ties to the earlier class; row by row, no shuffle."""
    entries = F.array(*[F.struct((-F.col(f"`{c}`")).alias("p"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(classes)])
    best = F.slice(F.array_sort(entries), 1, k)
    return wide.select(key, F.posexplode(best).alias("_p", "_e")).select(
        key, (F.col("_p") + 1).cast("bigint").alias("place"), F.col("_e.c").alias(out))


def run_cv(df: DataFrame, target: str, key: str, plans: Plans | None = None, *, test: DataFrame | None = None, k: int = 3,
           seed: int = 42, learner: Learner | None = None, metric: str | None = None, proba_columns: Sequence[str] | None = None) -> Run:
    """Ordinals, cleaning, features, gates, framing, final fit and submission, every choice measured by CV."""
    plans = plans or Plans()
    before = len(df.columns)
    folds = verified_folds(df, plans.folds, target)
    log: list[tuple] = [("folds", folds["strategy"], folds["status"], folds["reason"])]
    steps = []
    if plans.ordinals:
        step = fit_ordinals(df, plans.ordinals, target)
        df, log = step.transform(df), log + step.log
        steps.append(step)
    # every choice passes over the table again
    with dealt(df) as rows:
        return _chosen(rows, target, key, plans, test, dict(k=k, seed=seed, folds=folds, learner=learner, metric=metric), proba_columns, steps, log, before)


def _chosen(df: DataFrame, target: str, key: str, plans: Plans, test: DataFrame | None, options: dict[str, Any],
            proba_columns: Sequence[str] | None, steps: list, log: list[tuple], before: int) -> Run:
    """The run from the table with its ordinals on."""
    folds, learner = options["folds"], options["learner"]
    climb = Climb(df, target, key, options | ({"cleaning": plans.cleaning} if plans.cleaning else {}), plans.budget)
    if plans.cleaning and plans.risky_drops:
        climb.keep_columns(plans.risky_drops)
    cleaning = climb.options.get("cleaning")
    full = df
    widths = [before, len(df.columns)]
    for plan, fitter in ((cleaning, fit_cleaning), (plans.features, fit_features)):
        if plan:
            step = fitter(full, _sparing(plan, key), target)
            full, log = step.transform(full), log + step.log
            steps.append(step)
        if fitter is fit_cleaning:
            widths[1] = len(full.columns)
    if plans.features:
        # what was measured so far had no feature plan, so it is measured anew with it
        climb.options["features"], climb.stand = plans.features, None
    kept = climb.features(plans.user_features) if plans.user_features else []
    transform = climb.log_target() if plans.try_log_target else None
    cv = climb.current
    final = add_features(full, [], target, key, kept)[0] if kept else full
    fitted = fit(final, target, learner or forest(), key=key, classes=cv.classes, transform=transform)
    run = Run(cv, folds, climb.records(), fitted, log, (before, widths[1], len(final.columns)), trials_spent=climb.spent)
    if test is not None:
        run.shift_auc = adversarial_auc(df, _replay(test, steps[:1] if plans.ordinals else []), target, key, cleaning=cleaning)
        seen = _replay(test, steps)
        if kept:
            seen = add_features(full, [seen], target, key, kept)[1]
        pred = fitted.predict(seen, [key])
        if proba_columns:
            run.submission = proba_submission(pred, key, cv.classes, proba_columns)
        else:
            clip = cv.classes is None and df.agg(F.min(F.col(f"`{target}`"))).first()[0] >= 0
            run.submission = label_submission(pred, key, target, clip)
    return run


def _sparing(plan: Mapping, key: str) -> Mapping:
    """The plan with the row's key left in the table: it names rows and is never a feature, dropped or not."""
    return without_drop(plan, key) if "columns_to_drop" in plan else plan


def _replay(df: DataFrame, steps: Sequence) -> DataFrame:
    for s in steps:
        df = s.transform(df)
    return df


def run_holdout(df: DataFrame, target: str, key: str, plans: Plans | None = None, *, fraction: float = 0.2, seed: int = 42,
                learner: Learner | None = None, metric: str | None = None) -> DataFrame:
    """One row: a single split, plans fitted on its training part, scored on the rest."""
    plans = plans or Plans()
    marked = holdout(df, key, fraction, seed)
    train, held = marked.where("NOT held_out").drop("held_out"), marked.where("held_out").drop("held_out")
    for plan, fitter in ((plans.cleaning, fit_cleaning), (plans.features, fit_features)):
        if plan:
            step = fitter(train, _sparing(plan, key), target)
            train, held = step.transform(train), step.transform(held)
    classes = class_list(df, target) if looks_like_classes(df, target) else None
    fitted = fit(train, target, learner or forest(), key=key, classes=classes)
    used = metric or default_metric(classes)
    pred = fitted.predict(held, [key, F.col(f"`{target}`").alias("label")])
    return score_frame(pred, used, classes).select(F.lit(used).alias("metric"), "score", F.lit(len(fitted.features)).alias("n_features"))


def paired_run(df: DataFrame, target: str, key: str, metric: str, treatment: Plans, *, baseline: Plans | None = None,
               seeds: Sequence[int] = (42,), holdout_frac: float = 0.25, learner: Learner | None = None, k: int = 3) -> DataFrame:
    """Both arms on the same carve and folds per seed, graded on the hidden key: one ledger row per seed.

    A seed that fails is recorded with its error and does not void the others.
    """
    spark, rows = df.sparkSession, []
    label = target if looks_like_classes(df, target) else None
    higher = metric in M.HIGHER_IS_BETTER
    for seed in seeds:
        work, features, answer = carve_key(df, key, target, holdout_frac, label=label, seed=seed)
        try:
            scores = []
            with dealt(work) as table, kept(features):
                for plans in (baseline or Plans(), treatment):
                    run = run_cv(table, target, key, plans, test=features, k=k, seed=seed, learner=learner)
                    scores.append(float(J.grade(answer, run.submission, key, target, metric).first()[metric]))
            rows.append((seed, scores[0], scores[1], None))
        except Exception as problem:  # noqa: BLE001 - fits fail in unpredictable ways; the failure is recorded
            rows.append((seed, None, None, f"{type(problem).__name__}: {problem}"))
    if all(r[3] for r in rows):
        raise RuntimeError(f"all {len(rows)} seeds failed: {rows}")
    out = spark.createDataFrame(rows, "seed bigint, baseline double, treatment double, error string")
    return out.withColumns({"metric": F.lit(metric), "higher_is_better": F.lit(higher)})


def graded_run(train: DataFrame, test: DataFrame, sample: DataFrame, answer: DataFrame, metric: str, *, learner: Learner | None = None,
               k: int = 3, calibrate: bool = False, seed: int = 42) -> DataFrame:
    """One record: infer the task, run CV and submission, grade it, and report the gap to the estimate."""
    task = infer_task(train, test, sample).first()
    if not task.ok:
        raise ValueError("the sample submission fits no supported task shape")
    key, target = task.id_column, task.target
    spark = train.sparkSession
    mode, optimised = M.metric_mode(F.lit(metric))
    how = spark.range(1).select(mode.alias("mode"), optimised.alias("optimised")).first()
    columns = [c for c in sample.columns if c != key] if how.mode == "proba" else None
    cv_metric = {"auc": "roc_auc"}.get(metric, metric)
    run = run_cv(train, target, key, test=test, k=k, seed=seed, learner=learner, metric=cv_metric if how.mode != "mismatch" else None,
                 proba_columns=columns)
    sign = -1.0 if cv_metric not in M.HIGHER_IS_BETTER else 1.0
    cv_score, temperature, calibrated = sign * run.cv.mean, None, None
    submission = run.submission
    if how.mode == "proba":
        classes = run.cv.classes
        names = [str(c) for c in classes]
        temperature = M.fit_temperature(run.cv.oof.select("label", "proba"), classes)[0]
        softened = run.cv.oof.withColumn("proba", M.apply_temperature(F.col("proba"), temperature))
        cv_score = sign * score_frame(run.cv.oof, cv_metric, classes).first().score
        calibrated = sign * score_frame(softened, cv_metric, classes).first().score
        array = F.array(*[F.col(c) for c in names]) if len(columns) > 1 else F.array(1 - F.col(columns[0]), F.col(columns[0]))
        proba = M.apply_temperature(array, temperature) if calibrate else array
        graded = answer.select(key, F.col(target).alias("label")).join(submission.select(key, proba.alias("proba")), key)
        external = sign * score_frame(graded, cv_metric, classes).first().score
    else:
        external = float(J.grade(answer, submission, key, target, metric).first()[metric])
    rec = spark.createDataFrame([(target, how.mode, cv_score, external, temperature, calibrated)],
                                "task string, mode string, cv_score double, external_score double, temperature double, cv_score_calibrated double")
    return D.cv_gap(rec)


def check_validation(df: DataFrame, target: str, key: str, proposal: Mapping, *, k: int = 3, seed: int = 42,
                     learner: Learner | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """One row: the verified design and the measured optimism of a naive random split on the same data."""
    args: dict[str, Any] = dict(k=k, seed=seed, learner=learner, exclude=exclude)
    # the check and both estimates pass over the table
    with dealt(df) as rows:
        plan = verified_folds(rows, proposal, target)
        column = plan["group_column"] or plan["time_column"]
        naive = cross_validate(rows, target, key, **args)
        if plan["strategy"] == "random":
            scores = naive.frame(arm="naive").unionByName(naive.frame(arm="recommended"))
        else:
            scores = naive.frame(arm="naive").unionByName(cross_validate(rows, target, key, folds=plan, **args).frame(arm="recommended"))
    gap = D.optimism_gap(scores.withColumns({"strategy": F.lit(plan["strategy"]), "column": F.lit(column).cast("string"),
                                             "higher_is_better": F.lit(True)}), ["strategy", "column", "metric"])
    return gap


def feasibility(df: DataFrame, target: str, key: str, *, proposal: Mapping | None = None, k: int = 3, learner: Learner | None = None,
                top: int = 5) -> DataFrame:
    """One record: achievable quality, fold design, strongest drivers and the audit's risk, or a reasoned refusal."""
    guard = guard_inputs(df, [target, key]).first()
    if guard.verdict != "ok":
        return df.sparkSession.createDataFrame(
            [(guard.verdict, guard.reason, None, None, None, None, None, None)],
            "verdict string, reason string, metric string, mean double, std double, strategy string, risk string, drivers string")
    run = run_cv(df, target, key, Plans(folds=proposal or {}), k=k, learner=learner)
    risk = A.risk_level(A.audit(df, target, proposal=proposal)).first().risk
    drivers = ", ".join(n for n, _ in run.fitted.drivers(top))
    return df.sparkSession.createDataFrame(
        [("ok", "", run.cv.metric, run.cv.mean, run.cv.std, run.folds["strategy"], risk, drivers)],
        "verdict string, reason string, metric string, mean double, std double, strategy string, risk string, drivers string")
