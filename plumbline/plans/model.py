"""Distributed fits with Spark ML: holdout, cross-validation, comparison and shift checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col_type, is_number, is_temporal, is_text, keyed_hash, ordinal_time
from plumbline.operators import decide as D
from plumbline.operators.clean import fit_cleaning, require_features, without_drop
from plumbline.operators.encode import TargetTransform
from plumbline.operators.features import fit_features
from plumbline.operators.folds import fold_masks
from plumbline.operators.metrics import roc_auc, score_table
from plumbline.operators.ordering import global_rank
from plumbline.operators.profile import looks_like_classes
from plumbline.operators.userfeatures import UserFeature, add_features
from plumbline.session import dealt, kept, stable

HASH_WIDTH = 1 << 12    # slots of a hashed one-hot column, whatever its number of levels
PARTS = 5               # parts of the training rows whose own labels stay out of their level statistics
SMOOTHING = 4.0         # rows of the overall mean added to every level's statistic
CONCURRENT_FITS = 3
SENT_NUMBERS = 500_000  # numbers of a table of level statistics that is sent to every executor; larger ones are joined by shuffles
MAX_CLASSES = 10_000    # of a target: each is a literal of the plan and an entry of every probability vector
ERRORS = ("rmse", "mae", "rmsle", "rmspe", "log_loss", "wmae")


@dataclass(frozen=True)
class Learner:
    """Any pair of Spark ML estimators; the target decides which one is used."""

    classifier: Estimator
    regressor: Estimator
    one_hot: bool = False
    name: str = "learner"


def forest(trees: int = 20, depth: int = 6, seed: int = 42) -> Learner:
    return Learner(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed),
                   GBTRegressor(maxIter=10, maxDepth=4, seed=seed), name="forest")


def tree(depth: int = 5, seed: int = 42) -> Learner:
    return Learner(DecisionTreeClassifier(maxDepth=depth, seed=seed),
                   DecisionTreeRegressor(maxDepth=depth, seed=seed), name="tree")


def constant() -> Learner:
    """Predicts the mean or the largest class: the least any model should beat."""
    return Learner(DecisionTreeClassifier(maxDepth=0), DecisionTreeRegressor(maxDepth=0), name="constant")


def linear(reg: float = 1e-3) -> Learner:
    return Learner(LogisticRegression(regParam=reg, maxIter=50), LinearRegression(regParam=reg), one_hot=True, name="linear")


@dataclass
class Fitted:
    """A fitted model with the preparation that belongs to it."""

    prepare: Callable[[DataFrame], DataFrame]
    model: PipelineModel
    classes: list | None
    features: list[str]
    target: str
    transform: TargetTransform | None = None
    owners: list[str] = field(default_factory=list)     # the column behind every slot of the feature vector

    def predict(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` columns plus ``pred`` and, for classes, ``proba`` in class order."""
        scored = self.model.transform(self.prepare(df))
        if self.classes is None:
            pred = F.col("prediction")
            return scored.select(*keep, (self.transform.inverse(pred) if self.transform else pred).alias("pred"))
        labels = F.array(*[F.lit(c) for c in self.classes])
        # a class missing from this training part has probability 0, not a shorter list
        padded = F.concat(vector_to_array("probability"), F.array_repeat(F.lit(0.0), len(self.classes)))
        return scored.select(*keep, labels[F.col("prediction").cast("int")].alias("pred"),
                             F.slice(padded, 1, len(self.classes)).alias("proba"))

    def drivers(self, top: int = 5) -> list[tuple[str, float]]:
        """Strongest features by tree importance or absolute coefficient."""
        last = self.model.stages[-1]
        if hasattr(last, "featureImportances"):
            weights = [float(v) for v in last.featureImportances.toArray()]
        else:
            matrix = last.coefficientMatrix.toArray() if self.classes else [last.coefficients.toArray()]
            weights = [float(max(abs(r[i]) for r in matrix)) for i in range(len(matrix[0]))]
        # a column is as strong as its slots together
        total: dict[str, float] = {}
        for name, w in zip(self.owners, weights):
            total[name] = total.get(name, 0.0) + w
        return sorted(total.items(), key=lambda p: (-p[1], p[0]))[:top]


def class_list(df: DataFrame, target: str, limit: int | None = None) -> list:
    """All classes of the target, sorted. A model holds one entry for each, so targets with more than ``limit``
    (``MAX_CLASSES`` if not given) are refused; Spark counts them before any is collected."""
    y = F.col(f"`{target}`")
    with kept(df.where(y.isNotNull()).select(y).distinct()) as found:
        n, limit = found.count(), MAX_CLASSES if limit is None else limit
        if n > limit:
            raise ValueError(f"target {target!r} has {n} classes, more than {limit}")
        return sorted(r[0] for r in found.collect())


def level_statistics(train: DataFrame, column: str, label: Column, n_stats: int) -> DataFrame:
    """``(level, part, n, s0..)`` of rows with a ``_part``: label sums of every level outside the part; part -1 holds all rows of the level."""
    hits = [label] if n_stats == 1 else [(label == i).cast("double") for i in range(n_stats)]
    rows = train.select(F.coalesce(F.col(f"`{column}`"), F.lit("<missing>")).alias("level"), F.col("_part").alias("part"), *[h.alias(f"s{i}") for i, h in enumerate(hits)])
    names = [f"s{i}" for i in range(n_stats)]
    parts = rows.groupBy("level", "part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names])
    whole = parts.groupBy("level").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    rest = parts.join(whole.withColumnsRenamed({c: f"all_{c}" for c in ("n", *names)}), "level")
    rest = rest.select("level", "part", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in ("n", *names)])
    return whole.select("level", F.lit(-1).alias("part"), "n", *names).union(rest.select("level", "part", "n", *names))


def _parted(train: DataFrame, key: str | None) -> DataFrame:
    """The rows with a ``_part`` that says nothing about their label: drawn from the key, or else from the place in the order
    of all row hashes. Equal rows stand together there, so copies spread evenly over the parts; which copy gets which part changes nothing."""
    if key is not None:
        return train.withColumn("_part", F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(PARTS)).cast("int"))
    whole = F.xxhash64(*[F.col(f"`{c}`") for c, t in train.dtypes if not t.startswith("map")])
    ranked = global_rank(train.withColumns({"_row": whole, "_copy": F.monotonically_increasing_id()}), ["_row", "_copy"], name="_place")
    return ranked.withColumn("_part", (F.col("_place") % PARTS).cast("int")).drop("_row", "_copy", "_place")


def fit(train: DataFrame, target: str, learner: Learner, *, exclude: Sequence[str] = (), classes: Sequence | None = None,
        weight: str | None = None, transform: TargetTransform | None = None, key: str | None = None) -> Fitted:
    """Fit on every row of ``train``. ``classes`` given means classification; nulls get the training mean or a level of
    their own. Text of any number of levels is encoded in one way: by a hashed one-hot block for linear learners, by the
    label statistics of its level for the others, where a training row's own part of the rows stays out of its statistic.
    A unique ``key`` draws the parts without moving rows; it is no feature."""
    names = [c for c in train.columns if c not in {target, weight, key, *exclude}]
    require_features(train.select(target, *names), target)
    train = train.where(F.col(f"`{target}`").isNotNull())
    numbers = [c for c in names if is_number(col_type(train, c)) or isinstance(col_type(train, c), T.BooleanType)]
    times = [c for c in names if is_temporal(col_type(train, c))]
    texts = [c for c in names if is_text(col_type(train, c))]

    def as_number(df, c):
        return (ordinal_time(df, c) / 1e6 if c in times else F.col(f"`{c}`")).cast("double")

    y = F.col(f"`{target}`")
    if classes is None:
        label: Column = (transform.forward(y) if transform else y).cast("double")
    else:
        label = (F.array_position(F.array(*[F.lit(c) for c in classes]), y) - 1).cast("double")
    n_stats = 1 if classes is None or len(classes) <= 2 else len(classes)
    # linear learners see levels as a hashed one-hot block of fixed width; trees see what the label does within a level
    levels = {}
    encoded = bool(texts) and not learner.one_hot
    overall = [F.avg(label if n_stats == 1 else (label == i).cast("double")).alias(f"o_{i}") for i in range(n_stats)] if encoded else []
    facts = train.agg(F.count(F.lit(1)).alias("n"), *[F.avg(as_number(train, c)).alias(f"m_{i}") for i, c in enumerate(numbers + times)], *overall).first()
    means = {c: facts[f"m_{i}"] for i, c in enumerate(numbers + times) if facts[f"m_{i}"] is not None}
    used = [*means, *texts]
    if encoded:
        train = _parted(train, key)
        for c in texts:
            # written once: training, every pass of the learner and every prediction read it
            table = stable(level_statistics(train, c, label, n_stats))
            small = table.count() * (n_stats + 2) <= SENT_NUMBERS
            levels[c] = (F.broadcast(table) if small else table, [facts[f"o_{i}"] for i in range(n_stats)])

    def prepare(df: DataFrame, training: bool = False) -> DataFrame:
        made = {f"_x_{i}": F.coalesce(as_number(df, c), F.lit(m)) for i, (c, m) in enumerate(means.items())}
        out = df.withColumns(made if training and encoded else {**made, "_part": F.lit(-1)})
        for i, c in enumerate(texts):
            level = F.coalesce(F.col(f"`{c}`"), F.lit("<missing>"))
            if learner.one_hot:
                out = out.withColumn(f"_l_{i}", level)
                continue
            table, overall = levels[c]
            table = table.select(F.col("level").alias("_level"), F.col("part").alias("_p"), F.col("n").alias("_n"), *[F.col(f"s{j}").alias(f"_s{j}") for j in range(n_stats)])
            out = out.join(table, (level == F.col("_level")) & (F.col("_part") == F.col("_p")), "left")
            n = F.coalesce(F.col("_n"), F.lit(0))
            stats = {f"_t_{i}_{j}": (F.coalesce(F.col(f"_s{j}"), F.lit(0.0)) + SMOOTHING * m) / (n + SMOOTHING) for j, m in enumerate(overall)}
            out = out.withColumns(stats).drop("_level", "_p", "_n", *[f"_s{j}" for j in range(n_stats)])
        return out.drop("_part")

    stages: list[Any] = []
    slots = {c: [f"_x_{i}"] for i, c in enumerate(means)}
    for i, c in enumerate(texts):
        if learner.one_hot:
            stages.append(FeatureHasher(inputCols=[f"_l_{i}"], outputCol=f"_h_{i}", numFeatures=HASH_WIDTH))
        slots[c] = [f"_h_{i}"] if learner.one_hot else [f"_t_{i}_{j}" for j in range(n_stats)]
    stages.append(VectorAssembler(inputCols=[x for xs in slots.values() for x in xs], outputCol="_features", handleInvalid="error"))
    owners = [c for c, xs in slots.items() for x in xs for _ in range(HASH_WIDTH if x.startswith("_h_") else 1)]
    params = {"featuresCol": "_features", "labelCol": "_label"}
    estimator = learner.regressor if classes is None else learner.classifier
    chosen = estimator.copy({estimator.getParam(k): v for k, v in params.items()})
    if weight:
        chosen = chosen.copy({chosen.getParam("weightCol"): weight})
    inputs = [f"_l_{i}" for i, _ in enumerate(texts) if learner.one_hot] + [x for xs in slots.values() for x in xs if not x.startswith("_h_")]
    rows = prepare(train, training=True).withColumn("_label", label).select(*inputs, "_label", *([F.col(f"`{weight}`")] if weight else []))
    # learners pass over the rows again and again: the prepared columns are computed once
    with kept(rows):
        model = Pipeline(stages=[*stages, chosen]).fit(rows)
    return Fitted(prepare, model, list(classes) if classes is not None else None, used, target, transform, owners)


def score_frame(pred: DataFrame, metric: str, classes: Sequence | None, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """The metric over predictions, signed so that higher is better."""
    out = score_table(pred, metric, classes, weight, by)
    sign = -1.0 if metric in ERRORS else 1.0
    return out.select(*by, (F.col(metric) * sign).alias("score"))


def default_metric(classes: Sequence | None) -> str:
    return "accuracy" if classes is not None else "rmse"


def train_and_evaluate(train: DataFrame, held: DataFrame, target: str, key: str, learner: Learner | None = None, *,
                       metric: str | None = None, weight: str | None = None) -> tuple[Fitted, float]:
    """Fit on train, score on the held-out rows."""
    classes = class_list(train.unionByName(held), target) if looks_like_classes(train, target) else None
    fitted = fit(train, target, learner or forest(), key=key, classes=classes, weight=weight)
    pred = fitted.predict(held, [key, F.col(f"`{target}`").alias("label"), *([F.col(f"`{weight}`")] if weight else [])])
    return fitted, score_frame(pred, metric or default_metric(classes), classes, weight=weight).first().score


@dataclass
class CVResult:
    """A cross-validation estimate; scores are higher-is-better."""

    metric: str
    fold_scores: list[float]
    oof: DataFrame                      # key, fold, label, pred[, proba]
    classes: list | None
    folds: list[int] = field(default_factory=list)

    @property
    def mean(self) -> float:
        return sum(self.fold_scores) / len(self.fold_scores)

    @property
    def std(self) -> float:
        return (sum((s - self.mean) ** 2 for s in self.fold_scores) / len(self.fold_scores)) ** 0.5

    def frame(self, **labels) -> DataFrame:
        """Fold scores as rows, with constant label columns."""
        rows = [(f, s) for f, s in zip(self.folds, self.fold_scores)]
        out = self.oof.sparkSession.createDataFrame(rows, "fold bigint, score double").withColumn("metric", F.lit(self.metric))
        return out.withColumns({k: F.lit(v) for k, v in labels.items()}) if labels else out


def cross_validate(df: DataFrame, target: str, key: str, *, k: int = 3, seed: int = 42, folds: Mapping | None = None,
                   learner: Learner | None = None, cleaning: Mapping | None = None, features: Mapping | None = None,
                   user_features: Sequence[UserFeature] = (), metric: str | None = None, weight: str | None = None,
                   transform: TargetTransform | None = None, stratified: bool = True, exclude: Sequence[str] = (),
                   splitter: Callable | None = None) -> CVResult:
    """Leakage-free cross-validation: every statistic of every plan is fitted on its fold's training rows.

    A target transform is fitted forward and inverted before scoring, so scores stay in original units.
    The table is read once and dealt evenly over the cores, which keep it (a caller that estimates again passes one that it keeps so);
    folds are conditions on one assigned table, kept while they are fitted. The predictions are written once.
    """
    with dealt(df) as rows:
        return _estimated(rows.where(F.col(f"`{target}`").isNotNull()), target, key, k, seed, folds, learner, cleaning, features,
                          user_features, metric, weight, transform, stratified, exclude, splitter)


def _estimated(df: DataFrame, target: str, key: str, k: int, seed: int, folds: Mapping | None, learner: Learner | None, cleaning: Mapping | None,
               features: Mapping | None, user_features: Sequence[UserFeature], metric: str | None, weight: str | None,
               transform: TargetTransform | None, stratified: bool, exclude: Sequence[str], splitter: Callable | None) -> CVResult:
    """The estimate from a kept table of labelled rows."""
    classes = class_list(df, target) if looks_like_classes(df, target) else None
    metric = metric or default_metric(classes)
    label = target if classes is not None and stratified else None
    masks = fold_masks(df, folds or {}, key, k, label=label, seed=seed, splitter=splitter)
    ids = sorted(masks.sides)

    def one(i: int) -> DataFrame:
        train, held = masks.part(i, "train"), masks.part(i, "validate")
        # the key names rows whether or not the plan drops it
        clean = without_drop(cleaning, key) if cleaning else None
        for plan, fitter in ((clean, fit_cleaning), (features, fit_features)):
            if plan:
                step = fitter(train, plan, target)
                train, held = step.transform(train), step.transform(held)
        if user_features:
            train, held = add_features(train, [held], target, key, user_features)
        fitted = fit(train, target, learner or forest(), key=key, exclude=exclude, classes=classes, weight=weight, transform=transform)
        keep = [F.col(f"`{key}`"), F.lit(i).cast("bigint").alias("fold"), F.col(f"`{target}`").alias("label")]
        return fitted.predict(held, keep + ([F.col(f"`{weight}`")] if weight else []))

    # without columns of their own the conditions read the table that is kept already
    with kept(masks.table) if masks.helpers else nullcontext(), ThreadPoolExecutor(CONCURRENT_FITS) as pool:
        parts = list(pool.map(one, ids))
        oof = stable(reduce(DataFrame.unionByName, parts))
    scores = {r.fold: r.score for r in score_frame(oof, metric, classes, ["fold"], weight).collect()}
    ids = [i for i in ids if i in scores]       # a fold without validation rows has no score
    return CVResult(metric, [float(scores[i]) for i in ids], oof, classes, ids)


def pair_frame(base: CVResult, trial: CVResult, **labels) -> DataFrame:
    """Fold-paired scores of two estimates made on the same folds."""
    spark = base.oof.sparkSession
    rows = [(f, b, t) for f, b, t in zip(base.folds, base.fold_scores, trial.fold_scores)]
    out = spark.createDataFrame(rows, "fold bigint, base double, trial double").withColumns(
        {"higher_is_better": F.lit(True), "base_std": F.lit(base.std)})
    return out.withColumns({k: F.lit(v) for k, v in {"comparison": "all", **labels}.items()})


def compare(a: Learner, b: Learner, df: DataFrame, target: str, key: str, *, k: int = 5, seeds: int = 1,
            metric: str | None = None, splitter: Callable | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """One row: does ``b`` beat ``a`` on identical folds? Pools (seed, fold) pairs; never returns a model."""
    pairs, means, n_folds, used = None, [], k, ""
    for seed in range(seeds):
        ca, cb = (cross_validate(df, target, key, k=k, seed=seed, learner=m, metric=metric, splitter=splitter, exclude=exclude) for m in (a, b))
        n_folds, used = len(ca.folds), ca.metric
        means.append((ca.mean, cb.mean))
        one = pair_frame(ca, cb, seed=seed)
        pairs = one if pairs is None else pairs.unionByName(one)
    verdict = D.compare_verdict(pairs, ["comparison"], n_folds)
    return verdict.drop("comparison").withColumns({
        "a_mean": F.lit(sum(m[0] for m in means) / seeds), "b_mean": F.lit(sum(m[1] for m in means) / seeds),
        "metric": F.lit(used), "n_folds": F.lit(n_folds), "n_seeds": F.lit(seeds)})


# ---- shift ---------------------------------------------------------------------------------

def shared_features(train: DataFrame, test: DataFrame, target: str, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c in train.columns if c in test.columns and c != target and c not in exclude]


def label_sides(train: DataFrame, test: DataFrame, target: str, exclude: Sequence[str] = ()) -> DataFrame | None:
    """Union of the shared feature columns with ``is_test`` 0/1; None without shared columns."""
    names = shared_features(train, test, target, exclude)
    if not names:
        return None
    return (train.select(*names).withColumn("is_test", F.lit(0)).unionByName(test.select(*names).withColumn("is_test", F.lit(1))))


def hold_out(both: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Add ``_held``: a third of the rows of both sides."""
    return both.withColumn("_held", keyed_hash(seed, key, "is_test") % 3 == 0)


def side_scores(both: DataFrame, key: str, *, learner: Learner | None = None) -> DataFrame:
    """``(label, score, n)``: how many ``_held`` rows of either ``is_test`` were given each probability of being a test row; written once."""
    fitted = fit(both.where("NOT _held").drop("_held"), "is_test", learner or tree(), key=key, classes=[0, 1])
    pred = fitted.predict(both.where("_held"), [F.col("is_test").alias("label")])
    return stable(pred.groupBy("label", F.col("proba")[1].alias("score")).agg(F.count(F.lit(1)).cast("double").alias("n")))


def adversarial_auc(train: DataFrame, test: DataFrame, target: str, key: str, *, learner: Learner | None = None,
                    cleaning: Mapping | None = None, exclude: Sequence[str] = (), seed: int = 42) -> float | None:
    """Held-out AUC of telling test rows from training rows; about 0.5 means no detectable shift."""
    if cleaning:
        step = fit_cleaning(train, without_drop(cleaning, key), target)
        train, test = step.transform(train), step.transform(test)
    both = label_sides(train, test, target, exclude)
    if both is None or len(shared_features(train, test, target, [*exclude, key])) == 0:
        return None
    with kept(hold_out(both, key, seed)) as rows:
        scores = side_scores(rows, key, learner=learner)
    return roc_auc(scores, weight=F.col("n")).first().roc_auc


def univariate_shift(train: DataFrame, test: DataFrame, target: str, exclude: Sequence[str] = ()) -> DataFrame:
    """``(column, auc)`` of every shared numeric column on its own, all in one pass; folded to at least 0.5."""
    both = label_sides(train, test, target, exclude)
    names = [c for c in both.columns if c != "is_test" and is_number(col_type(both, c))]
    long = both.select(F.col("is_test").alias("label"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("score")) for c in names])))
    return roc_auc(long, ["column"]).select("column", F.greatest(F.col("roc_auc"), 1 - F.col("roc_auc")).alias("auc"))
