"""Metrics over prediction tables, per group or pooled.

Inputs carry ``label`` and ``pred`` (or ``score`` / ``proba``); ``by`` names grouping columns. Every
metric starts from a map-side partial aggregate; label metrics then work on the confusion counts only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordering import global_rank, running_counts

EPSILON = 2.220446049250313e-16     # fixed value: probability clip of log loss

# Which metrics grow with quality.
HIGHER_IS_BETTER = ("accuracy", "balanced_accuracy", "f1_macro", "f1", "mcc", "quadratic_weighted_kappa", "r2", "roc_auc")
# Competition metric -> the metric a cross-validation optimises directly.
ALIGNED = {"accuracy": "accuracy", "balanced_accuracy": "balanced_accuracy", "f1": "f1", "f1_macro": "f1_macro", "mcc": "mcc",
           "roc_auc": "roc_auc", "auc": "roc_auc", "log_loss": "log_loss", "rmse": "root_mean_squared_error",
           "mae": "mean_absolute_error", "r2": "r2"}
PROBABILITY = ("roc_auc", "auc", "log_loss")            # fixed values
OUT_OF_FOLD = ("quadratic_weighted_kappa",)             # fixed values: only computable on predictions


def confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "label", "pred").agg(F.count(F.lit(1)).alias("n"))


def _per_class(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by, cls, hit, n_true, n_pred)`` for every class among labels and predictions."""
    same = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("label").alias("cls"), same.alias("hit"), F.col("n").alias("n_true"), zero.alias("n_pred")),
        F.struct(F.col("pred").alias("cls"), zero.alias("hit"), zero.alias("n_true"), F.col("n").alias("n_pred")))
    return (confusion(df, by).select(*by, F.inline(sides)).groupBy(*by, "cls")
            .agg(*[F.sum(c).cast("double").alias(c) for c in ("hit", "n_true", "n_pred")]))


def accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))


def balanced_accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean recall over the classes that occur as labels."""
    return _per_class(df, by).where("n_true > 0").groupBy(*by).agg(F.avg(F.col("hit") / F.col("n_true")).alias("balanced_accuracy"))


def f1_macro(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("n_true") + F.col("n_pred")), F.lit(0.0))
    return _per_class(df, by).groupBy(*by).agg(F.avg(f1).alias("f1_macro"))


def f1(df: DataFrame, positive, by: Sequence[str] = ()) -> DataFrame:
    y, p = F.col("label") == F.lit(positive), F.col("pred") == F.lit(positive)
    value = F.try_divide(2.0 * F.count_if(y & p), F.count_if(y) + F.count_if(p))
    return df.groupBy(*by).agg(F.coalesce(value, F.lit(0.0)).alias("f1"))


def mcc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Matthews correlation for any number of classes; 0 when undefined."""
    s, c = F.sum("n_true"), F.sum("hit")
    cross = F.sum(F.col("n_true") * F.col("n_pred"))
    spread = F.sqrt((s * s - F.sum(F.col("n_pred") * F.col("n_pred"))) * (s * s - F.sum(F.col("n_true") * F.col("n_true"))))
    return _per_class(df, by).groupBy(*by).agg(F.coalesce(F.try_divide(c * s - cross, spread), F.lit(0.0)).alias("mcc"))


def quadratic_weighted_kappa(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Agreement with squared penalties over level positions; expected counts come from the margins' moments."""
    cells = confusion(df, by)
    levels = cells.select(*by, F.explode(F.array("label", "pred")).alias("cls")).distinct()
    # levels are numbered over the whole table; a group's own numbers follow from its smallest, since levels lead by group
    ranked = global_rank(levels, [*by, "cls"], group=list(by)) if by else global_rank(levels, ["cls"])
    place = ranked.select(*by, "cls", F.col("group_rank" if by else "rank").cast("double").alias("i"))
    i, j = place.withColumnsRenamed({"cls": "label"}), place.withColumnsRenamed({"cls": "pred", "i": "j"})
    n, ci, cj = F.col("n").cast("double"), F.col("i"), F.col("j")
    placed = cells.join(i, [*by, "label"]).join(j, [*by, "pred"])
    out = placed.groupBy(*by).agg(
        F.sum(n).alias("s"), F.sum(n * (ci - cj) * (ci - cj)).alias("seen"), F.sum(n * ci).alias("mi"), F.sum(n * cj).alias("mj"),
        F.sum(n * ci * ci).alias("ii"), F.sum(n * cj * cj).alias("jj"))
    expected = F.col("ii") + F.col("jj") - 2 * F.col("mi") * F.col("mj") / F.col("s")
    return out.select(*by, (1 - F.coalesce(F.try_divide(F.col("seen"), expected), F.lit(0.0))).alias("quadratic_weighted_kappa"))


def _error():
    return F.col("label").cast("double") - F.col("pred").cast("double")


def regression(df: DataFrame, by: Sequence[str] = (), negate: bool = False) -> DataFrame:
    """``rmse, mae, r2``; ``negate`` reports the errors so that higher is better."""
    e = _error()
    y = F.when(e.isNotNull(), F.col("label").cast("double"))
    sign = -1.0 if negate else 1.0
    r2 = F.coalesce(1 - F.try_divide(F.avg(e * e), F.var_pop(y)), F.lit(0.0))
    return df.groupBy(*by).agg((F.sqrt(F.avg(e * e)) * sign).alias("rmse"), (F.avg(F.abs(e)) * sign).alias("mae"), r2.alias("r2"))


def rmsle(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Root mean squared log error, predictions floored at 0."""
    d = F.log1p(F.greatest(F.col("pred").cast("double"), F.lit(0.0))) - F.log1p(F.col("label").cast("double"))
    return df.groupBy(*by).agg(F.sqrt(F.avg(d * d)).alias("rmsle"), F.count(d).alias("n"))


def rmspe(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Root mean squared percentage error over non-zero labels; 0 when none is left."""
    q = F.when(F.col("label") != 0, _error() / F.col("label"))
    return df.groupBy(*by).agg(F.coalesce(F.sqrt(F.avg(q * q)), F.lit(0.0)).alias("rmspe"))


def weighted_mae(df: DataFrame, weight: str, by: Sequence[str] = ()) -> DataFrame:
    w = F.when(_error().isNotNull(), F.col(f"`{weight}`"))
    return df.groupBy(*by).agg(F.try_divide(F.sum(w * F.abs(_error())), F.sum(w)).alias("wmae"))


def roc_auc(df: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Area under the ROC curve of a 0/1 ``label`` by ``score``; ties count half, NULL with one class."""
    one = F.lit(1.0) if weight is None else weight
    scores = df.where("label IS NOT NULL AND score IS NOT NULL").groupBy(*by, F.col("score").cast("double").alias("score")).agg(
        F.sum(F.when(F.col("label") == 1, one).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col("label") == 1, 0.0).otherwise(one)).alias("neg"))
    below = running_counts(scores, "score", ["neg"], by)
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return below.groupBy(*by).agg(F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, classes: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Macro mean of one-vs-rest AUC; ``proba`` lists one probability per class in the given order."""
    sides = F.array(*[F.struct(F.lit(c).alias("_c"), (F.col("label") == F.lit(c)).cast("int").alias("label"),
                               F.col("proba")[i].alias("score")) for i, c in enumerate(classes)])
    each = roc_auc(df.select(*by, F.inline(sides)), [*by, "_c"])
    return each.groupBy(*by).agg(F.avg("roc_auc").alias("roc_auc_ovr"))


def true_probability(classes: Sequence) -> Column:
    """The probability given to the row's own label, clipped away from 0 and 1."""
    own = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label"))
    p = F.when(own > 0, F.try_element_at(F.col("proba"), own.cast("int")))
    return F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))


def log_loss(df: DataFrame, classes: Sequence, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(-F.log(true_probability(classes))).alias("log_loss"))


def per_fold_and_pooled(df: DataFrame, aggs: Sequence[Column], fold: str = "fold") -> DataFrame:
    """The same aggregates for every fold and, with fold NULL, over all rows: one shuffle of partial sums."""
    return df.rollup(fold).agg(*aggs)


def metric_mode(metric: Column) -> tuple[Column, Column]:
    """``(mode, optimised metric)`` of a competition metric: aligned, proba, oof, mismatch or default."""
    names = F.create_map(*[F.lit(x) for p in ALIGNED.items() for x in p])
    mode = F.when(metric.isNull(), "default").when(metric.isin(list(PROBABILITY)), "proba") \
            .when(metric.isin(list(ALIGNED)), "aligned").when(metric.isin(list(OUT_OF_FOLD)), "oof").otherwise("mismatch")
    return mode, F.try_element_at(names, metric)


# ---- calibration ---------------------------------------------------------------------------

def apply_temperature(proba: Column, temperature: float | Column) -> Column:
    """``p ** (1/T)`` renormalised; the order of the classes never changes."""
    if not isinstance(temperature, Column):
        if temperature <= 0:
            raise ValueError("temperature must be positive")
        temperature = F.lit(float(temperature))
    raised = F.transform(proba, lambda p: F.pow(p, 1 / temperature))
    total = F.aggregate(raised, F.lit(0.0), lambda a, p: a + p)
    return F.transform(raised, lambda p: F.try_divide(p, total))


def _log_grid(lo: float, hi: float, n: int) -> list[float]:
    return [lo * (hi / lo) ** (i / (n - 1)) for i in range(n)]


def fit_temperature(df: DataFrame, classes: Sequence, bounds: tuple[float, float] = (0.05, 20.0), *, grid: int = 24,
                    passes: int = 3) -> tuple[float, float, float]:
    """``(temperature, loss, loss at T=1)`` minimising log loss on out-of-fold probabilities.

    Each pass tries a log-spaced grid in one aggregate and narrows to the neighbours of the best point.
    """
    lo, hi = bounds
    own = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")).cast("int")
    logs = df.select(F.transform("proba", lambda p: F.log(p)).alias("z"), own.alias("own"))
    cap, floor, t = -math.log(EPSILON), -math.log1p(-EPSILON), F.col("t")
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.coalesce(F.exp(x / t), F.lit(0.0)))
    mine = F.when(F.col("own") > 0, F.try_element_at("z", F.col("own")))
    loss = F.avg(F.greatest(F.least(F.coalesce(F.log(total) - mine / t, F.lit(cap)), F.lit(cap)), F.lit(floor)))

    def losses(points: Sequence[float]) -> list[float]:
        """One aggregate; the points are rows, so neither their number nor the plan depends on the classes."""
        grid_rows = logs.select("*", F.posexplode(F.array(*[F.lit(float(x)) for x in points])).alias("i", "t"))
        found = {r.i: r.loss for r in grid_rows.groupBy("i").agg(loss.alias("loss")).collect()}
        return [found[i] for i in range(len(points))]

    plain = best = None
    for _ in range(passes):
        points = _log_grid(lo, hi, grid)
        plain, *tried = losses([1.0, *points])
        i = min(range(grid), key=tried.__getitem__)
        best = (points[i], tried[i])
        lo, hi = points[max(0, i - 1)], points[min(grid - 1, i + 1)]
    return best[0], best[1], plain


def _weighted(value: Column, weight: str, by: Sequence[str], name: str, shape: Callable[[Column], Column] = lambda c: c) -> Callable[[DataFrame], DataFrame]:
    w = F.when(value.isNotNull(), F.col(f"`{weight}`"))
    return lambda df: df.groupBy(*by).agg(shape(F.try_divide(F.sum(w * value), F.sum(w))).alias(name))


def score_table(df: DataFrame, metric: str, classes: Sequence | None = None, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``(by, metric)`` over ``label``, ``pred`` and, for probabilities, ``proba`` in class order.

    More than two classes score ROC AUC one against the rest; ``f1`` takes the last class as positive. With a
    weight, metrics that are means over rows are weighted; others refuse it.
    """
    if metric == "roc_auc" and classes is not None and "proba" in df.columns:
        if len(classes) > 2:
            if weight:
                raise ValueError("roc_auc of several classes takes no weight")
            return roc_auc_ovr(df, classes, by).withColumnRenamed("roc_auc_ovr", "roc_auc")
        names = [*by, (F.col("label") == F.lit(classes[-1])).cast("int").alias("label"), F.col("proba")[len(classes) - 1].alias("score")]
        return roc_auc(df.select(*names, *([weight] if weight else [])), by, F.col(f"`{weight}`").cast("double") if weight else None)
    if weight:
        rows = {"accuracy": (F.col("label") == F.col("pred")).cast("double"), "mae": F.abs(_error()), "wmae": F.abs(_error()), "rmse": _error() * _error()}
        if metric == "log_loss":
            rows["log_loss"] = -F.log(true_probability(classes))
        if metric not in rows:
            raise ValueError(f"{metric} takes no weight")
        return _weighted(rows[metric], weight, by, metric, F.sqrt if metric == "rmse" else lambda c: c)(df)
    if metric == "log_loss":
        return log_loss(df, classes, by)
    if metric == "f1":
        positive = classes[-1] if classes else df.agg(F.max("label")).first()[0]
        return f1(df, positive, by)
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, known: {sorted([*METRICS, 'f1', 'log_loss', 'wmae'])}")
    return METRICS[metric](df, by)


METRICS: dict[str, Callable[..., DataFrame]] = {
    "accuracy": accuracy, "balanced_accuracy": balanced_accuracy, "f1_macro": f1_macro, "mcc": mcc,
    "quadratic_weighted_kappa": quadratic_weighted_kappa,
    "rmse": lambda df, by=(): regression(df, by).select(*by, "rmse"),
    "mae": lambda df, by=(): regression(df, by).select(*by, "mae"),
    "r2": lambda df, by=(): regression(df, by).select(*by, "r2"),
    "rmsle": lambda df, by=(): rmsle(df, by).select(*by, "rmsle"), "rmspe": rmspe, "roc_auc": roc_auc,
}
