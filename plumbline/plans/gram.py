"""Linear cross-validation from sufficient statistics: every fold's fit and score out of one scan.

Rows belong to cells, and every fold trains on some cells and validates on others. Per cell one aggregate holds, for each pair of
design columns, how many rows have both, their means over those rows and their co-moment. Deviations from any
centre follow from these without cancellation, so that

* a fold's normal equations are the sum over its training cells around its own training means. A filled
  gap lies on the mean and deviates by nothing: missing values are imputed by each fold's training mean without a second scan;
* its squared error on the validation cells is a quadratic form of their statistics;
* any subset of the columns, another target among them or another penalty only solves smaller systems of the same statistics.

Only ``cells x pairs`` rows reach the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col_type, is_number, is_temporal, is_text, keyed_hash, ordinal_time
from plumbline.operators import decide as D
from plumbline.operators.folds import assign_group, assign_stratified, position_cells
from plumbline.plans.model import class_list

MAX_WIDTH = 256     # of a design: the driver holds cells x pairs of its columns
MAX_LEVELS = 64     # of a text column that becomes indicators


def design(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str, Column]]:
    """``{name: (owner, double column)}``: numbers, booleans and times as they are, text as an indicator per level."""
    out: dict[str, tuple[str, Column]] = {}
    for c in columns:
        kind, col = col_type(df, c), F.col(f"`{c}`")
        if is_number(kind) or isinstance(kind, T.BooleanType):
            out[c] = (c, F.nanvl(col.cast("double"), F.lit(None).cast("double")))
        elif is_temporal(kind):
            out[c] = (c, (ordinal_time(df, c) / 1e6).cast("double"))
        elif is_text(kind):
            level = F.coalesce(col, F.lit("<missing>"))
            for value in class_list(df.select(level.alias("level")), "level", MAX_LEVELS):
                out[f"{c}={value}"] = (c, (level == value).cast("double"))
        else:
            raise ValueError(f"column {c!r} of type {kind.simpleString()} is no linear feature")
    if len(out) > MAX_WIDTH:
        raise ValueError(f"a design of {len(out)} columns is wider than {MAX_WIDTH}")
    return out


@dataclass(frozen=True)
class Cells:
    """A table whose ``_cell_<seed>`` columns number the cells, and per seed the folds as (train cells, validation cells)."""

    table: DataFrame
    folds: dict[int, list[tuple[frozenset[int], frozenset[int]]]]


def fold_cells(df: DataFrame, key: str, k: int, seeds: Sequence[int] = (42,), plan: Mapping | None = None, label: str | None = None) -> Cells:
    """Cells of random (default), stratified (``label``), group or expanding time folds.

    Random folds are an expression, so any number of seeds adds no scan. The others assign the table once for each seed.
    """
    plan = plan or {}
    strategy = plan.get("strategy", "random")
    if strategy == "time":
        table = df.withColumn(f"_cell_{seeds[0]}", position_cells(df, plan["time_column"], key, k))
        folds = [(frozenset(range(i + 1)), frozenset([i + 1])) for i in range(k)]
        return Cells(table.withColumns({f"_cell_{s}": F.col(f"_cell_{seeds[0]}") for s in seeds[1:]}), {s: folds for s in seeds})
    table = df
    for s in seeds:
        if strategy == "group":
            table = assign_group(table, plan["group_column"], k, label).withColumnRenamed("own", f"_cell_{s}")
        elif strategy == "random" and label:
            table = assign_stratified(table, key, label, k, s).withColumnRenamed("own", f"_cell_{s}")
        elif strategy == "random":
            table = table.withColumn(f"_cell_{s}", keyed_hash(s, key) % k)
        else:
            raise ValueError(f"no cells for strategy {strategy!r}")
    every = frozenset(range(k))
    return Cells(table, {s: [(every - {i}, frozenset([i])) for i in range(k)] for s in seeds})


@dataclass
class _Cell:
    n: np.ndarray       # rows that have both columns of a pair
    mean: np.ndarray    # mean of the first column over those rows
    co: np.ndarray      # their co-moment

    def about(self, centre: np.ndarray) -> np.ndarray:
        """Sums of products of deviations from ``centre`` over the rows that have both."""
        shift = self.mean - centre[:, None]
        return self.co + self.n * shift * shift.T


@dataclass
class Moments:
    """Sufficient statistics of a design and its target (the last column) per (seed, cell)."""

    names: list[str]
    owners: list[str]
    cells: dict[tuple[int, int], _Cell]
    folds: dict[int, list[tuple[frozenset[int], frozenset[int]]]]

    def subset(self, columns: Sequence[str]) -> list[int]:
        return [i for i, owner in enumerate(self.owners) if owner in set(columns)]


def moments(cells: Cells, columns: Mapping[str, tuple[str, Column]], target: Column) -> Moments:
    """One aggregate over the table: pairs of present values per seed and cell. Rows without a target or a cell take no part."""
    names = [*columns, None]
    seeds = list(cells.folds)
    wide = cells.table.select(F.array(*[c for _, c in columns.values()], F.nanvl(target.cast("double"), F.lit(None).cast("double"))).alias("x"),
                              F.array(*[F.struct(F.lit(s).alias("seed"), F.col(f"_cell_{s}").cast("int").alias("cell")) for s in seeds]).alias("at"))
    wide = wide.where(F.element_at("x", -1).isNotNull()).select("x", F.inline("at")).where("cell is not null")
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("x")[i].alias("a"), F.col("x")[j].alias("b")) for i in range(len(names)) for j in range(i, len(names))])
    long = wide.select("seed", "cell", F.inline(pairs)).where("a is not null and b is not null")
    sums = long.groupBy("seed", "cell", "i", "j").agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.covar_pop("a", "b").alias("co"))
    found: dict[tuple[int, int], _Cell] = {}
    size = len(names)
    for r in sums.collect():
        c = found.setdefault((r.seed, r.cell), _Cell(np.zeros((size, size)), np.zeros((size, size)), np.zeros((size, size))))
        c.n[r.i, r.j] = c.n[r.j, r.i] = r.n
        c.mean[r.i, r.j], c.mean[r.j, r.i] = r.mean_a, r.mean_b
        c.co[r.i, r.j] = c.co[r.j, r.i] = r.co * r.n
    return Moments(list(columns), [owner for owner, _ in columns.values()], found, cells.folds)


@dataclass
class LinearFold:
    """One fold's fit on some design columns and its scores on the validation cells."""

    seed: int
    fold: int
    used: list[int]
    means: np.ndarray       # of the columns used, over the training rows that have them
    coefficients: np.ndarray
    intercept: float        # at the means: the target's mean
    n_train: int
    n_validate: int
    rmse: float
    r2: float


def _sum(cells: Sequence[_Cell], about: np.ndarray) -> np.ndarray:
    return np.sum([c.about(about) for c in cells], axis=0)


def solve(m: Moments, used: Sequence[int], reg: float = 0.0) -> list[LinearFold]:
    """Ridge fits of all seeds and folds; ``reg`` is the share of each column's variance added to the diagonal.

    Columns that are missing or constant in a fold's training rows get no weight. Folds without training or validation rows are left out.
    """
    out = []
    for seed, folds in m.folds.items():
        for fold, (train_ids, valid_ids) in enumerate(folds):
            train, valid = ([m.cells[seed, c] for c in sorted(ids) if (seed, c) in m.cells] for ids in (train_ids, valid_ids))
            if not train or not valid:
                continue
            n = np.sum([np.diag(c.n) for c in train], axis=0)
            centre = np.sum([np.diag(c.n) * np.diag(c.mean) for c in train], axis=0) / np.maximum(n, 1)
            s = _sum(train, centre)
            live = [i for i in used if s[i, i] > n[i] * (1e-14 * centre[i]) ** 2]
            gram = s[np.ix_(live, live)]
            b = np.linalg.lstsq(gram + reg * np.diag(np.diag(gram)), s[live, -1], rcond=1e-12)[0] if live else np.empty(0)
            v = _sum(valid, centre)
            way = np.append(-b, 1.0)
            at = [*live, len(centre) - 1]
            error = float(way @ v[np.ix_(at, at)] @ way)
            n_valid = int(sum(c.n[-1, -1] for c in valid))
            held_mean = sum(c.n[-1, -1] * c.mean[-1, -1] for c in valid) / n_valid
            total = float(sum(c.co[-1, -1] + c.n[-1, -1] * (c.mean[-1, -1] - held_mean) ** 2 for c in valid))
            out.append(LinearFold(seed, fold, live, centre[live], b, float(centre[-1]), int(n[-1]), n_valid,
                                  max(error, 0.0) ** 0.5 / n_valid ** 0.5, 1 - error / total if total > 0 else float("nan")))
    return out


def linear_value(columns: Mapping[str, tuple[str, Column]], fit: LinearFold) -> Column:
    """The prediction of one fit; gaps lie on the training mean."""
    x, value = list(columns.values()), F.lit(fit.intercept)
    for i, mean, b in zip(fit.used, fit.means.tolist(), fit.coefficients.tolist()):
        value = value + (F.coalesce(x[i][1], F.lit(mean)) - mean) * b
    return value


def fit_gram(df: DataFrame, target: str, columns: Sequence[str], reg: float = 0.0) -> tuple[dict[str, tuple[str, Column]], LinearFold]:
    """The design and the fit on all rows with a target."""
    x, one = design(df, columns), frozenset([0])
    m = moments(Cells(df.withColumn("_cell_0", F.lit(0)), {0: [(one, one)]}), x, F.col(f"`{target}`"))
    return x, solve(m, m.subset(columns), reg)[0]


@dataclass
class GramCV:
    """A linear cross-validation; ``frame`` has a row per seed and fold, ``oof`` predicts in a second, narrow scan."""

    cells: Cells
    columns: dict[str, tuple[str, Column]]
    target: Column
    moments: Moments
    fits: list[LinearFold] = field(default_factory=list)

    def frame(self, digits: int | None = None) -> DataFrame:
        rows = [(f.seed, f.fold, f.n_train, f.n_validate, f.rmse, f.r2) for f in self.fits]
        out = self.cells.table.sparkSession.createDataFrame(rows, "seed bigint, fold bigint, n_train bigint, n_validate bigint, rmse double, r2 double")
        return out if digits is None else out.withColumns({c: F.round(c, digits) for c in ("rmse", "r2")})

    def oof(self, keep: Sequence[str], seed: int | None = None) -> DataFrame:
        """``keep``, fold, label and the prediction of the fold that validates the row: an expression over literals."""
        seed = next(iter(self.cells.folds)) if seed is None else seed
        fold, pred = F.lit(None).cast("bigint"), F.lit(None).cast("double")
        for f in (f for f in self.fits if f.seed == seed):
            here = F.col(f"_cell_{seed}").isin(*self.cells.folds[seed][f.fold][1])
            fold, pred = F.when(here, F.lit(f.fold)).otherwise(fold), F.when(here, linear_value(self.columns, f)).otherwise(pred)
        rows = self.cells.table.where(self.target.isNotNull())
        return rows.select(*keep, fold.alias("fold"), self.target.alias("label"), pred.alias("pred")).where("fold is not null")


def cv_gram(df: DataFrame, target: str, key: str, columns: Sequence[str], *, k: int = 5, seeds: Sequence[int] = (42,), reg: float = 0.0, plan: Mapping | None = None) -> GramCV:
    """Cross-validated linear regression on ``columns``; all seeds and folds from one scan."""
    cells = fold_cells(df, key, k, seeds, plan)
    x, y = design(df, columns), F.col(f"`{target}`")
    m = moments(cells, x, y)
    return GramCV(cells, x, y, m, solve(m, m.subset(columns), reg))


SIGNS = {"rmse": -1.0, "r2": 1.0}


def _pairs(base: Sequence[LinearFold], trial: Sequence[LinearFold], metric: str) -> list[tuple[int, int, float, float]]:
    by = {(f.seed, f.fold): f for f in trial}
    return [(f.seed, f.fold, SIGNS[metric] * getattr(f, metric), SIGNS[metric] * getattr(by[f.seed, f.fold], metric)) for f in base if (f.seed, f.fold) in by]


def compare_gram(df: DataFrame, target: str, key: str, arms: Mapping[str, tuple[Sequence[str], Sequence[str]]], *, k: int = 5, seeds: int = 5,
                 reg: float = 0.0, metric: str = "r2", plan: Mapping | None = None) -> DataFrame:
    """Does the second list of columns of each arm beat the first on identical folds? One row per arm, all from one scan.

    The verdict pools (seed, fold) pairs as ``compare`` does; scores are higher-is-better.
    """
    columns = list(dict.fromkeys(c for pair in arms.values() for side in pair for c in side))
    cells = fold_cells(df, key, k, range(seeds), plan)
    m = moments(cells, design(df, columns), F.col(f"`{target}`"))
    rows = [(name, *p) for name, (a, b) in arms.items() for p in _pairs(solve(m, m.subset(a), reg), solve(m, m.subset(b), reg), metric)]
    pairs = df.sparkSession.createDataFrame(rows, "arm string, seed bigint, fold bigint, base double, trial double")
    means = pairs.groupBy("arm").agg(F.avg("base").alias("a_mean"), F.avg("trial").alias("b_mean"))
    return D.compare_verdict(pairs, ["arm"], k).join(means, "arm").withColumn("metric", F.lit(metric))


def ablate_gram(df: DataFrame, target: str, key: str, columns: Sequence[str], **options) -> DataFrame:
    """What each column is worth: all columns against all but this one; ``improved`` marks columns that carry weight beyond noise."""
    arms = {c: ([x for x in columns if x != c], list(columns)) for c in columns}
    return compare_gram(df, target, key, arms, **options).withColumnRenamed("arm", "column")
