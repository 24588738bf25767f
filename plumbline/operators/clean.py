"""Cleaning plans: a table of requests judged against the schema, fitted on training rows, replayed as literals."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import INTEGRAL, col_type, is_number
from plumbline.operators.ordering import column_quantiles, exact_quantiles

STRATEGIES = ("median", "mean", "most_frequent", "constant")   # fixed vocabulary
AVERAGES = ("median", "mean")
LOG_SCHEMA = "op string, column string, status string, detail string"


class Request(NamedTuple):
    """One line of a plan. ``column`` is None when the line names none."""

    op: str
    shown: str
    column: str | None
    strategy: str | None = None
    value: Any = None
    note: str = ""


def requests(plan: Mapping) -> list[Request]:
    """The plan as lines, drops first; a bare string is short for the column it names."""
    lines = []
    for op, section in (("drop", "columns_to_drop"), ("impute", "imputations")):
        for raw in plan.get(section) or []:
            told = {"column": raw} if isinstance(raw, str) else raw
            if isinstance(told, Mapping):
                name = told.get("column")
                lines.append(Request(op, str(name), name, told.get("strategy"), told.get("fill_value"), told.get("reason") or ""))
            else:
                lines.append(Request(op, str(raw), None))
    return lines


class Facts(NamedTuple):
    """What a line is judged by."""

    schema: T.StructType
    target: str
    dropped: frozenset[str]

    def kind(self, name: str) -> T.DataType | None:
        return self.schema[name].dataType if name in self.schema.names else None


#: What stands against a line: for which operations, when, and the words for the log. The first that holds decides.
OBJECTIONS: list[tuple[tuple[str, ...], Callable[[Request, Facts], bool], str]] = [
    (("drop",), lambda r, f: r.column is None, "not a column entry"),
    (("impute",), lambda r, f: r.column is None, "not an imputation entry"),
    (("drop", "impute"), lambda r, f: r.column == f.target, "is the target"),
    (("drop",), lambda r, f: f.kind(r.column) is None, "does not exist"),
    (("impute",), lambda r, f: f.kind(r.column) is None or r.column in f.dropped, "not present"),
    (("impute",), lambda r, f: r.strategy not in STRATEGIES, "unknown strategy {strategy}"),
    (("impute",), lambda r, f: r.strategy in AVERAGES and not is_number(f.kind(r.column)), "{strategy} does not match the type"),
]


def judged(df: DataFrame, plan: Mapping, target: str) -> list[tuple[Request, str]]:
    """Every line with the objection against it, empty when there is none. Needs the schema only."""
    out: list[tuple[Request, str]] = []
    dropped: frozenset[str] = frozenset()
    for line in requests(plan):
        facts = Facts(df.schema, target, dropped)
        words = next((text for ops, holds, text in OBJECTIONS if line.op in ops and holds(line, facts)), "")
        out.append((line, words.format(strategy=line.strategy)))
        if line.op == "drop" and not words:
            dropped |= {line.column}
    return out


def filled(df: DataFrame, name: str, value: Column, strategy: str) -> Column:
    """The column with its gaps filled. An average of whole numbers need not be whole, so such a column becomes double."""
    kind = col_type(df, name)
    if strategy in AVERAGES and isinstance(kind, INTEGRAL):
        kind = T.DoubleType()
    return F.coalesce(F.col(f"`{name}`").cast(kind), value.cast(kind))


@dataclass
class CleaningFit:
    """Columns to drop and frozen fill values."""

    drops: list[str]
    fills: dict[str, Any]
    log: list[tuple] = field(default_factory=list)
    strategies: dict[str, str] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        kept = df.drop(*self.drops)
        return kept.withColumns({c: filled(kept, c, F.lit(v), self.strategies[c]) for c, v in self.fills.items() if v is not None and c in kept.columns})

    def log_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.log, LOG_SCHEMA)


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, Any]:
    """Most frequent value of each column, the smallest on ties; a top-1 over pre-aggregated counts."""
    out = {}
    for c in columns:
        q = F.col(f"`{c}`")
        top = df.where(q.isNotNull()).groupBy(q.alias("v")).count().orderBy(F.desc("count"), "v").limit(1).collect()
        out[c] = top[0].v if top else None
    return out


def fit_cleaning(train: DataFrame, plan: Mapping, target: str) -> CleaningFit:
    """Fit every statistic of the plan on ``train``: one aggregate for means, gaps and constants, shared passes for medians.

    A constant that the column's type can't hold is refused in the log instead of failing later.
    """
    lines = judged(train, plan, target)
    fit = CleaningFit([r.column for r, no in lines if r.op == "drop" and not no], {},
                      [(r.op, r.shown, "skip" if no else "applied", no or r.note) for r, no in lines if r.op == "drop" or no])
    wanted = [r for r, no in lines if r.op == "impute" and not no]
    if not wanted:
        return fit

    def summary(r: Request) -> Column:
        if r.strategy == "mean":
            return F.avg(F.col(f"`{r.column}`").cast("double"))
        if r.strategy == "constant":
            return F.max(F.lit(r.value).try_cast(col_type(train, r.column)))
        return F.lit(None).cast("double")

    row = train.agg(*[(F.count(F.lit(1)) - F.count(F.col(f"`{r.column}`"))).alias(f"gaps{i}") for i, r in enumerate(wanted)],
                    *[summary(r).alias(f"value{i}") for i, r in enumerate(wanted)]).first()
    medians = column_quantiles(train, [r.column for r in wanted if r.strategy == "median"], [0.5])
    most = modes(train, [r.column for r in wanted if r.strategy == "most_frequent"])
    for i, r in enumerate(wanted):
        value = medians[r.column][0] if r.strategy == "median" else most[r.column] if r.strategy == "most_frequent" else row[f"value{i}"]
        if r.strategy == "constant" and r.value is not None and value is None and train.limit(1).count():
            fit.log.append(("impute", r.shown, "skip", "constant does not match the type"))
            continue
        fit.fills[r.column], fit.strategies[r.column] = value, r.strategy
        fit.log.append(("impute", r.shown, "applied", f"{r.strategy} missing={row[f'gaps{i}']}"))
    return fit


def without_drop(plan: Mapping, column: str) -> dict:
    """The plan with one column kept."""
    return {**plan, "columns_to_drop": [d for d in plan.get("columns_to_drop") or [] if not any(r.column == column for r in requests({"columns_to_drop": [d]}))]}


def require_features(df: DataFrame, target: str) -> None:
    """Refuse a table that has nothing left to learn from."""
    if target not in df.columns:
        raise ValueError(f"target {target!r} is missing")
    if len(df.columns) < 2:
        raise ValueError("no feature column is left after cleaning")


def fold_fills(long: DataFrame, plan: Mapping, target: str) -> DataFrame:
    """One row per fold with that fold's own fill values (``fill_<column>``).

    ``long`` is a fold relation: table columns plus ``fold`` and ``role``. Only rows with role
    ``train`` are read, so a validation row can never reach its own statistic.
    """
    wanted = [(r.column, r.strategy, r.value) for r, no in judged(long, plan, target) if r.op == "impute" and not no]
    train = long.where(F.col("role") == "train")
    spark = long.sparkSession
    means = [(c, F.avg(F.col(f"`{c}`").cast("double")).alias(f"fill_{c}")) for c, s, _ in wanted if s == "mean"]
    fills = train.groupBy("fold").agg(F.count(F.lit(1)).alias("n_train"), *[m for _, m in means])
    for c, s, v in wanted:
        q = F.col(f"`{c}`")
        if s == "median":
            pairs = train.select(F.col("fold").alias("g"), q.cast("double").alias("v"))
            rows = [(g, qs[0]) for g, qs in exact_quantiles(pairs, [0.5]).items()]
            one = spark.createDataFrame(rows, f"fold {long.schema['fold'].dataType.simpleString()}, `fill_{c}` double")
        elif s == "most_frequent":
            counts = train.where(q.isNotNull()).groupBy("fold", q.alias("v")).count()
            one = counts.groupBy("fold").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias(f"fill_{c}"))
        elif s == "constant":
            fills = fills.withColumn(f"fill_{c}", F.lit(v).try_cast(col_type(long, c)))
            continue
        else:
            continue
        fills = fills.join(one, "fold", "left")
    return fills


def clean_per_fold(long: DataFrame, plan: Mapping, target: str) -> DataFrame:
    """The fold relation with every fold cleaned by statistics of its own training rows."""
    lines = [r for r, no in judged(long, plan, target) if not no]
    drops, wanted = [r.column for r in lines if r.op == "drop"], [(r.column, r.strategy) for r in lines if r.op == "impute"]
    fills = fold_fills(long, plan, target)
    # one row per fold: always small enough to broadcast
    joined = long.join(F.broadcast(fills), "fold")
    out = joined.withColumns({c: filled(long, c, F.col(f"`fill_{c}`"), s) for c, s in wanted})
    return out.drop("n_train", *drops, *[f"fill_{c}" for c, _ in wanted])
