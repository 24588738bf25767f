"""Features brought by the user: fitted on training rows with the target, applied without it."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col_type, is_correlatable, keyed_hash

TOLERANCE = 1e-6    # fixed value


@dataclass(frozen=True)
class UserFeature:
    """``fit(train) -> params`` and ``transform(df, params) -> Column or DataFrame``.

    A Column result becomes ``gen_<name>``; a DataFrame result must be the rows it was given with all their columns
    and that one (use it for a join against fitted params too large for a literal). ``python_feature`` makes one from a
    function over pandas batches.
    """

    name: str
    fit: Callable[[DataFrame], Any]
    transform: Callable[[DataFrame, Any], Column | DataFrame]
    idea: str = ""
    source: str = "user"

    @property
    def column(self) -> str:
        return f"gen_{self.name}"

    def apply(self, df: DataFrame, params: Any, target: str) -> DataFrame:
        """``df`` plus the feature, computed without sight of the target."""
        plain = df.drop(target)
        made = self.transform(plain, params)
        return plain.withColumn(self.column, made) if isinstance(made, Column) else made


def _with_feature(table: DataFrame, feature: UserFeature, params: Any, seen: Sequence[str]) -> DataFrame:
    """``table`` plus the feature; of its columns the feature sees ``seen`` only. No row is joined to itself, so none multiplies."""
    made = feature.transform(table.select(*[F.col(f"`{c}`") for c in seen]), params)
    if isinstance(made, Column):
        _ = table.select(*[F.col(f"`{c}`") for c in seen]).select(made).schema      # refuses other columns before they are in reach
        return table.withColumn(feature.column, made)
    hidden = {c: f"_hidden_{i}" for i, c in enumerate(table.columns) if c not in seen}
    made = feature.transform(table.withColumnsRenamed(hidden), params)
    missing = {*seen, *hidden.values(), feature.column} - set(made.columns)
    if missing:
        raise ValueError(f"the result lacks {sorted(missing)}")
    return made.select(*[F.col(f"`{hidden.get(c, c)}`").alias(c) for c in table.columns if c != feature.column], F.col(f"`{feature.column}`"))


def add_features(train: DataFrame, others: Sequence[DataFrame], target: str, key: str,
                 features: Sequence[UserFeature]) -> tuple[DataFrame, ...]:
    """Add every feature to train and the other tables; each is fitted on the original train and sees neither the target nor
    the other features. Rows keep their number, whatever their keys.

    A feature that fails is left out with a warning, never silently.
    """
    outs = [train, *others]
    seen = [[c for c in t.columns if c != target] for t in outs]
    for f in features:
        try:
            params = f.fit(train)
            outs = [_with_feature(o, f, params, s) for o, s in zip(outs, seen)]
        except (PySparkException, ArithmeticError, LookupError, TypeError, ValueError) as problem:
            warnings.warn(f"feature {f.name!r} left out: {problem}", stacklevel=2)
    return tuple(outs)


def python_feature(name: str, inputs: Sequence[str], fit: Callable[[DataFrame], Any], transform: Callable[[pd.DataFrame, Any], Any], *,
                   verify: bool = True, idea: str = "") -> UserFeature:
    """A feature from a function over pandas batches of the input columns: one number per row; NaN and None become null.

    ``fit`` sees the training rows as a Spark table and returns what can be pickled. Spark deals out Arrow batches of its own
    choice, so a value must follow from its row alone: with ``verify``, every batch is computed again in two
    halves, and a difference ends the job with a message.
    """
    def made(df: DataFrame, params: Any) -> Column:
        def numbers(batch: pd.DataFrame) -> np.ndarray:
            out = np.asarray(transform(batch.reset_index(drop=True), params), dtype=float)
            if out.shape != (len(batch),):
                raise ValueError(f"feature {name!r} gave {out.shape} for {len(batch)} rows")
            return out

        def value(batch: pd.DataFrame) -> pd.Series:
            whole = numbers(batch)
            if verify and len(batch) > 1:
                half = len(batch) // 2
                pieces = np.concatenate([numbers(batch.iloc[:half]), numbers(batch.iloc[half:])])
                if not np.allclose(pieces, whole, rtol=0.0, atol=TOLERANCE, equal_nan=True):
                    raise ValueError(f"feature {name!r} depends on the other rows of its batch")
            return pd.Series(whole)

        return F.pandas_udf(value, "double")(F.struct(*[F.col(f"`{c}`") for c in inputs]))

    return UserFeature(name, fit, made, idea)


def check_output(made: DataFrame, column: str, n_rows: int) -> str:
    """Empty text when the feature is usable, else what is wrong with it."""
    if column not in made.columns or not is_correlatable(col_type(made, column)):
        return "not numeric"
    c = F.col(f"`{column}`").cast("double")
    finite = c.isNotNull() & ~F.isnan(c) & ~c.isin(float("inf"), float("-inf"))
    row = made.agg(F.count(F.lit(1)).alias("n"), F.count_if(finite).alias("ok")).first()
    if row.n != n_rows:
        return "wrong length"
    return "" if row.ok else "no finite value"


def row_dependence(feature: UserFeature, train: DataFrame, df: DataFrame, target: str, key: str) -> DataFrame:
    """One row ``(feature, n_rows, n_mismatch, row_independent)``: halves against the whole."""
    params = feature.fit(train)
    half = keyed_hash(0, key) % 2 == 0
    col = F.col(f"`{feature.column}`").cast("double")

    def values(t, name):
        return feature.apply(t, params, target).select(F.col(f"`{key}`"), col.alias(name))

    whole = values(df, "whole")
    pieces = values(df.where(half), "piece").unionByName(values(df.where(~half), "piece"))
    same = F.when(F.col("whole").isNull() | F.col("piece").isNull(), F.col("whole").isNull() & F.col("piece").isNull()) \
            .otherwise(F.abs(F.col("whole") - F.col("piece")) <= TOLERANCE)
    return whole.join(pieces, key, "full").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~same).alias("n_mismatch")).select(
        F.lit(feature.name).alias("feature"), "n_rows", "n_mismatch", (F.col("n_mismatch") == 0).alias("row_independent"))


def dry_run(feature: UserFeature, df: DataFrame, target: str, key: str) -> str:
    """Cheap checks on one 2-fold split before any model is fitted; empty text when all hold."""
    first = keyed_hash("dry", key) % 2 == 0
    train, held = df.where(first), df.where(~first)
    try:
        params = feature.fit(train)
        made = feature.apply(held, params, target)
        problem = check_output(made, feature.column, held.count())
    except (PySparkException, ArithmeticError, LookupError, TypeError, ValueError) as error:
        return f"error: {error}"
    if problem:
        return problem
    return "" if row_dependence(feature, train, held, target, key).first().row_independent else "row_context_dependent"


def target_encoding(name: str, category: str, target: str, weight: float = 20.0) -> UserFeature:
    """Mean target per category, shrunk to the overall mean; the fitted table is joined, never collected."""
    def fit(train):
        prior = train.agg(F.avg(F.col(f"`{target}`").cast("double"))).first()[0]
        sums = train.groupBy(F.col(f"`{category}`").alias(category)).agg(
            F.sum(F.col(f"`{target}`").cast("double")).alias("_s"), F.count(F.col(f"`{target}`")).alias("_n"))
        return prior, sums

    def transform(df, params):
        prior, sums = params
        prior = F.lit(prior)
        encoded = (F.coalesce(F.col("_s"), F.lit(0.0)) + prior * weight) / (F.coalesce(F.col("_n"), F.lit(0)) + weight)
        return df.join(sums, category, "left").withColumn(f"gen_{name}", encoded).drop("_s", "_n")

    return UserFeature(name, fit, transform)
