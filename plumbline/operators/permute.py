"""Permutations as keyed maps of ranks: rows are ranked once, then every permutation is a hash join or a projection.

Ranks follow a hash of the key, so they say nothing about the rows. A permutation sends rank r to ``(a * r + b) mod n`` with a
and n coprime: a bijection in built-in arithmetic, different for every seed, with neither a sort nor a copy of the table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import keyed_hash
from plumbline.operators.ordering import global_rank

LEAST_STEP, STEPS = 1_000, 500_000      # fixed values: a * r stays below 2^63 for over 10^13 rows


@dataclass(frozen=True)
class RankMap:
    n: int
    a: int
    b: int

    def __call__(self, rank: Column) -> Column:
        kind = "bigint" if self.a * self.n + self.b < 1 << 63 else "decimal(18,0)"     # products of up to 36 digits stay exact
        return ((rank.cast(kind) * F.lit(self.a).cast(kind) + F.lit(self.b).cast(kind)) % F.lit(self.n).cast(kind)).cast("bigint")

    def inverse(self) -> RankMap:
        a = pow(self.a, -1, self.n)
        return RankMap(self.n, a, -a * self.b % self.n)


def _draw(*parts) -> int:
    """The number that ``keyed_hash`` gives."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def rank_map(n: int, seed: int | str, name: str = "") -> RankMap:
    """The bijection of 0 to n - 1 for a seed and a name."""
    n = max(n, 1)
    a = LEAST_STEP + _draw(seed, name, "a") % STEPS
    while math.gcd(a, n) > 1:
        a += 1
    return RankMap(n, a, _draw(seed, name, "b") % n)


def ranked(df: DataFrame, key: str, seed: int | str = 0) -> tuple[DataFrame, int]:
    """The rows with ``_rank`` from 0 in the order of their key's hash, written once, and how many they are."""
    out = global_rank(df.withColumn("_order", keyed_hash(seed, key)), ["_order", key], name="_rank").drop("_order").withColumn("_rank", F.col("_rank") - 1)
    return out, int(out.agg(F.coalesce(F.max("_rank") + 1, F.lit(0))).first()[0])


def permuted(rows: DataFrame, n: int, column: str, seed: int | str) -> DataFrame:
    """Ranked rows with the values of ``column`` permuted among all of them; their own ``_rank`` stays.

    Only ranks and values move: each value goes to the rank that takes it, so rows that are partitioned by ``_rank`` stay in place.
    """
    values = rows.select(rank_map(n, seed, column).inverse()(F.col("_rank")).alias("_to"), F.col(f"`{column}`"))
    return rows.drop(column).join(values, F.col("_rank") == F.col("_to")).drop("_to")


def versions(rows: DataFrame, n: int, columns: Sequence[str], keep: Sequence[str], seed: int | str = 0) -> DataFrame:
    """Every row once as it is (``version`` null) and once for each of ``columns`` with that column's value permuted.

    One shuffle for all columns: each value is sent to the rank that its column's map names, and meets the row of that rank there.
    """
    kinds = dict(rows.select(*columns, *keep).dtypes)
    names = {c: f"_v{i}" for i, c in enumerate([*columns, *keep])}

    def sent(to: Column, which: int, given: Sequence[str]) -> Column:
        return F.struct(to.alias("_to"), F.lit(which).alias("_which"), *[(F.col(f"`{c}`") if c in given else F.lit(None).cast(kinds[c])).alias(v) for c, v in names.items()])

    out = rows.select(F.inline(F.array(sent(F.col("_rank"), -1, list(names)), *[sent(rank_map(n, seed, c)(F.col("_rank")), i, [c]) for i, c in enumerate(columns)])))
    own = [F.any_value(F.when(F.col("_which") == -1, F.col(v)), True).alias(v) for v in names.values()]
    moved = [F.any_value(F.when(F.col("_which") == i, F.col(names[c])), True).alias(f"_m{i}") for i, c in enumerate(columns)]
    met = out.groupBy("_to").agg(*own, *moved)
    rest = [F.col(names[c]).alias(c) for c in keep]
    each = [F.struct(F.lit(which).alias("version"), *rest, *[F.col(f"_m{i}" if c == which else names[c]).alias(c) for i, c in enumerate(columns)]) for which in [None, *columns]]
    return met.select(F.inline(F.array(*each)))
