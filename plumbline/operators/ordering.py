"""Exact order statistics, ranks and cut points without ever sorting a table in one task.

Two tools cover every place where a single machine would index rows by position:

* ``order_statistics`` finds values at given ranks by narrowing histograms. Each pass is one scan
  with a map-side partial count; rows are never shuffled. The driver sees at most
  ``MAX_CELLS`` histogram cells per pass.
* ``global_rank`` numbers every row. Rows are range-partitioned on the full sort key (a unique key
  last), so equal leading values still spread over many tasks, and each partition's offset comes
  from a table with one row per partition.
* ``group_quantiles`` gives exact quantiles of any number of groups; brackets and ranks stay tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import INTEGRAL, any_of, col_type, is_number, ordinal_time
from plumbline.session import kept, stable

MAX_GROUPS = 1_000      # groups whose cut points may live on the driver
MAX_CELLS = 200_000     # histogram cells one pass may return
_LOW_BITS = (1 << 33) - 1


def order_statistics(values: DataFrame, ranks_of: Callable[[Any, int], Sequence[int]]) -> dict:
    """Exact values at given 0-based ranks of column ``v`` within each group ``g``.

    ``ranks_of(group, n)`` names the ranks wanted for a group of ``n`` non-null values. Returns
    ``{group: (n, {rank: (value, below, ties)})}`` with ``below`` values smaller than the answer
    and ``ties`` equal to it.
    """
    spark = values.sparkSession
    values = values.where("v IS NOT NULL AND g IS NOT NULL")
    bounds = (values.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
              .limit(MAX_GROUPS + 1).collect())
    if len(bounds) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups: rank the rows instead")
    result: dict = {}
    pending = []
    for b in bounds:
        wanted = sorted({r for r in ranks_of(b.g, b.n) if 0 <= r < b.n})
        result[b.g] = (b.n, {})
        if not wanted:
            continue
        if b.lo == b.hi:
            result[b.g][1].update({r: (b.lo, 0, b.n) for r in wanted})
        else:
            pending.append((b.g, b.lo, b.hi, 0, wanted))
    g_type, v_type = values.schema["g"].dataType, values.schema["v"].dataType
    schema = T.StructType([T.StructField("bid", T.IntegerType()), T.StructField("bg", g_type),
                           T.StructField("lo", v_type), T.StructField("hi", v_type)])
    while pending:
        cells = max(16, min(4096, MAX_CELLS // len(pending)))
        table = spark.createDataFrame([(i, p[0], p[1], p[2]) for i, p in enumerate(pending)], schema)
        inside = (F.col("g") == F.col("bg")) & F.col("v").between(F.col("lo"), F.col("hi"))
        # halving first keeps the difference of two extreme values inside the double range
        share = ((F.col("v").cast("double") / 2 - F.col("lo").cast("double") / 2)
                 / (F.col("hi").cast("double") / 2 - F.col("lo").cast("double") / 2))
        if isinstance(v_type, INTEGRAL) and all(p[2] - p[1] < 1 << 62 for p in pending):
            share = (F.col("v") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")).cast("double")
        cell = F.least(F.floor(share * cells), F.lit(cells - 1))
        # at most MAX_GROUPS x ranks rows, so the bracket table is safe to broadcast
        hist = (values.join(F.broadcast(table), inside)
                .groupBy("bid", cell.alias("cell"))
                .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                .collect())
        by_bracket: dict[int, list] = {}
        for h in hist:
            by_bracket.setdefault(h.bid, []).append(h)
        narrowed = []
        for i, (g, _, _, below, wanted) in enumerate(pending):
            seen, rest = below, list(wanted)
            for h in sorted(by_bracket.get(i, []), key=lambda h: h.cell):
                here = [r for r in rest if r < seen + h.n]
                rest = rest[len(here):]
                if here and h.lo == h.hi:
                    result[g][1].update({r: (h.lo, seen, h.n) for r in here})
                elif here:
                    narrowed.append((g, h.lo, h.hi, seen, here))
                seen += h.n
                if not rest:
                    break
        pending = narrowed
    return result


def exact_quantiles(values: DataFrame, fractions: Sequence[float]) -> dict:
    """Linear-interpolated quantiles of ``v`` per group ``g``: ``{group: [value, ...]}``."""
    def ranks(_, n):
        spots = [f * (n - 1) for f in fractions]
        return [r for s in spots for r in (math.floor(s), math.ceil(s))]

    out = {}
    for g, (n, found) in order_statistics(values, ranks).items():
        row = []
        for f in fractions:
            spot = f * (n - 1)
            lo, hi = float(found[math.floor(spot)][0]), float(found[math.ceil(spot)][0])
            row.append(lo + (hi - lo) * (spot - math.floor(spot)))
        out[g] = row
    return out


SKETCH = 10_000         # accuracy of the sketches that bracket quantiles: ranks are off by at most n / SKETCH
SMALL_GROUP = 20_000    # values up to which a group is ordered by itself; three rank errors are over a row beyond
LARGE_GROUPS = 100_000  # groups beyond that whose brackets are sent to the rows; with more of them, larger ones count as small
GROUP_CELLS = 256       # cells that a bracket is cut into


def group_quantiles(values: DataFrame, fractions: Sequence[float], *, small: int = SMALL_GROUP) -> DataFrame:
    """``(g, n, quantiles)``: exact linear-interpolated quantiles of ``v`` for any number of groups ``g``.

    Everything stays a relation. Groups of at most ``small`` values are ordered by themselves, in one shuffle of all their rows.
    Larger ones are few (there are at most as many as ``small`` fits into all rows), so their rows never move: a mergeable sketch per
    group brackets every quantile; one pass counts the values below each bracket and in its cells; the next counts the distinct values of
    the cells that hold the ranks. Their brackets are sent to the rows, for at most ``LARGE_GROUPS`` groups. Null groups and values take no part.
    """
    rows = values.where("v is not null and g is not null").select("g", F.col("v").cast("double").alias("v"))
    large = stable(rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > small))
    found = large.agg(F.count("*").alias("groups"), F.sum("n").alias("rows")).first()
    if not found.groups:
        return _ordered_quantiles(rows, fractions)
    if found.groups > LARGE_GROUPS:
        large = large.where(F.col("n") > found.rows // LARGE_GROUPS)
    sent = F.broadcast(large.select("g"))
    return _ordered_quantiles(rows.join(sent, "g", "left_anti"), fractions).unionByName(_bracketed_quantiles(rows.join(sent, "g"), fractions))


def _ordered_quantiles(rows: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """The quantiles of groups that a task may order whole; it spills what it orders."""
    group = Window.partitionBy("g")
    placed = rows.withColumns({"n": F.count("*").over(group), "r": F.row_number().over(group.orderBy("v")) - 1})

    def value(f: float) -> Column:
        spot = (F.col("n") - 1) * F.lit(float(f))
        a, b = (F.any_value(F.when(F.col("r") == end(spot), F.col("v")), True) for end in (F.floor, F.ceil))
        part = F.any_value(spot - F.floor(spot))
        return a + (b - a) * part

    return placed.groupBy("g", "n").agg(F.array(*[value(f) for f in fractions]).alias("quantiles"))


def _bracketed_quantiles(rows: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """The quantiles of few groups of any size; no row of them is shuffled."""
    margin = 3 / SKETCH
    points = sorted({min(1.0, max(0.0, f + side * margin)) for f in fractions for side in (-1, 1)})
    facts = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", points, SKETCH).alias("at"))

    def edge(f: float, side: int) -> Column:
        p = min(1.0, max(0.0, f + side * margin))
        return F.col("least" if side < 0 else "most") if p in (0.0, 1.0) else F.col("at")[points.index(p)]

    def wanted(i: int, f: float) -> Column:
        spot = (F.col("n") - 1) * F.lit(float(f))
        return F.struct(F.lit(i).alias("i"), edge(f, -1).alias("lo"), edge(f, 1).alias("hi"), spot.alias("spot"))

    brackets = stable(facts.select("g", "n", F.inline(F.array(*[wanted(i, f) for i, f in enumerate(fractions)]))))
    # cells of one value where a bracket is a single value; halving keeps the difference of extreme values finite
    share = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
    cell = F.when(F.col("v") < F.col("lo"), -1).otherwise(F.coalesce(F.least(F.floor(share * GROUP_CELLS), F.lit(GROUP_CELLS - 1)), F.lit(0)))
    inside = rows.join(F.broadcast(brackets.select("g", "i", "lo", "hi")), "g").where("v <= hi")
    cells = inside.groupBy("g", "i", cell.alias("cell")).agg(F.count("*").alias("held"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("g", "i").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = F.array_distinct(F.array(F.floor("spot"), F.ceil("spot")))
    spots = brackets.select("g", "i", F.explode(ranks).alias("r"))
    found = stable(cells.withColumn("before", before).join(spots, ["g", "i"]).where("r >= before and r < before + held").select("g", "i", "r", "before", "lo", "hi"))
    single = found.where("lo = hi").select("g", "i", "r", F.col("lo").alias("v"))
    within = rows.join(F.broadcast(found.where("lo < hi")), "g").where("v between lo and hi").groupBy("g", "i", "r", "before", "v").agg(F.count("*").alias("held"))
    upto = F.sum("held").over(Window.partitionBy("g", "i", "r").orderBy("v")) + F.col("before")
    exact = single.unionByName(within.withColumn("upto", upto).where("r < upto and r >= upto - held").select("g", "i", "r", "v"))
    ends = exact.groupBy("g", "i").agg(F.min("v").alias("a"), F.max("v").alias("b")).join(brackets.select("g", "n", "i", "spot"), ["g", "i"])
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("spot") - F.floor("spot"))
    listed = ends.groupBy("g", "n").agg(F.sort_array(F.collect_list(F.struct("i", value.alias("value")))).alias("q"))
    return listed.select("g", "n", F.transform("q", lambda x: x["value"]).alias("quantiles"))


def column_quantiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float]) -> dict[str, list]:
    """Exact quantiles of several numeric columns in shared passes; a column without values is left out."""
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("g"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    return exact_quantiles(df.select(F.inline(pairs)), fractions)


def _group_col(group: Column | str | None) -> Column:
    if group is None:
        return F.lit("all")
    return F.col(f"`{group}`") if isinstance(group, str) else group


def tuple_cuts(df: DataFrame, time: Column, key: str, sizes: Callable[[Any, int], Sequence[int]],
               group: Column | str | None = None) -> dict:
    """Sort-key values that cut each group after given numbers of rows.

    Rows order by ``(time, key)``, ``key`` unique, ``time`` numeric and non-null. Returns
    ``{group: (n, {size: (time, key)})}``; ``key`` is None when every row at that time belongs to
    the head. Compare with :func:`within_cut`.
    """
    # the sort key may be a hash of the row: several passes read it, so it is computed once
    with kept(df.select(_group_col(group).alias("g"), time.alias("v"), F.col(f"`{key}`").alias("k"))) as base:
        return _tuple_cuts(df, base, key, sizes)


def _tuple_cuts(df: DataFrame, base: DataFrame, key: str, sizes: Callable[[Any, int], Sequence[int]]) -> dict:
    found = order_statistics(base.select("g", "v"), lambda g, n: [s - 1 for s in sizes(g, n) if s > 0])
    cuts: dict = {g: (n, {}) for g, (n, _) in found.items()}
    ties = []
    for g, (_, at) in found.items():
        for rank, (value, below, equal) in at.items():
            if rank + 1 == below + equal:
                cuts[g][1][rank + 1] = (value, None)
            else:
                ties.append((len(ties), g, value, rank - below, rank + 1))
    if ties:
        spark = df.sparkSession
        schema = T.StructType([T.StructField("cid", T.IntegerType()),
                               T.StructField("tg", base.schema["g"].dataType),
                               T.StructField("tv", base.schema["v"].dataType)])
        table = spark.createDataFrame([t[:3] for t in ties], schema)
        tied = base.join(F.broadcast(table), (F.col("g") == F.col("tg")) & (F.col("v") == F.col("tv")))
        if is_number(col_type(df, key)):
            keys = order_statistics(tied.select(F.col("cid").alias("g"), F.col("k").alias("v")),
                                    lambda c, n: [ties[c][3]])
            answer = {c: at[ties[c][3]][0] for c, (_, at) in keys.items()}
        else:
            ranked = global_rank(tied.select("cid", "k"), ["cid", "k"], group=["cid"])
            wanted = any_of([(F.col("cid") == t[0]) & (F.col("group_rank") == t[3] + 1) for t in ties])
            answer = {r.cid: r.k for r in ranked.where(wanted).collect()}
        for cid, g, value, _, size in ties:
            cuts[g][1][size] = (value, answer[cid])
    return cuts


def within_cut(time: Column, key: Column, cut: tuple | None) -> Column:
    """True for rows at or before the cut (no cut: none)."""
    if cut is None:
        return F.lit(False)
    value, last = cut
    if last is None:
        return time <= F.lit(value)
    return (time < F.lit(value)) | ((time == F.lit(value)) & (key <= F.lit(last)))


def global_rank(df: DataFrame, order: Sequence[Column | str], *, group: Sequence[str] = (),
                name: str = "rank") -> DataFrame:
    """Add the 1-based position of every row in the order given (end it with a unique key).

    One range shuffle; equal leading values spread over partitions because the key is part of the
    range. With ``group`` (columns that lead the order) also adds ``group_rank`` and ``group_size``.
    Select only the columns you need first: the sorted rows are written once.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [c if isinstance(c, Column) else F.col(f"`{c}`").asc_nulls_last() for c in order]
    placed = stable(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                    .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    # one row per partition, so this window is as small as the partition count
    offsets = (placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(
                   Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")))
    ranked = (placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
              .withColumn(name, F.col("_at").bitwiseAND(F.lit(_LOW_BITS)) + F.col("_before") + 1)
              .drop("_part", "_before", "_at"))
    if not group:
        return ranked
    spans = ranked.groupBy(*[F.col(f"`{g}`").alias(f"_span_{i}") for i, g in enumerate(group)]).agg(F.min(name).alias("_first"), F.count("*").alias("group_size"))
    same = reduce(lambda a, b: a & b, [F.col(f"`{g}`").eqNullSafe(F.col(f"_span_{i}")) for i, g in enumerate(group)])
    # no hint: the adaptive planner broadcasts the spans when small and splits hot groups when not
    return (ranked.join(spans, same).withColumn("group_rank", F.col(name) - F.col("_first") + 1)
            .drop("_first", *[f"_span_{i}" for i in range(len(group))]))


def tile_ends(n: int, k: int) -> list[int]:
    """Cumulative sizes of ``k`` contiguous tiles of ``n`` rows, the larger tiles first."""
    return [i * (n // k) + min(i, n % k) for i in range(1, k + 1)]


def tiles(df: DataFrame, group: Column | None, time: Column, key: str, k: int, name: str = "tile") -> DataFrame:
    """Cut every group into ``k`` contiguous tiles by ``(time, key)`` and add the tile number 1..k.

    Few groups: cut points are found by histograms and compared in a projection, no row moves. Many
    groups: rows are ranked once by ``(group, time, key)``. Rows with a null group or time are left out.
    """
    work = df.withColumn("_g", _group_col(group)).withColumn("_t", time).where("_g IS NOT NULL AND _t IS NOT NULL")
    few = work.select("_g").distinct().limit(MAX_GROUPS + 1).count() <= MAX_GROUPS
    if few:
        cuts = tuple_cuts(work, F.col("_t"), key, lambda g, n: tile_ends(n, k)[:-1], F.col("_g"))
        limits = [(g, i, *at[size]) for g, (n, at) in cuts.items()
                  for i, size in enumerate(tile_ends(n, k)[:-1]) if size in at]
        schema = T.StructType([T.StructField("_g", work.schema["_g"].dataType), T.StructField("i", T.IntegerType()),
                               T.StructField("t", work.schema["_t"].dataType),
                               T.StructField("k", work.schema[key].dataType)])
        spark = df.sparkSession
        table = (spark.createDataFrame(limits, schema).groupBy("_g")
                 .agg(F.collect_list(F.struct("t", "k")).alias("_cuts")))  # <= k entries per group
        here, kk = F.col("_t"), F.col(f"`{key}`")
        past = F.filter("_cuts", lambda c: (here > c["t"]) | ((here == c["t"]) & c["k"].isNotNull() & (kk > c["k"])))
        return (work.join(F.broadcast(table), "_g", "left")
                .withColumn(name, F.when(F.col("_cuts").isNull(), 1).otherwise(F.size(past) + 1).cast("bigint"))
                .drop("_g", "_t", "_cuts"))
    ranked = global_rank(work, ["_g", "_t", key], group=["_g"])
    small = F.floor(F.col("group_size") / k)
    extra = F.col("group_size") % k
    r = F.col("group_rank") - 1
    wide = extra * (small + 1)
    tile = F.when(r < wide, F.floor(r / (small + 1))).otherwise(extra + F.floor(F.try_divide(r - wide, small)))
    return ranked.withColumn(name, (tile + 1).cast("bigint")).drop("_g", "_t", "rank", "group_rank", "group_size")


def heads(df: DataFrame, group: Column | None, time: Column, key: str, fraction: float, name: str = "in_head") -> DataFrame:
    """Mark the first round(n x fraction) rows of every group by ``(time, key)``.

    As :func:`tiles`: cut points and a projection for few groups, one ranking for many.
    """
    work = df.withColumn("_g", _group_col(group)).withColumn("_t", time).where("_g IS NOT NULL AND _t IS NOT NULL")
    if work.select("_g").distinct().limit(MAX_GROUPS + 1).count() > MAX_GROUPS:
        ranked = global_rank(work, ["_g", "_t", key], group=["_g"])
        return (ranked.withColumn(name, F.col("group_rank") <= F.floor(F.col("group_size") * fraction + 0.5))
                .drop("_g", "_t", "rank", "group_rank", "group_size"))
    cuts = tuple_cuts(work, F.col("_t"), key, lambda g, n: [int(n * fraction + 0.5)], F.col("_g"))
    schema = T.StructType([T.StructField("_g", work.schema["_g"].dataType), T.StructField("_ct", work.schema["_t"].dataType),
                           T.StructField("_ck", work.schema[key].dataType)])
    # one row per group, at most MAX_GROUPS
    table = df.sparkSession.createDataFrame([(g, *cut) for g, (_, at) in cuts.items() for cut in at.values()], schema)
    t, k = F.col("_t"), F.col(f"`{key}`")
    inside = (t < F.col("_ct")) | ((t == F.col("_ct")) & (F.col("_ck").isNull() | (k <= F.col("_ck"))))
    return work.join(F.broadcast(table), "_g", "left").withColumn(name, F.coalesce(inside, F.lit(False))).drop("_g", "_t", "_ct", "_ck")


def running_counts(scores: DataFrame, order: str, sums: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Add ``<sum>_below``: the total of each column over rows with a smaller ``order`` in the group.

    ``scores`` is pre-aggregated: one row per (group, order value). Rows are bucketed by quantiles of
    the order column, totals are prefixed over buckets, and each bucket is scanned on its own.
    """
    from pyspark.ml.feature import Bucketizer

    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = scores.approxQuantile(order, [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    splits = [-math.inf, *sorted(set(marks)), math.inf]
    placed = Bucketizer(splits=splits, inputCol=order, outputCol="_b").transform(scores)
    totals = placed.groupBy(*group, "_b").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    w_total = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_b", *[F.coalesce(F.sum(f"_{s}").over(w_total), F.lit(0)).alias(f"_{s}") for s in sums])
    w_in = Window.partitionBy(*group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(totals, [*group, "_b"])
    return joined.withColumns({f"{s}_below": F.col(f"_{s}") + F.coalesce(F.sum(s).over(w_in), F.lit(0)) for s in sums}) \
                 .drop("_b", *[f"_{s}" for s in sums])
