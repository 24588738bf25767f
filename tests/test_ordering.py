"""Order statistics, ranks and tiles against brute force, with heavy ties and hot groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ordering as O


def frame(spark, n=3000, hot=0.4):
    """Rows with many ties: a large share sits on one value and in one group."""
    rng = np.random.default_rng(1)
    t = np.where(rng.random(n) < hot, 7, rng.integers(-50, 400, n))
    g = np.where(rng.random(n) < hot, "hot", rng.choice(list("abcd"), n))
    return spark.createDataFrame([(int(i), int(a), str(b)) for i, (a, b) in enumerate(zip(t, g))], "id bigint, t bigint, g string")


def test_order_statistics_match_sorting(spark):
    df = frame(spark)
    got = O.order_statistics(df.select(F.col("g"), F.col("t").alias("v")), lambda g, n: range(0, n, 37))
    rows = df.collect()
    for g, (n, at) in got.items():
        want = sorted(r.t for r in rows if r.g == g)
        assert n == len(want)
        for rank, (value, below, ties) in at.items():
            assert value == want[rank]
            assert below == sum(v < value for v in want) and ties == want.count(value)


@pytest.mark.parametrize("spread", [1.0, 1e-9, 1e300])
def test_quantiles_of_doubles(spark, spread):
    rng = np.random.default_rng(2)
    x = rng.lognormal(0, 4, 2000) * spread
    x[:700] = x[0]
    df = spark.createDataFrame([("a", float(v)) for v in x], "g string, v double")
    got = O.exact_quantiles(df, [0, 0.1, 0.25, 0.5, 0.9, 1])["a"]
    assert np.allclose(got, np.quantile(x, [0, 0.1, 0.25, 0.5, 0.9, 1]), rtol=1e-12)


def test_extreme_integers(spark):
    big = 2 ** 62
    df = spark.createDataFrame([("a", v) for v in (-big, big, 0, 1, big - 1)], "g string, v bigint")
    got = O.order_statistics(df, lambda g, n: range(n))["a"][1]
    assert [got[i][0] for i in range(5)] == [-big, 0, 1, big - 1, big]


def test_no_values_no_answer(spark):
    assert O.order_statistics(spark.createDataFrame([], "g string, v double"), lambda g, n: [0]) == {}
    assert O.column_quantiles(spark.createDataFrame([(None,)], "x double"), ["x"], [0.5]) == {}


def test_too_many_groups_is_refused(spark):
    df = spark.range(O.MAX_GROUPS + 5).select(F.col("id").alias("g"), F.col("id").alias("v"))
    with pytest.raises(ValueError, match="groups"):
        O.order_statistics(df, lambda g, n: [0])


@pytest.mark.parametrize("key", ["id", "name"])
def test_tuple_cuts_split_ties_by_key(spark, key):
    df = frame(spark).withColumn("name", F.format_string("k%06d", (F.col("id") * 7919) % 3001))
    sizes = [1, 10, 700, 1500, 2999, 3000]
    (n, at), = O.tuple_cuts(df, F.col("t"), key, lambda g, n: sizes).values()
    assert n == 3000
    rows = sorted(df.collect(), key=lambda r: (r.t, r[key]))
    for size in sizes:
        head = df.where(O.within_cut(F.col("t"), F.col(key), at[size])).select("id").collect()
        assert {r.id for r in head} == {r.id for r in rows[:size]}


def test_global_rank_with_groups(spark):
    df = frame(spark)
    out = O.global_rank(df, ["g", "t", "id"], group=["g"]).collect()
    rows = sorted(df.collect(), key=lambda r: (r.g, r.t, r.id))
    place = {r.id: i + 1 for i, r in enumerate(rows)}
    assert all(r["rank"] == place[r.id] for r in out)
    first = {}
    for i, r in enumerate(rows):
        first.setdefault(r.g, i)
    assert all(r.group_rank == place[r.id] - first[r.g] for r in out)
    assert all(r.group_size == sum(x.g == r.g for x in rows) for r in out)


def test_a_hot_value_spreads_over_partitions(spark):
    """All rows share one time; the range shuffle must still use many partitions."""
    df = spark.range(20000).withColumn("t", F.lit(1))
    ranked = O.global_rank(df, ["t", "id"])
    assert ranked.agg(F.max("rank")).first()[0] == 20000
    assert ranked.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 8000


@pytest.mark.parametrize("limit", [1000, 2])
def test_tiles_equal_ntile_on_both_paths(spark, monkeypatch, limit):
    monkeypatch.setattr(O, "MAX_GROUPS", limit)
    df = frame(spark).union(spark.createDataFrame([(9001, 3, "tiny"), (9002, 1, "tiny")], "id bigint, t bigint, g string"))
    got = {r.id: r.tile for r in O.tiles(df, F.col("g"), F.col("t"), "id", 5).collect()}
    df.createOrReplaceTempView("tiled")
    want = {r.id: r.n for r in spark.sql("select id, ntile(5) over (partition by g order by t, id) as n from tiled").collect()}
    assert got == want


def test_running_counts(spark):
    df = frame(spark).groupBy("g", F.col("t").cast("double").alias("s")).agg(F.count("*").cast("double").alias("n"))
    out = O.running_counts(df, "s", ["n"], ["g"]).collect()
    rows = df.collect()
    for r in out:
        assert r.n_below == sum(x.n for x in rows if x.g == r.g and x.s < r.s)


def test_tile_ends():
    assert O.tile_ends(10, 4) == [3, 6, 8, 10]
    assert O.tile_ends(2, 4) == [1, 2, 2, 2]
    assert math.prod(O.tile_ends(8, 4)) == 2 * 4 * 6 * 8


@pytest.mark.parametrize("small", [O.SMALL_GROUP, 0])
def test_quantiles_of_any_number_of_groups(spark, small):
    """5,000 groups and one that holds most of the rows; with ``small`` 0 the sketches bracket that group."""
    hot = 60_000
    df = spark.range(hot + 12_000).select(F.when(F.col("id") < hot, -1).otherwise(F.col("id") % 5_000).alias("g"), F.when(F.col("id") % 97 > 0, (F.col("id") * 7919 % 10_007).cast("double")).alias("v"))
    if small == 0:
        df = df.where("g = -1")
    fractions = [0, 0.1, 0.5, 0.9, 1]
    got = {r.g: (r.n, r.quantiles) for r in O.group_quantiles(df, fractions, small=small).collect()}
    values = {}
    for r in df.where("v is not null").collect():
        values.setdefault(r.g, []).append(r.v)
    assert got.keys() == values.keys() and len(got) == (1 if small == 0 else 5_001)
    for g, v in values.items():
        v, (n, q) = sorted(v), got[g]
        want = [v[math.floor(f * (len(v) - 1))] + (v[math.ceil(f * (len(v) - 1))] - v[math.floor(f * (len(v) - 1))]) * (f * (len(v) - 1) % 1) for f in fractions]
        assert n == len(v) and q == pytest.approx(want)


def test_quantiles_of_groups_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", 1.0), (None, 3.0)], "g string, v double")
    assert [tuple(r) for r in O.group_quantiles(df, [0.5, 0.5]).collect()] == [("b", 2, [1.0, 1.0])]
    assert O.group_quantiles(df.where("false"), [0.5]).count() == 0


def test_quantiles_of_large_groups_move_no_rows(spark):
    df = spark.range(3_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 1_009).cast("double").alias("v"))
    plan = O._bracketed_quantiles(df, [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
    mixed = df.unionByName(spark.range(40).select((F.col("id") + 10).alias("g"), F.col("id").cast("double").alias("v")))
    got = {r.g: (r.n, r.quantiles) for r in O.group_quantiles(mixed, [0.0, 0.25], small=100).collect()}
    assert len(got) == 42 and got[10] == (1, [0.0, 0.0]) and got[0][0] == 1_500
    v = sorted(float(i * 7 % 1_009) for i in range(0, 3_000, 2))
    assert got[0][1] == pytest.approx([v[0], v[374] + (v[375] - v[374]) * 0.75])


def test_more_large_groups_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(O, "LARGE_GROUPS", 2)
    df = spark.range(1_000).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 4 + 1).alias("g"), F.col("id").cast("double").alias("v"))
    got = {r.g: (r.n, r.quantiles) for r in O.group_quantiles(df, [0.5], small=50).collect()}
    assert got == {0: (600, [299.5]), **{g: (100, [600 + 4 * 49.5 + g - 1]) for g in range(1, 5)}}
