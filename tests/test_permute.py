"""Rank maps are bijections, permuted columns keep their values, and drivers lose score."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators.permute import permuted, rank_map, ranked, versions
from plumbline.plans import model as L
from plumbline.plans.drivers import fitted_drivers


@pytest.mark.parametrize("n", [1, 2, 3, 12, 1000, 30030])
def test_rank_maps_are_bijections(n):
    for seed in range(5):
        m = rank_map(n, seed, "x")
        assert sorted((m.a * r + m.b) % n for r in range(n)) == list(range(n))
    assert n < 3 or len({(rank_map(n, s, c).a % n, rank_map(n, s, c).b) for s in range(5) for c in "xy"}) > 1


def test_values_are_kept_and_move(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("rank"), F.when(F.col("id") % 3 > 0, "t").alias("t"))
    before = df.toDF("id", "rank_before", "t_before")
    rows, n = ranked(df, "id")
    out = permuted(rows, n, "rank", 1)
    assert n == 500 and out.count() == 500
    assert sorted(r["rank"] for r in out.collect()) == sorted(r["rank"] for r in df.collect())
    assert out.join(before, "id").where("rank = rank_before").count() < 150
    wide = versions(rows, n, ["rank", "t"], ["id"])
    for column, other in (("rank", "t"), ("t", "rank")):
        one = wide.where(F.col("version") == column)
        assert one.join(before, "id").where(f"{other} <=> {other}_before").count() == 500
        assert sorted(repr(r[column]) for r in one.collect()) == sorted(repr(r[column]) for r in df.collect())
    same = wide.where("version is null")
    assert same.select("id", "rank", "t").exceptAll(df).count() == 0


def test_drivers_of_a_fitted_model(spark):
    df = spark.range(800).select("id", (F.col("id") * 37 % 101).cast("double").alias("x"), F.rand(3).alias("noise"), ((F.col("id") * 37 % 101) > 50).cast("int").alias("y"))
    fitted = L.fit(df, "y", L.tree(), classes=[0, 1], key="id")
    out = {r.column: r for r in fitted_drivers(fitted, df, "id").collect()}
    assert out["x"].base > 0.98 and out["x"].importance > 0.3 and abs(out["noise"].importance) < 0.02
    assert fitted_drivers(fitted, df.where("false"), "id").count() == 0


@pytest.mark.parametrize("n", [1, 2, 97, 30030, 10**10 + 19])
def test_inverse_rank_maps(spark, n):
    m = rank_map(n, 3, "x")
    df = spark.createDataFrame([(r,) for r in {0, n // 2, n - 1}], "r long")
    assert df.where(m.inverse()(m(F.col("r"))) != F.col("r")).count() == 0


def test_permuted_ranks_and_values_only_move(spark):
    rows, n = ranked(spark.range(60).select("id", (F.col("id") * 3).alias("v")), "id")
    m, own = rank_map(n, 5, "v"), {r._rank: r.v for r in rows.collect()}
    out = permuted(rows.repartition(3, "_rank"), n, "v", 5)
    assert {r._rank: r.v for r in out.collect()} == {r: own[(m.a * r + m.b) % n] for r in range(n)}
