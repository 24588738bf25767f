"""Linear folds from sufficient statistics against Spark ML and against plain least squares."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from plumbline.functions.columns import keyed_hash
from plumbline.plans import gram as M

rnd = random.Random(3)


def rows(n=400, offset=0.0):
    out = []
    for i in range(n):
        a, b, g = rnd.gauss(0, 1), rnd.gauss(0, 3), rnd.choice(["u", "v", "w", None])
        y = 2 * a - b + {"u": 5, "v": 0, "w": -5, None: 1}[g] + rnd.gauss(0, 0.1)
        out.append((i, offset + a, b if i % 7 else None, g, 4.0, None, y if i % 50 else None))
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), "id long, a double, b double, g string, same double, none double, y double").repartition(4)


def test_folds_are_those_of_spark_ml(spark, df):
    cv = M.cv_gram(df, "y", "id", ["a", "b"], k=4, seeds=[7])
    full = df.where("y is not null").withColumn("own", keyed_hash(7, "id") % 4)
    for f in cv.fits:
        train = full.where(F.col("own") != f.fold)
        mean = train.agg(F.avg("b")).first()[0]
        vector = VectorAssembler(inputCols=["a", "b"], outputCol="v")
        model = LinearRegression(featuresCol="v", labelCol="y", solver="normal").fit(vector.transform(train.na.fill(mean, ["b"])))
        assert f.coefficients == pytest.approx(model.coefficients.toArray(), rel=1e-8)
        held = model.transform(vector.transform(full.where(F.col("own") == f.fold).na.fill(mean, ["b"])))
        assert f.rmse == pytest.approx(held.agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0], rel=1e-8)
    oof = cv.oof(["id"], 7)
    assert oof.count() == full.count() and oof.agg(F.sqrt(F.avg((F.col("label") - F.col("pred")) ** 2))).first()[0] == pytest.approx((sum(f.n_validate * f.rmse ** 2 for f in cv.fits) / full.count()) ** 0.5)


def test_text_becomes_indicators_and_dead_columns_get_no_weight(df):
    cv = M.cv_gram(df, "y", "id", ["a", "b", "g", "same", "none"], k=3)
    assert set(cv.columns) == {"a", "b", "same", "none", "g=<missing>", "g=u", "g=v", "g=w"}
    names = list(cv.columns)
    assert all(names[i] not in ("same", "none") for f in cv.fits for i in f.used)
    assert all(f.r2 > 0.8 for f in cv.fits) and all(f.r2 < 0.8 for f in M.cv_gram(df, "y", "id", ["a", "b"], k=3).fits)


def test_far_from_zero_nothing_cancels(spark):
    far = spark.createDataFrame(rows(offset=1e8), "id long, a double, b double, g string, same double, none double, y double")
    near = far.withColumn("a", F.col("a") - 1e8)
    a, b = ([f.rmse for f in M.cv_gram(x, "y", "id", ["a", "b"], k=3).fits] for x in (far, near))
    assert a == pytest.approx(b, rel=1e-6)


def test_group_and_time_cells(df):
    grouped = M.cv_gram(df.withColumn("e", F.col("id") % 23), "y", "id", ["a"], k=3, plan={"strategy": "group", "group_column": "e"})
    assert sum(f.n_validate for f in grouped.fits) == df.where("y is not null").count()
    timed = M.cv_gram(df, "y", "id", ["a"], k=3, plan={"strategy": "time", "time_column": "id"})
    assert [(f.n_train + f.n_validate) for f in timed.fits] == sorted(f.n_train + f.n_validate for f in timed.fits) and len(timed.fits) == 3
    with pytest.raises(ValueError, match="strategy"):
        M.cv_gram(df, "y", "id", ["a"], plan={"strategy": "moon"})


def test_verdicts(df):
    out = {r.column: r.verdict for r in M.ablate_gram(df.withColumn("noise", F.rand(1)), "y", "id", ["a", "b", "noise"], k=4, seeds=3).collect()}
    assert out == {"a": "improved", "b": "improved", "noise": "no_improvement"}


def test_empty_and_refused(spark, df):
    assert M.cv_gram(df.where("false"), "y", "id", ["a"]).fits == []
    with pytest.raises(ValueError, match="no linear feature"):
        M.cv_gram(df.withColumn("l", F.array("a")), "y", "id", ["l"])
    with pytest.raises(ValueError, match="classes"):
        M.design(spark.range(100).withColumn("t", F.col("id").cast("string")), ["t"])
