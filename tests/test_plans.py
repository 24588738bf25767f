"""Cleaning, features, encodings and user features: fitted on training rows, replayed elsewhere."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import clean as C
from plumbline.operators import encode as E
from plumbline.operators import features as G
from plumbline.operators import userfeatures as U


def column(df, name, by="id"):
    return [r[name] for r in df.orderBy(by).collect()]


@pytest.fixture(scope="module")
def boats(spark):
    rows = [(1, 6.5, 4, "sloop", 0), (2, None, None, "ketch", 1), (3, 9.0, 7, None, 0), (4, 12.5, 2, "ketch", 1), (5, 8.0, None, "yawl", 1), (6, None, 9, "ketch", 0)]
    return spark.createDataFrame(rows, "id int, length double, crew int, rig string, sold int")


def test_imputations(boats):
    fit = C.fit_cleaning(boats, {"imputations": [{"column": "length", "strategy": "median"}, {"column": "rig", "strategy": "most_frequent"}]}, "sold")
    out = fit.transform(boats)
    assert column(out, "length") == [6.5, 8.5, 9.0, 12.5, 8.0, 8.5] and column(out, "rig") == ["sloop", "ketch", "ketch", "ketch", "yawl", "ketch"]


@pytest.mark.parametrize("strategy", ["median", "mean"])
def test_average_of_whole_numbers_keeps_its_fraction(boats, strategy):
    fit = C.fit_cleaning(boats, {"imputations": [{"column": "crew", "strategy": strategy}]}, "sold")
    assert column(fit.transform(boats), "crew") == [4.0, 5.5, 7.0, 2.0, 5.5, 9.0]


def test_constant_of_another_type_is_refused(boats):
    plan = {"imputations": [{"column": "crew", "strategy": "constant", "fill_value": "many"}, {"column": "length", "strategy": "constant", "fill_value": "7.5"}]}
    fit = C.fit_cleaning(boats, plan, "sold")
    assert column(fit.transform(boats), "length")[1] == 7.5 and column(fit.transform(boats), "crew")[1] is None
    assert [r[1:] for r in fit.log if r[2] == "skip"] == [("crew", "skip", "constant does not match the type")]


def test_training_statistic_is_used_on_held_out_rows(spark, boats):
    fit = C.fit_cleaning(boats, {"imputations": [{"column": "length", "strategy": "mean"}]}, "sold")
    held = spark.createDataFrame([(9, None, 1, "cat", 0), (10, 400.0, 1, "cat", 0)], boats.schema)
    assert column(fit.transform(held), "length") == [9.0, 400.0]


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert C.modes(df, ["c"]) == {"c": "a"}


def test_cleaning_is_total(boats):
    plan = {"columns_to_drop": ["sold", "keel", "rig", 5], "imputations": [{"column": "rig", "strategy": "mean"}, {"column": "sold", "strategy": "mean"},
            {"column": "length", "strategy": "guess"}, ["x"], "length", {"column": "id", "strategy": "constant", "fill_value": 0}]}
    fit = C.fit_cleaning(boats, plan, "sold")
    assert fit.drops == ["rig"] and list(fit.fills) == ["id"]
    assert [r[2] for r in fit.log].count("skip") == 8
    assert C.without_drop({"columns_to_drop": ["rig", {"column": "crew"}]}, "crew") == {"columns_to_drop": ["rig"]}
    with pytest.raises(ValueError):
        C.require_features(boats.select("sold"), "sold")


def test_per_fold_fill_never_sees_validation_rows(spark):
    rows = [(0, "train", 10.0), (0, "train", 20.0), (0, "validate", None), (0, "validate", 100.0),
            (1, "train", 100.0), (1, "train", None), (1, "validate", 10.0), (1, "validate", None)]
    long = spark.createDataFrame(rows, "fold bigint, role string, x double").withColumn("y", F.lit(1))
    for s, want in (("median", 15.0), ("mean", 15.0), ("most_frequent", 10.0)):
        out = C.clean_per_fold(long, {"imputations": [{"column": "x", "strategy": s}]}, "y")
        assert sorted(r.x for r in out.where("fold = 0 AND role = 'validate'").collect()) == [want, 100.0]
        assert sorted(r.x for r in out.where("fold = 1").collect()) == [10.0, 100.0, 100.0, 100.0]


def test_feature_operations(spark):
    df = spark.createDataFrame([(2.0, 7.0, "1999-07-31", 0), (5.0, 2.5, "2003-11-02", 1), (8.0, 0.0, "soon", 0), (6.0, 24.0, "2010-03-09", 1)], "w double, h double, built string, sold int")
    plan = {"features": [{"op": "difference", "left": "h", "right": "w"}, {"op": "ratio", "numerator": "w", "denominator": "h"},
                         {"op": "date_parts", "column": "built", "parts": ["month", "year"]}, {"op": "difference", "left": "h_minus_w", "right": "w"}, {"op": "bin", "column": "built"}]}
    fit = G.fit_features(df, plan, "sold")
    out = fit.transform(df)
    assert column(out, "h_minus_w", "w") == [5, -2.5, 18, -8] and column(out, "h_minus_w_minus_w", "w") == [3, -7.5, 12, -16]
    assert column(out, "w_per_h", "w") == [2 / 7, 2.0, 0.25, None]
    assert column(out, "built_year", "w") == [1999, 2003, 2010, None] and column(out, "built_month", "w")[0] == 7 and "built" not in out.columns
    assert fit.log[-1][2:] == ("skip", "not present: built")


def test_bin_edges_come_from_training_rows(spark):
    train = spark.createDataFrame([(float(v), 0) for v in (10, 14, 30, 31, 90, 95)], "a double, y int")
    held = spark.createDataFrame([(29.0, 0), (31.0, 0), (-50.0, 0), (990.0, 0), (None, 0)], "a double, y int")
    fit = G.fit_features(train, {"features": [{"op": "bin", "column": "a", "n_bins": 2}]}, "y")
    assert [r.a_bin for r in fit.transform(held).collect()] == [0, 1, 0, 1, None]
    flat = G.fit_features(train.withColumn("a", F.lit(1.0)), {"features": [{"op": "bin", "column": "a"}]}, "y")
    assert flat.operations == []


def test_derived_columns_are_checked_when_they_exist(spark):
    df = spark.createDataFrame([(1.0, 5.0), (7.0, 2.0)], "a double, b double").withColumn("y", F.lit(1))
    plan = {"features": [{"op": "difference", "left": "a", "right": "b"}, {"op": "log_transform", "column": "a_minus_b"}, {"op": "log_transform", "column": "a"}]}
    fit = G.fit_features(df, plan, "y")
    assert [r[2] for r in fit.log] == ["applied", "skip", "applied"]


def test_ordinals(spark):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(["calm", "storm", "fog", None, "gale", "breeze"])], "id int, wind string").withColumn("knots", F.lit(1))
    asked = [{"column": "wind", "order": ["calm", "breeze", "gale", "storm"]}, {"column": "knots", "order": ["1", "2"]}, {"column": "wind", "order": ["a", "a"]}, "wind"]
    fit = E.fit_ordinals(df, asked, "y")
    assert column(fit.transform(df), "wind") == [0.0, 3.0, None, None, 2.0, 1.0]
    assert fit.records == [("wind", 4, 0.8)] and sum(r[2] == "skip" for r in fit.log) == 3
    assert not E.fit_ordinals(df, [{"column": "wind", "order": ["u", "v"]}], "y").orders


def test_framing_checks(spark):
    df = spark.createDataFrame([(1.0, -1.0, float("inf"), None)], "a double, neg double, wide double, none double")
    ask = lambda c, **k: E.check_framing(df, c, **k).first()
    assert ask("a").eligible and ask("neg").reason == "negative values" and ask("wide").reason == "non-finite values" and ask("none").reason == "no values"
    assert not ask("a", transform="none").eligible and not ask("a", problem_type="binary").eligible and not ask("a", metric="mape").eligible
    t = E.TargetTransform()
    assert math.isclose(df.select(t.inverse(t.forward(F.col("a")))).first()[0], 1.0)


def test_user_features(spark):
    train = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 1), (3, 3.0, 0)], "id int, a double, y int")
    held = spark.createDataFrame([(4, 10.0, 1), (5, 20.0, 0)], train.schema)
    twice = U.UserFeature("twice", lambda t: 2.0, lambda df, p: F.col("a") * p)
    peek = U.UserFeature("peek", lambda t: None, lambda df, p: F.col("y") * 1.0)
    with pytest.warns(UserWarning, match="peek"):
        a, b = U.add_features(train, [held], "y", "id", [twice, peek])
    assert column(a, "gen_twice") == [2, 4, 6] and column(b, "gen_twice") == [20, 40] and "gen_peek" not in b.columns
    assert column(b, "y") == [1, 0]


def test_row_dependence_is_found(spark):
    df = spark.range(1, 41).select("id", F.col("id").cast("double").alias("a"), (F.col("id") % 2).alias("y"))
    share = U.UserFeature("share", lambda t: None, lambda d, p: F.col("a") / F.lit(d.agg(F.avg("a")).first()[0]))
    twice = U.UserFeature("twice", lambda t: None, lambda d, p: F.col("a") * 2)
    assert U.dry_run(share, df, "y", "id") == "row_context_dependent" and U.dry_run(twice, df, "y", "id") == ""
    text = U.UserFeature("text", lambda t: None, lambda d, p: F.lit("x"))
    broken = U.UserFeature("broken", lambda t: 1 / 0, lambda d, p: F.lit(1))
    assert U.dry_run(text, df, "y", "id") == "not numeric" and U.dry_run(broken, df, "y", "id").startswith("error")


def test_text_features(spark):
    from plumbline.functions import text as X
    df = spark.createDataFrame([("GOOD good! 3 days left, goodbye. ok?",), ("",), (None,)], "t string")
    s = X.style_features(F.col("t"), ["ok"])
    out = df.select(X.keyword_group(F.col("t"), ["good"]).alias("g"), X.number_after(F.col("t"), "days").alias("d"), X.truncate(F.col("t"), 4, "~").alias("c"), *[c.alias(n) for n, c in s.items()]).collect()
    assert (out[0].g, out[0].d, out[0].c, out[0].time_mentions) == (2, 3.0, "GOOD~", 1)
    assert out[1].g == 0 and out[1].upper_ratio is None and out[2].g is None


def test_user_features_keep_rows_with_repeated_and_missing_keys(spark):
    train = spark.createDataFrame([(1, 1.0, "u", 0), (1, 2.0, "v", 1), (None, 3.0, "u", 0)], "id int, a double, g string, y int")
    twice = U.UserFeature("twice", lambda t: 2.0, lambda df, p: F.col("a") * p)
    root = U.python_feature("root", ["a", "g"], lambda t: t.count(), lambda b, n: [n * x ** 0.5 if g == "u" else None for x, g in zip(b["a"], b["g"])])
    made, other = U.add_features(train, [train.drop("y")], "y", "id", [twice, U.target_encoding("g", "g", "y"), root])
    assert made.columns == ["id", "a", "g", "y", "gen_twice", "gen_g", "gen_root"] and other.columns == ["id", "a", "g", "gen_twice", "gen_g", "gen_root"]
    rows = {r.a: r for r in made.collect()}
    assert made.count() == 3 and (rows[2.0].y, rows[2.0].gen_twice, rows[2.0].gen_root) == (1, 4.0, None) and rows[1.0].gen_root == 3.0
    lossy = U.UserFeature("lossy", lambda t: None, lambda df, p: df.select("id", F.lit(1.0).alias("gen_lossy")))
    later = U.UserFeature("later", lambda t: None, lambda df, p: F.col("gen_twice") + 1)
    with pytest.warns(UserWarning) as said:
        assert U.add_features(train, [], "y", "id", [twice, lossy, later])[0].columns == ["id", "a", "g", "y", "gen_twice"]
    assert [str(w.message).split()[1] for w in said] == ["'lossy'", "'later'"]


def test_python_features_follow_from_their_row_alone(spark):
    df = spark.range(40).select("id", F.col("id").cast("double").alias("a"), (F.col("id") % 2).alias("y"))
    share = U.python_feature("share", ["a"], lambda t: None, lambda b, p: b["a"] - b["a"].mean())
    with pytest.raises(Exception, match="other rows of its batch"):
        U.add_features(df, [], "y", "id", [share])[0].collect()
    assert U.dry_run(share, df, "y", "id") != ""
    assert U.dry_run(U.python_feature("half", ["a"], lambda t: 2.0, lambda b, p: b["a"] / p), df, "y", "id") == ""
