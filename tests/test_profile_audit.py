from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import profile as P
from plumbline.operators.verify import check_folds, shift_band, verified_folds
from plumbline.plans import audit as A
from plumbline.sources import load as L


def rows(df, key="name"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_profile_counts(spark):
    df = spark.createDataFrame([(1, "A", 0), (2, "B", 1), (3, None, 0), (4, "A", 1)], "id bigint, city string, target int")
    p = rows(P.profile(df, "target"))
    assert (p["city"]["n_missing"], p["city"]["missing_frac"], p["city"]["n_unique"]) == (1, 0.25, 2)
    assert p["target"]["is_target"] and p["id"]["id_like"] and p["id"]["n_rows"] == 4


@pytest.mark.parametrize("mode", ["exact", "approx", "screened"])
def test_id_like_never_flags_measurements(spark, mode):
    df = spark.range(400).select("id", F.concat(F.lit("c"), "id").alias("code"), (F.col("id") * 1.5).alias("measure"), (F.col("id") % 4).alias("cat"), F.lit(1).alias("target"))
    p = rows(P.profile(df, "target", distinct=mode))
    assert [c for c in p if p[c]["id_like"]] == (["id", "code"] if mode != "approx" else [c for c in ("id", "code") if p[c]["id_like"]])
    assert not p["measure"]["id_like"] and not p["cat"]["id_like"]


def test_empty_table_has_zero_fractions(spark):
    p = rows(P.profile(spark.createDataFrame([], "a int, b string"), "a"))
    assert p["b"]["missing_frac"] == 0.0 and p["b"]["unique_frac"] == 0.0 and not p["b"]["id_like"]


def test_examples_cut_and_skip_nulls(spark):
    df = spark.createDataFrame([(1, "x" * 100), (2, None)], "k int, x string")
    shown = rows(P.examples(df, "k", ["x"]))["x"]["examples"]
    assert len(shown) == 1 and len(shown[0]) == 40 and shown[0].endswith("...")


def test_examples_look_past_the_head(spark, monkeypatch):
    monkeypatch.setattr(P, "_HEAD_ROWS", 10)
    df = spark.range(5000).select("id", F.when(F.col("id") < 4000, "early").otherwise(F.concat(F.lit("late"), F.col("id") % 3)).alias("x"))
    assert rows(P.examples(df, "id", ["x"]))["x"]["examples"] == ["early", "late1", "late2", "late0"]


def test_datetime_probe(spark):
    base = datetime(2020, 1, 1)
    df = spark.createDataFrame([(i, base + timedelta(days=i), f"2020-01-{i + 1:02d}", "free words", 20200101 + i) for i in range(20)],
                               "k int, ts timestamp, day string, note string, num bigint")
    p = rows(P.probe_datetime(df, "k"))
    assert [c for c in p if p[c]["datetime_like"]] == ["ts", "day"]
    assert p["day"]["period_candidates"] == ["month_of:day", "week_of:day", "dayofweek_of:day"] and p["num"]["period_candidates"] == []


def test_leak_scan_and_binary_text_target(spark):
    df = spark.range(200).select((F.col("id") * 2.0 + F.sin("id")).alias("leaky"), F.sin(F.col("id") * 7).alias("honest"), F.lit(3).alias("flat"), F.col("id").cast("double").alias("y"))
    assert [r.column for r in P.leak_scan(df, "y").collect()] == ["leaky"]
    two = df.withColumn("y", F.when(F.col("y") > 100, "yes").otherwise("no")).withColumn("copy", F.when(F.col("y") == "yes", 1.0).otherwise(0.0))
    assert [r.column for r in P.leak_scan(two, "y").collect()] == ["copy"]
    many = df.withColumn("y", F.concat(F.lit("c"), F.col("y") % 5))
    assert P.leak_scan(many, "y").count() == 0


def test_correlation_guards(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (2.0, 2.0, 5.0), (None, 3.0, 6.0)], "x double, y double, z double")
    got = {r.column: r for r in P.correlations(df, "y", min_pairs=3).collect()}
    assert got["x"].r_abs is None and got["x"].n_pairs == 2
    constant_where_paired = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (None, 9.0)], "x double, y double")
    assert P.correlations(constant_where_paired, "y").first().r_abs is None


def test_correlation_blocks_cover_wide_tables(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("y"), *[(F.col("id") * (i + 1) + F.sin(F.col("id") * i)).alias(f"c{i}") for i in range(25)])
    assert P.correlations(df, "y").count() == 25 and P.correlations(df, "y").where("r_abs IS NULL").count() == 0


def test_text_detection(spark):
    df = spark.range(60).select(F.concat(F.lit("a long description of the thing number "), "id").alias("description"), F.lit("Good").alias("quality"),
                                F.concat(F.lit("c"), "id").alias("code"), F.col("id").alias("y"))
    assert [r.name for r in P.detect_text(df, "y").collect()] == ["description"]
    assert P.detect_text(df.limit(10), "y").count() == 0


def test_target_stats_skew(spark):
    s = P.target_stats(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10)], "y double"), "y").first()
    assert (s["min"], s.p25, s.median, s["mean"], s.p75, s["max"], s.skewness) == (1, 1.75, 2.5, 4, 4.75, 10, 1.7636)


@pytest.mark.parametrize("values,expected", [(range(500), False), ([0, 1] * 10, True), (list("abc") * 5, True), ([0.5, 1.5] * 9, False)])
def test_classification(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "y string" if isinstance(list(values)[0], str) else None).toDF("y")
    assert P.is_classification(df, "y").first().classification is expected
    assert P.looks_like_classes(df, "y") is expected


def test_fold_checks_fall_back_with_a_reason(spark):
    df = spark.range(12).select(F.col("id").alias("rowid"), F.lit("never").alias("when_"), (F.col("id") % 3).alias("grp"), F.lit(1).alias("one"),
                                (F.col("id") % 2).alias("y"), F.timestamp_seconds(F.col("id") * 5_000_000).alias("ts"))
    for proposal in ({"strategy": "group", "group_column": "rowid"}, {"strategy": "time", "time_column": "when_"}, {"strategy": "group", "group_column": "none"},
                     {"strategy": "time_local", "time_column": "ts", "period_column": "one"}, {"strategy": "time_local", "time_column": "ts", "period_column": "month_of:zz"},
                     {"strategy": "group", "group_column": "y"}, {"strategy": "group", "group_column": "one"}):
        r = check_folds(df, proposal, "y").first()
        assert (r.strategy, r.status) == ("random", "fallback") and r.reason
    good = verified_folds(df, {"strategy": "time_local", "time_column": "ts", "period_column": "month_of:ts"}, "y")
    assert good["strategy"] == "time_local" and good["period_column"] == "month_of:ts"
    small = check_folds(df, {"strategy": "group", "group_column": "grp"}, "y").first()
    assert small.strategy == "group" and "few entities" in small.reason


def test_audit_risk_levels(spark):
    base = spark.range(60).select(F.sin(F.col("id") * 3).alias("x"), (F.col("id") % 2).alias("y"), (F.col("id") % 12).alias("customer_id"))
    low = A.risk_level(A.audit(base.drop("customer_id"), "y")).first()
    mid = A.risk_level(A.audit(base, "y", proposal={"strategy": "group", "group_column": "customer_id"})).first()
    high = A.risk_level(A.audit(base.withColumn("leak", F.col("y") * 2.0), "y")).first()
    warned = A.audit(base, "y", proposal={"strategy": "random", "leakage_warnings": [{"column": "x", "reason": "late"}]})
    shifted = A.risk_level(A.audit(base.drop("customer_id"), "y", shift_auc=0.9)).first()
    assert (low.risk, mid.risk, high.risk, A.risk_level(warned).first().risk, shifted.risk) == ("low", "elevated", "high", "high", "elevated")
    with pytest.raises(ValueError):
        A.audit(base, "zz")


def test_structural_findings(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("customer_id"), F.col("id").alias("row_id"), F.concat(F.lit("n"), "id").alias("note"),
                                 F.lit(None).cast("double").alias("empty"), F.lit(1).alias("const"), (F.col("id") * 0.5).alias("x"), (F.col("id") % 2).alias("y"))
    found = {(r.check, r.column) for r in A.audit(df, "y").collect()}
    assert {("id_like", "row_id"), ("id_like", "note"), ("constant", "empty"), ("constant", "const"), ("high_missing", "empty")} == found


def test_shift_bands(spark):
    got = spark.createDataFrame([(0.55,), (0.6,), (0.79,), (0.8,), (None,)], "a double").select(shift_band(F.col("a"))).collect()
    assert [r[0] for r in got] == ["low", "moderate", "moderate", "strong", "not measured"]


def test_task_inference(spark):
    train = spark.createDataFrame([(1, 0.1, "a"), (2, 0.2, "b")], "id int, f double, species string")
    test = train.drop("species")
    wide = spark.createDataFrame([(1, 0.5, 0.5)], "id int, a double, b double")
    assert L.infer_task(train, test, wide).first().asDict() == {"id_column": "id", "target": "species", "shape": "per_class", "ok": True}
    assert L.infer_task(train, test, train.select("id", "species")).first().target == "species"
    assert not L.infer_task(train, test, wide.withColumn("c", F.lit(0.1))).first().ok


def test_load_and_guard(spark, tmp_path):
    df = spark.range(60).select("id", (F.col("id") / 2).alias("x"))
    df.write.parquet(str(tmp_path / "t.parquet"))
    df.write.option("header", True).csv(str(tmp_path / "t.csv"))
    df.write.json(str(tmp_path / "t.json"))
    df.write.option("sep", ";").csv(str(tmp_path / "plain.csv"))
    assert all(L.load_table(spark, str(tmp_path / f"t.{e}")).count() == 60 for e in ("parquet", "csv", "json"))
    plain = L.read_csv(spark, str(tmp_path / "plain.csv"), header=False, sep=";", names=["id", "x"])
    assert plain.columns == ["id", "x"] and plain.count() == 60
    assert L.guard_inputs(df, ["id"]).first().verdict == "ok"
    assert L.guard_inputs(df.limit(5), ["id"]).first().reason == "only 5 rows, need 50"
    assert L.guard_inputs(df, ["zz"]).first().verdict == "rejected"
    L.write_predictions(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["id", "x"]


def test_nan_counts_as_missing(spark):
    from plumbline.functions.columns import nan_to_null
    df = nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),)], "x double"))
    assert rows(P.profile(df, "y"))["x"]["n_missing"] == 1


def test_shape_and_sample(spark):
    df = spark.range(500).select("id", F.col("id").alias("a"), F.when(F.col("id") % 2 == 0, 1).alias("y"), F.lit("TRUE").alias("w"))
    assert L.shape(df, "y", drop=["w"], rename={"y": "target"}).columns == ["id", "a", "target"] and L.shape(df, "y").count() == 250
    assert L.sample_rows(df, 77, "id").count() == 77 and L.sample_rows(df, 9999, "id").count() == 500
    assert sorted(r.id for r in L.sample_rows(df, 20, "id").collect()) == sorted(r.id for r in L.sample_rows(df.repartition(5), 20, "id").collect())
    assert L.with_row_id(df, ["id"]).columns == df.columns
    a, b = L.drop_columns(["w"], df, df)
    assert "w" not in a.columns and "w" not in b.columns
