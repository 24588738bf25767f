"""Fits with planted lies: the split that lies must be caught, the clean control must stay quiet."""

import pytest
from pyspark.sql import functions as F

from plumbline import session
from plumbline.functions.columns import keyed_hash
from plumbline.operators.userfeatures import UserFeature
from plumbline.plans import backtest as B
from plumbline.plans import gates as G
from plumbline.plans import jobs as W
from plumbline.plans import model as L


def noise(seed, key="id"):
    return keyed_hash(seed, key) / float(2 ** 32)


@pytest.fixture(scope="module")
def coin(spark):
    """200 sensors with six readings each; the fault is drawn per sensor, and readings tell the sensor apart."""
    df = spark.range(1200).withColumn("sensor", F.floor(F.col("id") / 6))
    cols = {f"reading_{i}": 10 * (keyed_hash(50 + i, "sensor") / float(2 ** 32)) + noise(200 + i) * 0.1 for i in range(3)}
    return df.withColumns(cols).withColumn("faulty", (keyed_hash("fault", "sensor") % 2).cast("int")).cache()


@pytest.fixture(scope="module")
def line(spark):
    return spark.range(240).select("id", (F.col("id") * 1.0).alias("x"), F.lit("k").alias("c"), (F.col("id") * 2.0 + noise(1)).alias("y")).cache()


def test_targets_of_too_many_classes_are_refused_before_they_are_collected(spark, monkeypatch):
    df = spark.range(L.MAX_CLASSES + 1).select("id", F.col("id").cast("string").alias("y"))
    assert len(L.class_list(df.where("id > 0"), "y")) == L.MAX_CLASSES
    monkeypatch.setattr(type(df), "collect", lambda self: pytest.fail("collected"))
    with pytest.raises(ValueError, match="10001 classes"):
        L.class_list(df, "y")


def test_random_folds_lie_on_grouped_data(coin):
    args = dict(k=3, learner=L.forest(10, 8), exclude=["sensor"])
    naive = L.cross_validate(coin, "faulty", "id", **args)
    honest = L.cross_validate(coin, "faulty", "id", folds={"strategy": "group", "group_column": "sensor"}, **args)
    assert naive.mean > 0.85 and honest.mean < 0.7
    assert honest.oof.count() == 1200 and honest.oof.where("abs(proba[0] + proba[1] - 1) > 1e-6").count() == 0
    gap = W.check_validation(coin, "faulty", "id", {"strategy": "group", "group_column": "sensor"}, learner=L.tree(8), exclude=["sensor"]).first()
    assert gap.gap > 0.1 and gap.direction == "optimistic (dangerous)"


def test_linear_beats_the_mean_and_not_the_reverse(line):
    up = L.compare(L.constant(), L.linear(), line, "y", "id", k=3, metric="r2").first()
    down = L.compare(L.linear(), L.constant(), line, "y", "id", k=3, metric="r2").first()
    assert up.verdict == "improved" and down.verdict == "no_improvement" and up.mean_delta > 0.5 and up.n_folds == 3


def test_cross_validation_scores_in_original_units(line):
    from plumbline.operators.encode import TargetTransform
    cv = L.cross_validate(line, "y", "id", k=3, learner=L.tree(), transform=TargetTransform())
    assert cv.metric == "rmse" and -40 < cv.mean < 0 and cv.oof.agg(F.max("pred")).first()[0] > 100


def test_missing_class_gets_probability_zero(spark):
    df = spark.createDataFrame([(i, float(i % 2), "ab"[i % 2]) for i in range(40)], "id int, x double, y string")
    fitted = L.fit(df, "y", L.tree(2), exclude=["id"], classes=["a", "b", "c"])
    assert fitted.predict(df, ["id"]).select(F.size("proba"), F.col("proba")[2]).distinct().collect() == [(3, 0.0)]


def test_unseen_levels_nulls_and_long_texts(spark):
    train = spark.range(300).select("id", F.concat(F.lit("free text number "), "id").alias("note"), F.when(F.col("id") % 3 == 0, "u").alias("lvl"),
                                    F.when(F.col("id") % 2 == 0, F.col("id") * 1.0).alias("x"), F.lit(None).cast("double").alias("void"), (F.col("id") % 2).alias("y"))
    fitted = L.fit(train, "y", L.tree(), exclude=["id"], classes=[0, 1])
    new = train.limit(5).withColumns({"lvl": F.lit("never seen"), "x": F.lit(None).cast("double")})
    assert fitted.predict(new, ["id"]).count() == 5 and "void" not in fitted.features


def test_shift_is_seen_and_absence_too(line):
    before, after = line.where("id < 120"), line.where("id >= 120")
    assert L.adversarial_auc(before, after, "y", "id") > 0.9
    mixed = line.withColumn("x", noise(5))
    assert L.adversarial_auc(mixed.where("id % 2 = 0"), mixed.where("id % 2 = 1"), "y", "id") < 0.75
    assert L.adversarial_auc(before.select("id", "y"), after.select("id", "y"), "y", "id") is None


def test_feature_gate_keeps_signal_only(spark):
    df = spark.range(500).select("id", noise(11).alias("width"), noise(12).alias("height")).withColumn("area", F.col("width") * F.col("height"))
    product = UserFeature("product", lambda t: None, lambda d, p: F.col("width") * F.col("height"))
    dice = UserFeature("dice", lambda t: None, lambda d, p: noise(78))
    climb = G.Climb(df, "area", "id", dict(k=3, learner=L.linear()))
    assert [f.name for f in climb.features([dice, product])] == ["product"]
    assert [r.reason for r in climb.records().collect()] == ["no_improvement", "improved"] and climb.spent == 2
    spent = G.Climb(df, "area", "id", dict(k=3, learner=L.linear()), limit=0)
    assert spent.features([product]) == [] and spent.ledger[0][4] == "budget_exhausted" and spent.spent == 0


def test_useful_column_is_kept_against_the_plan(spark):
    df = spark.range(500).select("id", noise(21).alias("load"), noise(22).alias("dust")).withColumn("fails", (F.col("load") > 0.7).cast("int"))
    climb = G.Climb(df, "fails", "id", dict(k=3, learner=L.tree(), cleaning={"columns_to_drop": ["load", "id"]}))
    assert climb.keep_columns(["load"])["columns_to_drop"] == ["id"] and climb.ledger[0][2]


def test_framing_gate(spark):
    df = spark.range(500).select("id", noise(31).alias("x")).withColumn("y", F.exp(F.col("x") * 8) * (1 + noise(33)))
    climb = G.Climb(df, "y", "id", dict(k=3, learner=L.linear()))
    climb.log_target()
    assert climb.ledger[0][4] in ("improved", "no_improvement")
    below = G.Climb(df.withColumn("y", -F.col("y")), "y", "id", dict(k=3, learner=L.linear()))
    assert below.log_target() is None and below.ledger[0][4] == "negative values"


def test_backtest_audit_finds_the_future_and_clears_the_clean(spark):
    df = spark.range(300).select("id", F.timestamp_seconds(F.col("id") * 86400).alias("date"), noise(1).alias("price")).withColumn("sales", F.col("price") * 10 + noise(2))
    bad = df.withColumn("actual_total", F.col("sales") * 1.01)
    found = {r.check: r for r in B.audit_backtest(bad, "sales", "date", "id", suspects=["actual_total", "ghost"], learner=L.tree(4)).collect()}
    assert found["future_feature"].subject == "actual_total" and found["future_feature"].value > 0.99 and found["risk"].detail == "high"
    clean = {r.check: r for r in B.audit_backtest(df, "sales", "date", "id", learner=L.tree(4)).collect()}
    assert clean["risk"].detail == "low" and "future_feature" not in clean
    assert B.split_design(df.limit(5), "sales", "date", "id") is None


def test_series_identity_leak(spark):
    df = spark.range(300).select("id", F.col("id").alias("t"), noise(1).alias("sales"), F.floor(F.col("id") / 10).cast("bigint").alias("store"))
    leak = B.series_null(df, "sales", "t", "id", "store", n_perm=3, exclude=["t"]).first()
    assert leak.verdict == "leaking" and leak.n_perm == 3
    fair = B.series_null(df.withColumn("store", F.col("id") % 7), "sales", "t", "id", "store", n_perm=3, exclude=["t"]).first()
    assert fair.observed < 0.8


def test_whole_run_and_submission(line):
    test = line.where("id % 5 = 0").drop("y")
    plans = W.Plans(cleaning={"columns_to_drop": ["c"]}, features={"features": [{"op": "log_transform", "column": "x"}]}, try_log_target=True, budget=1)
    run = W.run_cv(line.where("id % 5 > 0"), "y", "id", plans, test=test, learner=L.tree())
    assert run.submission.columns == ["id", "y"] and run.submission.count() == 48 and run.trials_spent == 1
    assert run.columns == (4, 3, 4) and run.shift_auc is not None
    assert W.run_holdout(line, "y", "id", plans, learner=L.tree()).first().metric == "rmse"
    assert W.feasibility(line.limit(10), "y", "id").first().verdict == "rejected"


def test_submission_shapes(spark):
    pred = spark.createDataFrame([(1, [0.2, 0.8])], "id int, proba array<double>")
    assert W.proba_submission(pred, "id", ["n", "y"], ["y", "n"]).first().asDict() == {"id": 1, "y": 0.8, "n": 0.2}
    assert W.proba_submission(pred, "id", ["n", "y"], ["score"], "y").first().score == 0.8
    with pytest.raises(ValueError):
        W.proba_submission(pred, "id", ["n", "y"], ["a", "b", "c"])
    wide = spark.createDataFrame([(1, 0.3, 0.3, 0.4)], "id int, a double, b double, c double")
    assert [r.choice for r in W.top_k_long(wide, "id", ["a", "b", "c"], 2).orderBy("place").collect()] == ["c", "a"]


def test_failed_seeds_are_recorded(line):
    broken = W.Plans(cleaning={"columns_to_drop": ["x", "c"]})
    with pytest.raises(RuntimeError, match="all 1 seeds failed"):
        W.paired_run(line, "y", "id", "rmse", broken, learner=L.tree())


@pytest.mark.parametrize("n_levels", [80, 200])
def test_levels_keep_their_signal_whatever_their_number(spark, n_levels):
    df = spark.range(8000).select("id", F.concat(F.lit("level "), (F.col("id") % n_levels).cast("string")).alias("code"), noise(3).alias("x"))
    df = df.withColumn("y", (keyed_hash("side", F.col("code")) % 2).cast("int"))
    for learner in (L.linear(), L.tree()):
        cv = L.cross_validate(df, "y", "id", k=3, learner=learner)
        assert cv.mean > 0.95
        assert L.fit(df, "y", learner, exclude=["id"], classes=[0, 1]).drivers()[0][0] == "code"


def test_level_statistics_never_use_a_row_s_own_label(spark):
    df = spark.range(2000).select("id", F.concat(F.lit("only "), "id").alias("name"), (keyed_hash("coin", "id") % 2).cast("int").alias("y"))
    assert L.cross_validate(df, "y", "id", k=3, learner=L.tree()).mean < 0.6


def test_plan_may_drop_the_key(line):
    cv = L.cross_validate(line, "y", "id", k=3, learner=L.linear(), cleaning={"columns_to_drop": ["id", "c"]})
    assert len(cv.fold_scores) == 3
    run = W.run_cv(line, "y", "id", W.Plans(cleaning={"columns_to_drop": ["id"]}), test=line.drop("y"), learner=L.linear())
    assert run.submission.count() == 240


def test_weights_reach_the_score(spark):
    df = spark.range(300).select("id", F.lit(1.0).alias("x"), F.when(F.col("id") % 10 == 0, 100.0).otherwise(1.0).alias("y"), F.when(F.col("id") % 10 == 0, 0.001).otherwise(1.0).alias("w"))
    plain = L.cross_validate(df.drop("w"), "y", "id", k=3, learner=L.constant(), metric="mae", stratified=False)
    heavy = L.cross_validate(df, "y", "id", k=3, learner=L.constant(), metric="mae", weight="w", stratified=False)
    assert plain.mean < -5 and heavy.mean > -1


def test_metrics_of_classes_in_cross_validation(spark):
    df = spark.range(600).select("id", (F.col("id") % 3).cast("double").alias("x"), (F.col("id") % 3).alias("y"))
    assert L.cross_validate(df, "y", "id", k=3, learner=L.tree(), metric="roc_auc").mean > 0.99
    two = df.withColumn("y", F.col("y") % 2)
    assert L.cross_validate(two, "y", "id", k=3, learner=L.tree(), metric="f1").mean > 0.99


def test_level_statistics_without_a_unique_column(spark):
    """Copies of a row share all parts, so a level keeps what it says about the label."""
    df = spark.range(2000).select(F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("g"), ((F.col("id") % 2) == F.when(keyed_hash("noise", "id") % 10 == 0, 1).otherwise(0)).cast("int").alias("y"))
    fitted = L.fit(df, "y", L.tree(), classes=[0, 1])
    hits = fitted.predict(df, [F.col("y").alias("label")]).agg(F.avg((F.col("label") == F.col("pred")).cast("double"))).first()[0]
    assert hits > 0.85


# ---- tables that come as one task --------------------------------------------------------------

@pytest.fixture
def single(spark, monkeypatch):
    """40,000 rows that are read by one task, as a file with one row group is; parts are small enough for them to be dealt."""
    monkeypatch.setattr(session, "MOST_ROWS", 10_000)
    return spark.range(0, 40_000, 1, 1).select("id", F.col("id").alias("at"), (F.col("id") % 7).alias("x"), F.when(F.col("id") % 7 > 3, "a").otherwise("b").alias("y"))


def test_parts_are_neither_small_nor_large():
    assert [session.even_parts(n, 12) for n in (0, 1, 250_000, 250_001, 600_000, 6_000_000, 36_000_000)] == [None, None, None, 24, 24, 24, 144]


def test_rows_of_one_task_stay_as_they_lie(spark):
    df = spark.range(0, 1_000, 1, 3)
    with session.dealt(df) as rows:
        assert rows.storageLevel.useMemory and rows.rdd.glom().map(len).collect() == df.rdd.glom().map(len).collect()
    assert not rows.storageLevel.useMemory


def test_both_arms_of_a_pair_run_on_one_dealt_table(spark, single, monkeypatch):
    seen, run = [], W.run_cv
    monkeypatch.setattr(W, "run_cv", lambda df, *a, **more: seen.append((df.storageLevel.useMemory, df.rdd.getNumPartitions())) or run(df, *a, **more))
    rows = W.paired_run(single, "y", "id", "accuracy", W.Plans(), learner=L.tree(2), k=2).collect()
    assert [(r.baseline, r.treatment, r.error) for r in rows] == [(1.0, 1.0, None)]
    assert len(seen) == 2 and all(held and parts > 1 for held, parts in seen)


@pytest.mark.parametrize("folds", [None, {"strategy": "time", "time_column": "at"}])
def test_folds_of_a_single_task_are_fitted_by_several(spark, single, folds, monkeypatch):
    seen, fit = [], L.fit
    monkeypatch.setattr(L, "fit", lambda train, *a, **more: seen.append(train.rdd.getNumPartitions()) or fit(train, *a, **more))
    cv = L.cross_validate(single, "y", "id", k=2, folds=folds, learner=L.tree(2))
    assert seen == [4, 4]
    assert cv.fold_scores == [1.0, 1.0]
    assert cv.oof.count() == cv.oof.select("id").distinct().count() == (40_000 if folds is None else 26_666)


def _kept_tables(monkeypatch, module):
    """The levels at which tables are kept when they are estimated on."""
    seen, estimate = [], module.cross_validate
    monkeypatch.setattr(module, "cross_validate", lambda df, *a, **more: seen.append((df.storageLevel.useMemory, df.rdd.getNumPartitions())) or estimate(df, *a, **more))
    return seen


def test_a_climb_reads_its_table_once(spark, single, monkeypatch):
    seen = _kept_tables(monkeypatch, G)
    climb = G.Climb(single, "y", "id", dict(k=2, learner=L.tree(2), cleaning={"columns_to_drop": ["x"]}))
    climb.keep_columns(["x"])
    assert seen == [(True, 4)] * 2
    assert climb.records().first().accepted
    assert climb.df is single and not single.storageLevel.useMemory


def test_check_validation_reads_its_table_once(spark, single, monkeypatch):
    seen = _kept_tables(monkeypatch, W)
    gap = W.check_validation(single, "y", "id", {"strategy": "time", "time_column": "at"}, k=2, learner=L.tree(2)).first()
    assert seen == [(True, 4)] * 2
    assert gap.strategy == "time"
