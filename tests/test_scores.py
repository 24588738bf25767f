"""Metrics and decisions: known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import decide as D
from plumbline.operators import grading as J
from plumbline.operators import metrics as M


def pred(spark, rows, schema="label string, pred string"):
    return spark.createDataFrame(rows, schema)


def test_label_metrics(spark):
    df = pred(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("c", "d")])
    assert M.accuracy(df).first()[0] == 0.5
    assert math.isclose(M.balanced_accuracy(df).first()[0], 0.5)
    assert math.isclose(M.f1_macro(df).first()[0], (2 / 3 + 2 / 3 + 0 + 0) / 4)
    assert math.isclose(M.f1(df, "b").first()[0], 2 / 3)
    same = pred(spark, [("a", "a"), ("b", "b")])
    assert M.mcc(same).first()[0] == 1 and M.quadratic_weighted_kappa(same).first()[0] == 1
    assert M.mcc(pred(spark, [("a", "a"), ("b", "a")])).first()[0] == 0
    assert math.isclose(M.quadratic_weighted_kappa(pred(spark, [(1, 1), (2, 3), (3, 3), (1, 2)], "label int, pred int")).first()[0], 1 - 2 / 6.5)


def test_regression_metrics(spark):
    df = pred(spark, [(1.0, 2.0), (2.0, 3.0), (3.0, 4.0)], "label double, pred double")
    r = M.regression(df, negate=True).first()
    assert (r.rmse, r.mae) == (-1, -1) and math.isclose(r.r2, -0.5)
    assert M.regression(pred(spark, [(1.0, 2.0)], "label double, pred double")).first().r2 == 0
    assert M.rmspe(pred(spark, [(0.0, 2.0)], "label double, pred double")).first()[0] == 0
    assert math.isclose(M.rmspe(pred(spark, [(0.0, 2.0), (2.0, 1.0)], "label double, pred double")).first()[0], 0.5)
    assert math.isclose(M.rmsle(pred(spark, [(0.0, -3.0), (math.e - 1, 0.0)], "label double, pred double")).first()[0], math.sqrt(0.5))
    w = pred(spark, [(1.0, 2.0, 5.0), (1.0, 4.0, 1.0)], "label double, pred double, w double")
    assert math.isclose(M.weighted_mae(w, "w").first()[0], 8 / 6)


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 400), np.where(rng.random(400) < 0.4, 0.5, np.round(rng.random(400), 3))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert math.isclose(M.roc_auc(df).first()[0], want)
    assert M.roc_auc(df.where("label = 1")).first()[0] is None
    assert math.isclose(M.roc_auc(df.withColumn("score", F.lit(1.0))).first()[0], 0.5)


def test_log_loss_and_temperature(spark):
    df = spark.createDataFrame([("a", [0.9, 0.1]), ("b", [0.8, 0.2]), ("a", [1.0, 0.0]), ("b", [1.0, 0.0])], "label string, proba array<double>")
    want = -(math.log(0.9) + math.log(0.2) + math.log(1 - M.EPSILON) + math.log(M.EPSILON)) / 4
    assert math.isclose(M.log_loss(df, ["a", "b"]).first()[0], want)
    one, three = df.select(M.apply_temperature(F.col("proba"), 1.0), M.apply_temperature(F.col("proba"), 3.0)).first()
    assert np.allclose(one, [0.9, 0.1]) and three[0] > three[1] and math.isclose(sum(three), 1)
    with pytest.raises(ValueError):
        M.apply_temperature(F.col("proba"), 0.0)
    over = spark.createDataFrame([("a", [0.99, 0.01])] * 7 + [("b", [0.99, 0.01])] * 3, "label string, proba array<double>")
    t, loss, plain = M.fit_temperature(over, ["a", "b"])
    assert t > 1 and loss < plain and math.isclose(loss, -(0.7 * math.log(0.7) + 0.3 * math.log(0.3)), rel_tol=1e-3)


def test_grade_refuses_partial_submissions(spark):
    answer = spark.createDataFrame([(i, i % 2) for i in range(4)], "id int, y int")
    sub = answer.withColumn("y", F.when(F.col("id") == 3, 0).otherwise(F.col("y")))
    assert J.grade(answer, sub, "id", "y", "accuracy").first().accuracy == 0.75
    assert J.grade(answer, sub, "id", "y", "balanced_accuracy").first().balanced_accuracy == 0.75
    for bad in (sub.where("id < 2"), sub.union(sub)):
        with pytest.raises(ValueError, match="misses"):
            J.grade(answer, bad, "id", "y", "accuracy")
    with pytest.raises(ValueError, match="unknown metric"):
        J.grade(answer, sub, "id", "y", "ndcg")


def summary(spark, deltas, ratio=0.0):
    return D.paired_summary(spark.createDataFrame([("c", float(d)) for d in deltas], "c string, delta double"), ["c"], ratio).first()


@pytest.mark.parametrize("deltas,ratio,better", [
    ([0.10, 0.09, 0.02], 0.0, True), ([0.10, 0.09, 0.02], 0.5, False), ([0.5], 0.0, False), ([1.0, -0.01, -0.01], 0.0, False),
    ([1e-5] * 3, 0.0, False), ([625, 1402, 377, 3653, 370], 1 / 3, False)])
def test_accept_rule(spark, deltas, ratio, better):
    assert summary(spark, deltas, ratio).better is better


def test_minimum_detectable_effect(spark):
    s = summary(spark, [0.10, 0.09, 0.02], 0.5)
    assert math.isclose(s.mde, 2 * np.std([0.10, 0.09, 0.02], ddof=1) * math.sqrt(1 / 3 + 0.5))
    assert summary(spark, [0.1], 0.5).mde == math.inf
    assert abs(summary(spark, [625, 1402, 377, 3653, 370], 1 / 3).mde - 2028.9) < 0.1     # published threshold
    assert abs(summary(spark, [625, 1402, 377, 3653, 370]).mde - 1242.4) < 0.1


@pytest.mark.parametrize("base,trial,higher,accepted", [
    ([.8] * 3, [.85, .84, .86], True, True), ([.8] * 3, [.81, .81, .79], True, False), ([.5] * 3, [.40, .42, .41], False, True), ([.80, .81, .82], [.80, .81, .82], True, False)])
def test_improves(spark, base, trial, higher, accepted):
    pairs = spark.createDataFrame([("c", b, t, higher) for b, t in zip(base, trial)], "c string, base double, trial double, higher_is_better boolean")
    r = D.improves(pairs, ["c"]).first()
    assert r.accepted is accepted and r.no_effect is (base == trial)
    if accepted:
        assert math.isclose(r.delta, 0.05 if higher else 0.09)


def test_single_pair_falls_back_to_spread(spark):
    pairs = spark.createDataFrame([("a", 0.5, 0.6, True, 0.01), ("b", 0.5, 0.6, True, 0.2)], "c string, base double, trial double, higher_is_better boolean, base_std double")
    assert {r.c: r.accepted for r in D.improves(pairs, ["c"]).collect()} == {"a": True, "b": False}


@pytest.mark.parametrize("naive,honest,higher,direction", [
    ([.90, .91, .89], [.70, .72, .68], True, "optimistic (dangerous)"), ([5, 5.2, 4.9], [8, 8.3, 7.9], False, "optimistic (dangerous)"),
    ([.80, .81, .79], [.80, .79, .81], True, "undecided"), ([.70, .72, .68], [.90, .91, .89], True, "pessimistic (safe)")])
def test_backtest_gap(spark, naive, honest, higher, direction):
    pairs = spark.createDataFrame([("c", float(n), float(c), higher) for n, c in zip(naive, honest)], "c string, naive double, corrected double, higher_is_better boolean")
    assert D.backtest_gap(pairs, ["c"]).first().direction == direction


def test_multi_seed(spark):
    rows = [("win", s, 0.7, 0.8 + s / 1000, True, None) for s in range(5)] + [("even", s, 0.7, 0.7 + (-1) ** s * 0.01, True, None) for s in range(5)]
    rows += [("lower", s, 1.0, 2.0 + s / 100, False, None) for s in range(5)] + [("partly", 0, 0.7, 0.8, True, None), ("partly", 1, None, None, True, "boom")]
    rows += [("dead", 0, None, None, True, "boom")]
    runs = spark.createDataFrame(rows, "task string, seed int, baseline double, treatment double, higher_is_better boolean, error string")
    got = {r.task: r for r in D.multi_seed_verdict(runs, ["task"]).collect()}
    assert {t: r.verdict for t, r in got.items()} == {"win": "treatment", "even": "undecided", "lower": "baseline", "partly": "undecided", "dead": "failed"}
    assert got["partly"].failed_seeds == [1] and got["partly"].mde == math.inf


def test_null_band(spark):
    null = spark.createDataFrame([("a", .55)] * 5 + [("b", .97)] * 5 + [("c", .90)] * 5, "s string, score double")
    seen = spark.createDataFrame([("a", .95), ("b", .97), ("c", .91)], "s string, observed double")
    assert {r.s: r.verdict for r in D.null_band(seen, null, ["s"]).collect()} == {"a": "leaking", "b": "not leaking", "c": "not leaking"}


def test_budget(spark):
    trials = spark.createDataFrame([("r", 3), ("r", 1), ("r", 2), ("s", 9)], "run string, trial int")
    got = {(r.run, r.trial): r.status for r in D.spend_budget(trials, "run", "trial", 2).collect()}
    assert got == {("r", 1): "measured", ("r", 2): "measured", ("r", 3): "budget_exhausted", ("s", 9): "measured"}
    assert D.spend_budget(trials, "run", "trial", 0).where("status = 'measured'").count() == 0


def test_budget_window_is_cut_before_its_shuffle(spark):
    plan = D.spend_budget(spark.range(100).selectExpr("id % 2 as run", "id as trial"), "run", "trial", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_common_support_and_references(spark):
    a = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, None)], "id int, label double, pred double")
    assert J.common_support(a, a, "id").count() == 1
    refs = spark.createDataFrame([("x", "u1"), ("x", "u9"), ("y", "u9")], "brief string, url string")
    seen = spark.createDataFrame([("u1",), ("u1",)], "url string")
    got = {r.brief: (r.n_kept, r.n_dropped, r.grounded) for r in J.ground_references(refs, seen).collect()}
    assert got == {"x": (1, 1, True), "y": (0, 1, False)} and J.dropped_references(refs, seen).count() == 2


def test_grade_refuses_repeated_and_missing_keys(spark):
    from plumbline.operators import grading as J
    answer = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "b")], "id int, y string")
    for sent in ([(1, "a"), (1, "a"), (3, "a"), (4, "b")], [(1, "a"), (3, "a"), (4, "b")], [(1, "a"), (2, "b"), (2, "b"), (3, "a"), (4, "b")]):
        with pytest.raises(ValueError, match="misses"):
            J.grade(answer, spark.createDataFrame(sent, answer.schema), "id", "y", "accuracy")
    full = spark.createDataFrame([(4, "b"), (3, "b"), (2, "b"), (1, "a"), (9, "z")], answer.schema)
    assert J.grade(answer, full, "id", "y", "accuracy").first().accuracy == 0.75
    assert J.grade(answer, full, "id", "y", "f1").first().f1 == pytest.approx(0.8)
