from pyspark.sql import functions as F

from plumbline.plans import ledger_views as V
from plumbline.sources.ledger import BOARD, RUNS, append_ledger, read_ledger
from plumbline.streaming.ledger_stream import follow, verdict_counts

ROW = "kind string, name string, metric string, baseline double, treatment double, delta double, higher_is_better boolean, verdict string"


def board(spark, rows):
    return spark.createDataFrame(rows, ROW)


def test_append_and_read_back(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert read_ledger(spark, path, BOARD).count() == 0
    append_ledger(board(spark, [("multi_seed", "a", "rmse", 1.0, 0.5, -0.5, False, "treatment")]), path, "2024-01-01T00:00:00")
    append_ledger(board(spark, [(None, "b", "rmse", 1.0, 1.5, 0.5, False, None)]), path, "2024-01-02T00:00:00")
    got = {r.name: r for r in read_ledger(spark, path, BOARD).collect()}
    assert got["a"].timestamp == "2024-01-01T00:00:00" and got["b"].verdict is None and len(got) == 2


def test_blank_lines_are_skipped(spark, tmp_path):
    (tmp_path / "runs.json").write_text('{"source": "x", "metrics": {"rmse": 1.5}}\n\n   \n{"source": "y"}\n')
    got = read_ledger(spark, str(tmp_path / "runs.json"), RUNS).orderBy("source").collect()
    assert [r.source for r in got] == ["x", "y"] and got[0].metrics == {"rmse": 1.5}


def test_latest_pair_shares_metrics(spark):
    rows = [("t", "baseline", 1, {"a": 1.0, "b": 2.0}), ("t", "baseline", 3, {"a": 5.0, "b": 6.0}), ("t", "treatment", 2, {"a": 7.0, "c": 1.0}), ("lonely", "baseline", 1, {"a": 1.0})]
    runs = spark.createDataFrame(rows, "table string, arm string, at int, metrics map<string,double>")
    assert [tuple(r) for r in V.latest_pair(runs, ["table"], ["at"]).collect()] == [("t", "a", 5.0, 7.0, 2.0)]


def test_only_settled_verdicts_are_precedent(spark):
    rows = [("multi_seed", f"n{i}", "rmse", 1.0, 1.0, 0.0, True, v) for i, v in enumerate(["treatment", "undecided", "baseline", None, "treatment", "treatment", "treatment", "baseline"])]
    rows.append(("single", "x", "rmse", 1.0, 1.0, 0.0, True, "treatment"))
    got = V.decided(board(spark, rows), [F.desc("name")]).collect()
    assert [r.name for r in got] == ["n7", "n6", "n5", "n4", "n2"]


def test_board_shows_verdict_or_winner(spark):
    rows = [("multi_seed", "a", "m", 1.0, 2.0, 1.0, True, "undecided"), (None, "b", "m", 1.0, 2.0, 1.0, False, None), (None, "c", "m", 1.0, 1.0, 0.0, True, None)]
    assert {r.name: r.winner for r in V.board(board(spark, rows)).collect()} == {"a": "undecided", "b": "baseline", "c": "tie"}


def test_labels_lights_and_limits(spark):
    n = F.lit(None).cast("string")
    r = spark.range(1).select(V.fold_label(F.lit("time"), n, F.lit("ts"), n).alias("a"), V.fold_label(F.lit("random"), n, n, n).alias("b"), V.fold_label(n, n, n, n).alias("c")).first()
    assert tuple(r) == ("time:ts", "random", None)
    cases = [(False, True, 0.5, "red"), (True, True, 0.9, "red"), (True, True, 0.7, "yellow"), (True, False, None, "yellow"), (True, True, None, "green")]
    df = spark.createDataFrame(cases, "m boolean, cv boolean, auc double, want string")
    assert df.where(V.run_light(F.col("m"), F.col("cv"), F.col("auc")) != F.col("want")).count() == 0
    assert spark.range(1).select(V.run_limits(F.lit(False), F.lit(True), F.lit(False), F.lit(0.7))).first()[0] == [
        "single holdout", "target framing not evaluated", "train and test differ"]


def test_detection_and_drop_scores(spark):
    predicted = spark.createDataFrame([("a", "group", "id"), ("b", "time", "ts"), ("c", "random", None), ("d", "group", "z")], "name string, strategy string, column string")
    acceptable = spark.createDataFrame([("a", "group", "id"), ("b", "time", "other"), ("c", "random", None), ("d", "random", None)], "name string, strategy string, column string")
    truth = spark.createDataFrame([("a", "group"), ("b", "time"), ("c", "random"), ("d", "random")], "name string, primary string")
    got = {r.primary: (r.n, r.n_correct, r.n_false_alarms) for r in V.detection_score(predicted, acceptable, truth).collect()}
    assert got == {"group": (1, 1, 0), "time": (1, 0, 0), "random": (2, 1, 1)}
    plans = spark.createDataFrame([("t", "y", ["id", "x", "z", "y"], ["id"], ["x"], ["id", "x", "ghost", "y"])],
                                  "name string, target string, columns array<string>, must_drop array<string>, traps array<string>, proposed array<string>")
    assert tuple(V.drop_plan_score(plans).first()) == ("t", 1, 1, ["x"], ["x"])


def test_first_seen_and_evidence(spark):
    hits = spark.createDataFrame([("u", 1, 0, "late"), ("u", 0, 3, "early"), ("v", 0, 1, "only")], "url string, q int, r int, title string")
    assert {r.url: r.title for r in V.first_seen(hits, "url", ["q", "r"]).collect()} == {"u": "early", "v": "only"}
    e = V.evidence(spark.createDataFrame([("s" * 900, "c" * 9000), ("s", "")], "snippet string, content string")).collect()
    assert len(e[0].snippet) == 500 and len(e[0].content) == 6000 and e[1].content is None


def test_following_the_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    append_ledger(board(spark, [("multi_seed", "a", "rmse", 1.0, 0.5, -0.5, False, "treatment")]), path, "t1")
    q = (verdict_counts(follow(spark, path)).writeStream.outputMode("complete").format("memory").queryName("board_counts")
         .option("checkpointLocation", str(tmp_path / "state")).start())
    try:
        q.processAllAvailable()
        append_ledger(board(spark, [("multi_seed", "b", "rmse", 1.0, 0.5, -0.5, False, "treatment"), (None, "c", "rmse", 1.0, 1.0, 0.0, False, None)]), path, "t2")
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r.metric, r.verdict): r.n for r in spark.table("board_counts").collect()} == {("rmse", "treatment"): 2, ("rmse", "single"): 1}
