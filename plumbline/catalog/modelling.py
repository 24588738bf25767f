"""Queries that fit Spark ML models, and SQL-checkable companions of their outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.registry import query, table
from plumbline.catalog.scoring import _CLASSES, auc_sql
from plumbline.functions.columns import keyed_hash
from plumbline.operators import folds as S
from plumbline.operators.userfeatures import UserFeature, target_encoding
from plumbline.plans import backtest as B
from plumbline.plans import gates as G
from plumbline.plans import jobs as W
from plumbline.plans import model as L


def priced_orders(spark, d):
    """Orders with a learnable regression target built from their own columns."""
    o = table(spark, d, "orders")
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    wave = F.month("o_orderdate") * 4000.0
    return o.withColumn("amount", F.col("o_totalprice") * (0.2 + rank * 0.05) + wave).drop("o_totalprice")


def typed_events(spark, d):
    """Events with a two-class label that depends on value and user."""
    e = table(spark, d, "events").drop("props")
    noisy = F.col("value") + (keyed_hash(5, "event_id") % 40) / 10.0
    return e.withColumn("late", F.when(noisy > 12 + (F.col("user_id") % 7), "yes").otherwise("no"))


@query("fit_holdout")
def _holdout(spark, d):
    e = typed_events(spark, d)
    m = S.holdout(e, "event_id", 0.2)
    fitted, score = L.train_and_evaluate(m.where("NOT held_out").drop("held_out"), m.where("held_out").drop("held_out"), "late", "event_id")
    return spark.createDataFrame([(score, ",".join(fitted.features))], "accuracy double, features string")


@query("predict_proba")
def _predict(spark, d):
    e = typed_events(spark, d)
    fitted = L.fit(e, "late", L.tree(), exclude=["event_id"], classes=["no", "yes"])
    return fitted.predict(e, ["event_id"]).select("event_id", "pred", *[F.col("proba")[i].alias(f"p_{c}") for i, c in enumerate(fitted.classes)])


@query("embedding_classes")
def _embeddings(spark, d):
    v = table(spark, d, "embeddings")
    wide = v.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    cv = L.cross_validate(wide, "label", "vec_id", k=3, learner=L.linear())
    return cv.frame(run="embeddings")


@query("cv_scores")
def _cv(spark, d):
    e = typed_events(spark, d)
    clean = {"imputations": [{"column": "value", "strategy": "median"}]}
    feats = {"features": [{"op": "date_parts", "column": "ts", "parts": ["weekday", "hour"]}, {"op": "bin", "column": "value", "n_bins": 6}]}
    return L.cross_validate(e, "late", "event_id", k=3, cleaning=clean, features=feats, learner=L.tree()).frame(run="events")


@query("oof")
def _oof(spark, d):
    cv = L.cross_validate(typed_events(spark, d), "late", "event_id", k=3, folds={"strategy": "group", "group_column": "user_id"}, learner=L.tree())
    return cv.oof.select("event_id", "fold", "label", "pred", F.col("proba")[0].alias("p_no"), F.col("proba")[1].alias("p_yes"))


@query("cv_log1p")
def _cv_log(spark, d):
    o = priced_orders(spark, d)
    raw, log = (L.cross_validate(o, "amount", "o_orderkey", k=3, learner=L.tree(), transform=t) for t in (None, W.TargetTransform()))
    return raw.frame(space="raw").unionByName(log.frame(space="log1p"))


@query("compare_models")
def _compare(spark, d):
    return L.compare(L.constant(), L.linear(), priced_orders(spark, d), "amount", "o_orderkey", k=3, seeds=1, metric="r2")


@query("top_drivers")
def _drivers(spark, d):
    fitted = L.fit(priced_orders(spark, d), "amount", L.tree(), exclude=["o_orderkey"])
    return spark.createDataFrame(fitted.drivers(), "feature string, importance double")


def _before_after(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderdate < '1999-01-01'"), o.where("o_orderdate >= '1999-01-01'")


@query("adversarial_auc")
def _adversarial(spark, d):
    before, after = _before_after(spark, d)
    auc = L.adversarial_auc(before, after, "o_totalprice", "o_orderkey", exclude=["o_orderdate"])
    return spark.createDataFrame([(auc,)], "auc double")


@query("adversarial_univariate", """with s as (select o_orderkey, o_custkey, case when o_orderdate >= '1999-01-01' then 1 else 0 end as is_test from orders),
    l as (select 'o_orderkey' as c, is_test as y, o_orderkey::double as v from s union all select 'o_custkey', is_test, o_custkey from s)
    select c as "column", round(greatest(auc, 1 - auc), 8) as auc from """ + auc_sql("l", "y", "v", "c"))
def _univariate(spark, d):
    before, after = _before_after(spark, d)
    return L.univariate_shift(before, after, "o_totalprice").withColumn("auc", F.round("auc", 8))


@query("union_sides", """select source, is_test, count(*) as n, round(sum(o_custkey), 2) as total from (
    select 'train' as source, 0 as is_test, o_custkey::double as o_custkey from orders where o_orderdate < '1999-01-01'
    union all select 'test', 1, o_custkey from orders where o_orderdate >= '1999-01-01') group by 1, 2""")
def _sides(spark, d):
    before, after = _before_after(spark, d)
    both = L.label_sides(before, after, "o_totalprice")
    source = F.when(F.col("is_test") == 1, "test").otherwise("train")
    return both.groupBy(source.alias("source"), "is_test").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_custkey").cast("double")), 2).alias("total"))


# ---- backtests -----------------------------------------------------------------------------

def series_events(spark, d):
    """Daily-like demand per user: a trend, a user level and a column only known afterwards."""
    e = table(spark, d, "events").drop("props")
    return e.withColumns({"demand": F.col("value") * 2 + F.col("user_id") % 11 + F.dayofmonth("ts") * 0.3,
                          "closed_total": F.col("value") * 2 + F.col("user_id") % 11 + F.dayofmonth("ts") * 0.3 + F.col("event_id") % 3})


@query("future_features", """with s as (select *, value * 2 + user_id % 11 + day(ts) * 0.3 as demand from events), t as (select *, demand + event_id % 3 as closed_total from s)
    select 'closed_total' as "column", count(*) as n_pairs, round(abs(corr(closed_total, demand)), 8) as r_abs from t
    union all select 'user_id', count(*), round(abs(corr(user_id, demand)), 8) from t union all select 'event_type', 0, null""")
def _future(spark, d):
    return B.future_features(series_events(spark, d), "demand", ["closed_total", "user_id", "event_type", "ghost", "demand"]) \
            .withColumn("r_abs", F.round("r_abs", 8))


@query("split_design")
def _design(spark, d):
    return B.split_design(series_events(spark, d).drop("closed_total"), "demand", "ts", "event_id", learner=L.tree())


@query("series_boundary_auc")
def _boundary(spark, d):
    auc = B.series_boundary(series_events(spark, d), "demand", "ts", "event_id", "user_id")
    return spark.createDataFrame([(auc,)], "auc double")


@query("series_leak_null")
def _null(spark, d):
    # users join in the order of their id, so the id itself gives the boundary away
    e = table(spark, d, "events")
    return B.series_null(e.withColumn("user_id", F.floor(F.col("event_id") / 100)).select("event_id", "ts", "user_id", "value", "event_type"),
                         "value", "ts", "event_id", "user_id", exclude=["ts"])


@query("backtest_audit")
def _backtest(spark, d):
    return B.audit_backtest(series_events(spark, d), "demand", "ts", "event_id", suspects=["closed_total"], series="user_id", learner=L.tree())


# ---- gates and runs ------------------------------------------------------------------------

_HALF = UserFeature("noise", lambda t: None, lambda df, p: (keyed_hash(9, "o_orderkey") % 1000).cast("double"))


@query("feature_gate")
def _feature_gate(spark, d):
    o = priced_orders(spark, d)
    rank = UserFeature("rank", lambda t: None, lambda df, p: F.substring("o_orderpriority", 1, 1).cast("double"))
    climb = G.Climb(o, "amount", "o_orderkey", dict(k=3, learner=L.tree()))
    climb.features([_HALF, rank])
    return climb.records()


@query("drop_gate")
def _drop_gate(spark, d):
    plan = {"columns_to_drop": ["value", "event_type"]}
    climb = G.Climb(typed_events(spark, d), "late", "event_id", dict(k=3, learner=L.tree(), cleaning=plan))
    climb.keep_columns(["value"])
    return climb.records()


@query("framing_gate")
def _framing_gate(spark, d):
    climb = G.Climb(priced_orders(spark, d), "amount", "o_orderkey", dict(k=3, learner=L.tree()))
    climb.log_target()
    return climb.records()


@query("feasibility")
def _feasibility(spark, d):
    return W.feasibility(typed_events(spark, d), "late", "event_id", proposal={"strategy": "group", "group_column": "user_id"}, learner=L.tree())


@query("check_validation")
def _check(spark, d):
    return W.check_validation(typed_events(spark, d), "late", "event_id", {"strategy": "time", "time_column": "ts"}, learner=L.tree())


@query("run_cv_job")
def _run(spark, d):
    m = S.holdout(priced_orders(spark, d), "o_orderkey", 0.1)
    train, test = m.where("NOT held_out").drop("held_out"), m.where("held_out").drop("held_out", "amount")
    plans = W.Plans(folds={"strategy": "time_local", "time_column": "o_orderdate", "period_column": "month_of:o_orderdate"},
                    ordinals=[{"column": "o_orderpriority", "order": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}],
                    cleaning={"columns_to_drop": ["o_orderstatus"]},
                    features={"features": [{"op": "date_parts", "column": "o_orderdate", "parts": ["year", "month"]}]},
                    try_log_target=True)
    run = W.run_cv(train, "amount", "o_orderkey", plans, test=test, learner=L.tree())
    return run.submission


@query("run_holdout_job")
def _run_holdout(spark, d):
    return W.run_holdout(priced_orders(spark, d), "amount", "o_orderkey", W.Plans(cleaning={"columns_to_drop": ["o_orderstatus"]}), learner=L.tree())


@query("submission")
def _submission(spark, d):
    m = S.holdout(priced_orders(spark, d), "o_orderkey", 0.25)
    fitted = L.fit(m.where("NOT held_out").drop("held_out"), "amount", L.tree(), exclude=["o_orderkey"])
    return W.label_submission(fitted.predict(m.where("held_out"), ["o_orderkey"]), "o_orderkey", "amount", clip=True)


@query("paired_run")
def _paired(spark, d):
    treat = W.Plans(user_features=[target_encoding("user_value", "user_id", "value")])
    return W.paired_run(typed_events(spark, d), "late", "event_id", "accuracy", treat, learner=L.tree(4), k=2)


@query("graded_run")
def _graded(spark, d):
    e = typed_events(spark, d)
    work, features, answer = S.carve_key(e, "event_id", "late", 0.25, label="late")
    sample = features.select("event_id", F.lit(0.5).alias("no"), F.lit(0.5).alias("yes"))
    return W.graded_run(work, features, sample, answer, "log_loss", learner=L.tree(4), k=2, calibrate=True)


# ---- shapes of probability tables ----------------------------------------------------------

def _ids(spark, d):
    """Probability rows keyed by a dense id over orders."""
    o = table(spark, d, "orders")
    w = [1.0 + (F.col("o_orderkey") * a + F.col("o_custkey") * b) % 89 for a, b in ((29, 7), (13, 31), (5, 43))]
    return o.select("o_orderkey", F.array(*[x / (w[0] + w[1] + w[2]) for x in w]).alias("proba"))


_OW = [f"(1.0::double + (o_orderkey * {a} + o_custkey * {b}) % 89)" for a, b in ((29, 7), (13, 31), (5, 43))]
_OP = "op as (select o_orderkey, " + ", ".join(f"{w} / ({' + '.join(_OW)}) as p{i}" for i, w in enumerate(_OW)) + " from orders)"


@query("submission_proba", f"""with {_OP} select o_orderkey, round(p2, 10) as "R", round(p0, 10) as "A", round(p1, 10) as "N" from op""")
def _sub_proba(spark, d):
    out = W.proba_submission(_ids(spark, d), "o_orderkey", _CLASSES, ["R", "A", "N"])
    return out.withColumns({c: F.round(c, 10) for c in _CLASSES})


@query("topk_long", f"""with {_OP}, l as (select o_orderkey, 0 as i, 'A' as choice, p0 as p from op union all select o_orderkey, 1, 'N', p1 from op union all select o_orderkey, 2, 'R', p2 from op),
    r as (select o_orderkey, choice, row_number() over (partition by o_orderkey order by p desc, i) as place from l) select * from r where place <= 2""")
def _topk(spark, d):
    wide = _ids(spark, d).select("o_orderkey", *[F.col("proba")[i].alias(c) for i, c in enumerate(_CLASSES)])
    return W.top_k_long(wide, "o_orderkey", _CLASSES, 2)
