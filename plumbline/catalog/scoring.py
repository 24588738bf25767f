"""Queries on grading, metrics, calibration and paired decisions.

Prediction tables and score ledgers are derived from ``lineitem`` and ``orders``, so they grow with them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.registry import query, table
from plumbline.operators import decide as D
from plumbline.operators import grading as J
from plumbline.operators import metrics as M

# ---- derived prediction tables -------------------------------------------------------------

_CLASSES = ["A", "N", "R"]
_WEIGHTS = {"A": (29, 7), "N": (13, 31), "R": (5, 43)}


def predictions(spark, d):
    li = table(spark, d, "lineitem")
    h = (F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_suppkey") * 3 + F.col("l_linenumber")) % 11
    r = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 7) % 200
    w = [1.0 + (F.col("l_orderkey") * a + F.col("l_partkey") * b) % 89 + F.when(F.col("l_returnflag") == c, 60.0).otherwise(0.0)
         for c, (a, b) in _WEIGHTS.items()]
    total = w[0] + w[1] + w[2]
    return li.select(
        (F.col("l_suppkey") % 5).alias("fold"), F.col("l_returnflag").alias("flag"),
        F.when(h < 2, "A").when(h == 2, "N").when(h == 3, "R").otherwise(F.col("l_returnflag")).alias("flag_pred"),
        F.col("l_linenumber").alias("level"), F.greatest(F.lit(1), F.least(F.lit(7), F.col("l_linenumber") + F.when(h < 3, 1).when(h < 5, -2).otherwise(0))).alias("level_pred"),
        F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") * (0.9 + r / 1000.0) - 500).alias("price_pred"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        F.round(((F.col("l_partkey") * 31 + F.col("l_orderkey") * 17 + F.col("l_linenumber") * 5) % 997) / 997.0 * 0.7
                + F.when(F.col("l_returnflag") == "R", 0.3).otherwise(0.0), 3).alias("score"),
        F.when(F.col("l_quantity") > 40, 5.0).otherwise(1.0).alias("w"),
        F.when(F.col("l_discount") > 0.02, F.col("l_discount")).otherwise(0.0).alias("rate"), (F.col("l_tax") + 0.01).alias("rate_pred"),
        F.array(*[x / total for x in w]).alias("proba"))


_w = {c: f"(1.0 + (l_orderkey * {a} + l_partkey * {b}) % 89 + case when l_returnflag = '{c}' then 60.0 else 0.0 end)::double" for c, (a, b) in _WEIGHTS.items()}
_tot = "(" + " + ".join(_w.values()) + ")"
PRED = f"""pred as (select l_suppkey % 5 as fold, l_returnflag as flag, h, case when h < 2 then 'A' when h = 2 then 'N' when h = 3 then 'R' else l_returnflag end as flag_pred,
    l_linenumber as level, greatest(1, least(7, l_linenumber + case when h < 3 then 1 when h < 5 then -2 else 0 end)) as level_pred,
    l_extendedprice as price, l_extendedprice * (0.9 + ((l_orderkey * 31 + l_partkey * 7) % 200) / 1000.0) - 500 as price_pred,
    case when l_returnflag = 'R' then 1 else 0 end as returned,
    round(((l_partkey * 31 + l_orderkey * 17 + l_linenumber * 5) % 997) / 997.0 * 0.7::double + case when l_returnflag = 'R' then 0.3::double else 0 end, 3) as score,
    case when l_quantity > 40 then 5.0 else 1.0 end as w, case when l_discount > 0.02 then l_discount else 0 end as rate, l_tax + 0.01 as rate_pred,
    {', '.join(f'{_w[c]} / {_tot} as p_{c}' for c in _CLASSES)}
    from (select *, (l_orderkey * 7 + l_partkey * 13 + l_suppkey * 3 + l_linenumber) % 11 as h from lineitem))"""


def _named(spark, d, label, pred, *extra):
    return predictions(spark, d).select("fold", F.col(label).alias("label"), F.col(pred).alias("pred"), *extra)


def _rounded(df, *cols, digits=8):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ---- joins ---------------------------------------------------------------------------------

@query("grade_join", """select round(avg(case when l.quality = (case when d.n_chars % 3 = 0 then 0 else 1 end) then 1.0 else 0.0 end), 8) as accuracy, count(*) as n
    from labels l join documents d using (doc_id)""")
def _grade(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") % 3 == 0, 0).otherwise(1).alias("quality"))
    return _rounded(J.grade(table(spark, d, "labels"), docs, "doc_id", "quality", "accuracy"), "accuracy")


@query("grade_uncovered", "select doc_id from labels where doc_id not in (select doc_id from documents where n_chars % 4 <> 1)")
def _uncovered(spark, d):
    docs = table(spark, d, "documents").where(F.col("n_chars") % 4 != 1)
    return J.uncovered(table(spark, d, "labels"), docs, "doc_id").select("doc_id")


@query("common_support", """with o as (select o_orderkey, o_totalprice as y, case when o_orderkey % 10 < 8 then o_totalprice * 1.1 end as a,
        case when o_orderkey % 3 <> 0 then o_totalprice * (0.8 + (o_custkey % 40) / 100.0) end as b from orders)
    select count(*) as n, round(sqrt(avg(pow(ln(1 + a) - ln(1 + y), 2))), 8) as rmsle_a, round(sqrt(avg(pow(ln(1 + b) - ln(1 + y), 2))), 8) as rmsle_b
    from o where a is not null and b is not null""")
def _common(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_totalprice", "label")
    a = o.withColumn("pred", F.when(F.col("o_orderkey") % 10 < 8, F.col("label") * 1.1))
    b = o.withColumn("pred", F.when(F.col("o_orderkey") % 3 != 0, F.col("label") * (0.8 + (F.col("o_custkey") % 40) / 100.0)))
    both = J.common_support(a, b, "o_orderkey").select("label", F.inline(F.array(*[
        F.struct(F.lit(x).alias("arm"), F.col(f"pred_{x}").alias("pred")) for x in "ab"])))
    s = M.rmsle(both, ["arm"]).groupBy().agg(F.max("n").alias("n"), *[F.max(F.when(F.col("arm") == x, F.col("rmsle"))).alias(f"rmsle_{x}") for x in "ab"])
    return _rounded(s, "rmsle_a", "rmsle_b")


def references(spark, d):
    p = table(spark, d, "pages")
    url = F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit("?invented"))).otherwise(F.col("url"))
    return p.select((F.col("page_id") % 60).alias("brief"), url.alias("url")), p.where(F.col("page_id") % 3 != 1).select("url")


@query("ground_refs", """with r as (select page_id % 60 as brief, case when page_id % 4 = 0 then url||'?invented' else url end as url from pages),
    e as (select distinct url as u from pages where page_id % 3 <> 1)
    select brief, count(u) as n_kept, count(*) - count(u) as n_dropped, count(u) > 0 as grounded from r left join e on url = u group by brief""")
def _ground(spark, d):
    return J.ground_references(*references(spark, d))


@query("dropped_refs", """with r as (select page_id % 60 as brief, case when page_id % 4 = 0 then url||'?invented' else url end as url from pages)
    select brief, url from r where url not in (select url from pages where page_id % 3 <> 1)""")
def _dropped(spark, d):
    return J.dropped_references(*references(spark, d)).select("brief", "url")


# ---- label and regression metrics ----------------------------------------------------------

def _cls(extra=""):
    return f"""{PRED}, cm as (select flag as label, flag_pred as pred, count(*)::double as n from pred group by 1, 2),
    t as (select label as c, sum(n) as n_true, sum(n) filter (where label = pred) as hit from cm group by 1), p as (select pred as c, sum(n) as n_pred from cm group by 1),
    k as (select coalesce(t.c, p.c) as c, coalesce(n_true, 0) as n_true, coalesce(n_pred, 0) as n_pred, coalesce(hit, 0) as hit from t full join p on t.c = p.c)"""


@query("m_accuracy", f"with {PRED} select round(avg(case when flag = flag_pred then 1.0 else 0.0 end), 8) as accuracy from pred")
def _accuracy(spark, d):
    return _rounded(M.accuracy(_named(spark, d, "flag", "flag_pred")), "accuracy")


@query("m_bal_acc", f"with {_cls()} select round(avg(hit / n_true), 8) as balanced_accuracy from k where n_true > 0")
def _bal(spark, d):
    return _rounded(M.balanced_accuracy(_named(spark, d, "flag", "flag_pred")), "balanced_accuracy")


@query("m_f1_macro", f"with {_cls()} select round(avg(coalesce(2 * hit / nullif(n_true + n_pred, 0), 0)), 8) as f1_macro from k")
def _f1m(spark, d):
    return _rounded(M.f1_macro(_named(spark, d, "flag", "flag_pred")), "f1_macro")


@query("m_f1", f"with {_cls()} select round(2 * hit / (n_true + n_pred), 8) as f1 from k where c = 'R'")
def _f1(spark, d):
    return _rounded(M.f1(_named(spark, d, "flag", "flag_pred"), "R"), "f1")


@query("m_mcc", f"""with {_cls()} select round((sum(hit) * sum(n_true) - sum(n_true * n_pred)) /
    sqrt((pow(sum(n_true), 2) - sum(n_pred * n_pred)) * (pow(sum(n_true), 2) - sum(n_true * n_true))), 8) as mcc from k""")
def _mcc(spark, d):
    return _rounded(M.mcc(_named(spark, d, "flag", "flag_pred")), "mcc")


@query("m_qwk", f"""with {PRED}, cm as (select level as i, level_pred as j, count(*)::double as n from pred group by 1, 2), s as (select sum(n) as s from cm),
    a as (select i, sum(n) as a from cm group by 1), b as (select j, sum(n) as b from cm group by 1)
    select round(1 - (select sum(n * pow(i - j, 2)) from cm) / (select sum(a * b / s * pow(i - j, 2)) from a, b, s), 8) as quadratic_weighted_kappa""")
def _qwk(spark, d):
    return _rounded(M.quadratic_weighted_kappa(_named(spark, d, "level", "level_pred")), "quadratic_weighted_kappa")


@query("m_regression", f"""with {PRED}, m as (select avg(price) as mu from pred) select round(-sqrt(avg(pow(price - price_pred, 2))), 5) as rmse, round(-avg(abs(price - price_pred)), 5) as mae,
    round(1 - sum(pow(price - price_pred, 2)) / sum(pow(price - mu, 2)), 8) as r2 from pred, m""")
def _reg(spark, d):
    out = M.regression(_named(spark, d, "price", "price_pred"), negate=True)
    return _rounded(_rounded(out, "rmse", "mae", digits=5), "r2")


@query("m_rmsle", f"with {PRED} select round(sqrt(avg(pow(ln(1 + greatest(price_pred, 0)) - ln(1 + price), 2))), 8) as rmsle, count(*) as n from pred")
def _rmsle(spark, d):
    return _rounded(M.rmsle(_named(spark, d, "price", "price_pred")), "rmsle")


@query("m_rmspe", f"with {PRED} select fold, round(coalesce(sqrt(avg(pow((rate - rate_pred) / rate, 2)) filter (where rate <> 0)), 0), 8) as rmspe from pred group by fold")
def _rmspe(spark, d):
    return _rounded(M.rmspe(_named(spark, d, "rate", "rate_pred"), ["fold"]), "rmspe")


@query("m_wmae", f"with {PRED} select round(sum(w * abs(price - price_pred)) / sum(w), 5) as wmae from pred")
def _wmae(spark, d):
    return _rounded(M.weighted_mae(_named(spark, d, "price", "price_pred", "w"), "w"), "wmae", digits=5)


# ---- probability metrics -------------------------------------------------------------------

def auc_sql(source: str, label: str, score: str, by: str = "") -> str:
    """Average-rank AUC of a relation, grouped when ``by`` names columns."""
    part = f"partition by {by}" if by else ""
    group = f"group by {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""(select {keys}(sum(r) filter (where y = 1) - pos * (pos + 1) / 2) / (pos * neg) as auc from (
        select {keys}{label} as y, rank() over ({part} order by {score}) + (count(*) over (partition by {keys}{score}) - 1) / 2.0::double as r,
        (count(*) filter (where {label} = 1) over ({part}))::double as pos, (count(*) filter (where {label} = 0) over ({part}))::double as neg from {source}) {group or 'group by'} {', ' if by else ''}pos, neg)"""


@query("m_auc", f"with {PRED} select round(auc, 8) as roc_auc from {auc_sql('pred', 'returned', 'score')}")
def _auc(spark, d):
    return _rounded(M.roc_auc(predictions(spark, d).select(F.col("returned").alias("label"), "score")), "roc_auc")


@query("m_auc_by_fold", f"with {PRED} select fold, round(auc, 8) as roc_auc from {auc_sql('pred', 'returned', 'score', 'fold')}")
def _auc_fold(spark, d):
    return _rounded(M.roc_auc(predictions(spark, d).select("fold", F.col("returned").alias("label"), "score"), ["fold"]), "roc_auc")


@query("m_auc_ovr", f"""with {PRED}, l as (""" + " union all ".join(
    f"select '{c}' as c, case when flag = '{c}' then 1 else 0 end as y, p_{c} as s from pred" for c in _CLASSES) + f""")
    select round(avg(auc), 8) as roc_auc_ovr from {auc_sql('l', 'y', 's', 'c')}""")
def _ovr(spark, d):
    return _rounded(M.roc_auc_ovr(predictions(spark, d).select(F.col("flag").alias("label"), "proba"), _CLASSES), "roc_auc_ovr")


_PTRUE = "case flag " + " ".join(f"when '{c}' then p_{c}" for c in _CLASSES) + " end"


@query("m_log_loss", f"with {PRED} select round(avg(-ln(greatest(least({_PTRUE}, 1 - {M.EPSILON}), {M.EPSILON}))), 8) as log_loss from pred")
def _ll(spark, d):
    return _rounded(M.log_loss(predictions(spark, d).select(F.col("flag").alias("label"), "proba"), _CLASSES), "log_loss")


@query("m_per_fold", f"""with {PRED} select fold, count(*) as n, round(sqrt(avg(pow(price - price_pred, 2))), 5) as rmse,
    round(sqrt(avg(pow(ln(1 + greatest(price_pred, 0)) - ln(1 + price), 2))), 8) as rmsle from pred group by grouping sets ((fold), ())""")
def _per_fold(spark, d):
    e = F.col("label") - F.col("pred")
    le = F.log1p(F.greatest(F.col("pred"), F.lit(0.0))) - F.log1p(F.col("label"))
    return M.per_fold_and_pooled(_named(spark, d, "price", "price_pred"), [
        F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 5).alias("rmse"), F.round(F.sqrt(F.avg(le * le)), 8).alias("rmsle")])


_ASKED = ["rmse", "auc", "quadratic_weighted_kappa", "ndcg", "log_loss", "f1", None]


@query("metric_mode", f"""with a as (select o_custkey % 7 as i, count(*) as n from orders group by 1), m as (select i, n, ([{', '.join(f"'{x}'" if x else 'null' for x in _ASKED)}])[i + 1] as metric from a)
    select metric, n, case when metric is null then 'default' when metric in ('roc_auc', 'auc', 'log_loss') then 'proba'
    when metric in ('accuracy','balanced_accuracy','f1','f1_macro','mcc','rmse','mae','r2') then 'aligned' when metric = 'quadratic_weighted_kappa' then 'oof' else 'mismatch' end as mode,
    case metric when 'auc' then 'roc_auc' when 'log_loss' then 'log_loss' when 'rmse' then 'root_mean_squared_error' when 'f1' then 'f1' end as optimised from m""")
def _mode(spark, d):
    names = F.array(*[F.lit(x) for x in _ASKED])
    asked = table(spark, d, "orders").groupBy((F.col("o_custkey") % 7).cast("int").alias("i")).agg(F.count("*").alias("n"))
    mode, optimised = M.metric_mode(F.col("metric"))
    return asked.select(names[F.col("i")].alias("metric"), "n").select("metric", "n", mode.alias("mode"), optimised.alias("optimised"))


@query("temp_apply", f"""with {PRED}, q as (select flag, {', '.join(f'pow(p_{c}, 1 / 2.5) as q_{c}' for c in _CLASSES)} from pred)
    select flag, {', '.join(f'round(avg(q_{c} / (q_A + q_N + q_R)), 8) as p_{c.lower()}' for c in _CLASSES)} from q group by flag""")
def _temp(spark, d):
    p = predictions(spark, d).select("flag", M.apply_temperature(F.col("proba"), 2.5).alias("q"))
    return p.groupBy("flag").agg(*[F.round(F.avg(F.col("q")[i]), 8).alias(f"p_{c.lower()}") for i, c in enumerate(_CLASSES)])


@query("temp_fit", f"""with {PRED}, g as (select unnest([{', '.join(repr(t) for t in M._log_grid(0.05, 20.0, 24))}]::double[]) as t),
    l as (select t, avg(-ln(greatest(least(pow({_PTRUE}, 1 / t) / ({' + '.join(f'pow(p_{c}, 1 / t)' for c in _CLASSES)}), 1 - {M.EPSILON}), {M.EPSILON}))) as loss from pred, g group by t)
    select round(arg_min(t, loss), 8) as temperature, round(min(loss), 8) as loss, (select round(avg(-ln({_PTRUE})), 8) from pred) as loss_at_1 from l""")
def _fit_temp(spark, d):
    t = M.fit_temperature(predictions(spark, d).select(F.col("flag").alias("label"), "proba"), _CLASSES, passes=1)
    return _rounded(spark.createDataFrame([t], "temperature double, loss double, loss_at_1 double"), "temperature", "loss", "loss_at_1")


# ---- score ledger --------------------------------------------------------------------------

LED = """led as (select 'task_'||lpad((l_partkey % 40)::varchar, 2, '0') as task, (l_partkey % 40) % 2 = 0 as higher_is_better, l_suppkey % 5 as seed, l_linenumber % 3 as fold,
    round(avg(l_discount), 6) as base, round(avg(l_tax) + 0.01 + (((l_partkey % 40) % 5) - 2) * 0.004, 6) as trial from lineitem group by l_partkey % 40, l_suppkey % 5, l_linenumber % 3)"""


def ledger(spark, d):
    t = F.col("l_partkey") % 40
    li = table(spark, d, "lineitem").groupBy(t.alias("t"), (F.col("l_suppkey") % 5).alias("seed"), (F.col("l_linenumber") % 3).alias("fold"))
    s = li.agg(F.round(F.avg("l_discount"), 6).alias("base"), F.avg("l_tax").alias("_tax"))
    return s.select(F.concat(F.lit("task_"), F.lpad(F.col("t").cast("string"), 2, "0")).alias("task"), (F.col("t") % 2 == 0).alias("higher_is_better"),
                    "seed", "fold", "base", F.round(F.col("_tax") + 0.01 + ((F.col("t") % 5) - 2) * 0.004, 6).alias("trial"))


def paired_sql(source: str, delta: str, by: str, ratio: str) -> str:
    return f"""(select *, case when n >= 2 then 2 * sd * sqrt(1.0::double / n + {ratio}) else 'infinity'::double end as mde,
        coalesce(n >= 2 and mean_delta > greatest(1e-4, 2 * sd * sqrt(1.0::double / n + {ratio})) and up * 2 > n, false) as better,
        coalesce(n >= 2 and -mean_delta > greatest(1e-4, 2 * sd * sqrt(1.0::double / n + {ratio})) and down * 2 > n, false) as worse from (
        select {by}, count({delta}) as n, avg({delta}) as mean_delta, stddev_samp({delta}) as sd, count(*) filter (where {delta} > 0) as up,
        count(*) filter (where {delta} < 0) as down from {source} group by {by}))"""


_SGN = "(case when higher_is_better then trial - base else base - trial end)"


@query("paired_scores", f"with {LED} select * from led")
def _pairs(spark, d):
    long = ledger(spark, d).select("task", "higher_is_better", "seed", "fold", F.inline(F.array(
        F.struct(F.lit("baseline").alias("arm"), F.col("base").alias("score")), F.struct(F.lit("treatment").alias("arm"), F.col("trial").alias("score")))))
    return J.paired_arms(long, ["task", "higher_is_better", "seed", "fold"])


@query("paired_test", f"with {LED} select task, n, round(mean_delta, 8) as mean_delta, better, worse from {paired_sql('led', _SGN, 'task', '0.5')}")
def _paired(spark, d):
    s = D.paired_summary(ledger(spark, d).withColumn("delta", D.signed(F.col("base"), F.col("trial"), F.col("higher_is_better"))), ["task"], 0.5)
    return s.select("task", "n", F.round("mean_delta", 8).alias("mean_delta"), "better", "worse")


@query("paired_mde", f"with {LED} select task, n, round(sd, 8) as sd, round(mde, 8) as mde from {paired_sql('led', _SGN, 'task', '0.5')}")
def _mde(spark, d):
    s = D.paired_summary(ledger(spark, d).withColumn("delta", D.signed(F.col("base"), F.col("trial"), F.col("higher_is_better"))), ["task"], 0.5)
    return _rounded(s.select("task", "n", "sd", "mde"), "sd", "mde")


_ONE = "one as (select *, 0.002::double as base_std from led where not (task < 'task_05' and fold > 0))"


def _one(spark, d):
    return ledger(spark, d).where(~((F.col("task") < "task_05") & (F.col("fold") > 0))).withColumn("base_std", F.lit(0.002))


@query("improves", f"""with {LED}, {_ONE}, same as (select task, seed, bool_and(base = trial) as same from one group by 1, 2),
    p as (select task, seed, n, mean_delta, case when n >= 2 then better else mean_delta > 0.004 end as accepted
    from {paired_sql('one', _SGN, 'task, seed', '(case when n > 1 then 1.0::double / (n - 1) else 0 end)')})
    select task, seed, n, round(mean_delta, 8) as delta, accepted, same and not accepted as no_effect from p join same using (task, seed)""")
def _improves(spark, d):
    return _rounded(D.improves(_one(spark, d), ["task", "seed"]), "delta")


@query("compare_verdict", f"""with {LED} select task, n, round(mean_delta, 8) as mean_delta, round(mde, 8) as mde, case when n < 2 then 'underpowered' when better then 'improved' else 'no_improvement' end as verdict
    from {paired_sql('led', '(trial - base)', 'task', '0.5')}""")
def _compare(spark, d):
    return _rounded(D.compare_verdict(ledger(spark, d), ["task"], 3), "mean_delta", "mde")


SEEDS = f"""seeds as (select task, bool_and(higher_is_better) as higher_is_better, seed, avg(base) as baseline, avg(trial) as treatment,
    case when (seed + substr(task, 6)::int) % 7 = 0 or task = 'task_39' then 'RuntimeError: fit failed' end as error from led group by task, seed)"""


def seed_runs(spark, d):
    failed = ((F.col("seed") + F.substring("task", 6, 2).cast("int")) % 7 == 0) | (F.col("task") == "task_39")
    return ledger(spark, d).groupBy("task", "seed").agg(
        F.bool_and("higher_is_better").alias("higher_is_better"), F.avg("base").alias("baseline"), F.avg("trial").alias("treatment")) \
        .withColumn("error", F.when(failed, "RuntimeError: fit failed"))


MULTI = f"""multi as (select s.task, n as n_seeds, x.mean_delta, mde, case when n = 0 then 'failed' when better then 'treatment' when worse then 'baseline' else 'undecided' end as verdict, failed_seeds
    from {paired_sql('(select *, case when error is null then case when higher_is_better then treatment - baseline else baseline - treatment end end as d from seeds)', 'd', 'task', '(0.25::double / 0.75)')} s
    join (select task, avg(treatment - baseline) filter (where error is null) as mean_delta, coalesce(string_agg(case when error is not null then seed::varchar end, '|' order by seed), '') as failed_seeds from seeds group by task) x using (task))"""


def multi_seed(spark, d):
    return D.multi_seed_verdict(seed_runs(spark, d), ["task"]).withColumn("failed_seeds", F.array_join(F.col("failed_seeds").cast("array<string>"), "|"))


@query("multi_seed_verdict", f"with {LED}, {SEEDS}, {MULTI} select task, n_seeds, round(mean_delta, 8) as mean_delta, round(mde, 8) as mde, verdict, failed_seeds from multi")
def _multi(spark, d):
    return _rounded(multi_seed(spark, d), "mean_delta", "mde")


@query("winner", f"""with {LED}, s as (select task, seed, higher_is_better, case when seed = 4 then 0 else avg(trial - base) end as delta from led group by 1, 2, 3)
    select task, seed, case when abs(delta) < 1e-9 then 'tie' when (delta > 0) = higher_is_better then 'treatment' else 'baseline' end as winner from s""")
def _winner(spark, d):
    s = ledger(spark, d).groupBy("task", "seed", "higher_is_better").agg(F.avg(F.col("trial") - F.col("base")).alias("_d"))
    delta = F.when(F.col("seed") == 4, 0.0).otherwise(F.col("_d"))
    return s.select("task", "seed", D.winner(delta, F.col("higher_is_better")).alias("winner"))


@query("backtest_gap", f"""with {LED} select task, seed, n as n_origins, round(mean_delta, 8) as mean_gap, round(mde, 8) as mde, case when better then 'optimistic (dangerous)'
    when worse then 'pessimistic (safe)' else 'undecided' end as direction from {paired_sql('led', '(case when higher_is_better then base - trial else trial - base end)', 'task, seed', '(case when n > 1 then 1.0::double / (n - 1) else 0 end)')}""")
def _gap(spark, d):
    pairs = ledger(spark, d).withColumnsRenamed({"base": "naive", "trial": "corrected"})
    return _rounded(D.backtest_gap(pairs, ["task", "seed"]), "mean_gap", "mde")


_DIR = "case when gap > 1e-9 then 'optimistic (dangerous)' when gap < -1e-9 then 'pessimistic (safe)' else 'negligible' end"


@query("optimism_gap", f"""with {LED}, m as (select task, higher_is_better, avg(base) as a, avg(trial) as b from led group by 1, 2),
    g as (select task, a, b, case when higher_is_better then a - b else b - a end as gap from m)
    select task, round(a, 8) as naive_mean, round(b, 8) as recommended_mean, round(gap, 8) as gap, {_DIR} as direction from g""")
def _optimism(spark, d):
    long = ledger(spark, d).select("task", "higher_is_better", F.inline(F.array(
        F.struct(F.lit("naive").alias("arm"), F.col("base").alias("score")), F.struct(F.lit("recommended").alias("arm"), F.col("trial").alias("score")))))
    return _rounded(D.optimism_gap(long, ["task"]), "naive_mean", "recommended_mean", "gap")


_MODES = ["aligned", "proba", "oof", "mismatch"]


@query("cv_lb_gap", f"""with {LED}, m as (select task, substr(task, 6)::int % 4 as i, avg(base) as cv_score, avg(trial) as external_score from led group by 1)
    select task, (['aligned', 'proba', 'oof', 'mismatch'])[i + 1] as mode, round(case when i < 3 then cv_score - external_score end, 8) as gap from m""")
def _cv_lb(spark, d):
    mode = F.array(*[F.lit(m) for m in _MODES])[F.substring("task", 6, 2).cast("int") % 4]
    runs = ledger(spark, d).groupBy("task").agg(F.avg("base").alias("cv_score"), F.avg("trial").alias("external_score")).withColumn("mode", mode)
    return _rounded(D.cv_gap(runs).select("task", "mode", "gap"), "gap")


@query("outcome_reason", f"""with {LED}, s as (select task, seed, fold, higher_is_better, base, case when task like '%7' then base else trial end as trial, seed < 4 as ran from led),
    m as (select *, case when ran then {_SGN} end as d, base = trial as same from s), agg as (select task, seed, bool_and(ran) as ran, bool_and(same) as same from m group by 1, 2)
    select p.task, p.seed, round(mean_delta, 8) as cv_delta, better as accepted, case when not ran then 'budget_exhausted' when better then 'improved' when same then 'no_effect' else 'no_improvement' end as reason
    from {paired_sql('m', 'd', 'task, seed', '(case when n > 1 then 1.0::double / (n - 1) else 0 end)')} p join agg using (task, seed)""")
def _reason(spark, d):
    pairs = ledger(spark, d).withColumns({"trial": F.when(F.col("task").like("%7"), F.col("base")).otherwise(F.col("trial")), "ran": F.col("seed") < 4})
    return _rounded(D.outcome_reasons(pairs, ["task", "seed"], "ran"), "cv_delta")


@query("budget_spend", """with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as p from orders)
    select o_custkey as run, o_orderkey as trial, case when p <= 3 then 'measured' else 'budget_exhausted' end as status from r""")
def _budget(spark, d):
    trials = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("trial"))
    return D.spend_budget(trials, "run", "trial", 3)


@query("cv_summary", f"with {LED} select task, seed, round(avg(base), 8) as mean, round(stddev_pop(base), 8) as std, count(*) as n_folds from led group by 1, 2")
def _cv(spark, d):
    return _rounded(D.cv_summary(ledger(spark, d).withColumn("score", F.col("base")), ["task", "seed"]), "mean", "std")


@query("null_band", f"""with {LED}, o as (select task, max(trial) as observed from led group by 1), b as (select task, avg(base) as null_mean, quantile_cont(base, 0.95) as null_p95, count(*) as n_perm from led group by 1)
    select task, observed, round(null_mean, 8) as null_mean, round(null_p95, 8) as null_p95, n_perm, case when observed > null_p95 + 0.02 then 'leaking' else 'not leaking' end as verdict from o join b using (task)""")
def _band(spark, d):
    led = ledger(spark, d)
    out = D.null_band(led.groupBy("task").agg(F.max("trial").alias("observed")), led.withColumn("score", F.col("base")), ["task"])
    return _rounded(out, "null_mean", "null_p95")


@query("backtest_risk", f"""with {LED}, g as (select task, case when better then 'optimistic (dangerous)' when worse then 'pessimistic (safe)' else 'undecided' end as direction
        from {paired_sql('led', '(case when higher_is_better then base - trial else trial - base end)', 'task', '(case when n > 1 then 1.0::double / (n - 1) else 0 end)')}),
    f as (select task, 'split_design' as c, direction as detail from g union all select task, 'series_auc', '1.0' from g
          union all select task, 'series_null', case when substr(task, 6)::int % 9 = 0 then 'leaking' else 'not leaking' end from g
          union all select task, 'future_feature', 'x' from g where substr(task, 6)::int % 8 = 3)
    select task, case when bool_or(bad) then 'high' else 'low' end as risk, count(*) filter (where bad) as n_drivers from (select *, c = 'future_feature' or (c = 'split_design' and detail = 'optimistic (dangerous)')
        or (c = 'series_null' and detail = 'leaking') as bad from f) group by 1""")
def _risk(spark, d):
    pairs = ledger(spark, d).withColumnsRenamed({"base": "naive", "trial": "corrected"})
    gaps = D.backtest_gap(pairs, ["task"])
    i = F.substring("task", 6, 2).cast("int")
    rows = F.array_compact(F.array(
        F.struct(F.lit("split_design").alias("check"), F.col("direction").alias("detail")), F.struct(F.lit("series_auc").alias("check"), F.lit("1.0").alias("detail")),
        F.struct(F.lit("series_null").alias("check"), F.when(i % 9 == 0, "leaking").otherwise("not leaking").alias("detail")),
        F.when(i % 8 == 3, F.struct(F.lit("future_feature").alias("check"), F.lit("x").alias("detail")))))
    return D.backtest_risk(gaps.select("task", F.inline(rows)), ["task"])


FACT = """fact as (select case when l_suppkey % 2 = 0 then 'random' else 'time_local' end as design, l_linenumber % 3 as fold, case when l_partkey % 2 = 0 then 'raw' else 'log1p' end as space,
    round(-sqrt(avg(pow(l_extendedprice * (l_discount - l_tax), 2))), 6) as rmse, round(-sqrt(avg(pow(l_discount - l_tax, 2))), 8) as rmsle from lineitem group by 1, 2, 3)"""


@query("factorial_verdict", f"""with {FACT}, l as (select design, fold, 'rmse' as metric, space, rmse as score from fact union all select design, fold, 'rmsle', space, rmsle from fact),
    w as (select design, fold, metric, max(score) filter (where space = 'log1p') - max(score) filter (where space = 'raw') as d from l group by 1, 2, 3)
    select design, metric, round(mean_delta, 7) as delta, round(mde, 7) as mde, better as accepted from {paired_sql('w', 'd', 'design, metric', '(case when n > 1 then 1.0::double / (n - 1) else 0 end)')}""")
def _factorial(spark, d):
    gap = F.col("l_discount") - F.col("l_tax")
    scores = table(spark, d, "lineitem").groupBy(F.when(F.col("l_suppkey") % 2 == 0, "random").otherwise("time_local").alias("design"), (F.col("l_linenumber") % 3).alias("fold"),
                                                 F.when(F.col("l_partkey") % 2 == 0, "raw").otherwise("log1p").alias("space")).agg(
        F.round(-F.sqrt(F.avg(F.pow(F.col("l_extendedprice") * gap, 2))), 6).alias("rmse"), F.round(-F.sqrt(F.avg(F.pow(gap, 2))), 8).alias("rmsle"))
    return _rounded(D.factorial_verdict(scores, ["design"], ["rmse", "rmsle"]), "delta", "mde", digits=7)


@query("cv_truth_gap", f"""with {LED}, cv as (select task, 'seed_'||seed as arm, bool_and(higher_is_better) as higher_is_better, avg(base) as mean from led group by 1, 2),
    t as (select task, avg(trial) as truth from led group by 1), g as (select task, arm, case when higher_is_better then mean - truth else truth - mean end as gap from cv join t using (task))
    select task, arm, round(gap, 8) as gap, {_DIR} as direction from g""")
def _truth(spark, d):
    led = ledger(spark, d)
    cv = led.groupBy("task", F.concat(F.lit("seed_"), F.col("seed").cast("string")).alias("arm")).agg(F.bool_and("higher_is_better").alias("higher_is_better"), F.avg("base").alias("mean"))
    out = D.truth_gap(cv, led.groupBy("task").agg(F.avg("trial").alias("truth")), ["task"])
    return _rounded(out.select("task", "arm", "gap", "direction"), "gap")
