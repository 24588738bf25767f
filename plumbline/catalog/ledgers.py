"""Queries over run ledgers derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.registry import query, table
from plumbline.catalog.scoring import LED, MULTI, SEEDS, ledger, multi_seed, seed_runs
from plumbline.plans import ledger_views as V


def runs(spark, d):
    """Every order is one run of some table, target and arm."""
    o = table(spark, d, "orders")
    m = F.map_filter(F.create_map(
        F.lit("rmse"), F.col("o_totalprice") / 1000, F.lit("mae"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") / 1500),
        F.lit("r2"), F.when(F.col("o_custkey") % 5 != 0, (F.col("o_orderkey") % 100) / 100.0)), lambda k, v: v.isNotNull())
    return o.select(F.concat(F.lit("csv_"), F.col("o_custkey") % 100).alias("source"), F.concat(F.lit("y"), F.col("o_custkey") % 3).alias("target"),
                    F.when(F.col("o_orderkey") % 2 == 0, "baseline").otherwise("treatment").alias("arm"), "o_orderdate", "o_orderkey", m.alias("metrics"))


_LATEST = """r as (select 'csv_'||(o_custkey % 100) as source, 'y'||(o_custkey % 3) as target, o_orderkey % 2 = 0 as is_base, o_orderdate, o_orderkey,
    o_totalprice / 1000 as rmse, case when o_orderkey % 3 <> 0 then o_totalprice / 1500 end as mae, case when o_custkey % 5 <> 0 then (o_orderkey % 100) / 100.0::double end as r2 from orders),
    p as (select *, row_number() over (partition by source, target, is_base order by o_orderdate desc, o_orderkey desc) as p from r)"""


@query("ledger_compare", f"with {_LATEST}" + ", u as (" + " union all ".join(
    f"select b.source, b.target, '{m}' as metric, b.{m} as baseline, t.{m} as treatment from p b join p t on b.source = t.source and b.target = t.target and b.is_base and not t.is_base and b.p = 1 and t.p = 1"
    for m in ("rmse", "mae", "r2")) + ") select source, target, metric, round(baseline, 8) as baseline, round(treatment, 8) as treatment, round(treatment - baseline, 8) as delta from u where baseline is not null and treatment is not null")
def _compare(spark, d):
    out = V.latest_pair(runs(spark, d), ["source", "target"], ["o_orderdate", "o_orderkey"])
    return out.withColumns({c: F.round(c, 8) for c in ("baseline", "treatment", "delta")})


@query("ledger_decided", f"""with {LED}, {SEEDS}, {MULTI} select task as name, verdict, n_seeds, round(mean_delta, 8) as delta from multi
    where verdict in ('treatment', 'baseline') order by task desc limit 5""")
def _decided(spark, d):
    rows = multi_seed(spark, d).withColumn("kind", F.lit("multi_seed"))
    return V.decided(rows, [F.desc("task")]).select(F.col("task").alias("name"), "verdict", "n_seeds", F.round("mean_delta", 8).alias("delta"))


@query("ledger_board", f"""with {LED}, {SEEDS}, {MULTI}, s as (select task||'/'||seed as name, avg(base) as baseline, avg(trial) as treatment, avg(trial - base) as delta, bool_and(higher_is_better) as h, null as verdict from led group by task, seed),
    m as (select task||' (n='||n_seeds||' seeds)' as name, b.baseline, b.treatment, mean_delta as delta, h, verdict from multi join (select task, avg(baseline) as baseline, avg(treatment) as treatment, bool_and(higher_is_better) as h from seeds group by 1) b using (task)),
    a as (select * from s union all select * from m)
    select name, 'rmse' as metric, round(baseline, 8) as baseline, round(treatment, 8) as treatment, round(delta, 8) as delta,
    coalesce(verdict, case when abs(delta) < 1e-9 then 'tie' when (delta > 0) = h then 'treatment' else 'baseline' end) as winner from a""")
def _board(spark, d):
    single = ledger(spark, d).groupBy(F.concat_ws("/", "task", "seed").alias("name")).agg(
        F.avg("base").alias("baseline"), F.avg("trial").alias("treatment"), F.avg(F.col("trial") - F.col("base")).alias("delta"),
        F.bool_and("higher_is_better").alias("higher_is_better")).withColumn("verdict", F.lit(None).cast("string"))
    means = seed_runs(spark, d).groupBy("task").agg(F.avg("baseline").alias("baseline"), F.avg("treatment").alias("treatment"), F.bool_and("higher_is_better").alias("higher_is_better"))
    multi = multi_seed(spark, d).join(means, "task").select(
        F.concat("task", F.lit(" (n="), F.col("n_seeds").cast("string"), F.lit(" seeds)")).alias("name"), "baseline", "treatment",
        F.col("mean_delta").alias("delta"), "higher_is_better", "verdict")
    out = V.board(single.unionByName(multi).withColumn("metric", F.lit("rmse")))
    return out.withColumns({c: F.round(c, 8) for c in ("baseline", "treatment", "delta")})


@query("fold_label", """with s as (select o_custkey % 5 as i, o_orderpriority as c, count(*) as n from orders group by 1, 2)
    select case i when 0 then 'group:'||c when 1 then 'time:'||c when 2 then 'time_local:'||c when 3 then 'random' end as label, n from s""")
def _label(spark, d):
    s = table(spark, d, "orders").groupBy((F.col("o_custkey") % 5).alias("i"), F.col("o_orderpriority").alias("c")).agg(F.count("*").alias("n"))
    i, c = F.col("i"), F.col("c")
    strategy = F.when(i == 0, "group").when(i == 1, "time").when(i == 2, "time_local").when(i == 3, "random")
    return s.select(V.fold_label(strategy, F.when(i == 0, c), F.when(i.isin(1, 2), c), F.when(i == 2, F.lit("period"))).alias("label"), "n")


_PICK = "(['group', 'time', 'random', 'group'])[((count(*) + sum(l_linenumber)) % 4 + 1)::bigint]"


@query("detection_score", f"""with p as (select l_suppkey as name, {_PICK} as strategy, 'col_'||(count(*) % 2) as c, (['group', 'time', 'random'])[l_suppkey % 3 + 1] as primary_ from lineitem group by l_suppkey),
    s as (select *, strategy = primary_ and (strategy = 'random' or c = 'col_0') or (strategy = 'time' and primary_ = 'group' and c = 'col_1') as ok from p)
    select primary_ as "primary", count(*) as n, count(*) filter (where ok) as n_correct, round(avg(case when ok then 1.0 else 0.0 end), 8) as recall,
    count(*) filter (where primary_ = 'random' and strategy <> 'random') as n_false_alarms from s group by 1""")
def _detection(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("name")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("m"))
    pick = F.array(*[F.lit(x) for x in ("group", "time", "random", "group")])[((F.col("n") + F.col("m")) % 4).cast("int")]
    predicted = s.select("name", pick.alias("strategy"), F.concat(F.lit("col_"), (F.col("n") % 2).cast("string")).alias("column"))
    kind = F.array(*[F.lit(x) for x in ("group", "time", "random")])[(F.col("name") % 3).cast("int")]
    truth = s.select("name", kind.alias("primary"))
    null = F.lit(None).cast("string")
    acceptable = truth.select("name", F.inline(F.array_compact(F.array(
        F.struct(F.col("primary").alias("strategy"), F.when(F.col("primary") != "random", "col_0").otherwise(null).alias("column")),
        F.when(F.col("primary") == "group", F.struct(F.lit("time").alias("strategy"), F.lit("col_1").alias("column")))))))
    return V.detection_score(predicted, acceptable, truth).withColumn("recall", F.round("recall", 8))


_COLS = ["id", "ver", "flux", "lat", "note", "y"]


def _subset(bits: str) -> str:
    return "[x for x in [" + ", ".join(f"case when ({bits}) & {1 << i} > 0 then '{c}' end" for i, c in enumerate(_COLS)) + "] if x is not null]"


@query("drop_plan_score", f"""with b as (select l_suppkey as name, count(*) % 64 as bits from lineitem group by 1), p as (select name, [x for x in {_subset('bits')} if x <> 'y'] as asked from b)
    select name, len([x for x in asked if x in ('id', 'ver')]) as n_caught, 2::bigint as n_must_drop, array_to_string(list_sort([x for x in asked if x not in ('id', 'ver')]), '|') as keep_violations,
    array_to_string(list_sort([x for x in asked if x in ('flux', 'lat')]), '|') as trap_violations from p""")
def _drop_score(spark, d):
    names = F.array(*[F.lit(c) for c in _COLS])
    bits = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("name")).agg((F.count("*") % 64).alias("bits"))
    proposed = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) > 0, c) for i, c in enumerate(_COLS)]))
    plans = bits.select("name", F.lit("y").alias("target"), names.alias("columns"), F.array(F.lit("id"), F.lit("ver")).alias("must_drop"),
                        F.array(F.lit("flux"), F.lit("lat")).alias("traps"), proposed.alias("proposed"))
    out = V.drop_plan_score(plans)
    return out.withColumns({c: F.array_join(c, "|") for c in ("keep_violations", "trap_violations")})


@query("interventions", """select o_orderkey as run, 'f'||(o_custkey % 9) as name, 'generated_feature' as kind, 'codegen:'||o_orderstatus as proposed_by, o_totalprice as delta, o_orderpriority as reason, o_custkey % 2 = 0 as accepted from orders where o_orderkey % 3 = 0
    union all select o_orderkey, 'keep:'||o_orderpriority, 'drop_veto', 'reviewer', case when o_custkey % 4 > 0 then o_totalprice end, o_orderstatus, o_custkey % 3 = 0 from orders where o_orderkey % 3 = 1
    union all select o_orderkey, 'target:log1p', 'target_framing', 'target_framing', o_totalprice, case when o_custkey % 2 = 0 then 'improved' else 'no_improvement' end, o_custkey % 2 = 0 from orders where o_orderkey % 3 = 2 and o_custkey % 5 > 0""")
def _interventions(spark, d):
    o = table(spark, d, "orders").withColumn("run", F.col("o_orderkey"))
    kind = F.col("o_orderkey") % 3
    c = F.col("o_custkey")
    f = o.where(kind == 0).select("run", F.concat(F.lit("f"), (c % 9).cast("string")).alias("name"), F.col("o_orderstatus").alias("source"),
                                  F.col("o_totalprice").alias("cv_delta"), F.col("o_orderpriority").alias("reason"), (c % 2 == 0).alias("kept"))
    v = o.where(kind == 1).select("run", F.col("o_orderpriority").alias("column"), F.when(c % 4 > 0, F.col("o_totalprice")).alias("cv_delta"),
                                  F.col("o_orderstatus").alias("reason"), (c % 3 == 0).alias("vetoed"))
    t = o.where(kind == 2).select("run", F.when(c % 5 > 0, "log1p").otherwise("none").alias("transform"), F.col("o_totalprice").alias("cv_delta"), (c % 2 == 0).alias("accepted"))
    return V.interventions(f, v, t)


_RUN = "o_custkey % 11 > 0 as has_model, o_custkey % 4 > 0 as has_cv, o_custkey % 3 > 0 as has_folds, o_orderkey % 2 = 0 as has_framing, case when o_orderkey % 6 > 0 then round(0.45 + (o_orderkey % 50) / 100.0::double, 4) end as auc"


def _flags(spark, d):
    o = table(spark, d, "orders")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return o.select(k.alias("run"), (c % 11 > 0).alias("has_model"), (c % 4 > 0).alias("has_cv"), (c % 3 > 0).alias("has_folds"), (k % 2 == 0).alias("has_framing"),
                    F.when(k % 6 > 0, F.round(0.45 + (k % 50) / 100.0, 4)).alias("auc"))


@query("run_light", f"""with r as (select o_orderkey as run, {_RUN} from orders) select run, case when not has_model then 'red' when auc >= 0.8 then 'red' when auc >= 0.6 then 'yellow' when not has_cv then 'yellow' else 'green' end as light from r""")
def _light(spark, d):
    return _flags(spark, d).select("run", V.run_light(F.col("has_model"), F.col("has_cv"), F.col("auc")).alias("light"))


@query("run_limits", f"""with r as (select o_orderkey as run, {_RUN} from orders) select run, concat_ws('; ', case when not has_cv then 'single holdout' end, case when not has_folds then 'fold design not checked' end,
    case when not has_framing then 'target framing not evaluated' end, case when auc >= 0.6 then 'train and test differ' end) as limits from r""")
def _limits(spark, d):
    f = _flags(spark, d)
    return f.select("run", F.array_join(V.run_limits(F.col("has_cv"), F.col("has_folds"), F.col("has_framing"), F.col("auc")), "; ").alias("limits"))


@query("dedupe_url", """with h as (select regexp_extract(url, '://([^/]+)', 1) as host, page_id % 7 as query_rank, page_id // 7 as hit_rank, page_id, url from pages)
    select host, query_rank, hit_rank, page_id, url from (select *, row_number() over (partition by host order by query_rank, hit_rank) as p from h) where p = 1""")
def _dedupe(spark, d):
    hits = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), (F.col("page_id") % 7).alias("query_rank"),
                                           F.floor(F.col("page_id") / 7).alias("hit_rank"), "page_id", "url")
    return V.first_seen(hits, "host", ["query_rank", "hit_rank"])


@query("dedupe_text", "select text, min(doc_id) as doc_id from documents group by text")
def _dedupe_text(spark, d):
    return V.first_seen(table(spark, d, "documents").select("text", "doc_id"), "text", ["doc_id"])


@query("evidence_trim", "select doc_id, substr(text, 1, 500) as snippet, case when doc_id % 2 = 0 and length(text) > 0 then substr(text, 1, 6000) end as content from documents")
def _evidence(spark, d):
    return V.evidence(table(spark, d, "documents").select("doc_id", F.col("text").alias("snippet"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("content")))


@query("task_board", f"""with {LED}, m as (select task, avg(base) as b, avg(trial) as t from led group by 1) select task, 'rmse' as metric, round(b, 8) as baseline, round(t, 8) as treatment,
    0.042::double as gold, 0.047::double as silver, 0.052::double as bronze, case when round(t, 8) < 0.042 then 'gold' when round(t, 8) < 0.047 then 'silver' when round(t, 8) < 0.052 then 'bronze' end as medal,
    round(0.05 - round(t, 8), 8) as gap from m""")
def _task_board(spark, d):
    long = ledger(spark, d).groupBy("task").agg(F.round(F.avg("base"), 8).alias("b"), F.round(F.avg("trial"), 8).alias("t"))
    s = long.select("task", F.inline(F.array(F.struct(F.lit("baseline").alias("arm"), F.col("b").alias("score")), F.struct(F.lit("treatment").alias("arm"), F.col("t").alias("score")))))
    marks = {"gold": 0.042, "silver": 0.047, "bronze": 0.052}
    medal = F.when(F.col("score") < 0.042, "gold").when(F.col("score") < 0.047, "silver").when(F.col("score") < 0.052, "bronze")
    return V.task_board(s.withColumns({"metric": F.lit("rmse"), **{k: F.lit(v) for k, v in marks.items()}, "medal": medal, "gap": F.round(0.05 - F.col("score"), 8)}))


@query("run_facts", f"""with {LED} select task, seed, count(*) as n_folds, round(avg(base), 8) as mean, round(stddev_pop(base), 8) as std, string_agg(printf('%.6f', base), '|' order by fold) as fold_scores from led group by 1, 2""")
def _facts(spark, d):
    out = V.run_facts(ledger(spark, d).withColumn("score", F.col("base")), ["task", "seed"])
    shown = F.array_join(F.transform("fold_scores", lambda s: F.format_string("%.6f", s)), "|")
    return out.select("task", "seed", "n_folds", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"), shown.alias("fold_scores"))


@query("leaderboard", f"with {LED}, m as (select task as model, round(avg(base), 8) as score from led group by 1) select * from m order by score desc, model limit 5")
def _leaderboard(spark, d):
    return V.leaderboard(ledger(spark, d).groupBy(F.col("task").alias("model")).agg(F.round(F.avg("base"), 8).alias("score")))
