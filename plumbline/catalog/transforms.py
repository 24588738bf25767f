"""Queries on cleaning, feature and encoding plans and text features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline.catalog.profiling import GAPS, orders_with_gaps
from plumbline.catalog.registry import query, sql_hash, table
from plumbline.functions import text as X
from plumbline.functions.columns import keyed_hash, period_expr
from plumbline.operators import clean as C
from plumbline.operators import encode as E
from plumbline.operators import features as G
from plumbline.operators import userfeatures as U

# orders with gaps, split by key hash into a training and a held-out part
SPLIT = f"{GAPS}, parts as (select *, {sql_hash(7, 'o_orderkey')} % 4 <> 0 as is_train from gaps), train as (select * from parts where is_train)"
_T = "o_custkey"      # stands in as the target where none is needed


def split_orders(spark, d):
    o = orders_with_gaps(spark, d)
    is_train = keyed_hash(7, "o_orderkey") % 4 != 0
    return o.where(is_train), o.where(~is_train)


def _replayed(spark, d, strategy, column, **extra):
    train, held = split_orders(spark, d)
    fit = C.fit_cleaning(train, {"imputations": [{"column": column, "strategy": strategy, **extra}]}, _T)
    both = fit.transform(train).withColumn("is_train", F.lit(True)).unionByName(
        fit.transform(held).withColumn("is_train", F.lit(False)))
    return both.select("o_orderkey", "is_train", column)


for _name, _strategy, _column, _sql in (
        ("impute_median", "median", "o_totalprice", "select median(o_totalprice) from train"),
        ("impute_mean", "mean", "o_totalprice", "select avg(o_totalprice) from train"),
        ("impute_mode", "most_frequent", "o_orderpriority",
         "select o_orderpriority from train where o_orderpriority is not null group by 1 order by count(*) desc, 1 limit 1")):
    _value = f"coalesce({_column}, ({_sql}))"
    _shown = f"round({_value}, 4)" if _column == "o_totalprice" else _value

    def _impute(spark, d, s=_strategy, c=_column):
        out = _replayed(spark, d, s, c)
        return out.withColumn(c, F.round(c, 4)) if c == "o_totalprice" else out
    query(_name, f"with {SPLIT} select o_orderkey, is_train, {_shown} as {_column} from parts")(_impute)


@query("impute_whole_numbers", """with g as (select c_custkey, case when c_custkey % 7 <> 0 then c_nationkey end as k from customer)
    select c_custkey, coalesce(k::double, (select median(k) from g)) as by_median, round(coalesce(k::double, (select avg(k) from g)), 6) as by_mean from g""")
def _whole(spark, d):
    """Averages of a whole-number column with gaps keep their fraction."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("by_median"), F.lit(0).alias("y"))
    c = c.withColumn("by_mean", F.col("by_median"))
    plan = {"imputations": [{"column": "by_median", "strategy": "median"}, {"column": "by_mean", "strategy": "mean"}]}
    return C.fit_cleaning(c, plan, "y").transform(c).select("c_custkey", "by_median", F.round("by_mean", 6).alias("by_mean"))


@query("impute_const", f"with {SPLIT} select o_orderkey, is_train, coalesce(o_orderpriority, 'UNKNOWN') as o_orderpriority from parts")
def _const(spark, d):
    return _replayed(spark, d, "constant", "o_orderpriority", fill_value="UNKNOWN")


@query("clean_drop", "select o_custkey, o_totalprice, o_orderdate from orders")
def _drop(spark, d):
    plan = {"columns_to_drop": ["o_orderkey", {"column": "o_orderstatus"}, "o_custkey", "nothing", {"column": "o_orderpriority"}]}
    o = table(spark, d, "orders")
    return C.fit_cleaning(o, plan, "o_custkey").transform(o)


_PLAN = {"columns_to_drop": ["o_orderstatus", {"column": "o_custkey", "reason": "id"}, 17, "ghost"],
         "imputations": [{"column": "o_totalprice", "strategy": "median"}, {"column": "o_orderpriority", "strategy": "most_frequent"},
                         {"column": "o_custkey", "strategy": "mean"}, {"column": "o_orderstatus", "strategy": "mean"},
                         {"column": "o_orderdate", "strategy": "mean"}, {"column": "o_orderkey", "strategy": "guess"}, 3.5]}


@query("cleaning_log", f"""with {GAPS} select * from (values ('drop','o_orderstatus','applied',''), ('drop','o_custkey','skip','is the target'),
    ('drop','17','skip','not a column entry'), ('drop','ghost','skip','does not exist'), ('impute','o_custkey','skip','is the target'),
    ('impute','o_orderstatus','skip','not present'), ('impute','o_orderdate','skip','mean does not match the type'),
    ('impute','o_orderkey','skip','unknown strategy guess'), ('impute','3.5','skip','not an imputation entry')) t(op, "column", status, detail)
    union all select 'impute', 'o_totalprice', 'applied', 'median missing='||(count(*) - count(o_totalprice)) from gaps
    union all select 'impute', 'o_orderpriority', 'applied', 'most_frequent missing='||(count(*) - count(o_orderpriority)) from gaps""")
def _log(spark, d):
    return C.fit_cleaning(orders_with_gaps(spark, d), _PLAN, _T).log_frame(spark)


@query("clean_replay", f"""with {SPLIT} select o_orderkey, o_custkey, round(coalesce(o_totalprice, (select median(o_totalprice) from train)), 4) as o_totalprice,
    o_orderdate, coalesce(o_orderpriority, (select o_orderpriority from train where o_orderpriority is not null group by 1 order by count(*) desc, 1 limit 1)) as o_orderpriority
    from parts where not is_train""")
def _replay(spark, d):
    train, held = split_orders(spark, d)
    return C.fit_cleaning(train, _PLAN, _T).transform(held).withColumn("o_totalprice", F.round("o_totalprice", 4))


FOLD_LONG = f"""{GAPS}, keyed as (select *, {sql_hash(3, 'o_orderkey')} % 3 as own from gaps),
    long as (select k.*, f.fold, case when own = fold then 'validate' else 'train' end as role from keyed k, (select unnest([0, 1, 2])::bigint as fold) f)"""


def fold_long(spark, d):
    from plumbline.operators.folds import random_folds
    return random_folds(orders_with_gaps(spark, d), "o_orderkey", 3, seed=3)


@query("clean_per_fold", f"""with {FOLD_LONG}, fills as (select fold, median(o_totalprice) as med, avg(o_totalprice) as mean from long where role = 'train' group by fold),
    counted as (select fold, o_orderpriority as v, row_number() over (partition by fold order by count(*) desc, o_orderpriority) as p from long
        where role = 'train' and o_orderpriority is not null group by 1, 2)
    select l.fold, role, count(*) as n, round(min(case when o_totalprice is null then med end), 4) as filled, round(sum(coalesce(o_totalprice, med)) / count(*), 4) as mean_price,
        count(*) filter (where coalesce(l.o_orderpriority, m.v) = '1-URGENT') as n_urgent, min(case when l.o_orderpriority is null then m.v end) as filled_priority
    from long l join fills using (fold) join counted m on m.fold = l.fold and m.p = 1 group by 1, 2""")
def _per_fold(spark, d):
    plan = {"imputations": [{"column": "o_totalprice", "strategy": "median"}, {"column": "o_orderpriority", "strategy": "most_frequent"}]}
    long = fold_long(spark, d).select("fold", "role", "o_custkey", "o_totalprice", "o_orderpriority",
                                      F.col("o_totalprice").isNull().alias("gap"), F.col("o_orderpriority").isNull().alias("gap2"))
    out = C.clean_per_fold(long, plan, _T)
    return out.groupBy("fold", "role").agg(
        F.count("*").alias("n"), F.round(F.min(F.when(F.col("gap"), F.col("o_totalprice"))), 4).alias("filled"),
        F.round(F.sum("o_totalprice") / F.count("*"), 4).alias("mean_price"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
        F.array_join(F.collect_set(F.when(F.col("gap2"), F.col("o_orderpriority"))), ",").alias("filled_priority"))


# ---- features ------------------------------------------------------------------------------

def _features(spark, d, *ops, source="orders", target="o_custkey"):
    t = table(spark, d, source)
    return G.fit_features(t, {"features": list(ops)}, target).transform(t)


@query("fe_date_parts", """select event_id, year(ts)::integer as ts_year, month(ts)::integer as ts_month, (isodow(ts) - 1)::integer as ts_weekday,
    hour(ts)::integer as ts_hour from events""")
def _date_parts(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "value")
    plan = {"features": [{"op": "date_parts", "column": "ts", "parts": ["year", "month", "weekday", "hour"]}]}
    return G.fit_features(e, plan, "value").transform(e).drop("value")


@query("fe_bin", f"""with {SPLIT}, q as (select quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) as e from train)
    select o_orderkey, case when o_totalprice is not null then (o_totalprice > e[1])::integer + (o_totalprice > e[2])::integer
    + (o_totalprice > e[3])::integer + (o_totalprice > e[4])::integer end as o_totalprice_bin from parts, q where not is_train""")
def _bin(spark, d):
    train, held = split_orders(spark, d)
    fit = G.fit_features(train, {"features": [{"op": "bin", "column": "o_totalprice", "n_bins": 5}]}, _T)
    return fit.transform(held).select("o_orderkey", "o_totalprice_bin")


@query("fe_log", "select o_orderkey, round(ln(1 + o_totalprice), 9) as o_totalprice_log from orders")
def _log1p(spark, d):
    out = _features(spark, d, {"op": "log_transform", "column": "o_totalprice"})
    return out.select("o_orderkey", F.round("o_totalprice_log", 9).alias("o_totalprice_log"))


@query("fe_ratio", """select l_orderkey, l_partkey, l_linenumber, round(l_extendedprice / nullif(l_tax, 0), 6) as l_extendedprice_per_l_tax from lineitem""")
def _ratio(spark, d):
    out = _features(spark, d, {"op": "ratio", "numerator": "l_extendedprice", "denominator": "l_tax"}, source="lineitem", target="l_quantity")
    return out.select("l_orderkey", "l_partkey", "l_linenumber", F.round("l_extendedprice_per_l_tax", 6).alias("l_extendedprice_per_l_tax"))


@query("fe_difference", "select c_custkey, round(c_acctbal - c_nationkey, 6) as c_acctbal_minus_c_nationkey from customer")
def _difference(spark, d):
    out = _features(spark, d, {"op": "difference", "left": "c_acctbal", "right": "c_nationkey"}, source="customer", target="c_mktsegment")
    return out.select("c_custkey", F.round("c_acctbal_minus_c_nationkey", 6).alias("c_acctbal_minus_c_nationkey"))


_FE = [{"op": "difference", "left": "c_acctbal", "right": "c_nationkey"}, {"op": "bin", "column": "c_acctbal_minus_c_nationkey", "n_bins": 4},
       {"op": "log_transform", "column": "c_acctbal"}, {"op": "log_transform", "column": "c_nationkey"}, {"op": "ratio", "numerator": "c_name", "denominator": "c_acctbal"},
       {"op": "ratio", "numerator": "c_mktsegment", "denominator": "c_acctbal"}, {"op": "cube", "column": "c_acctbal"}, {"op": "bin"},
       {"op": "date_parts", "column": "c_name", "parts": ["year"]}, {"op": "date_parts", "column": "c_name", "parts": []},
       {"op": "difference", "left": "c_acctbal", "right": "c_nationkey"}, {"op": "bin", "column": "ghost"}, "c_acctbal"]


@query("fe_log_rows", """with n as (select count(*) filter (where c_acctbal < 0) as neg from customer)
    select op, "column", status, detail from (values ('difference','c_acctbal_minus_c_nationkey','applied',''), ('bin','c_acctbal_minus_c_nationkey_bin','applied',''),
    ('log_transform','c_nationkey_log','applied',''), ('ratio','c_name_per_c_acctbal','skip','not numeric'),
    ('ratio','c_mktsegment_per_c_acctbal','skip','uses the target'), ('cube','c_acctbal','skip','unknown operation'), ('bin','','skip','missing column specification'),
    ('date_parts','c_name_year','skip','not parseable as a date'), ('date_parts','','skip','invalid parts'), ('difference','c_acctbal_minus_c_nationkey','skip','name already taken'),
    ('bin','ghost_bin','skip','not present: ghost'), ('entry','c_acctbal','skip','not a feature entry')) t(op, "column", status, detail)
    union all select 'log_transform', 'c_acctbal_log', case when neg > 0 then 'skip' else 'applied' end, case when neg > 0 then 'negative values' else '' end from n""")
def _fe_log(spark, d):
    return G.fit_features(table(spark, d, "customer"), {"features": _FE}, "c_mktsegment").log_frame(spark)


@query("fe_replay", """with d as (select *, c_acctbal - c_nationkey as diff from customer), q as (select quantile_cont(diff, [0.25, 0.5, 0.75]) as e from d)
    select c_custkey, round(diff, 6) as c_acctbal_minus_c_nationkey, (diff > e[1])::integer + (diff > e[2])::integer + (diff > e[3])::integer as c_acctbal_minus_c_nationkey_bin,
    round(ln(1 + c_nationkey), 9) as c_nationkey_log from d, q""")
def _fe_replay(spark, d):
    c = table(spark, d, "customer")
    out = G.fit_features(c, {"features": _FE}, "c_mktsegment").transform(c)
    return out.select("c_custkey", F.round("c_acctbal_minus_c_nationkey", 6).alias("c_acctbal_minus_c_nationkey"),
                      "c_acctbal_minus_c_nationkey_bin", F.round("c_nationkey_log", 9).alias("c_nationkey_log"))


# ---- encodings and framing -----------------------------------------------------------------

_ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
_ENC = [{"column": "o_orderpriority", "order": _ORDER[:-1]}, {"column": "o_orderstatus", "order": ["X", "Y"]},
        {"column": "o_totalprice", "order": ["a", "b"]}, {"column": "ghost", "order": ["a", "b"]}, {"column": "o_orderdate", "order": ["a"]}]


@query("ordinal_encode", f"with {GAPS} select o_orderkey, (case o_orderpriority " + " ".join(
    f"when '{v}' then {i}" for i, v in enumerate(_ORDER[:-1])) + " end)::double as o_orderpriority from gaps")
def _encode(spark, d):
    o = orders_with_gaps(spark, d)
    return E.fit_ordinals(o, _ENC, "o_custkey").transform(o).select("o_orderkey", "o_orderpriority")


@query("ordinal_coverage", f"""with {GAPS}, c as (select avg(case when o_orderpriority in ({', '.join(f"'{v}'" for v in _ORDER[:-1])}) then 1.0 else 0.0 end)
    filter (where o_orderpriority is not null) as cov from gaps)
    select 'o_orderpriority' as "column", 4 as n_levels, round(cov, 3) as coverage from c where cov >= 0.5""")
def _coverage(spark, d):
    return E.fit_ordinals(orders_with_gaps(spark, d), _ENC, "o_custkey").record_frame(spark)


@query("target_roundtrip", "select l_orderkey, l_linenumber, l_partkey, round(ln(1 + l_extendedprice), 8) as forward, round(l_extendedprice, 4) as back from lineitem")
def _roundtrip(spark, d):
    t = E.TargetTransform()
    f = t.forward(F.col("l_extendedprice"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(f, 8).alias("forward"), F.round(t.inverse(f), 4).alias("back"))


@query("framing_eligible", """select 'l_extendedprice' as target, min(l_extendedprice) >= 0 as eligible, case when min(l_extendedprice) < 0 then 'negative values' else '' end as reason from lineitem
    union all select 'l_returnflag', false, 'target is not numeric'
    union all select 'c_acctbal', min(c_acctbal) >= 0, case when min(c_acctbal) < 0 then 'negative values' else '' end from customer
    union all select 'l_tax', false, 'metric accuracy cannot be rescored'""")
def _framing(spark, d):
    li = table(spark, d, "lineitem")
    return (E.check_framing(li, "l_extendedprice").unionByName(E.check_framing(li, "l_returnflag"))
            .unionByName(E.check_framing(table(spark, d, "customer"), "c_acctbal"))
            .unionByName(E.check_framing(li, "l_tax", metric="accuracy")))


@query("clip_nonneg", "select c_custkey, greatest(c_acctbal, 0.0::double) as pred from customer")
def _clip(spark, d):
    return table(spark, d, "customer").select("c_custkey", E.clip_nonnegative(F.col("c_acctbal")).alias("pred"))


@query("period_token", """select event_id, month(ts)::bigint as m, weekofyear(ts)::bigint as w, (isodow(ts) - 1)::bigint as dow from events""")
def _tokens(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", period_expr(e, "month_of:ts").alias("m"), period_expr(e, "week_of:ts").alias("w"), period_expr(e, "dayofweek_of:ts").alias("dow"))


# ---- user features -------------------------------------------------------------------------

def _te():
    return U.target_encoding("priority_price", "o_orderpriority", "o_totalprice")


def _whole_orders(spark, d):
    o = table(spark, d, "orders")
    is_train = keyed_hash(7, "o_orderkey") % 4 != 0
    return o.where(is_train), o.where(~is_train)


_OSPLIT = f"parts as (select *, {sql_hash(7, 'o_orderkey')} % 4 <> 0 as is_train from orders), train as (select * from parts where is_train)"


@query("user_feature_te", f"""with {_OSPLIT}, prior as (select avg(o_totalprice) as p from train), g as (select o_orderpriority, sum(o_totalprice) as s, count(*) as n from train group by 1)
    select o_orderkey, round((coalesce(s, 0) + p * 20) / (coalesce(n, 0) + 20), 4) as gen_priority_price from parts left join g using (o_orderpriority), prior where not is_train""")
def _user_te(spark, d):
    train, held = _whole_orders(spark, d)
    _, out = U.add_features(train, [held], "o_totalprice", "o_orderkey", [_te()])
    return out.select("o_orderkey", F.round("gen_priority_price", 4).alias("gen_priority_price"))


def _distance(batch, mean):
    return np.hypot(batch["o_custkey"] - mean, np.where(batch["o_orderstatus"] == "F", 3.0, 4.0))


_PYTHON = U.python_feature("distance", ["o_custkey", "o_orderstatus"], lambda t: t.agg(F.avg("o_custkey")).first()[0], _distance)


@query("user_feature_python", f"""with {_OSPLIT}, m as (select avg(o_custkey) as m from train)
    select o_orderkey, o_totalprice, round(sqrt((o_custkey - m) ** 2 + case when o_orderstatus = 'F' then 9 else 16 end), 6) as gen_distance, o_custkey * 2.0::double as gen_twice from parts, m where not is_train""")
def _user_python(spark, d):
    train, held = _whole_orders(spark, d)
    _, out = U.add_features(train, [held], "o_totalprice", "o_orderkey", [_PYTHON, _DOUBLE])
    return out.select("o_orderkey", "o_totalprice", F.round("gen_distance", 6).alias("gen_distance"), "gen_twice")


_DOUBLE = U.UserFeature("twice", lambda t: None, lambda df, p: F.col("o_custkey") * 2.0)
_TEXTY = U.UserFeature("texty", lambda t: None, lambda df, p: F.upper("o_orderstatus"))
_EMPTY = U.UserFeature("empty", lambda t: None, lambda df, p: F.when(F.col("o_custkey") < 0, F.lit(1.0)))


def _share_of_batch(df, params):
    """Depends on the rest of the batch: what the independence check must catch."""
    return F.col("o_custkey") / F.lit(df.agg(F.avg("o_custkey")).first()[0])


_SHARE = U.UserFeature("share", lambda t: None, _share_of_batch)


@query("user_feature_valid", f"""with {_OSPLIT}, h as (select * from parts where not is_train)
    select 'twice' as feature, case when count(o_custkey * 2.0) = 0 then 'no finite value' else '' end as problem from h
    union all select 'texty', 'not numeric' union all select 'empty', case when count(*) filter (where o_custkey < 0) = 0 then 'no finite value' else '' end from h
    union all select 'priority_price', ''""")
def _valid(spark, d):
    train, held = _whole_orders(spark, d)
    n = held.count()
    rows = [(f.name, U.check_output(f.apply(held, f.fit(train), "o_totalprice"), f.column, n)) for f in (_DOUBLE, _TEXTY, _EMPTY, _te())]
    return spark.createDataFrame(rows, "feature string, problem string")


@query("row_independence", f"""with {_OSPLIT}, h as (select *, {sql_hash(0, 'o_orderkey')} % 2 as half from parts where not is_train),
    w as (select o_custkey / (select avg(o_custkey) from h) as whole, o_custkey / avg(o_custkey) over (partition by half) as piece from h)
    select 'twice' as feature, count(*) as n_rows, 0::bigint as n_mismatch, true as row_independent from h
    union all select 'share', count(*), count(*) filter (where abs(whole - piece) > 1e-6), count(*) filter (where abs(whole - piece) > 1e-6) = 0 from w
    union all select 'priority_price', count(*), 0, true from h""")
def _independence(spark, d):
    train, held = _whole_orders(spark, d)
    out = None
    for f in (_DOUBLE, _SHARE, _te()):
        one = U.row_dependence(f, train, held, "o_totalprice", "o_orderkey")
        out = one if out is None else out.unionByName(one)
    return out


# ---- text ----------------------------------------------------------------------------------

_PRAISE = ["good", "great", "best", "clean", "fresh"]       # fixed values
_INFORMAL = ["lol", "gonna", "wanna", "hey", "ok", "yeah"]  # fixed values


def _n(pattern: str, source: str = "text") -> str:
    return f"len(regexp_extract_all({source}, '{pattern}'))"


_LETTERS = _n("[A-Za-z]")
# words set apart by two blanks, so that neighbours never share a separator
_APART = r"' '||regexp_replace(lower(text), '[^\p{L}\p{N}_]', '  ', 'g')||' '"


@query("text_features_docs", f"""select doc_id, {_n(' (' + '|'.join(_PRAISE) + ') ', _APART)}::bigint as praise,
    try_cast(nullif(regexp_extract(lower(text), '(\\d+)\\s*days', 1), '') as double) as days,
    round({_n('[A-Z]')}::double / nullif({_LETTERS}, 0), 9) as upper_ratio, round({_n('!')}::double / nullif(length(text), 0), 9) as exclamation_density,
    round({_n('[?]')}::double / nullif(length(text), 0), 9) as question_density, round({_n('[0-9]')}::double / nullif(length(text), 0), 9) as digit_density,
    {_n('[$€£]\\s*[0-9]')}::bigint as currency_mentions, {_n('\\b([0-9]+\\s*(hour|day|week|month|year)s?)\\b', 'lower(text)')}::bigint as time_mentions,
    round({_n(' (' + '|'.join(_INFORMAL) + ') ', _APART)}::double / nullif({_n("[A-Za-z'']+")}, 0), 9) as informal_ratio from documents""")
def _text(spark, d):
    t = F.col("text")
    style = X.style_features(t, _INFORMAL)
    return table(spark, d, "documents").select(
        "doc_id", X.keyword_group(t, _PRAISE).alias("praise"), X.number_after(t, "days").alias("days"),
        *[(F.round(c, 9) if n.endswith(("ratio", "density")) else c).alias(n) for n, c in style.items()])


@query("truncate_text", """select doc_id, case when length(text) > 400 then substr(text, 1, 400)||chr(10)||'[... truncated]' else text end as body from documents""")
def _truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate(F.col("text"), 400).alias("body"))
