"""Queries on loading, profiling, flags, fold checks and the audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.catalog.registry import query, sql_hash, table
from plumbline.operators import profile as P
from plumbline.operators.ordering import group_quantiles
from plumbline.operators.verify import check_folds, shift_band
from plumbline.plans import audit as A
from plumbline.sources import load as L

# ---- loading and shaping -------------------------------------------------------------------

_GUARDED = [("region", "r_name", 5), ("nation", "n_name", 25), ("orders", "o_totalprice", 0), ("lineitem", "l_tax", 0),
            ("customer", "no_such_column", 0)]


@query("guard_inputs", " union all ".join(
    f"select '{t}' as audited, count(*) as n_rows, "
    + ("'rejected'" if c.startswith("no_") else "case when count(*) < 50 then 'rejected' else 'ok' end") + " as verdict, "
    + ("'missing column: no_such_column'" if c.startswith("no_") else
       "case when count(*) = 0 then 'no rows' when count(*) < 50 then 'only '||count(*)||' rows, need 50' else '' end")
    + f" as reason from {t}" for t, c, _ in _GUARDED))
def _guard(spark, d):
    out = None
    for t, c, _ in _GUARDED:
        one = L.guard_inputs(table(spark, d, t), [c]).withColumn("audited", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


@query("infer_task", """
    with v as (select distinct o_orderstatus as s from orders),
    t as (select count(*) filter (where s not in ('F','O','P')) as other, count(*) filter (where s in ('F','O','P')) as hit from v)
    select 'o_orderkey' as id_column, case when other = 0 and hit = 3 then 'o_orderstatus' end as target,
           case when other = 0 and hit = 3 then 'per_class' else 'unsupported' end as shape, other = 0 and hit = 3 as ok from t
    union all select 'o_orderkey', 'o_totalprice', 'single', true""")
def _infer(spark, d):
    o = table(spark, d, "orders")
    test = o.drop("o_orderstatus")
    wide = o.select("o_orderkey", *[F.lit(0.0).alias(c) for c in "FOP"])
    single = o.select("o_orderkey", "o_totalprice")
    return L.infer_task(o, test, wide).unionByName(L.infer_task(o, o.drop("o_totalprice"), single))


@query("sample_n", f"""select o_orderkey, o_totalprice from orders
    order by {sql_hash(42, 'o_orderkey')}, o_orderkey limit 1000""")
def _sample(spark, d):
    return L.sample_rows(table(spark, d, "orders"), 1000, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("anonymize", """select o_orderkey, o_custkey as x1, o_orderstatus as x2,
    case when o_orderkey % 7 = 0 then null else o_totalprice end as y, case when o_orderkey % 5 > 1 then o_orderpriority end as x3 from orders where o_orderkey % 7 <> 0""")
def _anonymize(spark, d):
    return L.anonymize(orders_with_gaps(spark, d).drop("o_orderdate"), "o_totalprice", "o_orderkey")


@query("row_id", "select event_id, row_number() over (order by ts, event_id) - 1 as id from events")
def _row_id(spark, d):
    return L.with_row_id(table(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"]).drop("ts")


@query("composite_key", """select l_orderkey||'_'||l_linenumber||'_'||l_returnflag as ckey, count(*) as n,
    round(sum(l_quantity), 2) as qty from lineitem group by 1""")
def _composite(spark, d):
    li = table(spark, d, "lineitem")
    key = L.composite_key(["l_orderkey", "l_linenumber", "l_returnflag"])
    return li.groupBy(key.alias("ckey")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("row_weights", """select case when o_orderstatus = 'F' then 'true' when o_orderstatus = 'O' then 'no' else 'Yes' end as flag,
    case when o_orderstatus in ('F', 'P') then 5.0::double else 1.0::double end as w, count(*) as n from orders group by 1, 2""")
def _weights(spark, d):
    flag = F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "O", "no").otherwise("Yes")
    o = table(spark, d, "orders").select(flag.alias("flag"))
    return o.withColumn("w", L.row_weights(F.col("flag"))).groupBy("flag", "w").agg(F.count("*").alias("n"))


# ---- profile -------------------------------------------------------------------------------

def orders_with_gaps(spark, d) -> DataFrame:
    """Orders with missing prices, statuses and priorities planted by key."""
    o = table(spark, d, "orders")
    return o.withColumns({
        "o_totalprice": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")),
        "o_orderpriority": F.when(F.col("o_orderkey") % 5 > 1, F.col("o_orderpriority"))})


GAPS = """gaps as (select o_orderkey, o_custkey, o_orderstatus,
    case when o_orderkey % 7 <> 0 then o_totalprice end as o_totalprice, o_orderdate,
    case when o_orderkey % 5 > 1 then o_orderpriority end as o_orderpriority from orders)"""
_ORDERS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
           ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


def profile_sql(source: str, columns, target: str, ctes: str) -> str:
    parts = []
    for name, t in columns:
        floating = t in ("double", "float")
        tokens = f"'month_of:{name}|week_of:{name}|dayofweek_of:{name}'" if t.startswith("timestamp") else "''"
        parts.append(f"""select '{name}' as name, {str(name == target).lower()} as is_target, '{t}' as dtype, count(*) as n_rows,
            count(*) - count({name}) as n_missing, round((count(*) - count({name})) / count(*), 3) as missing_frac,
            count(distinct {name}) as n_unique, round(count(distinct {name}) / count(*), 3) as unique_frac,
            {'false' if floating else f'count(distinct {name}) / count(*) >= 0.99'} as id_like, {tokens} as period_candidates
            from {source}""")
    return f"with {ctes}, prof as (" + " union all ".join(parts) + ") "


def _joined(p: DataFrame) -> DataFrame:
    return p.withColumn("period_candidates", F.array_join("period_candidates", "|"))


_PROF = profile_sql("gaps", _ORDERS, "o_totalprice", GAPS)


@query("profile_orders", _PROF + "select * from prof")
def _profile(spark, d):
    return _joined(P.profile(orders_with_gaps(spark, d), "o_totalprice"))


@query("profile_missing", _PROF + "select name, n_missing, missing_frac from prof")
def _missing(spark, d):
    return P.profile(orders_with_gaps(spark, d), "o_totalprice", distinct="approx").select("name", "n_missing", "missing_frac")


@query("profile_distinct", _PROF + "select name, n_unique, unique_frac from prof")
def _distinct(spark, d):
    return P.profile(orders_with_gaps(spark, d), "o_totalprice").select("name", "n_unique", "unique_frac")


@query("flag_id_like", _PROF + "select name from prof where id_like")
def _id_like(spark, d):
    return P.profile(orders_with_gaps(spark, d), "o_totalprice", distinct="screened").where("id_like").select("name")


# lineitem with planted structure: a copy of the target, a constant, an empty-ish and an id-like column
def planted(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.withColumns({
        "net": F.col("l_extendedprice") * (1 - F.col("l_discount")),
        "schema_version": F.lit(3),
        "late_tax": F.when(F.col("l_orderkey") % 10 >= 7, F.col("l_tax")),
        "row_tag": F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("bigint")),
        "remark": F.when(F.col("l_orderkey") % 25 != 0, F.concat_ws(" ", F.lit("lot"), "l_partkey", "l_orderkey", "l_suppkey")),
    })


PLANTED = """planted as (select *, l_extendedprice * (1 - l_discount) as net, 3 as schema_version,
    case when l_orderkey % 10 >= 7 then l_tax end as late_tax,
    concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::bigint) as row_tag,
    case when l_orderkey % 25 <> 0 then concat_ws(' ', 'lot', l_partkey, l_orderkey, l_suppkey) end as remark from lineitem)"""
_LI = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"),
       ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
       ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"), ("net", "double"), ("schema_version", "int"),
       ("late_tax", "double"), ("row_tag", "string"), ("remark", "string")]
_LIPROF = profile_sql("planted", _LI, "l_extendedprice", PLANTED)
FLAGS = """flags as (
    select 'id_like' as "check", name as "column", unique_frac as "value" from prof where not is_target and id_like
    union all select 'constant', name, n_unique::double from prof where not is_target and n_unique <= 1
    union all select 'high_missing', name, missing_frac from prof where not is_target and missing_frac > 0.5
    union all select 'high_card_text', name, unique_frac from prof where not is_target and not id_like and dtype = 'string' and unique_frac > 0.9)"""


def _flag(spark, d, check):
    prof = P.profile(planted(spark, d), "l_extendedprice", distinct="screened")
    return P.structural_flags(prof).where(F.col("check") == check).select("column", "value")


for _check in ("constant", "high_missing", "high_card_text"):
    query(f"flag_{_check}", _LIPROF.rstrip() + ", " + FLAGS + f""" select "column", "value" from flags where "check" = '{_check}'""")(
        lambda spark, d, c=_check: _flag(spark, d, c))


@query("profile_examples", "with u as (" + " union all ".join(
    f"select '{c}' as name, {c}::varchar as v, min(o_orderkey) as k from orders group by 2" for c in
    ("o_custkey", "o_orderstatus", "o_orderpriority", "long_text")).replace("long_text", "repeat(o_orderpriority||'/', 6)", 2)
    .replace("'repeat(o_orderpriority||'/', 6)'", "'long_text'") + """),
    r as (select *, row_number() over (partition by name order by k, v) as p from u where v is not null)
    select name, string_agg(case when length(v) > 40 then substr(v, 1, 37)||'...' else v end, '|' order by p) as examples
    from r where p <= 5 group by name""")
def _examples(spark, d):
    o = table(spark, d, "orders").withColumn("long_text", F.repeat(F.concat("o_orderpriority", F.lit("/")), 6))
    return (P.examples(o, "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority", "long_text"])
            .withColumn("examples", F.array_join("examples", "|")))


_TEXTDATE = {"iso_day": "strftime(o_orderdate, '%Y-%m-%d')", "us_day": "strftime(o_orderdate, '%m/%d/%Y')",
             "mostly": "case when o_orderkey % 50 = 0 then 'n/a' else strftime(o_orderdate, '%Y-%m-%d') end",
             "half": "case when o_orderkey % 2 = 0 then 'later' else strftime(o_orderdate, '%Y-%m-%d') end"}


@query("probe_datetime", "with src as (select *, " + ", ".join(f"{e} as {n}" for n, e in _TEXTDATE.items())
       + f", {sql_hash(0, 'o_orderkey')} as h from orders), s as (" + " union all ".join(
    f"(select '{n}' as name, {n} as v from src where {n} is not null order by h, o_orderkey limit 200)"
    for n in [*_TEXTDATE, "o_orderpriority"]) + """), p as (select name, count(*) as sampled,
    count(*) filter (where coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%m/%d/%Y')) is null) as unparseable from s group by name)
    select name, sampled, unparseable, unparseable <= 0.05 * sampled as datetime_like,
    case when unparseable <= 0.05 * sampled then 'month_of:'||name||'|week_of:'||name||'|dayofweek_of:'||name else '' end as period_candidates from p
    union all select 'o_totalprice', 0, 0, false, ''
    union all select 'o_orderdate', 0, 0, true, 'month_of:o_orderdate|week_of:o_orderdate|dayofweek_of:o_orderdate'""")
def _probe(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = table(spark, d, "orders").withColumns({
        "iso_day": day, "us_day": F.date_format("o_orderdate", "MM/dd/yyyy"),
        "mostly": F.when(F.col("o_orderkey") % 50 == 0, "n/a").otherwise(day),
        "half": F.when(F.col("o_orderkey") % 2 == 0, "later").otherwise(day)})
    cols = [*_TEXTDATE, "o_orderpriority", "o_totalprice", "o_orderdate"]
    return _joined(P.probe_datetime(o, "o_orderkey", cols))


@query("period_candidates", _PROF + "select name, period_candidates from prof where period_candidates <> ''")
def _periods(spark, d):
    p = _joined(P.profile(orders_with_gaps(spark, d), "o_totalprice", distinct="approx"))
    return p.where("period_candidates <> ''").select("name", "period_candidates")


# ---- correlations --------------------------------------------------------------------------

_LI_NUM = [c for c, t in _LI if t in ("bigint", "int", "double") and c != "l_extendedprice"]


def _corr_sql(cols, y, source, table_="planted"):
    return " union all ".join(
        f"""select '{c}' as "column", count(*) filter (where {c} is not null and {y} is not null) as n_pairs,
        case when min({c}) < max({c}) then abs(corr({c}, {y})) end as r from {table_}""" for c in cols)


@query("leak_scan", f"""with {PLANTED}, c as ({_corr_sql(_LI_NUM, 'l_extendedprice', '')})
    select "column", round(r, 3) as r_abs from c where r > 0.9""")
def _leaks(spark, d):
    return P.leak_scan(planted(spark, d), "l_extendedprice")


@query("leak_scan_binary", f"""with b as (select l_orderkey, l_quantity, l_tax, l_linestatus,
    case when l_linestatus = 'F' then 1.0 else 0.0 end + l_discount as echo from lineitem),
    c as ({_corr_sql(['l_orderkey', 'l_quantity', 'l_tax', 'echo'], "(case when l_linestatus = 'F' then 1 else 0 end)", '', 'b')})
    select "column", round(r, 3) as r_abs from c where r > 0.9""")
def _leaks_binary(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_tax", "l_linestatus", (
        F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0) + F.col("l_discount")).alias("echo"))
    return P.leak_scan(li, "l_linestatus")


_CW = ["o_custkey", "o_orderkey"]


@query("corr_with_target", f"""with {GAPS}, c as ({_corr_sql(_CW, 'o_totalprice', '', 'gaps')})
    select "column", n_pairs, round(case when n_pairs >= 3 then r end, 6) as r_abs from c
    union all select 'o_orderpriority', 0, null""")
def _corr(spark, d):
    return P.correlations(orders_with_gaps(spark, d), "o_totalprice", [*_CW, "o_orderpriority"], min_pairs=3) \
            .withColumn("r_abs", F.round("r_abs", 6))


# ---- text and target -----------------------------------------------------------------------

def _text_sql(t, cols):
    return " union all ".join(
        f"""select '{c}' as name, count({c}) as n_non_null, count(distinct {c}) as n_unique, avg(length({c})) as len_mean,
        max(length({c})) as len_max from {t}""" for c in cols)


@query("detect_text", f"""with m as ({_text_sql('documents', ['text', 'lang', 'source'])})
    select name, n_non_null, n_unique, round(len_mean, 1) as len_mean, len_max from m
    where n_non_null >= 30 and len_mean >= 25 and n_unique / n_non_null >= 0.5""")
def _detect(spark, d):
    return P.detect_text(table(spark, d, "documents"), "n_chars").withColumn("len_mean", F.round("len_mean", 1))


@query("text_profile_docs", f"""with m as ({_text_sql('documents', ['text', 'source'])}),
    u as (select 'text' as name, text as v, min(doc_id) as k from documents group by 2
          union all select 'source', source, min(doc_id) from documents group by 2),
    r as (select *, row_number() over (partition by name order by k, v) as p from u where v is not null),
    e as (select name, string_agg(substr(v, 1, 160), '|' order by p) as examples from r where p <= 6 group by name)
    select m.name, n_non_null, n_unique, round(len_mean, 1) as len_mean, len_max, examples from m join e using (name)""")
def _text_profile(spark, d):
    return P.text_profile(table(spark, d, "documents"), "doc_id", ["text", "source"]) \
            .withColumn("examples", F.array_join("examples", "|"))


@query("target_stats", f"""with {GAPS} select 'double' as dtype, count(distinct o_totalprice) as n_unique, round(min(o_totalprice), 4) as "min",
    round(quantile_cont(o_totalprice, 0.25), 4) as p25, round(quantile_cont(o_totalprice, 0.5), 4) as median,
    round(avg(o_totalprice), 4) as mean, round(quantile_cont(o_totalprice, 0.75), 4) as p75, round(max(o_totalprice), 4) as "max",
    round(skewness(o_totalprice), 4) as skewness from gaps""")
def _target_stats(spark, d):
    return P.target_stats(orders_with_gaps(spark, d), "o_totalprice")


@query("is_classification", """select 'l_returnflag' as target, count(distinct l_returnflag) as n_unique, true as classification from lineitem
    union all select 'l_linenumber', count(distinct l_linenumber), count(distinct l_linenumber) <= 20 from lineitem
    union all select 'l_discount', count(distinct l_discount), count(distinct l_discount) <= 20 and count(*) filter (where l_discount <> floor(l_discount)) = 0 from lineitem
    union all select 'l_quantity', count(distinct l_quantity), count(distinct l_quantity) <= 20 and count(*) filter (where l_quantity <> floor(l_quantity)) = 0 from lineitem""")
def _classes(spark, d):
    li = table(spark, d, "lineitem")
    out = P.is_classification(li, "l_returnflag")
    for c in ("l_linenumber", "l_discount", "l_quantity"):
        out = out.unionByName(P.is_classification(li, c))
    return out


# ---- fold checks and audit -----------------------------------------------------------------

def _checks(spark, d, name, proposals, target="o_totalprice"):
    out = None
    o = table(spark, d, name)
    for p in proposals:
        one = check_folds(o, p, target)
        out = one if out is None else out.unionByName(one)
    return out


def _check_row(proposed, strategy, column, period, n, status, reason, source=""):
    return (f"select '{proposed}' as proposed, {strategy} as strategy, {column} as \"column\", {period} as period, "
            f"{n} as n_values, {status} as status, {reason} as reason {source}")


@query("verify_group", f"""with u as (select count(*) as n, count(distinct o_custkey) as c, count(distinct o_orderkey) as k, count(distinct o_orderstatus) as s from orders)
    {_check_row('group', "'group'", "'o_custkey'", 'null::varchar', 'c', "'verified'", "''", 'from u')}
    union all {_check_row('group', "case when k >= n then 'random' else 'group' end", "case when k < n then 'o_orderkey' end", 'null', 'k',
                          "case when k >= n then 'fallback' else 'verified' end", "case when k >= n then 'no entity repeats' else '' end", 'from u')}
    union all {_check_row('group', "'group'", "'o_orderstatus'", 'null', 's', "'verified'",
                          "case when s < 5 then 'few entities: is this an entity or a design factor?' else '' end", 'from u')}
    union all {_check_row('group', "'random'", 'null', 'null', 'null', "'fallback'", "'group column is the target'")}""")
def _verify_group(spark, d):
    return _checks(spark, d, "orders", [{"strategy": "group", "group_column": c} for c in
                                        ("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")])


@query("verify_time", f"""with u as (select avg(case when try_strptime(o_orderpriority, '%Y-%m-%d') is null then 1 else 0 end) as bad from orders)
    {_check_row('time', "'time'", "'o_orderdate'", 'null::varchar', 'null::bigint', "'verified'", "''")}
    union all {_check_row('time', "'time'", "'o_orderkey'", 'null', 'null', "'verified'", "''")}
    union all {_check_row('time', "case when bad > 0.05 then 'random' else 'time' end", "case when bad <= 0.05 then 'o_orderpriority' end", 'null', 'null',
                          "case when bad > 0.05 then 'fallback' else 'verified' end", "case when bad > 0.05 then 'time column does not parse' else '' end", 'from u')}
    union all {_check_row('time', "'random'", 'null', 'null', 'null', "'fallback'", "'time column when_ does not exist'")}""")
def _verify_time(spark, d):
    return _checks(spark, d, "orders", [{"strategy": "time", "time_column": c} for c in
                                        ("o_orderdate", "o_orderkey", "o_orderpriority", "when_")])


@query("verify_time_local", f"""with u as (select count(distinct month(o_orderdate)) as m, count(distinct o_orderstatus) as s from orders)
    {_check_row('time_local', "case when m < 2 then 'random' else 'time_local' end", "case when m >= 2 then 'o_orderdate' end",
                "case when m >= 2 then 'month_of:o_orderdate' end", 'm', "case when m < 2 then 'fallback' else 'verified' end",
                "case when m < 2 then 'fewer than 2 periods' else '' end", 'from u')}
    union all {_check_row('time_local', "'time_local'", "'o_orderdate'", "'o_orderstatus'", 's', "'verified'", "''", 'from u')}
    union all {_check_row('time_local', "'random'", 'null', 'null', 'null', "'fallback'", "'period token week_of:nothing names no usable column'")}
    union all {_check_row('time_local', "'random'", 'null', 'null', 'null', "'fallback'", "'no period column'")}""")
def _verify_local(spark, d):
    return _checks(spark, d, "orders", [{"strategy": "time_local", "time_column": "o_orderdate", "period_column": p} for p in
                                        ("month_of:o_orderdate", "o_orderstatus", "week_of:nothing", None)])


@query("verify_random_fallback", f"""with u as (select count(*) as n, count(distinct event_id) as k from events)
    {_check_row('random', "'random'", 'null::varchar', 'null::varchar', 'null::bigint', "'default'", "''")}
    union all {_check_row('spiral', "'random'", 'null', 'null', 'null', "'fallback'", "'unknown strategy spiral'")}
    union all {_check_row('group', "case when k >= n then 'random' else 'group' end", "case when k < n then 'event_id' end", 'null', 'k',
                          "case when k >= n then 'fallback' else 'verified' end", "case when k >= n then 'no entity repeats' else '' end", 'from u')}""")
def _verify_random(spark, d):
    return _checks(spark, d, "events", [{"strategy": "random"}, {"strategy": "spiral"},
                                        {"strategy": "group", "group_column": "event_id"}], "value")


def _findings_sql(prefix: str, leak_cols, target, source, design: str) -> str:
    acts = " ".join(f"when '{k}' then '{v}'" for k, v in A.ACTIONS.items())
    return f"""{prefix}, {FLAGS}, c as ({_corr_sql(leak_cols, target, '', source)}),
    found as (select * from flags union all select 'target_leak', "column", round(r, 3) from c where r > 0.9 {design}),
    audit as (select "check", "column", "value", case when "check" in ('target_leak', 'leakage_warning') then 'high'
        when "check" in ('fold_design', 'shift') then 'elevated' else 'note' end as severity,
        case "check" {acts} end as action from found) """


_LI_AUDIT = _findings_sql(_LIPROF.rstrip(), _LI_NUM, "l_extendedprice", "planted", """
    union all select 'fold_design', 'group:l_orderkey', count(distinct l_orderkey)::double from lineitem having count(distinct l_orderkey) < count(*)""")


@query("audit_lineitem", _LI_AUDIT + "select * from audit")
def audit_lineitem(spark, d):
    return A.audit(planted(spark, d), "l_extendedprice", proposal={"strategy": "group", "group_column": "l_orderkey"})


_ORDERS_AUDIT = _findings_sql(_PROF.rstrip(), ["o_orderkey", "o_custkey"], "o_totalprice", "gaps", """
    union all select 'fold_design', 'time:o_orderdate', null""")
_EVENTS = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string")]
_EVENTS_AUDIT = _findings_sql(profile_sql("events", _EVENTS, "value", "one as (select 1)").rstrip(), ["event_id", "user_id"], "value", "events", "")


def _battery(spark, d):
    return A.audit_many([
        ("lineitem", planted(spark, d), "l_extendedprice", {"strategy": "group", "group_column": "l_orderkey"}),
        ("orders", orders_with_gaps(spark, d), "o_totalprice", {"strategy": "time", "time_column": "o_orderdate"}),
        ("events", table(spark, d, "events"), "value", None)])


BATTERY_SQL = "with battery as (" + " union all ".join(
    f"select '{n}' as audited, * from ({s} select * from audit)" for n, s in
    (("lineitem", _LI_AUDIT), ("orders", _ORDERS_AUDIT), ("events", _EVENTS_AUDIT))) + ") "


@query("audit_battery", BATTERY_SQL + "select * from battery")
def _audit_battery(spark, d):
    return _battery(spark, d)


@query("audit_risk", BATTERY_SQL + """select audited, count(*) as n_findings, case when bool_or(severity = 'high') then 'high'
    when bool_or(severity = 'elevated') then 'elevated' else 'low' end as risk from battery group by audited""")
def _audit_risk(spark, d):
    return A.risk_level(_battery(spark, d), ["audited"])


@query("worst_finding", BATTERY_SQL + """, r as (select *, row_number() over (partition by audited order by list_position(["""
       + ", ".join(f"'{c}'" for c in A.SEVERITY_ORDER) + """], "check"), "column") as p from battery)
    select audited, "check", "column", "value" from r where p = 1""")
def _worst(spark, d):
    return A.worst_finding(_battery(spark, d), ["audited"])


@query("shift_band", """with s as (select l_suppkey as source, round(0.5 + 10 * abs(avg(l_discount) - 0.05) + 5 * abs(avg(l_tax) - 0.04), 4) as auc from lineitem group by 1)
    select source, auc, case when auc < 0.6 then 'low' when auc < 0.8 then 'moderate' else 'strong' end as band from s""")
def _band(spark, d):
    off = 0.5 + 10 * F.abs(F.avg("l_discount") - 0.05) + 5 * F.abs(F.avg("l_tax") - 0.04)
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(F.round(off, 4).alias("auc"))
    return s.withColumn("band", shift_band(F.col("auc")))


# ---- quantiles of many groups --------------------------------------------------------------

@query("group_quantiles", """select 'order' as kind, l_orderkey as g, count(*) as n, round(quantile_cont(l_extendedprice, 0.25), 6) as q25, round(quantile_cont(l_extendedprice, 0.5), 6) as q50,
        round(quantile_cont(l_extendedprice, 0.9), 6) as q90 from lineitem where l_extendedprice is not null group by all
    union all select 'flag', case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end, count(*), round(quantile_cont(l_extendedprice, 0.25), 6), round(quantile_cont(l_extendedprice, 0.5), 6),
        round(quantile_cont(l_extendedprice, 0.9), 6) from lineitem where l_extendedprice is not null group by all""")
def _group_quantiles(spark, d):
    # an order has a few lines, a flag a large share of all
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).cast("bigint")
    both = table(spark, d, "lineitem").select(F.inline(F.array(F.struct(F.lit("order").alias("kind"), F.col("l_orderkey").alias("g"), F.col("l_extendedprice").alias("v")),
                                                               F.struct(F.lit("flag").alias("kind"), flag.alias("g"), F.col("l_extendedprice").alias("v")))))
    out = group_quantiles(both.select(F.struct("kind", "g").alias("g"), "v"), [0.25, 0.5, 0.9])
    return out.select("g.kind", F.col("g.g").alias("g"), "n", *[F.round(F.col("quantiles")[i], 6).alias(c) for i, c in enumerate(["q25", "q50", "q90"])])
