"""Queries on holdouts, folds, carves and permutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.registry import query, sql_hash, table
from plumbline.operators import folds as S

_H = sql_hash(42, "o_orderkey")
_LONG = "(select unnest(range({k}))::bigint as fold) f"


@query("holdout", f"""with r as (select o_orderkey, row_number() over (order by {_H}, o_orderkey) as p, count(*) over () as n from orders)
    select o_orderkey, p <= floor(n * 0.2 + 0.5) as held_out from r""")
def _holdout(spark, d):
    return S.holdout(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2)


@query("fold_random", f"select o_orderkey, {_H} % 5 as own from orders")
def _random(spark, d):
    return S.assign_random(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("fold_stratified", f"""select doc_id, quality, ntile(5) over (partition by quality order by {sql_hash(42, 'doc_id')}, doc_id) - 1 as own from labels""")
def _stratified(spark, d):
    return S.assign_stratified(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", 5)


def _deal(p, k):
    return f"case when ({p} - 1) % {2 * k} < {k} then ({p} - 1) % {2 * k} else {2 * k - 1} - ({p} - 1) % {2 * k} end"


_GROUPS = f"""g as (select user_id, count(*) as n_rows from events group by 1),
    deal as (select user_id, n_rows, {_deal('row_number() over (order by n_rows desc, user_id)', 5)} as own from g)"""


@query("fold_group", f"with {_GROUPS} select * from deal")
def _group(spark, d):
    return S.group_table(table(spark, d, "events"), "user_id", 5)


@query("fold_strat_group", f"""with c as (select user_id, event_type, count(*) as n from events group by 1, 2),
    g as (select user_id, sum(n)::bigint as n_rows, arg_min(event_type, (-n, event_type)) as major from c group by 1)
    select user_id, n_rows, {_deal('row_number() over (partition by major order by n_rows desc, user_id)', 3)} as own from g""")
def _strat_group(spark, d):
    return S.group_table(table(spark, d, "events"), "user_id", 3, "event_type")


_ET = "t as (select event_id, ts, user_id, row_number() over (order by ts, event_id) as p, count(*) over () as n from events)"
_OT = "t as (select o_orderkey, o_orderdate, row_number() over (order by o_orderdate, o_orderkey) as p, count(*) over () as n from orders)"


@query("fold_time", f"""with {_OT}, w as (select t.*, f.fold, n - (4 - f.fold) * (n // 5) as start from t, {_LONG.format(k=4)})
    select o_orderkey, fold, case when p <= start then 'train' else 'validate' end as role from w where p <= start + n // 5""")
def _time(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return S.time_folds(o, "o_orderdate", "o_orderkey", 4).drop("o_orderdate")


_GT = """t as (select o_orderkey, case when o_orderkey % 3 <> 0 then o_orderdate end as d from orders),
    p as (select *, row_number() over (order by d nulls last, o_orderkey) as p, count(*) over () as n from t)"""


@query("fold_time_gaps", f"""with {_GT}, w as (select p.*, f.fold, n - (5 - f.fold) * (n // 6) as start from p, {_LONG.format(k=5)})
    select o_orderkey, fold, case when p <= start then 'train' else 'validate' end as role from w where p <= start + n // 6""")
def _time_gaps(spark, d):
    """A third of the rows has no time; fold edges fall among them."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("d"))
    return S.time_folds(o, "d", "o_orderkey", 5).drop("d")


_GG = "e as (select event_id, case when user_id % 5 <> 0 then user_id end as u from events)"


@query("fold_group_gaps", f"""with {_GG}, g as (select u, count(*) as n_rows from e group by 1),
    deal as (select u, {_deal('row_number() over (order by n_rows desc, u nulls last)', 4)} as own from g)
    select event_id, own from e join deal on e.u is not distinct from deal.u""")
def _group_gaps(spark, d):
    """Rows without an entity stay together and are not lost."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("u"))
    return S.assign_group(e, "u", 4).select("event_id", "own")


_LOCAL = f"""b as (select o_orderkey, o_orderdate, month(o_orderdate) as m, ntile(4) over (partition by month(o_orderdate) order by o_orderdate, o_orderkey) - 1 as b from orders),
    loc as (select o_orderkey, o_orderdate, m, fold, case when b <= fold then 'train' else 'validate' end as role from b, {_LONG.format(k=3)} where b <= fold + 1)"""


@query("fold_time_local", f"with {_LOCAL} select o_orderkey, fold, role from loc")
def _local(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return S.time_local_folds(o, "o_orderdate", "month_of:o_orderdate", "o_orderkey", 3).select("o_orderkey", "fold", "role")


@query("fold_rolling", f"""with {_ET}, w as (select t.*, f.fold, n - (2 - f.fold) * 300 as stop from t, {_LONG.format(k=3)})
    select event_id, fold, case when p > stop - 300 then 'validate' else 'train' end as role from w where p <= stop - 350 or (p > stop - 300 and p <= stop)""")
def _rolling(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    return S.rolling_folds(e, "ts", "event_id", 3, 300, 50).drop("ts")


ORIGINS = f"""{_ET}, w as (select t.*, f.fold, n - 3 * greatest(1, floor(n * 0.1)::bigint) + f.fold * greatest(1, floor(n * 0.1)::bigint) as start,
    greatest(1, floor(n * 0.1)::bigint) as len, floor(n * 0.05)::bigint as gap from t, {_LONG.format(k=3)}),
    origins as (select * exclude (role), role from (select *, unnest(['naive_train', 'embargo_train', 'test']) as role from w)
    where start - gap >= 10 and case role when 'naive_train' then p <= start when 'embargo_train' then p <= start - gap else p > start and p <= start + len end)"""


@query("origins_embargo", f"with {ORIGINS} select event_id, fold, role from origins")
def _origins(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    return S.embargo_origins(e, "ts", "event_id").drop("ts")


@query("carve_key", f"""with r as (select *, row_number() over (partition by quality order by {sql_hash(42, 'doc_id')}, doc_id) as p, count(*) over (partition by quality) as n from labels),
    m as (select *, p <= floor(n * 0.25 + 0.5) as held from r)
    select 'work' as part, doc_id, toxic, quality from m where not held union all select 'features', doc_id, toxic, null from m where held
    union all select 'answer', doc_id, null, quality from m where held""")
def _carve_key(spark, d):
    work, features, answer = S.carve_key(table(spark, d, "labels"), "doc_id", "quality", 0.25, label="quality")
    out = work.withColumn("part", F.lit("work"))
    for name, part in (("features", features), ("answer", answer)):
        out = out.unionByName(part.withColumn("part", F.lit(name)), allowMissingColumns=True)
    return out


@query("carve_group", f"""with g as (select distinct user_id from events), r as (select user_id, row_number() over (order by {sql_hash(42, 'user_id')}, user_id) as p, count(*) over () as n from g)
    select event_id, user_id in (select user_id from r where p <= floor(n * 0.3 + 0.5)) as held from events""")
def _carve_group(spark, d):
    work, held = S.carve_groups(table(spark, d, "events").select("event_id", "user_id"), "user_id", 0.3)
    return work.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True))).drop("user_id")


@query("carve_time", f"with {_OT} select o_orderkey, p <= floor(n * 0.7) as is_train from t")
def _carve_time(spark, d):
    return S.carve_time(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("carve_local", """with t as (select event_id, (isodow(ts) - 1) as p, epoch_us(ts) as us from events),
    q as (select p, quantile_cont(us::double, 2.0 / 3) as cut from t group by p) select event_id, us::double <= cut as is_train from t join q using (p)""")
def _carve_local(spark, d):
    return S.carve_local(table(spark, d, "events").select("event_id", "ts"), "ts", "dayofweek_of:ts").drop("ts")


@query("boundary_split", f"with {_ET} select event_id, p > floor(n * 0.8) as after from t")
def _boundary(spark, d):
    return S.boundary_split(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id").drop("ts")


@query("permute_labels", f"""with a as (select event_id, row_number() over (order by event_id) as p from events),
    b as (select user_id, row_number() over (order by {sql_hash(11, 'event_id')}, event_id) as p from events) select event_id, user_id from a join b using (p)""")
def _permute(spark, d):
    return S.permute_labels(table(spark, d, "events"), "event_id", "user_id", seed=11)


@query("fold_check", """select * from (values ('group', 0), ('group', 1), ('group', 2), ('time', 0), ('time', 1), ('time', 2),
    ('time_local', 0), ('time_local', 1), ('time_local', 2), ('rolling', 0), ('rolling', 1)) t(strategy, f)""".replace("select *", "select strategy, f::bigint as fold, 0::bigint as violations"))
def _check(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id")
    checks = {
        "group": S.check_relation(S.group_folds(e, "user_id", 3), group="user_id"),
        "time": S.check_relation(S.time_folds(e, "ts", "event_id", 3), time="ts", key="event_id"),
        "time_local": S.check_relation(S.time_local_folds(e, "ts", "dayofweek_of:ts", "event_id", 3), time="ts", key="event_id", period="dayofweek_of:ts"),
        "rolling": S.check_relation(S.rolling_folds(e, "ts", "event_id", 2, 200, 20), time="ts", key="event_id")}
    out = None
    for name, one in checks.items():
        one = one.select(F.lit(name).alias("strategy"), "fold", "violations")
        out = one if out is None else out.unionByName(one)
    return out


def _expanding_positions(n):
    """Three origins, the training rows before the last twentieth as every second one."""
    for i in range(1, 4):
        cut = i * n // 4
        yield range(0, cut - cut // 20, 2), range(cut, cut + n // 4)


@query("splitter_folds", """with r as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as pos, count(*) over () as n from orders),
    f as (select v - 1 as fold, v as i from range(1, 4) t(v)), c as (select *, i * n // 4 as cut from r, f)
    select o_orderkey, fold, 'train' as role from c where pos < cut - cut // 20 and pos % 2 = 0 union all select o_orderkey, fold, 'validate' from c where pos >= cut and pos < cut + n // 4""")
def _splitter(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    folds = S.make_folds(orders, {"strategy": "time", "time_column": "o_orderdate"}, "o_orderkey", 3, splitter=S.by_positions(_expanding_positions))
    return folds.select("o_orderkey", "fold", "role")
