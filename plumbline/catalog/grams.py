"""Cross-validation from sufficient statistics and counts; the SQL fits every fold on its own training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.registry import query, sql_hash, table
from plumbline.functions.columns import keyed_hash
from plumbline.operators.permute import LEAST_STEP, STEPS, permuted, ranked
from plumbline.plans import bayes as N
from plumbline.plans import gram as M
from plumbline.plans.drivers import permutation_drivers

_X = ["rank", "customer", "month"]


def amounts(spark, d):
    """Orders with a target that depends on priority and month; every eleventh order lacks its customer."""
    o = table(spark, d, "orders")
    rank, month = F.substring("o_orderpriority", 1, 1).cast("int"), F.month("o_orderdate")
    return o.select("o_orderkey", "o_orderdate", "o_orderstatus", rank.alias("rank"), month.alias("month"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("customer"),
                    (rank * 90.0 + month * 40.0 + (keyed_hash(3, "o_orderkey") % 1000)).alias("amount"))


_BASE = f"""base as (select o_orderkey, o_orderdate, substr(o_orderpriority, 1, 1)::double as rank, month(o_orderdate)::double as month,
    case when o_orderkey % 11 <> 0 then o_custkey::double end as customer,
    substr(o_orderpriority, 1, 1)::double * 90 + month(o_orderdate) * 40 + {sql_hash(3, "o_orderkey")} % 1000 as y from orders)"""


def fit_sql(name: str, source: str, pairs: str, columns: list[str], reg: float = 0.0) -> str:
    """CTEs up to ``<name>``: per fold coefficients ``b0..`` at means ``m0..`` and ``my`` of a ridge fit on the rows of ``source``.

    ``source`` has the columns, ``y`` and ``cell``; ``pairs`` is a relation (fold, cell) of training cells. Gaps take the training mean.
    """
    p = len(columns)
    steps = [f"{name}_m as (select fold, count(*) as n_train, avg(y) as my, {', '.join(f'avg({c}) as m{i}' for i, c in enumerate(columns))} from {source} join {pairs} using (cell) group by fold)",
             f"{name}_z as (select fold, y - my as zy, {', '.join(f'coalesce({c}, m{i}) - m{i} as z{i}' for i, c in enumerate(columns))} from {source} join {pairs} using (cell) join {name}_m using (fold))",
             f"{name}_0 as (select fold, " + ", ".join([f"sum(z{i} * z{j}) {f'* {1 + reg}' if i == j else ''} as a{i}_{j}" for i in range(p) for j in range(p)] + [f"sum(z{i} * zy) as c{i}" for i in range(p)]) + f" from {name}_z group by fold)"]
    for s in range(p - 1):      # eliminate column s below row s
        row = [f"a{i}_{j} - a{i}_{s} / a{s}_{s} * a{s}_{j} as a{i}_{j}" if i > s else f"a{i}_{j}" for i in range(p) for j in range(p)]
        right = [f"c{i} - a{i}_{s} / a{s}_{s} * c{s} as c{i}" if i > s else f"c{i}" for i in range(p)]
        steps.append(f"{name}_{s + 1} as (select fold, {', '.join(row + right)} from {name}_{s})")
    back = []
    for i in reversed(range(p)):
        known = "".join(f" - a{i}_{j} * b{j}" for j in range(i + 1, p))
        back.append(f"(c{i}{known}) / a{i}_{i} as b{i}")
    steps.append(f"{name} as (select *, {', '.join(back)} from {name}_{p - 1} join {name}_m using (fold))")
    return ",\n".join(steps)


def pred_sql(name: str, columns: list[str]) -> str:
    return f"{name}.my + " + " + ".join(f"{name}.b{i} * (coalesce({c}, {name}.m{i}) - {name}.m{i})" for i, c in enumerate(columns))


def score_sql(name: str, source: str, pairs: str, columns: list[str]) -> str:
    """Per fold n_train, n_validate, rmse and r2 on the cells of ``pairs`` (fold, cell)."""
    return f"""select fold, any_value(n_train)::bigint as n_train, count(*) as n_validate, sqrt(avg((y - pred) ** 2)) as rmse, 1 - sum((y - pred) ** 2) / (var_pop(y) * count(*)) as r2
        from (select fold, n_train, y, {pred_sql(name, columns)} as pred from {source} join {pairs} using (cell) join {name} using (fold)) group by fold"""


def _random(k: int, seed: int | str = 42) -> str:
    return f"""{_BASE}, s as (select *, {sql_hash(seed, "o_orderkey")} % {k} as cell from base), tr as (select a.v as fold, b.v as cell from range({k}) a(v), range({k}) b(v) where a.v <> b.v),
        va as (select v as fold, v as cell from range({k}) t(v))"""


@query("cv_gram", f"""with {_random(5)}, {fit_sql("f", "s", "tr", _X, 0.01)}
    select 42::bigint as seed, fold, n_train, n_validate, round(rmse, 6) as rmse, round(r2, 8) as r2 from ({score_sql("f", "s", "va", _X)})""")
def _cv(spark, d):
    out = M.cv_gram(amounts(spark, d), "amount", "o_orderkey", _X, k=5, reg=0.01).frame()
    return out.withColumns({"rmse": F.round("rmse", 6), "r2": F.round("r2", 8)})


@query("cv_gram_time", f"""with {_BASE}, r as (select *, row_number() over (order by o_orderdate, o_orderkey) - 1 as pos, count(*) over () as n from base),
    s as (select *, case when pos < n - 4 * (n // 5) then 0 else (pos - (n - 4 * (n // 5))) // (n // 5) + 1 end as cell from r),
    tr as (select a.v as fold, b.v as cell from range(4) a(v), range(5) b(v) where b.v <= a.v), va as (select v as fold, v + 1 as cell from range(4) t(v)), {fit_sql("f", "s", "tr", _X)}
    select 42::bigint as seed, fold, n_train, n_validate, round(rmse, 6) as rmse, round(r2, 8) as r2 from ({score_sql("f", "s", "va", _X)})""")
def _cv_time(spark, d):
    plan = {"strategy": "time", "time_column": "o_orderdate"}
    out = M.cv_gram(amounts(spark, d), "amount", "o_orderkey", _X, k=4, plan=plan).frame()
    return out.withColumns({"rmse": F.round("rmse", 6), "r2": F.round("r2", 8)})


@query("oof_gram", f"""with {_random(3)}, {fit_sql("f", "s", "tr", _X)}
    select o_orderkey, fold, y as label, round({pred_sql("f", _X)}, 6) as pred from s join va using (cell) join f using (fold)""")
def _oof(spark, d):
    return M.cv_gram(amounts(spark, d), "amount", "o_orderkey", _X, k=3).oof(["o_orderkey"]).withColumn("pred", F.round("pred", 6))


_SEEDS, _K = 5, 3


def _arms_sql(arms: dict[str, tuple[list[str], list[str]]], name: str = "arm") -> str:
    """Paired r2 of both lists of each arm over all seeds and folds: a cell and a fold of their own for each seed."""
    cells = " union all ".join(f"select *, {i * _K} + {sql_hash(i, 'o_orderkey')} % {_K} as cell from base" for i in range(_SEEDS))
    lists = [tuple(x) for x in dict.fromkeys(tuple(side) for pair in arms.values() for side in pair)]
    ctes = [_BASE, f"s as ({cells})", f"tr as (select a.v as fold, b.v as cell from range({_SEEDS * _K}) a(v), range({_SEEDS * _K}) b(v) where a.v <> b.v and a.v // {_K} = b.v // {_K})",
            f"va as (select v as fold, v as cell from range({_SEEDS * _K}) t(v))"]
    for i, x in enumerate(lists):
        ctes += [fit_sql(f"f{i}", "s", "tr", list(x)), f"g{i} as ({score_sql(f'f{i}', 's', 'va', list(x))})"]
    rows = " union all ".join(f"select '{arm}' as arm, fold, a.r2 as base, b.r2 as trial from g{lists.index(tuple(x))} a join g{lists.index(tuple(y))} b using (fold)" for arm, (x, y) in arms.items())
    return "with " + ",\n".join(ctes) + f""", p as ({rows}), t as (select arm, count(*) as n, avg(trial - base) as m, stddev_samp(trial - base) as sd, count_if(trial > base) as up, avg(base) as a, avg(trial) as b from p group by arm),
        v as (select *, 2 * sd * sqrt(1 / n + 1 / {_K - 1}) as mde from t)
        select arm as "{name}", n, round(m, 8) as mean_delta, round(mde, 8) as mde, case when m > greatest(1e-4, mde) and up * 2 > n then 'improved' else 'no_improvement' end as verdict,
               round(a, 8) as a_mean, round(b, 8) as b_mean, 'r2' as metric from v"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 8) for c in ("mean_delta", "mde", "a_mean", "b_mean")})


_ARMS = {"with month": (["rank"], ["rank", "month"]), "with customer": (["rank", "month"], ["rank", "month", "customer"])}


@query("compare_gram", _arms_sql(_ARMS))
def _compare(spark, d):
    return _rounded(M.compare_gram(amounts(spark, d), "amount", "o_orderkey", _ARMS, k=_K, seeds=_SEEDS))


@query("ablate_gram", _arms_sql({c: ([x for x in _X if x != c], _X) for c in _X}, "column"))
def _ablate(spark, d):
    return _rounded(M.ablate_gram(amounts(spark, d), "amount", "o_orderkey", _X, k=_K, seeds=_SEEDS))


# ---- counts --------------------------------------------------------------------------------

def events_of_users(spark, d):
    """Events with their user as a level and two coarse numbers; every ninth event lacks its value."""
    e = table(spark, d, "events")
    return e.select("event_id", "event_type", F.col("user_id"), F.hour("ts").alias("hour"), F.when(F.col("event_id") % 9 != 0, F.floor(F.col("value") / 5)).alias("value_bin"))


def bayes_sql(columns: list[str], k: int, seed: int = 42) -> str:
    """Every class scored for every row, from the training rows of its fold."""
    levels = " union all ".join(f"select event_id, fold, y, {i} as c, coalesce({c}::varchar, '<missing>') as v from e" for i, c in enumerate(columns))
    return f"""with e as (select event_id, event_type as y, user_id, hour(ts) as hour, case when event_id % 9 <> 0 then floor(value / 5)::bigint end as value_bin, {sql_hash(seed, "event_id")} % {k} as fold from events where event_type is not null),
    l as ({levels}), f as (select v as fold from range({k}) t(v)),
    t as (select f.fold, c, v, y, count(*) as n from l join f on l.fold <> f.fold group by all), lv as (select fold, c, count(distinct v) as d from t group by all),
    cl as (select f.fold, y, count(*) as n from e join f on e.fold <> f.fold group by all), r as (select fold, sum(n) as n from cl group by fold),
    b as (select cl.fold, cl.y, ln(any_value(cl.n) / any_value(r.n)) + sum(-ln(cl.n + d)) as base from cl join lv using (fold) join r using (fold) group by cl.fold, cl.y),
    s as (select l.event_id, l.fold, l.y as label, b.y as class, any_value(base) + sum(ln(coalesce(t.n, 0) + 1)) as score from l join b on b.fold = l.fold left join t on t.fold = l.fold and t.c = l.c and t.v = l.v and t.y = b.y group by all),
    p as (select event_id, fold, label, class as pred, score from s qualify row_number() over (partition by event_id order by round(score, 9) desc, class) = 1)"""


_LEVELS = ["user_id", "hour", "value_bin"]


@query("oof_bayes", bayes_sql(_LEVELS, 4) + " select event_id, fold, label, pred, round(score, 6) as score from p")
def _oof_counts(spark, d):
    return N.oof_bayes(events_of_users(spark, d), "event_type", "event_id", _LEVELS, k=4).withColumn("score", F.round("score", 6))


@query("cv_bayes", bayes_sql(_LEVELS, 5, 7) + " select fold, count(*) as n_validate, avg((label = pred)::int) as score from p group by fold")
def _cv_counts(spark, d):
    return N.cv_bayes(events_of_users(spark, d), "event_type", "event_id", _LEVELS, k=5, seed=7)


# ---- permutations --------------------------------------------------------------------------

def map_sql(seed: int | str, name: str) -> str:
    """(n, a, b) of the rank map, with ``n`` from the relation ``ranked``."""
    a, b = (sql_hash(seed, f"'{name}'", f"'{x}'") for x in "ab")
    return f"""(select n, {b} % n as b, (select min(v) from range({LEAST_STEP} + {a} % {STEPS}, {LEAST_STEP} + {a} % {STEPS} + 1000) t(v) where gcd(v, n) = 1) as a from (select count(*) as n from ranked))"""


@query("permuted_labels", f"""with ranked as (select o_orderkey, o_orderstatus, row_number() over (order by {sql_hash(0, "o_orderkey")}, o_orderkey) - 1 as r from orders)
    select x.o_orderkey, y.o_orderstatus from ranked x, {map_sql("0/3", "o_orderstatus")} m join ranked y on y.r = (x.r * m.a + m.b) % m.n""")
def _permuted(spark, d):
    rows, n = ranked(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return permuted(rows, n, "o_orderstatus", "0/3").drop("_rank")


def _moved_sql(column: str) -> str:
    values = ", ".join(f"{'s' if c == column else 't'}.{c}" for c in _X)
    return f"select '{column}' as v, t.y, {values} from ranked s, {map_sql(5, column)} m join ranked t on t.r = (s.r * m.a + m.b) % m.n"


@query("permutation_drivers", f"""with {_BASE}, s as (select *, 0 as cell from base), tr as (select 0 as fold, 0 as cell), {fit_sql("f", "s", "tr", _X)},
    ranked as (select *, row_number() over (order by {sql_hash(5, "o_orderkey")}, o_orderkey) - 1 as r from base),
    p as (select v, y - ({pred_sql("f", _X)}) as e from (select '' as v, y, {", ".join(_X)} from ranked union all {" union all ".join(_moved_sql(c) for c in _X)}), f),
    g as (select v, -sqrt(avg(e * e)) as score from p group by v)
    select x.v as "column", round(b.score, 6) as base, round(x.score, 6) as permuted, round(b.score - x.score, 6) as importance from g x, g b where x.v <> '' and b.v = ''""")
def _permutation_drivers(spark, d):
    o = amounts(spark, d)
    columns, fit = M.fit_gram(o, "amount", _X)
    out = permutation_drivers(o, "amount", "o_orderkey", _X, lambda rows: rows.withColumn("pred", M.linear_value(columns, fit)), "rmse", seed=5)
    return out.withColumns({c: F.round(c, 6) for c in ("base", "permuted", "importance")})
