"""Column profile, structural flags, correlation scans and target statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import (
    PERIOD_KINDS, all_of, col_type, is_correlatable, is_floating, is_number, is_temporal, is_text, keyed_hash, parse_time)
from plumbline.operators.ordering import column_quantiles

# Thresholds of the profile and its flags.
ID_LIKE_UNIQUE_FRAC = 0.99
MAX_UNPARSEABLE_FRAC = 0.05
PARSE_SAMPLE = 200
MAX_EXAMPLES = 5
MAX_EXAMPLE_LEN = 40
HIGH_MISSING = 0.5
HIGH_CARD_TEXT = 0.9
LEAK_CORRELATION = 0.9
MAX_CLASS_VALUES = 20
TEXT_MIN_AVG_LEN = 25
TEXT_MIN_UNIQUE_FRAC = 0.5
TEXT_MIN_NON_NULL = 30
TEXT_EXAMPLES = 6
TEXT_EXAMPLE_CHARS = 160

_BLOCK = 9           # correlations per aggregate
_HEAD_ROWS = 1_000   # rows looked at first for examples; a miss falls back to the whole column


def approx_distinct(name: str) -> Column:
    """Aggregate: a HyperLogLog estimate (about 1.6 % error) held in one binary buffer per column."""
    q = F.col(f"`{name}`")
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(q.isNotNull(), F.xxhash64(q)), F.lit(12)))


def _long(row: DataFrame, entries: Sequence[Column]) -> DataFrame:
    return row.select(F.inline(F.array(*entries)))


def profile(df: DataFrame, target: str, *, distinct: str = "exact") -> DataFrame:
    """One row per column: type, missingness, distinct count, id-likeness, period tokens for real dates.

    ``distinct`` is ``"exact"``, ``"approx"`` (HyperLogLog, one scan without a value shuffle) or
    ``"screened"``: approximate first, then exact counts only for columns that could reach a flag
    threshold; continuous columns are only told apart from constants (``n_unique`` NULL when they vary). Text columns that merely look like dates need :func:`probe_datetime`.
    """
    names = df.columns
    if distinct == "exact":
        row = df.agg(F.count(F.lit(1)).alias("n"),
                     *[F.count(F.col(f"`{c}`")).alias(f"f{i}") for i, c in enumerate(names)],
                     *[F.count_distinct(F.col(f"`{c}`")).alias(f"u{i}") for i, c in enumerate(names)])
    else:
        row = _sketched_counts(df, refine=distinct == "screened")
    n = F.col("n")
    entries = []
    for i, c in enumerate(names):
        t = col_type(df, c)
        found, unique = F.col(f"f{i}"), F.col(f"u{i}")
        entries.append(F.struct(
            F.lit(c).alias("name"), F.lit(c == target).alias("is_target"),
            F.lit(t.simpleString()).alias("dtype"), n.alias("n_rows"),
            (n - found).alias("n_missing"),
            F.when(n > 0, F.round((n - found) / n, 3)).otherwise(0.0).alias("missing_frac"),
            unique.alias("n_unique"),
            F.when(n > 0, F.round(unique / n, 3)).otherwise(0.0).alias("unique_frac"),
            (F.lit(not is_floating(t)) & (n > 0) & (F.try_divide(unique, n) >= ID_LIKE_UNIQUE_FRAC)).alias("id_like"),
            F.array(*[F.lit(p) for p in (period_tokens(c) if is_temporal(t) else [])]).cast("array<string>")
             .alias("period_candidates")))
    return _long(row, entries)


def _sketched_counts(df: DataFrame, refine: bool) -> DataFrame:
    """One row ``n, f0, u0, f1, u1, ...`` (rows, filled, distinct) from one scan with sketches.

    With ``refine`` every column that could reach a flag threshold is counted exactly in a second scan
    of just those columns: possible constants, and anything above half the lowest share threshold,
    some thirty standard errors of the sketch below it. Kept apart because sketches and exact distincts
    in one aggregate would build a sketch per value.
    """
    names = df.columns
    plain = {i for i, c in enumerate(names) if refine and is_floating(col_type(df, c))}
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"f{i}") for i, c in enumerate(names)],
                 *[(F.min(F.col(f"`{c}`")) < F.max(F.col(f"`{c}`")) if i in plain else approx_distinct(c)).alias(f"u{i}")
                   for i, c in enumerate(names)]).first()
    unique = {i: (None if row[f"u{i}"] else min(1, row[f"f{i}"])) if i in plain else row[f"u{i}"] or 0 for i in range(len(names))}
    if refine:
        near = [i for i in range(len(names)) if i not in plain and (
            unique[i] <= 3 or unique[i] / row["n"] >= HIGH_CARD_TEXT / 2)]
        if near:
            exact = df.agg(*[F.count_distinct(F.col(f"`{names[i]}`")).alias(f"u{i}") for i in near]).first()
            unique.update({i: exact[f"u{i}"] for i in near})
    fields = ["n bigint"] + [f"f{i} bigint, u{i} bigint" for i in range(len(names))]
    flat = [row["n"]] + [v for i in range(len(names)) for v in (row[f"f{i}"], unique[i])]
    return df.sparkSession.createDataFrame([tuple(flat)], ", ".join(fields))


def period_tokens(name: str) -> list[str]:
    return [f"{kind}_of:{name}" for kind in PERIOD_KINDS]


def structural_flags(prof: DataFrame) -> DataFrame:
    """Long ``(check, column, value)`` rows for ids, constants, missingness and free text."""
    p = prof.where(~F.col("is_target"))
    checks = [
        ("id_like", F.col("id_like"), F.col("unique_frac")),
        ("constant", F.col("n_unique") <= 1, F.col("n_unique").cast("double")),
        ("high_missing", F.col("missing_frac") > HIGH_MISSING, F.col("missing_frac")),
        ("high_card_text", (F.col("dtype") == "string") & ~F.col("id_like")
         & (F.col("unique_frac") > HIGH_CARD_TEXT), F.col("unique_frac")),
    ]
    rows = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(check).alias("check"), F.col("name").alias("column"), value.alias("value")))
        for check, test, value in checks]))
    return p.select(F.inline(rows))


def examples(df: DataFrame, key: str, columns: Sequence[str] | None = None, *, count: int = MAX_EXAMPLES,
             max_len: int = MAX_EXAMPLE_LEN, ellipsis: bool = True) -> DataFrame:
    """First distinct non-null values of each column in key order, as text cut to ``max_len``.

    A bounded head answers for columns that vary early; only the others are grouped over the whole
    table, one column-pruned scan each.
    """
    names = [c for c in (df.columns if columns is None else columns)]
    k = F.col(f"`{key}`")

    def long(source, cols):
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])
        return source.select(k.alias("_k"), F.inline(pairs)).where("value IS NOT NULL")

    head = long(df.select(k, *[F.col(f"`{c}`") for c in names if c != key]).orderBy(k).limit(_HEAD_ROWS), names)
    enough = {r.name for r in head.groupBy("name").agg(F.count_distinct("value").alias("d"))
              .where(F.col("d") >= count).collect()}
    first = head.where(F.col("name").isin(list(enough))).groupBy("name", "value").agg(F.min("_k").alias("_k"))
    for c in names:
        if c not in enough:
            one = long(df.select(k, F.col(f"`{c}`")), [c]) if c != key else long(df.select(k), [c])
            first = first.unionByName(one.groupBy("name", "value").agg(F.min("_k").alias("_k"))
                                      .orderBy("_k", "value").limit(count))
    # at most _HEAD_ROWS rows per column reach this window
    place = F.row_number().over(Window.partitionBy("name").orderBy("_k", "value"))
    cut = F.substring("value", 1, max_len)
    if ellipsis:
        cut = F.when(F.length("value") > max_len, F.concat(F.substring("value", 1, max_len - 3), F.lit("..."))) \
               .otherwise(F.col("value"))
    shown = first.withColumn("_p", place).where(F.col("_p") <= count).withColumn("_s", F.struct("_p", cut.alias("v")))
    return shown.groupBy("name").agg(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["v"]).alias("examples"))


def probe_datetime(df: DataFrame, key: str, columns: Sequence[str] | None = None, seed: int = 0) -> DataFrame:
    """``(name, sampled, unparseable, datetime_like, period_candidates)`` for every column.

    Real dates pass, numbers never do, text passes when at most 5 % of a seeded sample of 200
    values fails to parse. The sample is the 200 smallest key hashes: a top-k, never a sort.
    """
    spark = df.sparkSession
    out = None
    for c in df.columns if columns is None else columns:
        t = col_type(df, c)
        q = F.col(f"`{c}`")
        if is_text(t):
            sample = (df.where(q.isNotNull()).select(q.alias("v"), keyed_hash(seed, key).alias("h"), F.col(f"`{key}`").alias("k"))
                      .orderBy("h", "k").limit(PARSE_SAMPLE))
            one = sample.agg(F.count("*").alias("sampled"), F.count_if(parse_time(F.col("v")).isNull()).alias("unparseable"))
            one = one.select(F.lit(c).alias("name"), "sampled", "unparseable",
                             ((F.col("sampled") > 0) & (F.col("unparseable") <= MAX_UNPARSEABLE_FRAC * F.col("sampled")))
                             .alias("datetime_like"))
        else:
            one = spark.range(1).select(F.lit(c).alias("name"), F.lit(0).cast("bigint").alias("sampled"),
                                        F.lit(0).cast("bigint").alias("unparseable"), F.lit(is_temporal(t)).alias("datetime_like"))
        out = one if out is None else out.unionByName(one)
    tokens = F.array(*[F.concat(F.lit(f"{kind}_of:"), F.col("name")) for kind in PERIOD_KINDS])
    return out.withColumn("period_candidates", F.when(F.col("datetime_like"), tokens).otherwise(F.array().cast("array<string>")))


def numeric_target(df: DataFrame, target: str) -> Column | None:
    """The target as a number: itself, or 0/1 for a two-valued text target, else None."""
    y = F.col(f"`{target}`")
    if is_correlatable(col_type(df, target)):
        return y.cast("double")
    two = [r[0] for r in df.where(y.isNotNull()).select(y).distinct().limit(3).collect()]
    if len(two) != 2:
        return None
    return (y == F.lit(min(two))).cast("double")


def correlations(df: DataFrame, target: str, columns: Sequence[str] | None = None, min_pairs: int = 0) -> DataFrame:
    """``(column, n_pairs, r_abs)`` against the target for all numeric columns; NULL where one side is constant.

    Columns go through in blocks, each its own column-pruned aggregate: more buffers than about a
    hundred in one aggregate would switch compiled execution off.
    """
    y = numeric_target(df, target)
    names = [c for c in (df.columns if columns is None else columns) if c != target and c in df.columns]
    usable = [c for c in names if y is not None and is_correlatable(col_type(df, c))]
    spark = df.sparkSession
    schema = "column string, n_pairs bigint, r_abs double"
    out = spark.createDataFrame([(c, 0, None) for c in names if c not in usable], schema)
    for start in range(0, len(usable), _BLOCK):
        block = usable[start:start + _BLOCK]
        aggs, rows = [], []
        for i, c in enumerate(block):
            x = F.col(f"`{c}`").cast("double")
            aggs += [F.regr_count(y, x).alias(f"n{i}"), F.regr_r2(y, x).alias(f"r{i}"), F.regr_syy(y, x).alias(f"s{i}")]
            value = F.when((F.col(f"n{i}") >= min_pairs) & (F.col(f"s{i}") > 0), F.sqrt(F.col(f"r{i}")))
            rows.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_pairs"), value.alias("r_abs")))
        out = out.unionByName(_long(df.agg(*aggs), rows))
    return out


def leak_scan(df: DataFrame, target: str) -> DataFrame:
    """Numeric features that are near-copies of the target: ``(column, r_abs)``, strongest first."""
    return (correlations(df, target).where(F.col("r_abs") > LEAK_CORRELATION)
            .select("column", F.round("r_abs", 3).alias("r_abs")).orderBy(F.desc("r_abs"), "column"))


def is_classification(df: DataFrame, target: str) -> DataFrame:
    """One row ``(target, n_unique, classification)``; numbers are classes only when few and whole."""
    y = F.col(f"`{target}`")
    t = col_type(df, target)
    n = df.agg(F.count_distinct(y).alias("n_unique"), *([(F.count_if(y != F.floor(y)) == 0).alias("w")] if is_number(t) else []))
    verdict = F.col("w") & (F.col("n_unique") <= MAX_CLASS_VALUES) if is_number(t) else F.lit(True)
    return n.select(F.lit(target).alias("target"), "n_unique", verdict.alias("classification"))


def looks_like_classes(df: DataFrame, target: str) -> bool:
    """:func:`is_classification` as a plain answer, without an exact distinct count of a continuous target."""
    y = F.col(f"`{target}`")
    if not is_number(col_type(df, target)):
        return True
    row = df.agg(approx_distinct(target).alias("a"), (F.count_if(y != F.floor(y)) == 0).alias("w")).first()
    if not row["w"] or row["a"] > 4 * MAX_CLASS_VALUES:
        return False
    return df.select(y).where(y.isNotNull()).distinct().limit(MAX_CLASS_VALUES + 1).count() <= MAX_CLASS_VALUES


def target_stats(df: DataFrame, target: str) -> DataFrame:
    """Distribution of the target; quantiles are exact, skewness is sample-adjusted; 4 decimals."""
    y = F.col(f"`{target}`")
    t = col_type(df, target)
    base = [F.lit(t.simpleString()).alias("dtype"), F.col("n_unique")]
    if not is_number(t):
        return df.agg(F.count_distinct(y).alias("n_unique")).select(*base)
    x = y.cast("double")
    q = column_quantiles(df.select(y.alias(target)), [target], [0.25, 0.5, 0.75]).get(target, [None] * 3)
    n = F.col("n").cast("double")
    adjust = F.try_divide(F.sqrt(n * (n - 1)), F.when(n > 2, n - 2))
    row = df.agg(F.count_distinct(y).alias("n_unique"), F.count(x).alias("n"), F.min(x).alias("lo"),
                 F.avg(x).alias("mean"), F.max(x).alias("hi"),
                 F.when(F.min(x) < F.max(x), F.skewness(x)).alias("skew"))
    lit = [F.lit(v).cast("double") for v in q]
    return row.select(*base, F.round("lo", 4).alias("min"), F.round(lit[0], 4).alias("p25"),
                      F.round(lit[1], 4).alias("median"), F.round("mean", 4).alias("mean"),
                      F.round(lit[2], 4).alias("p75"), F.round("hi", 4).alias("max"),
                      F.round(F.col("skew") * adjust, 4).alias("skewness"))


def text_measures(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(name, n_non_null, n_unique, len_mean, len_max)`` for every text column, one aggregate."""
    names = [c for c in (df.columns if columns is None else columns) if is_text(col_type(df, c))]
    aggs, rows = [], []
    for i, c in enumerate(names):
        q = F.col(f"`{c}`")
        # 128-bit digests keep long texts out of the distinct shuffle
        aggs += [F.count(q).alias(f"n{i}"), F.count_distinct(F.md5(q)).alias(f"u{i}"),
                 F.avg(F.length(q)).alias(f"a{i}"), F.max(F.length(q)).cast("bigint").alias(f"m{i}")]
        rows.append(F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("n_non_null"), F.col(f"u{i}").alias("n_unique"),
                             F.col(f"a{i}").alias("len_mean"), F.col(f"m{i}").alias("len_max")))
    if not rows:
        return df.sparkSession.createDataFrame(
            [], "name string, n_non_null bigint, n_unique bigint, len_mean double, len_max bigint")
    return _long(df.agg(*aggs), rows)


def detect_text(df: DataFrame, target: str) -> DataFrame:
    """Free-text columns: long, mostly distinct, filled often enough, not the target."""
    return text_measures(df, [c for c in df.columns if c != target]).where(all_of([
        F.col("n_non_null") >= TEXT_MIN_NON_NULL, F.col("len_mean") >= TEXT_MIN_AVG_LEN,
        F.try_divide(F.col("n_unique"), F.col("n_non_null")) >= TEXT_MIN_UNIQUE_FRAC]))


def text_profile(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Text measures plus the first distinct values, cut to 160 characters."""
    shown = examples(df, key, columns, count=TEXT_EXAMPLES, max_len=TEXT_EXAMPLE_CHARS, ellipsis=False)
    return text_measures(df, columns).withColumn("len_mean", F.round("len_mean", 1)).join(shown, "name", "left")
