"""Reading tables, guarding inputs and shaping them for an experiment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import keyed_hash, nan_to_null
from plumbline.operators.ordering import global_rank, tuple_cuts, within_cut

MIN_ROWS = 50                                   # fixed value: fewer rows carry no judgment
TRUTHY = ("TRUE", "1", "T", "YES")              # fixed values: texts that mean yes


def read_csv(spark: SparkSession, path: str, *, schema: T.StructType | str | None = None, header: bool = True,
             sep: str = ",", names: Sequence[str] | None = None) -> DataFrame:
    """Delimited text. Give a schema at scale; without one the file is scanned once more to infer it."""
    reader = spark.read.option("header", header).option("sep", sep)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return nan_to_null(df.toDF(*names) if names else df)


def load_table(spark: SparkSession, path: str, *, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A table by file extension: csv/tsv, json/jsonl, otherwise parquet."""
    lower = path.lower().rstrip("/")
    if lower.endswith((".csv", ".csv.gz")):
        return read_csv(spark, path, schema=schema, **options)
    if lower.endswith((".tsv", ".tsv.gz")):
        return read_csv(spark, path, schema=schema, sep="\t", **options)
    if lower.endswith((".json", ".jsonl")):
        return nan_to_null((spark.read.schema(schema) if schema is not None else spark.read).json(path))
    return nan_to_null(spark.read.parquet(path))


def write_predictions(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Prediction table as headed CSV; one file per partition, never one task for the whole table."""
    df.write.mode(mode).option("header", True).csv(path)


def guard_inputs(df: DataFrame, required: Sequence[str], min_rows: int = MIN_ROWS) -> DataFrame:
    """One row ``(verdict, reason, n_rows)``: ok, or a reasoned rejection."""
    absent = [c for c in required if c not in df.columns]
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    reason = F.when(F.lit(bool(absent)), F.lit("missing column: " + ",".join(absent))) \
              .when(F.col("n_rows") == 0, F.lit("no rows")) \
              .when(F.col("n_rows") < min_rows, F.concat(F.lit("only "), F.col("n_rows").cast("string"),
                                                         F.lit(f" rows, need {min_rows}")))
    return n.select(F.when(reason.isNull(), "ok").otherwise("rejected").alias("verdict"),
                    F.coalesce(reason, F.lit("")).alias("reason"), "n_rows")


def infer_task(train: DataFrame, test: DataFrame, sample: DataFrame) -> DataFrame:
    """One row ``(id_column, target, shape, ok)`` read off the three tables of a prediction task.

    The id is the first sample column that test also has. The target is the only other sample column
    when train has it; else the only train column that test lacks, provided its distinct values are
    exactly the sample's class columns.
    """
    shared = [c for c in sample.columns if c in test.columns]
    id_col = shared[0] if shared else sample.columns[0]
    outputs = [c for c in sample.columns if c != id_col]
    spark = train.sparkSession

    def answer(target, shape, ok):
        return spark.range(1).select(F.lit(id_col).alias("id_column"), F.lit(target).cast("string").alias("target"),
                                     F.lit(shape).alias("shape"), F.lit(ok).alias("ok"))

    if len(outputs) == 1 and outputs[0] in train.columns:
        return answer(outputs[0], "single", True)
    missing = [c for c in train.columns if c != id_col and c not in test.columns]
    if len(missing) != 1:
        return answer(None, "unsupported", False)
    target = missing[0]
    named = F.col("v").isin(outputs)
    # one row per class reaches the final aggregate; the target itself is pre-aggregated
    values = train.where(F.col(f"`{target}`").isNotNull()).select(F.col(f"`{target}`").cast("string").alias("v")).distinct()
    return values.agg((F.count_if(~named) == 0).alias("known"), F.count_if(named).alias("hit")).select(
        F.lit(id_col).alias("id_column"),
        F.when(F.col("known") & (F.col("hit") == len(outputs)), F.lit(target)).alias("target"),
        F.when(F.col("known") & (F.col("hit") == len(outputs)), "per_class").otherwise("unsupported").alias("shape"),
        (F.col("known") & (F.col("hit") == len(outputs))).alias("ok"))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows chosen by key hash, without sorting the table: one cut point, then a filter."""
    h = keyed_hash(seed, key)
    cuts = tuple_cuts(df, h, key, lambda g, size: [min(n, size)])
    if not cuts:
        return df.limit(0)
    (size, at), = cuts.values()
    return df if n >= size else df.where(within_cut(h, F.col(f"`{key}`"), at.get(n)))


def drop_columns(names: Sequence[str], *tables: DataFrame) -> tuple[DataFrame, ...]:
    """The same columns (known leaks) removed from every table."""
    return tuple(t.drop(*names) for t in tables)


def shape(df: DataFrame, target: str, *, keep: Sequence[str] | None = None, drop: Sequence[str] = (),
          rename: Mapping[str, str] | None = None) -> DataFrame:
    """Keep, drop, rename; rows without a target are removed."""
    out = df.select(*[c for c in (keep or df.columns) if c not in drop])
    return out.withColumnsRenamed(dict(rename or {})).na.drop(subset=[(rename or {}).get(target, target)])


def anonymize(df: DataFrame, target: str, id_col: str | None = None) -> DataFrame:
    """Features become ``x1..xn`` in column order and the target ``y``; an id keeps its name."""
    features = [c for c in df.columns if c not in (target, id_col)]
    names = {c: f"x{i}" for i, c in enumerate(features, 1)} | {target: "y"}
    return df.na.drop(subset=[target]).withColumnsRenamed(names)


def with_row_id(df: DataFrame, order: Sequence[Column | str], name: str = "id") -> DataFrame:
    """A dense 0-based row id in the given order (end it with a unique key); kept when already there."""
    if name in df.columns:
        return df
    return global_rank(df, order, name=name).withColumn(name, F.col(name) - 1)


def composite_key(columns: Sequence[str]) -> Column:
    return F.concat_ws("_", *[F.col(f"`{c}`").cast("string") for c in columns])


def row_weights(column: Column, heavy: float = 5.0) -> Column:
    """``heavy`` where the text says yes, else 1."""
    return F.when(F.upper(column.cast("string")).isin(list(TRUTHY)), F.lit(float(heavy))).otherwise(F.lit(1.0))
