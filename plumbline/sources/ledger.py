"""The append-only run ledger: one row per run, JSON lines in a directory."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_failed = T.ArrayType(T.StructType([T.StructField("seed", T.IntegerType()), T.StructField("error", T.StringType())]))

RUNS = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("target", T.StringType()), T.StructField("arm", T.StringType()),
    T.StructField("attempts", T.IntegerType()), T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("cv", T.StructType([
        T.StructField("metric", T.StringType()), T.StructField("mean", T.DoubleType()),
        T.StructField("std", T.DoubleType()), T.StructField("folds", T.IntegerType()),
        T.StructField("fold_scores", T.ArrayType(T.DoubleType()))])),
    T.StructField("shift_auc", T.DoubleType()), T.StructField("fold_strategy", T.StringType()),
    T.StructField("n_cols_before", T.IntegerType()), T.StructField("n_cols_clean", T.IntegerType()),
    T.StructField("n_cols_after", T.IntegerType()), T.StructField("plan", T.StringType())])

BOARD = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("metric", T.StringType()), T.StructField("baseline", T.DoubleType()),
    T.StructField("treatment", T.DoubleType()), T.StructField("delta", T.DoubleType()),
    T.StructField("higher_is_better", T.BooleanType()), T.StructField("seeds", T.ArrayType(T.IntegerType())),
    T.StructField("verdict", T.StringType()), T.StructField("mde", T.DoubleType()),
    T.StructField("fold_strategy", T.StringType()), T.StructField("n_train", T.LongType()),
    T.StructField("n_grade", T.LongType()), T.StructField("failed_seeds", _failed)])


def read_ledger(spark: SparkSession, path: str, schema: T.StructType = RUNS) -> DataFrame:
    """All rows of a ledger; a ledger that does not exist yet is empty. Blank lines are skipped."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)
    return (lines.where(F.trim("value") != "")
            .select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*"))


def append_ledger(rows: DataFrame, path: str, timestamp: str) -> None:
    """Append rows stamped by the caller; files already written are never touched."""
    rows.withColumn("timestamp", F.lit(timestamp)).write.mode("append").json(path)
