"""Following the append-only ledger: the same views kept up to date as runs are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.ledger import BOARD


def follow(spark: SparkSession, path: str, schema: T.StructType = BOARD) -> DataFrame:
    """New ledger rows as a stream; files are read once, in the order they appear."""
    return spark.readStream.schema(schema).json(path)


def verdict_counts(rows: DataFrame) -> DataFrame:
    """Running number of verdicts per metric; state grows with the metrics, not with the runs."""
    return rows.groupBy("metric", F.coalesce("verdict", F.lit("single")).alias("verdict")).agg(F.count("*").alias("n"))
