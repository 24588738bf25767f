"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL counterpart when there is one."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_hash(seed: int | str, *keys: str) -> str:
    """SQL text of :func:`plumbline.functions.columns.keyed_hash`."""
    text = "||':'||".join([f"'{seed}'"] + [f"cast({k} as varchar)" for k in keys])
    return f"cast('0x'||substr(md5({text}),1,8) as bigint)"
