"""Connected components of an undirected graph given as links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import settled


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Every node links its larger (``large``) or smaller neighbours to the smallest node it knows."""
    near = _both(links)
    if not large:
        near = near.where(F.col("b") < F.col("a"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    out = near.join(least, "a")
    if large:
        return out.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return out.select(F.col("b").alias("a"), F.col("least").alias("b")).where(F.col("a") != F.col("b")).union(least.select("a", F.col("least").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), the component being its smallest node.

    Null ends and loops link nothing. Each round is written to the shared folder, so a lost executor costs
    one round; rounds grow with the logarithm of the longest path.
    """
    now = settled(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())

    state = mark(now)
    while state[0]:
        grown = settled(_star(now, large=True).distinct())
        now = settled(_star(grown, large=False).distinct())
        fresh = mark(now)
        if fresh == state:
            break
        state = fresh
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
