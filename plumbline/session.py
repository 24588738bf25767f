"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",     # copies go with the frames that read them
}

LEAST_ROWS, MOST_ROWS = 10_000, 250_000     # of a part that rows are dealt to


def get_spark(app: str = "plumbline", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this library expects; extra settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_folder(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        # a machine-local folder is only ever chosen for single-process sessions
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
    sc.setCheckpointDir(folder)


def stable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder.

    Used where two reads must see the same physical layout (range partitions) or where a driver
    loop would otherwise grow the plan. The copy survives the loss of executors.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` kept by the executors, on their disks beyond their memory, while the block runs; what a caller keeps stays theirs.

    Used where many passes would compute the same rows anew. A lost executor's part is computed again.
    """
    level = df.storageLevel
    if level.useMemory or level.useDisk:
        yield df
        return
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


@contextmanager
def dealt(df: DataFrame) -> Iterator[DataFrame]:
    """The rows of ``df`` dealt evenly over the cores and kept like :func:`kept` while the block runs; what a caller keeps is taken as it is.

    Used where much is computed from a table that is read: a file is few tasks (no more than it has row groups), and all that
    follows from it without a shuffle has no more of them, however many cores there are.
    """
    level = df.storageLevel
    if level.useMemory or level.useDisk:
        yield df
        return
    parts = even_parts(df.count(), df.sparkSession.sparkContext.defaultParallelism)
    with kept(df.repartition(parts) if parts else df) as even:
        yield even


def even_parts(n: int, cores: int) -> int | None:
    """Parts of ``n`` rows: two for every core unless that leaves them too small, more where they would be too large. None for
    rows that one task may hold: they stay as they lie, since learners draw by part."""
    return None if n <= MOST_ROWS else max(min(2 * cores, -(-n // LEAST_ROWS)), -(-n // MOST_ROWS))
