"""What several operators share: words, the shared folder, Arrow columns."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that end a word in texts split at white space.
SPACES = " \t\n\x0b\x0c\r"

#: A-Z become a-z, every ASCII character but letters and digits becomes a space.
ALNUM_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: A-Z become a-z.
CASE_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that other columns can't clash."""
    return df.select(*[df[f"`{c}`"].alias(alias) for alias, c in named.items()])


def alnum_words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_FOLD).split()


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, name: str, limit: int):
    """Parts of a batch with about ``limit`` bytes of text each, so that work arrays stay small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)
    start, held = 0, 0
    for i, n in enumerate(sizes.to_pylist()):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values; empty when there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n].copy()
    for j in range(1, k):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += words[j:j + n]
    return mixed(total)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a local one only for a single process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="plumbline-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_written: list[tuple[weakref.ref, str]] = []


def settled(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read from there.

    Cuts the lineage: later reads see the same rows in the same files, also after executors are lost.
    The copies are removed when the driver's Python ends.
    """
    return settled_at(df, compression)[0]


def settled_at(df: DataFrame, compression: str = "zstd") -> tuple[DataFrame, str]:
    """``settled`` with the folder, for ``remove`` when nothing reads the copy any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _written.append((weakref.ref(spark), path))
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_written() -> None:
    for ref, path in _written:
        try:
            remove(ref(), path)
        except Exception:  # noqa: BLE001 - the session is gone; its folder's owner cleans up
            return


def crc32_text(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def vocabulary_file(name: str) -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers
    return os.fspath(public_tokenizers.path(name))
