"""A training corpus from raw documents in stages; each stage reads what its predecessor wrote.

All stages but the last return the columns of ``documents``, whatever further ones there are and however they are
named. Texts may be null, empty or of any length; empty tables give empty tables. Rows that share an id or lack one are never lost
by accident: each docstring says what becomes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, neardup, packing, quality, substrings
from plumbline.llm.common import settled, table, vocabulary_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go, row by row: null and empty texts have no words and fail; repeated rows and null ids are judged as any other."""
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays. Null and empty texts link with nothing and stay;
    so do rows with a null id. Rows that share an id are one document: they stay or go together."""
    return neardup.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document with a smaller id holds leave the text; the documents stay, also with an empty text.
    Texts that lose nothing keep their white space; the others are their kept words joined by a space. Rows with a null id
    keep their text, and rows that share an id are no smaller than each other. ``n_chars`` follows the text."""
    return substrings.cleaned(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, row by row; null and empty texts and items hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all remaining documents in sequences of 1024; a null or empty text is one id, repeated rows get pieces each."""
    return packing.pack(docs, vocabulary_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: Packing works on token ids, which SQL cannot make.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; between two of them the documents are a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settled(docs)
    return docs
