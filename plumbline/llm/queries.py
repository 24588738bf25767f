"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bytebpe, decontaminate, licences, mainhtml, materialise, neardup, packing, periodic, quality, sharding, substrings, tokencount, vectorcodes
from plumbline.llm.common import table, vocabulary_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TOKENIZER = "byte_bpe_50k.json"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_file(TOKENIZER))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).drop("places")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents"), vocabulary_file(TOKENIZER))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select("kept.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).select("kept.doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("kept.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("passes").alias("kept"), "n_stop_words", "n_lines", "n_symbol_lines")


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise.materialise(table(spark, sf_dir, "documents"), vocabulary_file(TOKENIZER), key=20)


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.main_text(table(spark, sf_dir, "pages"))


@query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def with_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Of about every tenth document, the words from a place on repeat with a period. Both follow from its id; a null id changes nothing."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (1 + (n - a) // p))[:n - a]


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), edit=with_tail, digests=True)
    best = F.when(F.size("runs") > 0, periodic.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    found = found.withColumn("best", best)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
                        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise("")), 256).alias("runs_sha256"),
                        F.col("collapsed").alias("collapsed_sha256"))


@query
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary_file("byte_bpe_50k.tiktoken")
    encoded = bytebpe.encode(table(spark, sf_dir, "documents"), ranks)
    decoded = bytebpe.decode(encoded.withColumn("doc_id", F.struct("doc_id", "n_inside", F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"))), ranks, with_text=False)
    return decoded.select("doc_id.doc_id", "n_tokens", "doc_id.ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"), "doc_id.n_inside")


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    labels = found.rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    rows = found.rows.join(labels, F.col("label").eqNullSafe(F.col("of")))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return rows.select("vec_id", code.alias("code"), "error", "label_error", F.lit(vectorcodes.digest(found.codebooks)).alias("codebooks_sha256"))
