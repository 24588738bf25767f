"""Token ids in training order, written as shards of fixed stride.

The ids of all documents of a task follow each other, each document closed by an end id, and are cut into
sequences of one length. Sequences are numbered over all tasks, and a keyed Feistel permutation of the next
power of four, walked along its cycle until it falls below the number of sequences, gives each its slot: a
shuffle of the whole corpus that can be recomputed for any slot, and undone, without a table. Slots are
dealt in ranges to tasks, each of which holds whole shards and writes them in order. Slot ``s`` stands in shard
``s // per_shard`` at byte ``s % per_shard * stride``; a reader that stopped there begins there.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import columns, mixed, settled
from plumbline.llm.packing import document_ids

ROUNDS = 6


def _round_keys(key: int) -> np.ndarray:
    return mixed(np.uint64(key) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _half_bits(n: int) -> int:
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def _feistel(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for k in keys:
        left, right = right, left ^ (mixed(right + k) & mask)
    return left << shift | right


def slots(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each sequence number: a permutation of 0..n-1."""
    half, keys = _half_bits(n), _round_keys(key)
    out = _feistel(index.astype(np.uint64), half, keys)
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = _feistel(out[far], half, keys)
    return out.astype(np.int64)


def numbers(slot: np.ndarray, n: int, key: int) -> np.ndarray:
    """The sequence number at each slot: the inverse of :func:`slots`."""
    half, keys = _half_bits(n), _round_keys(key)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def back(x):
        left, right = x >> shift, x & mask
        for k in keys[::-1]:
            left, right = right ^ (mixed(left + k) & mask), left
        return left << shift | right

    out = back(slot.astype(np.uint64))
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = back(out[far])
    return out.astype(np.int64)


def sequences(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows part, seq, first_doc, first_start, n_tokens, ids (little-endian unsigned 16-bit, padded with the end id).

    ``first_doc`` and ``first_start`` say which document the sequence begins in and at which of its ids.
    """
    inner = columns(docs, doc_id=id_col, text=text_col)
    kind = inner.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        part, seq = TaskContext.get().partitionId(), 0
        rest, origin = np.empty(0, "<u2"), None
        doc_type = None

        def batch_of(rows):
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], doc_type),
                 pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.binary())],
                ["part", "seq", "first_doc", "first_start", "n_tokens", "ids"])

        for batch in batches:
            doc_type = batch.schema.field(0).type
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = document_ids(text, tokenizer, end_id)
                if int(ids.max()) >= 1 << 16:
                    raise ValueError("ids of this tokenizer don't fit 16 bits")
                ids, used = ids.astype("<u2"), 0
                while len(rest) + len(ids) - used >= length:
                    take = length - len(rest)
                    if not len(rest):
                        origin = (doc, used)
                    rows.append((seq, *origin, length, np.concatenate([rest, ids[used:used + take]]).tobytes()))
                    used += take
                    seq += 1
                    rest = rest[:0]
                if used < len(ids):
                    if not len(rest):
                        origin = (doc, used)
                    rest = np.concatenate([rest, ids[used:]])
                if len(rows) >= 1024:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)
        if len(rest):
            full = np.full(length, end_id, "<u2")
            full[:len(rest)] = rest
            yield batch_of([(seq, *origin, len(rest), full.tobytes())])

    return inner.mapInArrow(cut, f"part long, seq long, first_doc {kind}, first_start long, n_tokens long, ids binary")


def materialise(docs: DataFrame, tokenizer: str, key: int, length: int = 1024, per_shard: int = 4096, end_id: int = 0,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every sequence at its slot: slot, shard, byte_offset, seq_no, first_doc, first_start, n_tokens, ids_crc32, ids.

    Rows come in slot order within a task, and tasks hold disjoint ranges of slots, so writing the result
    writes the corpus in training order. Null and empty texts give an end id; repeated rows are written as often
    as they occur; an empty table gives no rows.
    """
    cut = settled(sequences(docs, tokenizer, length, end_id, id_col, text_col))
    counts = cut.groupBy("part").agg(F.count("*").alias("n"))
    # one row for each task that read documents
    starts = counts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    stride = 2 * length
    numbered = cut.join(starts, "part").select((F.col("start") + F.col("seq")).alias("seq_no"), "first_doc", "first_start", "n_tokens", "ids")
    kind = numbered.schema["first_doc"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            slot = slots(batch.column(0).to_numpy(), total, key)
            crc = [zlib.crc32(x) for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(slot // per_shard), pa.array(slot % per_shard * stride), *batch.columns[:4], pa.array(crc, pa.int64()), batch.column(4)],
                ["slot", "shard", "byte_offset", "seq_no", "first_doc", "first_start", "n_tokens", "ids_crc32", "ids"])

    placed = numbered.mapInArrow(place, f"slot long, shard long, byte_offset long, seq_no long, first_doc {kind}, first_start long, n_tokens long, ids_crc32 long, ids binary")
    # slots are spread evenly by construction, so whole shards dealt in order fill the tasks evenly
    n_shards = max(1, -(-total // per_shard))
    tasks = min(n_shards, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return placed.repartitionById(tasks, (F.col("shard") * tasks / n_shards).cast("int")).sortWithinPartitions("slot")


def write_shards(placed: DataFrame, path: str, per_file: int = 256) -> None:
    """Shards as a Parquet table of fixed-stride blocks: shard, first_slot, n_slots, payload (``per_file`` sequences each)."""
    block = (F.col("slot") / per_file).cast("long")
    rows = placed.groupBy("shard", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("slot", "ids"))).alias("rows"))
    blocks = rows.select("shard", (F.col("block") * per_file).alias("first_slot"), F.size("rows").alias("n_slots"), F.array_join(F.transform("rows", lambda r: F.hex(r["ids"])), "").alias("hex"))
    blocks.select("shard", "first_slot", "n_slots", F.unhex("hex").alias("payload")).repartitionByRange("first_slot").sortWithinPartitions("first_slot").write.parquet(path)


def read_from(spark: SparkSession, path: str, slot: int, per_file: int = 256) -> DataFrame:
    """The blocks from the one that holds ``slot`` on, in order; files before it are not read."""
    return spark.read.parquet(path).where(F.col("first_slot") >= slot // per_file * per_file).orderBy("first_slot")
