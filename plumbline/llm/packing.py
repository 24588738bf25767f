"""Packing by minimum bin slack.

Every document becomes its token ids and an end id. Windows that a document fills alone are cut off
first; what remains of each document is an item. Per window, the largest waiting item is set and a
bitset holds the sums that other waiting lengths can reach; the sum closest to the capacity is traced
back to how many items of each length it takes. Lengths and counts are all that the search sees, so
one found pattern fills as many windows as the counts allow.

Shuffled rows describe pieces (about 50 bytes each), never texts or ids, unless ``with_ids`` asks for
the ids themselves.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import tokens
from plumbline.llm.common import columns

#: Items that wait at a time in a task; more than this are packed before more are read.
WAITING = 50_000

PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def document_ids(text: str | None, tokenizer: str, end_id: int) -> np.ndarray:
    return np.append(tokens.ids_of(text or "", tokenizer), np.uint32(end_id)).astype("<u4")


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many items of each length to put in one window: the largest one, and others up to the least slack."""
    order = sorted(counts, reverse=True)
    seed = order[0]
    room = capacity - seed
    reach, layers, mask = 1, [], (1 << (room + 1)) - 1
    for length in order:
        if length > room:
            continue
        left, part = counts[length] - (length == seed), 1
        while left > 0 and part * length <= room:
            part = min(part, left)
            wider = (reach | reach << part * length) & mask
            if wider != reach:
                layers.append((length, part, reach))
                reach = wider
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, defaultdict(int, {seed: 1})
    for length, part, before in reversed(layers):
        if not before >> total & 1:
            taken[length] += part
            total -= part * length
    return dict(taken)


def windows(waiting: dict[int, list[int]], capacity: int, keep: int) -> Iterator[list[int]]:
    """Groups of items that share a window, until at most ``keep`` items wait; used items leave ``waiting``."""
    counts = {length: len(items) for length, items in waiting.items() if items}
    held = sum(counts.values())
    while held > keep:
        pattern = fullest(counts, capacity)
        for _ in range(min(counts[length] // n for length, n in pattern.items())):
            yield [waiting[length].pop() for length, n in pattern.items() for _ in range(n)]
        for length in pattern:
            counts[length] = len(waiting[length])
            if not counts[length]:
                del counts[length], waiting[length]
        held = sum(counts.values())


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row per piece: the document's columns ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts hold the end id alone. Repeated rows are packed as often as they occur, null ids
    stay null. An empty table gives no rows. Other columns of ``docs`` are not looked at. A sequence is
    written by one task; its number joins the task's number and a count within the task.
    """
    key = docs.schema[id_col].dataType
    tail = ", ids array<int>" if with_ids else ""
    cut_schema = f"doc_id {key.simpleString()}, {PIECE}, deal long{tail}"

    def cut(batches):
        part = TaskContext.get().partitionId()
        serial = 0
        for batch in batches:
            rows: dict[str, list] = defaultdict(list)
            ids_out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = document_ids(text, tokenizer, end_id)
                for start in range(0, len(ids), capacity):
                    piece = ids[start:start + capacity]
                    for name, value in (("doc_id", doc), ("start", start), ("length", len(piece)), ("ids_crc32", zlib.crc32(piece)),
                                        ("doc_tokens", len(ids)), ("deal", (part << 40) | serial)):
                        rows[name].append(value)
                    serial += 1
                    if with_ids:
                        ids_out.append(piece.astype(np.int32))
            if rows:
                arrays = [pa.array(rows["doc_id"], batch.schema.field(0).type), *[pa.array(rows[c], pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "deal")]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"]
                if with_ids:
                    arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    def fill(batches):
        number = TaskContext.get().partitionId() << 40
        waiting: dict[int, list[int]] = defaultdict(list)
        held: pa.Table | None = None

        def emit(groups, rows: pa.Table):
            nonlocal number
            take, sequence, offset = [], [], []
            lengths = rows["length"].to_numpy()
            for group in groups:
                at = 0
                for i in group:
                    take.append(i)
                    sequence.append(number)
                    offset.append(at)
                    at += int(lengths[i])
                number += 1
            out = rows.take(pa.array(take, pa.int64())).drop_columns(["deal"])
            for name, values in (("sequence_id", sequence), ("offset", offset)):
                out = out.append_column(name, pa.array(values, pa.int64()))
            return out.combine_chunks().to_batches()

        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            full = np.flatnonzero(fresh["length"].to_numpy() == capacity)
            yield from emit(([int(i)] for i in full), fresh)
            rest = fresh.filter(pa.array(fresh["length"].to_numpy() < capacity))
            base = held.num_rows if held is not None else 0
            held = pa.concat_tables([held, rest]) if held is not None else rest
            for i, length in enumerate(rest["length"].to_pylist()):
                waiting[length].append(base + i)
            if held.num_rows > WAITING:
                yield from emit(list(windows(waiting, capacity, WAITING // 4)), held)
                left = sorted(i for items in waiting.values() for i in items)
                held = held.take(pa.array(left, pa.int64())).combine_chunks()
                waiting = defaultdict(list)
                for i, length in enumerate(held["length"].to_pylist()):
                    waiting[length].append(i)
        if held is not None:
            yield from emit(list(windows(waiting, capacity, 0)), held)

    pieces = columns(docs, doc_id=id_col, text=text_col).mapInArrow(cut, cut_schema)
    dealt = pieces.repartition(F.xxhash64("deal")).sortWithinPartitions("deal")
    out = dealt.mapInArrow(fill, f"doc_id {key.simpleString()}, {PIECE}{tail}, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)


def padding(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: sequences, ids and padding, where a sequence at a power of two is not padded."""
    total = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    power = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    return total.agg(F.count("*").alias("sequences"), F.sum("used").alias("ids"),
                     F.sum(F.when(power, 0).otherwise(capacity - F.col("used"))).alias("padding"))


__all__ = ["fullest", "pack", "padding", "windows"]
