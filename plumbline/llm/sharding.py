"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard stands at many places of a ring of 64-bit positions; a row belongs to the first place clockwise
from the hash of its id. A shard takes at most its share of the rows (shares differ by one row at most);
rows beyond that go on clockwise to the next shard with room. Which rows go on is settled on counts alone: one
count for each arc of the ring reaches the driver, at most ``n_shards * places`` numbers whatever the input,
and comes back as intervals of ranks. Everything that touches rows is DataFrame work.
"""

from __future__ import annotations

from collections import deque

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import columns, crc32_text, settled

#: Equal parts of the ring, by which a row finds its arc with a hash join.
CELL_BITS = 12
#: Parts of the rows of one cell of an arc that are ranked apart, so that rows with one hash spread over tasks.
SALTS = 8

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def ring(n_shards: int, places: int, seed: int) -> list[tuple[int, int]]:
    """(position, shard) of all places in clockwise order."""
    return sorted((xxhash.xxh64_intdigest(f"{shard}:{place}", seed) + LOW, shard) for shard in range(n_shards) for place in range(places))


def pieces(positions: list[int]) -> list[tuple[int, int, int, int]]:
    """(cell, first position, last position, arc): the arcs cut at the borders of the cells."""
    width = 1 << (64 - CELL_BITS)
    out = []
    low = LOW
    for arc, high in [*enumerate(positions), (0, HIGH)]:
        while low <= high:
            cell = (low - LOW) // width
            end = min(high, LOW + (cell + 1) * width - 1)
            out.append((cell, low, end, arc))
            low = end + 1
    return out


def flow(counts: dict[int, int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, slot of the first): who takes which rows of each arc.

    Rows stay with their own shard while it has room; the others walk clockwise in one queue. ``room`` adds
    up to the rows, so the walk ends within two rounds.
    """
    room, slots, out = list(room), [0] * len(room), []

    def take(arc: int, first: int, end: int, shard: int) -> int:
        n = min(end - first, room[shard])
        if n:
            out.append((arc, first, first + n, shard, slots[shard]))
            room[shard] -= n
            slots[shard] += n
        return first + n

    left = {arc: take(arc, 0, counts.get(arc, 0), owners[arc]) for arc in range(len(owners))}
    walking: deque[tuple[int, int, int]] = deque()
    for lap in range(2):
        for arc, shard in enumerate(owners):
            while walking and room[shard]:
                from_arc, first, end = walking.popleft()
                first = take(from_arc, first, end, shard)
                if first < end:
                    walking.appendleft((from_arc, first, end))
            if lap == 0 and left[arc] < counts.get(arc, 0):
                walking.append((arc, left[arc], counts[arc]))
    return out


def assign(docs: DataFrame, n_shards: int = 40, places: int = 64, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, size (UTF-8 bytes of the text plus 16), text_crc32, shard, slot (gapless from 0 in the shard).

    Counts of shards differ by one at most. A null text has no bytes; rows with a null id share one place on
    the ring and spread from there; repeated rows each take a slot; an empty table gives no rows. Other
    columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    places_on_ring = ring(n_shards, places, seed)
    owners = [shard for _, shard in places_on_ring]
    cut = spark.createDataFrame(pieces([p for p, _ in places_on_ring]), "cell int, low long, high long, arc int")
    text = F.col("text")
    keys = columns(docs, doc_id=id_col, text=text_col).select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), crc32_text(text).alias("text_crc32"),
        F.xxhash64(F.lit(seed), "doc_id").alias("pos"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    keys = settled(keys)
    cell = (F.shiftright("pos", 64 - CELL_BITS) + (1 << (CELL_BITS - 1))).cast("int")
    placed = keys.withColumn("cell", cell).join(F.broadcast(cut), "cell").where(F.col("pos").between(F.col("low"), F.col("high"))).drop("low", "high")

    groups = placed.groupBy("arc", "cell", "salt").agg(F.count("*").alias("n"))
    groups = settled(groups)
    before = Window.partitionBy("arc").orderBy("cell", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("arc", "cell", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    counts = {r.arc: r.n for r in groups.groupBy("arc").agg(F.sum("n").alias("n")).collect()}

    total = sum(counts.values())
    room = [total // n_shards + (shard < total % n_shards) for shard in range(n_shards)]
    taken = spark.createDataFrame(flow(counts, owners, room), "arc int, first long, end long, shard int, base long")

    inside = Window.partitionBy("arc", "cell", "salt").orderBy("pos", "doc_id", "text_crc32", "size")
    ranked = placed.withColumn("rn", F.row_number().over(inside).cast("long") - 1)
    # at most arcs x cells of an arc x SALTS rows, and one row for each arc and full shard: fixed by the parameters
    ranked = ranked.join(F.broadcast(offsets), ["arc", "cell", "salt"]).withColumn("rank", F.col("offset") + F.col("rn"))
    out = ranked.join(F.broadcast(taken), "arc").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return out.select(F.col("doc_id").alias(id_col), "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))
