"""Runs: stretches of words that repeat with a period, found in tiles and stitched.

A run is a stretch with smallest period q, as long as ``REPEATS`` periods and ``LEAST`` words at least, that no
neighbouring word extends. Periods from P to 2P - 1 form an octave (P a power of two).

1. A document is cut into tiles for each octave, which overlap by ``2 * REPEATS * P`` words: more than the least run of any of
   its periods, so the pieces of a run in neighbouring tiles overlap by a period or lie in one tile whole. All
   octaves up to a sixteenth of ``tile_words`` share the tiles of the largest of them. A document of one tile is solved
   where it is read; the tiles of longer ones are rows of their own, dealt to all tasks.
2. Tiles are solved alone. Boundaries stand every P words. A run of the octave holds a boundary whose next 2P words
   recur after q words, so one comparison of hashes for each word finds all candidates. A boundary with two
   candidates lies in a run of a smaller period (the periodicity lemma), so one with a single candidate is all
   that is needed. At such a boundary the Z-values for q, to the right and to the left, give the fragment, word by word.
3. Fragments are shuffled by document and period, and those that overlap by a period become one run.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import columns, mixed, settled, slices, texts

#: Periods and words that a run has at least.
REPEATS, LEAST = 4, 6
#: Words of a tile for the small octaves; documents of up to so many are one tile.
TILE_WORDS = 1 << 18
#: Bytes of text whose words are in memory at a time, unless one text is longer.
SLICE_BYTES = 8 << 20


@functools.lru_cache(maxsize=4096)
def _prime_factors(q: int) -> tuple[int, ...]:
    found, d = [], 2
    while d * d <= q:
        if q % d == 0:
            found.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return (*found, q) if q > 1 else tuple(found)


def _z_right(x: np.ndarray, b: int, q: int) -> int:
    """Words from ``b`` on that equal those q later."""
    at, step = b, 64
    while at + q < len(x):
        n = min(step, len(x) - q - at)
        differ = x[at:at + n] != x[at + q:at + q + n]
        if (first := int(differ.argmax())) or differ[0]:
            return at + first - b
        at, step = at + n, 2 * step
    return at - b


def _z_left(x: np.ndarray, b: int, q: int) -> int:
    """Words before ``b`` that equal those q later."""
    at, step = b, 64
    while at:
        n = min(step, at)
        differ = (x[at - n:at] != x[at - n + q:at + q])[::-1]
        if (first := int(differ.argmax())) or differ[0]:
            return b - at + first
        at, step = at - n, 2 * step
    return b


def fragments(tiles: list[np.ndarray], first: int = 1, last: int | None = None) -> list[list[tuple[int, int, int]]]:
    """Of each tile, an array of word numbers: the (period, start, end) of stretches with smallest period q, of
    ``REPEATS`` periods and ``LEAST`` words at least, that no word of the tile extends. Octaves from ``first`` to ``last``."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in tiles]
    order = sorted(range(len(tiles)), key=lambda k: -len(tiles[k]))
    ends = np.cumsum([len(tiles[k]) + 1 for k in order])
    # after each tile stands a number that occurs once, so nothing matches across it
    x = np.concatenate([part for i, k in enumerate(order) for part in (tiles[k].astype(np.int64), np.array([-1 - i]))]) if tiles else np.empty(0, np.int64)
    lengths = np.array([len(tiles[k]) for k in order])
    grams, span, octave = mixed(x.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1, 1
    while last is None or octave <= last:
        here = int((lengths >= REPEATS * octave).sum())     # the longest stand first
        if not here:
            break
        grams = grams[:int(ends[here - 1])]
        grams = mixed(grams[:-span] * np.uint64(0xD1342543DE82EF95) + grams[span:])      # of 2 * octave words
        span *= 2
        if octave >= first:
            for q, b in _candidates(grams, octave):
                _extend(x, q, b, octave, ends, order, out)
        octave *= 2
    return [sorted(set(found)) for found in out]


def _candidates(grams: np.ndarray, octave: int) -> list[tuple[int, int]]:
    """(period, boundary) in ascending order: boundaries whose words recur after exactly one period of the octave."""
    rows = -(-len(grams) // octave)
    table = np.zeros(rows * octave, np.uint64)
    table[:len(grams)] = grams
    table = table.reshape(rows, octave)
    at = np.flatnonzero(table[1:] == table[:-1, :1])
    row, shift = at // octave, at % octave
    alone = np.ones(len(at), bool)
    alone[1:] &= row[1:] != row[:-1]
    alone[:-1] &= row[1:] != row[:-1]
    row, shift = row[alone], shift[alone]
    new = np.ones(len(row), bool)       # neighbouring boundaries of one period lie in one stretch
    new[1:] = (row[1:] != row[:-1] + 1) | (shift[1:] != shift[:-1])
    return sorted(zip((shift[new] + octave).tolist(), (row[new] * octave).tolist()))


def _extend(x, q, b, octave, ends, order, out) -> None:
    """Append the stretch around boundary ``b`` to the tile that holds it."""
    tile = int(np.searchsorted(ends, b, side="right"))
    found, begin = out[order[tile]], int(ends[tile - 1]) if tile else 0
    if found and found[-1][0] == q and begin + found[-1][2] >= b + q:
        return
    right = _z_right(x, b, q)
    if right < 2 * octave:
        return
    root = x[b:b + q]
    if any(np.array_equal(root[:-(q // p)], root[q // p:]) for p in _prime_factors(q)):
        return
    start, end = b - _z_left(x, b, q), b + right + q
    if end - start >= max(LEAST, REPEATS * q):
        found.append((q, start - begin, end - begin))


def tiles_of(words: np.ndarray, tile_words: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(first octave, last octave, start, words) of a document's tiles."""
    n, last = len(words), 1
    while 32 * last <= tile_words:
        last *= 2
    first = 1
    while REPEATS * first <= n:
        overlap = 2 * REPEATS * last
        size = max(tile_words if first == 1 else 0, 2 * overlap)
        for start in range(0, max(1, n - overlap), size - overlap):
            yield first, last, start, words[start:start + size]
        first = last = 2 * last


class _Numbers(dict):
    """A number for each distinct word."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


_PARTS = ("doc_id {kind}, uid binary, n_words long, kept binary, words binary, fragments array<struct<period:long,start:long,end:long>>, "
          "first long, last long, at long, numbers binary")
_FRAGMENT = pa.list_(pa.struct([("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def _solved(inner: DataFrame, tile_words: int, edit: Callable | None, digests: bool) -> DataFrame:
    """A row per document, with its fragments if it is one tile; a row per tile of the longer documents.

    ``kept`` is the result of documents without runs; the others carry ``words``, joined by a space.
    """
    kind = inner.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            names = ["doc_id", "uid", "n_words", "kept", "words", "fragments", "first", "last", "at", "numbers"]
            types = [id_type, pa.binary(), pa.int64(), pa.binary(), pa.binary(), _FRAGMENT, pa.int64(), pa.int64(), pa.int64(), pa.binary()]

            def rows(values):
                return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*values), types)], names)

            for part in slices(batch, "text", SLICE_BYTES):
                ids, split, numbers = part.column(0).to_pylist(), [], []
                known = _Numbers()
                for doc, text in zip(ids, texts(part, "text")):
                    words = text.split()
                    split.append(edit(doc, words) if edit and words else words)
                    numbers.append(np.fromiter(map(known.__getitem__, split[-1]), np.int64, len(split[-1])))
                whole = [len(x) <= tile_words for x in numbers]
                solved = iter(fragments([x for x, w in zip(numbers, whole) if w]))
                out = []
                for doc, words, x, one in zip(ids, split, numbers, whole):
                    found, joined = next(solved) if one else None, b" ".join(words)
                    if one and not found:
                        out.append((doc, None, len(words), _sha(joined) if digests else joined, None, [], None, None, None, None))
                        continue
                    uid = xxhash.xxh3_128_digest(repr(doc).encode() + b"\0" + joined)
                    found = [dict(zip(("period", "start", "end"), f)) for f in found or []]
                    out.append((doc, uid, len(words), None, joined, found, None, None, None, None))
                    if not one:
                        for first, last, at, tile in tiles_of(x, tile_words):
                            yield rows([(None, uid, None, None, None, [], first, last, at, tile.astype("<u4").tobytes())])
                if out:
                    yield rows(out)

    return inner.mapInArrow(run, _PARTS.format(kind=kind))


def _sha(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


def _tile_fragments(tiles: DataFrame) -> DataFrame:
    """uid, period, start, end of each tile's fragments, in words of the document."""

    def run(batches):
        for batch in batches:
            for uid, first, last, at, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                found = fragments([np.frombuffer(numbers, "<u4")], first, last)[0]
                if found:
                    q, start, end = (np.array(c) for c in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array([uid] * len(q), pa.binary()), pa.array(q), pa.array(start + at), pa.array(end + at)], ["uid", "period", "start", "end"])

    dealt = tiles.select("uid", "first", "last", "at", "numbers").repartition("uid", "first", "at")
    return dealt.mapInArrow(run, "uid binary, period long, start long, end long")


def stitched(found: DataFrame) -> DataFrame:
    """uid, runs (start, length, period by start, then period): fragments of one period that overlap by it are one."""
    at = Window.partitionBy("uid", "period").orderBy("start", "end")
    reach = F.max("end").over(at.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | (F.col("start") + F.col("period") > reach)
    numbered = found.distinct().withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(at))
    runs = numbered.groupBy("uid", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("end") - F.col("start")).alias("length"), "period"))).alias("runs"))


def collapse(words: list[bytes], runs: list[dict[str, Any]]) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    kept = np.ones(len(words), bool)
    for r in runs:
        kept[r["start"] + r["period"]:r["start"] + r["length"]] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, edit: Callable[[Any, list[bytes]], list[bytes]] | None = None,
                  digests: bool = False, tile_words: int = TILE_WORDS) -> DataFrame:
    """Per row: the id, n_words, runs (array of start, length, period by start, then period; empty without any) and
    collapsed: the words outside the repeats, joined by a space, or with ``digests`` the sha256 of that in lowercase hex.

    Words are split at ASCII white space. ``edit(id, words)`` may change a document's words first. Null and empty texts
    have no words and no runs. A text may be of any length. Repeated rows get a row each, rows that share an id but not the
    text are told apart, and a null id is kept. An empty table gives no rows. Other columns of ``docs`` are not looked at.
    Words are compared themselves; only candidates come from 64-bit hashes of word sequences.
    """
    inner = columns(docs, doc_id=id_col, text=text_col)
    parts = settled(_solved(inner, tile_words, edit, digests))
    rows, tiles = parts.where("numbers is null"), parts.where("numbers is not null")
    plain = rows.where("uid is null").select(F.col("doc_id").alias(id_col), "n_words", F.expr("cast(array() as array<struct<start:bigint,length:bigint,period:bigint>>)").alias("runs"),
                                             F.col("kept").cast("string").alias("collapsed"))
    some = rows.where("uid is not null").select("doc_id", "uid", "n_words", "words", "fragments")
    whole = some.select("uid", F.inline("fragments"))
    runs = stitched(whole.union(_tile_fragments(tiles)))
    kind = inner.schema["doc_id"].dataType.simpleString()

    def finish(batches):
        for batch in batches:
            listed = [x or [] for x in batch.column(3).to_pylist()]
            kept = [collapse(w.split(b" ") if w else [], r) for w, r in zip(batch.column(2).to_pylist(), listed)]
            done = pa.array(map(_sha, kept) if digests else kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(listed, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), done],
                                             ["doc_id", "n_words", "runs", "collapsed"])

    joined = some.join(runs, "uid", "left").select("doc_id", "n_words", "words", "runs")
    done = joined.mapInArrow(finish, f"doc_id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return plain.unionByName(done.withColumnRenamed("doc_id", id_col))


def strongest(runs):
    """Of an array of runs the one with the greatest length over period (ties: smallest start, then period); null without any."""
    def better(a, b):
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(left > right, a).otherwise(b)

    # the array is sorted by start, then period, so an equal one that comes later never wins
    return F.aggregate(runs, F.element_at(runs, 1), lambda best, r: better(r, best))
