"""Benchmark decontamination with suffix arrays of the training text.

A task takes its documents in shards of bounded size, writes every word as a number of the benchmark's
vocabulary (0: not in it) and sorts all suffixes of the shard that could begin a match: those that start
a run of benchmark words as long as the shortest window. Suffixes left out begin with a word sequence no
benchmark text has, so no search could return them. Every benchmark suffix is then found by binary search.

The benchmark travels in blocks of at most ``BLOCK_BYTES`` of text, measured before anything is sent; a
larger benchmark takes more blocks, which a task loads one after the other.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import alnum_words, columns, slices, texts

#: Benchmark text in one broadcast, in bytes.
BLOCK_BYTES = 16_000_000
#: Document text of one suffix array, in bytes.
SHARD_BYTES = 8_000_000


class Benchmark:
    """The words of a block of benchmark items as numbers, and their windows."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        values, starts, ends, owner = [], [], [], []
        seen: dict[tuple[int, ...], int] = {}
        self.window_at, self.window_len, self.window_items = [], [], []
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in alnum_words(text)]
            if not words:
                continue
            base = len(values)
            starts.extend(range(base, base + len(words)))
            ends.extend(repeat(base + len(words), len(words)))
            owner.extend(repeat(item, len(words)))
            values.extend([*words, 0])
            starts.append(-1), ends.append(-1), owner.append("")
            size = min(window, len(words))
            for i in range(len(words) - size + 1):
                key = tuple(words[i:i + size])
                at = seen.setdefault(key, len(seen))
                if at == len(self.window_at):
                    self.window_at.append(base + i), self.window_len.append(size), self.window_items.append(set())
                self.window_items[at].add(item)
        self.values = np.array(values, np.int64)
        self.ends = np.array(ends, np.int64)
        self.owner = owner
        self.window_at = np.array(self.window_at, np.int64)
        self.window_len = np.array(self.window_len, np.int64)
        self.shortest = int(self.window_len.min()) if len(self.window_len) else 0


class SuffixArray:
    """Sorted suffixes of a shard's word numbers; zeros end a suffix."""

    def __init__(self, values: np.ndarray, shortest: int):
        stops = np.append(np.flatnonzero(values == 0), len(values))
        run_end = stops[np.searchsorted(stops, np.arange(len(values)))]
        run = run_end - np.arange(len(values))
        start = np.ones(len(values), bool)
        start[1:] = values[:-1] == 0
        first = np.maximum.accumulate(np.where(start, np.arange(len(values)), 0))
        in_long = run[first] >= shortest
        keep = np.flatnonzero((values != 0) & in_long)
        # runs that can hold a match stand one after the other, each followed by a zero
        gap = np.zeros(len(keep), np.int64)
        gap[1:] = np.diff(keep) > 1
        place = np.arange(len(keep)) + np.cumsum(gap)
        size = int(place[-1]) + 1 if len(keep) else 0
        self.values = np.zeros(size + 1, np.int64)
        self.origin = np.full(size + 1, -1, np.int64)
        self.values[place], self.origin[place] = values[keep], keep
        self.order = self._sorted(place, int(run.max(initial=0)))
        self.order = self.order[run[self.origin[self.order]] >= shortest]

    def _sorted(self, places: np.ndarray, longest: int) -> np.ndarray:
        """Prefix doubling until every suffix has its own rank or the longest run is covered."""
        rank = self.values.copy()
        width = 1
        while width < longest and len(places):
            later = np.zeros(len(rank), np.int64)
            if width < len(rank):
                later[:-width] = rank[width:]
            both = rank * (int(rank.max()) + 1) + later
            both[rank == 0] = 0
            distinct, rank = np.unique(both, return_inverse=True)
            rank = rank.astype(np.int64) + (distinct[0] != 0)
            if len(distinct) > len(places):
                break
            width *= 2
        return places[np.argsort(rank[places], kind="stable")]

    def _compare(self, at: np.ndarray, query: np.ndarray, bench: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sign of suffix against query over ``length`` words, and the words they share."""
        sign, shared = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        active, k = np.arange(len(at)), 0
        while len(active):
            active = active[k < length[active]]
            a = self.values[np.minimum(at[active] + k, len(self.values) - 1)]
            b = bench[query[active] + k]
            sign[active] = np.sign(a - b)
            active = active[a == b]
            shared[active] += 1
            k += 1
        return sign, shared

    def bound(self, query: np.ndarray, length: np.ndarray, bench: np.ndarray, after: bool) -> np.ndarray:
        """First place in the order whose suffix is not before (``after``: is beyond) each query."""
        low, high = np.zeros(len(query), np.int64), np.full(len(query), len(self.order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            sign, _ = self._compare(self.order[mid], query[open_], bench, length[open_])
            right = sign <= 0 if after else sign < 0
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        return low

    def longest(self, query: np.ndarray, length: np.ndarray, bench: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest match of each query and the shard position where it stands (-1: none)."""
        best, where = np.zeros(len(query), np.int64), np.full(len(query), -1, np.int64)
        if not len(self.order):
            return best, where
        place = self.bound(query, length, bench, after=False)
        for near in (place - 1, place):
            ok = np.flatnonzero((near >= 0) & (near < len(self.order)))
            at = self.order[near[ok]]
            _, shared = self._compare(at, query[ok], bench, length[ok])
            better = shared > best[ok]
            best[ok[better]], where[ok[better]] = shared[better], self.origin[at[better]]
        return best, where


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int):
    """Broadcasts of the benchmark's blocks. The driver holds one block at a time."""
    spark = benchmark.sparkSession
    items = columns(benchmark, item=item_col, text=text_col).select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    sent = []
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect()
        sent.append(spark.sparkContext.broadcast(Benchmark([(r.item, r.text.encode()) for r in rows], window)))
        del rows
    return sent


def _shard(docs: list[bytes], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words with a zero after each document; where each document starts."""
    parts, sizes = [], []
    for text in docs:
        words = alnum_words(text)
        parts.append(np.fromiter(map(number.get, words, repeat(0)), np.int64, len(words)))
        parts.append(np.zeros(1, np.int64))
        sizes.append(len(words) + 1)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _loaded(sent):
    """The blocks one after the other; of several, none stays in the worker."""
    for block in sent:
        yield block.value
        if len(sent) > 1:
            block.__dict__.pop("_value", None)


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = 10, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, items (sorted ids of the items with occurring windows), contaminated.

    ``carry`` names columns of ``docs`` to hand on; it is the id alone by default. Words are runs of letters
    and digits (every character beyond ASCII counts as one) with A-Z lower-cased. A window is ``window``
    consecutive words of an item, or all words of a shorter one. Null texts have no words; items without words
    have no windows; an item without id counts under the empty string; repeated rows are judged one by one; an
    empty benchmark hits nothing, and empty ``docs`` give no rows.
    """
    carry = [id_col] if carry is None else carry
    sent = _blocks(benchmark, item_col, item_text_col, window, block_bytes)
    inner = docs.select(F.struct(*[docs[f"`{c}`"] for c in carry]).alias("kept"), docs[f"`{text_col}`"].alias("text"))
    schema = T.StructType([inner.schema["kept"], *T._parse_datatype_string("n_words long, n_hit long, items array<string>, contaminated boolean").fields])

    def scan(batches):
        for whole in batches:
            for batch in slices(whole, "text", SHARD_BYTES):
                yield judged(batch)

    def judged(batch):
        docs_bytes = texts(batch, "text")
        n_words = hit = None
        found: list[set] = [set() for _ in docs_bytes]
        for bench in _loaded(sent):
            values, begins = _shard(docs_bytes, bench.number)
            if hit is None:
                hit, n_words = np.zeros(len(values), bool), np.diff(begins) - 1
            if not len(bench.window_at):
                continue
            shard = SuffixArray(values, bench.shortest)
            low = shard.bound(bench.window_at, bench.window_len, bench.values, after=False)
            high = shard.bound(bench.window_at, bench.window_len, bench.values, after=True)
            some = np.flatnonzero(high > low)
            times = (high - low)[some]
            which = np.repeat(some, times)
            at = shard.origin[shard.order[np.repeat(low[some] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())]]
            edge = np.zeros(len(values) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + bench.window_len[which], -1)
            hit |= np.cumsum(edge[:-1]) > 0
            doc = np.searchsorted(begins, at, side="right") - 1
            pairs = np.unique(doc * len(bench.window_at) + which)
            for pair in pairs.tolist():
                found[pair // len(bench.window_at)] |= bench.window_items[pair % len(bench.window_at)]
        running = np.concatenate([[0], np.cumsum(hit)])
        n_hit = running[begins[1:]] - running[begins[:-1]]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array(n_hit > 0)],
            ["kept", "n_words", "n_hit", "items", "contaminated"])

    return inner.mapInArrow(scan, schema)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark; all columns stay."""
    marked = annotate(docs, benchmark, carry=docs.columns, **options)
    return marked.where(~F.col("contaminated")).select("kept.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per test suffix with a match of a window's length: item_id (as text), item_word, length, and one place: doc_id, doc_word.

    Each shard answers for itself; the longest match over all shards stays, at the smallest document id.
    """
    sent = _blocks(benchmark, item_col, item_text_col, window, block_bytes)
    inner = columns(docs, doc_id=id_col, text=text_col)
    kind = inner.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for whole in batches:
            for batch in slices(whole, "text", SHARD_BYTES):
                docs_bytes = texts(batch, "text")
                for bench in _loaded(sent):
                    query = np.flatnonzero(bench.values > 0)
                    if not len(query):
                        continue
                    values, begins = _shard(docs_bytes, bench.number)
                    shard = SuffixArray(values, bench.shortest)
                    length, where = shard.longest(query, bench.ends[query] - query, bench.values)
                    first = np.maximum.accumulate(np.where(np.concatenate([[True], bench.values[:-1] == 0]), np.arange(len(bench.values)), 0))
                    need = np.minimum(window, bench.ends[query] - first[query])
                    good = np.flatnonzero((length >= need) & (where >= 0))
                    if len(good):
                        doc = np.searchsorted(begins, where[good], side="right") - 1
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([bench.owner[q] for q in query[good]], pa.string()), pa.array(query[good] - first[query[good]]), pa.array(length[good]),
                             batch.column(0).take(pa.array(doc)), pa.array(where[good] - begins[doc])],
                            ["item_id", "item_word", "length", "doc_id", "doc_word"])

    found = inner.mapInArrow(scan, f"item_id string, item_word long, length long, doc_id {kind}, doc_word long")
    best = F.min_by(F.struct("length", "doc_id", "doc_word"), F.struct(-F.col("length"), "doc_id", "doc_word")).alias("best")
    return found.groupBy("item_id", "item_word").agg(best).select("item_id", "item_word", "best.*")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


__all__ = ["annotate", "clean", "items_digest", "longest_matches"]
