"""Near-duplicates by bottom-k sketches from one hash function.

A document's set is its distinct 5-word shingles. The k smallest hashes of the set are its sketch, so that the k
smallest hashes of two sketches together are a sample of the union of both sets. Documents with equal sets are one
class; all that follows works on one document for each class.

1. Inverted lists hold the classes that retain a value. Each list links its members to its smallest member.
2. The sample of the union estimates the overlap of such a pair; pairs far below the threshold go.
3. Full sets of the remaining pairs are rebuilt from the texts and their Jaccard similarity decides.
4. Members of a list that are not in one component yet are compared with each other by the same estimate, within
   size classes that a link cannot cross by more than one. Long lists are cut into blocks that meet pair by pair;
   blocks of one component do not meet each other. Members with a candidate meet again with their full sets, and each
   meeting leaves only the confirmed links that join its components: fewer rows than members, however many pairs.

A pair over the threshold shares nearly all retained values, so it also meets in a list other than the most frequent
ones of either document: each leaves its ``SHARED - 1`` longest lists. A passage or line that very many documents
share thus brings together only those that consist of little else.
Pairs that share fewer than ``SHARED`` of ``K`` sampled values are never looked at; a pair at the threshold does
so with a probability below 1e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.common import CASE_FOLD, WordHashes, columns, gram_hashes, settled, slices, texts
from plumbline.llm.components import components

WORDS = 5
#: Values in a sketch, and how many of a union's sample two sets over the threshold share at least.
K, SHARED = 48, 18
#: Per cent of the least threshold for which SHARED, the size ratio of 3:4 and the size classes lose no link.
LEAST_THRESHOLD = 75
#: Identifiers (8 bytes each) up to which they are broadcast instead of shuffling all texts.
BROADCAST_IDS = 1_000_000


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word sequences, or of all words where there are fewer."""
    words = hashes.of(text.translate(CASE_FOLD).split())
    return np.unique(gram_hashes(words, min(WORDS, max(1, len(words)))))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, digest of the set, and the sketch in ascending order."""
    inner = columns(docs, doc_id=id_col, text=text_col)
    kind = inner.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sizes, digests, kept = [], [], []
                for text in texts(part, "text"):
                    found = shingles(text, hashes)
                    sizes.append(len(found))
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    kept.append((found[:K] ^ np.uint64(1 << 63)).view(np.int64))  # signed values in the same order
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept, pa.list_(pa.int64()))],
                                                 ["doc_id", "n_shingles", "digest", "sketch"])

    return inner.mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, sketch array<bigint>")


def _similar(a: str, b: str, n_a: str, n_b: str) -> Column:
    """Whether the union's sample and the sizes allow the threshold."""
    sample = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    common = F.size(F.array_intersect(sample, F.array_intersect(a, b)))
    return (4 * F.least(n_a, n_b) >= 3 * F.greatest(n_a, n_b)) & (common * K >= F.size(sample) * SHARED)


def _links(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets have a Jaccard similarity of ``threshold`` per cent at least."""
    ids = settled(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    few = ids.count() <= BROADCAST_IDS
    wanted = settled(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").distinct())
    sides = [wanted.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"]
    both = pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "text_a", "text_b").sortWithinPartitions("a")

    def verify(batches):
        hashes = WordHashes()
        last = lru_cache(maxsize=4)(lambda text: shingles(text, hashes))
        for batch in batches:
            keep = []
            for left, right in zip(texts(batch, "text_a"), texts(batch, "text_b")):
                x, y = last(left), shingles(right, hashes)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(common > 0 and 100 * common >= threshold * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return settled(both.mapInArrow(verify, f"a {kind}, b {kind}").distinct())


#: Members up to which the pairs of a meeting are looked at one by one.
SMALL_LIST = 12
#: Members up to which a list is one meeting; longer ones are cut into blocks of about so many.
BLOCK = 1024
#: Shingles that count as one member, so that the full sets of a block stay below about BLOCK * UNIT hashes (16 MB).
UNIT = 2048
#: Rows of a meeting that become Python objects at a time.
ROWS_AT_A_TIME = 512
#: Bytes of text whose sets are built at a time, unless one text is longer.
SLICE_BYTES = 4 << 20


def _common(sketches_of: list[np.ndarray], rows: int, start: int, block: int = 256, wide: int = 2048):
    """(first, counts): how many values the sketches from ``first`` on, of the first ``rows``, have in common with those from ``start`` on, a block of rows at a time."""
    size = np.array([len(x) for x in sketches_of])
    row = np.repeat(np.arange(len(size)), size)
    values, column, times = np.unique(np.concatenate(sketches_of), return_inverse=True, return_counts=True)
    again = np.flatnonzero(times > 1)
    if len(again) <= wide:
        place = np.full(len(values), -1)
        place[again] = np.arange(len(again))
        has = np.zeros((len(size), len(again)), np.float32)
        seen = place[column] >= 0
        has[row[seen], place[column[seen]]] = 1
        for i in range(0, rows, block):
            yield i, has[i:min(i + block, rows)] @ has[start:].T
    else:
        ends = np.concatenate([[0], np.cumsum(size)])
        flag = np.zeros(len(values), np.int64)
        for first in range(0, rows, block):
            counts = np.zeros((min(block, rows - first), len(size) - start), np.int64)
            for i in range(len(counts)):
                own = column[ends[first + i]:ends[first + i + 1]]
                flag[own] = 1
                running = np.concatenate([[0], np.cumsum(flag[column])])
                counts[i] = running[ends[start + 1:]] - running[ends[start:-1]]
                flag[own] = 0
            yield first, counts


class Member(NamedTuple):
    """A class in an inverted list."""

    rep: Any
    component: Any
    size: int
    sketch: np.ndarray      # ascending
    lists: frozenset


def _sampled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the samples of the unions allow the threshold, for rows of sketches filled up with the largest number."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    filler = np.iinfo(np.int64).max
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != filler)
    place = np.arange(1, both.shape[1] + 1) - np.cumsum(twice, axis=1)      # among the distinct values
    union = (both != filler).sum(axis=1) - twice.sum(axis=1)
    return (twice & (place <= K)).sum(axis=1) * K >= np.minimum(union, K) * SHARED


def _candidates(left: list[Member], right: list[Member], v: int, among: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one list in different components that the sizes and the sample allow, each in the least list that both are in.

    The left members meet the right ones, and each other if ``among``. Pairs are numbers of members, left ones first, and come a block of rows at a time.
    """
    members, start = left + right, 0 if among else len(left)
    n = np.array([x.size for x in members])
    table = np.full((len(members), K), np.iinfo(np.int64).max)
    for i, x in enumerate(members):
        table[i, :len(x.sketch)] = x.sketch

    def allowed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = np.concatenate([np.empty(0, bool), *(_sampled(table[x[i:i + 8192]], table[y[i:i + 8192]]) for i in range(0, len(x), 8192))])
        return x[good], y[good]

    if len(members) <= SMALL_LIST:
        pairs = [(i, j) for i, x in enumerate(left) for j, y in enumerate(members[start:], start)
                 if (j > i or not among) and x.component != y.component and 4 * min(x.size, y.size) >= 3 * max(x.size, y.size) and min(x.lists & y.lists) == v]
        if pairs:
            yield allowed(*np.array(pairs).T)
        return
    comp = np.unique([str(x.component) for x in members], return_inverse=True)[1]
    held = np.minimum(n, K)
    before = [np.array([u for u in x.lists if u < v], np.int64) for x in members]
    for (i, counts), (_, earlier) in zip(_common([x.sketch for x in members], len(left), start), _common(before, len(left), start)):
        at = np.arange(i, i + len(counts))[:, None]
        meet = (comp[at] != comp[start:]) & (earlier == 0)
        if among:
            meet &= np.arange(len(members)) > at
        meet &= (4 * np.minimum(n[at], n[start:]) >= 3 * np.maximum(n[at], n[start:])) & (counts * K >= SHARED * np.minimum(K, np.maximum(held[at], held[start:])))
        x, y = np.nonzero(meet)
        yield allowed(x + i, y + start)


def _forest(members: list[Member], sets: list[np.ndarray], pairs: Iterator[tuple[np.ndarray, np.ndarray]], threshold: int) -> list[tuple[Any, Any]]:
    """Links among the pairs, confirmed on full sets: as many as join the components that all links join, and no more."""
    parent = {x.component: x.component for x in members}

    def root(c: Any) -> Any:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    size = np.array([len(x) for x in sets])
    ends = np.concatenate([[0], np.cumsum(size)])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    flag, links = np.zeros(int(number.max(initial=-1)) + 1, np.int64), []
    for left, right in pairs:
        for i in np.unique(left).tolist():
            others = [j for j in right[left == i].tolist() if root(members[i].component) != root(members[j].component)]
            if not others:
                continue
            own = number[ends[i]:ends[i + 1]]
            flag[own] = 1
            seen = flag[np.concatenate([number[ends[j]:ends[j + 1]] for j in others])]
            common = np.add.reduceat(seen, np.concatenate([[0], np.cumsum(size[others])[:-1]]))
            flag[own] = 0
            for j in np.array(others)[100 * common >= threshold * (size[i] + size[others] - common)].tolist():
                a, b = root(members[i].component), root(members[j].component)
                if a != b:
                    parent[a] = b
                    links.append((min(members[i].rep, members[j].rep), max(members[i].rep, members[j].rep)))
    return links


def _meetings(listed: DataFrame) -> DataFrame:
    """The meetings (a, b) within v and size class that each member takes part in, on the left or not: v, size_class, rep, component, a, b, left.

    ``listed``: v, size_class, own (false for members that are only met from the next smaller class), rep, component, and
    n_shingles if a member with over ``UNIT`` of them is to count as several. A list of up to ``BLOCK`` members is one meeting, with its own
    members on the left. A longer one is cut by the hash of rep into blocks, those of a large component apart from
    the others, and every own block meets itself and the later ones unless both are of one component.
    """
    key, cell = ["v", "size_class"], ["v", "size_class", "own"]
    units = F.ceil(F.col("n_shingles") / UNIT) if "n_shingles" in listed.columns else F.lit(1)
    sizes = settled(listed.groupBy(*cell, "component").agg(F.sum(units).alias("n")))
    lists = settled(sizes.groupBy(*key).agg(F.sum("n").alias("members"), F.min("component").alias("x"), F.max("component").alias("y"), F.max("own").alias("own"))
                    .where((F.col("x") < F.col("y")) & F.col("own")).select(*key, "members"))
    short, long = (lists.where(c).select(*key) for c in (F.col("members") <= BLOCK, F.col("members") > BLOCK))
    whole = listed.join(short, key).select(*key, "rep", "component", F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("own").alias("left"))
    if long.isEmpty():
        return whole

    # components with a block's worth of members get blocks of their own; the others share blocks (pure is null)
    parts = settled(sizes.join(long, key).groupBy(*cell, F.when(F.col("n") >= BLOCK, F.col("component")).alias("pure"))
                    .agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("salts")))
    number = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("own"), "pure", "salt"))
    blocks = settled(parts.select(*cell, "pure", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).withColumn("block", number))
    first = blocks.where("own").select(*key, F.col("block").alias("a"), F.col("pure").alias("pure_a"))
    second = blocks.select(*key, F.col("block").alias("b"), F.col("pure").alias("pure_b"))
    pairs = settled(first.join(second, key).where((F.col("a") <= F.col("b")) & ~F.coalesce(F.col("pure_a") == F.col("pure_b"), F.lit(False))).select(*key, "a", "b"))
    sides = pairs.select(*key, F.col("a").alias("block"), "a", "b", F.lit(True).alias("left")).union(
        pairs.where("a <> b").select(*key, F.col("b").alias("block"), "a", "b", F.lit(False).alias("left")))

    alone = parts.where("pure is not null").select(*cell, F.col("pure").alias("component"), "pure", "salts")
    shared = parts.where("pure is null").select(*cell, F.col("salts").alias("shared"))
    placed = listed.join(long, key).join(alone, [*cell, "component"], "left").join(shared, cell, "left")
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("rep"), F.coalesce("salts", "shared")).cast("int"))
    numbers = blocks.select(*[F.col(c).alias(f"of_{c}") for c in (*cell, "pure", "salt")], "block")
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*cell, "pure", "salt")]
    placed = placed.join(numbers, same).select(*key, "block", "rep", "component")
    return whole.union(placed.join(sides, [*key, "block"]).select(*key, "rep", "component", "a", "b", "left"))


_KEY = ["v", "size_class", "a", "b"]
_MEMBER = [*_KEY, "left", "rep", "component", "n_shingles", "sketch", "kept", "digest"]


def _by_meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[Member], list[Member], list[tuple]]]:
    """(key, left members, right members, their rows in the same order) of each meeting; rows come sorted by the key."""
    key, left, right = None, [], []

    def met():
        if left and len(left) + len(right) > 1:
            yield key, [m for m, _ in left], [m for m, _ in right], [r for _, r in left + right]

    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
            for row in zip(*(c.to_pylist() for c in batch.slice(start, ROWS_AT_A_TIME).columns)):
                if row[:4] != key:
                    yield from met()
                    key, left, right = row[:4], [], []
                _, rep, component, n, sketch, kept = row[4:10]
                (left if row[4] else right).append((Member(rep, component, n, np.array(sketch, np.int64), frozenset(kept)), row))
    yield from met()


def _touched(met: DataFrame) -> DataFrame:
    """The rows of ``met`` whose member has a candidate in its meeting: never more than there are."""
    schema = met.select(*_MEMBER).schema
    types = [to_arrow_type(f.dataType) for f in schema]

    def run(batches):
        for key, left, right, rows in _by_meeting(batches):
            found = np.unique(np.concatenate([np.empty(0, np.int64), *(np.concatenate(p) for p in _candidates(left, right, key[0], key[2] == key[3]))]))
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[rows[i] for i in found]), types)], _MEMBER)

    return met.select(*_MEMBER).repartition(*_KEY).sortWithinPartitions(*_KEY, "rep").mapInArrow(run, schema)


def _sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """rep, digest, shingles: the full set of every class among the members, rebuilt from its text."""
    ids = settled(members.select(F.col("rep").alias("doc_id")).distinct())
    wanted = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = [shingles(t, hashes) for t in texts(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())],
                                                 ["rep", "digest", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return wanted.mapInArrow(run, f"rep {kind}, digest binary, shingles binary").dropDuplicates(["rep", "digest"])


def _confirmed(touched: DataFrame, docs: DataFrame, threshold: int, kind: str) -> DataFrame:
    """Links (a, b) that join what all links among the candidates of the meetings join: fewer per meeting than it has members."""

    rep_type = to_arrow_type(touched.schema["rep"].dataType)

    def run(batches):
        for key, left, right, rows in _by_meeting(batches):
            found = _forest(left + right, [np.frombuffer(r[-1], np.uint64) for r in rows], _candidates(left, right, key[0], key[2] == key[3]), threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, rep_type) for c in zip(*found)], ["a", "b"])

    dealt = touched.join(_sets(docs, touched), ["rep", "digest"]).select(*_MEMBER, "shingles").repartition(*_KEY)
    return dealt.sortWithinPartitions(*_KEY, "rep").mapInArrow(run, f"a {kind}, b {kind}")


def groups(docs: DataFrame, threshold: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_shingles, component_id (smallest id that links reach), kept (the id is the component's).

    Words are split at ASCII white space after lower-casing A-Z. Null and empty texts have no set and link with
    nothing; neither do rows with a null id, which are kept. Rows that share an id are one node. Repeated rows
    get a row each. An empty table gives no rows. Other columns of ``docs`` are not looked at. A ``threshold`` below
    ``LEAST_THRESHOLD`` is refused.
    """
    if threshold < LEAST_THRESHOLD:
        raise ValueError(f"threshold {threshold} is below {LEAST_THRESHOLD}, for which the sketches are made")
    source = columns(docs, doc_id=id_col, text=text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    each = settled(sketches(source))
    classes = settled(each.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("digest")
                      .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    by_rep = classes.select("rep", "digest", "n_shingles", "sketch")

    postings = by_rep.select("rep", F.least(F.lit(SHARED), F.ceil(F.size("sketch") * threshold / 100)).cast("long").alias("need"), F.explode("sketch").alias("v"))
    values = postings.groupBy("v").agg(F.count("*").alias("members"), F.min("rep").alias("least"), F.max("rep").alias("most")).where(F.col("least") < F.col("most"))
    # two classes with ``need`` values in common also share one that is not among the need - 1 most frequent of either
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("members"), F.desc("v")))
    lists = postings.join(values.select("v", "members"), "v").withColumn("place", place).where(F.col("place") >= F.col("need")).select("v", "rep")
    lists = settled(lists)
    least = lists.groupBy("v").agg(F.min("rep").alias("least"))
    lists = lists.join(least, "v")

    def sketch_of(c: str) -> DataFrame:
        return by_rep.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    stars = lists.where(F.col("rep") > F.col("least")).select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = settled(stars.join(sketch_of("a"), "a").join(sketch_of("b"), "b").where(_similar("s_a", "s_b", "n_a", "n_b")).select("a", "b").distinct())
    links = _links(pairs, source, threshold)
    joined = components(links)

    placed = lists.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = settled(placed.select("v", "rep", "component"))
    mixed_lists = placed.groupBy("v").agg(F.min("component").alias("x"), F.max("component").alias("y")).where(F.col("x") < F.col("y")).select("v")
    size_class = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(4 / 3)) + 1e-9).cast("int")
    members = settled(placed.join(mixed_lists, "v"))
    kept = members.groupBy("rep").agg(F.collect_set("v").alias("kept"))
    # in a class meet its own members and those of the next larger one
    listed = members.join(by_rep.select("rep", "n_shingles", size_class.alias("size_class")), "rep").select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("own"))
    listed = settled(listed.withColumn("size_class", F.when(F.col("own"), F.col("size_class")).otherwise(F.col("size_class") - 1)))
    touched = settled(_touched(_meetings(listed).join(kept, "rep").join(by_rep, "rep")))
    more = settled(_confirmed(touched, source, threshold, kind).distinct())
    if not more.isEmpty():
        joined = components(links.union(more))

    # a component's smallest document is the smallest of its classes' smallest
    of_class = classes.select("digest", "rep").join(joined, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    found = each.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return found.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest document of every group, with all columns."""
    gone = settled(groups(docs, id_col=id_col, text_col=text_col, **options).where(~F.col("kept")).select(F.col(f"`{id_col}`").alias("gone")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, docs[f"`{id_col}`"] == F.col("gone"), "left_anti")
