"""Substring dedup with suffix automata of reference shards.

A word goes if it lies in a window of ``window`` words that also starts in a document with a smaller id.

1. Each window elects the smallest hash of its k-word sequences as anchor. Equal windows elect equal anchors, so
   a window whose anchor stands in one document only has no copy. For every other anchor, the smallest document
   with it is the reference shard of all windows that elected it, because no smaller document can hold them.
2. Neighbouring windows with the same reference form a passage. The reference's own passages become a suffix automaton;
   the passages of other documents stream through it, and wherever the match that ends at a word is as long as
   a window, that window goes. A reference is a part of one document, so what travels to the tasks of a hot
   passage is bounded, and its many copies are split over tasks by the join.
3. Windows that are not in their reference may still be in a document between the two. They form
   the texts of a second round in which the whole window is the anchor, so that a reference holds each of its windows.

An automaton of all references could not be broadcast: it grows with the corpus. Anchors route each passage to the
only reference that can decide it instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import WordHashes, gram_hashes, settled, slices, texts

WINDOW = 50
#: Words of an anchor in the first round.
ANCHOR = 12
SLICE_BYTES = 8_000_000


def window_anchors(words: np.ndarray, window: int, k: int) -> np.ndarray:
    """The anchor of every window: the smallest hash of its k-word sequences."""
    least = gram_hashes(words, k)
    span, width = window - k + 1, 1
    if len(least) < span:
        return np.empty(0, np.uint64)
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    shift = span - width
    return np.minimum(least[:len(least) - shift], least[shift:]) if shift else least


class Automaton:
    """Suffix automaton of word sequences."""

    def __init__(self, parts: list[list[bytes]]):
        self.links: list[int] = [-1]
        self.lengths: list[int] = [0]
        self.steps: list[dict] = [{}]
        last = 0
        for number, part in enumerate(parts):
            last = self._extend(last, ("end", number))  # met by no word, so that no match runs over it
            for word in part:
                last = self._extend(last, word)

    def _extend(self, last: int, symbol) -> int:
        links, lengths, steps = self.links, self.lengths, self.steps
        new = len(steps)
        steps.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        at = last
        while at >= 0 and symbol not in steps[at]:
            steps[at][symbol] = new
            at = links[at]
        if at >= 0:
            to = steps[at][symbol]
            if lengths[at] + 1 == lengths[to]:
                links[new] = to
            else:
                copy = len(steps)
                steps.append(dict(steps[to]))
                lengths.append(lengths[at] + 1)
                links.append(links[to])
                while at >= 0 and steps[at].get(symbol) == to:
                    steps[at][symbol] = copy
                    at = links[at]
                links[to] = links[new] = copy
        return new

    def matches(self, words: list[bytes]) -> np.ndarray:
        """For each word, the length of the longest match that ends with it."""
        links, lengths, steps = self.links, self.lengths, self.steps
        state = length = 0
        out = []
        for word in words:
            to = steps[state].get(word)
            while to is None and state:
                state = links[state]
                length = lengths[state]
                to = steps[state].get(word)
            if to is not None:
                state, length = to, length + 1
            out.append(length)
        return np.array(out, np.int64)


def _runs(flags: np.ndarray) -> np.ndarray:
    """(first, end) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def _round(texts_df: DataFrame, window: int, k: int, want_rest: bool, keep_text: bool) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """One round over rows (row, base, doc_id, text, other columns): spans to remove (row, first, end), texts of windows to look at
    again, and the rows themselves with n_words, and kept_sha256 and ``alone`` where no window shares an anchor."""
    kind = texts_df.schema["doc_id"].dataType.simpleString()
    extra = [c for c in texts_df.columns if c not in ("row", "base", "doc_id", "text")]

    def elect(batches):
        hashes = WordHashes()
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                anchors, owner = [], []
                for i, text in enumerate(texts(batch, "text")):
                    found = window_anchors(hashes.of(text.split()), window, k)
                    if len(found):
                        found = np.unique(found[np.concatenate([[True], found[1:] != found[:-1]])])
                        anchors.append(found)
                        owner.append(np.full(len(found), i))
                if anchors:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(owner)))], ["anchor", "doc_id"])

    elected = settled(texts_df.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(elect, f"anchor long, doc_id {kind}"))
    shared = elected.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") < F.col("last")).drop("last")
    lists = elected.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "first")).alias("anchors"))
    joined = texts_df.join(lists, "doc_id", "left").select("row", "base", "doc_id", "text", "anchors", *extra)

    def sort_out(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                alone = batch.column(4).is_null()
                sizes, digest = [], []
                for text, one in zip(texts(batch, "text"), alone.to_pylist()):
                    words = text.split()
                    sizes.append(len(words))
                    digest.append(hashlib.sha256(b" ".join(words)).hexdigest() if one else None)
                text = batch.column(3)
                if not keep_text:
                    text = pa.array([None if one else x for x, one in zip(text.to_pylist(), alone.to_pylist())], text.type)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], text, *batch.columns[4:], alone, pa.array(sizes, pa.int64()), pa.array(digest, pa.string())],
                                                 [*batch.schema.names, "alone", "n_words", "kept_sha256"])

    schema = T.StructType([*joined.schema.fields, *T._parse_datatype_string("alone boolean, n_words long, kept_sha256 string").fields])
    sorted_out = settled(joined.mapInArrow(sort_out, schema))

    def cut(batches):
        hashes = WordHashes()
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                take, refs, start, out = [], [], [], []
                lists = batch.column(4)
                flat = lists.flatten()
                names, firsts = flat.field(0).to_numpy(), flat.field(1)
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]).astype(np.int64)
                for i, text in enumerate(texts(batch, "text")):
                    words = text.split()
                    anchors = window_anchors(hashes.of(words), window, k).view(np.int64)
                    own = names[ends[i]:ends[i + 1]]
                    order = np.argsort(own)
                    at = np.minimum(np.searchsorted(own, anchors, sorter=order), len(own) - 1)
                    hit = own[order[at]] == anchors
                    # neighbouring windows with one reference form a passage
                    ref = np.where(hit, order[at] + ends[i], -1)
                    codes = firsts.take(pa.array(np.maximum(ref, 0))).dictionary_encode().indices.to_numpy()
                    codes = np.where(hit, codes, -1)
                    edge = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
                    for first, end in zip(edge.tolist(), [*edge[1:].tolist(), len(codes)]):
                        if codes[first] >= 0:
                            take.append(i)
                            refs.append(int(ref[first]))
                            start.append(first)
                            out.append(b" ".join(words[first:end - 1 + window]))
                if take:
                    rows = pa.array(take)
                    base = batch.column(1).to_numpy()[take] + np.array(start)
                    yield pa.RecordBatch.from_arrays([firsts.take(pa.array(refs)), batch.column(0).take(rows), pa.array(base), batch.column(2).take(rows), pa.array(out, pa.binary()).cast(pa.string())],
                                                     ["ref", "row", "base", "doc_id", "text"])

    passages = settled(sorted_out.where(~F.col("alone")).select("row", "base", "doc_id", "text", "anchors").mapInArrow(cut, f"ref {kind}, row long, base long, doc_id {kind}, text string"))
    # a reference's passages: parts of one document, each text once even if its rows repeat
    # written, so that the join reads both sides as plain tables and can split a reference with very many passages
    references = settled(passages.where(F.col("doc_id") == F.col("ref")).groupBy("ref").agg(F.collect_set("text").alias("parts")))
    streams = passages.where(F.col("doc_id") > F.col("ref")).join(references, "ref").sortWithinPartitions("ref")

    def stream(batches):
        known, automaton = None, None
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE_BYTES)):
            rows = []
            for ref, row, base, doc, text, parts in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5)):
                if known != ref:
                    known, automaton = ref, Automaton([p.encode().split() for p in sorted(parts.as_py())])
                words = text.encode().split()
                found = automaton.matches(words) >= window
                covered = np.zeros(len(words) + 1, np.int64)
                ends = np.flatnonzero(found)
                np.add.at(covered, ends - window + 1, 1)
                np.add.at(covered, ends + 1, -1)
                rows.extend({"row": row, "doc_id": doc, "first": base + a, "end": base + b, "text": None} for a, b in _runs(np.cumsum(covered[:-1]) > 0).tolist())
                if want_rest:
                    for a, b in _runs(~found[window - 1:]).tolist():
                        rows.append({"row": row, "doc_id": doc, "first": base + a, "end": base + b - 1 + window, "text": b" ".join(words[a:b - 1 + window]).decode()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("row", pa.int64()), ("doc_id", batch.schema.field(3).type), ("first", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    streamed = streams.select("ref", "row", "base", "doc_id", "text", "parts").mapInArrow(stream, f"row long, doc_id {kind}, first long, end long, text string")
    streamed = settled(streamed)
    spans = streamed.where(F.col("text").isNull()).select("row", "first", "end")
    rest = streamed.where(F.col("text").isNotNull()).select("row", F.col("first").alias("base"), "doc_id", "text") if want_rest else None
    return spans, rest, sorted_out


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, carry: list[str] | None = None, keep_text: bool = False,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``kept`` (the carried columns), n_words, n_removed, kept_sha256 and, with ``keep_text``, ``text``.

    ``text`` is the document's own where nothing goes, else its kept words joined by one space. Words are runs of other
    characters than the six ASCII white-space characters. Windows are judged on the input. Null and empty texts have no
    words. Rows with a null id lose nothing and cost others nothing; rows that share an id are one document to the rule,
    each judged by its own words. An empty table gives no rows. Carried columns stay in a struct, so their names can't clash.
    """
    carry = [id_col] if carry is None else carry
    # a row's number is drawn where the rows are written first, and read from there
    start = docs.select(F.monotonically_increasing_id().alias("row"), F.lit(0).cast("long").alias("base"), docs[f"`{id_col}`"].alias("doc_id"),
                        docs[f"`{text_col}`"].alias("text"), F.struct(*[docs[f"`{c}`"] for c in carry]).alias("kept"))
    spans, rest, rows = _round(start, window, anchor, want_rest=True, keep_text=keep_text)
    more, _, _ = _round(rest, window, window, want_rest=False, keep_text=False)
    gone = spans.unionByName(more).groupBy("row").agg(F.collect_list(F.struct("first", "end")).alias("gone"))

    def remove(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                removed, digest, left = [], [], []
                for text, own, cuts in zip(batch.column(0), texts(batch, "text"), batch.column(1).to_pylist()):
                    words = own.split()
                    stay = np.ones(len(words), bool)
                    for cut in cuts or ():
                        stay[cut["first"]:cut["end"]] = False
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                    removed.append(len(stay) - len(words))
                    joined = b" ".join(words)
                    digest.append(hashlib.sha256(joined).hexdigest())
                    if keep_text:
                        left.append(joined.decode() if removed[-1] else text.as_py())
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(removed, pa.int64()), pa.array(digest, pa.string()),
                                                  pa.array(left if keep_text else [None] * len(digest), pa.string())], ["kept", "n_words", "n_removed", "kept_sha256", "text"])

    judged = rows.where(~F.col("alone")).join(gone, "row", "left").select("text", "gone", "kept", "n_words")
    schema = T.StructType([rows.schema["kept"], *T._parse_datatype_string("n_words long, n_removed long, kept_sha256 string, text string").fields])
    untouched = rows.where("alone").select("kept", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", "text")
    return judged.mapInArrow(remove, schema).union(untouched)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the spans removed from the text; all other columns stay as they are."""
    others = [c for c in docs.columns if c != text_col]
    out = dedup(docs, carry=others, keep_text=True, id_col=id_col, text_col=text_col, **options)
    return out.select(*[F.col("text").alias(text_col) if c == text_col else F.col("kept")[c].alias(c) for c in docs.columns])
