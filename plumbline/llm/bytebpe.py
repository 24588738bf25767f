"""Byte-level BPE: whole texts to ids with offsets, and ids back to bytes.

The tokenizers library encodes with a vocabulary of byte ranks. Its merges are recovered from the ranks, and each byte
is written as the character that byte-level vocabularies use for it. Texts are cut into units before the
ASCII white space that follows a character which is no white space: no match of the split pattern crosses such a place, and none
depends on what stands beyond it. Each distinct unit of a batch is encoded once, so that repeated words cost
a look-up and a long text needs no more of the library than a short one. Units of characters whose classes all versions
of Unicode agree on are split with the pattern here and go to the library's merges; others go through the library whole.

Decoding turns each id into its bytes by the reverse table. A character's bytes may be split over ids: ids are joined as
bytes first, and only whole sequences become characters.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from plumbline.llm.common import columns, slices
from plumbline.llm.tokens import _byte_of_symbol, ranks_file

#: Units whose ids are remembered in one worker.
REMEMBERED = 400_000
#: Characters up to which a unit is split here.
LONG_UNIT = 4096
#: Bytes of text encoded at a time, unless one text is longer.
SLICE_BYTES = 4 << 20
#: Python's \S leaves out every character that Unicode counts as white space; the ASCII ones are white space for all libraries.
_CUT = re.compile(r"(?<=\S)(?=[ \t-\r])")
#: Characters that are letters, digits, white space or others for the regex module just as for the tokenizers library; a test compares them all.
SETTLED = r"\x00-\u0557\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fea\uac00-\ud7a3"
_SETTLED = re.compile(f"[{SETTLED}]*").fullmatch


def merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The two parts that make each token of more than one byte, in the order of their ranks."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, i = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= rank:
                raise ValueError(f"no merges lead to token {rank}")
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


@functools.cache
def library(path: str):
    """The tokenizers library with the vocabulary of a rank file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # Spark deals out the work
    import public_tokenizers
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers
    ranks, symbol = ranks_file(path), {b: s for s, b in _byte_of_symbol().items()}

    def symbols(token: bytes) -> str:
        return "".join(map(symbol.__getitem__, token))

    model = models.BPE(vocab={symbols(t): i for t, i in ranks.items()}, merges=[(symbols(a), symbols(b)) for a, b in merges(ranks)], ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"),
                                                       pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


@functools.cache
def byte_table(path: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The bytes of every id, how many they are, and whether they begin inside a character; ids without a token have none."""
    ranks = ranks_file(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table, np.array([len(t) for t in table]), np.array([0x80 <= t[0] < 0xC0 if t else False for t in table])


class Encoder:
    """Ids of texts; remembers those of units."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        self.tokenizer, self.known = library(path), {}
        self.matches = regex.compile(public_tokenizers.PATTERN).findall
        # the bytes of a text, read as Latin-1, to the characters of the vocabulary
        self.symbols = {b: s for s, b in _byte_of_symbol().items()}

    def ids(self, batch: list[str]) -> list[np.ndarray]:
        units = [_CUT.split(text) for text in batch]
        met = set().union(*units)
        new = met - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {u: self.known[u] for u in met - new}
        known, merge, symbols = self.known, self.tokenizer.model.tokenize, self.symbols
        whole = []
        for unit in new:
            plain = unit.isascii()
            if len(unit) > LONG_UNIT or not (plain or _SETTLED(unit)):
                whole.append(unit)
            elif plain and unit[:1] == " " and unit[1:].isalpha():       # one match, whose characters but the first stand for themselves
                known[unit] = array("i", [t.id for t in merge(symbols[32] + unit[1:])]).tobytes()
            else:
                known[unit] = array("i", [t.id for x in self.matches(unit) for t in merge(x.encode().decode("latin-1").translate(symbols))]).tobytes()
        for start in range(0, len(whole), 4096):
            part = whole[start:start + 4096]
            for unit, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[unit] = array("i", found.ids).tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, u)), np.int32) for u in units]


def offsets(text: bytes, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each id the first character that it has a byte of and the one after the last."""
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    first_bytes = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    character = np.cumsum(first_bytes, dtype=np.int32) - 1
    return character[starts], character[ends - 1] + 1


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """A list column from arrays of 32-bit numbers."""
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *parts]).astype(np.int32)))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, with_offsets: bool = False) -> DataFrame:
    """Per row: the id, ids, n_inside (ids that begin inside a character) and, ``with_offsets``, starts and ends in characters.

    Null and empty texts have no ids. Texts may be of any length, also as one word or one stretch of white space. Special
    strings are ordinary text. Repeated rows get a row each and a null id is kept. An empty table gives no rows.
    Other columns of ``docs`` are not looked at.
    """
    inner = columns(docs, doc_id=id_col, text=text_col)
    kind = inner.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "ids", "n_inside", *(["starts", "ends"] if with_offsets else [])]

    def run(batches: Iterator[pa.RecordBatch]):
        encoder = Encoder(path)
        _, lengths, inside = byte_table(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                read = [t or "" for t in part.column(1).to_pylist()]
                ids = encoder.ids(read)
                placed = [offsets(t.encode(), i, lengths) for t, i in zip(read, ids)] if with_offsets else []
                more = [_lists([p[k] for p in placed]) for k in (0, 1)] if with_offsets else []
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids), pa.array([int(inside[i].sum()) for i in ids], pa.int64()), *more], names)

    more = ", starts array<int>, ends array<int>" if with_offsets else ""
    return inner.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_inside long{more}").withColumnRenamed("doc_id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", *, with_text: bool = True) -> DataFrame:
    """Per row: the id, n_tokens, bytes and, ``with_text``, text: whole characters, with U+FFFD for parts of one at the ends or in between.

    Null and empty lists give no bytes; an id that the vocabulary does not have, or null, is refused. Other columns are not looked at.
    """
    inner = columns(encoded, doc_id=id_col, ids=ids_col)
    kind = inner.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        table = byte_table(path)[0]
        for batch in batches:
            lists = batch.column(1)
            n = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int64())
            if lists.flatten().null_count:
                raise ValueError("a null is no id of the vocabulary")
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            if len(ids) and not 0 <= ids.min() <= ids.max() < len(table):
                raise ValueError("an id that the vocabulary does not have")
            ends = np.cumsum(n.to_numpy(zero_copy_only=False)).tolist()
            joined = [b"".join(map(table.__getitem__, ids[start:end].tolist())) for start, end in zip([0, *ends], ends)]
            text = [pa.array([x.decode("utf-8", "replace") for x in joined], pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(joined, pa.binary()), *text], ["doc_id", "n_tokens", "bytes", *(["text"] if with_text else [])])

    return inner.mapInArrow(run, f"doc_id {kind}, n_tokens long, bytes binary" + (", text string" if with_text else "")).withColumnRenamed("doc_id", id_col)
