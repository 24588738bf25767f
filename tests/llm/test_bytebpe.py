"""Encoding against the tiktoken library, offsets against the tokenizers library, decoding as an exact round trip."""

import hashlib
import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from plumbline.llm import bytebpe, tokens
from plumbline.llm import queries as Q
from plumbline.llm.common import vocabulary_file

RANKS = vocabulary_file("byte_bpe_50k.tiktoken")
rnd = random.Random(12)
ODD = [*"abcderstvml'' \n\t12!?-é漢🙂", "<|endoftext|>", "'re", "'ll", " the", "ing", "́", "\x85", "\xa0", "　", "\x1c", "\x1f", "\r\n", "  ", " ", "\x00"]
MIXED = ["".join(rnd.choices(ODD, k=rnd.randint(0, 60))) for _ in range(3000)]
ROWS = [(1, None), (2, ""), (3, " \t\n "), (4, "x<|endoftext|>y"), (5, "same text"), (5, "same text"), (None, "é́ \U0001f642  漢字"), (None, None), *enumerate(MIXED[:300], 10)]


@pytest.fixture(scope="module")
def tiktoken_library():
    import public_tokenizers
    import tiktoken
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.ranks_file(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("ids", "n_tokens", "bytes", "starts", "n_inside")})


def test_ids_are_those_of_tiktoken(tiktoken_library):
    every = ["a" + chr(c) + "1 " + chr(c) + " b" + chr(c) * 2 + "!" + chr(c) + "\n" + chr(c) for c in range(0, 0x30000) if not 0xD800 <= c < 0xE000]
    assert sum(bool(bytebpe._SETTLED(x)) for x in every) > 30_000
    texts = [*MIXED, *every]
    assert [x.tolist() for x in bytebpe.Encoder(RANKS).ids(texts)] == tiktoken_library.encode_ordinary_batch(texts)


def test_query(spark, tiktoken_library):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = tiktoken_library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op12_byte_bpe(spark, SF).collect()} == want


def test_rows_offsets_and_round_trip(docs):
    encoded = bytebpe.encode(docs, RANKS, with_offsets=True)
    rows = encoded.collect()
    texts = [t or "" for _, t in ROWS]
    found = bytebpe.library(RANKS).encode_batch(texts, add_special_tokens=False)
    want = [(d, e.ids, [a for a, _ in e.offsets], [b for _, b in e.offsets]) for (d, _), e in zip(ROWS, found)]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.ids, r.starts, r.ends)) for r in rows)
    assert sum(r.n_inside for r in rows) > 0
    back = bytebpe.decode(encoded, RANKS).collect()
    assert sorted(map(repr, ((d, t or "", (t or "").encode()) for d, t in ROWS))) == sorted(repr((r.doc_id, r.text, bytes(r.bytes))) for r in back)
    assert bytebpe.encode(docs.where("false"), RANKS).count() == 0 and bytebpe.decode(encoded.where("false"), RANKS).count() == 0


def test_parts_of_characters(spark):
    ids = bytebpe.Encoder(RANKS).ids(["a🙂b"])[0].tolist()
    assert len(ids) > 3
    cut = [(i, ids[:i]) for i in range(len(ids) + 1)]
    rows = {r.doc_id: r for r in bytebpe.decode(spark.createDataFrame([*cut, (99, None)], "doc_id long, ids array<int>"), RANKS).collect()}
    assert rows[len(ids)].text == "a🙂b" and rows[2].text == "a�" and rows[99].text == "" and rows[99].n_tokens == 0
    with pytest.raises(Exception, match="vocabulary"):
        bytebpe.decode(spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>"), RANKS).collect()


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000 + "x", "x" * 1_000_000, "漢" * 300_000])
def test_long_stretches(text):
    ids = bytebpe.Encoder(RANKS).ids([text])[0]
    assert b"".join(map(bytebpe.byte_table(RANKS)[0].__getitem__, ids.tolist())).decode() == text
