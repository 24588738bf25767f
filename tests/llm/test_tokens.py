"""Ids of texts with very long stretches of one kind, against the tokenizers library."""

import time

import numpy as np
import pytest

from plumbline.llm import packing, tokens
from plumbline.llm.common import vocabulary_file

TOKENIZER = vocabulary_file("byte_bpe_50k.json")
LONG = 2_000_000


@pytest.mark.parametrize("text", [" " * LONG, "\n" * LONG, "a" + " " * LONG + "b", "x\n" + "\n" * LONG + " y", " " * LONG + "<|endoftext|>" + " " * LONG + "\nz", "w" * 1_000_000,
                                  "　" * 300_000 + "é", "one  two" + "\t \n" * 400_000 + "\x1c" + " " * 150_000 + "!"],
                         ids=["blanks", "newlines", "between letters", "newlines before a blank", "around a special string", "a word", "wide blanks", "mixed"])
def test_long_stretches(text):
    from tokenizers import Tokenizer
    begun = time.perf_counter()
    ids = tokens.ids_of(text, TOKENIZER)
    assert time.perf_counter() - begun < 60
    assert ids.dtype == np.uint32 and ids.tolist() == Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


def test_packing_of_long_white_space(spark):
    df = spark.createDataFrame([(1, " " * LONG), (2, "word"), (3, "\n" * LONG + "x")], "doc_id long, text string")
    rows = packing.pack(df, TOKENIZER).collect()
    for doc in (1, 2, 3):
        pieces = sorted((r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == doc)
        assert sum(p[1] for p in pieces) == pieces[0][2] and [p[0] for p in pieces] == np.cumsum([0, *(p[1] for p in pieces)])[:-1].tolist()
