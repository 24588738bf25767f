"""Periodic runs against trying every period, whole and cut into small tiles."""

import random

import brute_new
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from plumbline.llm import periodic
from plumbline.llm import queries as Q

rnd = random.Random(11)


def planted(n, letters):
    words = [rnd.choice(letters) for _ in range(n)]
    for _ in range(rnd.randint(0, 4)):
        at, p = rnd.randrange(n), rnd.randint(1, 9)
        unit = [rnd.choice(letters) for _ in range(p)]
        words[at:] = [unit[i % p] if i < rnd.randint(1, n) else w for i, w in enumerate(words[at:])]
    return words


TEXTS = [" ".join(planted(rnd.randint(1, 150), "abc"[:rnd.randint(1, 3)])) for _ in range(60)]
#: id, text: nulls, empties, repeated rows, ids shared by different texts, odd white space, one word only, a long period
ROWS = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "a " * 5), (6, "a " * 6), (7, "é\x85 漢\n" * 9), (8, "a b " * 4), (8, "a b " * 4), (8, "c d e " * 4), (None, "x y " * 6), (None, None),
        (9, " ".join(f"w{i % 700}" for i in range(2900))), *enumerate(TEXTS, 100)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("uid", "runs", "n_words", "start", "end", "period", "kept", "words", "run", "new", "collapsed")})


def test_query_equals_trying_every_period(spark):
    fields = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r[c] for c in fields) for r in Q.op11_periodic_runs(spark, SF).collect()}
    assert got == {r.doc_id: brute_new.periodic(r.doc_id, r.text) for r in docs}
    assert sum(v[0] > 0 for v in got.values()) > 5


@pytest.mark.parametrize("tile_words", [32, 64, periodic.TILE_WORDS])
def test_tiles_of_any_size_give_the_same_runs(docs, tile_words):
    rows = periodic.periodic_runs(docs, tile_words=tile_words).collect()
    want = []
    for doc, text in ROWS:
        words = brute_new.SPACE_WORDS.findall(text or "")
        found = brute_new.runs(words)
        want.append((doc, len(words), found, brute_new.collapsed(words, found)))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in rows)


def test_no_rows(docs):
    assert periodic.periodic_runs(docs.where("false")).count() == 0


def test_a_long_text_in_seconds():
    words = np.concatenate([np.arange(300_000), np.tile(np.arange(70_000), 5), np.zeros(400_000, np.int64)])
    tiles = list(periodic.tiles_of(words, periodic.TILE_WORDS))
    assert max(len(t) for *_, t in tiles) < len(words) or len(tiles) > 1
    found = sorted({(q, s + at, e + at) for first, last, at, tile in tiles for q, s, e in periodic.fragments([tile], first, last)[0]})
    assert (70_000, 300_000, 650_001) in found and {q for q, _, _ in found} == {1, 70_000}
