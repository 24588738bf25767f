"""Product codes against plain k-means over whole numbers."""

import math
import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from plumbline.llm import queries as Q
from plumbline.llm import vectorcodes as V

rnd = random.Random(13)


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(vec_id, label, codes, error) and the codebooks, comparing every part with every entry in plain Python."""
    kept = [(i, tuple(math.floor(scale * x) for x in v), label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((i, v) for i, v, _ in kept if i is not None)[:entries]
    width = len(start[0][1]) // parts
    books = [[list(v[p * width:(p + 1) * width]) for _, v in start] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for r in range(rounds + 1):
        found = [[nearest(v[p * width:(p + 1) * width], books[p]) for p in range(parts)] for _, v, _ in kept]
        if r < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    own = [v[p * width:(p + 1) * width] for (_, v, _), f in zip(kept, found) if f[p][1] == k]
                    if own:
                        books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    return [(i, label, [k for _, k in f], sum(d for d, _ in f)) for (i, _, label), f in zip(kept, found)], books


def clusters(n, size=8):
    centres = [[rnd.uniform(-1, 1) for _ in range(size)] for _ in range(6)]
    return [(i, [rnd.gauss(c, 0.02) for c in rnd.choice(centres)], rnd.choice([0, 1, None])) for i in range(n)]


BAD = [(500, None, 1), (501, [], 1), (502, [0.1, None] * 4, 1), (503, [math.nan] * 8, 1), (504, [math.inf] + [0.0] * 7, 1), (505, [-math.inf] + [0.0] * 7, None)]
COPIES = [(7, [0.25] * 8, 3), (7, [0.25] * 8, 3), (8, [0.25] * 8, 3), (None, [0.5] * 8, 2), (9, [-0.0001] * 8, None)]


@pytest.mark.parametrize("rows, entries", [(clusters(200), 16), (clusters(30) + BAD + COPIES, 256), (COPIES, 2), (clusters(150) + COPIES * 20, 24)])
def test_codes_are_those_of_plain_means(spark, rows, entries):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    df = df.withColumns({c: F.lit("clash") for c in ("v", "codes", "error", "part", "entry", "n", "sums", "far")})
    found = V.compress(df, entries=entries)
    want, books = plain(rows, entries=entries)
    assert sorted(map(repr, want)) == sorted(repr((r.vec_id, r.label, r.codes, r.error)) for r in found.rows.collect())
    assert [b.tolist() for b in found.codebooks] == books


def test_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, books = plain(rows[:])
    totals = {}
    for _, label, _, e in want:
        totals[label] = totals.get(label, 0) + e
    h = V.digest([np.array(b) for b in books])
    got = {(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in Q.op13_vector_codes(spark, SF).collect()}
    assert got == {(i, "".join(f"{k:02x}" for k in codes), e, totals[label], h) for i, label, codes, e in want}


def test_pruned_search_is_the_full_search():
    for small in (True, False):
        for _ in range(20):
            x = np.array([[rnd.randint(-9, 9) for _ in range(3)] for _ in range(400)])
            entries = np.array([[rnd.randint(-9, 9) for _ in range(3)] for _ in range(rnd.randint(1, 40))])
            last, far = V.assign(x, V.Balls(entries), None, small)
            moved = entries + np.array([[rnd.randint(-2, 2) for _ in range(3)] for _ in entries])
            radius = np.array([max([((x[j] - moved[k]) ** 2).sum() for j in np.flatnonzero(last == k)], default=0) for k in range(len(moved))], object)
            pruned = V.assign(x, V.Balls.of(moved, radius), last, small)
            whole = V.assign(x, V.Balls(moved), None, small)
            assert all(np.array_equal(a, b) for a, b in zip(pruned, whole))


def test_nothing_to_code_and_refusals(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert V.compress(spark.createDataFrame([], schema)).rows.count() == 0
    assert V.compress(spark.createDataFrame(BAD, schema)).rows.count() == 0
    assert [(r.vec_id, r.codes, r.error) for r in V.compress(spark.createDataFrame([(None, [0.5] * 8, 2)], schema)).rows.collect()] == [(None, None, None)]
    for bad in ([(1, [0.5] * 8, 1), (2, [0.5] * 4, 1)], [(1, [0.5] * 6, 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(ValueError):
            V.compress(spark.createDataFrame(bad, schema))
