"""The pipeline and each of its stages against plain versions, on awkward rows and on a whole small table."""

import re

import brute
import corpus_pipeline
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_operators import PASSAGE, ROWS, check_packed, prose

from plumbline.llm import quality


def good(text):
    """The verdict of the rules, from measures taken in plain Python."""
    text = text or ""
    n, chars, symbols, dup, repeat, failed = brute.quality(text)
    lines = [x for x in text.split("\n") if brute.SPACE_WORDS.search(x)]
    m = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_lines": len(lines), "n_stop_words": sum(w.lower() in set(quality.STOP_WORDS) for w in brute.SPACE_WORDS.findall(text)),
         "n_symbol_lines": sum(brute.SPACE_WORDS.search(x)[0][0] in quality.SYMBOLS for x in lines)}

    def within(r):
        over = max(m[r.over], 1) if r.over else 1
        return n < r.at_least or ((r.low is None or m[r.measure] >= r.low * over) and (r.high is None or m[r.measure] <= r.high * over))

    return not failed and all(within(r) for r in quality.RULES)


def without_passages(docs, window=50):
    """id -> text without the words of windows that a document with a smaller id holds; texts that lose nothing stay as they are."""
    first, split = {}, {d: brute.SPACE_WORDS.findall(t or "") for d, t in docs}
    for d in sorted(split):
        for i in range(len(split[d]) - window + 1):
            first.setdefault(tuple(split[d][i:i + window]), d)
    out = {}
    for d, t in docs:
        gone = {i + k for i in range(len(split[d]) - window + 1) if first[tuple(split[d][i:i + window])] < d for k in range(window)}
        out[d] = " ".join(w for i, w in enumerate(split[d]) if i not in gone) if gone else t
    return out


def plain(docs, bench):
    """The documents after each of the first four stages."""
    one = [(d, t) for d, t in docs if good(t)]
    kept = brute.near(one)
    two = [(d, t) for d, t in one if kept[d][2]]
    three = list(without_passages(two).items())
    bad = brute.leaks(three, bench)
    return one, two, three, [(d, t) for d, t in three if not bad[d][4]]


def words(rows):
    return sorted((d, brute.SPACE_WORDS.findall(t or "")) for d, t in rows)


@pytest.fixture(scope="module")
def bench(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def test_run_over_a_whole_table(spark, bench):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = plain([(r.doc_id, r.text) for r in docs.collect()], bench)[-1]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    left = [(r.doc_id, r.text) for r in docs.collect()]
    assert words(left) == words(last) and len(last) > 0
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {d for d, _ in last}
    check_packed(rows, left)


def test_stages_on_awkward_rows(spark, bench):
    """Nulls, empties, ties, repeated rows, long texts and columns with clashing names; every stage but the last keeps the columns."""
    item = next(t for _, t in bench if len(re.findall(r"\w+", t)) > 12)
    unique = [(d, t) for d, t in ROWS if d not in (None, 22, 24)] + [(50, prose(60) + " the of to and " + item), (51, "the of to and " + prose(80) + " " + PASSAGE), (52, "the of and to " + prose(70) + " " + PASSAGE)]
    docs = spark.createDataFrame(unique, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("kept", "n_words", "component", "items")}).withColumn("n_chars", F.char_length("text").cast("long"))
    columns = docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES, plain(unique, bench)):
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        got = [(r.doc_id, r.text, r.n_chars) for r in docs.collect()]
        assert words([(d, t) for d, t, _ in got]) == words(want), name
        if name != "quality rules":
            assert all(n == len(t or "") for _, t, n in got)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packed(packed, [(r.doc_id, r.text) for r in docs.collect()])


def test_stages_on_rows_that_share_or_lack_ids(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n_chars", F.char_length("text").cast("long"))
    for empty in (docs.where("false"), docs):
        left = empty
        for name, stage in corpus_pipeline.STAGES:
            left = stage(spark, left, SF)
            assert left.count() >= 0, name
            assert name == "packing" or left.columns == docs.columns
