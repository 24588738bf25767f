"""Quality rules: measures of a text, and a table of thresholds compiled into one projection.

Only built-in functions are used. Measures stand in projections that build on one another, each computed once
a row; the rules are one expression over them.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACES

SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, French, Spanish and German.
STOP_WORDS = ("the be to of and that have with in is for it as on by this are or an a was at from "
              "le la les de des du et un une en que qui dans pour est sur pas par au aux avec ce il elle "
              "el los las del y una se por con para su lo como más no es "
              "der die das und ein eine ist im den dem von zu mit sich auf für nicht des sie auch").split()

#: Words in a window whose repetition counts.
WINDOW = 5


class Rule(NamedTuple):
    """A measure over another one (or over 1) must lie within bounds, where the text has ``at_least`` words."""

    name: str
    measure: str
    over: str | None
    low: float | None
    high: float | None
    at_least: int = 0


#: A text is kept if it meets every rule.
RULES = [
    Rule("length", "n_words", None, 10, None),
    Rule("word_length", "word_chars", "n_words", 1.5, 20.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.25),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None, 50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.3),
    Rule("symbol_lines", "n_symbol_lines", "n_lines", None, 0.8),
]


def _blank(text: Column) -> Column:
    return F.translate(text, SPACES[1:], " " * (len(SPACES) - 1))


def _neighbour_equal(array: Column, value, i, key) -> Column:
    """Whether an element of a sorted array equals the one before or after it."""
    one = F.lit(1)
    before, after = F.get(array, i - one), F.get(array, i + one)
    return F.coalesce(key(before) == key(value), F.lit(False)) | F.coalesce(key(after) == key(value), F.lit(False))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` as a struct column ``kept``, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words, n_symbol_lines."""
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    df = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("kept"), text.alias("text"))
    packed = F.translate("text", SPACES, "")
    df = df.select(
        "kept", F.char_length(packed).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.array_remove(F.split(_blank(F.col("text")), " "), "").alias("w"),
        F.filter(F.split("text", "\n"), lambda line: F.translate(line, SPACES, "") != "").alias("lines"))
    w = F.col("w")
    # the hash of each window; equal windows have equal hashes, so a text without equal hashes repeats nothing
    grams = F.when(F.size(w) >= WINDOW, F.transform(F.slice(w, 1, F.size(w) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)])))
    df = df.select(
        "*", grams.alias("grams"), F.size(w).cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: F.substring(F.translate(x, SPACES, ""), 1, 1).isin(list(SYMBOLS)))).cast("long").alias("n_symbol_lines"))
    # hash and place in one number: neighbours in sorted order with equal hashes are candidates
    place = F.transform("grams", lambda h, i: F.shiftleft(F.shiftright(h, 32), 31).bitwiseOR(i.cast("long")))
    df = df.withColumn("sorted", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.array_sort(place)))
    alike = F.transform(F.filter("sorted", lambda v, i: _neighbour_equal(F.col("sorted"), v, i, lambda x: F.shiftright(x, 31))), lambda v: v.bitwiseAND((1 << 31) - 1))
    df = df.withColumn("alike", alike)
    # the words themselves decide
    texts = F.array_sort(F.transform("alike", lambda p: F.struct(F.array_join(F.slice(w, p.cast("int") + 1, WINDOW), " ").alias("g"), p.alias("p"))))
    df = df.withColumn("texts", texts)
    same = F.transform(F.filter("texts", lambda v, i: _neighbour_equal(F.col("texts"), v, i, lambda x: x["g"])), lambda v: v["p"])
    df = df.withColumn("same", F.array_sort(same))
    covered = F.aggregate(F.transform("same", lambda p, i: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get("same", i + 1) - p, F.lit(WINDOW).cast("long")))),
                          F.lit(0).cast("long"), lambda total, x: total + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    return df.drop("w", "lines", "grams", "sorted", "alike", "texts", "same")


def verdict(rules: list[Rule]) -> Column:
    """The threshold table as one expression."""

    def met(rule: Rule) -> Column:
        measure = F.col(rule.measure)
        over = F.lit(1) if rule.over is None else F.greatest(F.col(rule.over), F.lit(1))
        # bounds are multiplied out, so that no ratio is rounded
        tests = [] if rule.low is None else [measure >= over * rule.low]
        tests += [] if rule.high is None else [measure <= over * rule.high]
        ok = reduce(lambda a, b: a & b, tests)
        return ok | (F.col("n_words") < rule.at_least) if rule.at_least else ok

    return reduce(lambda a, b: a & b, map(met, rules))


def judge(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its columns as the struct ``kept``, the measures, base_failed, and passes.

    ``base_failed``: fewer than 10 words, or more than a fifth of the words in repeated windows. Null and empty
    texts have no words and fail; repeated rows are judged one by one; an empty table gives no rows. Any other
    columns stay inside the struct, so their names can't clash.
    """
    df = measures(docs, text_col)
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return df.withColumn("passes", ~F.col("base_failed") & verdict(rules))


def accepted(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    # a filter would be pushed below the projections, each measure spelled out as often as it is used; a generator stays where it is
    return judge(docs, rules, text_col).select(F.explode(F.when(F.col("passes"), F.array("kept"))).alias("kept")).select("kept.*")
