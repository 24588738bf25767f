"""Count-based folds against a plain classifier, with many levels and classes."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.functions.columns import keyed_hash
from plumbline.plans import bayes as N

rnd = random.Random(4)
ROWS = [(i, rnd.choice(["a", "b", None]), rnd.randint(0, 300), f"c{rnd.randint(0, 40)}" if i % 30 else None) for i in range(500)]


def plain(rows, cell, k, alpha):
    out = {}
    for fold in range(k):
        train = [r for r in rows if cell[r[0]] != fold]
        classes, counts, levels = Counter(r[3] for r in train), Counter(), defaultdict(set)
        for r in train:
            for c in (1, 2):
                counts[c, str(r[c]), r[3]] += 1
                levels[c].add(str(r[c]))
        for r in rows:
            if cell[r[0]] == fold:
                scores = {y: math.log(n / len(train)) + sum(math.log((counts[c, str(r[c]), y] + alpha) / (n + alpha * len(levels[c]))) for c in (1, 2)) for y, n in classes.items()}
                best = min((-round(s, 9), y) for y, s in scores.items())
                out[r[0]] = (fold, r[3], best[1], -best[0])
    return out


@pytest.mark.parametrize("alpha", [1.0, 0.1])
def test_out_of_fold_predictions(spark, alpha):
    df = spark.createDataFrame(ROWS, "id long, u string, v long, y string").repartition(3)
    cell = {r.id: r.c for r in df.select("id", (keyed_hash(42, "id") % 5).alias("c")).collect()}
    got = {r.id: (r.fold, r.label, r.pred, r.score) for r in N.oof_bayes(df, "y", "id", ["u", "v"], k=5, alpha=alpha).collect()}
    want = plain([r for r in ROWS if r[3] is not None], cell, 5, alpha)
    assert got.keys() == want.keys()
    assert all(got[i][:3] == want[i][:3] and got[i][3] == pytest.approx(want[i][3], abs=1e-8) for i in want)


def test_own_folds_and_no_rows(spark):
    df = spark.createDataFrame([(i, f"l{i % 2}", f"l{i % 2}") for i in range(40)], "id long, u string, y string")
    assert {r.score for r in N.cv_bayes(df, "y", "id", ["u"], k=4, fold=F.col("id").bitwiseAND(3)).collect()} == {1.0}
    assert N.oof_bayes(df.where("false"), "y", "id", ["u"]).count() == 0
