"""Boosted trees cut by average precision, against brute force over all prefixes."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from paygrove.operators import models


@pytest.fixture(scope="module")
def parts(spark):
    rng = random.Random(7)
    rows = []
    for n in range(900):
        x, y = rng.random(), rng.choice([None, 0.0, 1.0, 2.0])
        rows.append((f"a{n:04d}", x, y, float(rng.random() < 0.05 + 0.5 * (x > 0.8) + 0.2 * (y == 2.0))))
    d = models.matrix(spark.createDataFrame(rows, "account_key string, u double, v double, label double"), ["u", "v"])[0].cache()
    return d.filter("account_key < 'a0500'"), d.filter("account_key >= 'a0500'")


def plain_precision(score, label):
    """Precision at each distinct score times the positives there, over all positives."""
    total = 0.0
    for s in np.unique(score):
        total += label[score == s].sum() * label[score >= s].mean()
    return total / label.sum()


def test_size_is_the_best_prefix(parts):
    train, valid = parts
    m = models.boosted(train, valid, trees=8, depth=2)
    rows = valid.select("x", "label").collect()
    label = np.array([r.label for r in rows])
    margins = np.cumsum([[t.predict(r.x) * w for r in rows] for t, w in zip(m.model.trees, m.model.treeWeights, strict=True)], axis=0)
    want = [plain_precision(np.round(s, 12), label) for s in margins]
    assert np.allclose(m.curve, want) and m.size == 1 + int(np.argmax(np.round(want, 12)))
    got = np.array([r.boosted for r in m.transform(valid).select("boosted").collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-2 * margins[m.size - 1])))


def test_all_trees_are_the_ensemble(parts):
    train, valid = parts
    m = models.boosted(train, valid, trees=4, depth=2)
    whole = models.Boosted(m.model, 4, m.curve).transform(valid)
    got = m.model.transform(whole).select("boosted", vector_to_array("probability")[1].alias("p")).filter(F.abs(F.col("boosted") - F.col("p")) > 1e-9)
    assert got.count() == 0


def test_search_takes_the_best_trial(parts):
    train, valid = parts
    best, trials = models.tune(train, valid, trees=3, grid=((1, 0.1), (3, 0.1), (3, 0.1)))
    top = max(t[3] for t in trials)
    assert len(trials) == 3 and best.curve[best.size - 1] == top and trials[1] == trials[2]


def test_no_positive_to_rank(parts):
    train, valid = parts
    m = models.boosted(train, valid.filter("label = 0"), trees=2, depth=1)
    assert m.size == 1 and m.curve == (0.0, 0.0)
    assert models.boosted(train, valid.limit(0), trees=2, depth=1).curve == (0.0, 0.0)
