import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paygrove.operators import evaluate, ranks


@pytest.mark.parametrize("one_range", [0, None])
def test_running_equals_plain(spark, one_range):
    rng = np.random.default_rng(3)
    rows = [(k, None if k % 11 == 0 else int(rng.integers(0, 3)), int(rng.integers(0, 50)), int(rng.integers(-5, 9))) for k in range(700)]
    df = spark.createDataFrame(rows, "i int, g int, x int, v int").repartition(9)
    got = ranks.running(df, [F.desc("x"), F.col("i")], ("g",), F.col("v"), "upto", also={"n": F.lit(1)}, one_range=one_range).collect()
    top = {r.i: r.m for r in ranks.running(df, [F.desc("x"), F.col("i")], (), F.col("v"), "m", F.max, one_range=one_range).collect()}
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    sums, n, most = {}, {}, -99
    want = {}
    for i, g, _, v in order:
        sums[g], n[g], most = sums.get(g, 0) + v, n.get(g, 0) + 1, max(most, v)
        want[i] = (sums[g], n[g])
        assert top[i] == most
    assert {r.i: (r.upto, r.n) for r in got} == want
    assert ranks.running(df.limit(0), [F.col("i")], one_range=one_range).count() == 0


def test_bootstrap_equals_plain(spark):
    """Weights of every replicate laid out in full, on scores with ties."""
    rng = np.random.default_rng(1)
    rows = [(f"a{k}", float(rng.integers(0, 40)) / 40, int(rng.random() < 0.2)) for k in range(400)]
    df = spark.createDataFrame(rows, "account_key string, score double, label int").repartition(5)
    h = np.array([r.h for r in df.select(F.xxhash64(F.lit(11), "account_key").alias("h"), "account_key").orderBy("account_key").collect()])
    s, y = (np.array([r[k] for r in sorted(rows)]) for k in (1, 2))
    w = evaluate._weights(h, np.arange(60))
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.1
    ap = []
    for c in w.T:
        n = p = a = 0.0
        for v in sorted(set(s), reverse=True):
            k = (c * (s == v)).sum(), (c * (s == v) * y).sum()
            n, p = n + k[0], p + k[1]
            a += k[1] * p / max(n, 1)
        ap.append(a / p)
    got = evaluate.bootstrap_ap(df, reps=60).first()
    assert got.reps == 60 and got.lo == pytest.approx(np.quantile(ap, 0.025)) and got.hi == pytest.approx(np.quantile(ap, 0.975))


def test_residual_tail_equals_plain(spark):
    rng = np.random.default_rng(2)
    rows = [(f"a{k}", int(rng.integers(0, 10_000)), float(rng.random() / 3)) for k in range(300)]
    df = spark.createDataFrame(rows, "account_key string, loss_minor long, score double")
    h = np.array([r.h for r in df.select(F.xxhash64(F.lit(3), "account_key").alias("h"), "account_key").orderBy("account_key").collect()])
    loss, p = (np.array([r[k] for r in sorted(rows)]) for k in (1, 2))
    total = np.sort(((evaluate._uniform(h, np.arange(2000)) < p[:, None]) * loss[:, None]).sum(0))
    for n in (1, 7):
        got = evaluate.residual_tail(df.repartition(n), draws=2000).first()
        assert got.var95 == total[math.ceil(0.95 * 2000) - 1] and got.es975 == pytest.approx(total[math.ceil(0.975 * 2000) - 1 :].mean())
