import statistics

import pytest
from pyspark.sql import functions as F

from paygrove.operators import kernels

BIG = 3_500_000_000


@pytest.mark.parametrize(
    ("xs", "known"),
    [
        ([5], False), ([50_000] * 6, True), ([1, 2, 4], True), ([BIG, 7_000_000_000, 5_250_000_001], True), ([-3, 0, 9, -9], True), ([10**12, 10**12 + 10**7] * 50, True),
        ([123_456_789, 123_456_790, 123_456_791], False), ([10**9, 10**9, 10**9 + 1], False),  # below the floor of doubles of their size
        ([BIG + 2 * k for k in range(5)], False), ([BIG] * 4, False), ([2_500_000_000 + k for k in (0, 3, 5, 9)], False), ([10**9 + 2000 * k for k in range(5)], True),
    ],
)
def test_sample_std_is_exact_or_null(spark, xs, known):
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    big = F.col("x").cast("decimal(38,0)")
    got = df.agg(kernels.sample_std(F.count("x"), F.sum("x"), F.sum(big * big)).alias("s")).first().s
    if not known:
        assert got is None
    else:
        assert got == pytest.approx(statistics.stdev(xs), rel=1e-12)


def test_over_items_equals_pairs(spark):
    """Windows over another table's rows against all pairs: block edges, ties, empty windows, negative times, a hot key."""
    import random

    rng = random.Random(6)
    for width in (0, 1, 7, 40):
        q = [(n, rng.choice("aab"), rng.randrange(-60, 200)) for n in range(150)] + [(900, "z", 5), (901, "a", 40), (902, "a", 41)]
        i = [(rng.choice("aaab"), rng.randrange(-60, 240), rng.randrange(50)) for _ in range(130)]
        qs, it = spark.createDataFrame(q, "id long, k string, ts_us long"), spark.createDataFrame(i, "k string, ts_us long, v long")
        values = {"lo": (F.struct("v", "ts_us"), "min"), "total": (F.col("v"), "sum"), "last": (F.col("ts_us"), "max")}
        got = {r.id: (tuple(r.lo) if r.lo else None, r.total, r.last) for r in kernels.over_items(qs, it, ["k"], F.col("ts_us"), width, values).collect()}
        for n, k, t in q:
            w = [(v, x) for kk, x, v in i if kk == k and t <= x <= t + width]
            assert got[n] == ((min(w), sum(v for v, _ in w), max(x for _, x in w)) if w else (None, None, None))


def test_windows_in_one_pass_equal_digits(spark):
    """Minima, maxima and quantiles from one pass against those found digit by digit: ties that cross batches, nulls, two keys."""
    import random

    from paygrove.operators import orders

    rng = random.Random(8)
    rows = [(n, "hub" if n % 2 else f"k{n % 5}", n % 3, rng.randrange(60) * 10, rng.choice([None, -5, 0, 7, rng.randrange(10**6)])) for n in range(700)]
    df = spark.createDataFrame(rows, "id long, k string, side long, t long, v long")
    targets = {"lo": (F.col("v"), 0.0, 100), "hi": (F.col("v"), 1.0, 30), "med": (F.col("v"), 0.5, 100), "q9": (F.col("v"), 0.9, 10_000)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for keys in (["k"], ["k", "side"]):
            got = kernels.window_orders(df, keys, targets, "t")
            assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, orders.sliding(df, keys, targets, "t").collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert kernels.window_orders(df.limit(0), ["k"], targets, "t").count() == 0


def test_values_in_buckets_stay_in_order(monkeypatch):
    import random

    from paygrove.operators import orders

    monkeypatch.setattr(orders._Values, "BUCKET", 4)
    rng, got, want = random.Random(2), orders._Values(), []
    for _ in range(500):
        if want and rng.random() < 0.45:
            v = rng.choice(want)
            want.remove(v)
            got.drop(v)
        else:
            v = rng.randrange(30)
            want.append(v)
            got.add(v)
        assert [got.nth(i) for i in range(len(want))] == sorted(want)


def test_grown_windows_equal_swept_ones_without_more_rows(spark):
    """Sums and distinct counts of trailing windows as differences of growing sums, against the sweep."""
    import random

    rng = random.Random(4)
    rows = [(n, rng.choice("aab"), rng.randrange(80), rng.choice([None, 0, -3, 10**12]), rng.choice("xyz")) for n in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, ts_us long, v long, peer string")
    swept = kernels.leaves_distinct(df, ["k"], "peer", 9, "e", order=("id",))
    want = kernels.sweep(swept, ["k"], {"s": (F.col("v"), kernels.leaves_after(7)), "d": (F.lit(1).cast("long"), F.col("e"))}).select("id", "s", "d")
    a, z = kernels.first_and_last(df, ["k"], "peer", 9, order=("id",))
    grown = kernels.grown(df.withColumns({"a": a, "z": z}), ["k"], {"s": (F.col("v"), F.col("v"), 8), "d": (F.col("a"), F.col("z"), 9)})
    assert sorted(map(tuple, grown.select("id", "s", "d").collect())) == sorted(map(tuple, want.collect()))
    assert "Generate" not in grown._jdf.queryExecution().executedPlan().toString()


def test_items_are_read_by_frames_that_grow(spark):
    """A frame that ends with its block is summed anew for each row, the square of a busy block."""
    qs = spark.createDataFrame([("a", 5)], "k string, ts_us long")
    got = kernels.over_items(qs, qs, ["k"], F.col("ts_us"), 3, {"n": (F.col("ts_us"), "sum")})
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()
