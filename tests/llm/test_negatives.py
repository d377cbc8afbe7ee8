import math
import random

import numpy as np

from paygrove.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, rows string"


def plain_mine(rows, every=50):
    kept = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        q = [math.floor(256 * float(np.float32(c))) for c in v]
        kept[i] = min(kept[i], (y, q)) if i in kept else (y, q)
    out = []
    for i, (y, q) in kept.items():
        if i % every:
            continue
        dot = lambda r: sum(a * b for a, b in zip(q, r, strict=False))  # noqa: E731, B023
        scored = sorted((-dot(r), j, z) for j, (z, r) in kept.items())
        for ps, p in [(-s, j) for s, j, z in scored if z == y and j != i][:5]:
            hard = [(j, -s) for s, j, z in scored if z != y and 50 * ps <= -100 * s <= 95 * ps][:3]
            out += [(i, p, n + 1, j, ps, s) for n, (j, s) in enumerate(hard)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "y") for i, v, y in rows], SCHEMA)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def rows_of(n, dims, seed, labels=4):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.2, 0.5) for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


def test_tree_boxes_hold_their_rows():
    rng = np.random.default_rng(1)
    v = rng.integers(-300, 300, (3000, 6))
    t = negatives.Tree(np.arange(3000), np.zeros(3000, int), v)
    assert sorted(t.ids) == list(range(3000))
    for (a, z), kids, low, high in zip(t.span, t.kids, t.low, t.high, strict=True):
        assert (t.vectors[a:z] >= low).all() and (t.vectors[a:z] <= high).all()
        if kids:
            assert len(kids) <= negatives.FAN and t.span[kids[0]][0] == a and t.span[kids[-1]][1] == z
        else:
            assert z - a <= negatives.LEAF


def test_mine_equals_plain(spark):
    rows = rows_of(900, 5, 3)
    for tile, block in ((100, 3), (4096, 512)):
        assert got(negatives.mine(table(spark, rows), tile=tile, block=block)) == plain_mine(rows)


def test_mine_ties_nulls_repeats(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)], rng.randrange(2)) for i in range(400)]  # mostly ties
    rows += [(i, [0.5, 0.5, 0.5], 1) for i in range(400, 900)]  # one hot vector
    rows += [(None, [1.0, 1.0, 1.0], 0), (950, None, 1), (1000, [1.0, None, 1.0], 1), (1001, [float("nan"), 1.0, 1.0], 1), (1002, [1.0, float("inf"), 1.0], 0), (1050, [1.0, 1.0, 1.0], None)]
    rows += [(100, [0.25, 0.0, 1.0], 0), rows[50], rows[51], (1100, [], 1), (1150, [-1.0, -1.0, -1.0], 0), (1151, [1.0, 0.5], 0)]
    assert got(negatives.mine(table(spark, rows), tile=64, block=4)) == plain_mine(rows)


def test_mine_large_numbers_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(0, 4.0e5) for _ in range(3)], i % 3) for i in range(120)]
    assert got(negatives.mine(table(spark, rows))) == plain_mine(rows)


def test_mine_empty_and_single_label(spark):
    assert negatives.mine(table(spark, [])).count() == 0
    assert negatives.mine(table(spark, [(i, [1.0, float(i)], 1) for i in range(60)])).count() == 0


def test_tiles_are_read_a_few_at_a_time(spark, monkeypatch):
    """A reader takes a file's rows as one batch, so a file holds few tiles, each as one binary and not as lists in lists."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(negatives, "FILE", 3 * 8 * 64 * (5 + 2))
    x = negatives.quantised(table(spark, rows_of(2000, 5, 4)))
    t = negatives.pack(x, tile=64)
    assert dict(t.dtypes)["rows"] == "binary"
    held = [pq.ParquetFile(f).metadata.num_rows for d in {f.rsplit("/", 1)[0][5:] for f in t.inputFiles()} for f in glob.glob(f"{d.lstrip(':')}/*.parquet")]
    assert max(held) <= 3 and sum(held) == t.count()
    got_ids = [i for r in t.select("rows").toArrow()["rows"].combine_chunks() for i in negatives._unpack(negatives._read([r], 0))[0]]
    assert sorted(got_ids) == list(range(2000))
