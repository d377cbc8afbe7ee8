"""Landing: a part replaces itself, repeated batches change nothing, unfinished parts aren't read."""

import os

import pytest

from paygrove.operators import landing


def held(spark, root, **kw):
    return sorted((r.run_id, r.part, r.a) for r in landing.landed(spark, root, "t", **kw).collect())


def test_a_part_replaces_itself(spark, tmp_path):
    root, of = str(tmp_path), lambda *a: spark.createDataFrame([(x,) for x in a], "a long")
    landing.land(of(1, 2), root, "t", "2024")
    landing.land(of(3), root, "t", "r2", "007")
    once = held(spark, root)
    landing.land(of(1, 2), root, "t", "2024")
    assert held(spark, root) == once == [("2024", "all", 1), ("2024", "all", 2), ("r2", "007", 3)]
    landing.land(of(), root, "t", "2024")
    assert held(spark, root) == held(spark, root, run_id="r2") == [("r2", "007", 3)]
    assert held(spark, root, run_id="2024") == []
    os.remove(f"{root}/t/run_id=r2/part=007/_SUCCESS")
    with pytest.raises(landing.LandingError):
        landing.landed(spark, root, "t", "r2")
    for bad in ("", "a/b", "..", "_x", "a=b"):
        with pytest.raises(landing.LandingError):
            landing.land(of(1), root, "t", bad)


def test_a_batch_that_comes_again_lands_once(spark, tmp_path):
    """The checkpoint forgets its last commit, as after a failure between landing and commit: the batch is run again."""
    raw, root, state = (f"{tmp_path}/{x}" for x in ("raw", "out", "state"))

    def run():
        stream = spark.readStream.schema("a long").option("maxFilesPerTrigger", 1).parquet(raw)
        q = stream.writeStream.foreachBatch(landing.sink(root, "t", "r1")).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()

    for k in range(3):
        spark.range(k * 10, k * 10 + 10).toDF("a").coalesce(1).write.mode("append").parquet(raw)
    run()
    first = held(spark, root)
    assert sorted(a for *_, a in first) == list(range(30)) and len({p for _, p, _ in first}) == 3
    last = max((f for f in os.listdir(f"{state}/commits") if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        if os.path.exists(f"{state}/commits/{f}"):
            os.remove(f"{state}/commits/{f}")
    run()
    assert held(spark, root) == first
