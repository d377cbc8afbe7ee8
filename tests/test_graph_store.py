import shutil

import pytest
from pyspark.sql import functions as F

from paygrove.operators import graph_store as gs
from paygrove.plans.tables import pay_events

SF = "/root/testdata/sf0.001"


def test_round_trip_tampering_and_shuffles(spark, tmp_path):
    root = f"{tmp_path}/g"
    g = gs.build(pay_events(spark, SF))
    m = gs.save(g, root).collect()
    assert {r.name for r in m} == set(gs.TABLES) and all(r.rows > 0 for r in m)
    back = gs.load(spark, root)
    for name in gs.TABLES:
        assert sorted(map(str, getattr(back, name).collect())) == sorted(map(str, getattr(g, name).collect()))
    assert gs.save(g, root).collect() == m
    # grouping and joining by account reads the buckets as they are
    back = gs.load(spark, root, verify=False)
    plan = back.legs.groupBy("account").agg(F.sum("amount_minor")).join(back.nodes.select("account", "fan_in").hint("merge"), "account")
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    # one changed amount, one table gone, no manifest
    changed = spark.read.parquet(f"{root}/pairs").withColumn("total_minor", F.col("total_minor") + (F.col("n") > 3).cast("int"))
    changed.write.parquet(f"{tmp_path}/changed")
    shutil.move(f"{root}/pairs", f"{tmp_path}/pairs")
    with pytest.raises(gs.GraphStoreError, match="pairs is missing"):
        gs.load(spark, root)
    shutil.copytree(f"{tmp_path}/changed", f"{root}/pairs")
    with pytest.raises(gs.GraphStoreError, match="other rows"):
        gs.load(spark, root)
    shutil.rmtree(f"{root}/{gs.MANIFEST}")
    with pytest.raises(gs.GraphStoreError, match="no manifest"):
        gs.load(spark, root)
