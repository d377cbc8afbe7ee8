import pytest
from pyspark.sql import functions as F

from paygrove.operators import features, folds, kernels, leakage
from paygrove.operators.entity import explode_entities
from paygrove.plans.q_features import GROUPS, _needed
from paygrove.plans.tables import pay_events

SF = "/root/testdata/sf0.001"
CUTS = [1_704_700_000_000_000, 1_705_276_800_000_000]
KEYS = ["txn_id", "sign"]


def test_every_group_is_clean(spark):
    e = pay_events(spark, SF).cache()
    fs = list({f.name: f for g in GROUPS for f in _needed(g)}.values())
    cols = [f.name for f in fs if f.name not in ("counterparty",)]
    found = leakage.refuse(leakage.compare(lambda x: features.build(x, fs), e, CUTS[:1], KEYS, cols)).collect()
    assert len(found) == len(cols) and all(r.n > 0 for r in found)


def test_planted_leaks_are_named(spark):
    e = pay_events(spark, SF).cache()

    def build(x):
        d = explode_entities(x).select("txn_id", "sign", "ts_us", "entity", "amount_minor")
        d = d.withColumn("next_day", kernels.forward_sum(F.col("amount_minor"), ["entity"], folds.DAY)).withColumn("clean", F.col("amount_minor") * 2)
        return d.withColumn("nothing", F.lit(None).cast("long")).filter("amount_minor > 0 or ts_us < 0")

    found = {(r.cutoff_us, r.column): r for r in leakage.compare(build, e, CUTS, KEYS, ["next_day", "clean", "nothing"]).collect()}
    assert all(found[c, "next_day"].changed > 0 and found[c, "clean"].changed == found[c, "nothing"].changed == 0 for c in CUTS)
    with pytest.raises(leakage.LeakError, match="next_day at"):
        leakage.refuse(leakage.compare(build, e, CUTS, KEYS, ["next_day", "clean"]))


def test_rows_that_come_and_go(spark):
    """A build that drops rows by what comes later shows as missing rows."""
    df = spark.createDataFrame([(k, k) for k in range(10)], "id long, ts_us long")
    build = lambda x: x.join(x.agg(F.max("id").alias("m"))).filter("id < m").select("id", "ts_us", F.lit(1).alias("one"))
    r = leakage.compare(build, df, [5], ["id"]).first()
    assert (r.n, r.changed, r.missing) == (6, 0, 1)
