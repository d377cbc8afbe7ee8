"""Registered queries against their SQL on the smallest tables, and plan properties."""

import pytest

import __spark_entry__ as entry
from paygrove.operators import registry
from paygrove.operators.features import ROW_COLUMNS, check_hash
from paygrove.plans import catalog
from tools import verify

SF = "/root/testdata/sf0.001"
SOME = [
    "features_temporal", "graph_nodes", "rule_r1", "rule_r6", "canonical_a_quarantine", "fold_audit", "alert_queue", "run_list",
]


@pytest.fixture(scope="module")
def con():
    return verify.connect(SF)


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, con, name):
    assert verify.compare(name, spark, con, catalog.QUERIES[name], catalog.ORACLE[name], SF).startswith("ok")


def test_contract(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registry():
    assert len({f.name for f in registry.FEATURES}) == len(registry.FEATURES) >= 96
    with pytest.raises(registry.RegistryError):
        registry.check([registry.Feature("x", "g", "sum", "label_is_fraud")], ROW_COLUMNS, {"always"})
    with pytest.raises(registry.RegistryError):
        registry.check([registry.Feature("x", "g", "nonsense")], ROW_COLUMNS, {"always"})
    with pytest.raises(registry.RegistryError):
        registry.check([registry.Feature("x", "g", "difference", "y", args=("x",)), registry.Feature("y", "g", "difference", "x", args=("x",))], ROW_COLUMNS, {"always"})
    with pytest.raises(ValueError):
        check_hash("other", registry.FEATURES)


def test_sweep_equals_sliding(spark):
    """Running totals of what comes and goes are the sums of RANGE frames."""
    from pyspark.sql import functions as F

    from paygrove.operators import entity, kernels

    d = entity.explode_entities(pay_events_of(spark)).select("txn_id", "sign", "entity", "ts_us", "amount_minor")
    got = kernels.sweep(d, ["entity"], {"s": (F.col("amount_minor"), kernels.leaves_after(DAY))}).select("txn_id", "sign", "s")
    want = d.select("txn_id", "sign", F.sum("amount_minor").over(kernels.trailing(["entity"], DAY)).alias("s"))
    a, b = sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))
    assert a == b and len(a) == d.count()


DAY = 86_400_000_000


def pay_events_of(spark):
    from paygrove.plans.tables import pay_events

    return pay_events(spark, SF)


def test_busy_account_is_dealt_by_time(spark):
    """One account on half of all sides: every declared feature is as without cells, in cells of 16 rows."""
    from pyspark.sql import functions as F

    from paygrove.operators import entity, features, spans

    e = pay_events_of(spark).withColumn("account_from", F.when(F.col("event_id") % 2 == 0, "HUB").otherwise(F.col("account_from")))
    e = e.withColumn("ts_us", F.when(F.col("event_id") % 10 == 0, F.col("ts_us") - F.col("ts_us") % (6 * 3_600_000_000)).otherwise(F.col("ts_us"))).cache()
    d = entity.explode_entities(e)
    cells = spans.cells(d, "entity", rows=16)
    sizes = [r.n for r in cells.place(d.filter("entity = 'HUB'")).groupBy(spans.CELL).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 20 and max(sizes) <= 60 and sum(sizes) == d.filter("entity = 'HUB'").count()
    assert spans.cells(d, "entity", rows=100_000) is None
    fs = [f for f in registry.FEATURES if f.kind not in ("graph", "rule") and f.name not in ("downstream_outflow_24h_minor",)]
    fs = [f for f in fs if not any(n not in {x.name for x in fs} and n in {x.name for x in registry.FEATURES} for n in f.needs)]
    a, b = (sorted(map(str, features.build(e, fs, busy=n).collect())) for n in (16, 100_000))
    assert len(a) == 2 * e.count() and a == b


def test_order_statistics_equal_plain(spark):
    """Lower quantiles against sorted windows, with ties in time and value, negative and wide values, nulls, busy keys."""
    import random

    from pyspark.sql import functions as F

    from paygrove.operators import orders, spans

    rng = random.Random(3)
    rows = [("hub" if n % 2 else f"k{n % 7}", rng.randrange(3000), rng.choice([None, -5, 0, 7, 7, rng.randrange(-(10**4), 10**4), rng.randrange(10**13)])) for n in range(900)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "id long, k string, t long, v long")
    targets = {"lo": (F.col("v"), 0.0, 100), "hi": (F.col("v"), 1.0, 700), "med": (F.col("v"), 0.5, 100), "q9": (F.col("v"), 0.9, 1500), "odd": (F.when(F.abs("v") % 2 == 1, F.col("v")), 0.5, 300)}
    want = {}
    for n, (k, t, _) in enumerate(rows):
        for name, (_, q, width) in targets.items():
            w = sorted(v for kk, tt, v in rows if kk == k and t - width < tt <= t and v is not None and (name != "odd" or abs(v) % 2 == 1))
            want[n, name] = w[int(q * (len(w) - 1))] if w else None
    for cells in (None, spans.cells(df, "k", "t", rows=16, slot_us=20)):
        got = orders.sliding(df, ["k"], targets, "t", cells).collect()
        assert len(got) == len(rows) and got[0].__fields__ == ["id", "k", "t", "v", *targets]
        assert {(r.id, n): r[n] for r in got for n in targets} == want
    assert orders.sliding(df.limit(0), ["k"], targets, "t").count() == 0


def test_no_future_in_features(spark):
    """Truncating the table at an instant doesn't change any feature before it."""
    from paygrove.operators import features
    from paygrove.plans.q_features import _needed
    from paygrove.plans.tables import pay_events

    e, fs = pay_events(spark, SF), _needed("temporal")
    cut = 1_705_276_800_000_000
    a = {tuple(r) for r in features.build(e, fs).filter(f"ts_us <= {cut}").collect()}
    b = {tuple(r) for r in features.build(e.filter(f"ts_us <= {cut}"), fs).collect()}
    assert a == b and a


def test_pushdown(spark):
    from paygrove.plans.tables import pay_events

    spark.catalog.clearCache()  # a table that another test has cached would stand in for the scan
    plan = pay_events(spark, SF).select("amount_minor").filter("amount_minor > 5")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<value:double>" in plan


def test_draws_are_registered_whole(spark, monkeypatch):
    from paygrove.operators import evaluate
    from paygrove.plans import q_evaluate

    seen = {}
    d = spark.createDataFrame([("a", 1, 5, 0.5, "USD")], "account_key string, total long, outflow_minor long, score double, currency string")
    monkeypatch.setattr(q_evaluate, "scored", lambda *a: d)
    monkeypatch.setattr(evaluate, "bootstrap_ap", lambda df, reps=1000: seen.update(reps=reps))
    monkeypatch.setattr(evaluate, "residual_tail", lambda df, draws=10_000: seen.update(draws=draws))
    q_evaluate.QUERIES["bootstrap_interval"](spark, "")
    q_evaluate.QUERIES["residual_tail"](spark, "")
    assert seen == {"reps": 1000, "draws": 10_000}
