import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from paygrove.operators import graph
from paygrove.plans.tables import pay_events
from paygrove.streaming import jobs

LEGS = "account string, currency string, side string, ts_us long, txn_id string, txn_type string, amount_minor long"
SF = "/root/testdata/sf0.001"


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_alerts_equal_batch_in_any_order(spark, tmp_path):
    """Three batches, rows within the watermark out of order; a last row moves the watermark past all of them."""
    legs = graph.legs(pay_events(spark, SF)).filter("not is_self").select("account", "currency", "side", "ts_us", "txn_id", "amount_minor")
    first, last = legs.agg(F.min("ts_us"), F.max("ts_us")).first()
    far = spark.createDataFrame([("nobody", "UGX", "in", last + 10**13, "zz", 1)], legs.schema)
    third = (last - first) // 3
    # a row comes in the batch of its time, or one later
    late = F.floor((F.col("ts_us") - first) / F.lit(third + 1)) + (F.xxhash64("txn_id") % 2 == 0).cast("int")
    for k, part in enumerate([*(legs.filter(late == k) for k in range(5)), far]):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/legs")
    stream = spark.readStream.schema(legs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/legs")
    kw = {"width_us": 6 * 3_600_000_000, "least_minor": 100}
    got = [tuple(r) for r in drain(jobs.pass_through(stream, lateness="30 days", **kw), "alerts").collect()]
    want = [tuple(r) for r in jobs.pass_through_batch(legs, **kw).collect()]
    assert sorted(got) == sorted(want) and want


def test_cash_outs_equal_batch_in_any_order(spark, tmp_path):
    """Rule R10 as a stream: rows in two orders within the watermark give the batch's alerts, and leave no state behind."""
    legs = graph.legs(pay_events(spark, SF)).filter("not is_self").select("account", "currency", "side", "ts_us", "txn_id", "txn_type", "amount_minor")
    first, last = legs.agg(F.min("ts_us"), F.max("ts_us")).first()
    far = spark.createDataFrame([("nobody", "UGX", "in", last + 10**13, "zz", "click", 1), (None, None, "out", None, None, None, None)], LEGS)
    third = (last - first) // 3
    kw = {"share_micro": 500_000, "width_us": 12 * 3_600_000_000, "cash_out": ("purchase", "click")}
    want = sorted(map(tuple, jobs.fast_cash_out_batch(legs, **kw).collect()))
    for turn in (0, 1):
        late = F.floor((F.col("ts_us") - first) / F.lit(third + 1)) + (F.xxhash64("txn_id") % 2 == turn).cast("int")
        for k, part in enumerate([*(legs.filter(late == k).orderBy(F.xxhash64("txn_id", F.lit(turn))) for k in range(5)), far]):
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/legs{turn}")
        stream = spark.readStream.schema(LEGS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/legs{turn}")
        df = jobs.fast_cash_out(stream, lateness="30 days", **kw)
        q = df.writeStream.outputMode("append").format("memory").queryName(f"cashed{turn}").start()
        q.processAllAvailable()
        rows = q.lastProgress.stateOperators[0].numRowsTotal
        q.stop()
        assert sorted(map(tuple, spark.table(f"cashed{turn}").collect())) == want and want
        assert rows < 10  # only the row that moved the watermark is waiting


def test_cash_outs_of_a_key_equal_pairs():
    """Windows by running sums against all pairs: ties in time, both edges, no cash-out at all."""
    rng = np.random.default_rng(5)
    for n in (0, 1, 40):
        i, o = (pd.DataFrame({"ts_us": rng.integers(0, 60, m), "txn_id": [f"{s}{k}" for k in range(m)], "amount_minor": rng.integers(1, 50, m)}) for s, m in (("i", 25), ("o", n)))
        got = {r.inflow_id: (r.cashed_minor, r.last_out_us) for r in jobs.cashed_out(i, o, 900_000, 10).itertuples()}
        want = {}
        for r in i.itertuples():
            w = o[(o.ts_us >= r.ts_us) & (o.ts_us <= r.ts_us + 10)]
            if len(w) and w.amount_minor.sum() * 10 >= r.amount_minor * 9:
                want[r.txn_id] = (w.amount_minor.sum(), w.ts_us.max())
        assert got == want


def test_ingest_drops_repeats(spark, tmp_path):
    e = pay_events(spark, SF).select("txn_id", "ts_us", "source_dataset")
    e.union(e.limit(50)).write.parquet(f"{tmp_path}/e")
    got = drain(jobs.ingest(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e")), "ingested")
    assert got.count() == e.count() and got.select("txn_id").distinct().count() == e.count()


def test_late_counts(spark):
    e = pay_events(spark, SF).withColumn("ingested_us", F.col("ts_us") + 1)
    r = jobs.late_counts(e, e.agg(F.max("ts_us")).first()[0]).first()
    assert r.rows == e.count() and r.late == 1


def test_cash_outs_start_in_any_session(spark):
    """A session made without ``get_spark`` keeps state in a store without lists; the stream brings its own and leaves the setting as it was."""
    from paygrove.plans.q_streams import CASHING, cash_outs
    from paygrove.session import STATE_STORE

    plain = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(STATE_STORE[0], plain)
    try:
        got = cash_outs(spark, SF).drop("share")
        assert spark.conf.get(STATE_STORE[0]) == plain
    finally:
        spark.conf.set(STATE_STORE[0], before)
    e = pay_events(spark, SF).filter("account_from <> account_to and txn_type <> 'error'")
    want = jobs.fast_cash_out_batch(graph.legs(e), cash_out=CASHING).drop("share")
    sure = (e.agg(F.max("ts_us")).first()[0] // 1000 - 3_600_000) * 1000 - 86_400_000_000
    settled = want.filter((F.floor(F.col("inflow_us") / 60_000_000) + 1) * 60_000_000 <= sure)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, settled.collect())) and not settled.isEmpty()


def test_processor_needs_no_path(tmp_path):
    """What a stream's worker unpickles loads where the library can't be imported."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "p").write_bytes(cloudpickle.dumps(jobs.CashOuts(1, 1)))
    say = "import pickle; print(pickle.load(open('p', 'rb')).share_micro)"
    assert subprocess.run([sys.executable, "-c", say], cwd=tmp_path, capture_output=True, text=True).stdout.strip() == "1"
