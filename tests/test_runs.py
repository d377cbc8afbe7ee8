import shutil

import pytest
from pyspark.sql import functions as F

from paygrove.operators import canonical
from paygrove.plans import q_canonical as q
from paygrove.sources import runs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    a = q.raw_a(spark, SF).select(*canonical.RAW_A)
    a.filter("step % 2 = 0").write.option("header", True).csv(f"{root}/a-0")
    a.filter("step % 2 = 1").write.option("header", True).csv(f"{root}/a-1")
    return root


A = runs.Declared("mobile", "source_a", (("a-0", "x0"), ("a-1", "x1")))
GONE = runs.Declared("bank", "source_b", (("nothing.csv", "y"),))
NO = runs.Declared("cards", "canonical", (("c.csv", "z"),), "licence unknown")


def rows(df):
    return sorted(map(str, df.collect()))


def test_run_lands_refuses_and_repeats(spark, raw, tmp_path):
    out = f"{tmp_path}/out"
    m = {(r.source_id, r.batch_id): r for r in runs.ingest(spark, str(raw), out, [A, GONE, NO], q.SECRET, q.EPOCH, "r1").collect()}
    assert {r.status for r in m.values() if r.source_id == "mobile"} == {"landed"} and len(m) == 4
    assert next(r for r in m.values() if r.source_id == "bank").status == "failed"
    assert next(r for r in m.values() if r.source_id == "cards").reason == "licence unknown"
    d = runs.landed(spark, out, verify=True)
    assert d.count() == sum(r.rows for r in m.values() if r.rows) > 0 and sum(r.quarantined for r in m.values() if r.rows) > 0
    assert d.select([f.name for f in canonical.CANONICAL]).schema.fieldNames() == canonical.CANONICAL.fieldNames()
    assert all(v == 0 for v in canonical.checks(d.withColumn("ts_us", F.unix_micros("event_ts_utc"))).first())
    before = rows(d)
    again = runs.ingest(spark, str(raw), out, [A, GONE, NO], q.SECRET, q.EPOCH, "r1")
    assert rows(again) == sorted(map(str, m.values())) and rows(runs.landed(spark, out)) == before
    # a second run with the same batch adds nothing
    runs.ingest(spark, str(raw), out, [A], q.SECRET, q.EPOCH, "r2")
    d = runs.landed(spark, out, verify=True)
    assert d.count() == len(before) and [r.run_id for r in d.select("run_id").distinct().collect()] == ["r2"]


def test_root_may_move_and_strangers_are_not_read(spark, raw, tmp_path):
    out, moved = f"{tmp_path}/out", f"{tmp_path}/moved"
    runs.ingest(spark, str(raw), out, [A], q.SECRET, q.EPOCH, "r1")
    n = runs.landed(spark, out).count()
    shutil.move(out, moved)
    batch = runs.batch_id(A, A.files[0])
    shutil.copytree(f"{moved}/events/source_dataset=mobile/batch_id={batch}", f"{moved}/events/source_dataset=mobile/batch_id=stranger")
    assert runs.landed(spark, moved).count() == n


def test_missing_short_and_changed_batches_are_refused(spark, raw, tmp_path):
    out = f"{tmp_path}/out"
    runs.ingest(spark, str(raw), out, [A], q.SECRET, q.EPOCH, "r1")
    batch = f"{out}/events/source_dataset=mobile/batch_id={runs.batch_id(A, A.files[1])}"
    kept = spark.read.parquet(batch).toPandas()
    write = lambda p: spark.createDataFrame(p, spark.read.parquet(batch).schema).write.mode("overwrite").parquet(f"{tmp_path}/x")
    write(kept.head(len(kept) - 1))
    shutil.move(batch, f"{tmp_path}/kept")
    with pytest.raises(runs.ManifestError, match="missing"):
        runs.landed(spark, out)
    shutil.copytree(f"{tmp_path}/x", batch)
    with pytest.raises(runs.ManifestError, match="number of rows"):
        runs.landed(spark, out)
    shutil.rmtree(batch)
    d = spark.read.parquet(f"{tmp_path}/kept")
    d.withColumn("amount_minor", F.col("amount_minor") + 1).write.parquet(batch)
    assert runs.landed(spark, out).count() > 0  # counts agree; only the content differs
    with pytest.raises(runs.ManifestError, match="other content"):
        runs.landed(spark, out, verify=True)
