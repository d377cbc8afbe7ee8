import hashlib
import hmac

from pyspark.sql import functions as F

from paygrove.functions import keys, money
from paygrove.operators import canonical
from paygrove.plans import q_canonical as q
from paygrove.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def test_round_trip(spark, tmp_path):
    q.raw_a(spark, SF).drop("row_index").select(*canonical.RAW_A).write.option("header", True).csv(f"{tmp_path}/a")
    raw = readers.source_a(spark, f"{tmp_path}/a").withColumn("row_index", F.monotonically_increasing_id())
    events, bad = canonical.canonical_a(raw, "b1", b"salt", q.EPOCH)
    sinks.write_events(events, f"{tmp_path}/events")
    sinks.write_quarantine(bad, f"{tmp_path}/bad")
    assert sinks.register_views(spark, f"{tmp_path}/events").first().n == readers.landed(spark, f"{tmp_path}/events").count() == events.count() > 0
    assert spark.table("events_source_a").count() == events.count()
    assert spark.read.parquet(f"{tmp_path}/bad").count() == bad.count() > 0
    assert all(v == 0 for v in canonical.checks(events).first())


def test_positions_and_ordinals(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Timestamp,From Bank,Account,To Bank,Account,R,RC,P,PC,F,L\n" + "".join(f"2024/01/0{k} 10:00,1,a{k},2,b{k},1.00,Euro,1.00,Euro,Wire,0\n" for k in range(1, 8)))
    d = readers.source_b(spark, f"{tmp_path}/b.csv")
    assert [(r.ordinal, r.from_account, r.to_account) for r in d.orderBy("ordinal").collect()] == [(k - 1, f"a{k}", f"b{k}") for k in range(1, 8)]
    events, bad = canonical.canonical_b(d, "b", b"salt")
    assert events.count() == 7 and bad.count() == 0 and events.first().amount_minor == 100
    assert canonical.structural(d.drop("ts"), canonical.RAW_B, "b", "source_b").count() == 1


def test_hmac(spark):
    df = spark.createDataFrame([("C1",), ("Ünï",), ("",)], "n string")
    for secret in (b"salt", b"x" * 100):
        for r in df.select("n", keys.hmac_sha256(secret, F.col("n")).alias("h")).collect():
            assert r.h == hmac.new(secret, r.n.encode(), hashlib.sha256).hexdigest()


def test_annotations(spark, tmp_path):
    (tmp_path / "t.txt").write_text("BEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 3\na,1\nb,2\nEND LAUNDERING ATTEMPT - FAN-OUT\n\nBEGIN LAUNDERING ATTEMPT - CYCLE\nc,3\nEND LAUNDERING ATTEMPT - CYCLE\n")
    r = canonical.annotations(readers.annotation_lines(spark, f"{tmp_path}/t.txt")).orderBy("n").collect()
    assert [(x.typology, x.line, x.attempt_description) for x in r] == [("fan-out", "a,1", "Max 3"), ("fan-out", "b,2", "Max 3"), ("cycle", "c,3", "")]


def test_money(spark):
    df = spark.createDataFrame([(7, 500_000), (5, 100_000), (-5, 100_000), (3, 500_000)], "m long, r long")
    assert [x[0] for x in df.select(money.scaled(F.col("m"), F.col("r"))).collect()] == [4, 1, 0, 2]


def test_watchlist(spark, tmp_path):
    (tmp_path / "w.csv").write_text("reference,name,alt_names,country,dob,remarks\nr1,José Núñez,Joe N;J. Nunez,XX,,\n")
    from paygrove.operators import screening

    w = readers.watchlist(spark, f"{tmp_path}/w.csv")
    assert w.count() == 3
    hits = screening.screen(spark.createDataFrame([("q1", "jose nunez"), ("q2", "Nunez Jose Maria"), ("q3", "other")], "query_id string, name string"), w).collect()
    assert {(h.query_id, h.method) for h in hits if h["rank"] == 1} == {("q1", "equal"), ("q2", "subset")}
