"""Canonical payment tables from the given tables, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Hours that the deployment's zone is ahead of UTC.
ZONE_HOURS = 3
HOUR, DAY = 3_600_000_000, 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts) -> F.Column:
    """Microseconds since 1970 of a zone-less or UTC timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def _clock(df: DataFrame) -> DataFrame:
    local = F.timestamp_micros(F.col("ts_us") + ZONE_HOURS * HOUR)
    return df.withColumn("event_date_local", F.to_date(local)).withColumn("local_hour", F.hour(local))


def pay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events from ``events``: users pay the account named in ``props``."""
    return as_payments(table(spark, sf_dir, "events"))


def pay_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of files; a pattern, since the path of a single file isn't one of a source."""
    path = f"{sf_dir}/events.parque[t]"
    return as_payments(spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(path))


def as_payments(e: DataFrame) -> DataFrame:
    d = e.select(
        F.concat(F.lit("ev:"), F.col("event_id")).alias("txn_id"), "event_id", micros(F.col("ts")).alias("ts_us"),
        F.col("event_type").alias("txn_type"), F.lit("app").alias("channel"), F.lit("UGX").alias("currency"),
        F.round(F.col("value") * 100).cast("long").alias("amount_minor"),
        F.concat(F.lit("A"), F.col("user_id")).alias("account_from"),
        F.concat(F.lit("A"), F.get_json_object("props", "$.k")).alias("account_to"),
        F.lit("events").alias("source_dataset"),
    )
    src, dst = (F.col("event_id") * 7919) % 50000, (F.col("event_id") * 104729) % 50000
    d = _clock(d).withColumns({
        "src_balance_before_minor": src, "src_balance_after_minor": F.greatest(src - F.col("amount_minor"), F.lit(0)),
        "dst_balance_before_minor": dst,
        "dst_balance_after_minor": dst + F.col("amount_minor") + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0),
        "label_is_fraud": ((F.col("event_id") * 7621 + 13) % 1000 < 30).cast("int"),
        "label_is_flagged": ((F.col("event_id") * 7621 + 13) % 1000 < 5).cast("int"),
    })
    return d


EV = f"""
ev AS (
  SELECT 'ev:' || event_id AS txn_id, event_id, epoch_us(ts) AS ts_us, event_type AS txn_type, 'app' AS channel, 'UGX' AS currency,
         CAST(round(value * 100) AS BIGINT) AS amount_minor, 'A' || user_id AS account_from,
         'A' || json_extract_string(props, '$.k') AS account_to, 'events' AS source_dataset,
         CAST(ts + INTERVAL {ZONE_HOURS} HOUR AS DATE) AS event_date_local, CAST(hour(ts + INTERVAL {ZONE_HOURS} HOUR) AS INT) AS local_hour,
         (event_id * 7919) % 50000 AS src_balance_before_minor,
         greatest((event_id * 7919) % 50000 - CAST(round(value * 100) AS BIGINT), 0) AS src_balance_after_minor,
         (event_id * 104729) % 50000 AS dst_balance_before_minor,
         (event_id * 104729) % 50000 + CAST(round(value * 100) AS BIGINT) + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS dst_balance_after_minor,
         CAST((event_id * 7621 + 13) % 1000 < 30 AS INT) AS label_is_fraud, CAST((event_id * 7621 + 13) % 1000 < 5 AS INT) AS label_is_flagged
  FROM events)"""


def pay_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events from ``lineitem``: customers pay suppliers, over seven years.

    The day comes from the ship date and the time of day from the digest that names the
    row. Equal rows get numbers, so ids are unique; a row's key begins with its order, by
    which the join has dealt the rows already.
    """
    return _payments(table(spark, sf_dir, "lineitem"), spark, sf_dir)


def lineitem_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``pay_lineitem`` on the first and the last day, between which all others lie.

    A payment comes less than a day after its ship date, and equal rows share theirs.
    Lines without an order pay nothing, so they don't say where the days end.
    """
    li = table(spark, sf_dir, "lineitem")
    at = F.col("l_shipdate").cast("timestamp")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    t = li.join(o, "l_orderkey", "left_semi").agg(F.unix_micros(F.min(at)).alias("a"), F.unix_micros(F.max(at)).alias("z")).first()
    if t.a is None:
        return _payments(li.limit(0), spark, sf_dir)
    us = micros(F.col("l_shipdate"))
    return _payments(li.filter((us < t.a + DAY) | (us > t.z - DAY)), spark, sf_dir)


def _payments(li: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents("l_extendedprice"), cents("l_quantity"), cents("l_discount"), cents("l_tax"), "l_returnflag", "l_linestatus", micros(F.col("l_shipdate")))
    d = li.join(o, li["l_orderkey"] == o["o_orderkey"]).drop("o_orderkey").withColumn("row_key", key)
    d = d.withColumn("nth", F.row_number().over(Window.partitionBy("l_orderkey", "row_key").orderBy("o_custkey")))
    digest = F.sha2(F.concat_ws("|", "row_key", "nth"), 256)
    d = d.withColumn("digest", digest).withColumn("offset_us", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % F.lit(DAY))
    d = d.select(
        F.concat(F.lit("li:"), F.substring("digest", 1, 24)).alias("txn_id"), (micros(F.col("l_shipdate")) + F.col("offset_us")).alias("ts_us"),
        F.col("l_returnflag").alias("txn_type"), F.col("l_linestatus").alias("channel"), F.lit("USD").alias("currency"),
        cents("l_extendedprice").alias("amount_minor"), F.concat(F.lit("C"), "o_custkey").alias("account_from"),
        F.concat(F.lit("S"), "l_suppkey").alias("account_to"), F.lit("lineitem").alias("source_dataset"), "l_discount", "l_quantity", "l_tax",
        (F.conv(F.substring("digest", 9, 8), 16, 10).cast("long") % 1000 < F.when(cents("l_discount") >= 8, 80).otherwise(20)).cast("int").alias("label_is_fraud"),
    )
    return _clock(d)


LI = f"""
li0 AS (
  SELECT l.*, o.o_custkey, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT),
    CAST(round(l_quantity * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT),
    l_returnflag, l_linestatus, epoch_us(l_shipdate)) AS row_key
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
li1 AS (SELECT *, sha256(row_key || '|' || row_number() OVER (PARTITION BY row_key ORDER BY o_custkey)) AS digest FROM li0),
li AS (
  SELECT 'li:' || substr(digest, 1, 24) AS txn_id,
         epoch_us(l_shipdate) + ('0x' || substr(digest, 1, 8))::BIGINT % {DAY} AS ts_us, l_returnflag AS txn_type, l_linestatus AS channel,
         'USD' AS currency, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_minor, 'C' || o_custkey AS account_from,
         'S' || l_suppkey AS account_to, 'lineitem' AS source_dataset, l_discount, l_quantity, l_tax,
         CAST(('0x' || substr(digest, 9, 8))::BIGINT % 1000 < CASE WHEN CAST(round(l_discount * 100) AS BIGINT) >= 8 THEN 80 ELSE 20 END AS INT) AS label_is_fraud
  FROM li1)"""
