"""Contract and canonicalisation queries; raw rows are derived from the given tables, bad ones among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paygrove.functions import keys, money, times
from paygrove.operators import canonical as c
from paygrove.plans.tables import EV, HOUR, LI, pay_events, pay_lineitem, table
from paygrove.session import checkpoint, scratch_table

SECRET = b"a salt for tests"
EPOCH = 1_704_067_200_000_000  # 2024-01-01
NOW = 1_767_225_600_000_000  # 2026-01-01


def raw_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` in the shape of source A; every 50th row or so is spoilt, and some come twice."""
    e = table(spark, sf_dir, "events").repartition("event_id").withColumn("m", F.col("event_id") % 50)  # the given file is one partition
    cents = F.round(F.col("value") * 100).cast("long")
    text = money.to_text(cents)
    d = e.select(
        F.col("event_id").alias("row_index"), F.expr("event_id div 100").cast("int").alias("step"),
        F.when(F.col("m") == 1, "GIFT").otherwise(F.element_at(F.array(*[F.lit(t) for t in c.TYPES_A]), (F.col("event_id") % 5 + 1).cast("int"))).alias("type"),
        F.when(F.col("m") == 2, F.concat(F.lit("-"), text)).when(F.col("m") == 3, "12,5").when(F.col("m") == 4, "1.0E3").when(F.col("m") == 5, F.concat(text, F.lit("5"))).otherwise(text).alias("amount"),
        F.concat(F.lit("C"), "user_id").alias("nameOrig"), F.lit("100.00").alias("oldbalanceOrg"), F.lit("50.5").alias("newbalanceOrig"),
        F.when(F.col("m") == 6, F.concat(F.lit("C"), "user_id")).otherwise(F.concat(F.lit("M"), F.get_json_object("props", "$.k"))).alias("nameDest"),
        F.lit("0").alias("oldbalanceDest"), F.lit("1").alias("newbalanceDest"), F.when(F.col("m") == 7, 2).otherwise((F.col("event_id") % 97 == 0).cast("int")).alias("isFraud"), F.lit(0).alias("isFlaggedFraud"),
    )
    # some rows come again as they are, some with another payload
    kinds = F.filter(F.array(F.lit(0), F.when(F.col("row_index") % 40 == 11, 1), F.when(F.col("row_index") % 400 == 13, 2)), lambda x: x.isNotNull())
    d = d.withColumn("again", F.explode(kinds)).withColumn("row_index", F.col("row_index") + F.col("again").cast("long") * 10_000_000_000)
    d = d.withColumn("newbalanceOrig", F.when(F.col("again") == 2, "9.99").otherwise(F.col("newbalanceOrig"))).drop("again")
    return scratch_table(d, "raw-a")  # raw logs are files


_RAW = """
c0 AS (SELECT *, event_id % 50 AS m, CAST(round(value * 100) AS BIGINT) AS cents FROM events), c1 AS (SELECT *, (cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0') AS t FROM c0),
ra AS (SELECT event_id AS row_index, CAST(event_id // 100 AS INT) AS step, CASE WHEN m = 1 THEN 'GIFT' ELSE ['CASH_IN','CASH_OUT','DEBIT','PAYMENT','TRANSFER'][event_id % 5 + 1] END AS type,
  CASE m WHEN 2 THEN '-' || t WHEN 3 THEN '12,5' WHEN 4 THEN '1.0E3' WHEN 5 THEN t || '5' ELSE t END AS amount, 'C' || user_id AS nameOrig, '50.5' AS newbalanceOrig,
  CASE WHEN m = 6 THEN 'C' || user_id ELSE 'M' || json_extract_string(props, '$.k') END AS nameDest, CASE WHEN m = 7 THEN 2 ELSE CAST(event_id % 97 = 0 AS INT) END AS isFraud FROM c1),
rb AS (FROM ra UNION ALL SELECT row_index + 10000000000, * EXCLUDE (row_index) FROM ra WHERE row_index % 40 = 11 UNION ALL SELECT row_index + 20000000000, * EXCLUDE (row_index) REPLACE ('9.99' AS newbalanceOrig) FROM ra WHERE row_index % 400 = 13),
rr AS (SELECT *, CASE WHEN NOT regexp_matches(amount, '^-?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?$') THEN 'amount_format' WHEN type = 'GIFT' THEN 'unknown_type' WHEN isFraud NOT IN (0, 1) THEN 'label_not_binary'
  WHEN amount LIKE '-%' THEN 'negative_amount' WHEN nameOrig = nameDest THEN 'self_transfer' END AS reason FROM rb),
gd AS (SELECT *, count(*) OVER k AS n, count(DISTINCT (newbalanceOrig, isFraud)) OVER k AS p, min(row_index) OVER k AS first FROM rr WHERE reason IS NULL WINDOW k AS (PARTITION BY step, type, amount, nameOrig, nameDest)),
kp AS (SELECT *, sha256(concat_ws('|', step, type, amount, nameOrig, nameDest)) AS digest FROM gd WHERE p = 1 AND row_index = first)"""


def canonical_a(spark, sf_dir):
    e, _ = c.canonical_a(raw_a(spark, sf_dir), "b1", SECRET, EPOCH, zone="UTC")
    return c.check_schema(_as_contract(c.landed(e, "run1", NOW))).select("txn_id", "ts_us", "event_date_local", "local_hour", "txn_type", "amount_minor", "label_is_fraud", "src_balance_after_minor")


def _as_contract(e: DataFrame) -> DataFrame:
    return e.select([f.name for f in c.CANONICAL])


_CAN_A = f"""WITH {_RAW}, x AS (SELECT *, {EPOCH} + step::BIGINT * {HOUR} + ('0x' || substr(digest, 9, 8))::BIGINT % {HOUR} AS ts_us FROM kp)
SELECT 'source_a:' || substr(digest, 1, 24) AS txn_id, ts_us, CAST(make_timestamp(ts_us) AS DATE) AS event_date_local, CAST(hour(make_timestamp(ts_us)) AS INT) AS local_hour, lower(type) AS txn_type,
  CAST(round_even(CAST(CAST(amount AS DECIMAL(20, 4)) * 100 AS DOUBLE), 0) AS BIGINT) AS amount_minor, isFraud AS label_is_fraud, CAST(5050 AS BIGINT) AS src_balance_after_minor FROM x"""


def quarantine_a(spark, sf_dir):
    _, q = c.canonical_a(raw_a(spark, sf_dir), "b1", SECRET, EPOCH)
    return q.select("batch_id", "source_dataset", "row_index", "reason", F.get_json_object("payload_json", "$.amount").alias("amount"))


_QUAR = f"""WITH {_RAW} SELECT 'b1' AS batch_id, 'source_a' AS source_dataset, row_index, reason, amount FROM rr WHERE reason IS NOT NULL
UNION ALL SELECT 'b1', 'source_a', row_index, 'duplicate_conflict', amount FROM gd WHERE p > 1"""


def duplicates(spark, sf_dir):
    good = raw_a(spark, sf_dir).withColumn("reason", c.reason_a()).filter("reason is null")
    ident = ["step", "type", "amount", "nameOrig", "nameDest"]
    return c.split_duplicates(good, ident, [x for x in c.RAW_A if x not in ident], "row_index")[2]


_DUPS = f"WITH {_RAW} SELECT CAST(sum(CASE WHEN p = 1 AND row_index <> first THEN 1 ELSE 0 END) AS BIGINT) AS dropped, CAST(sum(CASE WHEN p > 1 THEN 1 ELSE 0 END) AS BIGINT) AS conflicting FROM gd"


def raw_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` in the shape of source B, all text, a few rows spoilt."""
    li = pay_lineitem(spark, sf_dir)
    h = F.conv(F.substring("txn_id", 4, 8), 16, 10).cast("long")
    m = h % 60
    amount = money.to_text(F.col("amount_minor"))
    cur = F.element_at(F.array(*[F.lit(x) for x in money.CURRENCY_NAMES]), (h % len(money.CURRENCY_NAMES) + 1).cast("int"))
    d = li.select(
        h.alias("h"), "txn_id",
        F.when(m == 1, "2024/13/01 10:00").when(m == 2, "yesterday").when(m == 8, "2031/01/01 00:00").otherwise(F.date_format(F.timestamp_micros("ts_us"), "yyyy/MM/dd HH:mm")).alias("ts"),
        F.lit("001").alias("from_bank"), F.col("account_from").alias("from_account"), F.when(m == 3, " ").otherwise("002").alias("to_bank"), F.col("account_to").alias("to_account"),
        amount.alias("amount_received"), cur.alias("receiving_ccy"), F.when(m == 4, "1e5").when(cur == "Yen", F.split_part(amount, F.lit("."), F.lit(1))).otherwise(amount).alias("amount_paid"),
        F.when(m == 5, "Florin").otherwise(cur).alias("payment_ccy"), F.when(m == 6, "Barter").otherwise("Wire").alias("payment_format"), F.when(m == 7, F.lit(None)).otherwise(F.col("label_is_fraud").cast("string")).alias("is_laundering"),
    )
    return scratch_table(d.withColumn("ordinal", F.col("h")), "raw-b")


def canonical_b(spark, sf_dir):
    raw = raw_b(spark, sf_dir)
    typ = raw.filter("h % 100 = 0").select(F.col("ordinal").alias("txn_ordinal"), F.lit("fan-out").alias("typology")).distinct()
    e, _ = c.canonical_b(raw, "b2", SECRET, typ, now_us=NOW)
    a = e.groupBy("currency", "label_typology", "label_is_fraud").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("total_minor"), F.min("ts_us").alias("first_ts_us"), F.countDistinct("account_from").alias("senders"))
    return a.fillna("", ["label_typology"])


def quarantine_b(spark, sf_dir):
    _, q = c.canonical_b(raw_b(spark, sf_dir), "b2", SECRET, now_us=NOW)
    return q.select("batch_id", "source_dataset", "row_index", "reason", F.get_json_object("payload_json", "$.amount_paid").alias("amount"), F.get_json_object("payload_json", "$.payment_ccy").alias("ccy"))


_NAMES = ", ".join(f"'{x}'" for x in money.CURRENCY_NAMES)
_ISO = ", ".join(f"'{x}'" for x in money.CURRENCY_NAMES.values())
_RAW_B = f"""{LI}, b0 AS (SELECT *, ('0x' || substr(txn_id, 4, 8))::BIGINT AS h, (amount_minor // 100) || '.' || lpad((amount_minor % 100)::VARCHAR, 2, '0') AS amt FROM li),
b1 AS (SELECT *, h % 60 AS m, [{_NAMES}][h % {len(money.CURRENCY_NAMES)} + 1] AS name, [{_ISO}][h % {len(money.CURRENCY_NAMES)} + 1] AS iso FROM b0),
b2 AS (SELECT *, CASE m WHEN 7 THEN 'null_field' WHEN 2 THEN 'timestamp_shape' WHEN 1 THEN 'timestamp_range' WHEN 4 THEN 'amount_shape' WHEN 5 THEN 'unknown_currency' WHEN 6 THEN 'unknown_format' WHEN 3 THEN 'blank_bank'
  WHEN 8 THEN 'future_timestamp' END AS reason,
  CASE WHEN m = 4 THEN '1e5' WHEN iso = 'JPY' THEN (amount_minor // 100)::VARCHAR ELSE amt END AS paid,
  CASE iso WHEN 'JPY' THEN amount_minor // 100 * 100 WHEN 'BTC' THEN amount_minor * 1000000 ELSE amount_minor END AS v FROM b1)"""
_CAN_B = f"""WITH {_RAW_B} SELECT iso AS currency, CASE WHEN h % 100 = 0 THEN 'fan-out' ELSE '' END AS label_typology, label_is_fraud, count(*) AS n, CAST(sum(v) AS BIGINT) AS total_minor,
  min(ts_us // 60000000 * 60000000) AS first_ts_us, count(DISTINCT account_from) AS senders FROM b2 WHERE reason IS NULL GROUP BY 1, 2, 3"""
_QUAR_B = f"WITH {_RAW_B} SELECT 'b2' AS batch_id, 'source_b' AS source_dataset, h AS row_index, reason, paid AS amount, CASE WHEN m = 5 THEN 'Florin' ELSE name END AS ccy FROM b2 WHERE reason IS NOT NULL"


def amounts(spark, sf_dir):
    """All ways of reading and writing money, on one table."""
    d = raw_a(spark, sf_dir).filter("row_index < 10000000000")
    minor, expanded, rounded = money.any_decimal(F.col("amount"))
    return d.select("row_index", money.two_places(F.col("amount")).alias("two_places"), minor.alias("any_minor"), expanded.alias("expanded"), rounded.alias("rounded"),
                    money.by_currency(F.col("amount"), F.lit("BTC")).alias("btc"), money.by_currency(F.col("amount"), F.lit("JPY")).alias("jpy"), money.to_text(minor).alias("text"))


_AMT = f"""WITH {_RAW}, x AS (SELECT row_index, amount, TRY_CAST(CASE WHEN amount = '1.0E3' THEN '1000.0' ELSE amount END AS DECIMAL(38, 8)) AS d FROM ra),
y AS (SELECT *, CAST(round_even(CAST(d * 100 AS DOUBLE), 0) AS BIGINT) AS v FROM x)
SELECT row_index, CASE WHEN regexp_matches(amount, '^[0-9]+(\\.[0-9]{{1,2}})?$') THEN CAST(d * 100 AS BIGINT) END AS two_places, v AS any_minor, regexp_matches(amount, '[eE]') AS expanded,
  d IS NOT NULL AND d * 100 <> v AS rounded, CAST(d * 100000000 AS BIGINT) AS btc, CASE WHEN d * 100 = floor(d * 100) THEN CAST(d * 100 AS BIGINT) END AS jpy,
  CASE WHEN v < 0 THEN '-' ELSE '' END || (abs(v) // 100) || '.' || lpad((abs(v) % 100)::VARCHAR, 2, '0') AS text FROM y"""


def event_checks(spark, sf_dir):
    """The checks over events some of which are spoilt, each in one way."""
    e = pay_events(spark, sf_dir)
    on = lambda k: F.col("event_id") % k == 0
    key = lambda col: F.substring(F.md5(F.col(col).cast("binary")), 1, 12)
    d = e.select(
        F.when(on(101), F.col("txn_id")).otherwise(F.concat(F.lit("events:"), "event_id")).alias("txn_id"), "source_dataset", "ts_us",
        F.when(on(103), -1).otherwise(F.col("amount_minor")).alias("amount_minor"), F.when(on(107), 2).otherwise(F.col("label_is_fraud")).alias("label_is_fraud"), "label_is_flagged",
        F.when(on(109), 24).otherwise(F.col("local_hour")).alias("local_hour"), F.when(on(113), F.date_add("event_date_local", 4)).otherwise(F.col("event_date_local")).alias("event_date_local"),
        F.when(on(127), F.upper(F.concat(F.lit("z"), key("account_from")))).otherwise(key("account_from")).alias("account_from"), key("account_to").alias("account_to"),
        F.when(on(131), None).otherwise(F.col("src_balance_before_minor")).alias("src_balance_before_minor"), "src_balance_after_minor", "dst_balance_before_minor", "dst_balance_after_minor", "event_id")
    return c.checks(d.unionByName(d.filter(on(137))))


_CHECKS = f"""WITH {EV}, d AS (SELECT event_id AS i FROM ev UNION ALL SELECT event_id FROM ev WHERE event_id % 137 = 0)
SELECT count(*) FILTER (WHERE i % 101 = 0) AS id_not_namespaced, count(*) FILTER (WHERE i % 103 = 0) AS negative_amount, count(*) FILTER (WHERE i % 107 = 0) AS label_not_binary,
  count(*) FILTER (WHERE i % 109 = 0) AS hour_range, count(*) FILTER (WHERE i % 113 = 0) AS date_drift, count(*) FILTER (WHERE i % 127 = 0) AS key_shape,
  count(*) FILTER (WHERE i % 131 = 0) AS partial_balances, count(DISTINCT i) FILTER (WHERE i % 137 = 0) AS order_not_unique FROM d"""


def sources(spark, sf_dir):
    """Both sources per batch: rows, balances, labels, window, base rate."""
    a, _ = c.canonical_a(raw_a(spark, sf_dir), "b1", SECRET, EPOCH)
    b, _ = c.canonical_b(raw_b(spark, sf_dir), "b2", SECRET, now_us=NOW)
    both = checkpoint(a.unionByName(b))
    man = c.batch_manifest(both).select("source_dataset", "batch_id", "first_ts_us", "last_ts_us", F.round("fraud_rate", 9).alias("fraud_rate"))
    return c.balances_per_source(both).join(man, "source_dataset")


_SOURCES = f"""WITH {_RAW}, {_RAW_B}, x AS (SELECT 'source_a' AS s, 'b1' AS b, {EPOCH} + step::BIGINT * {HOUR} + ('0x' || substr(digest, 9, 8))::BIGINT % {HOUR} AS t, isFraud AS f, 1 AS bal FROM kp
  UNION ALL SELECT 'source_b', 'b2', ts_us // 60000000 * 60000000, label_is_fraud, NULL FROM b2 WHERE reason IS NULL)
SELECT s AS source_dataset, count(*) AS n, count(bal) AS with_balance, 0::BIGINT AS with_typology, CAST(sum(f) AS BIGINT) AS fraud, 0::BIGINT AS typology_without_label, b AS batch_id, min(t) AS first_ts_us, max(t) AS last_ts_us,
  round(avg(f), 9) AS fraud_rate FROM x GROUP BY s, b"""


def reconcile(spark, sf_dir):
    return c.reconcile(pay_events(spark, sf_dir).select("currency", "amount_minor").union(pay_lineitem(spark, sf_dir).select("currency", "amount_minor")))


_RECON = f"""WITH {EV}, {LI}, u AS (SELECT currency, amount_minor FROM ev UNION ALL SELECT currency, amount_minor FROM li)
SELECT currency, count(*) AS events, CAST(sum(amount_minor) AS BIGINT) AS moved_minor, 2 * count(*) AS entity_rows, CAST(sum(amount_minor) AS BIGINT) AS debits_minor, CAST(sum(amount_minor) AS BIGINT) AS credits_minor, true AS reconciled FROM u GROUP BY 1"""


def shape(spark, sf_dir):
    return c.corpus_shape(pay_events(spark, sf_dir)).withColumn("reuse_ratio", F.round("reuse_ratio", 9)).withColumn("label_rate", F.round("label_rate", 9))


_SHAPE = f"""WITH {EV}, s AS (SELECT account_from, count(*) AS k FROM ev GROUP BY 1)
SELECT (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM ev WHERE account_from = account_to) AS self_loops, (SELECT round(avg(label_is_fraud), 9) FROM ev) AS label_rate, count(*) AS senders, count(*) FILTER (WHERE k > 1) AS reused,
  quantile_disc(k, 0.5) AS p50, quantile_disc(k, 0.9) AS p90, quantile_disc(k, 0.99) AS p99, (SELECT count(DISTINCT (account_from, account_to)) FROM ev WHERE account_from <> account_to) AS edges, round(count(*) FILTER (WHERE k > 1) / count(*), 9) AS reuse_ratio FROM s"""


def slice_(spark, sf_dir):
    return c.connected_slice(pay_events(spark, sf_dir), 500).select("txn_id", "account_from", "account_to")


_SLICE = f"""WITH {EV}, d AS (SELECT account, row_number() OVER (ORDER BY count(*) DESC, account) AS r FROM (SELECT account_from AS account FROM ev UNION ALL SELECT account_to FROM ev) GROUP BY 1),
x AS (SELECT e.*, greatest(a.r, b.r) AS r FROM ev e JOIN d a ON a.account = e.account_from JOIN d b ON b.account = e.account_to),
p AS (SELECT 64 * CAST(pow(2, k) AS BIGINT) AS pool FROM range(0, 40) t(k)), c AS (SELECT pool, (SELECT count(*) FROM x WHERE x.r <= pool) AS have FROM p),
w AS (SELECT pool, have FROM c WHERE have >= 500 OR pool >= (SELECT count(*) FROM d) ORDER BY pool LIMIT 1),
i AS (SELECT x.*, row_number() OVER (ORDER BY ts_us, txn_id) - 1 AS i, have FROM x, w WHERE r <= pool)
SELECT txn_id, account_from, account_to FROM i WHERE floor(i * 500 / greatest(have, 500)) <> floor((i - 1) * 500 / greatest(have, 500))"""


def lineitem_hash(spark, sf_dir):
    return keys.content_hash(pay_lineitem(spark, sf_dir).select("txn_id", "ts_us", "amount_minor", "channel"), ["channel"])


_HASH = f"""WITH {LI}, d AS (SELECT channel, ('0x' || substr(sha256(concat_ws('|', amount_minor, ts_us, txn_id)), 1, 15))::BIGINT::HUGEINT AS h FROM li)
SELECT channel, count(*) AS n, lpad(upper(hex(CAST(sum(h) % 1152921504606846976 AS BIGINT))), 15, '0') AS content_hash FROM d GROUP BY 1"""


def diff(spark, sf_dir):
    e = pay_events(spark, sf_dir).select("txn_id", "amount_minor", "channel")
    changed = e.withColumn("amount_minor", F.when(F.col("amount_minor") % 1000 == 7, F.col("amount_minor") + 1).otherwise(F.col("amount_minor")))
    return c.table_diff(e, changed)


_DIFF = f"WITH {EV} SELECT txn_id, amount_minor, channel, 'left' AS side FROM ev WHERE amount_minor % 1000 = 7 UNION ALL SELECT txn_id, amount_minor + 1, channel, 'right' FROM ev WHERE amount_minor % 1000 = 7"


def clocks(spark, sf_dir):
    e = pay_events(spark, sf_dir)
    z = "Africa/Kampala"
    clock = F.date_format(F.timestamp_micros("ts_us"), "yyyy/MM/dd HH:mm")
    return e.select("txn_id", times.local_hour(F.col("ts_us"), z).alias("hour"), times.local_date(F.col("ts_us"), z).alias("day"), times.from_local(clock, z).alias("from_local_us"),
                    times.step_instant(F.col("event_id"), EPOCH, F.lit(5)).alias("step_us"), keys.node_key(F.col("source_dataset"), F.col("account_from")).alias("node"))


_CLOCKS = f"""WITH {EV} SELECT txn_id, CAST(local_hour AS INT) AS hour, event_date_local AS day, ts_us // 60000000 * 60000000 - {3 * HOUR} AS from_local_us, {EPOCH} + event_id * {HOUR} + 5 AS step_us, 'events#' || account_from AS node FROM ev"""


def fifo(spark, sf_dir):
    """Returned rows of an order and part matched, in order, with others of the same key."""
    li = pay_lineitem(spark, sf_dir)
    a = li.filter("txn_type = 'R'").select("account_from", "account_to", F.col("txn_id").alias("a_id"), F.col("ts_us").alias("a_ts"))
    t = li.filter("txn_type <> 'R'").select("account_from", "account_to", F.col("txn_id").alias("t_id"), F.col("ts_us").alias("t_ts"))
    m, u = c.fifo_match(a.withColumn("o", F.concat(F.col("a_ts"), "a_id")), t.withColumn("p", F.concat(F.col("t_ts"), "t_id")), ["account_from", "account_to"], "o", "p")
    return m.select("a_id", "t_id").unionByName(u.select("a_id"), allowMissingColumns=True)


_FIFO = f"""WITH {LI}, a AS (SELECT *, row_number() OVER (PARTITION BY account_from, account_to ORDER BY ts_us || txn_id) AS k FROM li WHERE txn_type = 'R'),
t AS (SELECT *, row_number() OVER (PARTITION BY account_from, account_to ORDER BY ts_us || txn_id) AS k FROM li WHERE txn_type <> 'R')
SELECT a.txn_id AS a_id, t.txn_id AS t_id FROM a LEFT JOIN t ON a.account_from = t.account_from AND a.account_to = t.account_to AND a.k = t.k"""

QUERIES = {
    "canonical_a": canonical_a, "canonical_a_quarantine": quarantine_a, "canonical_a_duplicates": duplicates, "canonical_b": canonical_b, "canonical_b_quarantine": quarantine_b, "money_text": amounts,
    "canonical_checks": event_checks, "canonical_sources": sources, "money_reconciled": reconcile, "corpus_shape": shape, "connected_slice": slice_, "content_hash": lineitem_hash,
    "table_diff": diff, "clocks": clocks, "fifo_match": fifo,
}
ORACLE = {
    "canonical_a": _CAN_A, "canonical_a_quarantine": _QUAR, "canonical_a_duplicates": _DUPS, "canonical_b": _CAN_B, "canonical_b_quarantine": _QUAR_B, "canonical_sources": _SOURCES, "connected_slice": _SLICE, "money_text": _AMT, "canonical_checks": _CHECKS,
    "money_reconciled": _RECON, "corpus_shape": _SHAPE, "content_hash": _HASH, "table_diff": _DIFF, "clocks": _CLOCKS, "fifo_match": _FIFO,
}
