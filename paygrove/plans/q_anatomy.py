"""Labelled rings and the settings that leave them out, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paygrove.operators import anatomy
from paygrove.plans.tables import EV, pay_events


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated rings, a row per leg: each labelled payment and the first payments by which its money can come back.

    A ring has two legs (back at once) or three (through any one account). Annotations
    ignore time and amounts; every fifth payment is in another currency.
    """
    e = pay_events(spark, sf_dir).filter("account_from <> account_to").withColumn("currency", F.when(F.col("event_id") % 5 == 0, "KES").otherwise(F.col("currency")))
    leg = F.struct("account_from", "account_to", "ts_us", "amount_minor", "currency", "txn_type", "event_id")
    seed = e.filter("label_is_fraud = 1").select(F.col("account_from").alias("a"), F.col("account_to").alias("b"), leg.alias("l1"))
    first = e.groupBy("account_from", "account_to").agg(F.min_by(leg, F.struct("ts_us", "event_id")).alias("l"))
    hop = lambda x, y, l: first.select(F.col("account_from").alias(x), F.col("account_to").alias(y), F.col("l").alias(l))
    two = seed.join(hop("b", "a", "l2"), ["a", "b"]).select(F.concat_ws("-", "l1.event_id", "l2.event_id").alias("attempt"), F.array("l1", "l2").alias("ls"))
    three = seed.join(hop("b", "c", "l2"), "b").filter("c <> a").join(hop("c", "a", "l3"), ["a", "c"]).select(
        F.concat_ws("-", "l1.event_id", "l2.event_id", "l3.event_id").alias("attempt"), F.array("l1", "l2", "l3").alias("ls"))
    return two.unionByName(three).select("attempt", F.posexplode("ls").alias("step", "leg")).select("attempt", "step", "leg.*")


def ring_reasons(spark, sf_dir):
    r = anatomy.reasons(anatomy.measured(attempts(spark, sf_dir)), non_increasing=True)
    return r.select("attempt", "legs", "turns_back", "increases", "retention_micro", F.concat_ws(",", "reasons").alias("reasons"))


def ring_anatomy(spark, sf_dir):
    r = anatomy.anatomy(anatomy.reasons(anatomy.measured(attempts(spark, sf_dir)), non_increasing=True))
    return r.withColumn("best_retention", F.round("best_retention", 9))


_RINGS = f"""{EV}, e AS (SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN 'KES' ELSE currency END AS currency) FROM ev WHERE account_from <> account_to),
f AS (SELECT account_from, account_to, arg_min(event_id, (ts_us, event_id)) AS id FROM e GROUP BY 1, 2), s AS (SELECT account_from AS a, account_to AS b, event_id AS id FROM e WHERE label_is_fraud = 1),
att AS (SELECT [s.id, f.id] AS ids FROM s JOIN f ON f.account_from = b AND f.account_to = a
  UNION ALL SELECT [s.id, f.id, g.id] FROM s JOIN f ON f.account_from = b AND f.account_to <> a JOIN f g ON g.account_from = f.account_to AND g.account_to = a),
lg AS (SELECT array_to_string(ids, '-') AS attempt, unnest(ids) AS event_id, generate_subscripts(ids, 1) AS step FROM att),
lx AS (SELECT lg.attempt, step, e.*, lag(ts_us) OVER w AS pt, lag(amount_minor) OVER w AS pa FROM lg JOIN e USING (event_id) WINDOW w AS (PARTITION BY lg.attempt ORDER BY step)),
m AS (SELECT attempt, count(*) AS legs, bool_or(txn_type = 'error') AS rv, count(*) FILTER (WHERE ts_us <= pt) AS turns_back, count(*) FILTER (WHERE amount_minor > pa) AS increases,
    count(DISTINCT currency) > 1 AS cv, max(amount_minor) AS hi, min(amount_minor) AS lo FROM lx GROUP BY 1),
q AS (SELECT *, CASE WHEN hi > 0 THEN lo * 1000000 // hi ELSE 0 END AS retention_micro FROM m),
r AS (SELECT *, list_filter([CASE WHEN rv THEN 'reversal_leg' END, CASE WHEN legs < 3 THEN 'length_below_min' END, CASE WHEN turns_back > 0 THEN 'time_reversal' END, CASE WHEN hi = 0 THEN 'zero_value' END,
    CASE WHEN hi > 0 AND retention_micro < 600000 THEN 'retention_floor' END, CASE WHEN cv THEN 'cross_currency' END, CASE WHEN increases > 0 THEN 'amount_increases' END], lambda x: x IS NOT NULL) AS rs FROM q)"""

QUERIES = {"ring_reasons": ring_reasons, "ring_anatomy": ring_anatomy}
ORACLE = {
    "ring_reasons": f"WITH {_RINGS} SELECT attempt, legs, turns_back, increases, retention_micro, array_to_string(rs, ',') AS reasons FROM r",
    "ring_anatomy": f"""WITH {_RINGS}, x AS (SELECT unnest(CASE WHEN len(rs) = 0 THEN ['found'] ELSE rs END) AS reason, len(rs) <= 1 AS alone, CASE WHEN hi > 0 THEN lo / hi ELSE 0 END AS retention FROM r),
g AS (SELECT reason, count(*) AS rings, count(*) FILTER (WHERE alone) AS alone, round(max(retention), 9) AS best_retention FROM x GROUP BY 1)
SELECT k.reason, coalesce(rings, 0) AS rings, coalesce(alone, 0) AS alone, best_retention FROM (SELECT unnest({list(("found", *anatomy.REASONS))}) AS reason) k LEFT JOIN g USING (reason)""",
}
