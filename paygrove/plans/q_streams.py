"""Streaming jobs run over the whole payment table as a stream of files, and what SQL gives for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paygrove.operators import graph
from paygrove.plans.tables import DAY, EV, HOUR, pay_stream
from paygrove.session import shared_dir, state_store
from paygrove.streaming import jobs

CASHING = ("purchase", "click")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What the stream gives for all files that are there now, as a table under the shared folder."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/paygrove-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    with state_store(spark):
        q = stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def cash_outs(spark, sf_dir):
    """Rule R10 as a stream: inflows whose window the watermark has passed and that were mostly cashed out in it."""
    e = pay_stream(spark, sf_dir).filter("account_from <> account_to and txn_type <> 'error'")
    legs = graph.legs(e).select("account", "currency", "side", "ts_us", "txn_id", "txn_type", "amount_minor")
    d = drained(jobs.fast_cash_out(legs, cash_out=CASHING), "cash-outs")
    return d.withColumn("share", F.round("share", 9))


_SLICE = jobs.CashOuts.SLICE_MS
_CASH = f"""WITH {EV}, p AS (SELECT * FROM ev WHERE account_from <> account_to AND txn_type <> 'error' AND amount_minor > 0),
wm AS (SELECT max(ts_us) // 1000 - {HOUR // 1000} AS ms FROM p),
j AS (SELECT i.account_to AS account, i.currency, i.txn_id AS inflow_id, i.ts_us AS inflow_us, i.amount_minor AS inflow_minor, CAST(sum(o.amount_minor) AS BIGINT) AS cashed_minor, max(o.ts_us) AS last_out_us
  FROM p i JOIN p o ON o.account_from = i.account_to AND o.currency = i.currency AND o.txn_type IN {CASHING} AND o.ts_us BETWEEN i.ts_us AND i.ts_us + {DAY} GROUP BY 1, 2, 3, 4, 5)
SELECT account, currency, inflow_id, inflow_us, inflow_minor, cashed_minor, round(cashed_minor / inflow_minor, 9) AS share, last_out_us FROM j, wm
WHERE cashed_minor * 1000000 >= inflow_minor * 900000 AND ((inflow_us + {DAY}) // 1000 // {_SLICE} + 1) * {_SLICE} <= ms"""

QUERIES = {"stream_cash_outs": cash_outs}
ORACLE = {"stream_cash_outs": _CASH}
