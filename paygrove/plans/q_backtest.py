"""A backtest whose scores come from each fold's own training rows, landed and read back, and its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paygrove.operators import evaluate, landing, pricing, splits
from paygrove.plans.q_evaluate import _FAIR, _FOLDS, _METRICS, A, SC, _folds
from paygrove.plans.q_reports import _ABL, _LED, _OVER, FS
from paygrove.session import scratch_table, shared_dir

#: From this score on an account counts as picked; payments from LARGE on are large.
PICKED, LARGE = 0.05, 5_000_000


def history(spark, sf_dir):
    """Customers of each fold's test block, scored by their labels in its training rows (smoothed) and by their share of large payments there."""
    li, plan = _folds(spark, sf_dir)
    d = splits.assign(li.withColumnRenamed("account_from", "account_key"), plan).filter("role in ('train', 'test')")
    train, test = F.col("role") == "train", F.col("role") == "test"
    g = d.groupBy("account_key", "fold").agg(
        F.sum(F.when(test, F.col("amount_minor"))).alias("total"), F.count_if(test).alias("rows"), F.max(F.when(test, F.col("label_is_fraud"))).alias("label"),
        F.sum(F.when(test & (F.col("channel") == "O"), F.col("amount_minor"))).alias("outflow_minor"), F.count_if(train).alias("seen"),
        F.count_if(train & (F.col("label_is_fraud") == 1)).alias("bad"), F.count_if(train & (F.col("amount_minor") >= LARGE)).alias("large")).filter("rows > 0")
    return g.select(
        "account_key", "fold", "total", "rows", "label", "outflow_minor", ((F.col("bad") + 0.5) / (F.col("seen") + 10)).alias("score"),
        (F.col("large") / F.greatest(F.col("seen"), F.lit(1))).alias("rule_severity"), F.lit("USD").alias("currency"))


def landed_backtest(spark, sf_dir):
    """Every panel of the backtest as read back from what it landed: metrics, spread, ledgers, policies, ablation, fairness."""
    d = scratch_table(history(spark, sf_dir), "history")
    p = pricing.candidates(pricing.price(pricing.attach(d, A), A)).withColumn("recoverable_minor", F.col("intercept_minor"))
    taken = pricing.first_fit(evaluate.by_policy(p), [F.col("place"), F.col("account_key")], [600], ("policy", "fold"))
    ledgers = scratch_table(evaluate.fold_ledger(taken, ["policy", "fold"]), "ledgers")
    parts = {"all": F.col("score") + F.col("rule_severity"), "without_rules": F.col("score"), "without_model": F.col("rule_severity"), "volume_only": F.col("rows")}
    tables = landing.backtest(
        scratch_table(evaluate.measure(d, ["fold"]), "measured"), ledgers, evaluate.cumulative(ledgers, ("policy",)), evaluate.ablation(d, parts, F.col("label") + F.col("score") / 10),
        evaluate.false_positive_rates(d.withColumn("picked", F.col("score") >= PICKED), "rows", "picked"))
    root = f"{shared_dir(spark)}/paygrove-{spark.sparkContext.applicationId}/landed-{uuid.uuid4().hex[:12]}"
    for name, rows in tables.items():
        landing.land(rows, root, "backtest", "r1", name)
    return landing.landed(spark, root, "backtest", "r1").withColumn("value", F.round("value", 6)).drop("run_id")


_HS = f"""{_FOLDS}, fs AS (SELECT account_from AS account_key, fold, CAST(sum(amount_minor) FILTER (WHERE role = 'test') AS BIGINT) AS total, count(*) FILTER (WHERE role = 'test') AS rows, max(label_is_fraud) FILTER (WHERE role = 'test') AS label,
  CAST(sum(amount_minor) FILTER (WHERE role = 'test' AND channel = 'O') AS BIGINT) AS outflow_minor, (count(*) FILTER (WHERE role = 'train' AND label_is_fraud = 1) + 0.5::DOUBLE) / (count(*) FILTER (WHERE role = 'train') + 10) AS score,
  count(*) FILTER (WHERE role = 'train' AND amount_minor >= {LARGE}) / greatest(count(*) FILTER (WHERE role = 'train'), 1)::DOUBLE AS rule_severity, 'USD' AS currency
  FROM ro WHERE role IN ('train', 'test') GROUP BY 1, 2 HAVING count(*) FILTER (WHERE role = 'test') > 0)"""
_HSC = f"{_HS}, sc AS (SELECT * FROM fs)"


def _long_sql(part: str, panel: str, source: str, measures: list[str], item: str = "NULL", fold: str = "NULL") -> str:
    each = ", ".join(f"{{'measure': '{m}', 'value': round(CAST({m} AS DOUBLE), 6)}}" for m in measures)
    return f"SELECT '{part}' AS part, '{panel}' AS panel, CAST({fold} AS INT) AS fold, CAST({item} AS VARCHAR) AS item, unnest([{each}], recursive := true) FROM ({source})"


_M = _METRICS.replace(SC, _HSC).replace("typology", "fold")
_METRIC_NAMES = ["n", "positives", "base_rate", "average_precision", "auroc", "brier", "ks"]
_SPREAD = " UNION ALL ".join(f"SELECT '{m}' AS measure_, count({m}) AS folds, avg({m}) AS mean, stddev_samp({m}) AS std, min({m}) AS least, max({m}) AS most FROM mt" for m in _METRIC_NAMES)
_LANDED = " UNION ALL ".join([
    _long_sql("fold_metrics", "fold", _M, _METRIC_NAMES, fold="fold"),
    _long_sql("summary", "summary", f"WITH mt AS ({_M}) {_SPREAD}", ["folds", "mean", "std", "least", "most"], "measure_"),
    _long_sql("ledgers", "ledger", f"{_LED.replace(FS, _HS)} SELECT * FROM led", ["reviewed", "minutes", "captured_minor", "review_cost_minor", "friction_minor", "net_minor"], "policy", "fold"),
    _long_sql("policies", "policy", _OVER.replace(FS, _HS), ["folds", "total_minor", "max_drawdown_minor", "worst_minor", "minutes", "per_hour_minor"], "policy"),
    _long_sql("ablation", "ablation", _ABL.replace(SC, _HSC), ["n", "positives", "average_precision", "auroc"], "configuration"),
    _long_sql("fairness", "fairness", _FAIR.replace(SC, _HSC).replace("score >= 0.6", f"score >= {PICKED}"), ["negatives", "false_positive_rate"], "bucket"),
])

QUERIES = {"landed_backtest": landed_backtest}
ORACLE = {"landed_backtest": _LANDED}
