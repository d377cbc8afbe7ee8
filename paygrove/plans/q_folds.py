"""Queries over fold tables and the frames built on them; each fold's SQL reads only events before its cutoff."""

from __future__ import annotations

from pyspark.sql import functions as F

from paygrove.operators import features, folds, graph, kernels, splits
from paygrove.operators.entity import explode_entities
from paygrove.operators.registry import FEATURES
from paygrove.plans.q_features import EN
from paygrove.plans.q_graph import _DENS, _DOWN, _EFF, _NODES, _PART
from paygrove.plans.q_rules import _SQL as RULE_SQL
from paygrove.plans.q_rules import S
from paygrove.plans.q_graph import CUTOFF
from paygrove.plans.tables import DAY, EV, pay_events, pay_lineitem
from paygrove.session import scratch_table

FOLDS = 2


def _plan(events):
    return splits.plan(events, folds=FOLDS, embargo_days=1)


def _rows(events, plan):
    """Every account in every fold."""
    a = events.select(F.explode(F.array("account_from", "account_to")).alias("entity")).distinct()
    return a.withColumn("fold", F.explode(F.array(*[F.lit(f.fold) for f in plan])))


_CUT = f"""cut AS (SELECT k::INT AS fold, known - trunc((known - a) * 0.15::DOUBLE)::BIGINT - {DAY} - 1 AS c FROM (
  SELECT k, a, a + trunc(span * 0.4::DOUBLE)::BIGINT + k * trunc(span * (1 - 0.4::DOUBLE) / {FOLDS})::BIGINT AS known FROM (SELECT min(ts_us) AS a, max(ts_us) + 1 - min(ts_us) AS span FROM eva), range({FOLDS}) r(k)))"""


def _ev(k: int, width: int | None = None) -> str:
    """The events that a fold's tables may see, in place of all events."""
    at = f"(SELECT c FROM cut WHERE fold = {k})"
    recent = "" if width is None else f" AND ts_us > {at} - {width}"
    return EV.replace("ev AS (", "eva AS (", 1) + f", {_CUT}, ev AS (SELECT * FROM eva WHERE ts_us <= {at}{recent})"


def _in(sql: str, k: int, width: int | None = None) -> str:
    return sql.replace(EV, _ev(k, width))


def _accounts(k: int) -> str:
    return f"(WITH {EV} SELECT account_from AS entity FROM ev UNION SELECT account_to FROM ev) r"


def graph_local(spark, sf_dir):
    e = pay_events(spark, sf_dir)
    plan = _plan(e)
    t = folds.per_fold(e, plan, lambda x, f: folds.node_table(x, f, (folds.LOCAL,)))
    return folds.attach(_rows(e, plan), folds.sealed(t, plan))


def _local_sql(k: int) -> str:
    w = 30 * DAY
    # the outflow before the cutoff, with the cutoff in place of the fixed instant
    down = _in(_DOWN, k).replace(f"ts_us <= {CUTOFF}", "true").replace(f"ts_us > {CUTOFF - DAY}", f"ts_us > (SELECT c FROM cut WHERE fold = {k}) - {DAY}")
    return f"""SELECT {k} AS fold, r.entity, n.in_degree AS graph_in_degree_30d, n.out_degree AS graph_out_degree_30d, f.fan_in_effective AS graph_effective_fan_in_30d, f.fan_out_effective AS graph_effective_fan_out_30d,
  d.local_density_bps AS graph_local_density_30d_bps, n.self_transfer_count AS graph_self_transfer_count_30d, o.downstream_outflow_24h_minor, b.is_external AS graph_is_external
FROM {_accounts(k)} LEFT JOIN (WITH {_in(_NODES, k)} SELECT * FROM nd) b ON b.account = r.entity LEFT JOIN (WITH {_in(_NODES, k, w)} SELECT * FROM nd) n ON n.account = r.entity
LEFT JOIN ({_in(_EFF, k, w)}) f ON f.account = r.entity LEFT JOIN ({_in(_DENS, k, w)}) d ON d.account = r.entity LEFT JOIN ({down}) o ON o.account = r.entity"""


def graph_global(spark, sf_dir):
    e = pay_events(spark, sf_dir)
    plan = _plan(e)
    t = folds.per_fold(e, plan, lambda x, f: folds.node_table(x, f, (folds.GLOBAL,)))
    d = folds.attach(_rows(e, plan), folds.sealed(t, plan))
    return d.withColumns({c: F.round(c, 9) for c in ("graph_pagerank", "graph_betweenness_approx")})


def graph_typology(spark, sf_dir):
    e = pay_events(spark, sf_dir)
    plan = _plan(e)
    found = folds.fold_cycles(e, plan)
    t = folds.per_fold(e, plan, lambda x, f: folds.node_table(x, f, (folds.TYPOLOGY,), cycles=found))
    return folds.attach(_rows(e, plan), folds.sealed(t, plan))


def _typology_sql(k: int) -> str:
    return f"""SELECT {k} AS fold, r.entity, CASE WHEN b.account IS NOT NULL THEN coalesce(p.cycle_participation_count, 0) END AS graph_cycle_participation_count, p.max_cycle_retention_bps AS graph_max_cycle_retention_bps,
  p.longest_cycle_length AS graph_longest_chain_length, b.is_external AS graph_is_external
FROM {_accounts(k)} LEFT JOIN (WITH {_in(_NODES, k)} SELECT * FROM nd) b ON b.account = r.entity LEFT JOIN ({_in(_PART, k)}) p ON p.account = r.entity"""


def rule_derived(spark, sf_dir):
    """Severities of all twelve rules, hits and the highest, per fold and account."""
    e = scratch_table(pay_events(spark, sf_dir), "events")  # read by every rule of every fold
    plan = _plan(e)
    found = folds.fold_cycles(e, plan, S)
    h = folds.per_fold(e, plan, lambda x, f: folds.hit_table(x, f, S, cycles=found))
    d = folds.attach(_rows(e, plan), hits=h)
    return d.withColumns({f.name: F.round(f.name, 9) for f in FEATURES if f.kind == "rule" and f.source != "COUNT"})


def _rules_sql(k: int) -> str:
    hits = " UNION ALL ".join(f"SELECT rule_id, account_key, severity FROM ({_in(q, k)})" for q in RULE_SQL.values())
    cols = ", ".join(
        f"count(h.rule_id) AS {f.name}" if f.source == "COUNT" else f"max(severity) AS {f.name}" if f.source == "MAX" else f"max(CASE WHEN rule_id = '{f.source}' THEN severity END) AS {f.name}"
        for f in FEATURES if f.kind == "rule")
    names = ", ".join(f"CASE WHEN rule_severity_max IS NOT NULL THEN {f.name} END AS {f.name}" for f in FEATURES if f.kind == "rule")
    return f"SELECT fold, entity, {names} FROM (SELECT {k} AS fold, r.entity, {cols} FROM {_accounts(k)} LEFT JOIN ({hits}) h ON h.account_key = r.entity GROUP BY r.entity)"


def _union(of) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({of(k)})" for k in range(FOLDS))


AMOUNTS = ["txn_count_in_24h", "amount_in_24h_minor", "amount_out_24h_minor", "net_flow_30d_minor"]
_NEEDED = [f for f in FEATURES if f.name in (*AMOUNTS, "amount_in_30d_minor", "amount_out_30d_minor")]
_BASE = f"""WITH {EV}, {EN}, mx AS (SELECT txn_id, ts_us, entity, sign, count(*) OVER d AS txn_count_in_24h,
  CAST(coalesce(sum(CASE WHEN sign > 0 AND amount_minor <> 0 THEN amount_minor END) OVER d, 0) AS BIGINT) AS amount_in_24h_minor, CAST(coalesce(sum(CASE WHEN sign < 0 AND amount_minor <> 0 THEN amount_minor END) OVER d, 0) AS BIGINT) AS amount_out_24h_minor,
  CAST(coalesce(sum(CASE WHEN sign > 0 AND amount_minor <> 0 THEN amount_minor END) OVER m, 0) - coalesce(sum(CASE WHEN sign < 0 AND amount_minor <> 0 THEN amount_minor END) OVER m, 0) AS BIGINT) AS net_flow_30d_minor
  FROM en WINDOW d AS (PARTITION BY entity ORDER BY ts_us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW), m AS (PARTITION BY entity ORDER BY ts_us RANGE BETWEEN {30 * DAY} PRECEDING AND CURRENT ROW))"""


def _labels(e):
    return e.select("txn_id", "label_is_fraud", F.when(F.col("label_is_fraud") == 1, F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string"))).alias("label_typology"))


def account_frame(spark, sf_dir):
    """Features of transactions brought to accounts, with their labels; refused if a value isn't finite."""
    e = pay_events(spark, sf_dir)
    m = folds.finite(features.build(e, _NEEDED), AMOUNTS)
    return folds.bridge(m, _labels(e), AMOUNTS).withColumn("label_typology", F.coalesce("label_typology", F.lit("")))


_FRAME = f"""{_BASE}, j AS (SELECT mx.*, label_is_fraud, CASE WHEN label_is_fraud = 1 THEN 't' || (event_id % 3) END AS typ FROM mx JOIN ev USING (txn_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, ts_us ORDER BY txn_id DESC, sign DESC) AS nth FROM j),
g AS (SELECT entity, ts_us, count(*) AS transactions, max(label_is_fraud) AS label_is_fraud, coalesce(arg_max(typ, (txn_id, sign)) FILTER (WHERE typ IS NOT NULL), '') AS label_typology FROM j GROUP BY 1, 2)
SELECT r.entity, r.ts_us AS as_of_us, txn_id, {', '.join(AMOUNTS)}, transactions, g.label_is_fraud, g.label_typology FROM r JOIN g ON r.entity = g.entity AND r.ts_us = g.ts_us WHERE nth = 1"""


def correlations(spark, sf_dir):
    """Columns against the label; one of them is the label in disguise and must be found."""
    e = pay_events(spark, sf_dir)
    m = features.build(e, _NEEDED).join(e.select("txn_id", "label_is_fraud"), "txn_id")
    m = m.withColumn("disguised", F.col("label_is_fraud") * 7 + 3).withColumn("constant", F.lit(1))
    return folds.label_correlations(m, [*AMOUNTS, "disguised", "constant"], "label_is_fraud").withColumn("correlation", F.round("correlation", 9))


_CORR = f"""{_BASE}, j AS (SELECT mx.*, label_is_fraud, label_is_fraud * 7 + 3 AS disguised FROM mx JOIN ev USING (txn_id))
""" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(abs(corr({c}, label_is_fraud)), 9) AS correlation, abs(corr({c}, label_is_fraud)) > 0.98 AS leaks FROM j" for c in (*AMOUNTS, "disguised")) + """
UNION ALL SELECT 'constant', NULL, false"""


def nulls(spark, sf_dir):
    """Null rates of the local graph features over all folds' rows."""
    d = graph_local(spark, sf_dir)
    return folds.null_rates(d, _GRAPH_COLS).withColumn("rate", F.round("rate", 9))


_GRAPH_COLS = ["graph_in_degree_30d", "graph_out_degree_30d", "graph_local_density_30d_bps", "downstream_outflow_24h_minor"]
_NULLS = "WITH x AS (" + _union(_local_sql) + ") " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls, round((count(*) - count({c})) / count(*), 9) AS rate FROM x" for c in _GRAPH_COLS)


def roles(spark, sf_dir):
    """Rows and positives of the pooled validation and test slices, with how many folds they come from."""
    e = pay_events(spark, sf_dir)
    f = splits.assign(e, _plan(e))
    out = None
    for r in ("valid", "test"):
        x = folds.pooled(f, r).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("label_is_fraud").alias("positives"), F.countDistinct("fold").alias("folds"), F.countDistinct("account_from").alias("accounts"))
        out = x if out is None else out.unionByName(x)
    return out


_ROLES = f"""WITH {EV}, t AS (SELECT min(ts_us) AS a, max(ts_us) + 1 - min(ts_us) AS span FROM ev), k AS (SELECT k AS fold, a, a + trunc(span * 0.4::DOUBLE)::BIGINT + k * trunc(span * (1 - 0.4::DOUBLE) / {FOLDS})::BIGINT AS known, trunc(span * (1 - 0.4::DOUBLE) / {FOLDS})::BIGINT AS step FROM t, range({FOLDS}) r(k)),
x AS (SELECT ev.*, fold, CASE WHEN ts_us >= known - trunc((known - a) * 0.15::DOUBLE)::BIGINT AND ts_us < known THEN 'valid' WHEN ts_us >= known + {DAY} AND ts_us < known + step THEN 'test' END AS role FROM ev, k)
SELECT role, count(*) AS n, CAST(sum(label_is_fraud) AS BIGINT) AS positives, count(DISTINCT fold) AS folds, count(DISTINCT account_from) AS accounts FROM x WHERE role IS NOT NULL GROUP BY 1"""


def currencies(spark, sf_dir):
    """Accounts of both sources that move more than one currency."""
    li = pay_lineitem(spark, sf_dir).select(F.when(F.col("amount_minor") % 97 == 0, "EUR").otherwise(F.col("currency")).alias("currency"), "account_from", "account_to")
    return folds.mixed_currencies(li.unionByName(pay_events(spark, sf_dir).select("currency", "account_from", "account_to")))


def _currencies_sql() -> str:
    from paygrove.plans.tables import LI

    return f"""WITH {EV}, {LI}, u AS (SELECT CASE WHEN amount_minor % 97 = 0 THEN 'EUR' ELSE currency END AS currency, account_from, account_to FROM li UNION ALL SELECT currency, account_from, account_to FROM ev),
l AS (SELECT currency, account_from AS account FROM u UNION ALL SELECT currency, account_to FROM u) SELECT account, count(DISTINCT currency) AS currencies FROM l GROUP BY 1 HAVING count(DISTINCT currency) > 1"""


def lifetimes(spark, sf_dir):
    """Lifetime counts and sums as of each row, and means over a day."""
    d = explode_entities(pay_events(spark, sf_dir))
    w, day = kernels.lifetime(["entity"]), kernels.trailing(["entity"], DAY)
    return d.select("txn_id", "sign", F.count(F.lit(1)).over(w).alias("rows_so_far"), F.sum("amount_minor").over(w).alias("moved_so_far"), F.round(F.avg("amount_minor").over(day), 9).alias("mean_24h"))


_LIFE = f"""WITH {EV}, {EN} SELECT txn_id, sign, count(*) OVER w AS rows_so_far, CAST(sum(amount_minor) OVER w AS BIGINT) AS moved_so_far, round(avg(amount_minor) OVER d, 9) AS mean_24h FROM en
WINDOW w AS (PARTITION BY entity ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (PARTITION BY entity ORDER BY ts_us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)"""


QUERIES = {
    "features_graph_local": graph_local, "features_graph_global": graph_global, "features_graph_typology": graph_typology, "features_rule_derived": rule_derived,
    "account_frame": account_frame, "label_correlations": correlations, "feature_null_rates": nulls, "pooled_roles": roles, "mixed_currencies": currencies, "lifetime_features": lifetimes,
}
ORACLE = {
    "features_graph_local": _union(_local_sql), "features_graph_typology": _union(_typology_sql), "features_rule_derived": _union(_rules_sql), "account_frame": _FRAME,
    "label_correlations": _CORR, "feature_null_rates": _NULLS, "pooled_roles": _ROLES, "mixed_currencies": _currencies_sql(), "lifetime_features": _LIFE,
}
