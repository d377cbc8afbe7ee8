"""Feature queries over pay_events; the SQL is written from the declarations with RANGE frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from paygrove.operators import entity, features, kernels
from paygrove.operators.registry import FEATURES, Feature
from paygrove.plans.tables import DAY, EV, HOUR, pay_events

_PRED = {
    "always": "true", "zero_amount": "amount_minor = 0", "is_nonzero": "amount_minor <> 0", "is_inflow": "sign > 0", "is_outflow": "sign < 0",
    "is_inflow_nonzero": "sign > 0 AND amount_minor <> 0", "is_outflow_nonzero": "sign < 0 AND amount_minor <> 0",
    "is_inflow_not_self": "sign > 0 AND NOT is_self", "is_outflow_not_self": "sign < 0 AND NOT is_self", "self_transfer": "is_self",
    "not_self_transfer": "NOT is_self", "reversal_txn": "txn_type = 'error'", "has_prior_event": "gap_since_previous_event_s IS NOT NULL",
    "has_balance": "balance_after IS NOT NULL", "has_balance_delta": "balance_delta_abs_minor IS NOT NULL",
    "balance_delta_mismatch": "balance_delta_abs_minor > 0", "zero_balance_after": "balance_after = 0",
    "overnight_local_hour": "local_hour IN (0, 1, 2, 3, 4, 5)", "weekend_local_date": "isodow(event_date_local) >= 6", "late_arrival": "false",
}

EN = """
en0 AS (
  SELECT txn_id, ts_us, txn_type, currency, amount_minor, event_date_local, local_hour, account_from AS entity, account_to AS counterparty, -1 AS sign, 'out' AS direction,
         src_balance_before_minor AS balance_before, src_balance_after_minor AS balance_after, account_from = account_to AS is_self FROM ev
  UNION ALL
  SELECT txn_id, ts_us, txn_type, currency, amount_minor, event_date_local, local_hour, account_to, account_from, 1, 'in', dst_balance_before_minor, dst_balance_after_minor,
         account_from = account_to FROM ev),
en AS (
  SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY entity ORDER BY ts_us, txn_id, sign)) // 1000000 AS gap_since_previous_event_s,
         (ts_us - lag(ts_us) OVER (PARTITION BY entity ORDER BY ts_us, txn_id, sign)) // 86400000000 AS gap_since_previous_event_days,
         abs(balance_after - balance_before - sign * amount_minor) AS balance_delta_abs_minor FROM en0)"""


def _sql_of(f: Feature) -> str:
    names = {x.name for x in FEATURES}
    ok = f'"{f.where}"' if f.where in names and f.where not in _PRED else _PRED.get(f.where, "true")
    keys = ", ".join(f.keys)
    over = lambda lo: f"OVER (PARTITION BY {keys} ORDER BY ts_us RANGE BETWEEN {lo} PRECEDING AND CURRENT ROW)"
    x = f.source
    if f.kind == "flag":
        return _PRED[f.source]
    if f.kind == "row_value":
        return x
    if f.kind == "code":
        return f"CAST(list_position({features.CODES[x]!r}, {x}) - 1 AS INT)"
    if f.kind == "count":
        return f"count(*) FILTER (WHERE {ok}) {over(f.width)}"
    if f.kind == "sum":
        return f"CAST(coalesce(sum(CASE WHEN {ok} THEN {x} END) {over(f.width)}, 0) AS BIGINT)"
    if f.kind == "max":
        return f"max(CASE WHEN {ok} THEN {x} END) {over(f.width - 1)}"
    if f.kind == "median":
        return f"list_extract(list_sort(list(CASE WHEN {ok} THEN {x} END) {over(f.width - 1)}), CAST(floor(0.5 * (count(CASE WHEN {ok} THEN {x} END) {over(f.width - 1)} - 1)) AS BIGINT) + 1)"
    if f.kind == "distinct":
        return f"count(DISTINCT {x}) {over(f.width - 1)}"
    if f.kind == "lifetime_distinct":
        return f"count(DISTINCT CASE WHEN {ok} THEN {x} END) {over('UNBOUNDED')}"
    if f.kind == "first_ever":
        return f"CAST(({ok}) AND count(*) FILTER (WHERE {ok}) OVER (PARTITION BY {keys}, {x} ORDER BY ts_us, txn_id, sign ROWS UNBOUNDED PRECEDING) = 1 AS BIGINT)"
    if f.kind == "mean_int":
        return f"CAST(sum(CASE WHEN {ok} THEN {x} END) {over(f.width)} // count(CASE WHEN {ok} THEN {x} END) {over(f.width)} AS BIGINT)"
    if f.kind == "age_days":
        return f"(ts_us - min(ts_us) OVER (PARTITION BY {keys})) // {DAY}"
    if f.kind == "recency_hours":
        return f"(ts_us - max(CASE WHEN {ok} THEN ts_us END) {over('UNBOUNDED')}) // {HOUR}"
    if f.kind == "difference":
        return f"{x} - {f.args[0]}"
    if f.kind == "quotient":
        return f"CASE WHEN {f.args[0]} > 0 THEN CAST(sign({x}) AS BIGINT) * ((abs({x}) * {f.args[1]}) // {f.args[0]}) END"
    if f.kind == "benford":
        m = f"CASE WHEN {ok} AND {x} > 0 THEN CAST(round((log10({x}) - floor(log10({x}))) * 1e6) AS BIGINT) END"
        return f"2 * abs(CAST(sum({m}) {over(f.width)} AS DOUBLE) / nullif(count({m}) {over(f.width)}, 0) / 1e6 - 0.5)"
    v = f"CASE WHEN {ok} THEN {x} END"
    n, s = f"CAST(count({v}) {over(f.width)} AS DOUBLE)", f"CAST(sum({v}) {over(f.width)} AS DOUBLE)"
    hn, hs, hq = f"CAST(count({v}) {over(f.width)} AS HUGEINT)", f"sum(CAST({v} AS HUGEINT)) {over(f.width)}", f"sum(CAST({v} AS HUGEINT) * {v}) {over(f.width)}"
    spread = f"(CAST({hn} * {hq} - {hs} * {hs} AS DOUBLE) / {n})"  # exact up to here
    floor = f"(8 * 2.220446049250313e-16::DOUBLE * {n} * greatest(CAST({hq} AS DOUBLE), {s} * {s} / {n}))"
    zero = f"(abs({hs}) <= 67108864 AND {hq} <= 9007199254740992 AND {spread} = 0)"
    std = f"(CASE WHEN {n} >= 2 AND ({spread} > {floor} OR {zero}) THEN sqrt({spread} / ({n} - 1)) END)"
    mean = f"({s} / nullif({n}, 0))"
    if f.kind == "burstiness":
        return f"CASE WHEN {std} + {mean} <> 0 THEN ({std} - {mean}) / ({std} + {mean}) END"
    if f.kind == "robust_z":
        return f"CASE WHEN {std} > 0 AND {x} <> 0 THEN ({x} - {mean}) / {std} END"
    raise ValueError(f.kind)


def _needed(group: str) -> list[Feature]:
    by = {f.name: f for f in FEATURES}
    want = [f for f in FEATURES if f.group == group and f.kind not in ("graph", "rule")]
    out: dict[str, Feature] = {}

    def add(f: Feature) -> None:
        for n in f.needs:
            if n in by and n != f.name and n not in out:
                add(by[n])
        out[f.name] = f

    for f in want:
        add(f)
    return [f for f in FEATURES if f.name in out]


def _query(group: str):
    fs = _needed(group)

    def run(spark, sf_dir):
        d = features.build(pay_events(spark, sf_dir), fs)
        doubles = [c for c, t in d.dtypes if t == "double" and not c.startswith("benford")]
        return d.withColumns({c: F.round(c, 9) for c in doubles})

    return run


def _sql(group: str) -> str:
    fs = _needed(group)
    rows = ("balance_delta_abs_minor", "gap_since_previous_event_s")
    sql, at = f"WITH {EV}, {EN}", "en"
    placed: set[str] = set()
    k = 0
    left = list(fs)
    while left:
        ready = [f for f in left if all(n not in {x.name for x in left} or n == f.name for n in f.needs)]
        cols = [f'{_sql_of(f)} AS "{f.name}"' for f in ready if f.name not in rows]
        sql += f", f{k} AS (SELECT *{''.join(', ' + c for c in cols)} FROM {at})"
        at, k = f"f{k}", k + 1
        placed |= {f.name for f in ready}
        left = [f for f in left if f.name not in placed]
    kinds = {f.name: f.kind for f in fs}
    out = [f'round("{f.name}", 9) AS "{f.name}"' if kinds[f.name] in ("burstiness", "robust_z") else f'"{f.name}"' for f in fs]
    return f"{sql} SELECT txn_id, ts_us, entity, counterparty, direction, sign, currency, {', '.join(out)} FROM {at}"


def forward(spark, sf_dir):
    """Forward window, minimum, lower quantile and exact standard deviation kernels."""
    d = entity.row_values(entity.explode_entities(pay_events(spark, sf_dir)))
    x = F.col("amount_minor")
    d = d.select("txn_id", "sign", "entity", "ts_us", "amount_minor", kernels.forward_sum(x, ["entity"], DAY).alias("next_24h"))
    d = kernels.window_orders(d, ["entity"], {"min_24h": (x, 0.0, DAY), "q90_24h": (x, 0.9, DAY)})
    return d.select("txn_id", "sign", "next_24h", "min_24h", "q90_24h")


_FORWARD = f"""WITH {EV}, {EN}
SELECT txn_id, sign, CAST(coalesce(sum(amount_minor) OVER (PARTITION BY entity ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND {DAY - 1} FOLLOWING), 0) AS BIGINT) AS next_24h,
  min(amount_minor) OVER w AS min_24h, list_extract(list_sort(list(amount_minor) OVER w), CAST(floor(0.9 * (count(amount_minor) OVER w - 1)) AS BIGINT) + 1) AS q90_24h
FROM en WINDOW w AS (PARTITION BY entity ORDER BY ts_us RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW)"""


def reversals(spark, sf_dir):
    d = entity.link_reversals(pay_events(spark, sf_dir))
    return d.filter(F.col("txn_type").isin(*entity.REVERSALS)).select("txn_id", "reversal_of")


_REVERSALS = f"""WITH {EV}, p AS (SELECT * FROM ev WHERE txn_type = 'error'),
o AS (SELECT p.txn_id, arg_max(e.txn_id, (e.ts_us, e.txn_id)) AS reversal_of FROM p JOIN ev e ON e.txn_type <> 'error' AND e.account_from = p.account_to AND e.account_to = p.account_from AND e.ts_us < p.ts_us GROUP BY 1)
SELECT p.txn_id, o.reversal_of FROM p LEFT JOIN o USING (txn_id)"""


def asof_balance(spark, sf_dir):
    """As-of carry: the account's latest purchase amount at each view, at most two days old."""
    e = pay_events(spark, sf_dir).withColumnRenamed("account_from", "entity")
    left = e.filter("txn_type = 'view'").select("txn_id", "entity", "ts_us")
    right = e.filter("txn_type = 'purchase'").select("entity", "ts_us", F.col("amount_minor").alias("last_purchase"))
    return kernels.asof_carry(left, right, ["entity"], "last_purchase", tolerance=2 * DAY)


_ASOF = f"""WITH {EV}, l AS (SELECT txn_id, account_from AS entity, ts_us FROM ev WHERE txn_type = 'view'),
r AS (SELECT account_from AS entity, ts_us AS rt, amount_minor FROM ev WHERE txn_type = 'purchase')
SELECT txn_id, l.entity, ts_us, CASE WHEN ts_us - rt <= {2 * DAY} THEN amount_minor END AS last_purchase FROM l ASOF LEFT JOIN r ON l.entity = r.entity AND l.ts_us >= r.rt"""


def late_arrivals(spark, sf_dir):
    """Counts under a seal: rows before it that came in after it stay out of all windows."""
    e = pay_events(spark, sf_dir)
    e = e.withColumn("ingested_us", F.col("ts_us") + F.when(F.col("event_id") % 7 == 0, 3 * DAY).otherwise(0))
    seal = 1_705_276_800_000_000  # 2024-01-15
    fs = [f for f in FEATURES if f.name in ("txn_count_in_24h", "amount_out_24h_minor")]
    return features.build(e, fs, sealed_us=seal).select("txn_id", "sign", "txn_count_in_24h", "amount_out_24h_minor")


_LATE = f"""WITH {EV}, {EN}, s AS (SELECT *, ts_us <= 1705276800000000 AND ts_us + CASE WHEN CAST(substr(txn_id, 4) AS BIGINT) % 7 = 0 THEN {3 * DAY} ELSE 0 END > 1705276800000000 AS late FROM en)
SELECT txn_id, sign, count(*) FILTER (WHERE NOT late) OVER w AS txn_count_in_24h, CAST(coalesce(sum(CASE WHEN sign < 0 AND amount_minor <> 0 AND NOT late THEN amount_minor END) OVER w, 0) AS BIGINT) AS amount_out_24h_minor
FROM s WINDOW w AS (PARTITION BY entity ORDER BY ts_us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)"""


def winsor(spark, sf_dir):
    e = pay_events(spark, sf_dir)
    b = features.winsor_bounds(e.filter("ts_us < 1705276800000000"), ["amount_minor", "local_hour"])
    return features.winsorise(e.select("txn_id", "amount_minor", "local_hour"), b, ["amount_minor", "local_hour"])


_WINSOR = f"""WITH {EV}, t AS (SELECT * FROM ev WHERE ts_us < 1705276800000000),
b AS (SELECT list_sort(list(amount_minor)) AS a, list_sort(list(local_hour)) AS h, count(*) AS n FROM t),
c AS (SELECT a[CAST(floor(0.01 * (n - 1)) AS BIGINT) + 1] AS alo, a[CAST(floor(0.99 * (n - 1)) AS BIGINT) + 1] AS ahi, h[CAST(floor(0.01 * (n - 1)) AS BIGINT) + 1] AS hlo, h[CAST(floor(0.99 * (n - 1)) AS BIGINT) + 1] AS hhi FROM b)
SELECT txn_id, CAST(greatest(least(amount_minor, ahi), alo) AS DOUBLE) AS amount_minor, CAST(greatest(least(local_hour, hhi), hlo) AS DOUBLE) AS local_hour FROM ev, c"""

GROUPS = ("volume_value", "counterparty", "temporal", "balance_proxy", "exposure")
QUERIES = {f"features_{g}": _query(g) for g in GROUPS} | {
    "kernels_forward_quantile": forward, "reversal_links": reversals, "asof_carry": asof_balance, "features_sealed_late": late_arrivals,
    "features_winsorised": winsor,
}
ORACLE = {f"features_{g}": _sql(g) for g in GROUPS} | {
    "kernels_forward_quantile": _FORWARD, "reversal_links": _REVERSALS, "asof_carry": _ASOF, "features_sealed_late": _LATE,
    "features_winsorised": _WINSOR,
}
