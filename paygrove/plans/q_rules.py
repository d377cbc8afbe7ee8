"""Rule queries over pay_events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paygrove.operators import graph, rules
from paygrove.operators.rules import Settings
from paygrove.plans.q_graph import _ADJ, _LEGS, _NODES, CHAIN_CTE
from paygrove.plans.tables import DAY, EV, HOUR, pay_events
from paygrove.session import checkpoint, scratch_table

MIN = 60_000_000
#: Parameters that make each rule fire on these tables; all else is the defaults.
S = Settings(
    r1_least_minor=100, r2_k=11, r3_k=6, r5_pinned_minor=None, r6_z=2.5, r7_days=3, r7_k=2, r8_jump=0.15, r9_m=1.6, r11_c=5, r11_share=0.5, r4_cap=None,
    tau_percent=60.0,
)


def _plain(hits):
    return hits.select(
        "rule_id", "account_key", F.round("severity", 9).alias("severity"), F.round("observation", 9).alias("observation"), "window_start_us", "window_end_us",
        F.concat_ws(",", "txn_ids").alias("txn_ids"),
    )


def _excluded(e):
    return graph.typed(graph.nodes(e)).filter("node_type in ('rail', 'external')")


def _rule(rule: str):
    def run(spark, sf_dir):
        e = pay_events(spark, sf_dir)
        x = _excluded(e) if rule in ("R2", "R3") else None
        return _plain(rules.run_rules(e, S, excluded=x, only=(rule,)))

    return run


def _hit(rule: str, sev: str, obs: str, start: str, end: str, txns: str, src: str) -> str:
    return f"SELECT '{rule}' AS rule_id, account AS account_key, round(greatest(0.0, least(1.0, {sev})), 9) AS severity, round(CAST({obs} AS DOUBLE), 9) AS observation, CAST({start} AS BIGINT) AS window_start_us, CAST({end} AS BIGINT) AS window_end_us, array_to_string(list_sort({txns}), ',') AS txn_ids FROM {src}"


_L = "account <> peer"
_CL = lambda x: f"greatest(0.0, least(1.0, {x}))"

_R1 = f"""WITH {EV}, {_LEGS}, j AS (SELECT s.account, s.ts_us AS st, s.txn_id AS si, r.ts_us AS rt, r.txn_id AS ri, s.amount_minor / r.amount_minor AS q
  FROM lg s JOIN lg r ON s.account = r.account AND s.currency = r.currency AND s.side = 'out' AND r.side = 'in' AND r.ts_us BETWEEN s.ts_us - {60 * MIN} AND s.ts_us
  WHERE s.account <> s.peer AND r.account <> r.peer AND s.txn_type <> 'error' AND r.txn_type <> 'error' AND r.amount_minor >= 100 AND s.amount_minor > 0 AND s.amount_minor * 1000000 >= r.amount_minor * 800000),
b AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY q DESC, st, si, rt, ri) AS nth FROM j)
{_hit('R1', '(q - 0.8) / (1.0 - 0.8)', 'q', 'rt', 'st', '[ri, si]', 'b WHERE nth = 1')}"""


def _fan(rule: str, side: str, k: int, width: int, low: bool) -> str:
    return f"""WITH {_NODES}, l AS (SELECT * FROM lg WHERE {_L} AND side = '{side}' {'AND amount_minor <> 0' if low else ''} AND account NOT IN (SELECT account FROM nd WHERE node_type IN ('rail', 'external'))),
c AS (SELECT *, count(DISTINCT peer) OVER (PARTITION BY account ORDER BY ts_us RANGE BETWEEN {width} PRECEDING AND CURRENT ROW) AS k FROM l),
b AS (SELECT account, k, ts_us AS bt FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY k DESC, ts_us) AS nth FROM c) WHERE nth = 1),
tau AS (SELECT list_sort(list(amount_minor))[least(CAST(floor(0.6 * count(*)) AS BIGINT), count(*) - 1) + 1] AS tau FROM ev WHERE amount_minor <> 0),
w AS (SELECT l.account, b.k, min(ts_us) AS st, list_sort(list(amount_minor)) AS a, list(txn_id) AS t, count(*) AS n FROM l JOIN b USING (account) WHERE ts_us BETWEEN bt - {width} AND bt GROUP BY 1, 2)
{_hit(rule, f'(k - {k}.0) / {k}.0', 'k', 'st', f'st + {width}', 't', f"w, tau WHERE k >= {k}" + (" AND (a[(n + 1) // 2] + a[n // 2 + 1]) // 2 < tau" if low else ""))}"""


_R4 = f"""WITH RECURSIVE {EV}, {_ADJ},
w AS (SELECT [account_from, account_to] AS path, [txn_id] AS txns, [ts_us] AS ats, account_to AS last, ts_us AS now, amount_minor AS lo, amount_minor AS hi, false AS closed FROM ad
  UNION ALL SELECT list_append(path, account_to), list_append(txns, txn_id), list_append(ats, ts_us), account_to, ts_us, least(lo, amount_minor), greatest(hi, amount_minor), account_to = path[1]
  FROM w JOIN ad ON ad.account_from = w.last AND ts_us > now
  WHERE NOT closed AND len(txns) < 6 AND least(lo, amount_minor) * 1000000 >= greatest(hi, amount_minor) * 600000
    AND (NOT list_contains(path, account_to) OR (account_to = path[1] AND len(txns) >= 2))),
c AS (SELECT path[1:len(path) - 1] AS nodes, txns, ats, lo / hi AS keep, len(txns) AS len FROM w WHERE closed),
r AS (SELECT *, list_position(nodes, list_min(nodes)) AS i FROM c), g AS (SELECT *, list_concat(nodes[i:], nodes[1:i - 1]) AS ring FROM r),
p AS (SELECT a.ring FROM g a JOIN g b ON a.ring = b.ring AND b.ats[1] > a.ats[1] WHERE abs((b.ats[1] - a.ats[1]) - round((b.ats[1] - a.ats[1]) / {168 * HOUR}.0) * {168 * HOUR}) <= {168 * HOUR} * 0.05 GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY ring ORDER BY keep DESC, ats[1], txns) AS nth FROM g),
s AS (SELECT b.*, CASE WHEN p.ring IS NOT NULL THEN 0.3 ELSE 1 END AS f, unnest(b.ring) AS account FROM b LEFT JOIN p ON b.ring = p.ring WHERE nth = 1)
{_hit('R4', f"f * ({_CL('(keep - 0.6) / (1.0 - 0.6)')} + {_CL('(len - 3.0) / 3.0')}) / 2", 'keep', 'list_min(ats)', 'list_max(ats)', 'txns', 's')}"""

_MODE = f"""th AS (SELECT arg_max(t, (k, -t)) AS t FROM (SELECT a.amount_minor AS t, count(*) AS k FROM (SELECT DISTINCT amount_minor FROM ev WHERE amount_minor > 0) a
  JOIN ev b ON b.amount_minor > 0 AND b.amount_minor <= a.amount_minor AND b.amount_minor * 1000000 >= a.amount_minor * 800000 GROUP BY 1) WHERE k >= 3)"""
_R5 = f"""WITH {EV}, {_LEGS}, {_MODE},
l AS (SELECT lg.*, th.t, row_number() OVER (PARTITION BY account ORDER BY ts_us, txn_id) AS i, count(*) OVER (PARTITION BY account ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND {7 * DAY} FOLLOWING) AS e
  FROM lg, th WHERE {_L} AND side = 'out' AND amount_minor <> 0 AND amount_minor * 1000000 >= t * 800000 AND amount_minor <= t),
m AS (SELECT *, lag(e) OVER (PARTITION BY account ORDER BY i) AS pe FROM l), a AS (SELECT * FROM m WHERE e - i + 1 >= 3 AND (pe IS NULL OR e > pe)),
w AS (SELECT a.account, a.i, a.e, a.ts_us AS st, avg(l.amount_minor / l.t) AS tight, list(l.txn_id) AS t FROM a JOIN l ON l.account = a.account AND l.i BETWEEN a.i AND a.e GROUP BY ALL)
{_hit('R5', f"({_CL('(e - i + 1 - 3.0) / 3.0')} + {_CL('(tight - 0.8) / (1.0 - 0.8)')}) / 2", 'e - i + 1', 'st', f'st + {7 * DAY}', 't', 'w')}"""

_R6 = f"""WITH {EV}, {_LEGS}, l AS (SELECT *, event_date_local - DATE '1970-01-01' AS day FROM lg WHERE {_L}), d AS (SELECT account, day, count(*)::DOUBLE AS n FROM l GROUP BY 1, 2),
s AS (SELECT *, list(n) OVER (PARTITION BY account ORDER BY day RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS xs FROM d),
m AS (SELECT *, list_aggregate(xs, 'median') AS med FROM s WHERE len(xs) > 5), q AS (SELECT *, list_aggregate(list_transform(xs, lambda x: abs(x - med)), 'median') AS mad FROM m),
z AS (SELECT *, (n - med) / (1.4826 * mad) AS z FROM q WHERE mad > 0), b AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY z DESC, day) AS nth FROM z WHERE z >= 2.5),
t AS (SELECT b.account, b.z, b.day, list(l.txn_id) AS t FROM b JOIN l ON l.account = b.account AND l.day = b.day WHERE nth = 1 GROUP BY 1, 2, 3)
{_hit('R6', '(z - 2.5) / 2.5', 'z', f'day * {DAY}', f'(day + 1) * {DAY}', 't', 't')}"""

_R7 = f"""WITH {EV}, {_LEGS}, l AS (SELECT *, event_date_local - DATE '1970-01-01' AS day FROM lg WHERE {_L}), d AS (SELECT DISTINCT account, day FROM l),
g AS (SELECT *, day - lag(day) OVER (PARTITION BY account ORDER BY day) AS gap FROM d),
j AS (SELECT g.account, gap, g.day * {DAY} AS st, count(*) AS n, list(txn_id) AS t FROM g JOIN l ON l.account = g.account AND l.ts_us BETWEEN g.day * {DAY} AND g.day * {DAY} + {DAY} WHERE gap >= 3 GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY gap DESC, st) AS nth FROM j WHERE n >= 2)
{_hit('R7', f"({_CL('(n - 2.0) / 2.0')} + {_CL('(gap - 3) / 3.0')}) / 2", 'gap', 'st', f'st + {DAY}', 't', 'b WHERE nth = 1')}"""

_R8 = f"""WITH {EV}, {_LEGS}, l0 AS (SELECT *, event_date_local - DATE '1970-01-01' AS day FROM lg WHERE {_L}),
l AS (SELECT *, max(day) OVER (PARTITION BY account) AS last, count(*) OVER (PARTITION BY account) AS n FROM l0), r AS (SELECT *, day >= last - 6 AS recent FROM l WHERE n >= 10),
h AS (SELECT a.account, x.hour, count(r.txn_id) FILTER (WHERE NOT recent) AS b, count(r.txn_id) FILTER (WHERE recent) AS c FROM (SELECT DISTINCT account FROM r) a CROSS JOIN range(24) x(hour)
  LEFT JOIN r ON r.account = a.account AND r.local_hour = x.hour GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY b, hour) <= 2 AS quiet FROM h),
s AS (SELECT account, sum(b) AS nb, sum(c) AS nr, sum(CASE WHEN quiet THEN b ELSE 0 END) AS qb, sum(CASE WHEN quiet THEN c ELSE 0 END) AS qr FROM q GROUP BY 1),
j AS (SELECT *, qr::DOUBLE / nr::DOUBLE - qb::DOUBLE / nb::DOUBLE AS jump FROM s WHERE nb >= 10 AND nr > 0),
t AS (SELECT j.account, jump, last, list(txn_id) AS t, max(ts_us) AS e FROM j JOIN r ON j.account = r.account AND recent WHERE jump >= 0.15 GROUP BY 1, 2, 3)
{_hit('R8', '(jump - 0.15) / (1.0 - 0.15)', 'jump', f'(last - 6) * {DAY}', 'e', 't', 't')}"""

_R9 = f"""WITH {EV}, {_LEGS}, l0 AS (SELECT *, event_date_local - DATE '1970-01-01' AS day FROM lg WHERE {_L} AND amount_minor <> 0),
l AS (SELECT *, max(day) OVER (PARTITION BY account) AS last FROM l0), r AS (SELECT *, day >= last - 6 AS recent FROM l WHERE day >= last - 6 - 30),
m AS (SELECT account, currency, last, list_sort(list(amount_minor) FILTER (WHERE recent)) AS a, list_sort(list(amount_minor) FILTER (WHERE NOT recent)) AS b, list(txn_id) AS t FROM r GROUP BY 1, 2, 3),
q AS (SELECT *, ((a[(len(a) + 1) // 2] + a[len(a) // 2 + 1]) // 2) / ((b[(len(b) + 1) // 2] + b[len(b) // 2 + 1]) // 2) AS ratio FROM m WHERE len(a) > 0 AND len(b) > 0),
z AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY abs(ln(ratio)) DESC, currency) AS nth FROM q WHERE ratio > 0 AND (ratio < 1 / 1.6 OR ratio > 1.6))
{_hit('R9', '(abs(ln(ratio)) - ln(1.6)) / ln(1.6)', 'ratio', f'(last - 36) * {DAY}', f'(last + 1) * {DAY}', 't', 'z WHERE nth = 1')}"""

_R10 = f"""WITH {EV}, {_LEGS}, j AS (SELECT i.account, i.currency, i.ts_us AS it, i.txn_id AS ii, i.amount_minor AS ia, sum(o.amount_minor) AS total, max(o.ts_us) AS e, list(o.txn_id) AS t
  FROM lg i JOIN lg o ON i.account = o.account AND i.currency = o.currency AND i.side = 'in' AND o.side = 'out' AND o.ts_us BETWEEN i.ts_us AND i.ts_us + {6 * HOUR}
  WHERE i.account <> i.peer AND o.account <> o.peer AND i.amount_minor <> 0 AND o.amount_minor <> 0 AND o.txn_type = 'purchase' GROUP BY ALL),
b AS (SELECT *, total::DOUBLE / ia AS q, row_number() OVER (PARTITION BY account ORDER BY total::DOUBLE / ia DESC, currency, it, ii) AS nth FROM j WHERE total * 1000000 >= ia * 700000)
{_hit('R10', '(q - 0.7) / (1.0 - 0.7)', 'q', 'it', 'e', 'list_append(t, ii)', 'b WHERE nth = 1')}"""

_R11 = f"""WITH {EV}, {_LEGS}, l AS (SELECT * FROM lg WHERE {_L}), f AS (SELECT account, peer, min(ts_us) AS f FROM l GROUP BY 1, 2),
c AS (SELECT account, ts_us, min(ts_us) OVER w AS st, count(DISTINCT peer) OVER w AS active FROM l WINDOW w AS (PARTITION BY account ORDER BY ts_us RANGE BETWEEN {48 * HOUR} PRECEDING AND CURRENT ROW)),
x AS (SELECT account, ts_us, st, active, (SELECT count(*) FROM f WHERE f.account = c.account AND f.f BETWEEN c.st AND c.st + {48 * HOUR}) AS fresh FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY fresh DESC, st, active DESC) AS nth FROM x),
t AS (SELECT b.account, fresh, st, list(txn_id) AS t FROM b JOIN l ON l.account = b.account AND l.ts_us BETWEEN st AND st + {48 * HOUR} WHERE nth = 1 AND fresh >= 5 AND fresh / active >= 0.5 GROUP BY 1, 2, 3)
{_hit('R11', '(fresh - 5.0) / 5.0', 'fresh', 'st', f'st + {48 * HOUR}', 't', 't')}"""

_R12 = f"""WITH RECURSIVE {EV}, {_ADJ}, {CHAIN_CTE},
s AS (SELECT *, list_sum(list_transform(range(1, len(amounts)), lambda i: least(1.0, amounts[i + 1] / amounts[i] / 0.95))) / (len(amounts) - 1) AS fid, unnest(path) AS account FROM ch)
{_hit('R12', f"({_CL('(len(txns) - 3.0) / 3.0')} + fid) / 2", 'len(txns)', 'begun', 'now', 'txns', 's')}"""

_SQL = {
    "R1": _R1, "R2": _fan("R2", "in", 11, 24 * HOUR, True), "R3": _fan("R3", "out", 6, 24 * HOUR, False), "R4": _R4, "R5": _R5, "R6": _R6, "R7": _R7, "R8": _R8, "R9": _R9,
    "R10": _R10, "R11": _R11, "R12": _R12,
}


def tau(spark, sf_dir):
    return rules.tau(pay_events(spark, sf_dir))


def mode(spark, sf_dir):
    return rules.structuring_threshold(pay_events(spark, sf_dir))


def _all_rules(e):
    """Hits of all twelve rules on written events."""
    return rules.run_rules(e, S, excluded=_excluded(e))


_ALL = " UNION ALL ".join(f"SELECT * FROM ({q})" for q in _SQL.values())


def overlaps(spark, sf_dir):
    return rules.overlaps(_all_rules(scratch_table(pay_events(spark, sf_dir), "events"))).select("account_key", "overlap_group", "members", F.concat_ws(",", "rule_ids").alias("rule_ids"), F.round("severity", 9).alias("severity"))


_GROUPS = " ".join(f"WHEN rule_id IN ({', '.join(repr(r) for r in rs)}) THEN '{g}'" for g, rs in rules.OVERLAP.items())
_OVER = f"""WITH u AS ({_ALL}), g AS (SELECT *, CASE {_GROUPS} END AS g FROM u)
SELECT account_key, g AS overlap_group, count(*) AS members, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rule_ids, max(severity) AS severity FROM g WHERE g IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2"""


def rates(spark, sf_dir):
    e = scratch_table(pay_events(spark, sf_dir), "events")
    n = graph.nodes(e).count()
    return rules.hit_rates(_all_rules(e), n, S).withColumn("hit_rate", F.round("hit_rate", 9)).withColumn("suggested_threshold", F.round("suggested_threshold", 9))


_RATES = f"""WITH {EV}, na AS (SELECT count(*) AS n FROM (SELECT account_from FROM ev UNION SELECT account_to FROM ev)),
h AS ({_ALL}),
p AS (SELECT rule_id, account_key, max(observation) AS o FROM h GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY o DESC, account_key) AS k FROM p),
a AS (SELECT rule_id, count(*) AS c, max(CASE WHEN k = greatest(1, CAST(floor(0.33 * n) AS BIGINT)) THEN o END) AS o FROM r, na GROUP BY 1),
e AS (SELECT unnest(['R1','R2','R3','R4','R5','R6','R7','R8','R9','R10','R11','R12']) AS rule_id)
SELECT e.rule_id, coalesce(c, 0) AS accounts_hit, round(coalesce(c, 0) / n, 9) AS hit_rate,
  CASE WHEN c IS NULL THEN 'dead' WHEN c / n > 0.33 THEN 'above_ceiling' WHEN c / n < 0.0001 THEN 'below_floor' ELSE 'ok' END AS state, CASE WHEN c / n > 0.33 THEN o END AS suggested_threshold
FROM e LEFT JOIN a USING (rule_id), na"""


def windows(spark, sf_dir):
    return rules.analysis_windows(pay_events(spark, sf_dir), 10)


_WINDOWS = f"""WITH {EV}, t AS (SELECT min(ts_us) AS a, max(ts_us) AS z FROM ev), w AS (SELECT a, z, unnest(generate_series(a, z, {10 * DAY})) AS t FROM t)
SELECT CAST((t - a) // {10 * DAY} AS INT) AS window, greatest(a, t - {168 * HOUR}) AS start_us, least(t + {10 * DAY - 1}, z) AS end_us FROM w"""


def seen_twice(spark, sf_dir):
    """R10 per overlapping analysis window, then one hit per pattern, and the earliest."""
    e = pay_events(spark, sf_dir)
    per = checkpoint(rules.in_windows(e, rules.analysis_windows(e, 10), S, ("R10",)))
    first = rules.dedupe_windows(per).select("rule_id", "account_key", "hit_signature", "window")
    return rules.dedupe(per).join(first, ["rule_id", "account_key", "hit_signature"]).select(
        "rule_id", "account_key", "windows_observed", "window", F.round("severity", 9).alias("severity"), F.concat_ws(",", "txn_ids").alias("txn_ids"))


_EVW = EV.replace("ev AS (", "ev_all AS (", 1) + f""", wn AS ({_WINDOWS.replace("WITH " + EV + ", t AS", "WITH t AS").replace("FROM ev)", "FROM ev_all)")}),
ev AS (SELECT e.* REPLACE (w."window" || '|' || account_from AS account_from, w."window" || '|' || account_to AS account_to) FROM ev_all e JOIN wn w ON ts_us BETWEEN start_us AND end_us)"""
_DEDUP = f"""WITH h AS ({_SQL['R10'].replace(EV, _EVW)}), x AS (SELECT rule_id, CAST(split_part(account_key, '|', 1) AS INT) AS "window", split_part(account_key, '|', 2) AS account_key, severity, window_start_us, txn_ids FROM h)
SELECT rule_id, account_key, count(*) AS windows_observed, min("window") AS "window", max(severity) AS severity, txn_ids FROM x GROUP BY rule_id, account_key, txn_ids"""


def flagship(spark, sf_dir):
    """Fan-in hits joined to three window features of the account's latest event."""
    from paygrove.operators import features
    from paygrove.operators.registry import FEATURES

    e = pay_events(spark, sf_dir)
    names = ("txn_count_in_24h", "amount_in_30d_minor", "lifetime_counterparties")
    hits = checkpoint(_plain(rules.run_rules(e, S, excluded=_excluded(e), only=("R2",))))
    m = features.build(e, [f for f in FEATURES if f.name in names], entities=hits.select(F.col("account_key").alias("entity")))
    last = m.groupBy("entity").agg(F.max_by(F.struct(*names), F.struct("ts_us", "txn_id", "sign")).alias("f")).select(F.col("entity").alias("account_key"), "f.*")
    return hits.join(last, "account_key").select("account_key", "severity", "observation", "window_start_us", *names)


_FLAG = f"""WITH h AS ({_SQL['R2']}), {EV}, en AS (SELECT account_from AS entity, account_to AS cp, -1 AS sign, ts_us, txn_id, amount_minor FROM ev UNION ALL SELECT account_to, account_from, 1, ts_us, txn_id, amount_minor FROM ev),
x AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY ts_us DESC, txn_id DESC, sign DESC) AS nth, count(*) OVER (PARTITION BY entity ORDER BY ts_us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS c,
  coalesce(sum(CASE WHEN sign > 0 THEN amount_minor END) OVER (PARTITION BY entity ORDER BY ts_us RANGE BETWEEN {30 * DAY} PRECEDING AND CURRENT ROW), 0) AS s,
  count(DISTINCT CASE WHEN entity <> cp THEN cp END) OVER (PARTITION BY entity) AS d FROM en)
SELECT account_key, severity, observation, window_start_us, c AS txn_count_in_24h, CAST(s AS BIGINT) AS amount_in_30d_minor, d AS lifetime_counterparties FROM h JOIN x ON x.entity = h.account_key AND nth = 1"""

QUERIES = {f"rule_{r.lower()}": _rule(r) for r in _SQL} | {
    "rule_tau": tau, "rule_structuring_threshold": mode, "rule_overlaps": overlaps, "rule_hit_rates": rates, "rule_windows": windows, "rule_window_dedup": seen_twice,
    "flagship_fan_in_features": flagship,
}
ORACLE = {f"rule_{r.lower()}": q for r, q in _SQL.items()} | {
    "rule_tau": f"WITH {EV} SELECT list_sort(list(amount_minor))[least(CAST(floor(0.25 * count(*)) AS BIGINT), count(*) - 1) + 1] AS tau_minor FROM ev WHERE amount_minor <> 0",
    "rule_structuring_threshold": f"WITH {EV}, {_MODE} SELECT t AS threshold_minor FROM th", "rule_overlaps": _OVER, "rule_hit_rates": _RATES, "rule_windows": _WINDOWS, "rule_window_dedup": _DEDUP,
    "flagship_fan_in_features": _FLAG,
}
