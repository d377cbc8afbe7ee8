"""Graph queries over pay_events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paygrove.operators import graph, paths
from paygrove.plans.tables import DAY, EV, LI, pay_events, pay_lineitem

CUTOFF = 1_705_276_800_000_000  # 2024-01-15
START, END = 1_704_412_800_000_000, 1_705_017_600_000_000  # a week in January


def _typed(spark, sf_dir):
    return graph.typed(graph.nodes(pay_events(spark, sf_dir)))


def nodes(spark, sf_dir):
    return _typed(spark, sf_dir)


_LEGS = """lg AS (SELECT account_from AS account, account_to AS peer, 'out' AS side, ts_us, txn_id, txn_type, amount_minor, currency, event_date_local, local_hour FROM ev
  UNION ALL SELECT account_to, account_from, 'in', ts_us, txn_id, txn_type, amount_minor, currency, event_date_local, local_hour FROM ev)"""

_NODES = f"""{EV}, {_LEGS}, n0 AS (
  SELECT account, count(*) FILTER (WHERE side = 'in' AND account <> peer) AS in_degree, count(*) FILTER (WHERE side = 'out' AND account <> peer) AS od,
    count(*) FILTER (WHERE account <> peer) AS total_degree, count(DISTINCT peer) FILTER (WHERE side = 'in' AND account <> peer) AS fan_in,
    count(DISTINCT peer) FILTER (WHERE side = 'out' AND account <> peer) AS fo, count(DISTINCT peer) FILTER (WHERE account <> peer) AS counterparties,
    count(*) FILTER (WHERE side = 'out' AND account = peer) AS self_transfer_count, bool_or(side = 'out') AS is_originator, min(ts_us) AS first_ts_us, max(ts_us) AS last_ts_us
  FROM lg GROUP BY 1),
rd AS (SELECT list_sort(list(total_degree))[least(CAST(floor(0.99 * count(*)) AS BIGINT), count(*) - 1) + 1] AS rail_degree FROM n0),
nd AS (SELECT account, in_degree, CASE WHEN is_originator THEN od END AS out_degree, total_degree, fan_in, CASE WHEN is_originator THEN fo END AS fan_out, counterparties,
    self_transfer_count, is_originator, first_ts_us, last_ts_us, rail_degree,
    CASE WHEN total_degree > rail_degree THEN 'rail' WHEN NOT is_originator THEN 'external' ELSE 'member' END AS node_type,
    total_degree > rail_degree AS is_rail, NOT is_originator AS is_external, counterparties = 0 AS is_singleton FROM n0, rd)"""


def pairs(spark, sf_dir):
    d = graph.pairs(pay_events(spark, sf_dir))
    return d.withColumn("txn_types", F.concat_ws(",", "txn_types"))


_PAIRS = f"""WITH {EV} SELECT account_from, account_to, currency, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS total_minor, min(amount_minor) AS min_minor, max(amount_minor) AS max_minor,
  min(ts_us) AS first_ts_us, max(ts_us) AS last_ts_us, arg_min(txn_id, (ts_us, txn_id)) AS first_txn_id, arg_max(txn_id, (ts_us, txn_id)) AS last_txn_id,
  string_agg(DISTINCT txn_type, ',' ORDER BY txn_type) AS txn_types, account_from = account_to AS is_self FROM ev GROUP BY ALL"""


def undirected(spark, sf_dir):
    return graph.undirected_pairs(pay_events(spark, sf_dir))


_UND = f"WITH {EV} SELECT least(account_from, account_to) AS a, greatest(account_from, account_to) AS b, count(*) AS n FROM ev WHERE account_from <> account_to GROUP BY 1, 2"


def self_totals(spark, sf_dir):
    return graph.self_transfer_totals(pay_events(spark, sf_dir))


_SELF = f"WITH {EV} SELECT currency, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS total_minor FROM ev WHERE account_from = account_to GROUP BY 1"


def degrees(spark, sf_dir):
    return graph.degree_summary(_typed(spark, sf_dir))


_DEG = f"WITH {_NODES} SELECT count(*) AS n, quantile_disc(total_degree, 0.5) AS median, quantile_disc(total_degree, 0.9) AS p90, quantile_disc(total_degree, 0.99) AS p99, max(total_degree) AS max FROM nd"


def top(spark, sf_dir):
    return graph.top_degree(_typed(spark, sf_dir), 10)


def effective(spark, sf_dir):
    e = pay_events(spark, sf_dir)
    return graph.effective_fan(graph.typed(graph.nodes(e)), graph.links(e))


_EFF = f"""WITH {_NODES} SELECT nd.account, count(DISTINCT CASE WHEN side = 'in' THEN peer END) AS fan_in_effective, count(DISTINCT CASE WHEN side = 'out' THEN peer END) AS fan_out_effective
FROM nd LEFT JOIN (SELECT * FROM lg WHERE account <> peer AND peer NOT IN (SELECT account FROM nd WHERE is_rail)) l USING (account) GROUP BY 1"""


def flows(spark, sf_dir):
    return graph.flows(pay_events(spark, sf_dir))


def flows_window(spark, sf_dir):
    return graph.flows(pay_events(spark, sf_dir), START, END)


def _flows_sql(where: str) -> str:
    return f"""WITH {EV}, {_LEGS} SELECT account, currency, CAST(sum(CASE WHEN side = 'in' THEN amount_minor ELSE 0 END) AS BIGINT) AS in_total_minor, count(*) FILTER (WHERE side = 'in') AS in_count,
  max(CASE WHEN side = 'in' THEN amount_minor END) AS in_max_minor, CAST(sum(CASE WHEN side = 'out' THEN amount_minor END) AS BIGINT) AS out_total_minor,
  nullif(count(*) FILTER (WHERE side = 'out'), 0) AS out_count, max(CASE WHEN side = 'out' THEN amount_minor END) AS out_max_minor
FROM lg WHERE account <> peer {where} GROUP BY 1, 2"""


def density(spark, sf_dir):
    return graph.local_density(pay_events(spark, sf_dir)).withColumn("local_density", F.round("local_density", 9))


_DENS = f"""WITH {EV}, u AS (SELECT DISTINCT least(account_from, account_to) AS a, greatest(account_from, account_to) AS b FROM ev WHERE account_from <> account_to),
s AS (SELECT a AS v, b AS w FROM u UNION ALL SELECT b, a FROM u), d AS (SELECT v, count(*) AS d FROM s GROUP BY 1),
k AS (SELECT x.v, count(*) AS k FROM s x JOIN s y ON x.v = y.v AND x.w < y.w JOIN u ON u.a = x.w AND u.b = y.w GROUP BY 1)
SELECT d.v AS account, coalesce(k, 0) AS density_links, d * (d - 1) // 2 AS density_possible, round(CASE WHEN d > 1 THEN coalesce(k, 0) / (d * (d - 1) // 2) ELSE 0 END, 9) AS local_density,
  CASE WHEN d > 1 THEN CAST(round_even(coalesce(k, 0) * 10000.0::DOUBLE / (d * (d - 1) // 2), 0) AS BIGINT) ELSE 0 END AS local_density_bps FROM d LEFT JOIN k USING (v)"""


def comps(spark, sf_dir):
    """Components of both sources' accounts in one graph."""
    e = pay_events(spark, sf_dir).select("account_from", "account_to").unionByName(pay_lineitem(spark, sf_dir).select("account_from", "account_to"))
    return graph.components(e)


def _comps_sql(rounds: int = 12) -> str:
    # the smallest label among neighbours, as often as these graphs are deep
    sql = f"""WITH {EV}, {LI}, u AS (SELECT account_from AS a, account_to AS b FROM ev UNION SELECT account_from, account_to FROM li), s AS (SELECT a, b FROM u WHERE a <> b UNION SELECT b, a FROM u WHERE a <> b),
c0 AS (SELECT DISTINCT a AS node, a AS c FROM s)"""
    for k in range(rounds):
        sql += f", c{k + 1} AS (SELECT s.a AS node, least(min(x.c), min(y.c)) AS c FROM s JOIN c{k} x ON x.node = s.a JOIN c{k} y ON y.node = s.b GROUP BY 1)"
    return sql + f" SELECT node, c AS component FROM c{rounds}"


def ranks(spark, sf_dir):
    return graph.pagerank(pay_events(spark, sf_dir), tolerance=1e-12).withColumn("pagerank", F.round("pagerank", 9))


def _rank_sql(rounds: int = 40, alpha: float = 0.85) -> str:
    sql = f"""WITH {EV}, e0 AS (SELECT account_from AS s, account_to AS t, count(*)::DOUBLE AS w FROM ev WHERE account_from <> account_to GROUP BY 1, 2),
e AS (SELECT s, t, w / sum(w) OVER (PARTITION BY s) AS p FROM e0), v AS (SELECT s AS account FROM e UNION SELECT t FROM e), n AS (SELECT count(*)::DOUBLE AS n FROM v),
r0 AS (SELECT account, 1 / n AS r FROM v, n)"""
    for k in range(rounds):
        sql += f""", l{k} AS (SELECT coalesce(sum(r), 0) AS lost FROM r{k} WHERE account NOT IN (SELECT s FROM e)),
g{k} AS (SELECT t, sum(p * r) AS g FROM e JOIN r{k} ON e.s = r{k}.account GROUP BY 1),
r{k + 1} AS (SELECT v.account, ({1 - alpha} + {alpha} * lost) / n + {alpha} * coalesce(g, 0) AS r FROM v CROSS JOIN n CROSS JOIN l{k} LEFT JOIN g{k} ON v.account = g{k}.t)"""
    return sql + f" SELECT account, round(r, 9) AS pagerank FROM r{rounds}"


def cores(spark, sf_dir):
    return graph.k_core(pay_events(spark, sf_dir))


def comm(spark, sf_dir):
    return graph.communities(pay_events(spark, sf_dir))


def between(spark, sf_dir):
    return graph.betweenness(pay_events(spark, sf_dir)).withColumn("betweenness_approx", F.round("betweenness_approx", 9))


def downstream(spark, sf_dir):
    return graph.downstream_outflow(pay_events(spark, sf_dir), CUTOFF)


_DOWN = f"""WITH {EV}, e AS (SELECT * FROM ev WHERE account_from <> account_to AND ts_us <= {CUTOFF}), o AS (SELECT account_from AS x, sum(amount_minor) AS o FROM e WHERE ts_us > {CUTOFF - DAY} GROUP BY 1),
h AS (SELECT account_from AS account, account_to AS x FROM e UNION SELECT account_from, account_from FROM e)
SELECT account, CAST(coalesce(sum(o), 0) AS BIGINT) AS downstream_outflow_24h_minor FROM h LEFT JOIN o USING (x) GROUP BY 1"""


def reach(spark, sf_dir):
    e = pay_events(spark, sf_dir)
    n = graph.typed(graph.nodes(e))
    return graph.reachable(e, n.select("account"), 2, n.filter("is_rail"))


_REACH = f"""WITH {_NODES}, l AS (SELECT DISTINCT account_from AS s, account_to AS t FROM ev WHERE account_from <> account_to),
h0 AS (SELECT account AS seed, account FROM nd), rl AS (SELECT account FROM nd WHERE is_rail),
h1 AS (SELECT DISTINCT seed, t AS account FROM h0 JOIN l ON s = account WHERE account NOT IN (FROM rl)),
h2 AS (SELECT DISTINCT seed, t AS account FROM h1 JOIN l ON s = account WHERE account NOT IN (FROM rl))
SELECT seed, account, min(hop) AS hop FROM (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY 1, 2"""


def ego(spark, sf_dir):
    e = pay_events(spark, sf_dir)
    n = graph.typed(graph.nodes(e))
    return graph.ego_network(e, "A7", 2, n.filter("is_rail"), graph.communities(e))[0]


def excluded(spark, sf_dir):
    return paths.excluded_counts(pay_events(spark, sf_dir))


_EXCL = f"""WITH {EV} SELECT CASE WHEN account_from = account_to THEN 'self_transfer' WHEN txn_type = 'error' THEN 'reversal' WHEN amount_minor = 0 THEN 'zero_value' ELSE 'kept' END AS reason, count(*) AS n FROM ev GROUP BY 1"""

_ADJ = "ad AS (SELECT * FROM ev WHERE account_from <> account_to AND txn_type <> 'error' AND amount_minor > 0)"


def cycles(spark, sf_dir):
    c = paths.cycles(paths.adjacency(pay_events(spark, sf_dir)))
    return c.select(F.concat_ws(",", "nodes").alias("nodes"), F.concat_ws(",", "txns").alias("txns"), "length", F.round("retention", 9).alias("retention"))


_CYC = f"""WITH RECURSIVE {EV}, {_ADJ},
w AS (SELECT [account_from, account_to] AS path, [txn_id] AS txns, account_to AS last, ts_us AS now, amount_minor AS lo, amount_minor AS hi, false AS closed FROM ad
  UNION ALL SELECT list_append(path, account_to), list_append(txns, txn_id), account_to, ts_us, least(lo, amount_minor), greatest(hi, amount_minor), account_to = path[1]
  FROM w JOIN ad ON ad.account_from = w.last AND ts_us > now
  WHERE NOT closed AND len(txns) < 6 AND least(lo, amount_minor) * 1000000 >= greatest(hi, amount_minor) * 600000
    AND (NOT list_contains(path, account_to) OR (account_to = path[1] AND len(txns) >= 2)))
SELECT array_to_string(path[1:len(path) - 1], ',') AS nodes, array_to_string(txns, ',') AS txns, CAST(len(txns) AS INT) AS length, round(lo / hi, 9) AS retention FROM w WHERE closed"""


def chains(spark, sf_dir):
    c = paths.chains(paths.adjacency(pay_events(spark, sf_dir)))
    return c.select(F.concat_ws(",", "nodes").alias("nodes"), F.concat_ws(",", "txns").alias("txns"), "hops")


CHAIN_CTE = f"""ch0 AS (SELECT [account_from, account_to] AS path, [txn_id] AS txns, account_to AS last, ts_us AS now, ts_us AS begun, amount_minor AS amt, [amount_minor] AS amounts FROM ad
  UNION ALL SELECT list_append(path, account_to), list_append(txns, txn_id), account_to, ts_us, begun, amount_minor, list_append(amounts, amount_minor)
  FROM ch0 JOIN ad ON ad.account_from = ch0.last AND ts_us > now AND ts_us <= now + {DAY} AND amount_minor <= amt WHERE len(txns) < 6 AND NOT list_contains(path, account_to)),
longer AS (SELECT DISTINCT txns[1:len(txns) - 1] AS t FROM ch0 WHERE len(txns) > 3 UNION SELECT DISTINCT txns[2:] FROM ch0 WHERE len(txns) > 3),
ch AS (SELECT * FROM ch0 WHERE len(txns) >= 3 AND txns NOT IN (SELECT t FROM longer))"""
_CHAIN = f"WITH RECURSIVE {EV}, {_ADJ}, {CHAIN_CTE} SELECT array_to_string(path, ',') AS nodes, array_to_string(txns, ',') AS txns, CAST(len(txns) AS INT) AS hops FROM ch"


def participation(spark, sf_dir):
    c = paths.cycles(paths.adjacency(pay_events(spark, sf_dir)))
    return paths.cycle_participation(c)


_PART = _CYC.split("SELECT array_to_string(path[1")[0] + """, x AS (SELECT unnest(path[1:len(path) - 1]) AS account, CAST(len(txns) AS INT) AS l, lo / hi AS r FROM w WHERE closed)
SELECT account, count(*) AS cycle_participation_count, max(l) AS longest_cycle_length, CAST(round_even(max(r) * 10000, 0) AS BIGINT) AS max_cycle_retention_bps FROM x GROUP BY 1"""


def checks(spark, sf_dir):
    return graph.graph_checks(pay_events(spark, sf_dir))


_CHECKS = f"""WITH {EV} SELECT count(*) FILTER (WHERE account_from IS NULL OR account_to IS NULL OR ts_us IS NULL) AS nulls, count(*) FILTER (WHERE NOT regexp_matches(currency, '^[A-Z]{{3}}$')) AS bad_currency,
  count(*) FILTER (WHERE amount_minor < 0) AS negative, (SELECT count(*) FROM (SELECT txn_id FROM ev GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids FROM ev"""

QUERIES = {
    "graph_nodes": nodes, "graph_pairs": pairs, "graph_undirected_pairs": undirected, "graph_self_totals": self_totals, "graph_degree_summary": degrees,
    "graph_top_degree": top, "graph_effective_fan": effective, "graph_flows": flows, "graph_flows_window": flows_window, "graph_density": density,
    "graph_components": comps, "graph_pagerank": ranks, "graph_k_core": cores, "graph_communities": comm, "graph_betweenness": between,
    "graph_downstream": downstream, "graph_reachable": reach, "graph_ego": ego, "graph_excluded": excluded, "graph_cycles": cycles, "graph_chains": chains,
    "graph_cycle_participation": participation, "graph_checks": checks,
}
ORACLE = {
    "graph_nodes": f"WITH {_NODES} SELECT * FROM nd", "graph_pairs": _PAIRS, "graph_undirected_pairs": _UND, "graph_self_totals": _SELF, "graph_degree_summary": _DEG,
    "graph_top_degree": f"WITH {_NODES} SELECT account, total_degree FROM nd ORDER BY total_degree DESC, account LIMIT 10", "graph_effective_fan": _EFF,
    "graph_flows": _flows_sql(""), "graph_flows_window": _flows_sql(f"AND ts_us BETWEEN {START} AND {END}"), "graph_density": _DENS, "graph_components": _comps_sql(),
    "graph_pagerank": _rank_sql(), "graph_downstream": _DOWN, "graph_reachable": _REACH, "graph_excluded": _EXCL, "graph_cycles": _CYC, "graph_chains": _CHAIN,
    "graph_cycle_participation": _PART, "graph_checks": _CHECKS,
}
