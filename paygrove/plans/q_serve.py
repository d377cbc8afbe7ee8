"""Landing, read-model, audit and screening queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paygrove.operators import audit, evaluate, graph, pricing, rules, screening, splits, warehouse
from paygrove.plans.q_evaluate import _FOLDS, A, SC, _cands, fitted, scored
from paygrove.plans.q_rules import _SQL as RULE_SQL
from paygrove.plans.q_rules import S
from paygrove.plans.tables import DAY, EV, pay_events, pay_lineitem, table
from paygrove.session import checkpoint


def accounts(spark, sf_dir):
    return warehouse.accounts(pay_events(spark, sf_dir))


_ACC = f"""WITH {EV}, l AS (SELECT account_from AS account, account_to AS peer, 0 AS i, ts_us, amount_minor, currency FROM ev UNION ALL SELECT account_to, account_from, 1, ts_us, amount_minor, currency FROM ev)
SELECT account, count(*) AS rows, count(DISTINCT CASE WHEN peer <> account THEN peer END) AS counterparties, CAST(sum(i * amount_minor) AS BIGINT) AS funding_minor, min(ts_us) AS first_ts_us, max(ts_us) AS last_ts_us,
  (max(ts_us) - min(ts_us)) // {DAY} AS age_days, mode(currency) AS currency FROM l GROUP BY 1"""


def current(spark, sf_dir):
    li = pay_lineitem(spark, sf_dir).withColumnRenamed("account_from", "account_key")
    d = splits.assign(li, splits.plan(li))
    return warehouse.current_scores(d).select("account_key", "fold", "txn_id", "amount_minor")


_CUR = f"""WITH {_FOLDS}, r AS (SELECT account_from AS account_key, fold, txn_id, amount_minor, row_number() OVER (PARTITION BY account_from ORDER BY fold DESC, ts_us DESC, txn_id) AS nth FROM ro WHERE role = 'test')
SELECT account_key, fold, txn_id, amount_minor FROM r WHERE nth = 1"""


def append(spark, sf_dir):
    e = pay_events(spark, sf_dir).select("txn_id", "event_id")
    return warehouse.append_only(e, e.filter("event_id % 3 <> 0"), ["txn_id"])


def page(spark, sf_dir):
    return warehouse.select(scored(spark, sf_dir).select("account_key", "typology", "currency", "total"), {"typology": "cycle"}, {"currency": ["USD", "EUR"]}, {"total": 100}, [F.desc("total"), "account_key"], 25, 10)[0]


def _queue_parts(spark, sf_dir):
    p = checkpoint(pricing.price(pricing.attach(scored(spark, sf_dir), A), A))
    band = F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (F.least(F.lit(4), F.floor(F.col("score") * 5)) + 1).cast("int"))
    rule_ids = F.filter(F.array(F.when(F.col("total") % 2 == 0, "R1"), F.when(F.col("total") % 3 == 0, "R5"), F.when(F.col("total") % 5 == 0, "R12")), lambda x: x.isNotNull())
    scores = p.select("account_key", "score", "typology", band.alias("band"), rule_ids.alias("rule_ids"), F.size(rule_ids).alias("rule_hits"))
    econ = p.filter("ev_minor is not null").select("account_key", "ev_minor", "density", "exposure_minor", "minutes")
    return p, scores, econ


_RANKING = f"""WITH RECURSIVE {fitted([600, 3000], ('ev_greedy',))}, rk AS (SELECT pr.*, row_number() OVER (ORDER BY ev_minor / minutes DESC, account_key) AS rank,
  account_key IN (SELECT account_key FROM fit WHERE capacity = 3000) AS selected FROM pr WHERE ev_minor IS NOT NULL),
sr AS (SELECT *, coalesce(max(CASE WHEN selected THEN rank END) OVER (), 0) AS cutoff_rank FROM rk)"""
def _taken(spark, sf_dir, capacity):
    return pricing.first_fit(_cands(spark, sf_dir), evaluate.policy_order("ev_greedy"), [capacity])


def ranking(spark, sf_dir):
    p = checkpoint(pricing.price(pricing.attach(scored(spark, sf_dir), A), A))
    taken = pricing.first_fit(pricing.candidates(p), evaluate.policy_order("ev_greedy"), [3000])
    return warehouse.stored_ranking(p, taken).select("account_key", "rank", "selected", "cutoff_rank", "beyond_capacity")


def what_if(spark, sf_dir):
    return warehouse.what_if(_taken(spark, sf_dir, 600), _taken(spark, sf_dir, 3000))


_WHAT = f"""{_RANKING}, a AS (SELECT account_key FROM fit WHERE capacity = 600), b AS (SELECT account_key FROM fit WHERE capacity = 3000)
SELECT coalesce(a.account_key, b.account_key) AS account_key, CASE WHEN a.account_key IS NULL THEN 'entered' WHEN b.account_key IS NULL THEN 'left' ELSE 'kept' END AS change FROM a FULL JOIN b USING (account_key)"""


def risky(spark, sf_dir):
    e = pay_events(spark, sf_dir)
    s = e.groupBy(F.col("account_from").alias("account_key")).agg(F.sum("amount_minor").alias("m")).withColumn("band", F.when(F.col("m") % 5 == 0, "E").otherwise("B"))
    return warehouse.risky_communities(graph.communities(e), s)


def timeline(spark, sf_dir):
    e = pay_events(spark, sf_dir)
    return warehouse.timeline(e, rules.run_rules(e, S, only=("R1", "R10")), "A7")


_TIMELINE = f"""WITH {EV}, h AS (SELECT * FROM ({RULE_SQL['R1']}) UNION ALL SELECT * FROM ({RULE_SQL['R10']}))
SELECT ts_us, 'transaction' AS kind, txn_type AS label, txn_id AS detail FROM ev WHERE account_from = 'A7' OR account_to = 'A7' UNION ALL SELECT window_start_us, 'rule', rule_id, txn_ids FROM h WHERE account_key = 'A7'"""

_TIME = f"""WITH {EV} SELECT ts_us, 'transaction' AS kind, txn_type AS label, txn_id AS detail FROM ev WHERE account_from = 'A7' OR account_to = 'A7'"""


def transactions(spark, sf_dir):
    e = pay_events(spark, sf_dir)
    return warehouse.timeline(e, rules.run_rules(e, S, only=("R1",)).filter("false"), "A7")


def audit_log(spark, sf_dir):
    """Orders as one hash-linked log per customer, some rows spoilt or gone; verification finds them."""
    o = table(spark, sf_dir, "orders")
    d = o.select(
        F.col("o_custkey").alias("chain_id"), F.col("o_orderkey").alias("k"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("occurred_us"), F.lit("clerk").alias("actor_id"),
        F.concat(F.lit("order "), "o_orderkey").alias("subject"), F.col("o_orderstatus").alias("action"), F.lit("{}").alias("payload"))
    d = d.withColumn("seq", F.row_number().over(Window.partitionBy("chain_id").orderBy("k")).cast("long"))
    row = F.struct("seq", "k", "occurred_us", "actor_id", "subject", "action", "payload")
    made = F.struct(F.lit(audit.GENESIS).alias("h"), F.array().cast("array<struct<prev_hash: string, row_hash: string>>").alias("links"))

    def link(acc, x):
        h = audit.row_hash(lambda c: acc["h"] if c == "prev_hash" else x[c])
        return F.struct(h.alias("h"), F.concat(acc["links"], F.array(F.struct(acc["h"].alias("prev_hash"), h.alias("row_hash")))).alias("links"))

    # a customer's orders are few; a log of unbounded length is what verify() takes, not what this makes
    g = d.groupBy("chain_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).withColumn("links", F.aggregate("rows", made, link)["links"])
    log = g.select("chain_id", F.inline(F.arrays_zip("rows", "links"))).select("chain_id", "rows.*", "links.*")
    spoilt = log.withColumn("action", F.when(F.col("k") % 1000 == 7, F.lit("X")).otherwise(F.col("action"))).filter("k % 500 <> 3")
    return audit.verify(spoilt)


def _digest_sql(prev: str, action: str = "action") -> str:
    """The digest of a log row as SQL; nothing in these rows needs escaping."""
    named = {"seq": "seq", "occurred_us": "occurred_us", "actor_id": "'clerk'", "subject": "'order ' || k", "action": action, "payload": "'{}'", "prev_hash": prev}
    return "sha256('{' || " + " || ',' || ".join(f"""'"{c}":"' || {v} || '"'""" for c, v in named.items()) + " || '}')"


_AUDIT = f"""WITH RECURSIVE o AS (SELECT o_custkey AS chain_id, o_orderkey AS k, epoch_us(o_orderdate) AS occurred_us, o_orderstatus AS action, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders),
l AS (SELECT o.*, '{audit.GENESIS}' AS prev_hash, {_digest_sql(f"'{audit.GENESIS}'")} AS row_hash FROM o WHERE seq = 1
  UNION ALL SELECT o.*, l.row_hash, {_digest_sql("l.row_hash").replace("seq ||", "o.seq ||").replace("occurred_us ||", "o.occurred_us ||").replace("|| k ||", "|| o.k ||").replace("|| action ||", "|| o.action ||")} FROM l JOIN o ON o.chain_id = l.chain_id AND o.seq = l.seq + 1),
s AS (SELECT * REPLACE (CASE WHEN k % 1000 = 7 THEN 'X' ELSE action END AS action) FROM l WHERE k % 500 <> 3),
b AS (SELECT *, lag(seq) OVER w AS before_seq, lag(row_hash) OVER w AS before_hash FROM s WINDOW w AS (PARTITION BY chain_id ORDER BY seq)),
d AS (SELECT *, CASE WHEN {_digest_sql("prev_hash")} <> row_hash THEN 'digest' WHEN before_seq IS NOT NULL AND seq <> before_seq + 1 THEN 'gap' WHEN prev_hash <> coalesce(before_hash, '{audit.GENESIS}') THEN 'predecessor' END AS bad FROM b)
SELECT chain_id, count(*) AS rows, count(bad) AS broken, min(seq) FILTER (WHERE bad IS NOT NULL) AS first_broken, arg_min(bad, seq) FILTER (WHERE bad IS NOT NULL) AS reason FROM d GROUP BY 1"""


def erase(spark, sf_dir):
    m = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.concat(F.lit("P"), "c_custkey").alias("pseudonym"))
    return audit.erase(m, m.filter("subject % 10 = 3"))


def screen(spark, sf_dir):
    """Customers' names against suppliers' with the role word swapped."""
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.regexp_replace("c_name", "Customer", "Party").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("reference"), F.regexp_replace("s_name", "Supplier", "Party").alias("name"))
    return screening.screen(q, s).select("query_id", "reference", "method", F.round("similarity", 9).alias("similarity"), "rank")


_SCREEN = """WITH n AS (SELECT c_custkey AS query_id, replace(c_name, 'Customer', 'Party') AS q FROM customer), s AS (SELECT 'S' || s_suppkey AS reference, replace(s_name, 'Supplier', 'Party') AS w FROM supplier),
a AS (SELECT *, trim(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g')) AS qn FROM n), b AS (SELECT *, trim(regexp_replace(lower(w), '[^a-z0-9]+', ' ', 'g')) AS wn FROM s),
p AS (SELECT *, list_distinct(list_filter(string_split(qn, ' '), lambda x: len(x) >= 2)) AS qt, list_distinct(list_filter(string_split(wn, ' '), lambda x: len(x) >= 2)) AS wt, 1 - levenshtein(qn, wn) / greatest(len(qn), len(wn), 1) AS r FROM a, b),
m AS (SELECT *, CASE WHEN q = reference THEN 'identifier' WHEN qn = wn THEN 'equal' WHEN least(len(qt), len(wt)) >= 2 AND len(list_intersect(qt, wt)) = least(len(qt), len(wt)) THEN 'subset' WHEN r >= 0.85 THEN 'similar' END AS method FROM p),
z AS (SELECT *, CASE method WHEN 'similar' THEN r WHEN 'subset' THEN 0.95 ELSE 1.0 END AS sim FROM m WHERE method IS NOT NULL)
SELECT query_id, reference, method, round(sim, 9) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, reference) AS INT) AS rank FROM z QUALIFY rank <= 5"""


def run_states(spark, sf_dir):
    e = pay_events(spark, sf_dir).withColumns({"run_id": F.concat(F.lit("r"), (F.col("event_id") % 40).cast("string")), "stage": F.col("txn_type"), "at_us": F.col("ts_us"), "state": F.when(F.col("amount_minor") % 2 == 0, "running").otherwise("done"), "rows": F.col("amount_minor")})
    return warehouse.stage_state(e).withColumn("seconds", F.round("seconds", 6))


_STATES = f"""WITH {EV}, l AS (SELECT 'r' || (event_id % 40) AS run_id, txn_type AS stage, ts_us AS at_us, CASE WHEN amount_minor % 2 = 0 THEN 'running' ELSE 'done' END AS state, amount_minor AS rows FROM ev)
SELECT run_id, stage, arg_max(state, (at_us, state)) AS state, arg_max(rows, (at_us, state)) AS rows, round((max(at_us) - min(at_us)) / 1e6, 6) AS seconds FROM l GROUP BY 1, 2"""


def runs(spark, sf_dir):
    e = pay_events(spark, sf_dir).select(F.col("txn_id").alias("run_id"), F.col("account_from").alias("dataset"), F.col("ts_us").alias("started_us"), F.when(F.col("amount_minor") % 3 == 0, "failed").otherwise("complete").alias("state"))
    return warehouse.runs(e).withColumn("superseded_by", F.coalesce("superseded_by", F.lit("")))


_RUNS = f"""WITH {EV}, l AS (SELECT txn_id AS run_id, account_from AS dataset, ts_us AS started_us, CASE WHEN amount_minor % 3 = 0 THEN 'failed' ELSE 'complete' END AS state FROM ev),
d AS (SELECT run_id, lead(run_id) OVER (PARTITION BY dataset ORDER BY started_us, run_id) AS s FROM l WHERE state = 'complete')
SELECT l.*, coalesce(s, '') AS superseded_by, d.run_id IS NOT NULL AND s IS NULL AS is_latest FROM l LEFT JOIN d USING (run_id)"""

QUERIES = {
    "account_table": accounts, "current_scores": current, "append_only": append, "generic_select": page,
    "stored_ranking": ranking, "policy_what_if": what_if, "risky_communities": risky, "case_timeline": timeline, "case_transactions": transactions, "audit_verify": audit_log, "audit_erase": erase,
    "name_screening": screen, "stage_states": run_states, "run_list": runs,
}
ORACLE = {
    "account_table": _ACC, "current_scores": _CUR, "append_only": f"WITH {EV} SELECT txn_id, event_id FROM ev WHERE event_id % 3 = 0",
    "generic_select": f"WITH {SC} SELECT account_key, typology, currency, total FROM sc WHERE typology = 'cycle' AND total > 100 ORDER BY total DESC, account_key LIMIT 25 OFFSET 10",
    "stored_ranking": f"{_RANKING} SELECT account_key, rank, selected, cutoff_rank, rank > cutoff_rank AS beyond_capacity FROM sr", "policy_what_if": _WHAT, "case_transactions": _TIME,
    "audit_erase": "SELECT c_custkey AS subject, 'P' || c_custkey AS pseudonym FROM customer WHERE c_custkey % 10 <> 3", "stage_states": _STATES, "run_list": _RUNS, "name_screening": _SCREEN, "audit_verify": _AUDIT, "case_timeline": _TIMELINE,
}
