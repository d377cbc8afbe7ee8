"""From declared features and real rule hits to the review queue: one chain over pay_events, and its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paygrove.operators import canonical, evaluate, features, folds, graph, kernels, leakage, pricing, rules, warehouse
from paygrove.operators.entity import explode_entities
from paygrove.operators.registry import FEATURES
from paygrove.plans import q_canonical
from paygrove.plans.q_evaluate import UGX, fitted, priced_sql
from paygrove.plans.q_features import EN, GROUPS, _sql
from paygrove.plans.q_folds import FOLDS, _local_sql, _plan, _rules_sql, _typology_sql, _union
from paygrove.plans.q_rules import _SQL as RULE_SQL
from paygrove.plans.q_rules import S
from paygrove.plans.tables import DAY, EV, pay_events
from paygrove.session import scratch_table, shared_dir
from paygrove.sources import runs

#: Measures of the whole graph are iterative and have no SQL; the matrix with them is ``training_matrix``.
_ITERATIVE = {"graph_pagerank", "graph_betweenness_approx", "graph_k_core_number", "graph_community_size", "graph_community_id"}
DECLARED = [f for f in FEATURES if f.name not in _ITERATIVE]
_DOUBLES = {"burstiness", "robust_z", "rule"}


def _matrix(spark, sf_dir, parts: tuple[str, ...], declared) -> DataFrame:
    e = scratch_table(pay_events(spark, sf_dir), "events")  # read by every measure and rule of every fold
    plan = _plan(e)
    found = folds.fold_cycles(e, plan, S)  # S has the lengths and retention that node tables take
    nodes = folds.per_fold(e, plan, lambda x, f: folds.node_table(x, f, parts, cycles=found), "fold-nodes")
    hits = folds.per_fold(e, plan, lambda x, f: folds.hit_table(x, f, S, cycles=found), "fold-hits")
    return folds.publish(e, plan, nodes, hits, declared)


def feature_matrix(spark, sf_dir):
    """Every row of every fold with all features that SQL can say: 91 of them, at each row's own instant or its fold's cutoff."""
    d = _matrix(spark, sf_dir, (folds.LOCAL, folds.TYPOLOGY), DECLARED)
    return d.withColumns({f.name: F.round(f.name, 9) for f in DECLARED if f.kind in _DOUBLES and f.source != "COUNT"})


def training_matrix(spark, sf_dir):
    """All 96 features: what models train on."""
    return _matrix(spark, sf_dir, (folds.LOCAL, folds.GLOBAL, folds.TYPOLOGY), None)


def _matrix_sql() -> str:
    named = {f.name for f in DECLARED}
    keys = ("txn_id", "sign")
    ctes, cols, joins, seen = [], [], "", set()
    for g in GROUPS:
        mine = [f.name for f in DECLARED if f.group == g and f.kind not in ("graph", "rule")]
        ctes.append(f"m_{g} AS ({_sql(g)})")
        joins += f" JOIN m_{g} USING (txn_id, sign)"
        cols += [f'm_{g}."{n}"' for n in mine if n not in seen and n not in keys]
        seen |= set(mine)
    for t, sql in (("t_local", _union(_local_sql)), ("t_typology", _union(_typology_sql)), ("t_rules", _union(_rules_sql))):
        ctes.append(f"{t} AS ({sql})")
        joins += f" LEFT JOIN {t} ON {t}.fold = ro.fold AND {t}.entity = k.entity"
    node = lambda f: "t_typology" if f.name in ("graph_cycle_participation_count", "graph_max_cycle_retention_bps", "graph_longest_chain_length") else "t_local"
    for f in DECLARED:
        if f.kind == "graph":
            cols.append(f'{node(f)}."{f.name}"')
        elif f.kind == "rule":
            cols.append(f't_rules."{f.name}"' if f.source == "COUNT" else f'round(t_rules."{f.name}", 9) AS "{f.name}"')
    assert {c.split('"')[-2] for c in cols} == named
    ctes.append(f"""k AS (WITH {EV} SELECT txn_id, ts_us, currency, account_from AS entity, account_to AS counterparty, -1 AS sign, 'out' AS direction FROM ev
  UNION ALL SELECT txn_id, ts_us, currency, account_to, account_from, 1, 'in' FROM ev)""")
    ctes.append(f"""ro AS (WITH t AS (SELECT min(ts_us) AS a, max(ts_us) + 1 - min(ts_us) AS span FROM k),
  b AS (SELECT f::INT AS fold, a, trunc(span * (1 - 0.4::DOUBLE) / {FOLDS})::BIGINT AS step, a + trunc(span * 0.4::DOUBLE)::BIGINT + f * trunc(span * (1 - 0.4::DOUBLE) / {FOLDS})::BIGINT AS known FROM t, range({FOLDS}) r(f)),
  c AS (SELECT *, known - trunc((known - a) * 0.15::DOUBLE)::BIGINT AS cut FROM b)
  SELECT txn_id, sign, fold, CASE WHEN ts_us < cut - {DAY} THEN 'train' WHEN ts_us < cut THEN 'purged' WHEN ts_us < known THEN 'valid' WHEN ts_us < known + {DAY} THEN 'embargo' WHEN ts_us < known + step THEN 'test' END AS role FROM k, c)""")
    return f"WITH {', '.join(ctes)} SELECT ro.fold, ro.role, k.*, {', '.join(cols)} FROM k JOIN ro USING (txn_id, sign){joins} WHERE role IS NOT NULL"


def _hits(spark, sf_dir) -> DataFrame:
    """What all twelve rules say of all events, written once."""
    e = scratch_table(pay_events(spark, sf_dir), "events")  # read by every rule
    out = graph.typed(graph.nodes(e)).filter("node_type in ('rail', 'external')")
    h = rules.run_rules(e, S, excluded=out).groupBy("account_key", "rule_id").agg(F.max("severity").alias("severity"))
    return scratch_table(h, "rule-hits")


def scored_events(spark, sf_dir, hits: DataFrame) -> DataFrame:
    """Paying accounts with the rules' score, their leading rule as typology, and what they paid as exposure.

    The score is the chance that at least one rule is right, each taken at its best severity.
    """
    e = pay_events(spark, sf_dir)
    a = e.groupBy(F.col("account_from").alias("account_key")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("label_is_fraud").alias("label"), F.max("ts_us").alias("ts_us"), F.sum("amount_minor").alias("outflow_minor"), F.max("currency").alias("currency"))
    h = hits.groupBy("account_key").agg(
        F.round(1 - F.exp(F.sum(F.log1p(-F.least("severity", F.lit(0.999999))))), 6).alias("score"), F.max("severity").alias("rule_severity"),
        F.min(F.struct((-F.col("severity")).alias("s"), "rule_id"))["rule_id"].alias("typology"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))
    d = a.join(h, "account_key", "left").fillna(0.0, ["score", "rule_severity"]).fillna("none", ["typology"])
    d = d.withColumn("rule_ids", F.coalesce("rule_ids", F.array().cast("array<string>")))
    return d.withColumn("rule_hits", F.size("rule_ids"))


_HITS = "hx AS (SELECT account_key, rule_id, max(severity) AS severity FROM (" + " UNION ALL ".join(f"SELECT rule_id, account_key, severity FROM ({q})" for q in RULE_SQL.values()) + ") GROUP BY 1, 2)"
SCE = f"""{EV}, {_HITS}, g AS (SELECT account_from AS account_key, count(*) AS rows, max(label_is_fraud) AS label, max(ts_us) AS ts_us, CAST(sum(amount_minor) AS BIGINT) AS outflow_minor, max(currency) AS currency FROM ev GROUP BY 1),
hg AS (SELECT account_key, round(1 - exp(sum(ln(1 - least(severity, 0.999999::DOUBLE)))), 6) AS score, max(severity) AS rule_severity, arg_min(rule_id, (-severity, rule_id)) AS typology, list_sort(list(rule_id)) AS rule_ids FROM hx GROUP BY 1),
sc AS (SELECT g.*, coalesce(hg.score, 0) AS score, coalesce(hg.rule_severity, 0) AS rule_severity, coalesce(hg.typology, 'none') AS typology, coalesce(rule_ids, []) AS rule_ids, CAST(len(coalesce(rule_ids, [])) AS INT) AS rule_hits FROM g LEFT JOIN hg USING (account_key))"""
_BAND = "['A','B','C','D','E'][CAST(least(4, floor(score * 5)) AS INT) + 1]"


def hits_long(spark, sf_dir):
    """The rules' own severities, a row per account and rule, from a column per rule."""
    h = _hits(spark, sf_dir)
    wide = h.groupBy("account_key").agg(*[F.max(F.when(F.col("rule_id") == r, F.col("severity"))).alias(r) for r in RULE_SQL])
    return warehouse.hits_long(wide, list(RULE_SQL)).withColumn("severity", F.round("severity", 9))


CAPACITY = 300


def _parts(spark, sf_dir):
    """(priced, scores, economics, allocation, cases) of the chain, each from the written hits."""
    p = scratch_table(pricing.price(pricing.attach(scored_events(spark, sf_dir, _hits(spark, sf_dir)), UGX), UGX), "priced")
    band = F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (F.least(F.lit(4), F.floor(F.col("score") * 5)) + 1).cast("int"))
    scores = p.select("account_key", "score", "typology", band.alias("band"), "rule_ids", "rule_hits")
    econ = p.filter("ev_minor is not null").select("account_key", "ev_minor", "density", "exposure_minor", "minutes")
    taken = pricing.first_fit(pricing.candidates(p), evaluate.policy_order("ev_greedy"), [CAPACITY])
    alloc = warehouse.stored_ranking(p, taken).select("account_key", "rank", "selected", "beyond_capacity")
    # a case is open where three rules agree
    cases = p.filter("rule_hits >= 3").select("account_key", F.lit("open").alias("status"))
    return p, scores, econ, scratch_table(alloc, "ranking"), cases


#: One page for each filter and each order of the queue, and some of both.
PAGES = [
    ("by rank", {}), ("band", {"band": "E", "sort": "score", "descending": True}), ("typology", {"typology": "R4", "sort": "exposure_minor", "descending": True}), ("rule", {"rule": "R1", "sort": "density", "descending": True}),
    ("selected", {"selected": True, "sort": "minutes"}), ("left", {"selected": False, "sort": "rule_hits", "descending": True, "offset": 3}), ("open", {"status": "open", "sort": "account_key"}),
    ("new", {"status": "new", "sort": "band"}), ("score", {"least_score": 0.4, "sort": "typology"}), ("ev", {"least_ev": 0, "sort": "ev_minor", "descending": True, "limit": 10}),
    ("text", {"text": "9", "sort": "rank", "descending": True}), ("all at once", {"rule": "R2", "selected": False, "least_score": 0.1, "text": "A", "sort": "ev_minor", "limit": 20, "offset": 2}),
]


def queue(spark, sf_dir):
    """Pages of the review queue with the number of accounts that each request matches."""
    _, scores, econ, alloc, cases = _parts(spark, sf_dir)
    out = []
    for name, how in PAGES:
        page, total = warehouse.queue_page(scores, econ, alloc, cases, **how)
        page = page.select(F.lit(name).alias("page"), "account_key", "band", "typology", "score", F.concat_ws(",", "rule_ids").alias("rule_ids"), "rank", "selected", "beyond_capacity", "ev_minor", F.coalesce("status", F.lit("new")).alias("status"))
        out.append(page.join(F.broadcast(total)))  # one row
    return reduce(DataFrame.unionByName, out)


def _page_sql(name: str, how: dict) -> str:
    where = [
        f"band = '{how['band']}'" if "band" in how else "", f"typology = '{how['typology']}'" if "typology" in how else "", f"list_contains(rule_ids, '{how['rule']}')" if "rule" in how else "",
        f"coalesce(selected, false) = {how['selected']}" if "selected" in how else "", f"coalesce(status, 'new') = '{how['status']}'" if "status" in how else "",
        f"score >= {how['least_score']}" if "least_score" in how else "", f"ev_minor >= {how['least_ev']}" if "least_ev" in how else "", f"contains(account_key, '{how['text']}')" if "text" in how else "",
    ]
    cond = " AND ".join(w for w in where if w) or "true"
    order = f"{how.get('sort', 'rank')} {'DESC' if how.get('descending') else 'ASC'} NULLS LAST, account_key"
    return f"""SELECT * FROM (SELECT '{name}' AS page, account_key, band, typology, score, array_to_string(rule_ids, ',') AS rule_ids, rank, selected, beyond_capacity, ev_minor, coalesce(status, 'new') AS status, count(*) OVER () AS total
  FROM qu WHERE {cond} ORDER BY {order} LIMIT {how.get('limit', 50)} OFFSET {how.get('offset', 0)})"""


_RANKED = f"""WITH RECURSIVE {fitted([CAPACITY], ('ev_greedy',), priced_sql(SCE, UGX))}, rk AS (SELECT pr.*, row_number() OVER (ORDER BY ev_minor / minutes DESC, account_key) AS rank,
  account_key IN (SELECT account_key FROM fit) AS selected FROM pr WHERE ev_minor IS NOT NULL), sr AS (SELECT *, coalesce(max(CASE WHEN selected THEN rank END) OVER (), 0) AS cutoff_rank FROM rk)"""
_QUEUE = f"""{_RANKED}, qu AS (SELECT pr.*, {_BAND.replace('score', 'pr.score')} AS band, ev_minor / minutes AS density, sr.rank, sr.selected, sr.rank > cutoff_rank AS beyond_capacity, CASE WHEN pr.rule_hits >= 3 THEN 'open' END AS status
  FROM pr LEFT JOIN (SELECT account_key, rank, selected, cutoff_rank FROM sr) sr USING (account_key))
""" + " UNION ALL ".join(f"({_page_sql(*p)})" for p in PAGES)


def facets(spark, sf_dir):
    return warehouse.facets(_parts(spark, sf_dir)[1])


_FACETS = f"""WITH {SCE}, b AS (SELECT *, {_BAND} AS band FROM sc) SELECT facet, value, count(*) AS n FROM (SELECT 'band' AS facet, band AS value FROM b UNION ALL SELECT 'typology', typology FROM b
  UNION ALL SELECT 'rule', unnest(rule_ids) FROM b) GROUP BY 1, 2"""


def measured(spark, sf_dir):
    """How well the rules' own score finds the labels, and how the labels fall by leading rule."""
    d = scored_events(spark, sf_dir, _hits(spark, sf_dir))
    return d.groupBy("typology").agg(
        F.count(F.lit(1)).alias("accounts"), F.sum("label").cast("bigint").alias("positives"), F.round(F.avg("score"), 6).alias("mean_score"), F.sum("outflow_minor").alias("outflow_minor"))


_MEASURED = f"WITH {SCE} SELECT typology, count(*) AS accounts, CAST(sum(label) AS BIGINT) AS positives, round(avg(score), 6) AS mean_score, CAST(sum(outflow_minor) AS BIGINT) AS outflow_minor FROM sc GROUP BY 1"

SEALS = (1_704_700_000_000_000, 1_705_276_800_000_000)


def leaks(spark, sf_dir):
    """Declared features and a planted one that looks a day ahead, built with and without the future; only the planted one changes."""
    names = ("txn_count_in_24h", "amount_out_24h_minor", "is_counterparty_first_ever", "gap_since_previous_event_s")
    fs = [f for f in FEATURES if f.name in names]

    def build(e):
        d = features.build(e, fs)
        a = explode_entities(e).select("txn_id", "sign", kernels.forward_sum(F.col("amount_minor"), ["entity"], DAY).alias("looks_ahead"))
        return d.join(a, ["txn_id", "sign"])

    return leakage.compare(build, pay_events(spark, sf_dir), list(SEALS), ["txn_id", "sign"], [*names, "looks_ahead"])


_LEAKS = f"""WITH {EV}, {EN}, c AS (SELECT unnest({list(SEALS)}) AS cut), a AS (SELECT txn_id, sign, ts_us, sum(amount_minor) OVER (PARTITION BY entity ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND {DAY - 1} FOLLOWING) AS x FROM en),
b AS (SELECT cut, txn_id, sign, sum(amount_minor) OVER (PARTITION BY cut, entity ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND {DAY - 1} FOLLOWING) AS x FROM en JOIN c ON ts_us <= cut),
g AS (SELECT cut, count(*) AS n, count(*) FILTER (WHERE a.x IS DISTINCT FROM b.x) AS changed FROM a JOIN b USING (txn_id, sign) GROUP BY 1)
SELECT cut AS cutoff_us, col AS "column", n, CASE WHEN col = 'looks_ahead' THEN changed ELSE 0 END AS changed, 0::BIGINT AS missing
FROM g, (SELECT unnest(['txn_count_in_24h', 'amount_out_24h_minor', 'is_counterparty_first_ever', 'gap_since_previous_event_s', 'looks_ahead']) AS col)"""


def ingest_manifest(spark, sf_dir):
    """A run over the raw log as files: what landed, what was put aside, what was refused, and what a reader then finds."""
    base = f"{shared_dir(spark)}/paygrove-{spark.sparkContext.applicationId}/ingest-{uuid.uuid4().hex[:12]}"
    q_canonical.raw_a(spark, sf_dir).select(*canonical.RAW_A).write.option("header", True).csv(f"{base}/raw/a")
    declared = [runs.Declared("source_a", "source_a", (("a", "declared"),)), runs.Declared("source_c", "canonical", (("c.csv", "declared"),), "licence unknown")]
    m = runs.ingest(spark, f"{base}/raw", f"{base}/out", declared, q_canonical.SECRET, q_canonical.EPOCH, "r1")
    found = runs.landed(spark, f"{base}/out", verify=True).groupBy("source_dataset").agg(F.count(F.lit(1)).alias("read_back"), F.sum("amount_minor").alias("amount_minor"))
    return m.join(found, F.col("source_id") == F.col("source_dataset"), "left").select("source_id", "status", "reason", "rows", "quarantined", "read_back", "amount_minor")


_MANIFEST = f"""SELECT 'source_a' AS source_id, 'landed' AS status, NULL AS reason, (SELECT count(*) FROM ({q_canonical.ORACLE['canonical_a']})) AS rows, (SELECT count(*) FROM ({q_canonical.ORACLE['canonical_a_quarantine']})) AS quarantined,
  (SELECT count(*) FROM ({q_canonical.ORACLE['canonical_a']})) AS read_back, (SELECT CAST(sum(amount_minor) AS BIGINT) FROM ({q_canonical.ORACLE['canonical_a']})) AS amount_minor
UNION ALL SELECT 'source_c', 'refused', 'licence unknown', NULL, NULL, NULL, NULL"""

QUERIES = {
    "leakage_check": leaks, "ingest_manifest": ingest_manifest,
    "feature_matrix": feature_matrix, "training_matrix": training_matrix, "hits_long": hits_long, "alert_queue": queue, "queue_facets": facets, "rules_by_typology": measured,
}
ORACLE = {
    "leakage_check": _LEAKS, "ingest_manifest": _MANIFEST,
    "feature_matrix": _matrix_sql(), "hits_long": f"WITH {EV}, {_HITS} SELECT account_key, rule_id, round(severity, 9) AS severity FROM hx", "alert_queue": _QUEUE, "queue_facets": _FACETS, "rules_by_typology": _MEASURED,
}
