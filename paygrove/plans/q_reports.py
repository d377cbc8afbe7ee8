"""Queries of reports over scores, folds and runs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paygrove.operators import evaluate, graph, models, pricing, rules, scorecard, splits, warehouse
from paygrove.plans.q_evaluate import _FOLDS, A, SC, _cands, _folds, fitted, metrics, fairness, scored
from paygrove.plans.q_evaluate import _FAIR, _METRICS, PR
from paygrove.plans.q_graph import _NODES
from paygrove.plans.q_rules import _SQL as RULE_SQL
from paygrove.plans.q_rules import S, _plain
from paygrove.plans.q_serve import _queue_parts, _taken
from paygrove.plans.tables import DAY, EV, pay_events

BAND = "['A','B','C','D','E'][CAST(least(4, floor(score * 5)) AS INT) + 1]"


def _rounded(d, but=()):
    return d.withColumns({c: F.round(c, 9) for c, t in d.dtypes if t == "double" and c not in but})


# -- scores of each fold's test block


def fold_scored(spark, sf_dir):
    """One row per customer and fold it is tested in, scored from that fold's amounts."""
    li, folds = _folds(spark, sf_dir)
    t = splits.assign(li.withColumnRenamed("account_from", "account_key"), folds).filter("role = 'test'")
    g = t.groupBy("account_key", "fold").agg(
        F.sum("amount_minor").alias("total"), F.count(F.lit(1)).alias("rows"), F.max("label_is_fraud").alias("label"), F.sum(F.when(F.col("channel") == "O", F.col("amount_minor"))).alias("outflow_minor"))
    d = g.withColumn("score", (F.col("total") % 997) / F.lit(1000.0)).withColumn("currency", F.lit("USD"))
    return d.withColumn("rule_severity", (F.col("total") % 101) / F.lit(100.0))


FS = f"""{_FOLDS}, fs AS (SELECT account_from AS account_key, fold, CAST(sum(amount_minor) AS BIGINT) AS total, count(*) AS rows, max(label_is_fraud) AS label, CAST(sum(CASE WHEN channel = 'O' THEN amount_minor END) AS BIGINT) AS outflow_minor,
  (CAST(sum(amount_minor) AS BIGINT) % 997) / 1000.0::DOUBLE AS score, 'USD' AS currency, (CAST(sum(amount_minor) AS BIGINT) % 101) / 100.0::DOUBLE AS rule_severity FROM ro WHERE role = 'test' GROUP BY 1, 2)"""
# the pricing of customers, over each fold's
PF = FS + ", " + PR[PR.index("att AS ("):].replace("FROM sc)", "FROM fs)", 1)


def _fold_cands(spark, sf_dir):
    return pricing.candidates(pricing.price(pricing.attach(fold_scored(spark, sf_dir), A), A)).withColumn("recoverable_minor", F.col("intercept_minor"))


def fold_ledgers(spark, sf_dir):
    c = evaluate.by_policy(_fold_cands(spark, sf_dir))
    return evaluate.fold_ledger(pricing.first_fit(c, [F.col("place"), F.col("account_key")], [600], ("policy", "fold")), ["policy", "fold"])


_FIT = fitted([600])
_LED = f"""WITH RECURSIVE {PF}, q AS ({" UNION ALL ".join(f"SELECT '{n}' AS policy, pr.*, row_number() OVER (PARTITION BY fold ORDER BY {o}, account_key) AS r FROM pr WHERE ev_minor > 0" for n, o in (("threshold", "score DESC"), ("rules_only", "rule_severity DESC"), ("highest_amount", "exposure_minor DESC"), ("random", "('0x' || substr(sha256('5|' || account_key), 1, 13))::BIGINT"), ("ev_greedy", "ev_minor / minutes DESC")))}),
f AS (SELECT DISTINCT policy, fold, 0::BIGINT AS r, 600::BIGINT AS left_, false AS took FROM q
  UNION ALL SELECT f.policy, f.fold, q.r, CASE WHEN q.minutes <= left_ THEN left_ - q.minutes ELSE left_ END, q.minutes <= left_ FROM f JOIN q ON q.r = f.r + 1 AND q.policy = f.policy AND q.fold = f.fold),
led AS (SELECT policy, fold, count(*) AS reviewed, CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(CASE WHEN label = 1 THEN intercept_minor ELSE 0 END) AS BIGINT) AS captured_minor, CAST(sum(review_cost_minor) AS BIGINT) AS review_cost_minor,
  CAST(sum(CASE WHEN label = 0 THEN friction_minor ELSE 0 END) AS BIGINT) AS friction_minor,
  CAST(sum(CASE WHEN label = 1 THEN intercept_minor ELSE 0 END) - sum(review_cost_minor) - sum(CASE WHEN label = 0 THEN friction_minor ELSE 0 END) AS BIGINT) AS net_minor FROM f JOIN q USING (policy, fold, r) WHERE took GROUP BY 1, 2)"""


def over_folds(spark, sf_dir):
    """Each policy over its folds: totals, drawdown, ratio, worst fold, benefit per hour."""
    return _rounded(evaluate.cumulative(fold_ledgers(spark, sf_dir), ("policy",)))


_OVER = f"""{_LED}, c AS (SELECT *, sum(net_minor) OVER (PARTITION BY policy ORDER BY fold) AS c FROM led), d AS (SELECT *, greatest(0, max(c) OVER (PARTITION BY policy ORDER BY fold)) - c AS fall FROM c)
SELECT policy, count(*) AS folds, CAST(sum(net_minor) AS BIGINT) AS total_minor, CAST(max(fall) AS BIGINT) AS max_drawdown_minor, round(avg(net_minor), 9) AS mean_minor, round(stddev_samp(net_minor), 9) AS std_minor,
  round(avg(net_minor) / nullif(stddev_samp(net_minor), 0), 9) AS mean_over_std, min(net_minor) AS worst_minor, CAST(sum(minutes) AS BIGINT) AS minutes, round(sum(net_minor) * 60.0::DOUBLE / nullif(sum(minutes), 0), 9) AS per_hour_minor FROM d GROUP BY 1"""


def ablation(spark, sf_dir):
    """Scores with parts left out, over the same customers, and the control that sees the label."""
    d = scored(spark, sf_dir)
    full = F.col("score") + F.col("rule_severity")
    parts = {"all": full, "without_rules": F.col("score"), "without_model": F.col("rule_severity"), "volume_only": F.col("rows")}
    return _rounded(evaluate.ablation(d, parts, F.col("label") + F.col("score") / 10))


_ABL = f"""WITH {SC}, x AS (SELECT 'all' AS configuration, score + rule_severity AS s, label FROM sc UNION ALL SELECT 'without_rules', score, label FROM sc UNION ALL SELECT 'without_model', rule_severity, label FROM sc
  UNION ALL SELECT 'volume_only', rows, label FROM sc UNION ALL SELECT 'lookahead', label + score / 10, label FROM sc),
s AS (SELECT configuration, s, count(*) AS n, sum(label) AS p FROM x GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER w AS nt, sum(p) OVER w AS pt, sum(n) OVER a AS na, sum(p) OVER a AS pa FROM s WINDOW w AS (PARTITION BY configuration ORDER BY s DESC), a AS (PARTITION BY configuration)),
m AS (SELECT configuration, CAST(max(na) AS BIGINT) AS n, CAST(max(pa) AS BIGINT) AS positives, sum(p * pt / nt) / max(pa) AS ap, sum(p * (2 * ((na - pa) - (nt - pt)) + (n - p))) / (2.0 * max(pa) * (max(na) - max(pa))) AS auroc FROM c GROUP BY 1)
SELECT configuration, n, positives, round(ap, 9) AS average_precision, round(auroc, 9) AS auroc, ap <= (SELECT ap FROM m WHERE configuration = 'lookahead') AS beaten FROM m"""


def seeds(spark, sf_dir):
    """Average precision and Brier score over the folds' test blocks as repeated runs: mean, deviation, range."""
    d = fold_scored(spark, sf_dir)
    a = evaluate.average_precision_ties(d, ["fold"]).select(F.lit("average_precision").alias("metric"), F.col("average_precision").alias("value"))
    b = evaluate.brier(d, ["fold"]).select(F.lit("brier").alias("metric"), F.col("brier").alias("value"))
    return _rounded(evaluate.over_seeds(a.unionByName(b)))


_SEEDS = f"""WITH {FS}, s AS (SELECT fold, score, count(*) AS n, sum(label) AS p FROM fs GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER w AS nt, sum(p) OVER w AS pt, sum(p) OVER (PARTITION BY fold) AS pa FROM s WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
m AS (SELECT 'average_precision' AS metric, sum(p * pt / nt) / max(pa) AS value FROM c GROUP BY fold UNION ALL SELECT 'brier', avg((score - label) ** 2) FROM fs GROUP BY fold)
SELECT metric, count(*) AS seeds, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, round(min(value), 9) AS least, round(max(value), 9) AS most FROM m GROUP BY 1"""


def shift(spark, sf_dir):
    """Ten percent less and more money: how ranks and the reviewed set move."""
    s = pricing.attach(scored(spark, sf_dir), A)
    base = pricing.candidates(pricing.price(s, A))
    taken = pricing.first_fit(base, evaluate.policy_order("ev_greedy"), [600])
    out = None
    for percent in (90, 110):
        x = s.withColumn("exposure_minor", F.call_function("div", F.col("exposure_minor") * percent, F.lit(100)))
        other = pricing.candidates(pricing.price(x, A))
        r = evaluate.money_shift(base, other, taken, pricing.first_fit(other, evaluate.policy_order("ev_greedy"), [600])).withColumn("percent", F.lit(percent))
        out = r if out is None else out.unionByName(r)
    return _rounded(out)


def _shift_sql(percent: int) -> str:
    other = fitted([600], ("ev_greedy",)).replace("coalesce(outflow_minor, 0) AS exposure_minor", f"coalesce(outflow_minor, 0) * {percent} // 100 AS exposure_minor")
    base = fitted([600], ("ev_greedy",))
    return f"""SELECT {percent} AS percent, * FROM (WITH b AS (WITH RECURSIVE {base} SELECT account_key, ev_minor / minutes AS x, account_key IN (SELECT account_key FROM fit) AS t FROM pr WHERE ev_minor > 0),
o AS (WITH RECURSIVE {other} SELECT account_key, ev_minor / minutes AS y, account_key IN (SELECT account_key FROM fit) AS t FROM pr WHERE ev_minor > 0),
j AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS c FROM b JOIN o USING (account_key)),
l AS (SELECT (SELECT count(*) FROM b WHERE t AND account_key NOT IN (SELECT account_key FROM o WHERE t)) AS left_, (SELECT count(*) FROM o WHERE t AND account_key NOT IN (SELECT account_key FROM b WHERE t)) AS entered)
SELECT round(corr(a, c), 9) AS rho, max(left_) AS "left", max(entered) AS entered, max(left_) + max(entered) > 0 AS cutoff_changed FROM j, l)"""


def drop_recall(spark, sf_dir):
    """Recall per typology over all customers and without a hashed tenth of them, and alerts per 10,000 rows."""
    d = scored(spark, sf_dir).withColumn("kept", splits.bucket(F.col("account_key"), "drop") >= 0.1)
    a = evaluate.recall_by(d, "typology", F.col("score") >= 0.6).select("typology", F.col("recall").alias("recall_all"))
    b = evaluate.recall_by(d.filter("kept"), "typology", F.col("score") >= 0.6).select("typology", F.col("recall").alias("recall_kept"))
    n = d.groupBy("typology").agg(evaluate.per_10k(F.count_if(F.col("score") >= 0.6), F.count(F.lit(1))).alias("alerts_per_10k"))
    return _rounded(a.join(b, "typology").join(n, "typology").withColumn("moved", F.abs(F.col("recall_all") - F.col("recall_kept"))))


_DROP = f"""WITH {SC}, d AS (SELECT *, ('0x' || substr(sha256('drop|' || account_key), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE >= 0.1 AS kept FROM sc),
dr AS (SELECT typology, avg(CASE WHEN label = 1 THEN (score >= 0.6)::INT END) AS a, avg(CASE WHEN label = 1 AND kept THEN (score >= 0.6)::INT END) AS b, count(*) FILTER (WHERE score >= 0.6) * 10000 / count(*) AS k FROM d GROUP BY 1)
SELECT typology, round(a, 9) AS recall_all, round(b, 9) AS recall_kept, round(k, 9) AS alerts_per_10k, round(abs(a - b), 9) AS moved FROM dr"""


def availability(spark, sf_dir):
    """Channels over folds, one measured everywhere, one in some folds, one nowhere."""
    d = fold_scored(spark, sf_dir).groupBy("fold").agg(F.avg("score").alias("score"))
    rows = d.select("fold", F.inline(F.array(
        F.struct(F.lit("model").alias("channel"), F.col("score").alias("value")), F.struct(F.lit("rules").alias("channel"), F.when(F.col("fold") % 2 == 0, F.col("score")).alias("value")),
        F.struct(F.lit("graph").alias("channel"), F.lit(None).cast("double").alias("value")))))
    return _rounded(evaluate.availability(rows))


_AVAIL = f"""WITH {FS}, d AS (SELECT fold, avg(score) AS s FROM fs GROUP BY 1), r AS (SELECT 'model' AS channel, s AS value FROM d UNION ALL SELECT 'rules', CASE WHEN fold % 2 = 0 THEN s END FROM d UNION ALL SELECT 'graph', NULL FROM d)
SELECT channel, count(*) AS folds, count(value) AS measured, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, CASE WHEN count(value) = 0 THEN 'unavailable' WHEN count(value) < count(*) THEN 'partial' ELSE 'measured' END AS state FROM r GROUP BY 1"""


# -- scorecard monitoring


def univariate(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("leak", F.col("label") * 10 + F.col("rule_severity"))
    return _rounded(scorecard.univariate_auc(d, ["rows", "outflow_minor", "rule_severity", "leak"]))


_UNI = f"""WITH {SC}, x AS (SELECT 'rows' AS feature, rows::DOUBLE AS s, label FROM sc UNION ALL SELECT 'outflow_minor', outflow_minor, label FROM sc UNION ALL SELECT 'rule_severity', rule_severity, label FROM sc UNION ALL SELECT 'leak', label * 10 + rule_severity, label FROM sc),
y AS (SELECT * FROM x WHERE s IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY s) + (count(*) OVER (PARTITION BY feature, s) - 1) / 2.0 AS r FROM y),
m AS (SELECT feature, count(*) AS n, (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS a FROM r GROUP BY 1)
SELECT feature, n, round(greatest(a, 1 - a), 9) AS auc, greatest(a, 1 - a) > 0.95 AS separates FROM m"""

EDGES = {"rows": [20.0, 40.0, 60.0], "rule_severity": [0.25, 0.5, 0.75], "score": [0.2, 0.4, 0.6, 0.8]}


def selection(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("leak", F.col("label") * 2.0 + 1)
    return _rounded(scorecard.selection(d, {**EDGES, "leak": [2.0]}))


def _iv_sql(f: str, edges: list[float]) -> str:
    at = " + ".join(f"({f} >= {e})::INT" for e in edges)
    return f"""SELECT '{f}' AS feature, sum((g - x) * ln(g / x)) AS iv, (SELECT abs(corr({f}, label)) FROM s2) AS correlation FROM (
  SELECT (n - bad + 0.5::DOUBLE) / (sum(n - bad) OVER () + 0.5::DOUBLE * count(*) OVER ()) AS g, (bad + 0.5::DOUBLE) / (sum(bad) OVER () + 0.5::DOUBLE * count(*) OVER ()) AS x
  FROM (SELECT CASE WHEN {f} IS NULL THEN 'missing' WHEN {f} = 0 THEN 'zero' ELSE 'b' || ({at}) END AS bin, count(*) AS n, sum(label) AS bad FROM s2 GROUP BY 1))"""


_SEL = f"""WITH {SC}, s2 AS (SELECT *, label * 2.0::DOUBLE + 1 AS leak FROM sc), u AS ({" UNION ALL ".join(_iv_sql(f, e) for f, e in {**EDGES, "leak": [2.0]}.items())}),
w AS (SELECT *, CASE WHEN iv < 0.02 THEN 'too_weak' WHEN iv > 0.5 THEN 'too_strong' WHEN correlation > 0.9 THEN 'correlates_with_label' ELSE 'admitted' END AS why FROM u)
SELECT feature, round(iv, 9) AS iv, round(correlation, 9) AS correlation, why = 'admitted' AS admitted, why FROM w"""


def score_drift(spark, sf_dir):
    """Stability of amounts in each test block on the quantile edges of the first fold's training rows."""
    li, folds = _folds(spark, sf_dir)
    d = splits.assign(li, folds).select("fold", "role", F.col("amount_minor").alias("score"))
    p = scorecard.score_psi(d.filter("role = 'train' and fold = 0").select("score"), d.filter("role = 'test'").select("fold", "score"), ["fold"])
    return p.select("fold", F.round("psi", 9).alias("psi"), scorecard.drift_state(F.col("psi")).alias("state"))


_SPSI = f"""WITH {_FOLDS}, b AS (SELECT list_sort(list(amount_minor)) AS a, count(*) AS n FROM ro WHERE role = 'train' AND fold = 0), ed AS (SELECT list_distinct([{", ".join(f"a[CAST(floor({k} * (n - 1) / 10) AS BIGINT) + 1]" for k in range(1, 10))}]) AS e FROM b),
d AS (SELECT fold, role, len(list_filter(e, lambda x: x < amount_minor)) AS bin FROM ro, ed WHERE role IN ('train', 'test')),
x AS (SELECT bin, count(*) / sum(count(*)) OVER () AS e FROM d WHERE role = 'train' AND fold = 0 GROUP BY 1), a AS (SELECT fold, bin, count(*) / sum(count(*)) OVER (PARTITION BY fold) AS a FROM d WHERE role = 'test' GROUP BY 1, 2),
fk AS (SELECT DISTINCT fold FROM a), xe AS (SELECT fk.fold, bin, e FROM x, fk),
j AS (SELECT coalesce(xe.fold, a.fold) AS fold, greatest(coalesce(e, 0), 0.0001::DOUBLE) AS e, greatest(coalesce(a, 0), 0.0001::DOUBLE) AS a FROM xe FULL JOIN a ON xe.fold = a.fold AND xe.bin = a.bin)
SELECT fold, round(sum((a - e) * ln(a / e)), 9) AS psi, CASE WHEN sum((a - e) * ln(a / e)) >= 0.25 THEN 'action' WHEN sum((a - e) * ln(a / e)) >= 0.1 THEN 'watch' ELSE 'stable' END AS state FROM j GROUP BY 1"""


def rates(spark, sf_dir):
    return _rounded(scorecard.positive_rates(fold_scored(spark, sf_dir)))


# -- channels from rules


def _hits(spark, sf_dir, only=("R1", "R2", "R10")):
    e = pay_events(spark, sf_dir)
    return rules.run_rules(e, S, excluded=graph.typed(graph.nodes(e)).filter("node_type in ('rail', 'external')"), only=only)


_HITS = "h AS (" + " UNION ALL ".join(f"SELECT rule_id, account_key, severity, window_end_us FROM ({RULE_SQL[r]})" for r in ("R1", "R2", "R10")) + ")"


def rule_channel(spark, sf_dir):
    """Accounts with what the rules say of them, and the rules-only score."""
    e = pay_events(spark, sf_dir)
    a = e.select(F.explode(F.array("account_from", "account_to")).alias("account_key")).distinct()
    d = models.attach_hits(a, _hits(spark, sf_dir))
    return _rounded(models.rules_only(d, ["rule_severity_sum"]))


_CHANNEL = f"""WITH {EV}, {_HITS}, a AS (SELECT account_from AS account_key FROM ev UNION SELECT account_to FROM ev),
g AS (SELECT account_key, max(severity) AS m, sum(severity) AS s, count(*) AS n, max((rule_id = 'R4')::INT) AS c, max((rule_id IN ('R2', 'R3'))::INT) AS f FROM h GROUP BY 1)
SELECT account_key, round(coalesce(m, 0), 9) AS rule_severity_max, round(coalesce(s, 0), 9) AS rule_severity_sum, coalesce(n, 0) AS rule_hits, coalesce(c, 0) AS in_cycle, coalesce(f, 0) AS in_fan, round(coalesce(s, 0), 9) AS rules_score FROM a LEFT JOIN g USING (account_key)"""


# -- landing and views


def bands(spark, sf_dir):
    _, s, _ = _queue_parts(spark, sf_dir)
    return _rounded(warehouse.band_definitions(s.join(scored(spark, sf_dir).select("account_key", "label"), "account_key")))


_BANDS = f"WITH {SC} SELECT {BAND} AS band, count(*) AS accounts, CAST(sum(label) AS BIGINT) AS positives, round(min(score), 9) AS low, round(max(score), 9) AS high, round(avg(label), 9) AS rate FROM sc GROUP BY 1"


def graph_edges(spark, sf_dir):
    """Edges to land, with whether they cross components (which stand for communities here, as SQL can find them)."""
    e = pay_events(spark, sf_dir)
    small = e.filter("amount_minor > 8000 and txn_type = 'purchase'")
    c = graph.components(small).select(F.col("node").alias("account"), F.col("component").alias("community_id"))
    d = warehouse.graph_rows(graph.nodes(e), graph.pairs(e), c)[2]
    return d.select("account_from", "account_to", "n", "total_minor", "from_community", "to_community", "crosses")


_EDGES = f"""WITH RECURSIVE {EV}, u AS (SELECT DISTINCT account_from AS a, account_to AS b FROM ev WHERE account_from <> account_to AND txn_type = 'purchase' AND amount_minor > 8000),
s AS (SELECT a, b FROM u UNION SELECT b, a FROM u), r AS (SELECT a AS node, a AS c FROM s UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.node), m AS (SELECT node, min(c) AS c FROM r GROUP BY 1),
p AS (SELECT account_from, account_to, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS total_minor FROM ev WHERE account_from <> account_to GROUP BY 1, 2)
SELECT p.*, x.c AS from_community, y.c AS to_community, x.c IS DISTINCT FROM y.c AS crosses FROM p LEFT JOIN m x ON x.node = account_from LEFT JOIN m y ON y.node = account_to"""


def dashboard(spark, sf_dir):
    """Summary, bands and latest patterns as one long table."""
    p, s, _ = _queue_parts(spark, sf_dir)
    full = s.select("account_key", "band").join(p.select("account_key", "exposure_minor"), "account_key")
    summary, per_band, last = warehouse.dashboard(full, _taken(spark, sf_dir, 3000), _hits(spark, sf_dir))
    a = summary.select(F.lit("summary").alias("panel"), F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("long").alias("value")) for c in summary.columns])))
    b = per_band.select(F.lit("band").alias("panel"), F.col("band").alias("item"), F.col("accounts").cast("long").alias("value"))
    c = last.select(F.lit("pattern").alias("panel"), F.concat_ws(":", "rule_id", "account_key").alias("item"), F.col("window_end_us").alias("value"))
    return a.unionByName(b).unionByName(c)


_DASH = f"""WITH RECURSIVE {fitted([3000], ('ev_greedy',))}, {_HITS}, z AS (SELECT count(*) AS accounts, sum(exposure_minor) AS exposure_minor FROM pr), t AS (SELECT count(*) AS reviewed, sum(ev_minor) AS ev_minor, sum(intercept_minor) AS loss_avoided_minor, sum(minutes) AS minutes FROM fit)
SELECT 'summary' AS panel, 'accounts' AS item, accounts::BIGINT AS value FROM z UNION ALL SELECT 'summary', 'exposure_minor', exposure_minor::BIGINT FROM z UNION ALL SELECT 'summary', 'reviewed', reviewed FROM t UNION ALL SELECT 'summary', 'ev_minor', ev_minor::BIGINT FROM t
UNION ALL SELECT 'summary', 'loss_avoided_minor', loss_avoided_minor::BIGINT FROM t UNION ALL SELECT 'summary', 'minutes', minutes::BIGINT FROM t UNION ALL SELECT 'band', {BAND}, count(*) FROM pr GROUP BY 2
UNION ALL (SELECT 'pattern', rule_id || ':' || account_key, window_end_us FROM h ORDER BY window_end_us DESC, rule_id, account_key LIMIT 8)"""

PINNED = 1_705_276_800_000_000


def packet(spark, sf_dir):
    e = pay_events(spark, sf_dir)
    s = e.groupBy(F.col("account_from").alias("account_key")).agg(F.count(F.lit(1)).alias("n")).withColumn("band", F.when(F.col("n") % 2 == 0, "B").otherwise("D"))
    return warehouse.packet("A7", s, _hits(spark, sf_dir), e, graph.typed(graph.nodes(e.filter(F.col("ts_us") <= PINNED))), PINNED)


_PACK = f"""WITH {EV}, {_HITS}, w AS (SELECT * FROM ev WHERE ts_us <= {PINNED}), o AS (SELECT count(*) AS n, sum(CASE WHEN account_from = 'A7' THEN amount_minor END) AS s, sum(CASE WHEN account_to = 'A7' THEN amount_minor END) AS r, max(ts_us) AS z FROM w WHERE account_from = 'A7' OR account_to = 'A7'),
g AS (SELECT * FROM (WITH {_NODES.replace(EV, EV.replace("ev AS (", "eva AS (", 1) + f", ev AS (SELECT * FROM eva WHERE ts_us <= {PINNED})")} SELECT * FROM nd) WHERE account = 'A7')
SELECT 'money' AS section, 'transactions' AS name, n::VARCHAR AS value FROM o UNION ALL SELECT 'money', 'sent_minor', s::BIGINT::VARCHAR FROM o UNION ALL SELECT 'money', 'received_minor', r::BIGINT::VARCHAR FROM o UNION ALL SELECT 'money', 'last_ts_us', z::VARCHAR FROM o
UNION ALL SELECT 'rule', rule_id, severity::VARCHAR FROM h WHERE account_key = 'A7' AND window_end_us <= {PINNED}
UNION ALL SELECT 'graph', 'total_degree', total_degree::VARCHAR FROM g UNION ALL SELECT 'graph', 'counterparties', counterparties::VARCHAR FROM g UNION ALL SELECT 'graph', 'node_type', node_type FROM g
UNION ALL SELECT 'score', 'band', CASE WHEN count(*) % 2 = 0 THEN 'B' ELSE 'D' END FROM ev WHERE account_from = 'A7'"""


def validation(spark, sf_dir):
    return _rounded(warehouse.validation_view(metrics(spark, sf_dir), ablation(spark, sf_dir), fairness(spark, sf_dir)))


_VAL = f"""WITH m AS ({_METRICS}), a AS ({_ABL}), f AS ({_FAIR})
""" + " UNION ALL ".join(
    [f"SELECT 'metrics' AS panel, typology AS item, '{x}' AS measure, {x}::DOUBLE AS value FROM m" for x in ("average_precision", "auroc", "brier", "ks")]
    + [f"SELECT 'ablation', configuration, '{x}', {x}::DOUBLE FROM a" for x in ("average_precision", "auroc")]
    + [f"SELECT 'fairness', bucket::VARCHAR, '{x}', {x}::DOUBLE FROM f" for x in ("negatives", "false_positive_rate")])


def counterfactual(spark, sf_dir):
    """The cheapest change of one feature's bin that moves an account to another band."""
    d = scored(spark, sf_dir)
    pts = lambda f, e: sum((F.when(F.col(f) >= x, 15).otherwise(0) for x in e), F.lit(0))
    d = d.withColumn("p1", pts("rows", EDGES["rows"])).withColumn("p2", pts("rule_severity", EDGES["rule_severity"])).withColumn("card", F.lit(500) + F.col("p1") + F.col("p2"))
    band = F.when(F.col("card") < 530, "E").when(F.col("card") < 560, "C").otherwise("A")
    long = d.select("account_key", F.col("card").alias("score"), band.alias("band"), F.inline(F.array(F.struct(F.lit("rows").alias("feature"), F.col("p1").alias("points")), F.struct(F.lit("rule_severity").alias("feature"), F.col("p2").alias("points")))))
    bins = spark.createDataFrame([(f, f"b{k}", 15 * k) for f in ("rows", "rule_severity") for k in range(4)], "feature string, label string, points int")
    return warehouse.counterfactuals(long, bins, spark.createDataFrame([("E", 0, 530), ("C", 530, 560), ("A", 560, 10_000)], "band string, low int, high int"))


_CF = f"""WITH {SC}, p AS (SELECT account_key, 15 * ({" + ".join(f"(rows >= {e})::INT" for e in EDGES["rows"])}) AS p1, 15 * ({" + ".join(f"(rule_severity >= {e})::INT" for e in EDGES["rule_severity"])}) AS p2 FROM sc),
s AS (SELECT *, 500 + p1 + p2 AS score FROM p), b AS (SELECT *, CASE WHEN score < 530 THEN 'E' WHEN score < 560 THEN 'C' ELSE 'A' END AS band FROM s), l AS (SELECT account_key, score, band, 'rows' AS feature, p1 AS points FROM b UNION ALL SELECT account_key, score, band, 'rule_severity', p2 FROM b),
x AS (SELECT l.*, 'b' || k AS to_label, abs(15 * k - points)::INT AS change, (score - points + 15 * k)::INT AS new_score FROM l, range(4) r(k) WHERE 15 * k <> points),
y AS (SELECT *, CASE WHEN new_score < 530 THEN 'E' WHEN new_score < 560 THEN 'C' ELSE 'A' END AS new_band FROM x)
SELECT account_key, band, m.change AS change, m.feature AS feature, m.to_label AS to_label, m.new_band AS new_band, m.new_score AS new_score FROM (SELECT account_key, band, min({{'change': change, 'feature': feature, 'to_label': to_label, 'new_band': new_band, 'new_score': new_score}}) AS m FROM y WHERE new_band <> band GROUP BY 1, 2)"""


QUERIES = {
    "fold_ledgers": fold_ledgers, "policy_over_folds": over_folds, "ablation_table": ablation, "metric_over_runs": seeds, "money_shift": shift, "recall_under_drop": drop_recall, "channel_availability": availability,
    "univariate_auc": univariate, "feature_selection": selection, "score_drift": score_drift, "positive_rates": rates, "rule_channel": rule_channel, "band_definitions": bands, "graph_edges_landed": graph_edges,
    "dashboard": dashboard, "case_packet": packet, "validation_view": validation, "counterfactuals": counterfactual,
}
ORACLE = {
    "fold_ledgers": f"{_LED} SELECT * FROM led", "policy_over_folds": _OVER, "ablation_table": _ABL, "metric_over_runs": _SEEDS, "money_shift": f"{_shift_sql(90)} UNION ALL {_shift_sql(110)}", "recall_under_drop": _DROP,
    "channel_availability": _AVAIL, "univariate_auc": _UNI, "feature_selection": _SEL, "score_drift": _SPSI,
    "positive_rates": f"WITH {FS} SELECT fold, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 9) AS rate FROM fs GROUP BY 1", "rule_channel": _CHANNEL, "band_definitions": _BANDS,
    "graph_edges_landed": _EDGES, "dashboard": _DASH, "case_packet": _PACK, "validation_view": _VAL, "counterfactuals": _CF,
}
