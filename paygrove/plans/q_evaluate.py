"""Split, metric and pricing queries over customers scored from pay_lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paygrove.operators import evaluate, pricing, splits
from paygrove.plans.tables import DAY, EV, LI, lineitem_ends, pay_events, pay_lineitem
from paygrove.session import scratch_table

A = pricing.Assumptions()
#: Economics of the event corpus, in its own currency and the size of its payments.
UGX = pricing.Assumptions(currency="UGX", cost_per_minute_minor=100, friction_minor=200, minor_per_minute=20_000)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: a score from amounts, a label, an exposure and a proxy axis.

    Written once: payments are read, joined and numbered in one pass, however often a query reads the customers.
    """
    li = pay_lineitem(spark, sf_dir)
    g = li.groupBy(F.col("account_from").alias("account_key")).agg(
        F.sum("amount_minor").alias("total"), F.count(F.lit(1)).alias("rows"), F.max("label_is_fraud").alias("label"), F.max("ts_us").alias("ts_us"),
        F.sum(F.when(F.col("channel") == "O", F.col("amount_minor"))).alias("outflow_minor"))
    d = g.withColumn("score", (F.col("total") % 997) / F.lit(1000.0)).withColumn("currency", F.when(F.col("total") % 50 == 0, "EUR").otherwise("USD"))
    d = d.withColumn("typology", F.element_at(F.array(F.lit("fan-in"), F.lit("cycle"), F.lit("other")), (F.col("total") % 3 + 1).cast("int"))).withColumn("rule_severity", (F.col("total") % 101) / F.lit(100.0))
    return scratch_table(d, "scored")


SC = f"""{LI}, g AS (SELECT account_from AS account_key, CAST(sum(amount_minor) AS BIGINT) AS total, count(*) AS rows, max(label_is_fraud) AS label, max(ts_us) AS ts_us,
  CAST(sum(CASE WHEN channel = 'O' THEN amount_minor END) AS BIGINT) AS outflow_minor FROM li GROUP BY 1),
sc AS (SELECT *, (total % 997) / 1000.0::DOUBLE AS score, CASE WHEN total % 50 = 0 THEN 'EUR' ELSE 'USD' END AS currency, ['fan-in', 'cycle', 'other'][total % 3 + 1] AS typology, (total % 101) / 100.0::DOUBLE AS rule_severity FROM g)"""


def _folds(spark, sf_dir):
    return pay_lineitem(spark, sf_dir), splits.plan(lineitem_ends(spark, sf_dir))


def fold_audit(spark, sf_dir):
    return splits.audit(*_folds(spark, sf_dir))


_FOLDS = f"""{LI}, t AS (SELECT min(ts_us) AS a, max(ts_us) + 1 - min(ts_us) AS span FROM li),
k AS (SELECT k::INT AS fold, a + trunc(span * 0.4::DOUBLE)::BIGINT + k * trunc(span * (1 - 0.4::DOUBLE) / 5)::BIGINT AS known, a, trunc(span * (1 - 0.4::DOUBLE) / 5)::BIGINT AS step FROM t, range(5) r(k)),
fo AS (SELECT fold, a AS train_start, known - trunc((known - a) * 0.15::DOUBLE)::BIGINT AS train_end, known AS valid_end, known + {30 * DAY} AS test_start, known + step AS test_end FROM k),
ro AS (SELECT li.*, fold, CASE WHEN ts_us >= train_start AND ts_us < train_end - {DAY} THEN 'train' WHEN ts_us >= train_end - {DAY} AND ts_us < train_end THEN 'purged' WHEN ts_us >= train_end AND ts_us < valid_end THEN 'valid'
  WHEN ts_us >= valid_end AND ts_us < test_start THEN 'embargo' WHEN ts_us >= test_start AND ts_us < test_end THEN 'test' END AS role FROM li, fo)"""


def fold_plan(spark, sf_dir):
    return splits.frame(spark, _folds(spark, sf_dir)[1]).drop("purge_us")


def fold_decisions(spark, sf_dir):
    li, folds = _folds(spark, sf_dir)
    d = splits.assign(li.withColumnRenamed("account_from", "account_key"), folds).filter("role = 'test'")
    return splits.decisions(d)


def fold_ids(spark, sf_dir):
    li, folds = _folds(spark, sf_dir)
    return splits.fold_of(li, folds).groupBy(F.coalesce("fold", F.lit(-1)).alias("fold")).agg(F.count(F.lit(1)).alias("n"))


def holdout(spark, sf_dir):
    h = splits.entity_holdout(scored(spark, sf_dir).select("account_key"), 0.2)
    return splits.holdout_size(h, 0.2)


_HOLD = f"""WITH {SC}, h AS (SELECT ('0x' || substr(sha256('holdout|' || account_key), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.2 AS h FROM sc)
SELECT count(*) AS n, count(*) FILTER (WHERE h) AS held_out, abs(count(*) FILTER (WHERE h) - count(*) * 0.2) <= 4 * sqrt(count(*) * 0.16) + 1 AS in_band FROM h"""


def leak_guard(spark, sf_dir):
    """Events that train and test of a fold share, some planted: every event of the training rows whose amount ends in 77."""
    li, folds = _folds(spark, sf_dir)
    d = splits.assign(li, folds)
    train = d.filter("role = 'train'")
    test = d.filter("role = 'test'").select("fold", "txn_id").unionByName(train.filter("amount_minor % 100 = 77").select("fold", "txn_id"))
    return splits.shared_keys(train.select("fold", "txn_id"), test, ["fold", "txn_id"]).groupBy("fold").agg(F.count(F.lit(1)).alias("shared"))


_LEAK = f"WITH {_FOLDS} SELECT fold, count(*) AS shared FROM ro WHERE role = 'train' AND amount_minor % 100 = 77 GROUP BY 1"


def feasibility(spark, sf_dir):
    a = splits.feasibility(pay_lineitem(spark, sf_dir), 30).withColumn("corpus", F.lit("lineitem"))
    b = splits.feasibility(pay_events(spark, sf_dir), 30).withColumn("corpus", F.lit("events"))
    return a.unionByName(b).withColumn("days", F.round("days", 6)).withColumn("needed_days", F.round("needed_days", 6))


_FEAS = f"""WITH {EV}, {LI}, u AS (SELECT 'events' AS corpus, (max(ts_us) - min(ts_us)) / {DAY} AS d FROM ev UNION ALL SELECT 'lineitem', (max(ts_us) - min(ts_us)) / {DAY} FROM li)
SELECT corpus, round(d, 6) AS days, 250.0::DOUBLE AS needed_days, d * 0.6 / 5 > 30 AS feasible FROM u"""


def metrics(spark, sf_dir):
    d = evaluate.measure(scored(spark, sf_dir), ["typology"])
    return d.withColumns({c: F.round(c, 9) for c, t in d.dtypes if t == "double"})


_METRICS = f"""WITH {SC}, s AS (SELECT typology, score, count(*) AS n, sum(label) AS p FROM sc GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER w AS nt, sum(p) OVER w AS pt, sum(n) OVER a AS na, sum(p) OVER a AS pa FROM s WINDOW w AS (PARTITION BY typology ORDER BY score DESC), a AS (PARTITION BY typology)),
m AS (SELECT typology, sum(p * pt / nt) / max(pa) AS ap, max(abs(pt / pa - (nt - pt) / (na - pa))) AS ks FROM c GROUP BY 1),
u AS (SELECT x.typology, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0.0 END) AS auroc FROM sc x JOIN sc y ON x.typology = y.typology AND x.label = 1 AND y.label = 0 GROUP BY 1),
b AS (SELECT typology, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, avg(label) AS base_rate, avg((score - label) ** 2) AS brier FROM sc GROUP BY 1)
SELECT typology, n, positives, round(base_rate, 9) AS base_rate, round(ap, 9) AS average_precision, round(auroc, 9) AS auroc, round(brier, 9) AS brier, round(ks, 9) AS ks FROM b JOIN m USING (typology) JOIN u USING (typology)"""


def ap_by_key(spark, sf_dir):
    s = scored(spark, sf_dir)
    d = evaluate.average_precision(s, []).join(evaluate.at_budget(s, [], 100))
    return d.select(*[F.round(c, 9).alias(c) for c in d.columns])


_AP = f"""WITH {SC}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, account_key) AS r, sum(label) OVER (ORDER BY score DESC, account_key ROWS UNBOUNDED PRECEDING) AS c FROM sc)
SELECT round(sum(CASE WHEN label = 1 THEN c / r END) / sum(label), 9) AS average_precision, round(sum(CASE WHEN r <= 100 THEN label END) / least(100, count(*)), 9) AS precision, round(sum(CASE WHEN r <= 100 THEN label END) / sum(label), 9) AS recall FROM r"""


def reliability(spark, sf_dir):
    d = evaluate.reliability(scored(spark, sf_dir))
    return d.select("bin", "n", *[F.round(c, 9).alias(c) for c in ("mean_score", "observed", "gap")])


_REL = f"WITH {SC} SELECT CAST(least(floor(score * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(label), 9) AS observed, round(abs(avg(score) - avg(label)), 9) AS gap FROM sc GROUP BY 1"


def reliability_counts(spark, sf_dir):
    d = evaluate.reliability_equal_count(scored(spark, sf_dir))
    e = evaluate.ece(d)
    return d.join(e).select("bin", "n", *[F.round(c, 9).alias(c) for c in ("mean_score", "observed", "ece")])


_RELC = f"""WITH {SC}, s AS (SELECT score, count(*) AS n, sum(label) AS p FROM sc GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS nt, sum(n) OVER () AS na FROM s),
b AS (SELECT CAST((nt - n) * 10 // na AS INT) AS bin, CAST(sum(n) AS BIGINT) AS n, sum(score * n) / sum(n) AS m, sum(p) / sum(n) AS o FROM c GROUP BY 1)
SELECT bin, n, round(m, 9) AS mean_score, round(o, 9) AS observed, round((SELECT sum(n * abs(m - o)) / sum(n) FROM b), 9) AS ece FROM b"""


def typology_recall(spark, sf_dir):
    return evaluate.recall_by(scored(spark, sf_dir), "typology", F.col("score") >= 0.6).withColumn("recall", F.round("recall", 9))


_RECALL = f"WITH {SC} SELECT typology, count(*) AS positives, round(avg((score >= 0.6)::INT), 9) AS recall FROM sc WHERE label = 1 GROUP BY 1"


def fairness(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("picked", F.col("score") >= 0.6)
    return evaluate.false_positive_rates(d, "rows", "picked").withColumn("false_positive_rate", F.round("false_positive_rate", 9))


_FAIR = f"""WITH {SC}, c AS (SELECT rows, count(*) AS n FROM sc GROUP BY 1), b AS (SELECT rows, CAST((sum(n) OVER () - sum(n) OVER (ORDER BY rows DESC)) * 4 // sum(n) OVER () AS INT) AS bucket FROM c)
SELECT bucket, count(*) AS negatives, round(avg((score >= 0.6)::INT), 9) AS false_positive_rate FROM sc JOIN b USING (rows) WHERE label = 0 GROUP BY 1"""


def rank_correlation(spark, sf_dir):
    return evaluate.spearman(scored(spark, sf_dir), "score", "rows").withColumn("rho", F.round("rho", 9))


_RHO = f"""WITH {SC}, r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY rows) + (count(*) OVER (PARTITION BY rows) - 1) / 2.0 AS b FROM sc)
SELECT round(corr(a, b), 9) AS rho FROM r"""


def bootstrap(spark, sf_dir):
    return evaluate.bootstrap_ap(scored(spark, sf_dir))


def tail(spark, sf_dir):
    """Losses of the accounts that the greedy policy leaves unreviewed."""
    taken = pricing.first_fit(_cands(spark, sf_dir), evaluate.policy_order("ev_greedy"), [3000])
    d = scored(spark, sf_dir).join(taken.select("account_key"), "account_key", "left_anti").withColumn("loss_minor", F.col("total"))
    return evaluate.residual_tail(d)


def score_percentiles(spark, sf_dir):
    d = evaluate.percentiles(scored(spark, sf_dir), "score")
    return d.select(*[F.round(c, 9).alias(c) for c in d.columns])


_PCT = f"WITH {SC} SELECT " + ", ".join(f"round(quantile_cont(score, {q}), 9) AS p{int(q * 100):02d}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM sc"


def priced(spark, sf_dir):
    d = pricing.price(pricing.attach(scored(spark, sf_dir), A), A)
    return d.select("account_key", "exposure_minor", "minutes", "intercept_minor", "review_cost_minor", "friction_minor", F.coalesce("ev_minor", F.lit(0)).alias("ev_minor"), F.coalesce("refusal", F.lit("")).alias("refusal"))


def priced_sql(sc: str, a: pricing.Assumptions, recovery: int | None = None) -> str:
    """CTEs of pricing: ``sc`` with the table sc, then pr, under the assumptions."""
    return f"""{sc}, att AS (SELECT *, coalesce(outflow_minor, 0) AS exposure_minor, CAST(greatest({a.minutes[0]}, least({a.minutes[1]}, coalesce(outflow_minor, 0) // {a.minor_per_minute})) AS INT) AS minutes, CAST(round(score * 1000000) AS BIGINT) AS pm FROM sc),
p0 AS (SELECT *, minutes * {a.cost_per_minute_minor}::BIGINT AS review_cost_minor, CAST((2 * pm::HUGEINT * {recovery or a.recovery_micro} + 1000000) // 2000000 AS BIGINT) AS joint, CAST((2 * {a.friction_minor}::HUGEINT * (1000000 - pm) + 1000000) // 2000000 AS BIGINT) AS friction_minor FROM att),
p1 AS (SELECT *, CAST((2 * exposure_minor::HUGEINT * joint + 1000000) // 2000000 AS BIGINT) AS intercept_minor FROM p0),
pr AS (SELECT *, CASE WHEN currency = '{a.currency}' THEN intercept_minor - review_cost_minor - friction_minor END AS ev_minor FROM p1)"""


PR = priced_sql(SC, A)
_PRICED = f"WITH {PR} SELECT account_key, exposure_minor, minutes, intercept_minor, review_cost_minor, friction_minor, coalesce(ev_minor, 0) AS ev_minor, CASE WHEN currency <> 'USD' THEN 'unpriced: ' || currency || ' exposure against USD costs' ELSE '' END AS refusal FROM pr"


def _cands(spark, sf_dir):
    return pricing.candidates(pricing.price(pricing.attach(scored(spark, sf_dir), A), A))


CAPS = [60, 600, 3000]
GRID = list(range(0, 12_001, 400))


def greedy(spark, sf_dir):
    return pricing.first_fit(_cands(spark, sf_dir), evaluate.policy_order("ev_greedy"), CAPS).select("capacity", "account_key", "minutes")


_ORDERS = {
    "threshold": "score DESC", "rules_only": "rule_severity DESC", "highest_amount": "exposure_minor DESC", "random": "('0x' || substr(sha256('5|' || account_key), 1, 13))::BIGINT", "ev_greedy": "ev_minor / minutes DESC",
}


def fitted(caps: list[int], policies=tuple(_ORDERS), base: str = PR) -> str:
    """CTEs of first fit: what each policy takes within each capacity (fit), one candidate after the other; ``base`` makes pr."""
    q = " UNION ALL ".join(f"SELECT '{n}' AS policy, pr.*, row_number() OVER (ORDER BY {_ORDERS[n]}, account_key) AS r FROM pr WHERE ev_minor > 0" for n in policies)
    return f"""{base}, q AS ({q}), cp AS (SELECT unnest({caps}) AS c), po AS (SELECT unnest({list(policies)}) AS policy),
f AS (SELECT policy, c::BIGINT AS capacity, 0::BIGINT AS r, c::BIGINT AS left_, false AS took FROM cp, po
  UNION ALL SELECT f.policy, f.capacity, q.r, CASE WHEN q.minutes <= left_ THEN left_ - q.minutes ELSE left_ END, q.minutes <= left_ FROM f JOIN q ON q.r = f.r + 1 AND q.policy = f.policy),
fit AS (SELECT capacity, q.* FROM f JOIN q ON q.policy = f.policy AND q.r = f.r WHERE took)"""


_GREEDY = f"WITH RECURSIVE {fitted(CAPS, ('ev_greedy',))} SELECT capacity, account_key, minutes FROM fit"


def frontier(spark, sf_dir):
    """All five policies over 31 capacities."""
    return pricing.frontier(evaluate.by_policy(_cands(spark, sf_dir)), GRID, evaluate.POLICIES).drop("expected_wrong_touches")


_FRONT = f"""WITH RECURSIVE {fitted(GRID)}, t AS (SELECT policy, capacity, count(*) AS accounts, sum(ev_minor) AS ev, sum(intercept_minor) AS la, sum(review_cost_minor) AS rc, sum(friction_minor) AS fr, sum(exposure_minor) AS ex, sum(minutes) AS mi FROM fit GROUP BY 1, 2),
p AS (SELECT po.policy, c::BIGINT AS capacity, coalesce(accounts, 0) AS accounts, CAST(coalesce(ev, 0) AS BIGINT) AS ev_minor, CAST(coalesce(la, 0) AS BIGINT) AS loss_avoided_minor, CAST(coalesce(rc, 0) AS BIGINT) AS review_cost_minor,
  CAST(coalesce(fr, 0) AS BIGINT) AS friction_minor, CAST(coalesce(ex, 0) AS BIGINT) AS exposure_minor, CAST(coalesce(mi, 0) AS BIGINT) AS minutes FROM cp CROSS JOIN po LEFT JOIN t ON t.policy = po.policy AND t.capacity = c)
SELECT *, ev_minor - coalesce(lag(ev_minor) OVER (PARTITION BY policy ORDER BY capacity), 0) AS gain_minor, ev_minor = max(ev_minor) OVER (PARTITION BY capacity) AS best,
  max(ev_minor) OVER (PARTITION BY capacity) > ev_minor AND arg_max(minutes, (ev_minor, -minutes)) OVER (PARTITION BY capacity) <= minutes AS dominated,
  capacity = arg_min(capacity, (-ev_minor, capacity)) OVER (PARTITION BY policy) AS operating FROM p"""


def policy_gap(spark, sf_dir):
    """What the greedy policy gains on the threshold at one capacity."""
    c = _cands(spark, sf_dir)
    a, b = (pricing.first_fit(c, evaluate.policy_order(n), [3000]) for n in ("ev_greedy", "threshold"))
    return pricing.gap(a, b)


_GAP = f"WITH RECURSIVE {fitted([3000])} SELECT CAST(sum(CASE policy WHEN 'ev_greedy' THEN ev_minor WHEN 'threshold' THEN -ev_minor ELSE 0 END) AS BIGINT) AS gap_minor FROM fit"


def recovery(spark, sf_dir):
    return pricing.recovery_band(pricing.attach(scored(spark, sf_dir), A), A).withColumn("expected_wrong_touches", F.round("expected_wrong_touches", 6))


_RECOV = f"""WITH {PR}, x AS (SELECT unnest([150000, 300000, 450000]) AS recovery_micro), j AS (SELECT pr.*, x.recovery_micro AS rm, CAST((2 * pm::HUGEINT * x.recovery_micro + 1000000) // 2000000 AS BIGINT) AS jj FROM pr, x WHERE currency = 'USD'),
k AS (SELECT *, CAST((2 * exposure_minor::HUGEINT * jj + 1000000) // 2000000 AS BIGINT) AS ii FROM j), l AS (SELECT *, ii - review_cost_minor - friction_minor AS ev FROM k)
SELECT rm AS recovery_micro, count(*) AS accounts, CAST(sum(ev) AS BIGINT) AS ev_minor, CAST(sum(ii) AS BIGINT) AS loss_avoided_minor, CAST(sum(review_cost_minor) AS BIGINT) AS review_cost_minor, CAST(sum(friction_minor) AS BIGINT) AS friction_minor,
  CAST(sum(exposure_minor) AS BIGINT) AS exposure_minor, CAST(sum(minutes) AS BIGINT) AS minutes, round(sum(1 - score), 6) AS expected_wrong_touches FROM l WHERE ev > 0 GROUP BY 1"""


def exposure(spark, sf_dir):
    e = pay_events(spark, sf_dir)
    t = e.filter("txn_type = 'purchase' and amount_minor > 15000").select(F.col("account_from").alias("account"), F.col("ts_us").alias("t_us"))
    return pricing.exposures(t, e)


_EXPO = f"""WITH {EV}, t AS (SELECT DISTINCT account_from AS account, ts_us AS t_us FROM ev WHERE txn_type = 'purchase' AND amount_minor > 15000), e AS (SELECT * FROM ev WHERE account_from <> account_to),
c1 AS (SELECT account, t_us, account AS m FROM t UNION SELECT t.account, t_us, e.account_to FROM t JOIN e ON e.account_from = t.account AND ts_us BETWEEN t_us AND t_us + {DAY - 1}),
c AS (SELECT * FROM c1 UNION SELECT c1.account, t_us, e.account_to FROM c1 JOIN e ON e.account_from = c1.m AND ts_us BETWEEN t_us AND t_us + {DAY - 1}),
o AS (SELECT account, t_us, sum(amount_minor) AS o FROM c JOIN e ON e.account_from = m AND ts_us BETWEEN t_us AND t_us + {DAY - 1} GROUP BY 1, 2), i AS (SELECT account, t_us, sum(amount_minor) AS i FROM c JOIN e ON e.account_to = m AND ts_us BETWEEN t_us AND t_us + {DAY - 1} GROUP BY 1, 2)
SELECT account, t_us, CAST(coalesce(o, 0) AS BIGINT) AS outflow_minor, CAST(coalesce(i, 0) AS BIGINT) AS inflow_minor, CAST(least(coalesce(o, 0), coalesce(i, 0)) AS BIGINT) AS exposure_minor FROM t LEFT JOIN o USING (account, t_us) LEFT JOIN i USING (account, t_us)"""


def propagation(spark, sf_dir):
    e = pay_events(spark, sf_dir)
    s = e.filter("label_is_fraud = 1").groupBy(F.col("account_from").alias("account")).agg(F.sum("amount_minor").alias("amount_minor"))
    return pricing.propagate(e, s).withColumn("amount_minor", F.round("amount_minor", 3))


_PROP = f"""WITH {EV}, e0 AS (SELECT account_from AS s, account_to AS t, sum(amount_minor) AS m FROM ev WHERE account_from <> account_to GROUP BY 1, 2), e AS (SELECT s, t, m / sum(m) OVER (PARTITION BY s) AS w FROM e0),
a0 AS (SELECT account_from AS account, CAST(sum(amount_minor) AS DOUBLE) AS x FROM ev WHERE label_is_fraud = 1 GROUP BY 1), a1 AS (SELECT t AS account, sum(x * w) AS x FROM a0 JOIN e ON s = account GROUP BY 1),
a2 AS (SELECT t AS account, sum(x * w) AS x FROM a1 JOIN e ON s = account GROUP BY 1), a3 AS (SELECT t AS account, sum(x * w) AS x FROM a2 JOIN e ON s = account GROUP BY 1), a4 AS (SELECT t AS account, sum(x * w) AS x FROM a3 JOIN e ON s = account GROUP BY 1)
SELECT account, round(x, 3) AS amount_minor, step FROM (SELECT *, 0 AS step FROM a0 UNION ALL SELECT *, 1 FROM a1 UNION ALL SELECT *, 2 FROM a2 UNION ALL SELECT *, 3 FROM a3 UNION ALL SELECT *, 4 FROM a4)"""


def ledger(spark, sf_dir):
    """Realised ledger of all five policies at one capacity, per typology."""
    c = evaluate.by_policy(_cands(spark, sf_dir).withColumn("recoverable_minor", F.col("intercept_minor")))
    return evaluate.fold_ledger(pricing.first_fit(c, [F.col("place"), F.col("account_key")], [3000], ("policy",)), ["policy", "typology"])


_LEDGER = f"""WITH RECURSIVE {fitted([3000])}, led AS (SELECT policy, typology, count(*) AS reviewed, CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(CASE WHEN label = 1 THEN intercept_minor ELSE 0 END) AS BIGINT) AS captured_minor,
  CAST(sum(review_cost_minor) AS BIGINT) AS review_cost_minor, CAST(sum(CASE WHEN label = 0 THEN friction_minor ELSE 0 END) AS BIGINT) AS friction_minor FROM fit GROUP BY 1, 2)
SELECT *, captured_minor - review_cost_minor - friction_minor AS net_minor FROM led"""


QUERIES = {
    "fold_plan": fold_plan, "fold_audit": fold_audit, "fold_decisions": fold_decisions, "fold_ids": fold_ids, "entity_holdout": holdout, "leak_guard": leak_guard, "feasibility": feasibility,
    "metrics_by_slice": metrics, "metrics_by_key": ap_by_key, "reliability": reliability, "reliability_counts": reliability_counts, "typology_recall": typology_recall, "fairness": fairness,
    "rank_correlation": rank_correlation, "bootstrap_interval": bootstrap, "residual_tail": tail, "score_percentiles": score_percentiles, "priced_accounts": priced, "first_fit": greedy,
    "frontier": frontier, "recovery_band": recovery, "exposure": exposure, "propagation": propagation, "policy_ledger": ledger, "policy_gap": policy_gap,
}
ORACLE = {
    "fold_plan": f"WITH {_FOLDS} SELECT * FROM fo", "fold_audit": f"WITH {_FOLDS} SELECT fold, role, count(*) AS n, CAST(sum(label_is_fraud) AS BIGINT) AS positives FROM ro WHERE role IS NOT NULL GROUP BY 1, 2",
    "fold_decisions": f"WITH {_FOLDS} SELECT account_from AS account_key, fold, arg_max(amount_minor, (ts_us, txn_id)) AS amount_minor, max(ts_us) AS ts_us, max(label_is_fraud) AS label_is_fraud, count(*) AS rows FROM ro WHERE role = 'test' GROUP BY 1, 2",
    "fold_ids": f"WITH {_FOLDS} SELECT coalesce(fold, -1) AS fold, count(*) AS n FROM li LEFT JOIN fo ON ts_us >= test_start AND ts_us < test_end GROUP BY 1",
    "entity_holdout": _HOLD, "leak_guard": _LEAK, "feasibility": _FEAS, "metrics_by_slice": _METRICS, "metrics_by_key": _AP, "reliability": _REL, "reliability_counts": _RELC,
    "typology_recall": _RECALL, "fairness": _FAIR, "rank_correlation": _RHO, "score_percentiles": _PCT, "priced_accounts": _PRICED, "first_fit": _GREEDY, "recovery_band": _RECOV, "exposure": _EXPO,
    "propagation": _PROP, "frontier": _FRONT, "policy_ledger": _LEDGER, "policy_gap": _GAP,
}
