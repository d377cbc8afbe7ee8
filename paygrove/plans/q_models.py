"""Scorecard and model queries over customers, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from paygrove.operators import folds, models, pricing, scorecard, splits, stack, warehouse
from paygrove.plans.q_evaluate import _FOLDS, SC, UGX, _folds, scored
from paygrove.plans.tables import pay_events
from paygrove.session import checkpoint

NUM, CAT = ["rows", "outflow_minor", "rule_severity"], ["typology"]
EDGES = [20.0, 40.0, 60.0]


def _parted(spark, sf_dir):
    """All customers, those to fit on and those held out, from one written table."""
    every = scored(spark, sf_dir)
    d = every.withColumn("held", splits.bucket(F.col("account_key"), "train") >= 0.7)
    return every, d.filter("not held"), d.filter("held")


def bin_table(spark, sf_dir):
    d = scorecard.bin_table(scored(spark, sf_dir), "rows", EDGES)
    return d.withColumns({c: F.round(c, 9) for c in ("woe", "iv_part")})


_BIN = f"""WITH {SC}, b AS (SELECT CASE WHEN rows IS NULL THEN 'missing' WHEN rows = 0 THEN 'zero' ELSE 'b' || ((rows >= 20)::INT + (rows >= 40)::INT + (rows >= 60)::INT) END AS bin, count(*) AS n, CAST(sum(label) AS BIGINT) AS bad FROM sc GROUP BY 1),
c AS (SELECT *, (n - bad + 0.5::DOUBLE) / (sum(n - bad) OVER () + 0.5::DOUBLE * count(*) OVER ()) AS g, (bad + 0.5::DOUBLE) / (sum(bad) OVER () + 0.5::DOUBLE * count(*) OVER ()) AS x FROM b)
SELECT bin, n, bad, round(ln(g / x), 9) AS woe, round((g - x) * ln(g / x), 9) AS iv_part FROM c"""


def card(spark, sf_dir):
    """Points per customer of a fitted card, its score and reasons."""
    every, t, _ = _parted(spark, sf_dir)
    c = scorecard.fit(t, NUM, CAT)
    d = scorecard.score(every, c)
    return d.select("account_key", "card_score", *[f"points_{f}" for f in c.bins]).join(scorecard.reasons(d, list(c.bins)), "account_key").withColumn("reasons", F.concat_ws("; ", "reasons"))


def card_bands(spark, sf_dir):
    every, t, _ = _parted(spark, sf_dir)
    return scorecard.bands(scorecard.score(every, scorecard.fit(t, NUM)))


def drift(spark, sf_dir):
    """Stability of amounts' bins between the first fold's training rows and each test block."""
    d = splits.assign(*_folds(spark, sf_dir)).withColumn("bin", F.concat(F.lit("b"), F.least(F.lit(9), F.floor(F.col("amount_minor") / 1_000_000)).cast("string")))
    e = d.filter("role = 'train'").select("fold", "bin")
    a = d.filter("role = 'test'").select("fold", "bin")
    p = scorecard.psi(e, a, ["fold"]).groupBy("fold").agg(F.sum("csi").alias("psi"))
    return p.select("fold", F.round("psi", 9).alias("psi"), scorecard.drift_state(F.col("psi")).alias("state"))


_DRIFT = f"""WITH {_FOLDS}, d AS (SELECT fold, role, 'b' || least(9, amount_minor // 1000000) AS bin FROM ro),
e AS (SELECT fold, bin, count(*) / sum(count(*)) OVER (PARTITION BY fold) AS e FROM d WHERE role = 'train' GROUP BY 1, 2), a AS (SELECT fold, bin, count(*) / sum(count(*)) OVER (PARTITION BY fold) AS a FROM d WHERE role = 'test' GROUP BY 1, 2),
j AS (SELECT coalesce(e.fold, a.fold) AS fold, greatest(coalesce(e, 0), 0.0001::DOUBLE) AS e, greatest(coalesce(a, 0), 0.0001::DOUBLE) AS a FROM e FULL JOIN a ON e.fold = a.fold AND e.bin = a.bin)
SELECT fold, round(sum((a - e) * ln(a / e)), 9) AS psi, CASE WHEN sum((a - e) * ln(a / e)) >= 0.25 THEN 'action' WHEN sum((a - e) * ln(a / e)) >= 0.1 THEN 'watch' ELSE 'stable' END AS state FROM j GROUP BY 1"""


def _banded(spark, sf_dir):
    li, plan = _folds(spark, sf_dir)
    d = splits.assign(li.withColumnRenamed("account_from", "account_key"), plan).filter("role = 'test'")
    g = d.groupBy("account_key", "fold").agg(F.sum("amount_minor").alias("m"))
    return g.withColumn("band", F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (F.col("m") % 5 + 1).cast("int")))


def migration(spark, sf_dir):
    return scorecard.migration(_banded(spark, sf_dir))


def migration_rates(spark, sf_dir):
    r = scorecard.migration_rates(migration(spark, sf_dir))
    return r.select("fold", "n", F.round("downgraded", 9).alias("downgraded"), F.round("upgraded", 9).alias("upgraded"))


_MIG = f"""{_FOLDS}, b AS (SELECT account_from AS k, fold, ['A','B','C','D','E'][CAST(sum(amount_minor) % 5 AS INT) + 1] AS band FROM ro WHERE role = 'test' GROUP BY 1, 2),
m AS (SELECT y.fold, x.band AS from_band, y.band AS to_band, count(*) AS n FROM b x JOIN b y ON x.k = y.k AND y.fold = x.fold + 1 GROUP BY 1, 2, 3)"""


def _three(spark, sf_dir):
    """Training, validation and test customers, by hash."""
    u = splits.bucket(F.col("account_key"), "three")
    d = scored(spark, sf_dir).withColumn("label", F.col("label").cast("double"))
    return d.filter(u < 0.6), d.filter((u >= 0.6) & (u < 0.8)), d.filter(u >= 0.8)


def boosted(spark, sf_dir):
    """Boosted trees on training customers, as many as rank validation ones best, scores of the test ones."""
    t, v, h = (models.matrix(x, NUM, CAT)[0] for x in _three(spark, sf_dir))
    m = models.boosted(t, v, trees=20, depth=3)
    return m.transform(h, "p").select("account_key", "label", "p")


def tuning(spark, sf_dir):
    """The trials of the search over depth and step, with the size and the validation average precision of each."""
    t, v, _ = (models.matrix(x, NUM, CAT)[0] for x in _three(spark, sf_dir))
    _, trials = models.tune(checkpoint(t), checkpoint(v))
    return spark.createDataFrame(trials, "depth int, step double, trees int, average_precision double")


def anomaly(spark, sf_dir):
    _, t, h = _parted(spark, sf_dir)
    ref = models.robust_distance(t, t, NUM)
    return models.percentile_rank(ref, models.robust_distance(t, h, NUM), "distance").select("account_key", "distance", "anomaly")


def fused(spark, sf_dir):
    """Two channels fused with non-negative weights on training customers, calibrated on validation ones, test ones scored."""
    t, v, h = _three(spark, sf_dir)
    m = models.fuse(t, ["score", "rule_severity"])
    raw = lambda d: m.transform(d).withColumn("raw", models.positive("fused_p")).select("account_key", "label", "raw")
    how, c = models.calibrate(raw(v), "raw")
    got = raw(h)
    if how == "isotonic":
        got = c.transform(got)
    elif how == "platt":
        got = c.transform(got).withColumn("p_calibrated", models.positive("platt_p")).select("account_key", "label", "raw", "p_calibrated")
    else:
        got = got.withColumn("p_calibrated", F.lit(None).cast("double"))
    return got.withColumn("method", F.lit(how))


#: What the card and the distance read; trees read every declared feature of the matrix.
CARDED = ["txn_count_in_30d", "largest_movement_30d_minor", "top_counterparty_share_30d_bps", "interarrival_burstiness_30d", "graph_out_degree_30d", "rule_severity_max"]


def stack_frame(spark, sf_dir):
    """(frame, folds, columns): the published matrix brought to accounts, with the severities of all twelve rules in it."""
    from paygrove.plans.q_chain import DECLARED, _matrix

    e = pay_events(spark, sf_dir)
    m = _matrix(spark, sf_dir, (folds.LOCAL, folds.TYPOLOGY), DECLARED)
    cols = [f.name for f in DECLARED]
    f = folds.scoring_frame(m, e, cols).withColumn("outflow_minor", F.col("amount_out_30d_minor").cast("bigint"))
    return f, sorted(r.fold for r in f.select("fold").distinct().collect()), cols


def _stack(spark, sf_dir):
    frame, which, cols = stack_frame(spark, sf_dir)
    plain = {"volume": "txn_count_in_30d", "value": "amount_out_30d_minor", "breadth": "lifetime_counterparties"}
    return stack.run(checkpoint(frame), which, cols, plain, "rule_severity_max", "stack-1", CARDED)


def model_stack(spark, sf_dir):
    """Every fold's test accounts with seven channels over the declared features, fused and calibrated scores, bands and reasons."""
    d = _stack(spark, sf_dir)
    return d.withColumn("top_channels", F.concat_ws(",", "top_channels")).withColumn("reasons", F.concat_ws("; ", "reasons"))


def model_gates(spark, sf_dir):
    return stack.gates(_stack(spark, sf_dir))


def stack_ranking(spark, sf_dir):
    """The latest fold's calibrated scores priced, ranked and allocated: what the review queue reads."""
    d = _stack(spark, sf_dir)
    last = d.groupBy("account_key").agg(F.max_by(F.struct("fold", "p_calibrated", "band", "outflow_minor", "currency", "label"), "fold").alias("x")).select("account_key", "x.*")
    p = pricing.price(pricing.attach(last.withColumnRenamed("p_calibrated", "score"), UGX), UGX)
    taken = pricing.first_fit(pricing.candidates(p), [F.desc("density"), F.col("account_key")], [300])
    return warehouse.stored_ranking(p, taken).select("account_key", "fold", "band", "score", "ev_minor", "rank", "selected", "beyond_capacity")


def queue(spark, sf_dir):
    return models.queue(scored(spark, sf_dir), ["typology"]).select("typology", "account_key", "rank")


_QUEUE = f"WITH {SC} SELECT typology, account_key, CAST(row_number() OVER (PARTITION BY typology ORDER BY score DESC, account_key) AS INT) AS rank FROM sc"


def _two(spark, sf_dir):
    band = lambda c: F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (F.least(F.lit(4), F.floor(c * 5)) + 1).cast("int"))
    s = scored(spark, sf_dir)
    return s.withColumn("band", band(F.col("score"))), s.withColumn("score", F.col("rule_severity")).withColumn("band", band(F.col("rule_severity")))


def agreement(spark, sf_dir):
    return models.agreement(*_two(spark, sf_dir))


def disagreements(spark, sf_dir):
    return models.disagreements(*_two(spark, sf_dir), top=20).withColumn("gap", F.round("gap", 9)).select("account_key", "band_a", "band_b", "distance", "gap")


_TWO = f"""{SC}, t AS (SELECT account_key, score AS a, rule_severity AS b, ['A','B','C','D','E'][CAST(least(4, floor(score * 5)) AS INT) + 1] AS band_a, ['A','B','C','D','E'][CAST(least(4, floor(rule_severity * 5)) AS INT) + 1] AS band_b FROM sc)"""


def prior(spark, sf_dir):
    return scored(spark, sf_dir).select("account_key", F.round(models.prior_shift(F.col("score"), 0.5, 0.02), 9).alias("p"))


def weights(spark, sf_dir):
    return models.class_weight(scored(spark, sf_dir)).groupBy("label").agg(F.round(F.sum("weight"), 6).alias("weight"))


QUERIES = {
    "scorecard_bins": bin_table, "scorecard_points": card, "scorecard_bands": card_bands, "drift_psi": drift, "band_migration": migration, "band_migration_rates": migration_rates,
    "model_boosted": boosted, "model_tuning": tuning, "model_anomaly": anomaly, "model_fused_calibrated": fused, "alert_ranks": queue, "band_agreement": agreement, "band_disagreements": disagreements,
    "prior_correction": prior, "class_weights": weights, "model_stack": model_stack, "model_gates": model_gates, "stack_ranking": stack_ranking,
}
ORACLE = {
    "scorecard_bins": _BIN, "drift_psi": _DRIFT, "band_migration": f"WITH {_MIG} SELECT * FROM m",
    "band_migration_rates": f"WITH {_MIG} SELECT fold, CAST(sum(n) AS BIGINT) AS n, round(sum(CASE WHEN to_band > from_band THEN n ELSE 0 END) / sum(n), 9) AS downgraded, round(sum(CASE WHEN to_band < from_band THEN n ELSE 0 END) / sum(n), 9) AS upgraded FROM m GROUP BY 1",
    "alert_ranks": _QUEUE, "band_agreement": f"WITH {_TWO} SELECT band_a, band_b, count(*) AS n FROM t GROUP BY 1, 2",
    "band_disagreements": f"WITH {_TWO} SELECT account_key, band_a, band_b, CAST(abs(ascii(band_a) - ascii(band_b)) AS INT) AS distance, round(abs(a - b), 9) AS gap FROM t WHERE band_a <> band_b ORDER BY distance DESC, abs(a - b) DESC, account_key LIMIT 20",
    "prior_correction": f"WITH {SC} SELECT account_key, round(score * 0.04::DOUBLE / (score * 0.04::DOUBLE + (1 - score) * 1.96::DOUBLE), 9) AS p FROM sc",
    "class_weights": f"WITH {SC}, t AS (SELECT count(*) AS n, sum(label) AS p FROM sc) SELECT label, round(sum(CASE WHEN label = 1 THEN n / (2.0::DOUBLE * p) ELSE n / (2.0::DOUBLE * (n - p)) END), 6) AS weight FROM sc, t GROUP BY 1",
}
