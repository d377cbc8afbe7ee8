import pytest
from pyspark.sql import functions as F

from paygrove.operators import folds, splits
from paygrove.operators.registry import FEATURES
from paygrove.plans.q_chain import scored_events
from paygrove.plans.tables import pay_events

SF = "/root/testdata/sf0.001"
NAMES = ("txn_count_in_24h", "amount_out_24h_minor", "graph_out_degree_30d", "rule_hit_count", "rule_severity_max")
DECLARED = [f for f in FEATURES if f.name in NAMES]


def fold_tables(spark, plan, accounts):
    nodes = spark.createDataFrame([(f.fold, a, f.fold + 5, folds.cutoff(f)) for f in plan for a in accounts], "fold int, account string, out_degree long, last_ts_us long")
    hits = spark.createDataFrame([(plan[0].fold, accounts[0], "R1", 0.25), (plan[0].fold, accounts[0], "R2", 0.75)], "fold int, account_key string, rule_id string, severity double")
    return nodes, hits


def test_matrix_and_frame(spark):
    """Every side of every event once per fold it has a role in; frames hold each account's latest row and its label."""
    e = pay_events(spark, SF).cache()
    plan = splits.plan(e, folds=2, embargo_days=1)
    a = sorted(r.account_from for r in e.select("account_from").distinct().collect())[:2]
    m = folds.publish(e, plan, *fold_tables(spark, plan, a), DECLARED)
    rows = m.collect()
    roles = splits.assign(e, plan).count()
    assert len(rows) == 2 * roles and m.columns[:2] == ["fold", "role"]
    hit = [r for r in rows if r.fold == plan[0].fold and r.entity == a[0]]
    assert hit and all((r.rule_hit_count, r.rule_severity_max, r.graph_out_degree_30d) == (2, 0.75, 5) for r in hit)
    assert all(r.rule_severity_max is None for r in rows if r.entity not in a or r.fold != plan[0].fold)
    label = {r.txn_id: r.label_is_fraud for r in e.collect()}
    want = {}
    for r in sorted(rows, key=lambda r: (r.ts_us, r.txn_id, r.sign)):
        if r.role in ("train", "valid", "test"):
            k = (r.entity, r.fold, r.role)
            n, y = want.get(k, (0, 0, 0))[:2]
            want[k] = (n + 1, max(y, label[r.txn_id]), r.amount_out_24h_minor)
    frame = folds.scoring_frame(m, e, ["amount_out_24h_minor"]).collect()
    assert {(r.account_key, r.fold, r.role): (r.transactions, r.label, r.amount_out_24h_minor) for r in frame} == want


def test_publish_refuses(spark):
    e = pay_events(spark, SF).cache()
    plan = splits.plan(e, folds=2, embargo_days=1)
    a = [e.first().account_from]
    nodes, hits = fold_tables(spark, plan, a)
    with pytest.raises(ValueError, match="currencies"):
        folds.publish(e.withColumn("currency", F.when(F.col("event_id") % 2 == 0, "EUR").otherwise("USD")), plan, nodes, hits, DECLARED)
    with pytest.raises(Exception, match="after its cutoff"):
        folds.publish(e, plan, nodes.withColumn("last_ts_us", F.col("last_ts_us") + 1), hits, DECLARED).count()


def test_scores_come_from_hits(spark):
    """The score is the chance that some rule is right, each at its best; the leading rule is the typology."""
    hits = spark.createDataFrame([("A1", "R2", 0.5), ("A1", "R7", 0.5), ("A2", "R4", 1.0), ("nobody", "R1", 0.9)], "account_key string, rule_id string, severity double")
    d = {r.account_key: r for r in scored_events(spark, SF, hits).collect()}
    assert (d["A1"].score, d["A1"].typology, d["A1"].rule_ids, d["A1"].rule_hits) == (0.75, "R2", ["R2", "R7"], 2)
    assert d["A2"].score == pytest.approx(0.999999) and d["A2"].typology == "R4" and "nobody" not in d
    rest = [r for k, r in d.items() if k not in ("A1", "A2")]
    assert rest and all((r.score, r.typology, r.rule_ids) == (0.0, "none", []) for r in rest)
