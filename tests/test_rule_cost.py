import re
from dataclasses import replace

from pyspark.sql import functions as F

from paygrove.operators import rules
from paygrove.plans.q_rules import S
from paygrove.plans.tables import pay_events

SF = "/root/testdata/sf0.001"


def test_velocity_sorts_a_series_once_per_median(spark):
    """Rule R6 names its median inside a function of the series' elements; it must not be sorted again for each of them."""
    h = rules.r6(pay_events(spark, SF), S)
    plan = h._jdf.queryExecution().optimizedPlan().toString()
    # a median and a spread in the column, and once more in the filter on it
    assert 0 < plan.count("sort_array(") + plan.count("array_sort(") <= 6


def test_surge_reads_no_sliding_frame(spark):
    """Of rule R11's windows all frames only grow: Spark goes through a sliding one anew for every row, the square of a busy account."""
    h = rules.r11(pay_events(spark, SF), S)
    plan = h._jdf.queryExecution().executedPlan().toString().lower()
    frames = re.findall(r"specifiedwindowframe\((\w+), ([^,]+),", plan)
    assert frames and all(begin.strip().startswith("unboundedpreceding") for kind, begin in frames if kind == "rangeframe")


def test_surge_equals_all_pairs(spark):
    """Hits of R11 against windows laid out in full: ties, repeated peers, gaps of exactly the window."""
    import random

    rng, w = random.Random(5), 20
    rows = [(f"t{n:03}", rng.randrange(0, 200, 5), f"a{rng.randrange(2)}", f"p{rng.randrange(25)}", rng.randrange(1, 9)) for n in range(160)]
    e = spark.createDataFrame(rows, "txn_id string, ts_us long, account_from string, account_to string, amount_minor long")
    e = e.withColumns({"txn_type": F.lit("x"), "channel": F.lit("c"), "currency": F.lit("U"), "event_date_local": F.to_date(F.lit("2024-01-01")), "local_hour": F.lit(1)})
    got = {r.account_key: (r.observation, r.window_start_us, tuple(r.txn_ids)) for r in rules.r11(e, replace(S, r11_us=w, r11_c=1, r11_share=0.0)).collect()}
    both = [(i, t, a, p) for i, t, a, p, _ in rows] + [(i, t, p, a) for i, t, a, p, _ in rows]
    for account in {x[2] for x in both}:
        own = [x for x in both if x[2] == account]
        first = {p: min(t for _, t, _, q in own if q == p) for _, _, _, p in own}
        best = []
        for t in {x[1] for x in own}:
            start = min(x[1] for x in own if t - w <= x[1] <= t)
            fresh = sum(start <= f <= start + w for f in first.values())
            best.append((fresh, -start, len({p for _, x, _, p in own if t - w <= x <= t})))
        fresh, minus, _ = max(best)
        want = (float(fresh), -minus, tuple(sorted(i for i, t, _, _ in own if -minus <= t <= -minus + w)))
        assert got.get(account) == (want if fresh else None)


def test_rules_read_written_events(spark, monkeypatch):
    """All twelve rules, and all folds, read events that were parsed and written once; cycles are searched once for all folds."""
    from paygrove.operators import folds, paths
    from paygrove.plans import q_chain, q_folds, q_rules

    seen, searches = [], []
    run, cycles = rules.run_rules, paths.cycles
    monkeypatch.setattr(paths, "cycles", lambda *a, **k: searches.append(1) or cycles(*a, **k))
    monkeypatch.setattr(rules, "run_rules", lambda e, s, *a, **k: seen.append(e.inputFiles()) or run(e, s, *a, **(k | {"only": ("R4", "R10")})))
    q_rules.overlaps(spark, SF), q_rules.rates(spark, SF), q_chain._hits(spark, SF)
    searches.clear()
    q_folds.rule_derived(spark, SF)
    assert len(searches) == 1 and folds.rules is rules
    assert len(seen) == 3 + q_folds.FOLDS and all(f and "events.parquet" not in f[0] and "/events-" in f[0] for f in seen)
