"""What-if over the rules' scores of the event corpus: another capacity, costs and recovery, and its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from paygrove.operators import simulate
from paygrove.plans.q_chain import CAPACITY, SCE, _hits, scored_events
from paygrove.plans.q_evaluate import UGX, fitted, priced_sql
from paygrove.session import scratch_table

BEFORE = simulate.Request(CAPACITY, UGX)
AFTER = simulate.Request(2 * CAPACITY, replace(UGX, cost_per_minute_minor=900, friction_minor=1_500, minor_per_minute=35_000), 150_000)


def _simulated(spark, sf_dir):
    return simulate.simulate(scratch_table(scored_events(spark, sf_dir, _hits(spark, sf_dir)), "scored"), BEFORE, AFTER)


def changes(spark, sf_dir):
    return _simulated(spark, sf_dir)[0]


def view(spark, sf_dir):
    return _simulated(spark, sf_dir)[1].withColumn("expected_wrong_touches", F.round("expected_wrong_touches", 6))


def _fit(r: simulate.Request, policies: tuple[str, ...]) -> str:
    return fitted([r.capacity], policies, priced_sql(SCE, r.assumptions, r.recovery_micro))


_ONE = ("ev_greedy",)
_ALL = ("threshold", "rules_only", "highest_amount", "random", "ev_greedy")
_CHANGES = f"""WITH a AS (WITH RECURSIVE {_fit(BEFORE, _ONE)} SELECT account_key, r AS rank_before, ev_minor AS ev_before_minor FROM fit), b AS (WITH RECURSIVE {_fit(AFTER, _ONE)} SELECT account_key, r AS rank_after, ev_minor AS ev_after_minor FROM fit)
SELECT account_key, rank_before, ev_before_minor, rank_after, ev_after_minor, CASE WHEN rank_before IS NULL THEN 'entered' WHEN rank_after IS NULL THEN 'left' ELSE 'kept' END AS change FROM a FULL JOIN b USING (account_key)"""
_VIEW = f"""WITH RECURSIVE {_fit(AFTER, _ALL)}, t AS (SELECT policy, count(*) AS accounts, CAST(sum(ev_minor) AS BIGINT) AS ev_minor, CAST(sum(intercept_minor) AS BIGINT) AS loss_avoided_minor, CAST(sum(review_cost_minor) AS BIGINT) AS review_cost_minor,
  CAST(sum(friction_minor) AS BIGINT) AS friction_minor, CAST(sum(exposure_minor) AS BIGINT) AS exposure_minor, CAST(sum(minutes) AS BIGINT) AS minutes, round(sum(1 - score), 6) AS expected_wrong_touches FROM fit GROUP BY 1),
e AS (SELECT count(*) FILTER (WHERE ev_minor > 0) AS candidates, count(*) FILTER (WHERE ev_minor IS NULL) AS unpriced, CAST(coalesce(sum(ev_minor) FILTER (WHERE ev_minor > 0), 0) AS BIGINT) AS reachable FROM pr), o AS (SELECT ev_minor AS own FROM t WHERE policy = 'ev_greedy')
SELECT t.*, candidates, unpriced, reachable - ev_minor AS forgone_minor, own - ev_minor AS behind_minor FROM t, e, o"""

QUERIES = {"policy_simulation": changes, "policy_simulation_totals": view}
ORACLE = {"policy_simulation": _CHANGES, "policy_simulation_totals": _VIEW}
