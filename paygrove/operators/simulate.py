"""What a policy would do under other assumptions: accounts that enter and leave, totals, baselines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paygrove.operators import evaluate, pricing
from paygrove.session import scratch_table


class RequestError(ValueError):
    """A request that the declared assumptions don't allow."""


@dataclass(frozen=True)
class Request:
    """A capacity in minutes, the economics, and a recovery rate out of their declared band (none: the central one)."""

    capacity: int
    assumptions: pricing.Assumptions
    recovery_micro: int | None = None

    def check(self) -> None:
        if self.capacity < 0:
            raise RequestError("capacity is negative")
        if self.recovery_micro is not None and self.recovery_micro not in self.assumptions.recovery_band_micro:
            raise RequestError(f"recovery {self.recovery_micro} is outside the declared band {self.assumptions.recovery_band_micro}")


def _priced(scored: DataFrame, r: Request) -> DataFrame:
    return pricing.price(pricing.attach(scored, r.assumptions), r.assumptions, r.recovery_micro)


def simulate(scored: DataFrame, before: Request, after: Request, policy: str = "ev_greedy", baselines: tuple[str, ...] = evaluate.POLICIES) -> tuple[DataFrame, DataFrame]:
    """(changes, view) of moving from one request to another over the same scored accounts.

    ``changes`` has every account that either request reviews: entered, left or kept, with
    its rank and value under both (null where a request doesn't review it). ``view`` has a
    row per baseline policy under the new request: totals of what it reviews, the value
    left on the table, candidates, accounts without a price, and how far ``policy`` is
    ahead. Each request prices and ranks once; all policies are allocated in one pass.
    """
    before.check()
    after.check()
    new = scratch_table(_priced(scored, after), "simulated")
    taken = pricing.first_fit(evaluate.by_policy(pricing.candidates(new), tuple(dict.fromkeys((policy, *baselines)))), [F.col("place"), F.col("account_key")], [after.capacity], ("policy",))
    taken = scratch_table(taken, "taken")
    old = pricing.first_fit(pricing.candidates(_priced(scored, before)), evaluate.policy_order(policy), [before.capacity])
    was = old.select("account_key", F.col("rank").alias("rank_before"), F.col("ev_minor").alias("ev_before_minor"))
    now = taken.filter(F.col("policy") == policy).select("account_key", F.col("rank").alias("rank_after"), F.col("ev_minor").alias("ev_after_minor"))
    change = F.when(F.col("rank_before").isNull(), "entered").when(F.col("rank_after").isNull(), "left").otherwise("kept")
    changes = was.join(now, "account_key", "full_outer").withColumn("change", change)
    every = new.agg(
        F.count_if(F.col("ev_minor") > 0).alias("candidates"), F.count_if(F.col("ev_minor").isNull()).alias("unpriced"), F.coalesce(F.sum(F.when(F.col("ev_minor") > 0, F.col("ev_minor"))), F.lit(0)).alias("reachable_minor"))
    names = scored.sparkSession.createDataFrame([(p,) for p in baselines], "policy string")
    t = names.join(pricing.totals(taken, ["policy"]), "policy", "left").fillna(0).join(F.broadcast(every))  # one row
    best = taken.filter(F.col("policy") == policy).agg(F.coalesce(F.sum("ev_minor"), F.lit(0)).alias("own"))
    t = t.join(F.broadcast(best))  # one row
    return changes, t.withColumn("forgone_minor", F.col("reachable_minor") - F.col("ev_minor")).withColumn("behind_minor", F.col("own") - F.col("ev_minor")).drop("reachable_minor", "own")
