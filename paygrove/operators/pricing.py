"""Pricing and allocation: exposure, expected value, first-fit selection, frontiers and propagation."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paygrove.functions import money
from paygrove.operators.paths import interval_join
from paygrove.operators.ranks import running
from paygrove.session import checkpoint

DAY = 86_400_000_000


@dataclass(frozen=True)
class Assumptions:
    """Declared economics; every figure carries them."""

    currency: str = "USD"
    cost_per_minute_minor: int = 50
    friction_minor: int = 2_000
    recovery_micro: int = 300_000
    recovery_band_micro: tuple[int, int, int] = (150_000, 300_000, 450_000)
    minutes: tuple[int, int] = (5, 120)
    minor_per_minute: int = 1_000_000


def attach(scored: DataFrame, a: Assumptions) -> DataFrame:
    """Exposure (null is 0), review minutes from it within the bounds, and their cost."""
    x = F.coalesce("outflow_minor", F.lit(0))
    m = F.greatest(F.lit(a.minutes[0]), F.least(F.lit(a.minutes[1]), F.call_function("div", x, F.lit(a.minor_per_minute)))).cast("int")
    return scored.withColumns({"exposure_minor": x, "minutes": m}).withColumn("review_cost_minor", F.col("minutes").cast("long") * a.cost_per_minute_minor)


def price(rows: DataFrame, a: Assumptions, recovery_micro: int | None = None) -> DataFrame:
    """Expected value of a review and its density per minute; a foreign currency is refused with its reason."""
    p, r = money.to_micro(F.col("score")), F.lit(recovery_micro or a.recovery_micro)
    joint = money.scaled(p, r)
    d = rows.withColumns({"intercept_minor": money.scaled(F.col("exposure_minor"), joint), "friction_minor": money.scaled(F.lit(a.friction_minor), F.lit(money.MICRO) - p)})
    ok = F.col("currency") == a.currency
    ev = F.col("intercept_minor") - F.col("review_cost_minor") - F.col("friction_minor")
    d = d.withColumn("ev_minor", F.when(ok, ev)).withColumn("density", F.col("ev_minor") / F.col("minutes"))
    return d.withColumn("refusal", F.when(~ok, F.concat(F.lit("unpriced: "), "currency", F.lit(f" exposure against {a.currency} costs"))))


def candidates(priced: DataFrame) -> DataFrame:
    return priced.filter("ev_minor > 0")


def totals(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("accounts"), F.sum("ev_minor").alias("ev_minor"), F.sum("intercept_minor").alias("loss_avoided_minor"), F.sum("review_cost_minor").alias("review_cost_minor"),
        F.sum("friction_minor").alias("friction_minor"), F.sum("exposure_minor").alias("exposure_minor"), F.sum("minutes").alias("minutes"), F.sum(1 - F.col("score")).alias("expected_wrong_touches"))


def first_fit(rows: DataFrame, order: list, capacities: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """(capacity, rows..., rank): what a first-fit pass in ``order`` takes within each capacity of minutes, for each of ``keys``.

    Exact in two steps. Running minutes in the order give the longest prefix that fits
    each capacity. Past it less is left than the next review takes, and only the first
    floor(left / m) later rows of each minute class m can still matter: their places in
    their class are known, so a few hundred rows are picked, and one grouped step goes
    through them in order. Minutes are within declared bounds, so classes are few; keys
    are declared things such as policies and folds.
    """
    d = running(rows, order, keys, name="rank", also={"upto": F.col("minutes").cast("long")})
    d = checkpoint(running(d, [F.col("rank")], (*keys, "minutes"), name="in_class"))
    used = [F.coalesce(F.max(F.when(F.col("upto") <= c, F.col("upto"))), F.lit(0)) for c in capacities]
    cut = checkpoint(d.groupBy(*keys).agg(F.array(*[F.struct(F.lit(c).cast("long").alias("capacity"), u.alias("used")) for c, u in zip(capacities, used, strict=True)]).alias("cuts")))
    d = d.join(F.broadcast(cut), list(keys)) if keys else d.join(F.broadcast(cut))  # a row per key
    prefix = d.select("*", F.inline(F.filter("cuts", lambda x: F.col("upto") <= x["used"]))).drop("used", "cuts")
    after = [F.coalesce(F.max(F.when(F.col("upto") <= F.col("cuts")[k]["used"], F.col("in_class"))), F.lit(0)) for k in range(len(capacities))]
    classes = d.groupBy(*keys, "minutes").agg(F.first("cuts").alias("cuts"), F.array(*after).alias("after"))
    classes = classes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("minutes").alias("m"), F.inline(F.arrays_zip("cuts", "after")))
    classes = classes.select("*", F.col("cuts.capacity").alias("capacity"), (F.col("cuts.capacity") - F.col("cuts.used")).alias("left")).drop("cuts").filter("m <= left")
    same = F.col("minutes") == F.col("m")
    for k in keys:
        same &= F.col(k) == F.col(f"__{k}")
    late = d.drop("cuts").join(F.broadcast(classes), same)  # at most a row per key, capacity and class
    nth = F.col("in_class") - F.col("after")
    late = late.filter((nth > 0) & (nth <= F.call_function("div", F.col("left"), F.col("minutes").cast("long"))))
    by = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], "capacity").alias("of")
    taken = late.select(by, "capacity", "rank", "minutes", "left").groupBy("of").applyInPandas(_fill, "of string, capacity long, rank long")
    rest = d.drop("cuts").withColumn("__of", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    taken = taken.withColumn("__of", F.regexp_replace("of", r"\|?[0-9]+$", "")).withColumnRenamed("rank", "__rank").drop("of")
    rest = rest.join(taken, (rest["rank"] == taken["__rank"]) & (rest["__of"] == taken["__of"])).select(*prefix.columns)
    return prefix.unionByName(rest).drop("upto", "in_class")


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """First fit over the few rows that can still matter, in rank order."""
    pdf = pdf.sort_values("rank")
    left, taken = int(pdf["left"].iloc[0]), []
    for rank, m in zip(pdf["rank"], pdf["minutes"], strict=True):
        if m <= left:
            taken.append(rank)
            left -= m
    return pd.DataFrame({"of": pdf["of"].iloc[0], "capacity": pdf["capacity"].iloc[0], "rank": taken}).astype({"capacity": "int64", "rank": "int64"})


def frontier(rows: DataFrame, capacities: list[int], policies: tuple[str, ...]) -> DataFrame:
    """(policy, capacity, totals, gain, best, dominated, operating): the value each policy reaches at each capacity.

    ``rows`` (policy, place, ...) hold every candidate once per policy (``evaluate.by_policy``).
    ``gain_minor`` is the step from the next smaller capacity, ``best`` whether no policy
    reaches more there, ``dominated`` whether another reaches more for no more minutes,
    and ``operating`` marks the smallest capacity at which a policy has its highest value.
    """
    out = totals(first_fit(rows, [F.col("place"), F.col("account_key")], capacities, ("policy",)), ["policy", "capacity"])
    grid = F.array(*[F.lit(c).cast("long") for c in capacities])
    points = rows.sparkSession.createDataFrame([(p,) for p in policies], "policy string").withColumn("capacity", F.explode(grid))  # a row per point
    out = points.join(out, ["policy", "capacity"], "left").fillna(0)
    own, at = Window.partitionBy("policy").orderBy("capacity"), Window.partitionBy("capacity")
    out = out.withColumn("gain_minor", F.col("ev_minor") - F.coalesce(F.lag("ev_minor").over(own), F.lit(0)))
    out = out.withColumn("best", F.col("ev_minor") == F.max("ev_minor").over(at))
    better = F.max(F.struct("ev_minor", (-F.col("minutes")).alias("m"))).over(at)
    out = out.withColumn("dominated", (better["ev_minor"] > F.col("ev_minor")) & (-better["m"] <= F.col("minutes")))
    peak = F.min_by("capacity", F.struct((-F.col("ev_minor")).alias("e"), "capacity")).over(Window.partitionBy("policy"))
    return out.withColumn("operating", F.col("capacity") == peak)


def monotone(curve: DataFrame) -> DataFrame:
    """Points of a frontier where more capacity gives less value; first fit may have such, and they are reported."""
    return curve.filter("gain_minor < 0").select("policy", "capacity", "gain_minor")


def gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Difference in expected value of two selected sets."""
    x, y = a.agg(F.coalesce(F.sum("ev_minor"), F.lit(0)).alias("x")), b.agg(F.coalesce(F.sum("ev_minor"), F.lit(0)).alias("y"))
    return x.join(y).select((F.col("x") - F.col("y")).alias("gap_minor"))  # one row each


def exposures(triggers: DataFrame, events: DataFrame, hops: int = 2, width_us: int = DAY) -> DataFrame:
    """(account, t_us, inflow, outflow, exposure): min of what enters and leaves the downstream cluster in the window.

    The cluster grows along events of the window itself, hop by hop.
    """
    e = events.filter("account_from <> account_to").select(F.col("account_from").alias("s"), F.col("account_to").alias("t"), "ts_us", "amount_minor")
    cluster = triggers.select("account", "t_us", F.col("account").alias("member")).distinct()
    front = cluster
    for _ in range(hops):
        j = interval_join(front, e, [("member", "s")], "t_us", "ts_us", 0, width_us - 1)
        front = j.select("account", "t_us", F.col("t").alias("member")).distinct().join(cluster, ["account", "t_us", "member"], "left_anti").select("account", "t_us", "member")
        front = checkpoint(front)
        cluster = cluster.union(front)
    cluster = checkpoint(cluster)
    out = interval_join(cluster, e, [("member", "s")], "t_us", "ts_us", 0, width_us - 1).groupBy("account", "t_us").agg(F.sum("amount_minor").alias("outflow_minor"))
    inn = interval_join(cluster, e, [("member", "t")], "t_us", "ts_us", 0, width_us - 1).groupBy("account", "t_us").agg(F.sum("amount_minor").alias("inflow_minor"))
    d = triggers.select("account", "t_us").distinct().join(out, ["account", "t_us"], "left").join(inn, ["account", "t_us"], "left").fillna(0)
    return d.withColumn("exposure_minor", F.least("outflow_minor", "inflow_minor"))


def propagate(events: DataFrame, seeds: DataFrame, depth: int = 4) -> DataFrame:
    """(account, amount_minor, step): value handed on from seeds along shares of each account's outflow, in expectation."""
    e = events.filter("account_from <> account_to").groupBy(F.col("account_from").alias("s"), F.col("account_to").alias("t")).agg(F.sum("amount_minor").alias("m"))
    e = checkpoint(e.withColumn("share", F.col("m") / F.sum("m").over(Window.partitionBy("s"))).select("s", "t", "share"))
    at = seeds.select("account", F.col("amount_minor").cast("double").alias("amount_minor"))
    out = at.withColumn("step", F.lit(0))
    for k in range(1, depth + 1):
        at = checkpoint(at.join(e, at["account"] == e["s"]).groupBy(F.col("t").alias("account")).agg(F.sum(F.col("amount_minor") * F.col("share")).alias("amount_minor")))
        out = out.unionByName(at.withColumn("step", F.lit(k)))
    return out


def recovery_band(rows: DataFrame, a: Assumptions) -> DataFrame:
    """Totals at each recovery rate of the band."""
    out = None
    for r in a.recovery_band_micro:
        t = totals(candidates(price(rows, a, r))).withColumn("recovery_micro", F.lit(r))
        out = t if out is None else out.unionByName(t)
    return out


def one_currency_sum(rows: DataFrame, value: str) -> DataFrame:
    """The sum and its currency; more than one currency is an error, not a number."""
    n = F.count_distinct("currency")
    return rows.agg(F.when(n > 1, F.raise_error(F.lit("a sum over several currencies")).cast("long")).otherwise(F.sum(value)).alias(value), F.max("currency").alias("currency"))
