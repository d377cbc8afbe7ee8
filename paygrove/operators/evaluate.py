"""Ranking and calibration metrics, policies and ledgers, computed from grouped scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrove.operators.ranks import running
from paygrove.session import checkpoint, scratch_table

POLICIES = ("threshold", "rules_only", "highest_amount", "random", "ev_greedy")


def by_score(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Per distinct score: rows, positives, and both counted from the top.

    The table of distinct scores is what metrics work on, so ties are exact and rows are
    aggregated once, before any ordering.
    """
    g = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p"))
    g = running(g, [F.desc(score)], tuple(keys), F.col("n"), "n_top", also={"p_top": F.col("p")})
    every = g.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.sum("n").alias("n_all"), F.sum("p").alias("p_all"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return g.join(every, same).drop(*[f"__{k}" for k in keys])


def average_precision(df: DataFrame, keys: list[str], key: str = "account_key", score: str = "score", label: str = "label") -> DataFrame:
    """Average precision with ties broken by key."""
    d = running(df.select(*keys, score, key, label), [F.desc(score), F.col(key)], tuple(keys), name="r", also={"c": F.col(label)})
    return d.groupBy(*keys).agg((F.sum(F.when(F.col(label) == 1, F.col("c") / F.col("r"))) / F.sum(label)).alias("average_precision"))


def average_precision_ties(df: DataFrame, keys: list[str], score: str = "score", label: str = "label", by: DataFrame | None = None) -> DataFrame:
    """Average precision in which equal scores are one step, null without a positive. ``by`` is the table of ``by_score``, where it is there already."""
    g = by_score(df, keys, score, label) if by is None else by
    return g.groupBy(*keys).agg(F.try_divide(F.sum(F.col("p") * F.col("p_top") / F.col("n_top")), F.max("p_all")).alias("average_precision"))


def auroc(df: DataFrame, keys: list[str], score: str = "score", label: str = "label", by: DataFrame | None = None) -> DataFrame:
    """Mann-Whitney with average ranks, from exact integer counts."""
    g = by_score(df, keys, score, label) if by is None else by
    below = (F.col("n_all") - F.col("p_all")) - (F.col("n_top") - F.col("p_top"))
    wins = F.sum(F.col("p") * (2 * below + (F.col("n") - F.col("p"))))
    pairs = F.max("p_all") * (F.max("n_all") - F.max("p_all"))
    return g.groupBy(*keys).agg(F.when(pairs > 0, wins / (2 * pairs)).alias("auroc"))


def ks(df: DataFrame, keys: list[str], score: str = "score", label: str = "label", by: DataFrame | None = None) -> DataFrame:
    g = by_score(df, keys, score, label) if by is None else by
    return g.groupBy(*keys).agg(F.max(F.abs(F.col("p_top") / F.col("p_all") - (F.col("n_top") - F.col("p_top")) / (F.col("n_all") - F.col("p_all")))).alias("ks"))


def at_budget(df: DataFrame, keys: list[str], budget: int, key: str = "account_key", score: str = "score", label: str = "label") -> DataFrame:
    """Precision and recall of the first ``budget`` rows; null where undefined."""
    d = running(df.select(*keys, score, key, label), [F.desc(score), F.col(key)], tuple(keys), name="r")
    hit, n, p = F.sum(F.when(F.col("r") <= budget, F.col(label))), F.least(F.count(F.lit(1)), F.lit(budget)), F.sum(label)
    return d.groupBy(*keys).agg(F.when(n > 0, hit / n).alias("precision"), F.when(p > 0, hit / p).alias("recall"))


def brier(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


def reliability(df: DataFrame, bins: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    """Equal-width bins: rows, mean score, observed rate, gap."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("observed")).withColumn("gap", F.abs(F.col("mean_score") - F.col("observed")))


def reliability_equal_count(df: DataFrame, bins: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    """Bins of near-equal counts: distinct scores are placed by how many rows lie above them."""
    g = by_score(df, [], score, label)
    b = F.floor((F.col("n_top") - F.col("n")) * bins / F.col("n_all")).cast("int")
    return g.groupBy(b.alias("bin")).agg(F.sum("n").alias("n"), (F.sum(F.col(score) * F.col("n")) / F.sum("n")).alias("mean_score"), (F.sum("p") / F.sum("n")).alias("observed"))


def ece(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("observed"))) / F.sum("n")).alias("ece"))


def recall_by(df: DataFrame, group: str, selected: Column, label: str = "label") -> DataFrame:
    return df.filter(F.col(label) == 1).groupBy(group).agg(F.count(F.lit(1)).alias("positives"), F.avg(selected.cast("double")).alias("recall"))


def per_10k(alerts: Column, rows: Column) -> Column:
    return alerts * 10_000 / rows


def _uniform(h: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) for each (row, draw), from the row's hash."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64)[:, None] + (draws.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) * 2.0**-53


#: The Poisson(1) distribution function.
_POISSON = np.array([0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940581, 0.99991676, 0.99998975])


def _weights(h: np.ndarray, draws: np.ndarray) -> np.ndarray:
    return np.searchsorted(_POISSON, _uniform(h, draws), "right")


def bootstrap_ap(df: DataFrame, reps: int = 1000, seed: int = 11, key: str = "account_key", score: str = "score", label: str = "label") -> DataFrame:
    """(reps, lo, hi): 95 % interval of average precision over resamples with Poisson(1) weights.

    A row's weight in a replicate is drawn from a hash of (key, replicate, seed), so runs
    agree. Rows are dealt by ranges of the score. Each range sums its weights of every
    replicate, a row per range and replicate; with what the ranges above hold, a second
    pass over the ranges gives their part of each replicate's average precision.
    """
    x = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"), F.xxhash64(F.lit(seed), F.col(key)).alias("h"))
    x = scratch_table(x.repartitionByRange(F.desc("s")).withColumn("part", F.spark_partition_id()), "bootstrap")  # equal scores lie in one range
    draws = np.arange(reps)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        n, p = np.zeros(reps, np.int64), np.zeros(reps, np.int64)
        for at in range(0, len(pdf), 512):
            w = _weights(pdf.h.to_numpy()[at : at + 512], draws)
            n += w.sum(0)
            p += w[pdf.y.to_numpy()[at : at + 512] == 1].sum(0)
        return pd.DataFrame({"part": pdf.part.iloc[0], "rep": draws, "n": n, "p": p})

    each = scratch_table(x.groupBy("part").applyInPandas(sums, "part int, rep int, n long, p long"), "bootstrap-sums")
    above = Window.partitionBy("rep").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = each.select("part", "rep", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("n", "p")])

    def steps(pdf: pd.DataFrame, pre: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"rep": [], "a": []}).astype({"rep": "int32"})
        pdf, pre = pdf.sort_values("s", ascending=False), pre.sort_values("rep")
        s, y, h = pdf.s.to_numpy(), pdf.y.to_numpy()[:, None] == 1, pdf.h.to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        out, width = np.zeros(reps), max(1, 4_000_000 // len(s))
        for at in range(0, reps, width):
            w = _weights(h, draws[at : at + width])
            n, p = np.add.reduceat(w, begin, 0), np.add.reduceat(w * y, begin, 0)
            top = pre.n.to_numpy()[at : at + width] + np.cumsum(n, 0), pre.p.to_numpy()[at : at + width] + np.cumsum(p, 0)
            out[at : at + width] = (p * top[1] / np.maximum(top[0], 1)).sum(0)
        return pd.DataFrame({"rep": draws.astype(np.int32), "a": out})

    parts = x.groupBy("part").cogroup(before.groupBy("part")).applyInPandas(steps, "rep int, a double")
    ap = parts.groupBy("rep").agg(F.sum("a").alias("a")).join(each.groupBy("rep").agg(F.sum("p").alias("p")), "rep")
    ap = ap.filter("p > 0").select((F.col("a") / F.col("p")).alias("ap"))
    return ap.agg(F.count(F.lit(1)).alias("reps"), F.percentile("ap", 0.025).alias("lo"), F.percentile("ap", 0.975).alias("hi"))


def residual_tail(df: DataFrame, draws: int = 10_000, seed: int = 3, key: str = "account_key", loss: str = "loss_minor", p: str = "score") -> DataFrame:
    """(var95, es975): tail of the total loss over seeded Bernoulli draws.

    Draws are made in blocks of rows by all draws; a task sends one integer sum per draw.
    """
    at = np.arange(draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(draws, np.int64)
        for b in batches:
            h, money, odds = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "loss", "p"))
            for k in range(0, len(h), 64):
                hit = _uniform(h[k : k + 64], at) < odds[k : k + 64, None]
                total += (hit * money[k : k + 64, None]).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total)], ["draw", "total"])

    x = df.select(F.xxhash64(F.lit(seed), F.col(key)).alias("h"), F.coalesce(F.col(loss), F.lit(0)).cast("long").alias("loss"), F.coalesce(F.col(p), F.lit(0.0)).cast("double").alias("p"))
    t = x.mapInArrow(run, "draw int, total long").groupBy("draw").agg(F.sum("total").alias("total"))
    r = t.withColumn("k", F.row_number().over(Window.orderBy("total", "draw")))  # a row per draw
    v, e = math.ceil(0.95 * draws), math.ceil(0.975 * draws)
    return r.agg(F.max(F.when(F.col("k") == v, F.col("total"))).alias("var95"), F.avg(F.when(F.col("k") >= e, F.col("total"))).alias("es975"))


def cumulative(folds: DataFrame, keys: tuple[str, ...] = (), value: str = "net_minor", minutes: str = "minutes") -> DataFrame:
    """Per key over its folds: total, largest fall from a peak, mean, deviation, their ratio, worst fold, benefit per hour."""
    w = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)  # a row per fold
    d = folds.withColumn("c", F.sum(value).over(w)).withColumn("peak", F.greatest(F.lit(0), F.max("c").over(w)))
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"), F.sum(value).alias("total_minor"), F.max(F.col("peak") - F.col("c")).alias("max_drawdown_minor"), F.avg(value).alias("mean_minor"),
        F.stddev_samp(value).alias("std_minor"), F.try_divide(F.avg(value), F.stddev_samp(value)).alias("mean_over_std"), F.min(value).alias("worst_minor"),
        F.sum(minutes).alias("minutes"), F.try_divide(F.sum(value) * 60.0, F.sum(minutes)).alias("per_hour_minor"))


def ablation(df: DataFrame, configurations: dict[str, Column], control: Column, label: str = "label") -> DataFrame:
    """(configuration, n, positives, average_precision, auroc, beaten): each score over the same rows, and a leaking control.

    The control sees the label, so it must come first in every column; ``beaten`` says
    that it does. A table in which it doesn't measures something else.
    """
    each = F.array(*[F.struct(F.lit(n).alias("configuration"), c.cast("double").alias("score")) for n, c in {**configurations, "lookahead": control}.items()])
    d = df.select(F.col(label).alias("label"), F.inline(each))
    by = checkpoint(by_score(d, ["configuration"]))
    base = d.groupBy("configuration").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))
    out = base.join(average_precision_ties(d, ["configuration"], by=by), "configuration").join(auroc(d, ["configuration"], by=by), "configuration")
    top = Window.partitionBy()  # a row per configuration
    best = F.max(F.when(F.col("configuration") == "lookahead", F.col("average_precision"))).over(top)
    return out.withColumn("beaten", F.col("average_precision") <= best)


def over_seeds(runs: DataFrame, keys: tuple[str, ...] = ("metric",), value: str = "value") -> DataFrame:
    """Mean, deviation and range of a metric over its seeds."""
    return runs.groupBy(*keys).agg(F.count(value).alias("seeds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))


def money_shift(before: DataFrame, after: DataFrame, taken_before: DataFrame, taken_after: DataFrame) -> DataFrame:
    """One row: rank correlation of two pricings of the same accounts by density, and accounts that enter or leave the reviewed set."""
    both = before.select("account_key", F.col("density").alias("x")).join(after.select("account_key", F.col("density").alias("y")), "account_key")
    a, b = taken_before.select("account_key"), taken_after.select("account_key")
    moved = a.join(b, "account_key", "left_anti").agg(F.count(F.lit(1)).alias("left")).join(b.join(a, "account_key", "left_anti").agg(F.count(F.lit(1)).alias("entered")))
    return spearman(both, "x", "y").join(moved).withColumn("cutoff_changed", F.col("left") + F.col("entered") > 0)  # one row each


def false_positive_rates(df: DataFrame, axis: str, selected: str, label: str = "label", buckets: int = 4) -> DataFrame:
    """Per quantile bucket of a proxy axis: negatives, and the share of them that was selected."""
    g = by_score(df, [], axis, label)
    place = g.select(F.col(axis).alias("__a"), F.floor((F.col("n_all") - F.col("n_top")) * buckets / F.col("n_all")).cast("int").alias("bucket"))
    d = df.join(place, df[axis] == place["__a"]).filter(F.col(label) == 0)
    return d.groupBy("bucket").agg(F.count(F.lit(1)).alias("negatives"), F.avg(F.col(selected).cast("double")).alias("false_positive_rate"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c in (x, y):
        g = running(d.groupBy(c).agg(F.count(F.lit(1)).alias("n")), [F.col(c)], value=F.col("n"), name="upto")
        d = d.join(g.select(F.col(c).alias(f"__{c}"), (F.col("upto") - (F.col("n") - 1) / 2.0).alias(f"__r_{c}")), F.col(c) == F.col(f"__{c}"))
    return d.agg(F.corr(f"__r_{x}", f"__r_{y}").alias("rho"))


def policy_place(policy: str, seed: int = 5) -> Column:
    """Where a policy puts a row: the smaller the earlier it is reviewed."""
    return {
        "threshold": -F.col("score"), "rules_only": -F.col("rule_severity"), "highest_amount": -F.col("exposure_minor").cast("double"),
        "random": F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col("account_key")), 256), 1, 13), 16, 10).cast("double"),
        "ev_greedy": -F.col("density"),
    }[policy]


def policy_order(policy: str, seed: int = 5) -> list[Column]:
    """What each policy reviews first; ties by account."""
    return [policy_place(policy, seed), F.col("account_key")]


def by_policy(rows: DataFrame, policies: tuple[str, ...] = POLICIES) -> DataFrame:
    """Rows once per policy, with ``policy`` and ``place``."""
    return rows.select("*", F.inline(F.array(*[F.struct(F.lit(p).alias("policy"), policy_place(p).alias("place")) for p in policies])))


def fold_ledger(selected: DataFrame, keys: list[str]) -> DataFrame:
    """Realised sums of the reviewed set: captured, review cost, friction, net."""
    a = selected.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("reviewed"), F.sum("minutes").alias("minutes"), F.sum(F.when(F.col("label") == 1, F.col("recoverable_minor")).otherwise(0)).alias("captured_minor"),
        F.sum("review_cost_minor").alias("review_cost_minor"), F.sum(F.when(F.col("label") == 0, F.col("friction_minor")).otherwise(0)).alias("friction_minor"))
    return a.withColumn("net_minor", F.col("captured_minor") - F.col("review_cost_minor") - F.col("friction_minor"))


def availability(rows: DataFrame, channel: str = "channel", value: str = "value") -> DataFrame:
    """Per channel: measured, partial or unavailable over its folds; an unavailable one carries no metric."""
    a = rows.groupBy(channel).agg(F.count(F.lit(1)).alias("folds"), F.count(value).alias("measured"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    state = F.when(F.col("measured") == 0, "unavailable").when(F.col("measured") < F.col("folds"), "partial").otherwise("measured")
    return a.withColumn("state", state)


def percentiles(df: DataFrame, col: str, at: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    return df.agg(*[F.percentile(col, q).alias(f"p{int(q * 100):02d}") for q in at])


def seeded_drop(df: DataFrame, share: float, seed: int, key: str = "account_key") -> DataFrame:
    """All rows but a seeded share of them."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return df.filter(u >= share)


def measure(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per slice: rows, positives, base rate, average precision, AUROC, Brier and KS."""
    df = checkpoint(df.select(*keys, "score", "label"))
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.avg("label").alias("base_rate"))
    by = checkpoint(by_score(df, keys))
    for t in (average_precision_ties(df, keys, by=by), auroc(df, keys, by=by), brier(df, keys), ks(df, keys, by=by)):
        base = base.join(t, keys) if keys else base.join(t)  # without keys one row each
    return base
