"""Typology rules R1 to R12 over canonical events, their thresholds, and what is done with hits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrove.operators import paths
from paygrove.operators.graph import legs, nearest_rank
from paygrove.operators.kernels import first_and_last, grown, over_items, sweep
from paygrove.operators.ranks import running

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000

# Names, overlap groups and default parameters of the rules.
NAMES = {
    "R1": "RAPID_PASS_THROUGH", "R2": "FAN_IN", "R3": "FAN_OUT", "R4": "CYCLE_MEMBER", "R5": "STRUCTURING", "R6": "VELOCITY_SPIKE",
    "R7": "DORMANT_REACTIVATION", "R8": "ODD_HOUR_SHIFT", "R9": "AMOUNT_REGIME_SHIFT", "R10": "FAST_CASH_OUT",
    "R11": "NEW_COUNTERPARTY_SURGE", "R12": "CHAIN_MEMBER",
}
OVERLAP = {"extraction": ("R1", "R10"), "aggregation": ("R2", "R11"), "layering": ("R4", "R12")}
NO_REVERSALS = ("R1", "R4", "R12")
VALUE_RULES = ("R1", "R2", "R4", "R5", "R9", "R10", "R12")


@dataclass(frozen=True)
class Settings:
    """Parameters; shares are in millionths, so comparisons are exact."""

    r1_share: int = 800_000
    r1_us: int = 60 * MINUTE
    r1_least_minor: int = 10_000
    r2_k: int = 8
    r2_us: int = 24 * HOUR
    tau_percent: float = 25.0
    r3_k: int = 8
    r3_us: int = 24 * HOUR
    r4_retention: int = 600_000
    r4_lengths: tuple[int, int] = (3, 6)
    r4_period_us: int = 168 * HOUR
    r4_tolerance: float = 0.05
    r4_down_weight: float = 0.3
    r4_hop_us: int | None = None
    r4_cap: int | None = None
    r5_n: int = 3
    r5_us: int = 7 * DAY
    r5_band: int = 800_000
    r5_pinned_minor: int | None = 2_500_000
    r6_z: float = 3.0
    r6_days: int = 30
    r6_least_days: int = 5
    r7_days: int = 30
    r7_k: int = 5
    r7_us: int = 24 * HOUR
    r8_jump: float = 0.40
    r8_least: int = 10
    r8_recent_days: int = 7
    r8_quiet_hours: int = 2
    r8_least_baseline: int = 10
    r9_m: float = 4.0
    r9_recent_days: int = 7
    r9_baseline_days: int = 30
    r10_share: int = 700_000
    r10_us: int = 6 * HOUR
    r11_share: float = 0.80
    r11_c: int = 6
    r11_us: int = 48 * HOUR
    r12_hops: tuple[int, int] = (3, 6)
    r12_us: int = 24 * HOUR
    r12_decay: float = 0.95
    cash_out: tuple[str, ...] = ("purchase",)
    reversals: tuple[str, ...] = ("error",)
    ceiling: float = 0.33
    floor: float = 0.0001


HIT = ["rule_id", "account_key", "severity", "observation", "window_start_us", "window_end_us", "txn_ids"]


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def excess(x: Column, threshold: float, saturation: float) -> Column:
    return clamp((x - F.lit(float(threshold))) / F.lit(float(saturation - threshold)))


def above_share(x: Column, floor: float) -> Column:
    return clamp((x - F.lit(floor)) / F.lit(1.0 - floor))


def log_band(x: Column, band: float) -> Column:
    return clamp((F.abs(F.log(x)) - F.log(F.lit(band))) / F.log(F.lit(band)))


def combine(*parts: Column, weights: tuple[float, ...] | None = None) -> Column:
    w = weights or (1.0,) * len(parts)
    return clamp(reduce(lambda a, b: a + b, (p * F.lit(x) for p, x in zip(parts, w, strict=True))) / F.lit(float(sum(w))))


def ratio_at_least(n: Column, d: Column, micro: int) -> Column:
    return n * F.lit(1_000_000) >= d * F.lit(micro)


def rule_legs(events: DataFrame, rule: str, s: Settings) -> DataFrame:
    """Legs a rule reads: no self-transfers; reversals and zero amounts by rule."""
    e = events.filter(F.col("account_from") != F.col("account_to"))
    if rule in NO_REVERSALS:
        e = e.filter(~F.col("txn_type").isin(*s.reversals))
    if rule in VALUE_RULES:
        e = e.filter(F.col("amount_minor") != 0)
    return legs(e)


def _hits(df: DataFrame, rule: str, severity: Column, observation: Column, start: Column, end: Column, txns: Column, account: str = "account") -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule_id"), F.col(account).alias("account_key"), severity.cast("double").alias("severity"), observation.cast("double").alias("observation"),
        start.cast("long").alias("window_start_us"), end.cast("long").alias("window_end_us"), F.array_sort(txns).alias("txn_ids"),
    )


def tau(events: DataFrame, percent: float = 25.0) -> DataFrame:
    """One row: nearest-rank percentile of non-zero amounts."""
    return nearest_rank(events.filter("amount_minor <> 0"), "amount_minor", percent / 100).withColumnRenamed("amount_minor", "tau_minor")


def structuring_threshold(events: DataFrame, band_micro: int = 800_000, pinned: int | None = None, support: int = 3) -> DataFrame:
    """One row: the pinned threshold, or the amount whose band [share * T, T] holds most events; the smaller on ties."""
    if pinned is not None:
        return events.sparkSession.createDataFrame([(pinned,)], "threshold_minor long")
    c = events.filter("amount_minor > 0").groupBy(F.col("amount_minor").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    run = running(c, [F.col("a")], value=F.col("n"), name="upto")
    # events below the band's lower edge, by an as-of lookup among the distinct amounts
    edge = F.ceil(F.col("a") * F.lit(band_micro) / F.lit(1_000_000)).cast("long")
    both = run.select(F.col("a").alias("x"), F.lit(1).alias("o"), F.col("upto").alias("u"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("long").alias("v")).unionByName(
        run.select(edge.alias("x"), F.lit(0).alias("o"), F.lit(None).cast("long").alias("u"), F.col("a").alias("t"), F.col("upto").alias("v"))
    )
    # counts grow with the amount, so the latest is the largest; an edge doesn't see the amount equal to it
    below = running(both, [F.col("x"), F.col("o")], value=F.col("u"), name="below", agg=F.max).filter("o = 0").withColumn("below", F.coalesce("below", F.lit(0)))
    best = below.withColumn("k", F.col("v") - F.col("below")).filter(F.col("k") >= support)
    return best.agg(F.max_by("t", F.struct("k", (-F.col("t")).alias("m"))).alias("threshold_minor"))


def r1(events: DataFrame, s: Settings) -> DataFrame:
    """Rapid pass-through: sends at least the share of what it received within the window before, same currency."""
    l = rule_legs(events, "R1", s)
    send = l.filter("side = 'out'").select("account", "currency", "ts_us", F.col("txn_id").alias("s_id"), F.col("amount_minor").alias("s_amt"))
    # the smallest receipt of the window before a send makes its best ratio; of equal ones the earliest counts
    recv = l.filter((F.col("side") == "in") & (F.col("amount_minor") >= s.r1_least_minor)).select("account", "currency", "ts_us", F.struct("amount_minor", "ts_us", "txn_id").alias("v"))
    j = over_items(send, recv, ["account", "currency"], F.col("ts_us") - s.r1_us, s.r1_us, {"r": (F.col("v"), "min")}).filter(F.col("r").isNotNull() & ratio_at_least(F.col("s_amt"), F.col("r.amount_minor"), s.r1_share))
    j = j.withColumn("ratio", F.col("s_amt") / F.col("r.amount_minor"))
    best = j.groupBy("account").agg(F.min(F.struct((-F.col("ratio")).alias("k"), F.col("ts_us").alias("s_ts"), "s_id", F.col("r.ts_us").alias("r_ts"), F.col("r.txn_id").alias("r_id"))).alias("b"))
    ratio = -F.col("b.k")
    return _hits(best, "R1", above_share(ratio, s.r1_share / 1e6), ratio, F.col("b.r_ts"), F.col("b.s_ts"), F.array("b.r_id", "b.s_id"))


def _best_window(l: DataFrame, width: int) -> DataFrame:
    """Per account: most distinct peers in a closed trailing window, at its earliest, and that window's legs."""
    again = F.lead("ts_us").over(Window.partitionBy("account", "peer").orderBy("ts_us", "txn_id"))
    d = l.withColumn("__end", F.least(again, F.col("ts_us") + F.lit(width + 1)))
    d = sweep(d, ["account"], {"distinct": (F.lit(1).cast("long"), F.col("__end"))})
    best = d.groupBy("account").agg(F.min(F.struct((-F.col("distinct")).alias("k"), "ts_us")).alias("b")).select(
        F.col("account").alias("ba"), (-F.col("b.k")).alias("distinct"), F.col("b.ts_us").alias("b_ts"))
    w = l.join(best, F.col("account") == F.col("ba")).filter(F.col("ts_us").between(F.col("b_ts") - F.lit(width), F.col("b_ts")))
    return w.groupBy("account", "distinct").agg(
        F.min("ts_us").alias("start"), F.sort_array(F.collect_list("amount_minor")).alias("amounts"), F.collect_list("txn_id").alias("txns"), F.sum("amount_minor").alias("total"))


def _middle(a: str) -> Column:
    """Integer median of a sorted array, down."""
    n = F.size(a)
    lo, hi = F.element_at(a, F.floor((n + 1) / 2).cast("int")), F.element_at(a, (F.floor(n / 2) + 1).cast("int"))
    return F.floor((lo + hi) / 2).cast("long")


def r2(events: DataFrame, s: Settings, excluded: DataFrame | None = None) -> DataFrame:
    """Fan-in: at least k distinct senders in a window, median amount below tau; rails and externals left out."""
    l = rule_legs(events, "R2", s).filter("side = 'in'")
    if excluded is not None:
        l = l.join(excluded.select("account"), "account", "left_anti")
    w = _best_window(l, s.r2_us).filter(F.col("distinct") >= s.r2_k)
    w = w.withColumn("median", _middle("amounts")).join(F.broadcast(tau(events, s.tau_percent))).filter("median < tau_minor")
    x = F.col("distinct").cast("double")
    return _hits(w, "R2", excess(x, s.r2_k, 2 * s.r2_k), x, F.col("start"), F.col("start") + F.lit(s.r2_us), F.col("txns"))


def r3(events: DataFrame, s: Settings, excluded: DataFrame | None = None) -> DataFrame:
    """Fan-out: at least k distinct receivers in a window."""
    l = rule_legs(events, "R3", s).filter("side = 'out'")
    if excluded is not None:
        l = l.join(excluded.select("account"), "account", "left_anti")
    w = _best_window(l, s.r3_us).filter(F.col("distinct") >= s.r3_k)
    x = F.col("distinct").cast("double")
    return _hits(w, "R3", excess(x, s.r3_k, 2 * s.r3_k), x, F.col("start"), F.col("start") + F.lit(s.r3_us), F.col("txns"))


def r4_cycles(events: DataFrame, s: Settings, skip: DataFrame | None = None) -> DataFrame:
    return paths.cycles(paths.adjacency(events, s.reversals, skip), *s.r4_lengths, s.r4_retention, s.r4_hop_us, round_cap=s.r4_cap)


def r4(events: DataFrame, s: Settings, skip: DataFrame | None = None, cycles: DataFrame | None = None) -> DataFrame:
    """Cycle members: one hit per member and ring, at its best lap; rings that recur weekly weigh less.

    ``cycles``: those of ``events`` (``r4_cycles``), if they are known already.
    """
    c = r4_cycles(events, s, skip) if cycles is None else cycles
    c = c.withColumn("ring", paths.rotated(F.col("nodes"))).withColumn("start", F.element_at("at", 1))
    # two laps recur when their starts lie within the tolerance of a multiple of the period, so
    # neighbours in the order of what is left of the start after whole periods decide, the last and the first too
    tol = max(1, int(s.r4_tolerance * s.r4_period_us))
    starts = c.select("ring", F.col("start"), F.pmod("start", F.lit(s.r4_period_us)).alias("rest")).distinct()
    step = F.col("rest") - F.lag("rest").over(Window.partitionBy("ring").orderBy("rest", "start"))
    recur = starts.withColumn("step", step).groupBy("ring").agg(
        F.min("step").alias("near"), (F.min("rest") + F.lit(s.r4_period_us) - F.max("rest")).alias("turn"), F.count(F.lit(1)).alias("n"))
    recur = recur.filter((F.col("n") > 1) & ((F.col("near") <= tol) | (F.col("turn") <= tol))).select("ring", F.lit(True).alias("periodic"))
    best = c.groupBy("ring").agg(F.min(F.struct((-F.col("retention")).alias("k"), "start", "txns", "at", "length")).alias("b"), F.count(F.lit(1)).alias("laps"))
    x = best.join(recur, "ring", "left")
    keep = -F.col("b.k")
    sev = combine(above_share(keep, s.r4_retention / 1e6), excess(F.col("b.length").cast("double"), *map(float, s.r4_lengths)))
    sev = F.when(F.col("periodic"), clamp(sev * F.lit(s.r4_down_weight))).otherwise(sev)
    x = x.withColumn("sev", sev).withColumn("keep", keep).withColumn("account", F.explode("ring"))
    return _hits(x, "R4", F.col("sev"), F.col("keep"), F.array_min("b.at"), F.array_max("b.at"), F.col("b.txns"))


def r5(events: DataFrame, s: Settings) -> DataFrame:
    """Structuring: maximal windows with at least n originated amounts in the band below the threshold."""
    t = structuring_threshold(events, s.r5_band, s.r5_pinned_minor)
    l = rule_legs(events, "R5", s).filter("side = 'out'").join(F.broadcast(t))
    l = l.filter(ratio_at_least(F.col("amount_minor"), F.col("threshold_minor"), s.r5_band) & (F.col("amount_minor") <= F.col("threshold_minor")))
    by = Window.partitionBy("account").orderBy("ts_us", "txn_id")
    upto = F.count(F.lit(1)).over(Window.partitionBy("account").orderBy("ts_us").rangeBetween(Window.unboundedPreceding, s.r5_us))
    a = l.withColumn("i", F.row_number().over(by)).withColumn("end", upto)
    prev = F.lag("end").over(by)
    top = a.withColumn("prev", prev).filter((F.col("end") - F.col("i") + 1 >= s.r5_n) & (F.col("prev").isNull() | (F.col("end") > F.col("prev"))))
    top = top.select(F.col("account").alias("ta"), F.col("i").alias("lo"), F.col("end").alias("hi"), F.col("ts_us").alias("start"))
    w = a.join(top, (F.col("account") == F.col("ta")) & F.col("i").between(F.col("lo"), F.col("hi"))).groupBy("account", "lo", "hi", "start").agg(
        F.avg(F.col("amount_minor") / F.col("threshold_minor")).alias("tight"), F.collect_list("txn_id").alias("txns"))
    n = (F.col("hi") - F.col("lo") + 1).cast("double")
    low = s.r5_band / 1e6
    return _hits(w, "R5", combine(excess(n, s.r5_n, 2 * s.r5_n), clamp((F.col("tight") - low) / (1.0 - low))), n, F.col("start"), F.col("start") + F.lit(s.r5_us), F.col("txns"))


def _local_day(l: DataFrame) -> DataFrame:
    return l.withColumn("day", F.unix_date("event_date_local").cast("long"))


def _let(x: Column, made) -> Column:
    """``made(x)`` with ``x`` computed once, however often it is named, also inside a function of an array's elements."""
    return F.element_at(F.transform(F.array(x), made), 1)


def _median(a: Column) -> Column:
    return _let(F.sort_array(a), lambda s: (F.element_at(s, F.floor((F.size(s) + 1) / 2).cast("int")) + F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))) / 2.0)


def r6(events: DataFrame, s: Settings) -> DataFrame:
    """Velocity spike: a day's count against the account's own earlier days, by median and MAD."""
    l = _local_day(rule_legs(events, "R6", s))
    d = l.groupBy("account", "day").agg(F.count(F.lit(1)).cast("double").alias("n"))
    w = Window.partitionBy("account").orderBy("day").rangeBetween(-(s.r6_days - 1), 0)
    d = d.withColumn("series", F.collect_list("n").over(w)).filter(F.size("series") > s.r6_least_days)
    spread = lambda med: _let(_median(F.transform("series", lambda x: F.abs(x - med))), lambda mad: F.when(mad > 0, (F.col("n") - med) / (F.lit(1.4826) * mad)))
    d = d.withColumn("z", _let(_median(F.col("series")), spread)).filter(F.col("z") >= s.r6_z)
    best = d.groupBy("account").agg(F.min(F.struct((-F.col("z")).alias("k"), "day")).alias("b")).select(F.col("account").alias("ba"), (-F.col("b.k")).alias("z"), F.col("b.day").alias("bd"))
    t = l.join(best, (F.col("account") == F.col("ba")) & (F.col("day") == F.col("bd"))).groupBy("account", "z", "bd").agg(F.collect_list("txn_id").alias("txns"))
    return _hits(t, "R6", excess(F.col("z"), s.r6_z, 2 * s.r6_z), F.col("z"), F.col("bd") * DAY, (F.col("bd") + 1) * DAY, F.col("txns"))


def r7(events: DataFrame, s: Settings) -> DataFrame:
    """Dormant reactivation: a gap in local days, then k events within the window from the day's label on."""
    l = _local_day(rule_legs(events, "R7", s))
    days = l.select("account", "day").distinct()
    g = days.withColumn("gap", F.col("day") - F.lag("day").over(Window.partitionBy("account").orderBy("day"))).filter(F.col("gap") >= s.r7_days)
    g = g.select(F.col("account").alias("ga"), "gap", (F.col("day") * DAY).alias("start"))
    j = l.join(g, (F.col("account") == F.col("ga")) & F.col("ts_us").between(F.col("start"), F.col("start") + F.lit(s.r7_us)))
    b = j.groupBy("account", "gap", "start").agg(F.count(F.lit(1)).alias("n"), F.collect_list("txn_id").alias("txns")).filter(F.col("n") >= s.r7_k)
    first = Window.partitionBy("account").orderBy(F.desc("gap"), "start")
    b = b.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    sev = combine(excess(F.col("n").cast("double"), s.r7_k, 2 * s.r7_k), clamp((F.col("gap") - s.r7_days) / F.lit(float(s.r7_days))))
    return _hits(b, "R7", sev, F.col("gap"), F.col("start"), F.col("start") + F.lit(s.r7_us), F.col("txns"))


def r8(events: DataFrame, s: Settings) -> DataFrame:
    """Odd-hour shift: the share in the account's quietest baseline hours jumps in its last days."""
    l = _local_day(rule_legs(events, "R8", s))
    anchor = l.groupBy("account").agg(F.max("day").alias("last"), F.count(F.lit(1)).alias("all")).filter(F.col("all") >= s.r8_least)
    l = l.join(anchor, "account").withColumn("recent", F.col("day") >= F.col("last") - (s.r8_recent_days - 1))
    hours = l.groupBy("account", F.col("local_hour").cast("int").alias("hour")).agg(F.count_if(~F.col("recent")).alias("b"), F.count_if("recent").alias("r"))
    grid = anchor.select("account", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    hours = grid.join(hours, ["account", "hour"], "left").select("account", "hour", F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("r", F.lit(0)).alias("r"))
    quiet = F.row_number().over(Window.partitionBy("account").orderBy("b", "hour")) <= s.r8_quiet_hours
    a = hours.withColumn("quiet", quiet).groupBy("account").agg(
        F.sum("b").alias("nb"), F.sum("r").alias("nr"), F.sum(F.when(F.col("quiet"), F.col("b")).otherwise(0)).alias("qb"), F.sum(F.when(F.col("quiet"), F.col("r")).otherwise(0)).alias("qr"))
    a = a.filter((F.col("nb") >= s.r8_least_baseline) & (F.col("nr") > 0)).withColumn("jump", F.col("qr") / F.col("nr") - F.col("qb") / F.col("nb")).filter(F.col("jump") >= s.r8_jump)
    t = l.filter("recent").join(a.select("account", "jump"), "account").groupBy("account", "jump", "last").agg(F.collect_list("txn_id").alias("txns"), F.max("ts_us").alias("end"))
    return _hits(t, "R8", above_share(F.col("jump"), s.r8_jump), F.col("jump"), (F.col("last") - (s.r8_recent_days - 1)) * DAY, F.col("end"), F.col("txns"))


def r9(events: DataFrame, s: Settings) -> DataFrame:
    """Amount regime shift: the median of the last days against the days before, per currency."""
    l = _local_day(rule_legs(events, "R9", s))
    anchor = l.groupBy("account").agg(F.max("day").alias("last"))
    l = l.join(anchor, "account").withColumn("from", F.col("last") - (s.r9_recent_days - 1))
    l = l.filter(F.col("day") >= F.col("from") - s.r9_baseline_days).withColumn("recent", F.col("day") >= F.col("from"))
    m = l.groupBy("account", "currency", "last", "from").agg(
        F.sort_array(F.collect_list(F.when(F.col("recent"), F.col("amount_minor")))).alias("r"), F.sort_array(F.collect_list(F.when(~F.col("recent"), F.col("amount_minor")))).alias("b"),
        F.collect_list("txn_id").alias("txns")).filter((F.size("r") > 0) & (F.size("b") > 0))
    m = m.withColumn("ratio", _middle("r") / _middle("b")).filter((F.col("ratio") > 0) & ((F.col("ratio") < 1 / s.r9_m) | (F.col("ratio") > s.r9_m)))
    first = Window.partitionBy("account").orderBy(F.desc(F.abs(F.log("ratio"))), "currency")
    m = m.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    return _hits(m, "R9", log_band(F.col("ratio"), s.r9_m), F.col("ratio"), (F.col("from") - s.r9_baseline_days) * DAY, (F.col("last") + 1) * DAY, F.col("txns"))


def r10(events: DataFrame, s: Settings) -> DataFrame:
    """Fast cash-out: what is cashed out within the holding time of an inflow is at least the share of it."""
    l = rule_legs(events, "R10", s)
    inn = l.filter("side = 'in'").select("account", "currency", F.col("ts_us").alias("i_ts"), F.col("txn_id").alias("i_id"), F.col("amount_minor").alias("i_amt"))
    out = l.filter((F.col("side") == "out") & F.col("txn_type").isin(*s.cash_out)).select("account", "currency", "ts_us", "txn_id", "amount_minor")
    e = over_items(inn, out, ["account", "currency"], F.col("i_ts"), s.r10_us, {"total": (F.col("amount_minor"), "sum"), "end": (F.col("ts_us"), "max")})
    e = e.filter(F.col("total").isNotNull() & ratio_at_least(F.col("total"), F.col("i_amt"), s.r10_share)).withColumn("share", F.col("total") / F.col("i_amt"))
    b = e.groupBy("account").agg(F.min(F.struct((-F.col("share")).alias("k"), "currency", "i_ts", "i_id", "end")).alias("b")).select("account", "b.*")
    # only the best inflow of an account asks for its cash-outs one by one
    those = out.select(F.col("account").alias("oa"), F.col("currency").alias("oc"), F.col("ts_us").alias("o_ts"), F.col("txn_id").alias("o_id"))
    j = paths.interval_join(b, those, [("account", "oa"), ("currency", "oc")], "i_ts", "o_ts", 0, s.r10_us)
    h = j.groupBy("account", "k", "i_ts", "i_id", "end").agg(F.array_sort(F.collect_list("o_id")).alias("outs"))
    x = -F.col("k")
    return _hits(h, "R10", above_share(x, s.r10_share / 1e6), x, F.col("i_ts"), F.col("end"), F.concat("outs", F.array("i_id")))


def r11(events: DataFrame, s: Settings) -> DataFrame:
    """New-counterparty surge: first-time peers in a window, and their share of those active."""
    l = rule_legs(events, "R11", s)
    contact = Window.partitionBy("account", "peer").orderBy("ts_us", "txn_id")
    came, went = first_and_last(l, ["account"], "peer", s.r11_us + 1, order=("txn_id",))
    d = l.select("account", "peer", "ts_us", "txn_id", came.alias("came"), went.alias("went"), F.lag("ts_us").over(contact).isNull().cast("long").alias("new"))
    d = grown(d, ["account"], {"active": (F.col("came"), F.col("went"), s.r11_us + 1)})
    d = d.groupBy("account", "ts_us").agg(F.max("active").alias("active"), F.sum("new").alias("k"))
    # first contacts in [t, t + w] of every instant t that has legs: all up to its end less those before t, frames that only grow
    upto = Window.partitionBy("account").orderBy("ts_us")
    some = lambda end: F.sum("k").over(upto.rangeBetween(Window.unboundedPreceding, end))
    d = d.withColumn("fresh", some(s.r11_us) - some(0) + F.col("k"))
    # a window begins at the first instant from ts - w on: seen from the end of time, the latest one passed
    instant, none = F.struct("ts_us", "fresh"), F.lit(None)
    asks = F.struct((F.col("ts_us") - s.r11_us).alias("t"), F.lit(1).alias("asks"), none.cast("struct<ts_us:bigint,fresh:bigint>").alias("at"), F.col("active").alias("active"))
    d = d.select("account", F.inline(F.array(F.struct(F.col("ts_us").alias("t"), F.lit(0).alias("asks"), instant.alias("at"), none.cast("bigint").alias("active")), asks)))
    since = Window.partitionBy("account").orderBy(F.desc("t"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("first", F.min("at").over(since)).filter("asks = 1")
    b = d.groupBy("account").agg(F.max(F.struct(F.col("first.fresh").alias("fresh"), (-F.col("first.ts_us")).alias("m"), "active")).alias("b"))
    b = b.select(F.col("account").alias("ba"), F.col("b.fresh").alias("fresh"), (-F.col("b.m")).alias("start"), F.col("b.active").alias("active"))
    b = b.filter((F.col("fresh") >= s.r11_c) & (F.col("fresh") / F.col("active") >= s.r11_share))
    t = l.join(b, (F.col("account") == F.col("ba")) & F.col("ts_us").between(F.col("start"), F.col("start") + F.lit(s.r11_us))).groupBy("account", "fresh", "start").agg(F.collect_list("txn_id").alias("txns"))
    x = F.col("fresh").cast("double")
    return _hits(t, "R11", excess(x, s.r11_c, 2 * s.r11_c), x, F.col("start"), F.col("start") + F.lit(s.r11_us), F.col("txns"))


def r12(events: DataFrame, s: Settings, rails: DataFrame | None = None) -> DataFrame:
    """Chain members: one hit per account and maximal chain."""
    c = paths.chains(paths.adjacency(events, s.reversals, rails), *s.r12_hops, s.r12_us)
    step = lambda i: F.least(F.lit(1.0), F.element_at("amounts", i + 1) / F.element_at("amounts", i) / F.lit(s.r12_decay))
    fid = F.aggregate(F.transform(F.sequence(F.lit(1), F.size("amounts") - 1), step), F.lit(0.0), lambda a, x: a + x) / (F.size("amounts") - 1)
    n = F.col("hops").cast("double")
    c = c.withColumn("sev", combine(excess(n, s.r12_hops[0], 2 * s.r12_hops[0]), fid)).withColumn("account", F.explode("nodes"))
    return _hits(c, "R12", F.col("sev"), n, F.array_min("at"), F.array_max("at"), F.col("txns"))


def run_rules(events: DataFrame, s: Settings | None = None, excluded: DataFrame | None = None, rails: DataFrame | None = None, skip: DataFrame | None = None, only: tuple[str, ...] | None = None, cycles: DataFrame | None = None) -> DataFrame:
    """Hits of all rules, with name, signature and overlap group; ``cycles`` as in ``r4``."""
    s = s or Settings()
    made = {
        "R1": lambda: r1(events, s), "R2": lambda: r2(events, s, excluded), "R3": lambda: r3(events, s, excluded), "R4": lambda: r4(events, s, skip, cycles),
        "R5": lambda: r5(events, s), "R6": lambda: r6(events, s), "R7": lambda: r7(events, s), "R8": lambda: r8(events, s), "R9": lambda: r9(events, s),
        "R10": lambda: r10(events, s), "R11": lambda: r11(events, s), "R12": lambda: r12(events, s, rails),
    }
    return annotate(reduce(DataFrame.unionByName, (make() for r, make in made.items() if only is None or r in only)))


def annotate(hits: DataFrame) -> DataFrame:
    name = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    group = F.create_map(*[F.lit(x) for g, rs in OVERLAP.items() for r in rs for x in (r, g)])
    return hits.withColumns({
        "rule_name": name[F.col("rule_id")], "overlap_group": F.try_element_at(group, F.col("rule_id")),
        "hit_signature": F.sha2(F.concat_ws("|", "rule_id", "account_key", F.concat_ws(",", "txn_ids")), 256),
    })


def dedupe(hits: DataFrame) -> DataFrame:
    """One hit per (rule, account, signature): the strongest, with all its events and how often it was seen."""
    best = F.max_by(F.struct("severity", "observation", "window_start_us", "window_end_us"), F.struct("severity", (-F.col("window_start_us")).alias("m")))
    d = hits.groupBy("rule_id", "account_key", "hit_signature").agg(
        best.alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("txn_ids")))).alias("txn_ids"), F.count(F.lit(1)).alias("windows_observed"))
    return d.select("rule_id", "account_key", "hit_signature", "b.*", "txn_ids", "windows_observed")


def overlaps(hits: DataFrame) -> DataFrame:
    """One unit of evidence per (account, overlap group) with at least two hits."""
    return hits.filter("overlap_group is not null").groupBy("account_key", "overlap_group").agg(
        F.count(F.lit(1)).alias("members"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"), F.max("severity").alias("severity")).filter("members >= 2")


def hit_rates(hits: DataFrame, accounts: int, s: Settings | None = None) -> DataFrame:
    """Per rule: accounts hit, rate, verdict, and the observation at the rank the ceiling allows."""
    s = s or Settings()
    per = hits.groupBy("rule_id", "account_key").agg(F.max("observation").alias("o"))
    allowed = max(1, int(s.ceiling * accounts))
    a = running(per, [F.desc("o"), F.col("account_key")], ("rule_id",), name="rank").groupBy("rule_id").agg(F.count(F.lit(1)).alias("accounts_hit"), F.max(F.when(F.col("rank") == allowed, F.col("o"))).alias("at_ceiling"))
    every = hits.sparkSession.createDataFrame([(r,) for r in NAMES], "rule_id string")
    d = every.join(a, "rule_id", "left").withColumn("accounts_hit", F.coalesce("accounts_hit", F.lit(0)))
    rate = F.col("accounts_hit") / F.lit(float(max(accounts, 1)))
    state = F.when(F.col("accounts_hit") == 0, "dead").when(rate > s.ceiling, "above_ceiling").when(rate < s.floor, "below_floor").otherwise("ok")
    return d.select("rule_id", "accounts_hit", rate.alias("hit_rate"), state.alias("state"), F.when(rate > s.ceiling, F.col("at_ceiling")).alias("suggested_threshold"))


def analysis_windows(events: DataFrame, days: int, overlap_hours: int = 168) -> DataFrame:
    """(window, start_us, end_us): tumbling windows over the timeline, each reading back by the overlap."""
    t = events.agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("z"))
    step = days * DAY
    w = t.select("a", "z", F.posexplode(F.sequence(F.col("a"), F.col("z"), F.lit(step))).alias("window", "t"))
    return w.select("window", F.greatest("a", F.col("t") - F.lit(overlap_hours * HOUR)).alias("start_us"), F.least(F.col("t") + F.lit(step - 1), F.col("z")).alias("end_us"))


def in_windows(events: DataFrame, windows: DataFrame, s: Settings, only: tuple[str, ...]) -> DataFrame:
    """Hits of rules of single accounts in each analysis window, with ``window``, from one plan for all windows.

    A window's accounts are accounts of their own (its number stands before the name), so
    every rule sees of an event what the window sees; an event is in as many windows as
    overlap at it. Rules whose threshold comes from all events take it from all windows.
    """
    w = F.broadcast(windows.select("window", "start_us", "end_us"))  # a row per window
    own = lambda c: F.concat_ws("|", "window", c).alias(c)
    rest = [c for c in events.columns if c not in ("account_from", "account_to")]
    e = events.join(w, F.col("ts_us").between(F.col("start_us"), F.col("end_us"))).select(*rest, own("account_from"), own("account_to"))
    h = run_rules(e, s, only=only).drop("rule_name", "overlap_group", "hit_signature")
    h = h.withColumn("window", F.substring_index("account_key", "|", 1).cast("int")).withColumn("account_key", F.expr("substr(account_key, instr(account_key, '|') + 1)"))
    return annotate(h)


def dedupe_windows(hits: DataFrame) -> DataFrame:
    """Of one pattern seen in several analysis windows, the earliest stays."""
    w = Window.partitionBy("rule_id", "account_key", "hit_signature").orderBy("window", "window_start_us")
    return hits.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
