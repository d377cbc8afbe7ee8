"""Time-respecting paths: cycles from half paths met in the middle, chains by bounded expansion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrove.session import checkpoint, scratch_table


def interval_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], at: str, ts: str, before: int, after: int) -> DataFrame:
    """Inner join on ``keys`` where right.ts lies in [left.at - before, left.at + after].

    Time buckets as wide as the interval make it an equi-join: a left row meets two
    buckets at most, so work follows the rows close in time and not a key's square.
    """
    width = before + after + 1
    low = F.floor((F.col(at) - before) / width)
    l = left.withColumn("__b", F.explode(F.sequence(low, F.floor((F.col(at) + after) / width))))
    r = right.withColumn("__rb", F.floor(F.col(ts) / width))
    on = F.col("__b") == F.col("__rb")
    for a, b in keys:
        on = on & (F.col(a) == F.col(b))
    return l.join(r, on).filter(F.col(ts).between(F.col(at) - before, F.col(at) + after)).drop("__b", "__rb")


def adjacency(events: DataFrame, reversals: tuple[str, ...] = ("error",), skip: DataFrame | None = None) -> DataFrame:
    """Legs that paths may use: no self-transfers, reversals, zero amounts, nor accounts in ``skip``."""
    e = events.filter((F.col("account_from") != F.col("account_to")) & ~F.col("txn_type").isin(*reversals) & (F.col("amount_minor") > 0))
    e = e.select("txn_id", "ts_us", "account_from", "account_to", "amount_minor", "currency")
    if skip is not None:
        s = skip.select("account")
        e = e.join(s.withColumnRenamed("account", "account_from"), "account_from", "left_anti").join(s.withColumnRenamed("account", "account_to"), "account_to", "left_anti")
    return e


def excluded_counts(events: DataFrame, reversals: tuple[str, ...] = ("error",), skip: DataFrame | None = None) -> DataFrame:
    """How many events each guard keeps out of the adjacency, by the first that applies."""
    why = F.when(F.col("account_from") == F.col("account_to"), "self_transfer").when(F.col("txn_type").isin(*reversals), "reversal").when(F.col("amount_minor") == 0, "zero_value")
    return events.withColumn("reason", F.coalesce(why, F.lit("kept"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _start(legs: DataFrame) -> DataFrame:
    return legs.select(
        F.array("account_from", "account_to").alias("path"), F.array("txn_id").alias("txns"), F.array("ts_us").alias("at"), F.array("amount_minor").alias("amounts"),
        F.col("account_to").alias("last"), F.col("ts_us").alias("now"), F.col("currency").alias("ccy"),
    )


def _extend(paths: DataFrame, legs: DataFrame, hop_us: int, ok: Column) -> DataFrame:
    x = interval_join(paths, legs, [("last", "account_from"), ("ccy", "currency")], "now", "ts_us", -1, hop_us)
    x = x.filter(ok & ~F.array_contains("txns", F.col("txn_id")))
    return x.select(
        F.concat("path", F.array("account_to")).alias("path"), F.concat("txns", F.array("txn_id")).alias("txns"), F.concat("at", F.array("ts_us")).alias("at"),
        F.concat("amounts", F.array("amount_minor")).alias("amounts"), F.col("account_to").alias("last"), F.col("ts_us").alias("now"), "ccy",
    )


def _band(amount: Column, retention_micro: int, slack: float = 0.0) -> Column:
    """Bands as wide as the retention allows: amounts of one cycle lie in one band or in neighbours."""
    if retention_micro <= 0:
        return F.lit(0).cast("bigint")
    return F.floor(F.log(amount) / F.lit(math.log(1_000_000 / min(retention_micro, 999_999))) + F.lit(slack)).cast("bigint")


def trimmed(legs: DataFrame, retention_micro: int = 600_000, strict: bool = True) -> DataFrame:
    """The legs that a time-respecting cycle may use, to a fixed point.

    A leg inside a cycle has an earlier leg of its currency and about its amount into its
    sender and a later one out of its receiver. A cycle's first leg has its last one, which
    comes later, into its sender, and its last leg its first one, which came earlier, out
    of its receiver. What lacks all three goes, and with it what stood on it. A round
    keeps first and last instants per account, currency and band, so a busy account costs
    an aggregate. Sparse tables lose nearly all their legs here.
    """
    x = scratch_table(legs.withColumn("__band", _band(F.col("amount_minor"), retention_micro)), "legs")
    n = x.count()
    while n:
        ends = F.array(
            F.struct(F.col("account_to").alias("a"), F.col("ts_us").alias("came"), F.lit(None).cast("bigint").alias("went")),
            F.struct(F.col("account_from").alias("a"), F.lit(None).cast("bigint").alias("came"), F.col("ts_us").alias("went")))
        own = x.select(F.inline(ends), F.col("currency").alias("c"), "__band").groupBy("a", "c", "__band").agg(
            F.min("came").alias("came0"), F.max("came").alias("came1"), F.min("went").alias("went0"), F.max("went").alias("went1"))
        near = own.withColumn("b", F.explode(F.array(F.col("__band") - 1, F.col("__band"), F.col("__band") + 1))).groupBy("a", "c", "b").agg(
            F.min("came0").alias("came0"), F.max("came1").alias("came1"), F.min("went0").alias("went0"), F.max("went1").alias("went1"))
        near = scratch_table(near, "ends")
        at = lambda side, who: (F.col(f"{side}.a") == F.col(f"l.{who}")) & (F.col(f"{side}.c") == F.col("l.currency")) & (F.col(f"{side}.b") == F.col("l.__band"))
        before = (lambda a, b: a < b) if strict else (lambda a, b: a <= b)
        t = F.col("l.ts_us")
        lead, follow = before(F.col("s.came0"), t), before(t, F.col("r.went1"))
        around, begun = before(t, F.col("s.came1")), before(F.col("r.went0"), t)
        y = x.alias("l").join(near.alias("s"), at("s", "account_from")).join(near.alias("r"), at("r", "account_to")).filter((lead & follow) | (follow & around) | (lead & begun)).select("l.*")
        x = scratch_table(y, "legs")
        left = x.count()
        if left == n:
            break
        n = left
    return x.drop("__band")


def _grown(halves: DataFrame, legs: DataFrame, retention_micro: int, hop_us: int | None, non_increasing: bool, strict: bool) -> DataFrame:
    """Half paths with one leg more: to a new account, in time, within the retention; met by account, currency and band."""
    ratio = retention_micro / 1_000_000
    l = legs.withColumn("__lb", _band(F.col("amount_minor"), retention_micro))
    if retention_micro <= 0:
        h = halves.withColumn("__hb", F.lit(0).cast("bigint"))
    else:
        low, high = _band(F.col("hi") * F.lit(ratio), retention_micro, -1e-9), _band(F.col("lo") / F.lit(ratio), retention_micro, 1e-9)
        h = halves.withColumn("__hb", F.explode(F.sequence(low, high)))
    gap = F.col("ts_us") - F.col("now")
    ok = (gap > 0) if strict else (gap >= 0) & ~F.array_contains("txns", F.col("txn_id"))
    if hop_us is not None:
        ok &= gap <= hop_us
    if non_increasing:
        ok &= F.col("amount_minor") <= F.element_at("amounts", -1)
    lo, hi = F.least("lo", "amount_minor"), F.greatest("hi", "amount_minor")
    ok &= ~F.array_contains("path", F.col("account_to")) & (lo * 1_000_000 >= hi * F.lit(retention_micro))
    x = h.join(l, (F.col("last") == F.col("account_from")) & (F.col("ccy") == F.col("currency")) & (F.col("__hb") == F.col("__lb")) & ok)
    return x.select(
        F.concat("path", F.array("account_to")).alias("path"), F.concat("txns", F.array("txn_id")).alias("txns"), F.concat("at", F.array("ts_us")).alias("at"),
        F.concat("amounts", F.array("amount_minor")).alias("amounts"), "first", F.col("account_to").alias("last"), "began", F.col("ts_us").alias("now"), lo.alias("lo"), hi.alias("hi"), "ccy",
    )


def cycles(
    legs: DataFrame, min_length: int = 3, max_length: int = 6, retention_micro: int = 600_000, hop_us: int | None = None,
    non_increasing: bool = False, strict: bool = True, round_cap: int | None = None,
) -> DataFrame:
    """Simple time-respecting cycles: nodes, txns, at, amounts, currency, length, retention, truncated.

    No account repeats, the smallest amount is at least the retention share of the
    largest, and each hop comes after the last (strictly later, or at the same instant
    too). There is no limit on the pause between hops unless ``hop_us`` sets one.

    Legs are trimmed first (``trimmed``). Paths then grow to half the length only; a cycle
    is a half path and another that begins later where the first ends and ends where it
    began, met by both accounts. So work follows paths of half the length. With
    ``round_cap``, a round keeps so many half paths and marks the search ``truncated``.
    """
    legs = trimmed(legs, retention_micro, strict)
    level = legs.select(
        F.array("account_from", "account_to").alias("path"), F.array("txn_id").alias("txns"), F.array("ts_us").alias("at"), F.array("amount_minor").alias("amounts"),
        F.col("account_from").alias("first"), F.col("account_to").alias("last"), F.col("ts_us").alias("began"), F.col("ts_us").alias("now"),
        F.col("amount_minor").alias("lo"), F.col("amount_minor").alias("hi"), F.col("currency").alias("ccy"))
    halves, cut = [scratch_table(level, "half-1")], False
    for k in range(2, -(-max_length // 2) + 1):
        grown = scratch_table(_grown(halves[-1], legs, retention_micro, hop_us, non_increasing, strict), f"half-{k}")
        if round_cap is not None and grown.count() > round_cap:
            cut, grown = True, scratch_table(grown.orderBy("now", "txns").limit(round_cap), f"half-{k}")
        halves.append(grown)
    found = None
    for n in range(min_length, max_length + 1):
        a, b = halves[-(-n // 2) - 1].alias("a"), halves[n // 2 - 1].alias("b")
        gap = F.col("b.began") - F.col("a.now")
        ok = (gap > 0) if strict else (gap >= 0) & ~F.arrays_overlap("a.txns", "b.txns")
        if hop_us is not None:
            ok &= gap <= hop_us
        if non_increasing:
            ok &= F.element_at("b.amounts", 1) <= F.element_at("a.amounts", -1)
        inner = lambda p: F.slice(p, 2, F.size(p) - 2)
        ok &= ~F.arrays_overlap(inner("a.path"), inner("b.path")) & (F.least("a.lo", "b.lo") * 1_000_000 >= F.greatest("a.hi", "b.hi") * F.lit(retention_micro))
        c = a.join(b, (F.col("a.last") == F.col("b.first")) & (F.col("a.first") == F.col("b.last")) & (F.col("a.ccy") == F.col("b.ccy")) & ok).select(
            F.concat("a.path", inner("b.path")).alias("nodes"), *[F.concat(f"a.{x}", f"b.{x}").alias(x) for x in ("txns", "at", "amounts")], F.col("a.ccy").alias("currency"))
        found = c if found is None else found.union(c)
    return found.select(
        "nodes", "txns", "at", "amounts", "currency", F.size("txns").alias("length"), (F.array_min("amounts") / F.array_max("amounts")).alias("retention"), F.lit(cut).alias("truncated"))


def rotated(nodes: Column) -> Column:
    """The cycle's nodes from the smallest on, so that its turns look alike."""
    at = F.array_position(nodes, F.array_min(nodes)).cast("int")
    return F.concat(F.slice(nodes, at, F.size(nodes)), F.slice(nodes, F.lit(1), at - 1))


def chains(
    legs: DataFrame, min_hops: int = 3, max_hops: int = 6, hop_us: int = 86_400_000_000, non_increasing: bool = True,
) -> DataFrame:
    """Maximal time-respecting simple paths of at least ``min_hops``: nodes, txns, at, amounts, hops.

    A chain whose events are a contiguous run of a longer chain's is left out: no chain
    that could be extended at its end within the depth is kept, nor one that is the tail
    of a chain with an earlier first leg.
    """
    ok = ~F.array_contains("path", F.col("account_to"))
    if non_increasing:
        ok = ok & (F.col("amount_minor") <= F.element_at("amounts", -1))
    level, kept = _start(legs), []
    for hops in range(2, max_hops + 1):
        nxt = checkpoint(_extend(level, legs, hop_us, ok))
        if hops > min_hops:
            longer = nxt.select(F.slice("txns", 1, hops - 1).alias("txns")).union(nxt.select(F.slice("txns", 2, hops - 1).alias("txns"))).distinct()
            kept.append(level.join(longer, "txns", "left_anti").select(*level.columns))
        level = nxt
    kept.append(level)
    out = kept[0]
    for x in kept[1:]:
        out = out.union(x)
    return out.select(F.col("path").alias("nodes"), "txns", "at", "amounts", F.col("ccy").alias("currency"), F.size("txns").alias("hops"))


def cycle_participation(c: DataFrame) -> DataFrame:
    """Per account: cycles it is in, the longest, and the best retention in basis points."""
    x = c.select(F.explode("nodes").alias("account"), "length", "retention")
    return x.groupBy("account").agg(
        F.count(F.lit(1)).alias("cycle_participation_count"), F.max("length").alias("longest_cycle_length"),
        F.rint(F.max("retention") * 10000).cast("long").alias("max_cycle_retention_bps"),
    )
