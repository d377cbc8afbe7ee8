"""Window kernels over (entity, time), all answered for every row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrove.operators import orders, spans
from paygrove.session import scratch_table


def trailing(keys: list[str], width: int, closed: bool = True, ts: str = "ts_us"):
    """RANGE frame of the last ``width`` microseconds; ``closed`` keeps a row exactly ``width`` back."""
    return Window.partitionBy(*keys).orderBy(ts).rangeBetween(-width if closed else -width + 1, 0)


def lifetime(keys: list[str], ts: str = "ts_us"):
    """All rows up to and including this instant, ties included."""
    return Window.partitionBy(*keys).orderBy(ts).rangeBetween(Window.unboundedPreceding, 0)


def sweep(df: DataFrame, keys: list[str], sums: Mapping[str, tuple[Column, Column]], ts: str = "ts_us", cells: spans.Cells | None = None) -> DataFrame:
    """``df`` with sums over trailing windows, in one sorted pass per key and linear in its rows.

    ``sums``: name -> (value, instant at which it leaves). A row adds its value at its own
    instant and a second, narrow row takes it away when it leaves; a running total, ties
    included, is then the window's sum. Unlike sliding frames the cost doesn't grow with
    the rows in a window, so an account with millions of rows is a sort, not a product.
    With ``cells`` busy keys are dealt by time, and what earlier cells still hold is carried.
    """
    if cells is not None:
        df = df.drop(spans.CELL, spans.BUSY)
    names, kinds = list(sums), dict(df.dtypes)
    out = df.withColumns({f"__v_{n}": F.coalesce(v, F.lit(0)) for n, (v, _) in sums.items()} | {f"__x_{n}": x for n, (_, x) in sums.items()})
    leaving: dict[str, list[str]] = {}
    for n, (_, x) in sums.items():
        leaving.setdefault(str(x), []).append(n)
    zero = {n: F.lit(0).cast(dict(out.dtypes)[f"__v_{n}"]) for n in names}
    some = F.greatest(*[F.when(F.col(f"__v_{n}") != 0, 1).otherwise(0) for n in names], F.lit(0)) > 0
    # one row becomes itself and a narrow one per instant at which something leaves, so what is above runs once
    real = F.struct(*[F.col(c) for c in df.columns], *[F.col(f"__v_{n}").alias(f"__d_{n}") for n in names], F.lit(True).alias("__real"), F.lit(True).alias("__keep"))
    gone = [
        F.struct(
            *[(F.col(f"__x_{group[0]}").cast(kinds[ts]) if c == ts else F.col(c) if c in keys else F.lit(None).cast(kinds[c])).alias(c) for c in df.columns],
            *[(-F.col(f"__v_{n}") if n in group else zero[n]).cast(dict(out.dtypes)[f"__v_{n}"]).alias(f"__d_{n}") for n in names], F.lit(False).alias("__real"), some.alias("__keep"))
        for group in leaving.values()
    ]
    both = out.select(F.inline(F.array(real, *gone))).filter("__keep")
    if cells is not None:
        both = cells.place(both)
    run = spans.running(both, keys, {n: (F.col(f"__d_{n}"), "sum") for n in names}, ts, dealt=cells is not None)
    return run.filter("__real").drop("__real", "__keep", *[f"__d_{n}" for n in names])


def grown(df: DataFrame, keys: list[str], sums: Mapping[str, tuple[Column, Column, int]], ts: str = "ts_us") -> DataFrame:
    """``df`` with, for each name, what has come up to each instant less what has gone ``lasts`` before it.

    ``sums``: name -> (value that comes, value that goes ``lasts`` later, lasts). With the
    same value twice that is the sum of a trailing window. Both are sums over frames that
    only grow, so it is one sort per key and linear, and unlike in ``sweep`` no row is
    added. Sums are of a key's whole life, so they must fit their type.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    upto = w.rangeBetween(Window.unboundedPreceding, 0)
    x = df.withColumns({f"__c_{n}": F.coalesce(c, F.lit(0)) for n, (c, _, _) in sums.items()} | {f"__g_{n}": F.coalesce(g, F.lit(0)) for n, (c, g, _) in sums.items() if g is not c})
    gone = lambda n, c, g: f"__c_{n}" if g is c else f"__g_{n}"
    zero = {n: F.lit(0).cast(dict(x.dtypes)[f"__c_{n}"]) for n in sums}
    return x.select(*[c for c in df.columns if c not in sums], *[
        (F.sum(f"__c_{n}").over(upto) - F.coalesce(F.sum(gone(n, c, g)).over(w.rangeBetween(Window.unboundedPreceding, -lasts)), zero[n])).cast(dict(x.dtypes)[f"__c_{n}"]).alias(n)
        for n, (c, g, lasts) in sums.items()])


def first_and_last(df: DataFrame, keys: list[str], subject: str, width: int, ts: str = "ts_us", order: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """For ``grown``: 1 where the subject was not there in the ``width`` before, and 1 where it won't be in the ``width`` after."""
    w = Window.partitionBy(*keys, subject).orderBy(ts, *order)
    before, after = F.lag(ts).over(w), F.lead(ts).over(w)
    one = lambda gap: F.when(gap.isNull() | (gap > width), 1).otherwise(0).cast("long")
    return one(F.col(ts) - before), one(after - F.col(ts))


def leaves_after(width: int, ts: str = "ts_us") -> Column:
    """For ``sweep``: the instant after the last one whose closed window still holds the row."""
    return F.col(ts) + F.lit(width + 1)


def leaves_distinct(df: DataFrame, keys: list[str], subject: str, width: int, name: str, ts: str = "ts_us", order: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """For ``sweep``: ``df`` with the instant at which a distinct subject stops being counted for the row.

    That is when the same subject comes again, or ``width`` after (a row exactly that far
    back no longer counts).
    """
    x = spans.neighbour(df, [*keys, subject], name, [ts, *order], after=True, ts=ts, dealt=dealt)
    return x.withColumn(name, F.least(F.col(name), F.col(ts) + F.lit(width)))


def window_orders(df: DataFrame, keys: list[str], targets: dict[str, tuple[Column, float, int]], ts: str = "ts_us", cells: spans.Cells | None = None) -> DataFrame:
    """``df`` with lower quantiles of trailing windows: name -> (value, q, width); 0 is the minimum and 1 the maximum.

    The element of the window at index floor(q * (n - 1)) of its sorted values.
    """
    return orders.passed(df, keys, targets, ts) if cells is None else orders.sliding(df, keys, targets, ts, cells)


def forward_sum(x: Column, keys: list[str], width: int, ts: str = "ts_us") -> Column:
    """Sum over [now, now + width): for outcomes only."""
    return F.coalesce(F.sum(x).over(Window.partitionBy(*keys).orderBy(ts).rangeBetween(0, width - 1)), F.lit(0))


def first_ever(df: DataFrame, keys: list[str], subject: str, where: Column, name: str, order: tuple[str, ...] = ("ts_us", "txn_id", "sign"), dealt: bool = False) -> DataFrame:
    """``df`` with 1 on the first matching row of each (key, subject), else 0."""
    x = spans.running(df, [*keys, subject], {name: (where.cast("int"), "sum")}, order=list(order), dealt=dealt)
    return x.withColumn(name, (where & (F.col(name) == 1)).cast("long"))


def quotient(a: Column, b: Column, scale: int, square: bool = False) -> Column:
    """a * scale over b (or b squared), truncated toward zero; null unless b > 0."""
    return F.when(b > 0, _div(a * F.lit(scale), b * b if square else b))


def _div(n: Column, d: Column) -> Column:
    return F.call_function("div", n, d)


def units_since(last: Column, unit_us: int, ts: str = "ts_us") -> Column:
    """Whole units since an instant; null if there is none."""
    return F.floor((F.col(ts) - last) / unit_us).cast("long")


#: A spread counts as measured when it clears so many rounding errors of a one-pass sum in doubles.
NOISE, EPS = 8.0, 2.220446049250313e-16
#: Sums up to these are exact in doubles, and only there a spread of zero is a measured one.
EXACT_SUM, EXACT_SQUARES = 1 << 26, 1 << 53


def sample_std(n: Column, s: Column, ss: Column) -> Column:
    """Sample standard deviation from the exact count, sum and sum of squares of integers.

    Null under two rows, and where the spread lies below the noise floor of doubles of
    this size. The sum of squared deviations is taken about q = s div n, in decimals:
    ss - q * (s + r) with r = s mod n, less r * r / n; so nothing cancels in doubles.
    """
    big = "decimal(38,0)"
    n, s = n.cast("long"), s.cast("long")
    r = F.pmod(s, F.nullif(n, F.lit(0)))
    q = _div(s - r, F.nullif(n, F.lit(0)))
    about = ss.cast(big) - q.cast("decimal(19,0)") * (s.cast("decimal(19,0)") + r.cast("decimal(19,0)"))
    spread = about.cast("double") - r.cast("double") * r.cast("double") / n.cast("double")
    wide, mean_term = ss.cast("double"), s.cast("double") * s.cast("double") / n.cast("double")
    floor = F.lit(NOISE * EPS) * n.cast("double") * F.greatest(F.abs(wide), F.abs(mean_term))
    exact = (F.abs(s) <= EXACT_SUM) & (wide <= EXACT_SQUARES) & (spread == 0)
    return F.when((n >= 2) & ((spread > floor) | exact), F.sqrt(spread / (n.cast("double") - 1)))


def over_items(queries: DataFrame, items: DataFrame, keys: list[str], begin: Column, width: int, values: dict[str, tuple[Column, str]], ts: str = "ts_us") -> DataFrame:
    """``queries`` with, for each name, the min, max or sum of a column of ``items`` with the same keys in the closed window [begin, begin + width]; null if none.

    Time is cut into blocks as long as the window, which so lies in two of them at most:
    it is the end of one, known from aggregates that run backwards, and the beginning of
    the next, from aggregates that run forwards. No pair of a query and an item is ever
    made, and a busy key is dealt by its blocks.
    """
    agg = {"min": F.min, "max": F.max, "sum": F.sum}
    length = width + 1
    block = lambda c: F.floor(c / F.lit(length))
    q = scratch_table(queries.withColumns({"__q": F.monotonically_increasing_id(), "__lo": begin.cast("bigint")}), "asked")
    x = items.select(*keys, F.col(ts).alias("__t"), *[c.alias(f"__v_{n}") for n, (c, _) in values.items()], F.lit(None).cast("bigint").alias("__q"), F.lit(None).cast("boolean").alias("__up"))
    kinds = dict(x.dtypes)
    none = [F.lit(None).cast(kinds[f"__v_{n}"]).alias(f"__v_{n}") for n in values]
    low = q.select(*keys, F.col("__lo").alias("__t"), *none, "__q", F.lit(False).alias("__up"))
    # a window within one block is the end of it, and is asked for once
    two = q.filter(block(F.col("__lo")) != block(F.col("__lo") + width))
    high = two.select(*keys, (F.col("__lo") + width).alias("__t"), *none, "__q", F.lit(True).alias("__up"))
    by = Window.partitionBy(*keys, "__b")
    # both frames only grow: one that shrinks from a block's end would be summed anew for every row
    upto = by.orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    since = by.orderBy(F.desc("__t")).rangeBetween(Window.unboundedPreceding, 0)
    all_ = x.union(low).union(high).withColumn("__b", block(F.col("__t")))
    got = all_.select("__q", *[F.when(F.col("__up"), agg[a](f"__v_{n}").over(upto)).otherwise(agg[a](f"__v_{n}").over(since)).alias(n) for n, (_, a) in values.items()])
    both = got.filter("__q is not null").groupBy("__q").agg(*[agg[a](n).alias(n) for n, (_, a) in values.items()])
    return q.join(both, "__q", "left").drop("__q", "__lo")


def asof_carry(left: DataFrame, right: DataFrame, keys: list[str], value: str, ts: str = "ts_us", tolerance: int | None = None) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` at or before each row, within ``tolerance``."""
    l = left.withColumn("__left", F.lit(1)).withColumn("__v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("__t", F.lit(None).cast("long"))
    r = right.select(*keys, ts, F.col(value).alias("__v"), F.col(ts).alias("__t")).withColumn("__left", F.lit(0))
    w = Window.partitionBy(*keys).orderBy(ts, "__left").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True)
    got = F.last(F.when(F.col("__t").isNotNull(), F.struct("__t", "__v")), ignorenulls=True).over(w)
    both = both.withColumn("__g", got).filter("__left = 1")
    ok = F.lit(True) if tolerance is None else F.col(ts) - F.col("__g.__t") <= tolerance
    return both.withColumn(value, F.when(ok, F.col("__g.__v"))).drop("__left", "__v", "__t", "__g")
