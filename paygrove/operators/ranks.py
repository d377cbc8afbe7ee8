"""Positions and running sums in a global order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrove.session import scratch_table

#: Rows that one range holds anyway; a table of no more is ordered as one, with the same result.
ONE_RANGE = 100_000


def running(
    df: DataFrame, order: list[Column], keys: tuple[str, ...] = (), value: Column | None = None, name: str = "position",
    agg=F.sum, also: dict[str, Column] | None = None, one_range: int | None = None,
) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (1, so the position, by default) over rows up to this one.

    ``agg`` may be ``F.max`` or ``F.min`` instead: then the largest or smallest value so
    far. ``also`` names more values that are run alike.

    The order is by ``keys``, then ``order``, which should be total: rows that tie in all
    of it are numbered in any order. Rows are dealt by ranges of the order and written
    once with their range. A window numbers each range of each key, and what the earlier
    ranges of the key hold is added; those sums, a row per range and key, are all that is
    looked at beyond one range. So one key may hold any share of the rows. A table of no
    more than ``one_range`` rows is one range.
    """
    values = {name: F.lit(1) if value is None else value, **(also or {})}
    kinds = dict(df.dtypes)
    tie = F.xxhash64(*[F.col(c) for c in df.columns if "map<" not in kinds[c]])
    key = [F.col(k).asc_nulls_first() for k in keys]
    # written first, since dealing by ranges reads its input twice
    x = scratch_table(df.withColumns({f"__v_{n}": v for n, v in values.items()}), "to-order")
    if x.count() <= (ONE_RANGE if one_range is None else one_range):
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return x.withColumns({n: agg(f"__v_{n}").over(upto) for n in values}).select(*df.columns, *values)
    x = x.repartitionByRange(*key, *order, tie).withColumn("__range", F.spark_partition_id())
    x = scratch_table(x, "ranges")
    sums = x.groupBy(*keys, "__range").agg(*[agg(f"__v_{n}").alias(f"__v_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], F.col("__range").alias("__r"), *[agg(f"__v_{n}").over(before).alias(f"__b_{n}") for n in values])
    inside = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = x.withColumns({f"__o_{n}": agg(f"__v_{n}").over(inside) for n in values})
    same = F.col("__range") == F.col("__r")
    for n, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{n}"))
    both = own.join(sums, same)
    total = {F.max: F.greatest, F.min: F.least}.get(agg, lambda a, b: F.coalesce(a + b, a, b))
    return both.withColumns({n: total(F.col(f"__o_{n}"), F.col(f"__b_{n}")) for n in values}).select(*df.columns, *values)
