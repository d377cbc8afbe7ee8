"""Windows of busy keys, dealt over tasks by time.

A key with more rows than one task should sort is cut into cells: stretches of time with
about as many rows each. Every window over such a key is then local windows over (key,
cell) and what the earlier cells carry over, a row per key and cell. Keys within the
bound have one cell and no carried row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrove.session import scratch_table

#: Rows of a key that one task sorts; a busier key is cut into cells of about so many.
ROWS = 1_000_000
#: Cells begin and end at multiples of this, so rows of one instant are never parted.
SLOT = 3_600_000_000

CELL, BUSY = "__cell", "__busy"


@dataclass
class Cells:
    """(key, slot, cell) of every slot of each busy key from its first row to its last."""

    table: DataFrame
    key: str
    ts: str
    slot_us: int

    def place(self, df: DataFrame, key: str | None = None, ts: str | None = None) -> DataFrame:
        """``df`` with its cell and whether its key is busy; rows of a busy key outside all cells go.

        ``key`` and ``ts`` name its columns where they are called otherwise.

        Only rows that leave a window lie there, after the key's last row: no row is left
        that could see them leave.
        """
        key, ts = key or self.key, ts or self.ts
        keys = self.table.select(F.col(self.key).alias("__k")).distinct()
        t = self.table.select(F.col(self.key).alias("__k"), F.col("slot").alias("__s"), F.col("cell").alias("__c"))
        slot = F.floor(F.col(ts) / self.slot_us)
        x = df.join(t, (F.col(key) == F.col("__k")) & (slot == F.col("__s")), "left").drop("__k", "__s")
        busy = x.join(keys.withColumn("__b", F.lit(True)), F.col(key) == F.col("__k"), "left").drop("__k")
        busy = busy.withColumn(BUSY, F.coalesce("__b", F.lit(False))).drop("__b")
        return busy.filter(~F.col(BUSY) | F.col("__c").isNotNull()).withColumn(CELL, F.coalesce("__c", F.lit(0))).drop("__c")


def cells(df: DataFrame, key: str, ts: str = "ts_us", rows: int = ROWS, slot_us: int = SLOT) -> Cells | None:
    """The cells of keys with more than ``rows`` rows; None if there are none.

    A slot with more rows than ``rows`` is one cell. The running sum is over the slots of
    one key, a row each, so it grows with the time that the table spans and not with its
    rows.
    """
    many = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("all")).filter(F.col("all") > rows).select(key)
    if not many.limit(1).count():
        return None
    own = df.join(scratch_table(many, "busy"), key, "left_semi")
    per = scratch_table(own.groupBy(key, F.floor(F.col(ts) / slot_us).alias("slot")).agg(F.count(F.lit(1)).alias("n")), "slots")
    dense = per.groupBy(key).agg(F.min("slot").alias("a"), F.max("slot").alias("z")).select(key, F.explode(F.sequence("a", "z")).alias("slot"))
    full = dense.join(per, [key, "slot"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    made = full.select(key, "slot", F.floor(F.coalesce(upto, F.lit(0)) / rows).cast("int").alias("cell"))
    return Cells(scratch_table(made, "cells"), key, ts, slot_us)


def _joined(df: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the carried columns of its (keys, cell); null where none is."""
    c = carried.select(*[F.col(k).alias(f"__j{n}") for n, k in enumerate(keys)], F.col(CELL).alias("__jc"), *[x for x in carried.columns if x not in (*keys, CELL)])
    on = F.col(CELL) == F.col("__jc")
    for n, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__j{n}"))
    return df.join(c, on, "left").drop("__jc", *[f"__j{n}" for n in range(len(keys))])


_BOTH = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, keys: list[str], values: dict[str, tuple[Column, str]], ts: str = "ts_us", dealt: bool = False, order: list[str] | None = None) -> DataFrame:
    """``df`` with, for each name, the sum, max or min of its value over the key's rows up to this instant, ties included.

    ``dealt``: ``df`` has been placed in cells. With ``order``, a total order, the rows up
    to this row are taken instead.
    """
    x = df.withColumns({f"__v_{n}": v for n, (v, _) in values.items()})
    parts = [*keys, CELL] if dealt else keys
    w = Window.partitionBy(*parts)
    w = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) if order else w.orderBy(ts).rangeBetween(Window.unboundedPreceding, 0)
    if not dealt:
        return x.withColumns({n: _AGG[a](f"__v_{n}").over(w) for n, (_, a) in values.items()}).select(*[c for c in df.columns if c not in values], *values)
    x = scratch_table(x, "to-run")
    own = x.filter(BUSY).groupBy(*keys, CELL).agg(*[_AGG[a](f"__v_{n}").alias(f"__t_{n}") for n, (_, a) in values.items()])
    before = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    carried = own.select(*keys, CELL, *[_AGG[a](f"__t_{n}").over(before).alias(f"__b_{n}") for n, (_, a) in values.items()])
    x = _joined(x.withColumns({f"__o_{n}": _AGG[a](f"__v_{n}").over(w) for n, (_, a) in values.items()}), carried, keys)
    got = {n: _BOTH[a](F.col(f"__o_{n}"), F.col(f"__b_{n}")) for n, (_, a) in values.items()}
    return x.withColumns(got).select(*[c for c in df.columns if c not in values], *values)


def neighbour(df: DataFrame, keys: list[str], name: str, order: list[str], after: bool, ts: str = "ts_us", dealt: bool = False) -> DataFrame:
    """``df`` with the instant of the key's next row in the total ``order`` (or, not ``after``, of the one before); null at its end."""
    step = F.lead(ts) if after else F.lag(ts)
    if not dealt:
        return df.withColumn(name, step.over(Window.partitionBy(*keys).orderBy(*order)))
    x = scratch_table(df, "to-link")
    edge = x.filter(BUSY).groupBy(*keys, CELL).agg((F.min if after else F.max)(ts).alias("__e"))
    by = Window.partitionBy(*keys).orderBy(CELL)
    edge = edge.withColumn("__e", F.lead("__e").over(by) if after else F.lag("__e").over(by))
    x = _joined(x.withColumn("__o", step.over(Window.partitionBy(*keys, CELL).orderBy(*order))), edge, keys)
    return x.withColumn(name, F.coalesce("__o", "__e")).drop("__o", "__e")
