"""Does a feature see the future? Two builds, with and without it, compared value by value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paygrove.session import scratch_table


class LeakError(ValueError):
    """A column changes when the future is taken away."""


def compare(
    build: Callable[[DataFrame], DataFrame], events: DataFrame, cutoffs: list[int], keys: list[str], columns: list[str] | None = None, ts: str = "ts_us",
) -> DataFrame:
    """(cutoff_us, column, n, changed, missing): at each cutoff, how many rows up to it a column has another value for once later events are gone.

    ``build`` makes features of events, rows named by ``keys``; it runs once over all
    events and once per cutoff over the events up to it. Rows meet by a null-safe join and
    values are equal if both are null or alike, doubles to the last bit. ``missing`` counts
    rows that only one of the builds has. A feature that reads nothing after a row's own
    instant changes nowhere.
    """
    whole = build(events)
    columns = columns or [c for c in whole.columns if c not in (*keys, ts)]
    keep = [*keys, *([] if ts in keys else [ts])]
    names = [f"c{k}" for k in range(len(columns))]
    shape = lambda d, side: d.select(
        *[F.col(c).alias(f"k{n}") for n, c in enumerate(keep)], F.lit(True).alias(side), *[F.col(c).alias(f"{side}_{x}") for c, x in zip(columns, names, strict=True)])
    full = scratch_table(shape(whole, "a"), "whole-build")
    at_key = f"k{keep.index(ts)}"
    out = None
    for cutoff in cutoffs:  # a handful of declared instants
        part = shape(build(events.filter(F.col(ts) <= cutoff)), "b")
        seen = full.filter(F.col(at_key) <= cutoff).alias("x")
        same = F.lit(True)
        for n in range(len(keep)):
            same = same & F.col(f"x.k{n}").eqNullSafe(F.col(f"y.k{n}"))
        both = seen.join(part.alias("y"), same, "full")
        one = F.count_if(F.col("a").isNull() | F.col("b").isNull())
        met = F.col("a").isNotNull() & F.col("b").isNotNull()
        sums = both.agg(F.count(F.lit(1)).alias("n"), one.alias("missing"), *[F.count_if(met & ~F.col(f"a_{x}").eqNullSafe(F.col(f"b_{x}"))).alias(x) for x in names])
        rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(x).alias("changed")) for c, x in zip(columns, names, strict=True)]))
        found = sums.select(F.lit(cutoff).cast("bigint").alias("cutoff_us"), "n", "missing", rows).select("cutoff_us", "column", "n", "changed", "missing")
        out = found if out is None else out.unionByName(found)
    return out


def refuse(found: DataFrame) -> DataFrame:
    """``found`` from ``compare``, or an error that names each column that leaks and where."""
    bad = found.filter("changed > 0 or missing > 0").select("column", "cutoff_us", "changed", "missing").orderBy("column", "cutoff_us").collect()  # a row per column and cutoff
    if bad:
        raise LeakError("; ".join(f"{r.column} at {r.cutoff_us}: {r.changed} of its rows change, {r.missing} come or go" for r in bad))
    return found
