"""Word tables: the most frequent rows within a bound, found without gathering or a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_by_count(table: DataFrame, bound: int, n: str = "n") -> tuple[DataFrame, DataFrame]:
    """(frequent, rest): rows whose count reaches the lowest one that keeps them within ``bound``.

    Rows per count are summed first, so the cut is found over distinct counts. Rows of
    equal count are all in or all out.
    """
    hist = table.groupBy(n).agg(F.count(F.lit(1)).alias("k"))
    cut = hist.withColumn("upto", F.sum("k").over(Window.orderBy(F.desc(n)))).filter(F.col("upto") <= bound).agg(F.min(n)).first()[0]
    if cut is None:
        return table.filter(F.lit(False)), table
    return table.filter(F.col(n) >= cut), table.filter(F.col(n) < cut)
