"""Joins of rows to one row per key, where a few keys may have a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many rows is hot, so at most so many keys are.
HOT = 4096


def meet(rows: DataFrame, table: DataFrame, keys: list[str], count: str, spread, hot: int = HOT) -> DataFrame:
    """``rows`` joined to ``table`` by ``keys``, which are never null.

    ``table``, a written table, has one row per key; its column ``count`` says how many
    rows the key has. Keys with more than one in ``hot`` of all rows are at most ``hot``,
    a bound that holds at every size, and are broadcast. Every other row meets its key
    through a shuffle; rows already met pass it under the hash of ``spread``.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    named = table.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*[c for c in table.columns if c not in keys]).alias("__row"), F.col(count).alias("__n"))
    is_hot = F.col("__n") * hot > total
    near = F.broadcast(named.filter(is_hot).drop("__n").withColumnRenamed("__row", "__near"))
    x = rows.join(near, [F.col(k) == F.col(f"__{k}") for k in keys], "left").drop(*[f"__{k}" for k in keys])
    # a met row looks for nothing: its first key becomes null, with a second one that deals it anew
    x = x.withColumn("__first", F.when(F.col("__near").isNull(), F.col(keys[0])))
    x = x.withColumn("__deal", F.when(F.col("__near").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread), F.lit(1 << 20)).cast("int")))
    far = named.filter(~is_hot).drop("__n").withColumn("__d", F.lit(0))
    same = [F.col("__first") == F.col(f"__{keys[0]}"), F.col("__deal") == F.col("__d"), *[F.col(k) == F.col(f"__{k}") for k in keys[1:]]]
    x = x.join(far, same, "left").withColumn("__row", F.coalesce("__near", "__row")).filter("__row is not null")
    return x.select(*rows.columns, "__row.*")
