"""Why a labelled ring is not found: each setting of the ring search that leaves it out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What can leave a ring out, in the order of the settings.
REASONS = (
    "incomplete", "not_closed", "account_repeats", "reversal_leg", "length_below_min", "length_above_max", "time_reversal", "zero_value",
    "retention_floor", "cross_currency", "amount_increases",
)


def measured(rows: DataFrame, attempt: str = "attempt", step: str = "step", reversals: tuple[str, ...] = ("error",)) -> DataFrame:
    """Per attempt, of its legs in the order of ``step``: what the search's settings look at.

    ``rows`` has account_from, account_to, ts_us, amount_minor, currency and txn_type per
    leg. Legs are met by a window in order and by sums, so no attempt is gathered. A null
    in a leg makes its ring ``incomplete``; an attempt may have any number of legs.
    """
    w = Window.partitionBy(attempt).orderBy(step, "ts_us", "account_from", "account_to")
    before = lambda c: F.lag(c).over(w)
    needed = ("account_from", "account_to", "ts_us", "amount_minor", "currency")
    holes = F.lit(False)
    for c in needed:
        holes |= F.col(c).isNull()
    d = rows.select(attempt, step, *needed, "txn_type", holes.alias("hole"), F.row_number().over(w).alias("nth"), *[before(c).alias(f"last_{c}") for c in ("account_to", "ts_us", "amount_minor")])
    last = F.col("nth") > 1
    most, least = F.max("amount_minor"), F.min("amount_minor")
    return d.groupBy(attempt).agg(
        F.count(F.lit(1)).alias("legs"), F.bool_or("hole").alias("incomplete"),
        (F.min_by("account_from", "nth").eqNullSafe(F.max_by("account_to", "nth")) & F.bool_and(~last | F.col("account_from").eqNullSafe(F.col("last_account_to")))).alias("closes"),
        (F.count_distinct("account_from") < F.count("account_from")).alias("repeats"),
        F.bool_or(F.coalesce(F.col("txn_type").isin(*reversals), F.lit(False))).alias("reverses"),
        F.count_if(last & (F.col("ts_us") <= F.col("last_ts_us"))).alias("turns_back"), F.count_if(last & (F.col("ts_us") == F.col("last_ts_us"))).alias("same_instant"),
        F.count_if(last & (F.col("amount_minor") > F.col("last_amount_minor"))).alias("increases"), (F.min("currency") != F.max("currency")).alias("converts"),
        most.alias("most"), F.coalesce(F.when(most > 0, least / most), F.lit(0.0)).alias("retention"),
        F.coalesce(F.when(most > 0, F.call_function("div", least.cast("decimal(20,0)") * F.lit(1_000_000), most.cast("decimal(20,0)"))), F.lit(0)).alias("retention_micro"),
    )


def reasons(
    rings: DataFrame, min_length: int = 3, max_length: int = 6, retention_micro: int = 600_000,
    non_increasing: bool = False, strict: bool = True, same_currency: bool = True,
) -> DataFrame:
    """``rings`` with ``reasons``: every setting that leaves the ring out, not just the first; empty if none does.

    Settings are those of ``paths.cycles``, so a ring without a reason is one that it finds.
    """
    back = F.col("turns_back") if strict else F.col("turns_back") - F.col("same_instant")
    tests: dict[str, Column] = {
        "incomplete": F.col("incomplete"), "not_closed": ~F.col("closes"), "account_repeats": F.col("repeats"), "reversal_leg": F.col("reverses"),
        "length_below_min": F.col("legs") < min_length, "length_above_max": F.col("legs") > max_length, "time_reversal": back > 0,
        "zero_value": F.col("most") == 0, "retention_floor": (F.col("most") > 0) & (F.col("retention_micro") < retention_micro),
        "cross_currency": F.col("converts") & F.lit(same_currency), "amount_increases": (F.col("increases") > 0) & F.lit(non_increasing),
    }
    return rings.withColumn("reasons", F.array_compact(F.array(*[F.when(tests[r], r) for r in REASONS])))


def anatomy(explained: DataFrame) -> DataFrame:
    """(reason, rings, alone, best_retention): rings that each reason leaves out, and near misses, those it alone leaves out.

    Every reason has a row; ``found`` counts the rings without one.
    """
    one = F.when(F.size("reasons") == 0, F.array(F.lit("found"))).otherwise(F.col("reasons"))
    got = explained.select(F.explode(one).alias("reason"), (F.size("reasons") <= 1).alias("alone"), "retention").groupBy("reason").agg(
        F.count(F.lit(1)).alias("rings"), F.count_if("alone").alias("alone"), F.max("retention").alias("best_retention"))
    every = explained.sparkSession.createDataFrame([(r,) for r in ("found", *REASONS)], "reason string")
    return every.join(got, "reason", "left").fillna(0, ["rings", "alone"])
