"""Entity-event frame: one row per participating account, its predicates and row values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrove.operators import spans

#: Local hours that count as overnight, and transaction types that are reversals.
OVERNIGHT = (0, 1, 2, 3, 4, 5)
REVERSALS = ("error",)


def explode_entities(events: DataFrame) -> DataFrame:
    """Two rows per event: the debit side with sign -1 and the credit side with +1."""
    side = lambda who, other, sign, bal: F.struct(
        F.col(who).alias("entity"), F.col(other).alias("counterparty"), F.lit(sign).alias("sign"),
        F.when(F.lit(sign) < 0, "out").otherwise("in").alias("direction"),
        F.col(f"{bal}_balance_before_minor").alias("balance_before"), F.col(f"{bal}_balance_after_minor").alias("balance_after"),
    )
    both = F.array(side("account_from", "account_to", -1, "src"), side("account_to", "account_from", 1, "dst"))
    rest = [c for c in events.columns if not c.endswith("_balance_before_minor") and not c.endswith("_balance_after_minor")]
    return events.select(*rest, F.inline(both)).withColumn("is_self", F.col("entity") == F.col("counterparty"))


def row_values(entities: DataFrame, dealt: bool = False) -> DataFrame:
    """Gap to the entity's previous event, and how far its balance moved from what it should.

    ``dealt``: busy entities have been placed in cells (``spans``).
    """
    x = spans.neighbour(entities, ["entity"], "before_us", ["ts_us", "txn_id", "sign"], after=False, dealt=dealt)
    moved = F.col("balance_after") - F.col("balance_before") - F.col("sign") * F.col("amount_minor")
    return x.withColumns({
        "gap_us": F.col("ts_us") - F.col("before_us"), "balance_delta_abs_minor": F.abs(moved),
    }).withColumns({
        "gap_since_previous_event_s": F.expr("gap_us div 1000000"), "gap_since_previous_event_days": F.expr("gap_us div 86400000000"),
    }).drop("gap_us", "before_us")


def predicates(sealed_us: int | None = None) -> dict[str, Column]:
    """The named predicates over ``row_values(explode_entities(...))``.

    With a seal, rows at or before it that were ingested after it are late arrivals
    (needs ``ingested_us``).
    """
    c = F.col
    up, down, some, own = c("sign") > 0, c("sign") < 0, c("amount_minor") != 0, c("is_self")
    late = F.lit(False) if sealed_us is None else (c("ts_us") <= sealed_us) & (c("ingested_us") > sealed_us)
    return {
        "always": F.lit(True), "zero_amount": ~some, "is_nonzero": some, "is_inflow": up, "is_outflow": down,
        "is_inflow_nonzero": up & some, "is_outflow_nonzero": down & some, "is_inflow_not_self": up & ~own,
        "is_outflow_not_self": down & ~own, "self_transfer": own, "not_self_transfer": ~own,
        "reversal_txn": c("txn_type").isin(*REVERSALS), "has_prior_event": c("gap_since_previous_event_s").isNotNull(),
        "has_balance": c("balance_after").isNotNull(), "has_balance_delta": c("balance_delta_abs_minor").isNotNull(),
        "balance_delta_mismatch": c("balance_delta_abs_minor").isNotNull() & (c("balance_delta_abs_minor") > 0),
        "zero_balance_after": c("balance_after").isNotNull() & (c("balance_after") == 0),
        "overnight_local_hour": c("local_hour").isin(*OVERNIGHT), "weekend_local_date": F.weekday("event_date_local") >= 5,
        "late_arrival": late,
    }


def link_reversals(events: DataFrame) -> DataFrame:
    """``events`` with ``reversal_of``: the latest earlier ordinary event of the pair the other way round.

    An as-of lookup: both kinds lie in one list per ordered pair, so a busy pair costs a
    sort and not the square of its events.
    """
    rev = F.col("txn_type").isin(*REVERSALS)
    a = F.when(rev, F.col("account_to")).otherwise(F.col("account_from"))
    b = F.when(rev, F.col("account_from")).otherwise(F.col("account_to"))
    # peers at the same instant don't count, so the frame ends just before it
    w = Window.partitionBy("a", "b").orderBy("ts_us").rangeBetween(Window.unboundedPreceding, -1)
    d = events.withColumn("a", a).withColumn("b", b)
    best = F.max(F.when(~rev, F.struct("ts_us", "txn_id"))).over(w)
    return d.withColumn("reversal_of", F.when(rev, best["txn_id"])).drop("a", "b")

