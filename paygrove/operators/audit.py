"""Hash-linked audit log as data: verification and erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
FIELDS = ("seq", "occurred_us", "actor_id", "subject", "action", "payload", "prev_hash")


def row_hash(get=F.col) -> Column:
    """Digest of a row as canonical JSON: fixed fields in fixed order, nulls kept."""
    parts = [F.concat(F.lit(f'"{c}":'), F.coalesce(F.concat(F.lit('"'), F.regexp_replace(get(c).cast("string"), r'([\\"])', r"\\$1"), F.lit('"')), F.lit("null"))) for c in FIELDS]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def verify(log: DataFrame, chain: str = "chain_id") -> DataFrame:
    """(chain, rows, broken, first_broken, reason): each link against its own digest and its neighbour.

    One window per chain and one aggregate; a row's predecessor is all it needs.
    """
    w = Window.partitionBy(chain).orderBy("seq")
    d = log.withColumns({"before_seq": F.lag("seq").over(w), "before_hash": F.lag("row_hash").over(w)})
    bad = (
        F.when(row_hash() != F.col("row_hash"), "digest").when(F.col("before_seq").isNotNull() & (F.col("seq") != F.col("before_seq") + 1), "gap")
        .when(F.col("prev_hash") != F.coalesce("before_hash", F.lit(GENESIS)), "predecessor"))
    d = d.withColumn("bad", bad)
    return d.groupBy(chain).agg(
        F.count(F.lit(1)).alias("rows"), F.count("bad").alias("broken"), F.min(F.when(F.col("bad").isNotNull(), F.col("seq"))).alias("first_broken"),
        F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("seq"))).alias("reason"))


def erase(mapping: DataFrame, subjects: DataFrame) -> DataFrame:
    """The pseudonym mapping without the erased subjects; the log itself stays, and stays valid."""
    return mapping.join(subjects.select("subject").distinct(), "subject", "left_anti")
