"""Sinks: canonical batches, quarantine and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_events(events: DataFrame, root: str, mode: str = "append") -> None:
    """Batches by source and batch, each file sorted by the total order (ts_us, txn_id), zstd."""
    d = events.repartitionByRange("source_dataset", "batch_id", "ts_us").sortWithinPartitions("source_dataset", "batch_id", "ts_us", "txn_id")
    d.write.mode(mode).option("compression", "zstd").partitionBy("source_dataset", "batch_id").parquet(root)


def write_quarantine(bad: DataFrame, root: str, mode: str = "append") -> None:
    bad.sortWithinPartitions("batch_id", "row_index").write.mode(mode).partitionBy("source_dataset").parquet(root)


def register_views(spark: SparkSession, root: str) -> DataFrame:
    """A view per source and one over all; counts as read back."""
    d = spark.read.parquet(root)
    d.createOrReplaceTempView("events_all")
    counts = d.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n"))
    for r in counts.collect():  # a row per declared source
        name = "".join(c if c.isalnum() else "_" for c in r.source_dataset)
        d.filter(F.col("source_dataset") == r.source_dataset).createOrReplaceTempView(f"events_{name}")
    return counts
