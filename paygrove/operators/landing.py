"""Landing of result tables: a part of a run replaces itself, so a repeated batch changes nothing; long rows of a backtest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a landed long table holds.
LONG = "panel string, fold int, item string, measure string, value double"


class LandingError(ValueError):
    """A run or part whose name cannot be a folder of its own."""


def _path(root: str, table: str, run_id: str, part: str) -> str:
    for name in (table, run_id, part):
        if not name or not all(c.isalnum() or c in "-_." for c in name) or name.startswith(("_", ".")):
            raise LandingError(f"{name!r} can't name a table, run or part")
    return f"{root}/{table}/run_id={run_id}/part={part}"


def land(df: DataFrame, root: str, table: str, run_id: str, part: str = "all") -> None:
    """Replace one part of one run of ``table`` with ``df``; other parts and runs aren't touched.

    The part is overwritten as a whole, so fewer rows, or none, replace more. Its
    ``_SUCCESS`` file is the commit record: a writer that dies leaves a part that
    ``landed`` doesn't read, until the same call is repeated.
    """
    df.write.mode("overwrite").option("compression", "zstd").parquet(_path(root, table, run_id, part))


def sink(root: str, table: str, run_id: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch is a part of its own, so one that comes again after a failure lands once."""
    return lambda df, batch: land(df, root, table, run_id, f"batch-{batch:09d}")


def landed(spark: SparkSession, root: str, table: str, run_id: str | None = None) -> DataFrame:
    """Rows of the committed parts of one run, or of all runs, with ``run_id`` and ``part``.

    Only the names of parts come to the driver, one per landed batch.
    """
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}/run_id={run_id or '*'}/part=*/_SUCCESS")
    found = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(fs_path)
    parts = sorted(str(f.getPath().getParent()) for f in found or [])
    if not parts:
        raise LandingError(f"nothing of {table} has landed{f' in run {run_id}' if run_id else ''}")
    # names are names, not numbers or dates
    schema = spark.read.parquet(parts[0]).schema.add("run_id", "string").add("part", "string")
    return spark.read.schema(schema).option("basePath", f"{root}/{table}").parquet(*parts)


def long_rows(df: DataFrame, panel: str, measures: list[str], item: Column | None = None, fold: Column | None = None) -> DataFrame:
    """(panel, fold, item, measure, value): a row for each measure of each row of ``df``; a null measure is a row too."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    none = F.lit(None)
    return df.select(
        F.lit(panel).alias("panel"), (none if fold is None else fold).cast("int").alias("fold"), (none if item is None else item).cast("string").alias("item"), F.inline(each))


def backtest(folds: DataFrame, ledgers: DataFrame, policies: DataFrame, ablation: DataFrame, fairness: DataFrame) -> dict[str, DataFrame]:
    """The tables that a backtest lands, by name: metrics and their spread over folds, ledgers, policies, ablation, fairness."""
    metrics = ["n", "positives", "base_rate", "average_precision", "auroc", "brier", "ks"]
    per = long_rows(folds, "fold", metrics, fold=F.col("fold"))
    spread = per.groupBy("measure").agg(F.count("value").alias("folds"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"))
    return {
        "fold_metrics": per, "summary": long_rows(spread, "summary", ["folds", "mean", "std", "least", "most"], F.col("measure")),
        "ledgers": long_rows(ledgers, "ledger", ["reviewed", "minutes", "captured_minor", "review_cost_minor", "friction_minor", "net_minor"], F.col("policy"), F.col("fold")),
        "policies": long_rows(policies, "policy", ["folds", "total_minor", "max_drawdown_minor", "worst_minor", "minutes", "per_hour_minor"], F.col("policy")),
        "ablation": long_rows(ablation, "ablation", ["n", "positives", "average_precision", "auroc"], F.col("configuration")),
        "fairness": long_rows(fairness, "fairness", ["negatives", "false_positive_rate"], F.col("bucket")),
    }
