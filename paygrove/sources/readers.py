"""Readers of raw logs, canonical files, annotation files and watchlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paygrove.operators import canonical

_INTS = {"step", "isFraud", "isFlaggedFraud"}
SCHEMA_A = T.StructType([T.StructField(c, T.IntegerType() if c in _INTS else T.StringType()) for c in canonical.RAW_A])
SCHEMA_B = T.StructType([T.StructField(c, T.StringType()) for c in canonical.RAW_B])
SCHEMA_WATCH = T.StructType([T.StructField(c, T.StringType()) for c in ("reference", "name", "alt_names", "country", "dob", "remarks")])


def source_a(spark: SparkSession, path: str) -> DataFrame:
    """The mobile-money log: named columns, amounts as text."""
    return spark.read.schema(SCHEMA_A).option("header", True).csv(path)


def source_b(spark: SparkSession, path: str) -> DataFrame:
    """The bank log by position (its header repeats a name), all text, with ordinals in file order.

    Rows are numbered within each file split first; the splits' counts, a row per split,
    give the offsets, so no row moves and nothing is sorted.
    """
    d = spark.read.schema(SCHEMA_B).option("header", True).option("enforceSchema", True).csv(path)
    d = d.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    counts = d.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.col("__id") - F.shiftleft("__part", 33)
    return d.join(F.broadcast(before), "__part").withColumn("ordinal", F.col("before") + within).drop("__id", "__part", "before")


def source_canonical(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, bad lines) of a CSV that is canonical already; a line that doesn't parse is kept as text."""
    schema = T.StructType([*canonical.CANONICAL.fields, T.StructField("_bad", T.StringType())])
    d = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    # a required field that is missing marks a line as bad too
    need = [f.name for f in canonical.CANONICAL if not f.nullable]
    whole = F.col("_bad").isNull() & ~F.greatest(*[F.col(c).isNull() for c in need])
    ok = d.filter(whole).drop("_bad")
    return ok, d.filter(~whole).select(F.coalesce("_bad", F.to_json(F.struct(*[c for c in d.columns if c != "_bad"]))).alias("line"))


def landed(spark: SparkSession, root: str) -> DataFrame:
    """Canonical batches under a run's folder, partitioned by source_dataset and batch_id."""
    return spark.read.parquet(root)


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    """One row per name and alternative name."""
    d = spark.read.schema(SCHEMA_WATCH).option("header", True).csv(path)
    names = F.concat(F.array("name"), F.filter(F.split(F.coalesce("alt_names", F.lit("")), r"\s*;\s*"), lambda x: x != ""))
    return d.select("reference", F.explode(names).alias("name"), "country", "dob", "remarks")


def annotation_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of a text file in order."""
    return spark.read.text(path, wholetext=False).select(F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
