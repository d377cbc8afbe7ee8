"""Ingest runs: declared sources are refused or landed, and a manifest says what a reader may take.

The manifest is the commit record. Batches land first, each in a partition of its own
that a repeated run overwrites with the same rows; then the run's manifest is written.
Until then no reader sees the batches, so a run that dies half way leaves nothing to
clean up, and running it again changes nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paygrove.functions import keys
from paygrove.operators import canonical
from paygrove.sources import readers

EVENTS, BAD, MANIFESTS = "events", "quarantine", "manifests"
#: Which run landed a row, and when, isn't its content.
LINEAGE = ("run_id", "ingested_at")
MANIFEST = "run_id string, source_id string, batch_id string, path string, status string, reason string, rows bigint, quarantined bigint, content_hash string"


class ManifestError(ValueError):
    """What lies under a root isn't what its manifests say."""


@dataclass(frozen=True)
class Declared:
    """One source of a run: its kind (``source_a``, ``source_b`` or ``canonical``) and its files, relative to the root.

    ``sha256`` per file is part of the declaration, not checked against bytes here: the
    batch's own content hash is. ``refusal`` says why a source isn't to be read.
    """

    source_id: str
    kind: str
    files: tuple[tuple[str, str], ...]
    refusal: str | None = None


def batch_id(d: Declared, file: tuple[str, str]) -> str:
    """Named by what is declared, so the same declaration lands in the same place."""
    return hashlib.sha256(f"{d.source_id}|{file[0]}:{file[1]}".encode()).hexdigest()[:12]


def _read(spark: SparkSession, d: Declared, path: str, batch: str, secret: bytes, epoch_us: int) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of one file."""
    if d.kind == "source_a":
        raw = readers.source_a(spark, path).withColumn("row_index", F.monotonically_increasing_id())
        return canonical.canonical_a(raw, batch, secret, epoch_us, d.source_id)
    if d.kind == "source_b":
        return canonical.canonical_b(readers.source_b(spark, path), batch, secret, dataset=d.source_id)
    if d.kind == "canonical":
        events, lines = readers.source_canonical(spark, path)
        bad = lines.select(
            F.lit(batch).alias("batch_id"), F.lit(d.source_id).alias("source_dataset"), F.monotonically_increasing_id().alias("row_index"), F.lit("unreadable").alias("reason"),
            F.lit(None).cast("string").alias("detail"), F.col("line").alias("payload_json"))
        return events.withColumns({"source_dataset": F.lit(d.source_id), "batch_id": F.lit(batch)}), bad
    raise ManifestError(f"{d.source_id} has no reader for {d.kind}")


def _overwrite(df: DataFrame, root: str) -> None:
    """Replace the partitions that ``df`` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("source_dataset", "batch_id").parquet(root)


def ingest(spark: SparkSession, root: str, out: str, declared: list[Declared], secret: bytes, epoch_us: int, run_id: str, ingested_us: int = 0) -> DataFrame:
    """The run's manifest, written under ``out`` after its batches: a row per declared file, landed, refused or failed.

    A refused source is listed with its reason and not read. A file that can't be read
    fails alone; the others land. Paths are relative, so ``out`` may be moved as a whole.
    Repeating a run gives the same tables and the same manifest. The loop is over
    declared files; rows are read, written and hashed in Spark.
    """
    listed = []
    for d in declared:
        for f in d.files:
            batch = batch_id(d, f)
            path = f"source_dataset={d.source_id}/batch_id={batch}"
            row = (run_id, d.source_id, batch, path)
            if d.refusal:
                listed.append((*row, "refused", d.refusal, None, None, None))
                continue
            try:
                events, bad = _read(spark, d, f"{root}/{f[0]}", batch, secret, epoch_us)
                if "run_id" not in events.columns:
                    events = canonical.landed(events, run_id, ingested_us)
                events = canonical.check_schema(events.select([x.name for x in canonical.CANONICAL]))
                _overwrite(events.repartitionByRange("event_ts_utc", "txn_id").sortWithinPartitions("event_ts_utc", "txn_id"), f"{out}/{EVENTS}")
                _overwrite(bad, f"{out}/{BAD}")
            except Exception as e:  # this file's own line says so
                listed.append((*row, "failed", f"{type(e).__name__}: {str(e).splitlines()[0][:200]}", None, None, None))
                continue
            n, h = _state(spark, f"{out}/{EVENTS}", d.source_id, batch)
            listed.append((*row, "landed", None, n, _state(spark, f"{out}/{BAD}", d.source_id, batch)[0], h))
    m = spark.createDataFrame(listed, MANIFEST)
    m.coalesce(1).write.mode("overwrite").json(f"{out}/{MANIFESTS}/{run_id}")
    return m


def _state(spark: SparkSession, path: str, source: str, batch: str) -> tuple[int, str | None]:
    """Rows and content hash of one landed batch, as read back."""
    try:
        d = spark.read.parquet(f"{path}/source_dataset={source}/batch_id={batch}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return 0, None  # a batch without rows leaves no folder
        raise
    r = keys.content_hash(d.drop(*LINEAGE)).first()
    return (r.n, r.content_hash) if r else (0, None)


def manifest(spark: SparkSession, out: str, run_id: str | None = None) -> DataFrame:
    """The rows of one run's manifest, or of all."""
    return spark.read.schema(MANIFEST).json(f"{out}/{MANIFESTS}/{run_id or '*'}")


def landed(spark: SparkSession, out: str, run_id: str | None = None, verify: bool = False) -> DataFrame:
    """Events of the batches that a manifest lists as landed, and of no others.

    A listed batch that is missing or has another number of rows is an error; with
    ``verify`` the content is hashed and compared too. Folders that no manifest lists are
    not read. The check is one count per batch, from file footers; the list is a row per
    batch and its comparison a join.
    """
    m = manifest(spark, out, run_id).filter("status = 'landed' and rows > 0").select("source_id", "batch_id", "rows", "content_hash").distinct()
    try:
        d = spark.read.option("basePath", f"{out}/{EVENTS}").schema(_contract()).parquet(f"{out}/{EVENTS}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        d = spark.createDataFrame([], _contract())
    own = keys.content_hash(d.drop(*LINEAGE), ["source_dataset", "batch_id"]) if verify else d.groupBy("source_dataset", "batch_id").agg(F.count(F.lit(1)).alias("n"))
    there = own.withColumnsRenamed({"source_dataset": "s", "batch_id": "b"} | ({"content_hash": "h"} if verify else {}))
    x = m.join(there, (F.col("source_id") == F.col("s")) & (F.col("batch_id") == F.col("b")), "left")
    why = F.when(F.col("n").isNull(), "is missing").when(F.col("n") != F.col("rows"), "has another number of rows")
    if verify:
        why = why.when(F.col("h") != F.col("content_hash"), "has other content")
    wrong = x.withColumn("why", why).filter("why is not null").limit(1).collect()
    if wrong:
        raise ManifestError(f"batch {wrong[0].source_id}/{wrong[0].batch_id} {wrong[0].why}")
    listed = m.select(F.col("source_id").alias("__s"), F.col("batch_id").alias("__b")).distinct()
    return d.join(listed, (F.col("source_dataset") == F.col("__s")) & (F.col("batch_id") == F.col("__b")), "left_semi")


def _contract():
    """The canonical columns, those that name a partition last."""
    from pyspark.sql import types as T

    parts = ("source_dataset", "batch_id")
    fields = list(canonical.CANONICAL.fields)
    return T.StructType([f for f in fields if f.name not in parts] + [f for f in fields if f.name in parts])
