"""Session factory, reliable checkpoints and scratch tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The state store that stateful processors need, with lists and timers per key.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def get_spark(app: str = "paygrove", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on: UTC, ANSI and AQE."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        STATE_STORE[0]: STATE_STORE[1],
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in ``STATE_STORE``, whatever session the caller made.

    A stream takes the session's settings when it starts, so they are put back after that.
    """
    key, wanted = STATE_STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, wanted)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in a local session may the setting be absent: then a temporary folder is used.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    d = tempfile.mkdtemp(prefix="paygrove-ckpt-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint (survives the loss of any executor)."""
    sc = df.sparkSession.sparkContext
    d = shared_dir(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return df.checkpoint(eager=True)


def scratch_table(df: DataFrame, name: str = "t", rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder, at most ``rows_per_file`` rows a file if given, and read it back.

    Unlike ``checkpoint`` the files are compressed and columnar, so later readers prune
    columns. They live in a folder named after the application, which
    ``clear_scratch`` removes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paygrove-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed_table(df: DataFrame, key: str, name: str = "t") -> DataFrame:
    """Write ``df`` under the shared folder in buckets of ``key``, and read it back.

    There are as many buckets as shuffle partitions, so a later join or grouping by
    ``key`` shuffles only the other side.
    """
    spark = df.sparkSession
    table = f"paygrove_{name}_{uuid.uuid4().hex[:12]}".replace("-", "_")
    path = f"{shared_dir(spark)}/paygrove-{spark.sparkContext.applicationId}/{table}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).format("parquet").option("path", path).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's scratch tables."""
    jvm, path = spark.sparkContext._jvm, f"{shared_dir(spark)}/paygrove-{spark.sparkContext.applicationId}"
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
