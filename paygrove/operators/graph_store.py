"""A graph that stays: its tables in buckets, under a manifest that says what they hold."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paygrove.functions import keys
from paygrove.operators import graph, paths

#: Fixed by the format: each table with the column that its buckets are of.
TABLES = {"legs": "account", "nodes": "account", "pairs": "account_from", "flows": "account", "cycles": None}
MANIFEST, VERSION = "manifest", 1
_LISTED = "version int, name string, rows bigint, content_hash string, columns string, buckets int"


class GraphStoreError(ValueError):
    """The tables under a root aren't what its manifest says."""


@dataclass(frozen=True)
class Graph:
    legs: DataFrame
    nodes: DataFrame
    pairs: DataFrame
    flows: DataFrame
    cycles: DataFrame


def build(events: DataFrame, **cycle) -> Graph:
    """All tables of the account graph; ``cycle`` goes to ``paths.cycles``."""
    c = paths.cycles(paths.adjacency(events), **cycle).select("nodes", "txns", "length", "retention", "truncated")
    return Graph(graph.legs(events), graph.typed(graph.nodes(events)), graph.pairs(events), graph.flows(events), c)


def save(g: Graph, root: str, buckets: int | None = None) -> DataFrame:
    """Write the tables and then the manifest, which is returned: rows, columns and content of each, as read back.

    A table in buckets of the account needs no shuffle to be grouped by it, or to meet
    another of these tables. Until the manifest is there nothing can be loaded, and
    writing again gives the same one.
    """
    spark = g.legs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = []
    for name, by in TABLES.items():
        df, path = getattr(g, name), f"{root}/{name}"
        w = df.write.mode("overwrite").format("parquet").option("compression", "zstd")
        if by is None:
            w.save(path)
        else:
            table = f"paygrove_{name}_{uuid.uuid4().hex[:12]}"
            w.option("path", path).bucketBy(n, by).sortBy(by).saveAsTable(table)
            spark.sql(f"DROP TABLE {table}")  # its files lie outside the warehouse and stay
        r = keys.content_hash(_strings(spark.read.parquet(path))).first()
        listed.append((VERSION, name, r.n if r else 0, r.content_hash if r else None, ",".join(df.columns), n if by else None))
    m = spark.createDataFrame(listed, _LISTED)
    m.coalesce(1).write.mode("overwrite").json(f"{root}/{MANIFEST}")
    return m


def _strings(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))})


def load(spark: SparkSession, root: str, verify: bool = True) -> Graph:
    """The saved graph, refused where a table is missing or, with ``verify``, has other rows than its manifest says."""
    try:
        listed = {r.name: r for r in spark.read.schema(_LISTED).json(f"{root}/{MANIFEST}").collect()}  # a row per table
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise GraphStoreError(f"{root} has no manifest") from e
        raise
    if set(listed) != set(TABLES) or {r.version for r in listed.values()} != {VERSION}:
        raise GraphStoreError(f"{root} lists {sorted(listed)} in another format")
    out = {}
    for name, by in TABLES.items():
        r = listed[name]
        try:
            plain = spark.read.parquet(f"{root}/{name}")
        except Exception as e:
            if r.rows or "PATH_NOT_FOUND" in str(e):
                raise GraphStoreError(f"{name} is missing") from e
            raise
        if ",".join(plain.columns) != r.columns:
            raise GraphStoreError(f"{name} has other columns")
        if verify:
            h = keys.content_hash(_strings(plain)).first()
            if (h.n if h else 0, h.content_hash if h else None) != (r.rows, r.content_hash):
                raise GraphStoreError(f"{name} has other rows than its manifest says")
        out[name] = plain if by is None else _bucketed(spark, plain, f"{root}/{name}", by, r.buckets)
    return Graph(**out)


def _bucketed(spark: SparkSession, plain: DataFrame, path: str, by: str, n: int) -> DataFrame:
    """The table again, with what Spark must know of its buckets."""
    table = f"paygrove_{uuid.uuid4().hex[:12]}"
    ddl = ", ".join(f"`{c}` {t}" for c, t in plain.dtypes)
    spark.sql(f"CREATE TABLE {table} ({ddl}) USING parquet CLUSTERED BY (`{by}`) SORTED BY (`{by}`) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(table)
