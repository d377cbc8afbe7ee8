"""Operator 1, exact dedup: skew-safe combining by digest with full content compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paygrove.llm.skew import meet
from paygrove.session import scratch_table

#: ASCII white space, as a Java and RE2 pattern.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text) -> F.Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per row of ``docs``: (id, keep_id, group_size, kept, text_sha256).

    1. Locally: the partial aggregate of each partition leaves one row per equal text.
    2. Salted: those rows meet by (digest, salt), where the salt is the partition they
       came from, so a group with a third of all rows spreads over ``salts`` tasks.
    3. Globally: at most ``salts`` winners per text meet by digest.
    The whole normalised text is a grouping key at each stage, so equality is by content;
    a digest shared by two texts raises an error instead of merging them. Only then do
    the narrow (id, digest) rows look up their winner: those of the few large groups by a
    broadcast, the others by digest. Copies are never gathered.

    Null text equals empty text. Null ids sort last: they are kept only in a group with
    no other id. Rows that repeat both id and text count in group_size; one of them has
    kept = true. Other columns are ignored, whatever their names. An empty table gives
    an empty result.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("i"), text.alias("t"), F.sha2(text, 256).alias("g"), F.xxhash64(text).alias("x")
    )
    local = rows.withColumn("salt", F.spark_partition_id() % F.lit(salts))
    salted = local.groupBy("g", "x", "salt", "t").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("g", "x", "t").agg(F.min("i").alias("i"), F.sum("n").alias("n")).drop("t")
    winners = merged.groupBy("g", "x").agg(
        F.min("i").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("texts")
    )
    winners = scratch_table(winners.select(
        "g", "x", "keep_id",
        F.when(F.col("texts") == 1, F.col("group_size"))
        .otherwise(F.raise_error(F.lit("two texts share a digest")).cast("long")).alias("group_size"),
    ), "winners")
    out = meet(rows.select("i", "g", "x"), winners, ["g", "x"], "group_size", ["i"])
    # one row of those that repeat the id too; the key holds the id, so a large group is dealt over many tasks
    first = F.row_number().over(Window.partitionBy("k", "i", "g").orderBy(F.lit(1))) == 1
    return out.withColumn("k", F.xxhash64("g", "x", "i")).select(
        F.col("i").alias(id_col), "keep_id", "group_size",
        (F.col("i").eqNullSafe(F.col("keep_id")) & first).alias("kept"), F.col("g").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Rows that repeat id and text come once: the least of them by all columns in turn
    (maps, which have no order, left out), so a rerun keeps the same one.
    """
    key = lambda i, g: F.sha2(F.concat_ws("|", g, i.cast("string")), 256)
    kept = exact_groups(docs, id_col, text_col, salts).filter("kept")
    kept = kept.select(key(F.col(id_col), F.col("text_sha256")).alias("k"))
    rows = docs.select(
        key(docs[id_col], F.sha2(normalised(docs[text_col]), 256)).alias("k"), F.struct(*[docs[c] for c in docs.columns]).alias("row"),
    )
    maps = any("map<" in kind for _, kind in docs.dtypes)
    order = [F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind] if maps else ["row"]
    # the join's own partitioning serves the window, so texts are shuffled once
    nth = F.row_number().over(Window.partitionBy("k").orderBy(*order))
    return rows.join(kept, "k", "left_semi").withColumn("nth", nth).filter("nth = 1").select("row.*")
