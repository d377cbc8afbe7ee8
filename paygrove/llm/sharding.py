"""Operator 4, sharding by extendible hashing. Native."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paygrove.session import checkpoint

#: Bits of the hash, and bits that one round of splitting looks at.
BITS, STEP = 60, 12


def key_hash(key) -> F.Column:
    """The first 60 bits of the key's MD5, as a long; a null key hashes as an empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, doc_bytes, shard_id, depth, shard_bytes, shard_docs, oversized.

    The directory starts with one bucket. A bucket of more than ``limit`` bytes and more
    than one document splits on the next bit of the hash, and only such a bucket does,
    until none is left. Sums of the finest prefixes that a round looks at decide for all
    their ancestors at once, so a round of ``STEP`` bits costs one aggregate over the
    narrow (hash, bytes) rows of the buckets still too large. ``shard_id`` is the prefix
    as bits ("root" for the whole table).

    A document over the limit is a shard of its own, ``oversized``. Rows that share a key
    share a hash: where all 60 bits don't part them they are dealt in turn to as many
    numbered parts ("prefix.part") as their largest document allows; a part may then still
    be of one row only. Null text has 0 bytes. An empty table gives an empty result.
    """
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    rows = checkpoint(docs.select(F.col(id_col).alias("i"), key_hash(F.col(id_col)).alias("h"), size.alias("b")))
    total = rows.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    first = max(1, min(22, math.ceil(math.log2(max(total.b, 1) / limit)) + 2 if total.b > limit else 1))
    done, todo, base = [], rows.withColumn("at", F.lit(0).cast("int")), 0
    while True:
        bits = min(BITS, base + (first if base == 0 else STEP))
        fine = todo.groupBy(F.shiftright("h", BITS - bits).alias("f")).agg(
            F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"), F.max("b").alias("top")
        )
        nodes = fine.withColumn("d", F.explode(F.sequence(F.lit(base), F.lit(bits)))).groupBy(
            "d", F.expr(f"shiftright(f, {bits} - d)").alias("p")
        ).agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.max("top").alias("top"))
        nodes = checkpoint(nodes.withColumn("split", (F.col("b") > limit) & (F.col("n") > 1)))
        parents = nodes.filter("split").select((F.col("d") + 1).alias("pd"), F.col("p").alias("pp"))
        child = nodes.filter(~F.col("split") | (F.col("d") == bits))
        born = child.filter(F.col("d") > base).join(
            parents, (F.col("d") == F.col("pd")) & (F.shiftright("p", 1) == F.col("pp")), "left_semi"
        ).union(child.filter(F.col("d") == base))
        # the directory: each entry of the finest level points to its bucket
        ends = born.withColumn("e", F.expr(f"explode(sequence(shiftleft(p, {bits} - d), shiftleft(p + 1, {bits} - d) - 1))"))
        ends = ends.select("e", "d", "p", F.col("b").alias("shard_bytes"), F.col("n").alias("shard_docs"), "top", "split")
        placed = todo.join(ends, F.shiftright("h", BITS - bits) == F.col("e")).drop("e")
        done.append(placed.filter("not split"))
        if not nodes.filter(F.col("split") & (F.col("d") == bits)).limit(1).count():
            break
        if bits == BITS:
            done.append(_dealt(placed.filter("split"), limit))
            break
        todo, base = placed.filter("split").select("i", "h", "b", "at"), bits
    out = done[0].withColumn("part", F.lit(None).cast("long"))
    for x in done[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    name = F.when(F.col("d") == 0, F.lit("root")).otherwise(F.lpad(F.conv(F.col("p").cast("string"), 10, 2), F.col("d"), F.lit("0")))
    return out.select(
        F.col("i").alias(id_col), F.col("b").alias("doc_bytes"),
        F.when(F.col("part").isNull(), name).otherwise(F.concat_ws(".", name, "part")).alias("shard_id"),
        F.col("d").alias("depth"), "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversized"),
    )


def _dealt(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of equal hash, in numbered parts of at most limit / (their largest row) rows."""
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("top", F.lit(1))))
    w = Window.partitionBy("h").orderBy("b")
    x = rows.withColumn("part", F.floor((F.row_number().over(w) - 1) / per).cast("long"))
    sums = x.groupBy("h", "part").agg(F.sum("b").alias("sb"), F.count(F.lit(1)).alias("sn"))
    x = x.join(sums, ["h", "part"])
    return x.withColumn("shard_bytes", F.col("sb")).withColumn("shard_docs", F.col("sn")).drop("sb", "sn")
