"""Account keys, transaction ids and digests from built-in hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hmac_sha256(secret: bytes, text: Column) -> Column:
    """HMAC-SHA256 in hex: sha2 over the padded key and the message, twice. The key stays a literal."""
    k = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ p for b in k)) for p in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))
    return F.sha2(F.concat(outer, first), 256)


def account_key(secret: bytes, name: Column) -> Column:
    """The first 12 hex digits of the salted digest."""
    return F.substring(hmac_sha256(secret, name), 1, 12)


def node_key(dataset: Column, key: Column) -> Column:
    return F.concat_ws("#", dataset, key)


def row_digest(*cols: Column) -> Column:
    """sha256 of the columns as text, nulls marked."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols]), 256)


def digest_offset(digest: Column, modulus: int, at: int = 1) -> Column:
    """A number below ``modulus`` from eight hex digits of a digest."""
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("long") % F.lit(modulus)


def ordinal_id(dataset: str, ordinal: Column, digest: Column) -> Column:
    return F.concat(F.lit(dataset + ":"), F.lpad(ordinal.cast("string"), 9, "0"), F.lit("-"), F.substring(digest, 1, 8))


def content_hash(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, content_hash): rows and an order-free digest of a table, per key.

    Row digests are added up as decimals, so order and partitioning don't matter and
    repeated rows do.
    """
    cols = sorted(c for c in df.columns if c not in (keys or []))
    d = F.conv(F.substring(row_digest(*[F.col(c) for c in cols]), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n"), F.lpad(F.hex(F.pmod(F.sum(d), F.lit(2**60).cast("decimal(38,0)")).cast("long")), 15, "0").alias("content_hash"))
