"""Operator 7, SimHash near-dedup with covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paygrove.llm.skew import meet
from paygrove.operators.components import connected_components
from paygrove.session import checkpoint

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Up to so many fingerprints, a bucket is compared inside one task; larger ones go the exact way of ``_ball_edges``.
BUCKET = 2048


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the text's word shingles, as a signed long; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= SHINGLE:
        return int(np.uint64(xxhash.xxh64_intdigest(flat, SEED)).astype(np.int64))
    begins = list(accumulate((len(w) + 1 for w in words), initial=0))
    h = xxhash.xxh64_intdigest
    count = np.zeros(64, np.int64)
    n = len(words) - SHINGLE + 1
    for at in range(0, n, 1 << 15):
        stop = min(n, at + (1 << 15))
        hashes = np.array([h(flat[a : b - 1], SEED) for a, b in zip(begins[at:stop], begins[at + SHINGLE : stop + SHINGLE], strict=True)], "<u8")
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<i8")[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = pa.array([fingerprint(t) for t in b.column("t").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("i"), f], ["i", "f"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, f): id and fingerprint of each row, without a shuffle."""
    narrow = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return narrow.mapInArrow(_prints, f"i {dict(narrow.dtypes)['i']}, f bigint")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2 ** (radius + 1) - 1 masks, of which any ``radius`` positions miss at least one.

    Position i gets a non-zero vector m(i) of radius + 1 bits; mask v keeps the positions
    with an odd number of bits in m(i) & v. The vectors of up to ``radius`` positions
    span fewer than radius + 1 dimensions, so some v is orthogonal to all of them and its
    mask has none of these positions. Two fingerprints that differ there agree under it.
    """
    tables = 2 ** (radius + 1) - 1
    m = [i % tables + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (m[i] & v).bit_count() % 2) for v in range(1, tables + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _linked(f: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct fingerprints the smallest (unsigned) that links reach within ``f``."""
    x = f.view(np.uint64)
    out, left = x.copy(), np.arange(len(x))
    while len(left):
        group, front, left = [left[0]], [left[0]], left[1:]
        while front and len(left):
            near = np.bitwise_count(x[left] ^ x[front.pop()]) <= radius
            found = left[near]
            group.extend(found)
            front.extend(found)
            left = left[~near]
        out[group] = x[group].min()
    return out.view(np.int64)


def _bucket_edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("fs")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            src, dst = [], []
            for a, z in zip(offsets[:-1], offsets[1:], strict=True):
                f = values[a:z]
                to = _linked(f, radius)
                moved = to != f
                src.append(f[moved])
                dst.append(to[moved])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src or [values[:0]])), pa.array(np.concatenate(dst or [values[:0]]))], ["src", "dst"])

    return run


def _ball(radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(64), k)], np.uint64)


def _centres(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = _ball(radius)
        for b in batches:
            f = b.column("f").to_numpy().view(np.uint64)
            for at in range(0, len(f), 64):
                part = f[at : at + 64]
                z = (part[:, None] ^ ball[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(np.repeat(part.view(np.int64), len(ball)))], ["z", "f"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between neighbours of equal z in a sorted stream."""
    last_z = last_f = None
    for b in batches:
        z, f = b.column("z").to_numpy(), b.column("f").to_numpy()
        if not len(z):
            continue
        if last_z is not None:
            z, f = np.concatenate([[last_z], z]), np.concatenate([[last_f], f])
        last_z, last_f = z[-1], f[-1]
        same = (z[1:] == z[:-1]) & (f[1:] != f[:-1])
        e = np.unique(np.stack([f[1:][same], f[:-1][same]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["src", "dst"])


def _ball_edges(hot: DataFrame, radius: int) -> DataFrame:
    """Edges with the same components as all links among ``hot`` fingerprints, in linear work.

    Two fingerprints are within 2k bits exactly when some third one is within k of both.
    Each names all centres within k = radius / 2 of it; those that share a centre are
    linked, and a chain along each centre's sorted list connects them.
    """
    keys = hot.mapInArrow(_centres(radius // 2), "z bigint, f bigint")
    return keys.repartition("z").sortWithinPartitions("z", "f").mapInArrow(_runs, "src bigint, dst bigint")


def fingerprint_components(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(f, component): for each distinct non-null ``f`` that has links, the smallest of its component.

    Tables of masked fingerprints hold every linked pair together at least once. Buckets
    of one are dropped by count. Buckets up to ``bucket`` are compared in place and give
    at most one edge per fingerprint, never their pairs. All fingerprints of larger ones
    are linked among themselves by ``_ball_edges``; ``radius`` must be even for that.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    f = checkpoint(prints.select("f").distinct()).repartition("f")  # few bytes, but much work follows: no coalescing
    keys = F.array(*[F.xxhash64(F.lit(v), F.col("f").bitwiseAND(F.lit(_signed(m)))) for v, m in enumerate(covering_masks(radius))])
    spread = f.select("f", F.explode(keys).alias("k"))
    shared = checkpoint(spread.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = spread.join(shared, "k")
    small = met.filter(F.col("n") <= bucket).groupBy("k").agg(F.sort_array(F.collect_set("f")).alias("fs")).select("fs")
    edges = small.mapInArrow(_bucket_edges(radius), "src bigint, dst bigint")
    if shared.filter(F.col("n") > bucket).limit(1).count():
        hot = met.filter(F.col("n") > bucket).select("f").distinct()
        edges = edges.union(_ball_edges(hot, radius))
    return connected_components(edges).select(F.col("node").alias("f"), "component")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most ``radius`` bits, the
    row's own fingerprint included. Null and empty texts have fingerprint zero and link
    like any other. Null ids are never the smallest unless a component has no other.
    Repeated rows give repeated rows. An empty table gives an empty result.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col))
    comps = fingerprint_components(prints, radius)
    own = prints.groupBy("f").agg(F.min("i").alias("low"), F.count(F.lit(1)).alias("n"))
    label = checkpoint(own.join(comps, "f", "left").select("f", "low", "n", F.coalesce("component", "f").alias("c")))
    low = checkpoint(label.groupBy("c").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("prints")))
    # one fingerprint may have a third of the rows, and one component a third of the fingerprints
    named = checkpoint(meet(label, low, ["c"], "prints", ["f"]).select("f", "n", "component_id"))
    found = meet(prints, named, ["f"], "n", ["i"])
    return found.select(F.col("i").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, with their own columns.

    Rows that share both id and component all stay; exact dedup is what removes them.
    """
    drop = near_components(docs, id_col, text_col, radius).filter(~F.col(id_col).eqNullSafe(F.col("component_id")))
    drop = drop.select(F.col(id_col).alias("gone")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("i"))
    return rows.join(drop, F.col("i").eqNullSafe(F.col("gone")), "left_anti").select("row.*")
