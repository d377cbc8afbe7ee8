"""Operator 12, n-gram Jaccard join: T-occurrence search with DivideSkip over blocks of documents."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from heapq import merge
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paygrove.llm.skew import meet
from paygrove.operators.components import connected_components
from paygrove.session import scratch_table

WORDS = 5
#: Two sets link when 100 * intersection >= LINK * union.
LINK = 80
#: The first look counts this part of the shingles, by hash.
SLICE = 4
#: Shingles of the documents that one task indexes together; families with more are cut into chunks.
BLOCK = 1 << 20
#: The weight of a binary probe against a heap step in the choice of how many lists are long.
PROBE = 0.0085
#: Documents of a large family that are searched first.
PIVOTS = 16
#: Bits of the filter that says whose sets are asked for, at most.
BITS = 1 << 28
#: Word digests that a task remembers.
MEMO = 500_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Shingler:
    """Sorted distinct 64-bit digests of a text's shingles, by a weighted sum of word digests."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.memo = words, {}
        self.odd = np.resize(_ODD, words) + np.arange(words, dtype=np.uint64) // np.uint64(len(_ODD)) * np.uint64(2)

    def _word(self, word: bytes) -> int:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        h = self.memo[word] = xxhash.xxh64_intdigest(word)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        memo, word = self.memo, self._word
        h = np.array([memo.get(w) or word(w) for w in words], np.uint64)
        n = max(1, len(h) - self.words + 1)
        total = np.full(n, len(h) if len(h) < self.words else self.words, np.uint64)
        for k in range(min(self.words, len(h))):
            total += h[k : k + n] * self.odd[k]
        total ^= total >> np.uint64(32)
        total *= np.uint64(0xD6E8FEB86659FD93)
        total ^= total >> np.uint64(29)
        return np.unique(total)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


def _slices(words: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        top = np.uint64((1 << 64) // share - 1)
        for b in batches:
            n, d1, d2, part = [], [], [], []
            for text in b.column("t"):
                s = shingles(text.as_py())
                two = np.frombuffer(hashlib.md5(s.tobytes(), usedforsecurity=False).digest(), "<i8")
                n.append(len(s))
                d1.append(two[0])
                d2.append(two[1])
                part.append(s[: np.searchsorted(s, top, "right")])
            yield pa.RecordBatch.from_arrays(
                [b.column("i"), b.column("v"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), _lists(part)], ["i", "v", "n", "d1", "d2", "part"])

    return run


def _sets(words: int, shared):
    """(i, v, ws) of the rows whose ``v`` passes the bitmap, once in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, bitmap = Shingler(words), shared.value
        for b in batches:
            v = b.column("v").to_numpy()
            at = v.view(np.uint64) % np.uint64(64 * len(bitmap))
            passed = np.flatnonzero(bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
            once = list({(int(v[k]), b.column("i")[k].as_py()): int(k) for k in passed}.values())
            part = b.take(pa.array(once, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("i"), part.column("v"), _lists([shingles(t.as_py()) for t in part.column("t")])], ["i", "v", "ws"])

    return run


def _bitmap(keys: DataFrame, count: int) -> np.ndarray:
    """Which ``v`` may be wanted: 16 bits a key, but no more than ``BITS``, so a bounded thing to broadcast.

    Over more keys it passes more rows; the join that follows decides.
    """
    bits = min(BITS, max(1 << 10, 1 << (16 * count).bit_length()))
    # a negative v counts by its unsigned value; bits is a power of two, so the low bits are the place
    at = F.col("v1").bitwiseAND(F.lit(bits - 1))
    set_ = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(v1 & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[set_.column("word").to_numpy()] = set_.column("b").to_numpy().view(np.uint64)
    return out


def _least(n, link: int):
    """The overlap that a set of ``n`` needs with any set that it links to, as a column: ceil(n * link / 100)."""
    return F.floor((F.col(n) * link + 99) / 100)


class Index:
    """Inverted lists over the shared shingles of some documents, in the order of their sizes."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, tokens: np.ndarray) -> None:
        order = np.lexsort((keys, sizes))
        lengths = np.diff(offsets)[order]
        self.keys, self.sizes = keys[order], sizes[order]
        self.start = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(offsets[:-1][order] - self.start[:-1], lengths) + np.arange(self.start[-1])
        owner = np.repeat(np.arange(len(order)), lengths)
        _, self.token = np.unique(tokens[at], return_inverse=True)
        by = np.argsort(self.token, kind="stable")  # documents ascend within each list
        self.docs = owner[by]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.token, minlength=0))]) if len(by) else np.zeros(1, int)
        self.flat = self.docs.tolist()

    def candidates(self, x: int, need: int, low: int, high: int, skip: np.ndarray) -> Iterator[tuple[int, int, list]]:
        """(document, overlap so far, long lists) of documents low <= y < high, not in ``skip``, in at least ``need`` lists, by DivideSkip.

        The longest lists are set apart. The short ones are merged in a heap; who stands
        in at least ``need`` less the number of long lists goes on to the probes.
        """
        lists = self.token[self.start[x] : self.start[x + 1]]
        if len(lists) < need or high <= low:
            return
        begin, end = self.first[lists], self.first[lists + 1]
        length = end - begin
        by = np.argsort(-length, kind="stable")
        long = int(min(need - 1, need / (PROBE * log2(max(2, int(length.max()))) + 1)))
        short = by[long:]
        spread = np.repeat(begin[short] - np.concatenate([[0], np.cumsum(length[short])[:-1]]), length[short])
        docs = self.docs[spread + np.arange(len(spread))]
        which = np.repeat(np.arange(len(short)), length[short])
        ok = (docs >= low) & (docs < high) & ~skip[docs]
        if not ok.any():
            return
        docs, which = docs[ok], which[ok]
        cuts = np.flatnonzero(np.diff(which)) + 1
        probes = [(int(begin[i]), int(end[i])) for i in by[:long]]
        for y, same in groupby(merge(*[part.tolist() for part in np.split(docs, cuts)])):
            seen = sum(1 for _ in same)
            if seen + long >= need:
                yield y, seen, probes

    def reaches(self, y: int, seen: int, probes: list, need: int) -> bool:
        """Whether ``y`` stands in ``need`` lists: binary probes of the long ones, given up once too many are missed."""
        left = len(probes)
        for a, z in probes:
            if seen >= need or seen + left < need:
                break
            at = bisect_left(self.flat, y, a, z)
            seen += at < z and self.flat[at] == y
            left -= 1
        return seen >= need

    def links(self, queries: np.ndarray | None, label: np.ndarray, link: int) -> Iterator[tuple[int, int]]:
        """Links that join documents of different labels, (key, key), each joining two labels that none before has joined.

        Without ``queries`` each document is searched among those after it; a query is
        searched among all.
        """
        label = label.copy()
        n = self.sizes
        ends = np.searchsorted(n, n * 100 // link, "right")
        begins = np.searchsorted(n, (n * link + 99) // 100, "left")
        for x in range(len(n)) if queries is None else np.flatnonzero(queries):
            nx = int(n[x])
            if queries is None:  # y is no smaller, so it shares link * 2 / (100 + link) of x at least
                low, need = x + 1, -(-2 * link * nx // (100 + link))
            else:
                low, need = int(begins[x]), -(-link * nx // 100)
            skip = label == label[x]
            for y, seen, probes in self.candidates(int(x), need, low, int(ends[x]), skip):
                if label[y] == label[x]:
                    continue  # joined meanwhile
                if self.reaches(y, seen, probes, -(-link * (nx + int(n[y])) // (100 + link))):
                    yield int(self.keys[x]), int(self.keys[y])
                    label[label == label[y]] = label[x]


def _block_links(link: int, queries: bool):
    """Links within one block; with ``queries``, of the rows marked ``q`` only."""

    def run(table: pa.Table) -> pa.Table:
        ws = table.column("ws").combine_chunks()
        keys, sizes = table.column("k").to_numpy(), table.column("n").to_numpy()
        index = Index(keys, sizes, ws.offsets.to_numpy() - ws.offsets[0].as_py(), ws.flatten().to_numpy())
        order = np.lexsort((keys, sizes))
        asked, labels = table.column("q").to_numpy(zero_copy_only=False).astype(bool)[order], np.unique(table.column("label").to_numpy(), return_inverse=True)[1][order]
        found = list(index.links(asked if queries else None, labels, link))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"src": pa.array(a, pa.int64()), "dst": pa.array(b, pa.int64())})

    return run


_EDGES = "src bigint, dst bigint"


def _families(docs: DataFrame, link: int) -> DataFrame:
    """(k, fam): classes that may link are in one family; a class that shares no rare shingle is left out.

    With shingles in the order of how many sets hold them, two sets that link share one
    of the first n - ceil(n * link / 100) + 1 of both. All sets that have a shingle among
    those first ones are tied to the smallest of them.
    """
    first = F.col("n") - _least("n", link) + 1 - (F.col("n") - F.size("ws"))  # less those that no other set has
    posts = scratch_table(docs.select("k", F.explode(F.slice("ws", F.lit(1), first.cast("int"))).alias("w")), "firsts")
    tied = scratch_table(posts.groupBy("w").agg(F.min("k").alias("m"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "tied")
    edges = meet(posts, tied, ["w"], "c", ["k"]).filter("k <> m").select("k", "m").distinct()
    return connected_components(edges, "k", "m").select(F.col("node").alias("k"), F.col("component").alias("fam"))


def _search(docs: DataFrame, link: int, block: int) -> DataFrame:
    """(src, dst): links enough to join all linked classes of ``docs`` (k, n, ws)."""
    fams = _families(docs, link)
    x = scratch_table(docs.join(fams, "k"), "family-sets")
    sizes = scratch_table(x.groupBy("fam").agg(F.sum(F.size("ws")).alias("tokens"), F.count(F.lit(1)).alias("docs")), "families")
    facts = sizes.agg(F.sum(F.when(F.col("tokens") <= block, F.col("tokens"))).alias("small"), F.max("tokens").alias("most")).first()
    bins = max(1, -(-2 * (facts.small or 0) // block))
    large = F.col("tokens") > block
    chunks = F.when(large, F.ceil(2 * F.col("tokens") / block)).otherwise(F.lit(1)).cast("int")
    # a small family is whole in one bin with others; a large one is cut into chunks
    x = meet(x, sizes, ["fam"], "docs", ["k"]).drop("docs").withColumns({
        "a": F.when(large, F.col("fam")).otherwise(F.pmod(F.xxhash64("fam"), F.lit(bins))), "large": large, "chunks": chunks, "b": F.pmod(F.xxhash64("k"), chunks).cast("int")})
    x = scratch_table(x.withColumns({"label": F.col("k"), "q": F.lit(False)}), "blocks")
    edges = scratch_table(x.groupBy("large", "a", "b").applyInArrow(_block_links(link, False), _EDGES), "links")
    if (facts.most or 0) <= block:
        return edges
    # large families: what joins chunks is still missing
    big = x.filter("large").drop("label", "q")
    for asked in (_pivots(big), None):
        labels = connected_components(edges).select(F.col("node").alias("k"), F.col("component").alias("label"))
        named = scratch_table(big.join(labels, "k", "left").withColumn("label", F.coalesce("label", "k")), "labelled")
        if asked is None:
            # a missing link has an end outside the largest group of its family
            groups = named.groupBy("fam", "label").agg(F.count(F.lit(1)).alias("c"))
            main = groups.groupBy("fam").agg(F.max(F.struct("c", "label")).alias("g"), F.sum("c").alias("docs"))
            main = scratch_table(main.select("fam", F.col("g.label").alias("main"), "docs"), "largest")
            asked = meet(named.select("fam", "k", "label"), main, ["fam"], "docs", ["k"]).filter("label <> main").select("k")
        edges = scratch_table(edges.union(_asked(named, asked, link, block)), "links")
    return edges


def _pivots(big: DataFrame) -> DataFrame:
    """(k): the first classes of each large family by hash, one for each of up to ``PIVOTS`` cells of it."""
    cell = F.pmod(F.xxhash64("k", F.lit(7)), F.lit(PIVOTS))
    return big.groupBy("fam", cell.alias("cell")).agg(F.min("k").alias("k")).select("k")


def _asked(named: DataFrame, asked: DataFrame, link: int, block: int) -> DataFrame:
    """Links of the ``asked`` classes (k) to any class of their families, in blocks of queries and chunks."""
    own = scratch_table(named.join(asked, "k", "left_semi").withColumn("q", F.lit(True)), "asked")
    docs = named.groupBy("fam").agg(F.count(F.lit(1)).alias("docs"))
    parts = own.groupBy("fam").agg(F.ceil(2 * F.sum(F.size("ws")) / block).cast("int").alias("parts"))
    parts = scratch_table(parts.join(docs, "fam"), "parts")
    columns = ["fam", "p", "b", "k", "n", "ws", "label", "q"]
    queries = meet(own, parts, ["fam"], "docs", ["k"]).withColumn("p", F.pmod(F.xxhash64("k", F.lit(3)), F.col("parts")).cast("int"))
    queries = queries.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(columns)
    others = meet(named.withColumn("q", F.lit(False)), parts, ["fam"], "docs", ["k"]).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(columns)
    return queries.union(others).groupBy("fam", "p", "b").applyInArrow(_block_links(link, True), _EDGES)


def linked_sets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, link: int = LINK, block: int = BLOCK,
) -> DataFrame:
    """(id, n_shingles, component_id), a row for each row of ``docs``.

    A document's set holds its distinct shingles of ``words`` words, as 64-bit digests;
    with fewer words, the whole sequence. component_id is the smallest id that links
    reach, the own one included; null ids are never the smallest unless there is no
    other. A null text counts as empty: no shingles, linked with nothing. Repeated rows
    give repeated rows. Other columns are not read. An empty table gives an empty result.

    1. A quarter of each set is counted. Who has too few shared shingles there to reach
       ``link`` with anyone is done; mostly these are nearly all.
    2. Documents with equal sets become one class. Shingles of the classes left are
       counted exactly, and classes with too few shared ones are done too.
    3. Families of classes that share one of their rarest shingles are searched together
       by DivideSkip, in bins or, where a family is large, in chunks and against its
       queries. Pairs never leave a task, only links that join two groups.
    """
    narrow = docs.select(F.col(id_col).alias("i"), F.xxhash64(F.col(text_col)).alias("v"), F.col(text_col).alias("t"))
    kind = dict(narrow.dtypes)["i"]
    s = narrow.mapInArrow(_slices(words, SLICE), f"i {kind}, v bigint, n bigint, d1 bigint, d2 bigint, part array<bigint>")
    s = scratch_table(s.withColumn("r", F.monotonically_increasing_id()), "slices")
    # 1. the quarter
    tokens = s.select("r", F.explode("part").alias("w"))
    counts = scratch_table(tokens.groupBy("w").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "slice-counts")
    shared = meet(tokens, counts, ["w"], "c", ["r"]).groupBy("r").agg(F.collect_list("c").alias("cs"))
    rows = s.select("r", "i", "v", "n", "d1", "d2", F.size("part").alias("there")).filter("n > 0")
    alike = scratch_table(rows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("m"), F.min("i").alias("low")), "alike")
    # a shingle is shared if more rows have it than have all of this set
    spare = F.col("n") - _least("n", link)
    rows = scratch_table(meet(rows, alike, ["d1", "d2"], "m", ["r"]), "sized")
    some = rows.join(shared, "r", "left")
    some = some.filter(F.size(F.filter(F.coalesce("cs", F.array().cast("array<bigint>")), lambda c: c > F.col("m"))) >= F.col("there") - spare)
    some = scratch_table(some.select("r", "i", "v", "n", "d1", "d2"), "left")
    # 2. classes, and all their shingles
    classes = some.groupBy("d1", "d2").agg(F.min(F.struct("i", "v")).alias("one"), F.min("i").alias("low"), F.first("n").alias("n"), F.count(F.lit(1)).alias("members"))
    classes = scratch_table(classes.withColumn("k", F.monotonically_increasing_id()), "classes")
    one = classes.select("k", F.col("one.i").alias("i1"), F.col("one.v").alias("v1"))
    asked = docs.sparkSession.sparkContext.broadcast(_bitmap(one, classes.count()))
    sets = narrow.mapInArrow(_sets(words, asked), f"i {kind}, v bigint, ws array<bigint>")
    sets = scratch_table(sets.join(one, (F.col("v") == F.col("v1")) & F.col("i").eqNullSafe(F.col("i1"))).select("k", "ws"), "sets")
    tokens = sets.select("k", F.explode("ws").alias("w"))
    df = scratch_table(tokens.groupBy("w").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shingle-counts")
    # a set: a row that stands in the table several times may have come more than once
    ordered = meet(tokens, df, ["w"], "c", ["k"]).groupBy("k").agg(F.sort_array(F.collect_set(F.struct("c", "w"))).alias("x"))
    left = ordered.join(classes.select("k", "n"), "k").select("k", "n", F.col("x.w").alias("ws")).filter(F.size("ws") >= _least("n", link))
    # 3. links
    edges = _search(scratch_table(left, "shared-sets"), link, block)
    label = connected_components(edges).select(F.col("node").alias("k"), "component")
    named = scratch_table(classes.join(label, "k", "left").select("d1", "d2", "low", "members", F.coalesce("component", "k").alias("g")), "groups")
    lows = scratch_table(named.groupBy("g").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("classes")), "lows")
    # one group may hold a third of the classes, one class a third of the rows
    ids = scratch_table(meet(named, lows, ["g"], "classes", ["d1"]).select("d1", "d2", "members", "component_id"), "ids")
    met = meet(some, ids, ["d1", "d2"], "members", ["r"]).select("i", "n", "component_id")
    # the rest link with their equals only, and rows without words with nothing
    alone = rows.select("r", "i", "n", "low").join(some.select("r"), "r", "left_anti").select("i", "n", F.col("low").alias("component_id"))
    alone = alone.union(s.filter("n = 0").select("i", "n", F.col("i").alias("component_id")))
    out = met.union(alone)
    return out.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
