"""Operator 13, hard-negative mining with an STR-packed R-tree and best-first search."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappop, heappush
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paygrove.operators.ranks import running
from paygrove.session import scratch_table

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOWEST, HIGHEST = 50, 95
EVERY = 50
#: Rows of one tile (a subtree that one task searches), rows of a leaf, children of a node, anchors searched together.
TILE, LEAF, FAN, BLOCK = 4096, 128, 4, 512
#: Bytes of bundles in one file, which a reader may take as one batch; tasks that tiles and anchors are dealt over, at least and at most.
FILE, FEW, MANY = 16 << 20, 128, 4096
_FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint, found bigint, score bigint"


def _vectors(lists: pa.ListArray) -> np.ndarray:
    """(rows, dimensions) of a list column whose lists have one length."""
    n = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


class Tree:
    """One tile of rows, sort-tile-recursively packed, with the bounding box of every node.

    Nodes are in the order of their making: the root is 0, ``kids`` holds a node's
    children, or nothing for a leaf; ``span`` its rows.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        wide = np.argsort(-np.ptp(vectors.astype(float), axis=0), kind="stable") if len(ids) and vectors.shape[1] else np.zeros(0, int)
        self.ids = ids
        self.span: list[tuple[int, int]] = []
        self.kids: list[list[int]] = []
        order: list[np.ndarray] = []
        self._pack(np.arange(len(ids)), vectors, wide, 0, order, 0)
        at = np.concatenate(order)
        self.ids, self.labels, self.vectors = ids[at], labels[at], vectors[at]
        self.low = np.stack([self.vectors[a:z].min(0) for a, z in self.span])
        self.high = np.stack([self.vectors[a:z].max(0) for a, z in self.span])
        self.size = max(1, vectors.shape[1]) * max(1, int(np.abs(self.low).max(initial=0)), int(np.abs(self.high).max(initial=0)))

    def _pack(self, rows: np.ndarray, vectors: np.ndarray, wide: np.ndarray, depth: int, order: list[np.ndarray], start: int) -> int:
        me = len(self.span)
        self.span.append((start, start + len(rows)))
        self.kids.append([])
        if len(rows) <= LEAF:
            order.append(rows[np.argsort(self.ids[rows], kind="stable")])  # of equal scores the smaller id comes first
            return me
        leaves = ceil(len(rows) / LEAF)
        if len(wide):
            rows = rows[np.argsort(vectors[rows, wide[depth % len(wide)]], kind="stable")]
        each = ceil(leaves / min(FAN, leaves)) * LEAF
        for a in range(0, len(rows), each):
            self.kids[me].append(self._pack(rows[a : a + each], vectors, wide, depth + 1, order, start + a))
        return me

    def fit(self, queries: np.ndarray):
        """Both sides as numbers whose inner products are exact: doubles below 2 ** 53, else Python's integers."""
        exact = self.size * max(1, int(np.abs(queries).max(initial=0))) < 1 << 53
        kind = float if exact else object
        return queries.astype(kind), self.vectors.astype(kind), self.low.astype(kind), self.high.astype(kind)


def _best(tree: Tree, upper: list, lower: list, scored, k: int, lo, hi, kth) -> list[tuple]:
    """The first ``k`` (-score, id) in the window [lo, hi] that reach ``kth``, from the boxes with the highest bounds on."""
    floor = max((x for x in (lo, kth) if x is not None), default=None)
    found: list[tuple] = []

    def entry(node: int):
        most = upper[node] if hi is None else min(upper[node], hi)
        inside = (hi is None or lower[node] <= hi) and (floor is None or most >= floor)
        return (-most, node) if inside else None

    queue = [e for e in [entry(0)] if e]
    while queue:
        most, node = heappop(queue)
        if floor is not None and -most < floor:
            break  # strictly below the k-th, and so are all others
        if tree.kids[node]:
            for e in map(entry, tree.kids[node]):
                if e:
                    heappush(queue, e)
            continue
        minus, ids = scored(node)
        first = 0 if hi is None else bisect_left(minus, -hi)
        new = [(minus[at], ids[at]) for at in range(first, min(first + k, len(minus))) if floor is None or -minus[at] >= floor]
        if new:
            found = sorted(found + new)[:k]
            if len(found) == k:
                worst = -found[-1][0]
                floor = worst if floor is None else max(floor, worst)
    return found


def _search(tree: Tree, ids, labels, vectors, windows: list[list[tuple]], k: int, same: bool) -> Iterator[tuple]:
    """(anchor, positive, its score, found, score) for each window (positive, its score, k-th) of each anchor.

    Inner nodes are bounded by their boxes. Where products fit doubles, a leaf's bound for
    an anchor is the best of its rows that may be found, from one product of all anchors
    and the tile; so a leaf is opened only if it can add something.
    """
    if not len(ids) or not len(tree.ids):
        return
    q, rows, low, high = tree.fit(vectors)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    uppers, lowers = up @ high.T + down @ low.T, (up @ low.T + down @ high.T).tolist()
    may = lambda n: ((tree.labels == labels[n]) == same) & ((tree.ids != ids[n]) if same else True)
    exact = q.dtype == float
    if exact:
        products = q @ rows.T
        for n in range(len(ids)):
            products[n, ~may(n)] = -np.inf
        leaves = [node for node, kids in enumerate(tree.kids) if not kids]
        uppers[:, leaves] = np.maximum.reduceat(products, [tree.span[node][0] for node in leaves], axis=1)
    uppers = uppers.tolist()
    for n in range(len(ids)):
        kept: dict[int, tuple] = {}

        def scored(node: int, n=n, kept=kept):
            """-scores and ids of the leaf's rows that may be found, best first; the first window to ask for them has them sorted."""
            if node not in kept:
                a, z = tree.span[node]
                scores = products[n, a:z] if exact else rows[a:z] @ q[n]
                at = np.flatnonzero(scores > -np.inf if exact else may(n)[a:z])
                order = at[np.argsort(-scores[at], kind="stable")]
                kept[node] = ((-scores[order]).tolist(), tree.ids[a:z][order].tolist())
            return kept[node]

        for positive, ps, kth in windows[n]:
            lo, hi = (None, None) if ps is None else (-((-LOWEST * ps) // 100), HIGHEST * ps // 100)
            if lo is not None and lo > hi:
                continue
            for minus, row in _best(tree, uppers[n], lowers[n], scored, k, lo, hi, kth):
                yield int(ids[n]), positive, ps, row, -int(minus)


def _narrow(lists: pa.ListArray) -> pa.ListArray:
    """The same whole numbers in the narrowest type that holds them all."""
    ends = pc.min_max(lists.flatten())
    lo, hi = ends["min"].as_py() or 0, ends["max"].as_py() or 0
    for kind in (pa.int8(), pa.int16(), pa.int32()):
        bits = kind.bit_width - 1
        if -(1 << bits) <= lo and hi < 1 << bits:
            return lists.cast(pa.list_(kind))
    return lists


def _bundle(parts: list[pa.RecordBatch]) -> bytes:
    t = pa.Table.from_batches(parts).combine_chunks()
    t = t.set_column(t.schema.get_field_index("q"), "q", _narrow(t["q"].combine_chunks()))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _bundles(key: str):
    """(key, rows): from a stream sorted by ``key`` the rows of each key as one binary; a task holds the rows of one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        one = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([_bundle(held)], pa.binary())], [key, "rows"])
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(key).to_numpy()
            rest = b.select([c for c in b.schema.names if c != key])
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, z in zip(edges, edges[1:], strict=False):
                if held and keys[a] != now:
                    yield one()
                    held = []
                now = int(keys[a])
                held.append(rest.slice(a, z - a))
        if held:
            yield one()

    return run


def _bundled(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """(key, rows) of ``rows`` with their ``key``, over ``parts`` tasks; no row of Spark's ever holds a list of vectors."""
    return rows.repartition(max(1, parts), key).sortWithinPartitions(key).mapInArrow(_bundles(key), f"{key} bigint, rows binary")


def _read(column: pa.BinaryArray, at: int) -> pa.Table:
    return pa.ipc.open_stream(column[at].as_buffer()).read_all().combine_chunks()


def _unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return t["id"].to_numpy(), t["label"].to_numpy(), _vectors(t["q"].combine_chunks()).astype(np.int64)


def _windows(t: pa.Table) -> list[list[tuple]]:
    return [[(w["pos"], w["ps"], w["kth"]) for w in x] for x in t["w"].to_pylist()]


def _batch(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


_NAMES = ["anchor_id", "positive_id", "positive_score", "found", "score"]


def _home(every: int, k: int):
    """The k-th best same-label score that each anchor finds in its own tile: what any other tile must reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                tree = Tree(*_unpack(_read(b.column("rows"), at)))
                mine = np.flatnonzero(tree.ids % every == 0)
                best: dict[int, list[int]] = {int(i): [] for i in tree.ids[mine]}
                for i, _, _, _, score in _search(tree, tree.ids[mine], tree.labels[mine], tree.vectors[mine], [[(None, None, None)]] * len(mine), k, True):
                    best[i].append(score)
                yield _batch([(i, s[k - 1] if len(s) == k else None, b.column("s")[at].as_py()) for i, s in best.items()], ["id", "kth", "s"])

    return run


def _meet(k: int, same: bool):
    """Each tile's best for each window of each anchor of the block beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, which = None, None
        for b in batches:
            for at in range(b.num_rows):
                if which != (s := b.column("s")[at].as_py()):
                    tree, which = Tree(*_unpack(_read(b.column("rows"), at))), s
                anchors = _read(b.column("anchors"), at)
                yield _batch(list(_search(tree, *_unpack(anchors), _windows(anchors), k, same)), _NAMES)

    return run


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, q): the rows that take part, one for each id, all vectors of one length.

    Rows with a null id, label or vector, or with any null or non-finite component, take
    no part. Of rows with one id, the smallest (label, vector) stands for all. Shorter
    vectors are filled with zeros, which add nothing to a product.
    """
    x = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("v"))
    x = x.filter("id is not null and label is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    x = x.select("id", "label", F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("bigint")).alias("q"))
    x = x.groupBy("id").agg(F.min(F.struct("label", "q")).alias("r")).select("id", "r.label", "r.q")
    x = scratch_table(x, "vectors")
    longest = x.agg(F.max(F.size("q"))).first()[0] or 0
    return x.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("bigint"), F.lit(longest) - F.size("q"))))


def pack(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """(s, rows): tiles of up to ``tile`` rows, written: the top of the tree, sort-tile-recursive over the two widest coordinates.

    A tile's rows are one binary, and a file has few of them: a reader of lists would take
    all tiles of a file as one batch. Ranks come from ``running``, so neither a task nor a coordinate that many rows share
    holds more than its part; ties go by id.
    """
    first = rows.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    n, dims = first[0], first[1] or 0
    wide = [0, 0]
    if dims and n:
        spread = rows.agg(*[F.var_pop(F.element_at("q", k + 1)).alias(f"v{k}") for k in range(dims)]).first()
        wide = sorted(range(dims), key=lambda k: -(spread[k] or 0))[:2]
    each = ceil(max(1, n) / max(1, ceil(sqrt(max(1, n) / tile))))
    at = lambda k: F.element_at("q", wide[k % len(wide)] + 1) if dims else F.lit(0)
    narrow = rows.select("id", at(0).alias("x"), at(1).alias("y"))
    slabs = running(narrow, [F.col("x"), F.col("id")], one_range=tile).withColumn("slab", F.floor((F.col("position") - 1) / each)).drop("position")
    tiles = running(slabs, [F.col("y"), F.col("id")], keys=("slab",), one_range=tile)
    s = F.col("slab") * ceil(each / tile) + F.floor((F.col("position") - 1) / tile)
    dealt = rows.join(tiles.select("id", s.cast("bigint").alias("s")), "id").select("s", "id", "label", "q")
    packed = _bundled(dealt, "s", min(MANY, ceil(n / tile)))
    return scratch_table(packed, "tiles", max(1, FILE // (8 * tile * (dims + 2))))


def _in_blocks(anchors: DataFrame, trees: DataFrame, k: int, same: bool, block: int) -> DataFrame:
    """Every anchor (id, label, q, w) against every tile, in blocks of about ``block`` anchors.

    Tasks are dealt by tile and, where tiles are few, by a share of the blocks; their
    number is set here, since the work lies in the pairs and not in the bytes.
    """
    blocks = max(1, ceil(anchors.count() / block))
    top = trees.agg(F.max("s")).first()[0] or 0
    shares = min(blocks, max(1, ceil(FEW / (top + 1))))
    tasks = min(MANY, shares * (top + 1))
    b = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("bigint").alias("b")
    groups = _bundled(anchors.select(b, "id", "label", "q", "w"), "b", min(FEW, blocks)).select(F.col("rows").alias("anchors"), (F.col("b") % shares).alias("part"))
    asked = groups.withColumn("s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(top).cast("bigint")))).repartition(tasks, "s", "part")
    dealt = trees.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shares - 1).cast("bigint")))).repartition(tasks, "s", "part")
    return asked.hint("merge").join(dealt, ["s", "part"]).select("s", "rows", "anchors").mapInArrow(_meet(k, same), _FOUND)


def mine(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = EVERY,
    positives: int = POSITIVES, negatives: int = NEGATIVES, tile: int = TILE, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``: a stated query set, searched
    against all rows in blocks of tiles and anchors. What takes part is told in
    ``quantised``. An anchor without other rows of its label, and a positive without a
    row of another label inside its window, gives no row. Ties go to the smaller id. An
    empty table gives an empty result. Scores are exact; a score beyond a long is an error.

    First each anchor searches its own tile; the k-th score found there is what boxes of
    other tiles must reach, so tiles that add nothing send nothing.
    """
    x = quantised(rows, id_col, vector_col, label_col)
    trees = pack(x, tile)
    kth = scratch_table(trees.mapInArrow(_home(every, positives), "id bigint, kth bigint, s bigint"), "home")
    none = F.lit(None).cast("bigint")
    window = lambda pos, ps, least: F.struct(pos.alias("pos"), ps.alias("ps"), least.alias("kth"))
    anchors = scratch_table(x.filter(F.col("id") % every == 0).join(kth, "id"), "anchors")
    asked = anchors.select("id", "label", "q", F.array(window(none, none, F.col("kth"))).alias("w"))
    order = [F.desc("score"), F.asc("found")]
    near = _in_blocks(asked, trees, positives, True, block).withColumn("nth", F.row_number().over(Window.partitionBy("anchor_id").orderBy(*order)))
    near = scratch_table(near.filter(F.col("nth") <= positives).select("anchor_id", F.col("found").alias("pos"), F.col("score").alias("ps")), "positives")
    both = near.groupBy("anchor_id").agg(F.collect_list(window(F.col("pos"), F.col("ps"), none)).alias("w"))
    wanted = anchors.join(both, F.col("id") == F.col("anchor_id")).select("id", "label", "q", "s", "w")
    own = _bundled(wanted, "s", min(MANY, max(1, trees.count()))).withColumnRenamed("rows", "anchors").join(trees, "s")
    seed = own.select("s", "rows", "anchors").mapInArrow(_meet(negatives, False), _FOUND)
    least = seed.groupBy("anchor_id", F.col("positive_id").alias("pos")).agg(F.when(F.count(F.lit(1)) == negatives, F.min("score")).alias("kth"))
    seeded = near.join(least, ["anchor_id", "pos"], "left").groupBy("anchor_id").agg(F.collect_list(window(F.col("pos"), F.col("ps"), F.col("kth"))).alias("w"))
    wanted = scratch_table(anchors.join(seeded, F.col("id") == F.col("anchor_id")).select("id", "label", "q", "w"), "wanted")
    hard = _in_blocks(wanted, trees, negatives, False, block)
    hard = hard.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(*order))).filter(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
