"""Operator 3, LM scoring: masked pseudo-likelihood under a bidirectional window network."""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paygrove.llm.words import split_by_count
from paygrove.session import scratch_table

#: Words each side of the predicted one, and hidden units.
SIDE, HIDDEN = 2, 28
#: What the network sees of a word around: one of the most frequent words, or else its ending.
OWN, ENDINGS = 64, 64
SEEN = OWN + ENDINGS
#: What it predicts: a class, then the word within it. Frequent words come in blocks, by rank; other words by ending.
BLOCKS, BLOCK = 64, 64
CLASSES = BLOCKS + ENDINGS
#: Words of the broadcast (others are joined to the word table).
VOCAB = 200_000
#: Rounds of training (each over its share of the documents, together over all), positions of a gradient step, step size.
ROUNDS, STEP, RATE = 2, 4096, 0.15
#: Positions that are scored at once.
SCORED = 8 * STEP
#: No weight of the outputs goes beyond, so scores stay where exponentials are finite.
MOST = 1.5
#: Distinct words that one task counts before it hands them on.
COUNTED = 800_000
#: Parameters travel as integers of this unit, so their sums don't depend on order.
UNIT = 2.0**-24
#: Logarithms of counts are summed as integers of this unit, for the same reason.
LOG_UNIT = 2.0**-32
#: A word counts as so much more than its other occurrences.
OTHERS = 0.1

AROUND = [k for k in range(-SIDE, SIDE + 1) if k]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for b in batches:
        for t in b.column("t").to_pylist():
            seen.update(words(t))
            if len(seen) > COUNTED:
                yield _pairs(seen)
                seen = Counter()
    yield _pairs(seen)


def _pairs(seen: Counter) -> pa.RecordBatch:
    w = list(seen)
    return pa.RecordBatch.from_arrays(
        [pa.array(w, pa.binary()), pa.array([ending(x) for x in w], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["w", "e", "n"]
    )


class Tables(NamedTuple):
    """By a word's place in the lexicon: what the network sees, and what it predicts.

    ``seen``: the input of the word. ``classes`` and ``within``: its class and, in a block
    of frequent words, its place there (else -1). ``log_p``: of a word outside the blocks,
    the logarithm of its count, this occurrence left out, over that of its ending.
    """

    seen: np.ndarray
    classes: np.ndarray
    within: np.ndarray
    log_p: np.ndarray


class Lexicon(dict):
    """Place of every word, known or not, in ``tables``."""

    def __init__(self, top: list[tuple[bytes, int]], stats: dict[int, int]):
        """top: the most frequent words and counts; stats: tokens of each ending."""
        tokens = np.zeros(ENDINGS)
        for e, n in stats.items():
            tokens[e] = n
        top = sorted(top, key=lambda x: (-x[1], x[0]))
        e = np.array([ending(w) for w, _ in top] + list(range(ENDINGS)), np.int64)
        n = np.array([n for _, n in top] + [1] * ENDINGS, float)
        k = np.arange(len(n))
        known = k < len(top)
        block = known & (k < BLOCKS * BLOCK)
        np.subtract.at(tokens, e[block], n[block])
        super().__init__(zip([w for w, _ in top], range(len(top)), strict=True))
        self.size = len(top)
        self.tables = Tables(
            np.where(known & (k < OWN), k, OWN + e).astype(np.int16), np.where(block, k // BLOCK, BLOCKS + e).astype(np.int16),
            np.where(block, k % BLOCK, -1).astype(np.int16), np.where(block, 0.0, np.log((n - 1 + OTHERS) / np.maximum(tokens[e], 1))),
        )

    def __missing__(self, word: bytes) -> int:
        return self.size + ending(word)

    def __reduce__(self):
        return _lexicon, (dict(self), self.tables)

    def places(self, ws: list[bytes]) -> np.ndarray:
        """Index of each word; from ``size`` on where the word is not in the lexicon."""
        return np.frombuffer(array("I", map(self.__getitem__, ws)), np.uint32)


def _lexicon(index: dict, tables: Tables) -> Lexicon:
    x = Lexicon.__new__(Lexicon)
    x.update(index)
    x.size, x.tables = len(index), tables
    return x


class Net:
    """Log probabilities of a word given what is seen of the words around it: of its class, and of the word in its block."""

    SHAPES = ((len(AROUND), SEEN + 1, HIDDEN), (HIDDEN,), (HIDDEN + 1, CLASSES), (BLOCKS, HIDDEN + 1, BLOCK))

    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            flat = np.random.default_rng(7).standard_normal(sum(map(math.prod, self.SHAPES))) * 0.1
        self.flat = flat.astype(np.float32, copy=False)
        self.near, self.bias, self.out, self.inner = self.views(self.flat)

    @classmethod
    def views(cls, flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([math.prod(s) for s in cls.SHAPES])
        return [flat[z - math.prod(s) : z].reshape(s) for s, z in zip(cls.SHAPES, ends, strict=True)]

    def hidden(self, ctx: np.ndarray) -> np.ndarray:
        """Hidden units, the last of which is always 1."""
        h = self.near[0].take(ctx[0], 0)
        for k in range(1, len(AROUND)):
            h += self.near[k].take(ctx[k], 0)
        h += self.bias
        out = np.ones((len(h), HIDDEN + 1), np.float32)
        np.tanh(h, out=out[:, :HIDDEN])
        return out

    @staticmethod
    def by_class(c: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """An order of positions by class, and in it the span of each block of frequent words; these come first."""
        order = np.argsort(c, kind="stable")
        ends = np.searchsorted(c.take(order), np.arange(BLOCKS + 1, dtype=c.dtype)).tolist()
        return order, [(k, slice(a, z)) for k, (a, z) in enumerate(zip(ends, ends[1:], strict=False)) if z > a]

    def log_probs(self, ctx: np.ndarray, c: np.ndarray, m: np.ndarray) -> np.ndarray:
        order, spans = self.by_class(c)
        ctx, c, m = ctx.take(order, 1), c.take(order), m.take(order)
        h = self.hidden(ctx)
        lp = np.empty(len(c), np.float32)
        for at in range(0, len(c), STEP):
            lp[at : at + STEP] = _log_soft(h[at : at + STEP] @ self.out, c[at : at + STEP])
        for k, at in spans:
            lp[at] += _log_soft(h[at] @ self.inner[k], m[at])
        out = np.empty_like(lp)
        out[order] = lp
        return out

    def gradient(self, ctx: np.ndarray, c: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Of the mean negative log probability."""
        n = len(c)
        grad = np.zeros_like(self.flat)
        near, bias, out, inner = self.views(grad)
        order, spans = self.by_class(c)
        ctx, c, m = ctx.take(order, 1), c.take(order), m.take(order)
        h = self.hidden(ctx)
        z = _soft_less(h @ self.out, c, n)
        dh = z @ self.out[:HIDDEN].T
        np.matmul(h.T, z, out=out)
        own = spans[-1][1].stop if spans else 0
        z = np.empty((own, BLOCK), np.float32)
        for k, at in spans:
            np.matmul(h[at], self.inner[k], out=z[at])
        z = _soft_less(z, m[:own], n)
        for k, at in spans:
            dh[at] += z[at] @ self.inner[k, :HIDDEN].T
            np.matmul(h[at].T, z[at], out=inner[k])
        h = h[:, :HIDDEN]
        dh *= 1 - h * h
        bias[:] = dh.sum(0)
        for k in range(len(AROUND)):
            order = np.argsort(ctx[k], kind="stable")
            key = ctx[k].take(order)
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            near[k][key[at]] = np.add.reduceat(dh.take(order, 0), at)
        return grad

    def learn(self, ctx: np.ndarray, c: np.ndarray, m: np.ndarray, g2: np.ndarray) -> None:
        """One adaptive gradient step."""
        grad = self.gradient(ctx, c, m)
        g2 += grad * grad
        grad /= np.sqrt(g2)
        grad *= RATE
        self.flat -= grad
        for x in (self.out, self.inner):
            np.clip(x, -MOST, MOST, out=x)


def _log_soft(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    own = z[np.arange(len(at)), at]
    return own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], np.float32))


def _soft_less(z: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    np.exp(z, out=z)
    z *= (1 / (n * (z @ np.ones(z.shape[1], np.float32))))[:, None]
    z[np.arange(len(at)), at] -= np.float32(1 / n)
    return z


def _windows(seen: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What is seen around each word, a row per offset; SEEN beyond the ends of a document."""
    ends = np.cumsum(sizes)
    at = np.arange(len(seen)) + np.repeat(SIDE * np.arange(1, len(sizes) + 1), sizes)
    flat = np.full(len(seen) + SIDE * (len(sizes) + 1), SEEN, np.int16)
    flat[at] = seen
    return np.stack([flat[at + k] for k in AROUND]) if len(ends) else np.zeros((len(AROUND), 0), np.int16)


def _batches(texts: list[str | None], most: int = 200_000) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(number of the last document and 1, words of documents one after another, how many each has); a document is cut nowhere."""
    held, sizes = [], []
    for k, t in enumerate(texts, 1):
        w = words(t)
        held += w
        sizes.append(len(w))
        if len(held) >= most or k == len(texts):
            yield k, held, np.array(sizes, np.int32)
            held, sizes = [], []


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _coded(shared):
    """Documents in batches as places of the lexicon, and each word outside it with its document's number in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for b in batches:
            lo = 0
            for hi, ws, sizes in _batches(b.column("t").to_pylist()):
                k = lexicon.places(ws)
                other = np.flatnonzero(k >= lexicon.size)
                of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[other]
                rare = pa.StructArray.from_arrays([pa.array(of), pa.array([ws[p] for p in other.tolist()], pa.binary())], ["d", "w"])
                planes = k.view(np.uint8).reshape(-1, 4).T[:3].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [_one_list(b.column("i").slice(lo, hi - lo)), _one_list(pa.array(sizes)), pa.array([planes], pa.binary()), _one_list(rare)], ["i", "sizes", "codes", "rare"]
                )
                lo = hi

    return run


def _coded_rows(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, places, sizes) of each batch of documents."""
    for row in range(b.num_rows):
        planes = np.frombuffer(b.column("codes")[row].as_py(), np.uint8).reshape(3, -1).astype(np.uint32)
        yield row, planes[0] | planes[1] << 8 | planes[2] << 16, b.column("sizes")[row].values.to_numpy()


def _trained(shared):
    """(salt, block, v): a task's parameters times its positions, and last the positions, in blocks of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, flat = shared.value
        net, n = Net(flat.copy()), 0
        g2 = np.full(len(net.flat), 1e-6, np.float32)
        for b in batches:
            for _, k, sizes in _coded_rows(b):
                ctx, c, m = _windows(tables.seen[k], sizes), tables.classes[k], tables.within[k]
                n += len(k)
                step = min(STEP, max(256, len(k) // 32))  # a small table still gets some steps
                for at in range(0, len(k), step):
                    net.learn(ctx[:, at : at + step], c[at : at + step], m[at : at + step], g2)
        if n:
            value = np.append(np.rint(net.flat.astype(np.float64) / UNIT * n / 1024), n).astype("<i8")
            parts = [value[a : a + 4096].tobytes() for a in range(0, len(value), 4096)]
            salt = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays([pa.array([salt] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array(parts)], ["salt", "block", "v"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of blocks of integers, by salt and block."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for *key, v in zip(*(b.column(c).to_pylist() for c in ("salt", "block", "v")), strict=True):
            x = np.frombuffer(v, "<i8")
            sums[tuple(key)] = sums[tuple(key)] + x if tuple(key) in sums else x
    yield pa.RecordBatch.from_arrays(
        [pa.array([s for s, _ in sums], pa.int32()), pa.array([k for _, k in sums], pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["salt", "block", "v"]
    )


def word_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, e, n): every distinct word of the whole corpus, its ending and its count."""
    t = docs.select(F.col(text_col).alias("t"))
    return scratch_table(t.mapInArrow(_counted, "w binary, e int, n bigint").groupBy("w", "e").agg(F.sum("n").alias("n")), "lm-words")


def coded(docs: DataFrame, id_col: str, text_col: str, vocab: int, table: DataFrame) -> tuple[Lexicon, DataFrame]:
    """A lexicon counted over all documents, and the corpus written as places in it."""
    spark = docs.sparkSession
    found = split_by_count(table.filter("n > 1"), vocab)[0].select("w", "n").toArrow()
    top = list(zip(found.column("w").to_pylist(), found.column("n").to_pylist(), strict=True))
    lexicon = Lexicon(top, {r.e: r.n for r in table.groupBy("e").agg(F.sum("n").alias("n")).collect()})
    narrow = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = f"i array<{dict(narrow.dtypes)['i']}>, sizes array<int>, codes binary, rare array<struct<d: int, w: binary>>"
    made = narrow.mapInArrow(_coded(spark.sparkContext.broadcast(lexicon)), kind)
    return lexicon, scratch_table(made.withColumn("b", F.monotonically_increasing_id()), "lm-coded")


def train(corpus: DataFrame, tables: Tables, rounds: int = ROUNDS) -> Net:
    """A network trained on the whole coded corpus.

    In each round every task starts from the shared parameters and takes gradient steps
    over its documents, each word masked in turn; the parameters are then averaged,
    weighted by positions, in Spark: first by block and salt, then by block. Each round
    takes another ``rounds``-th of the batches of documents, so all rounds together train
    on every position once. What comes to the driver is one set of parameters.

    Counts don't depend on how rows are dealt to tasks; the averaged parameters do, since
    each task learns from its own rows in turn.
    """
    net, kind = Net(), "salt int, block int, v binary"
    for turn in range(rounds):
        shared = corpus.sparkSession.sparkContext.broadcast((tables, net.flat))
        own = corpus.filter(F.pmod(F.xxhash64("b"), F.lit(rounds)) == turn).select("sizes", "codes")
        parts = own.mapInArrow(_trained(shared), kind).repartition("salt", "block").mapInArrow(_added, kind)
        sums = parts.withColumn("salt", F.lit(0)).repartition("block").mapInArrow(_added, kind).toArrow().sort_by("block")
        flat = np.frombuffer(b"".join(sums.column("v").to_pylist()), "<i8").astype(float)
        net = Net(flat[:-1] * UNIT * 1024 / flat[-1]) if len(flat) else net
    return net


def _scored(shared):
    """(b, d, i, n_tokens, pll): scores that lack the counts of words outside the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, flat = shared.value
        net = Net(flat)
        for b in batches:
            for row, k, sizes in _coded_rows(b):
                lp, c, m = tables.log_p[k], tables.classes[k], tables.within[k]
                ctx = _windows(tables.seen[k], sizes)
                for at in range(0, len(k), SCORED):
                    part = slice(at, at + SCORED)
                    lp[part] += net.log_probs(ctx[:, part], c[part], m[part])
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, b.column("b")[row].as_py())), pa.array(np.arange(n, dtype=np.int32)), b.column("i").slice(row, 1).flatten(),
                     pa.array(sizes.astype(np.int64)), pa.array(_between(lp, np.cumsum(sizes), sizes))],
                    ["b", "d", "i", "n_tokens", "pll"],
                )

    return run


def _between(x: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each document's values."""
    run = np.concatenate([[0], np.cumsum(x)])
    return run[ends] - run[ends - sizes]


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, vocab: int = VOCAB) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, pll, mean_pll, n_alone.

    pll sums, over every word of the whole text, its log probability given the words on
    both sides. One of the 4,096 most frequent words gets it from the network alone: that
    of its block of words, and that within the block, both from what is around. Any other
    word gets that of its ending from the network, and within the ending its share of the
    corpus by its own count, with this occurrence left out (plus ``OTHERS``). The ``vocab``
    most frequent words (a fixed bound) are broadcast; every other one is joined to the
    word table of the whole corpus. mean_pll is pll per word, null without words (then pll
    is 0), as for null and empty texts. n_alone is how many words occur once in all of the
    corpus. Repeated rows give repeated rows; other columns are ignored. An empty table
    gives an empty result. A text of any length is scored whole; its positions are taken
    ``SCORED`` at a time. The network's part depends on how rows are dealt to tasks
    (see ``train``).
    """
    table = word_table(docs, text_col)
    lexicon, corpus = coded(docs, id_col, text_col, vocab, table)
    net = train(corpus, lexicon.tables, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.tables, net.flat))
    out = corpus.select("b", "i", "sizes", "codes").mapInArrow(_scored(shared), f"b bigint, d int, i {dict(docs.select(F.col(id_col)).dtypes)[id_col]}, n_tokens bigint, pll double")
    # so far each counts as seen once, so a word that is needs no partner
    more = F.rint((F.log(F.col("n") - 1 + OTHERS) - math.log(OTHERS)) / F.lit(LOG_UNIT)).cast("long")
    rare = corpus.select("b", F.inline("rare")).join(table.select("w", "n", more.alias("v")), "w")
    counts = rare.groupBy("b", "d").agg(F.sum("v").alias("v"), F.count_if(F.col("n") == 1).alias("alone"))
    both = out.join(counts, ["b", "d"], "left")
    pll = F.col("pll") + F.coalesce("v", F.lit(0)) * F.lit(LOG_UNIT)
    return both.select(
        F.col("i").alias(id_col), "n_tokens", pll.alias("pll"), F.try_divide(pll, F.col("n_tokens")).alias("mean_pll"),
        F.coalesce("alone", F.lit(0)).alias("n_alone"),
    )
