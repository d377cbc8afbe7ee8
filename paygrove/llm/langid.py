"""Operator 5, language ID by language-bitmask n-gram filters (bit-sliced Bloom filters)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths of the n-grams, in letters; a gap between words counts as one.
LENGTHS = (1, 2, 3, 4)
#: Cells of the filter (a power of two), hashes per n-gram, languages per slice.
CELLS, HASHES, SLICE = 1 << 20, 3, 63
#: Documents of a language that the filter is learned from, about (bound of the training sample).
SAMPLE = 6000
#: An n-gram belongs to a language if it is in this share of the sample, and in this
#: share of what it has in the language where it is most frequent.
LEAST_SHARE, LEAST_RATIO = 0.004, 0.08

_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache
def _letters() -> np.ndarray:
    """Lower-case letter of each code point, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low[0])
    return out


def _codes(text: str) -> np.ndarray:
    """Letters of the text with one 32 between words and at both ends; empty without a letter."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    c = _letters()[cp]
    c = np.concatenate([[0], c, [0]]).astype(np.uint32)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = c[keep]
    return np.where(c == 0, 32, c).astype(np.uint64) if len(c) > 1 else c[:0].astype(np.uint64)


def _grams(c: np.ndarray) -> list[np.ndarray]:
    """Hashes of all n-grams of a code array, one array per length, in order of position."""
    out = []
    h = np.zeros(len(c), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(LENGTHS) + 1):
            if len(c) < n:
                break
            h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint64(n)) * _MIX
            h ^= h >> np.uint64(29)
            if n in LENGTHS:
                out.append(h)
    return out


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, df) of what this task has read of the sample."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("t").to_pylist(), strict=True):
            c = _codes(text)
            if len(c):
                g = np.unique(np.concatenate(_grams(c)))
                held.setdefault(lang, []).append(g)
                size += len(g)
            if size > 8_000_000:
                yield from _summed(held)
                held, size = {}, 0
    yield from _summed(held)


def _summed(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, parts in held.items():
        g, n = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "g", "n"])


class Filter:
    """Cells of language masks per slice, and the share of cells that each language has set."""

    def __init__(self, langs: list[str], cells: np.ndarray):
        self.langs, self.cells = langs, cells
        self.fill = np.array([((cells[k // SLICE] >> np.uint64(k % SLICE)) & np.uint64(1)).mean() for k in range(len(langs))])

    def places(self, g: np.ndarray) -> list[np.ndarray]:
        a, b = g & np.uint64(0xFFFFFFFF), (g >> np.uint64(32)) | np.uint64(1)
        return [((a + np.uint64(j) * b) & np.uint64(CELLS - 1)).astype(np.int64) for j in range(HASHES)]

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        codes = [_codes(t) if t else np.zeros(0, np.uint64) for t in texts]
        hits = np.zeros((len(self.langs), len(texts)))
        total = np.zeros(len(texts))
        for lo, hi in _groups([len(c) for c in codes]):
            self._count(codes[lo:hi], hits[:, lo:hi], total[lo:hi])
        fp = self.fill[:, None] ** HASHES
        est = np.maximum(0, (hits - total * fp) / np.maximum(1e-9, 1 - fp))
        said, score = [], []
        for k, c in enumerate(codes):
            if not len(c) or not self.langs:
                said.append("und")
                score.append(0.0)
                continue
            best = int(np.argmax(est[:, k]))
            said.append(self.langs[best])
            others = np.delete(est[:, k], best).max(initial=0.0)
            top = est[best, k]
            score.append(float(top / (top + others)) if top > 0 else 0.0)
        return said, score

    def _count(self, codes: list[np.ndarray], hits: np.ndarray, total: np.ndarray) -> None:
        full = [k for k, c in enumerate(codes) if len(c)]
        if not full:
            return
        sizes = np.array([len(codes[k]) for k in full])
        c = np.concatenate([codes[k] for k in full])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for n, g in zip(LENGTHS, _grams(c), strict=False):
            ok = np.ones(len(g), bool)  # n-grams that reach into the next document don't count
            for j in range(1, n):
                over = (begin[1:] - j)
                ok[over[(over >= 0) & (over < len(g))]] = False
            at = np.minimum(begin, len(g) - 1)
            total[full] += np.add.reduceat(ok.astype(np.int64), at) * (begin < len(g))
            cells = self.places(g)
            for s in range(len(self.cells)):
                m = self.cells[s][cells[0]]
                for p in cells[1:]:
                    m &= self.cells[s][p]
                m[~ok] = 0
                for k in range(s * SLICE, min(len(self.langs), (s + 1) * SLICE)):
                    bit = ((m >> np.uint64(k % SLICE)) & np.uint64(1)).astype(np.int64)
                    hits[k, full] += np.add.reduceat(bit, at) * (begin < len(g))


def _groups(sizes: list[int], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    lo = n = 0
    for k, s in enumerate(sizes):
        if n and n + s > most:
            yield lo, k
            lo, n = k, 0
        n += s
    if lo < len(sizes):
        yield lo, len(sizes)


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Filter:
    """The filter, from about ``sample`` documents a language of those not held out.

    Which documents is a matter of their ids' hashes. Their n-grams are counted in Spark
    by document, the members of each language chosen by frequency, and the cells set in
    Spark; only the cells, a fixed number, come to the driver.
    """
    spark = docs.sparkSession
    usable = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang"))
    usable = usable.filter(F.col("lang").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("i")))
    sizes = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Filter([], np.zeros((1, CELLS), np.uint64))
    share = spark.createDataFrame([(k, float(min(1.0, sample / sizes[k])), i) for i, k in enumerate(langs)], "l string, share double, idx int")
    share = F.broadcast(share)  # a row per language
    u = F.pmod(F.xxhash64(F.lit(5), F.col("i")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = usable.join(share, F.col("lang") == F.col("l")).filter(u < F.col("share"))
    grams = picked.select("lang", "t").mapInArrow(_sampled, "lang string, g bigint, n bigint")
    df = grams.groupBy("lang", "g").agg(F.sum("n").alias("n"))
    seen = {k: max(1.0, min(sizes[k], sample)) for k in langs}
    by = F.create_map(*[x for i, k in enumerate(langs) for x in (F.lit(k), F.struct(F.lit(i).alias("i"), F.lit(float(seen[k])).alias("n")))])
    df = df.withColumn("of", by[F.col("lang")]).withColumn("p", F.col("n") / F.col("of.n"))
    df = df.filter((F.col("p") >= LEAST_SHARE) & (F.col("n") >= 2))
    top = df.groupBy("g").agg(F.max("p").alias("top"), F.collect_list(F.struct("of.i", "p")).alias("ls"))
    ours = top.withColumn("x", F.explode(F.filter("ls", lambda x: x["p"] >= LEAST_RATIO * F.col("top"))))
    slices = ours.select("g", (F.col("x.i") / SLICE).cast("int").alias("s"), F.expr(f"shiftleft(1L, x.i % {SLICE})").alias("m"))
    a, b = F.col("g").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("g", 32).bitwiseOR(F.lit(1).cast("long"))
    places = F.array(*[(a + F.lit(j) * b).bitwiseAND(F.lit(CELLS - 1)) for j in range(HASHES)])
    set_ = slices.select("s", F.explode(places).alias("cell"), "m").groupBy("s", "cell").agg(F.expr("bit_or(m)").alias("m")).toArrow()
    cells = np.zeros(((len(langs) + SLICE - 1) // SLICE, CELLS), np.uint64)
    cells[set_.column("s").to_numpy(), set_.column("cell").to_numpy()] = set_.column("m").to_numpy().view(np.uint64)
    return Filter(langs, cells)


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                said, score = f.decide(part.column("t").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("held_out"), pa.array(said, pa.string()), pa.array(score, pa.float64())], ["i", "held_out", "lang_pred", "score"])

    return run


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE,
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score.

    Each n-gram of the whole text looks up its cells; the AND of their masks names all
    languages that contain it. A language's count, less what false positives would give
    at its fill, decides; the score is its part of the two best. A null id isn't held
    out. Null text, or text without a letter, is ``und`` with score 0, as is everything
    if nothing can be learned. Ties go to the first language by name. Other columns are
    ignored. Repeated rows give repeated rows; an empty table gives an empty result. Texts
    of any length are read whole.
    """
    f = docs.sparkSession.sparkContext.broadcast(learn(docs, id_col, text_col, lang_col, sample))
    narrow = docs.select(F.col(id_col).alias("i"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("t"))
    out = narrow.mapInArrow(_predicted(f), f"i {dict(narrow.dtypes)['i']}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("i", id_col)
