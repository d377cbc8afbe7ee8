"""Operator 8, toxicity: a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paygrove.llm.langid import held_out
from paygrove.session import checkpoint

WORD = re.compile(r"[^\W\d_]+")
#: Bounds of the training sample: documents of each label, and characters of the longest one taken.
SAMPLE, LONGEST = 1500, 20_000
#: Hashed feature weights.
WEIGHTS = 1 << 18
#: Words of a block of the forward-backward passes.
BLOCK = 64
#: A word is labelled toxic where a feature is in so many toxic documents at least, and
#: so many times as often there as in others.
LEAST_DOCS, LEAST_ODDS = 4, 8.0
#: Distinct words whose emission a task remembers.
REMEMBERED = 400_000


def features(word: str) -> list[str]:
    """The word itself and its prefixes of 4 and 5 letters."""
    out = ["w" + word]
    if len(word) > 4:
        out.append("4" + word[:4])
    if len(word) > 5:
        out.append("5" + word[:5])
    return out


def slots(word: str) -> list[int]:
    return [xxhash.xxh32_intdigest(f.encode("utf-8", "surrogatepass")) % WEIGHTS for f in features(word)]


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class Model:
    """Log weights: of a feature for label 1, of starting with 1, and of the four transitions."""

    theta: np.ndarray
    start: float
    step: np.ndarray
    scale: tuple[float, float, float] = (0.0, 1.0, 0.0)

    def emission(self, word: str) -> float:
        return float(min(30.0, max(-30.0, self.theta[slots(word)].sum())))


def marginals(e: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """P(label 1) of each word, given log emissions of documents one after another."""
    return posteriors(e, sizes, model)[0]


def posteriors(e: np.ndarray, sizes: np.ndarray, model: Model, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(label 1), P(0 before 1), P(1 before 1)) of each word; the last two only with ``pairs``, and 0 for first words.

    Forward and backward in blocks: the products of each block's transfer matrices come
    from one pass over all blocks at once, they are chained per document, and a second
    pass fills in the blocks. Exact, whatever the documents' lengths.
    """
    sizes = np.asarray(sizes)
    if not len(e):
        return np.zeros(0), np.zeros(0), np.zeros(0)
    nb = -(-sizes // BLOCK)
    first = np.concatenate([[0], np.cumsum(nb)])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(e)) - begin[doc]
    row, col = first[doc] + at // BLOCK, at % BLOCK
    x = np.ones((first[-1], BLOCK))
    x[row, col] = np.exp(e)
    on = np.zeros((first[-1], BLOCK), bool)
    on[row, col] = True
    t = np.exp(model.step)
    n = first[-1]
    head = np.zeros(n, bool)
    head[first[:-1][nb > 0]] = True
    # transfer of a word: [[t00, t01 * x], [t10, t11 * x]]; a document's first word comes after a start state
    s0, s1 = 1.0, float(np.exp(model.start))
    p = np.zeros((4, n))
    p[0] = p[3] = 1.0
    for k in range(BLOCK):
        v, w = x[:, k], on[:, k]
        t00, t01, t10, t11 = _transfer(t, v, head & (k == 0), s0, s1)
        q = np.stack([p[0] * t00 + p[1] * t10, p[0] * t01 + p[1] * t11, p[2] * t00 + p[3] * t10, p[2] * t01 + p[3] * t11])
        q /= q.sum(0)
        p = np.where(w, q, p)
    # entry of each block from the left and from the right
    left, right = np.zeros((2, n)), np.ones((2, n))
    order = np.flatnonzero(nb > 0)
    a = np.zeros((2, len(sizes)))
    a[0] = 1.0
    z = np.ones((2, len(sizes)))
    for k in range(int(nb.max())):
        d = order[nb[order] > k]
        r = first[d] + k
        left[:, r] = a[:, d]
        b = np.stack([a[0, d] * p[0, r] + a[1, d] * p[2, r], a[0, d] * p[1, r] + a[1, d] * p[3, r]])
        a[:, d] = b / b.sum(0)
        r = first[d] + nb[d] - 1 - k
        right[:, r] = z[:, d]
        b = np.stack([p[0, r] * z[0, d] + p[1, r] * z[1, d], p[2, r] * z[0, d] + p[3, r] * z[1, d]])
        z[:, d] = b / b.sum(0)
    fwd = np.zeros((2, n, BLOCK))
    entry = left
    for k in range(BLOCK):
        t00, t01, t10, t11 = _transfer(t, x[:, k], head & (k == 0), s0, s1)
        q = np.stack([left[0] * t00 + left[1] * t10, left[0] * t01 + left[1] * t11])
        left = np.where(on[:, k], q / q.sum(0), left)
        fwd[:, :, k] = left
    out = np.zeros((n, BLOCK))
    both = np.zeros((2, n, BLOCK)) if pairs else None
    for k in range(BLOCK - 1, -1, -1):
        up = fwd[1, :, k] * right[1]
        out[:, k] = up / (up + fwd[0, :, k] * right[0])
        t00, t01, t10, t11 = _transfer(t, x[:, k], head & (k == 0), s0, s1)
        if pairs:
            a0, a1 = fwd[:, :, k - 1] if k else entry
            z = a0 * (t00 * right[0] + t01 * right[1]) + a1 * (t10 * right[0] + t11 * right[1])
            no = head & (k == 0)
            both[0, :, k], both[1, :, k] = np.where(no, 0, a0 * t01 * right[1] / z), np.where(no, 0, a1 * t11 * right[1] / z)
        q = np.stack([t00 * right[0] + t01 * right[1], t10 * right[0] + t11 * right[1]])
        right = np.where(on[:, k], q / q.sum(0), right)
    return out[row, col], both[0][row, col] if pairs else out[row, col], both[1][row, col] if pairs else out[row, col]


def _transfer(t, v, starts, s0, s1):
    if not starts.any():
        return t[0, 0], t[0, 1] * v, t[1, 0], t[1, 1] * v
    return (np.where(starts, s0, t[0, 0]), np.where(starts, s1, t[0, 1]) * v, np.where(starts, s0, t[1, 0]), np.where(starts, s1, t[1, 1]) * v)


def _dfs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, documents) of a task's part of the sample."""
    seen: dict[tuple[str, int], int] = {}
    for b in batches:
        for t, y in zip(b.column("t").to_pylist(), b.column("y").to_pylist(), strict=True):
            for f in {f for w in set(tokens(t)) for f in features(w)}:
                seen[f, y] = seen.get((f, y), 0) + 1
    keys = list(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())],
        ["f", "y", "n"],
    )


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(t, y): up to ``most`` labelled documents of each label, none of them held out, none beyond ``LONGEST``.

    Ids are taken in the order of their hashes, and of several rows of one id one is, so
    the sample has at most 2 * ``most`` rows of ``LONGEST`` characters whatever repeats,
    and is the same when it is made anew. An id with both labels counts as toxic.
    """
    usable = labels.select(F.col(id_col).alias("__i"), F.col(label_col).cast("int").alias("y"))
    usable = usable.filter(F.col("y").isin(0, 1) & F.col("__i").isNotNull() & ~held_out(F.col("__i"))).groupBy("__i").agg(F.max("y").alias("y"))
    first = [usable.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit(8), F.col("__i")), "__i").limit(most) for y in (0, 1)]
    picked = F.broadcast(first[0].union(first[1]))  # at most 2 * most ids
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    texts = texts.filter(F.length("t") <= LONGEST).join(picked, F.col("__id") == F.col("__i"))
    one = texts.groupBy("__i").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t", "y")).alias("r"))
    return one.select("r.t", "r.y")


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int = SAMPLE) -> Model:
    """A model from a bounded sample of labelled documents.

    Documents' labels become words' labels: in a toxic document a word is toxic if one of
    its features is far more frequent, by documents, in toxic than in other documents of
    the sample (counted in Spark). The field is then fitted to these tags by gradient
    steps on the conditional likelihood, and two numbers per document (noisy-or and sum of
    the marginals) are mapped to its label by logistic regression.
    """
    s = checkpoint(sample(docs, labels, id_col, text_col, label_col, most))
    rows = s.toArrow()
    texts, y = rows.column("t").to_pylist(), np.array(rows.column("y").to_pylist(), int)
    none = Model(np.zeros(WEIGHTS, np.float32), -20.0, np.array([[0.0, -20.0], [0.0, -20.0]]), (-20.0, 0.0, 0.0))
    if not (y == 1).any() or not (y == 0).any():
        return none
    df = s.repartition(16, F.xxhash64("t")).mapInArrow(_dfs, "f string, y int, n bigint").groupBy("f").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    odds = ((F.col("a") + 0.1) / F.lit(n1 + 1.0)) / ((F.col("b") + 0.5) / F.lit(n0 + 1.0))
    seeds = {r.f for r in df.filter((F.col("a") >= LEAST_DOCS) & (odds >= LEAST_ODDS)).orderBy(F.desc("a"), "f").limit(20_000).collect()}
    seqs, tags, known = [], [], {}
    for t, label in zip(texts, y, strict=True):
        w = tokens(t)
        for x in w:
            if x not in known:
                known[x] = (slots(x), any(f in seeds for f in features(x)))
        seqs.append(w)
        tags.append(np.array([known[x][1] and label == 1 for x in w], float))
    return _fit(seqs, tags, y, known)


def _fit(seqs, tags, y, known, rounds: int = 25, rate: float = 0.5, decay: float = 1e-5) -> Model:
    sizes = np.array([len(s) for s in seqs])
    width = 3
    f = np.full((int(sizes.sum()), width), WEIGHTS, np.int64)  # the last weight stays 0
    k = 0
    for s in seqs:
        for w in s:
            own = known[w][0]
            f[k, : len(own)] = own
            k += 1
    tag = np.concatenate(tags) if len(tags) else np.zeros(0)
    theta = np.zeros(WEIGHTS + 1)
    # words begin as unlikely as they are
    base = np.log((tag.sum() + 1) / (len(tag) + 2))
    m = Model(theta, float(base), np.array([[0.0, base], [0.0, base]]))
    g2, gs = np.full(WEIGHTS + 1, 1e-3), np.full(5, 1.0)
    starts = np.zeros(len(tag), bool)
    starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    prev = np.concatenate([[0.0], tag[:-1]])
    for _ in range(rounds):
        e = np.clip(theta[f].sum(1), -30, 30)
        p, p01, p11 = posteriors(e, sizes, m, pairs=True)
        d = tag - p
        grad = np.bincount(f.ravel(), np.repeat(d, width), WEIGHTS + 1) - decay * len(tag) * theta / 100
        grad[WEIGHTS] = 0
        g2 += grad**2
        theta += rate * 4 * grad / np.sqrt(g2)
        inner = ~starts
        gt = np.array([d[starts].sum(), ((1 - prev) * tag - p01)[inner].sum(), (prev * tag - p11)[inner].sum()])
        gs[:3] += gt**2
        up = rate * gt / np.sqrt(gs[:3])
        m = Model(theta, m.start + up[0], m.step + np.array([[0.0, up[1]], [0.0, up[2]]]))
    p = marginals(np.clip(theta[f].sum(1), -30, 30), sizes, m)
    x = document_numbers(p, sizes)
    m = Model(theta[:WEIGHTS].astype(np.float32), m.start, m.step)
    m.scale = _logistic(x, y)
    return m


def document_numbers(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: the logit of 1 - prod(1 - p), and log(1 + sum(p))."""
    ends = np.cumsum(sizes)
    none = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
    some = np.concatenate([[0.0], np.cumsum(p)])
    ln = np.minimum(none[ends] - none[ends - sizes], -1e-12)
    logit = np.log(-np.expm1(ln)) - ln
    return np.stack([np.clip(logit, -15, 15), np.log1p(np.maximum(0, some[ends] - some[ends - sizes]))], 1)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """Newton steps with a ridge, label classes weighted alike."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    b = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (w * (y - p)) - 0.5 * b
        h = (a * (w * p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(3)
        b = b + np.linalg.solve(h, g)
    return tuple(map(float, b))


def _scored(shared, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        emission: dict[str, float] = {}
        for b in batches:
            texts = b.column("t").to_pylist()
            lo = 0
            score, found = [], []
            while lo < len(texts):
                words, hi, n = [], lo, 0
                while hi < len(texts) and n < 300_000:
                    words.append(tokens(texts[hi]))
                    n += len(words[-1])
                    hi += 1
                if len(emission) > REMEMBERED:
                    emission = {}
                for w in {w for ws in words for w in ws if w not in emission}:
                    emission[w] = model.emission(w)
                e = np.array([emission[w] for ws in words for w in ws])
                sizes = np.array([len(ws) for ws in words])
                p = marginals(e, sizes, model)
                x = document_numbers(p, sizes)
                c = model.scale
                score.append(1 / (1 + np.exp(-np.clip(c[0] + x @ np.array(c[1:]), -30, 30))))
                if spans:
                    ends = np.cumsum(sizes)
                    for t, a, z in zip(texts[lo:hi], ends - sizes, ends, strict=True):
                        found.append(offsets(t, p[a:z]))
                lo = hi
            s = np.concatenate(score) if score else np.zeros(0)
            cols, names = [b.column("i"), b.column("held_out"), pa.array(s), pa.array((s >= 0.7).astype(np.int32))], ["i", "held_out", "score", "predicted"]
            if spans:
                kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
                cols, names = [*cols, pa.array(found, kind)], [*names, "spans"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def offsets(text: str | None, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Offending offsets: runs of words whose marginal is at least ``least``, as code points."""
    out: list[dict] = []
    if not len(p) or p.max() < least:
        return out
    open_ = False
    for m, x in zip(WORD.finditer(text.lower()), p, strict=True):
        if x < least:
            open_ = False
        elif open_:
            out[-1]["end"], out[-1]["p"] = m.end(), max(out[-1]["p"], float(x))
        else:
            out.append({"begin": m.start(), "end": m.end(), "p": float(x)})
            open_ = True
    return out


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most: int = SAMPLE, spans: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted; ``spans`` adds the offending offsets.

    Every word of the whole text gets the marginal probability of the label toxic given
    all of the text. Null and empty texts get the score of a document without toxic
    words. Without labels of both kinds every score is near 0. A null id isn't held out.
    Offsets are code points of the lower-cased text. Repeated rows give repeated rows;
    other columns are ignored. Repeated labels of an id count once, toxic if any is. An
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, label_col, most))
    narrow = docs.select(F.col(id_col).alias("i"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("t"))
    out = f"i {dict(narrow.dtypes)['i']}, held_out boolean, score double, predicted int" + ", spans array<struct<begin: int, end: int, p: double>>" * spans
    return narrow.mapInArrow(_scored(shared, spans), out).withColumnRenamed("i", id_col)
