import random

import numpy as np
import pytest

from paygrove.llm import jaccard

SCHEMA = "doc_id long, text string, k string, n_shingles string"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(rows):
    """component of each row, by all pairs of different sets that share a shingle"""
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    where, first = {}, {}
    for n, s in enumerate(sets):
        if s:
            up[root(n)] = root(first.setdefault(s, n))
            for g in s:
                where.setdefault(g, set()).add(first[s])
    pairs = {(a, b) for ks in where.values() for a in ks for b in ks if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            up[root(a)] = root(b)
    low = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            low[root(n)] = min(low.get(root(n), i), i)
    return sorted(((i, len(s), low.get(root(n))) for n, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked_sets(df, **how).collect()), key=str)


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        at = rng.randrange(len(words))
        rng.choice([lambda: words.pop(at), lambda: words.insert(at, f"n{rng.randrange(10**6)}"), lambda: words.__setitem__(at, f"z{rng.randrange(9)}")])()
    return " ".join(words)


def corpus(seed, bases=12, size=(3, 160), copies=25):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for b in range(bases):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(*size))]
        if b % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = passage
        for _ in range(rng.randint(1, copies)):
            rows.append(edited(rng, words, rng.randrange(0, 1 + len(words) // 40)))
    rows += [" ".join(passage)] * 3 + [" ".join(passage[: 60 - k]) for k in range(12)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_needs_are_exact():
    """Index.links finds what all pairs give, with lists of every length."""
    rng = random.Random(4)
    base = [rng.getrandbits(60) for _ in range(90)]
    sets = [sorted({*rng.sample(base, rng.randint(60, 90)), *(rng.getrandbits(60) for _ in range(rng.randrange(6)))}) for _ in range(120)]
    offsets = np.cumsum([0, *map(len, sets)])
    index = jaccard.Index(np.arange(120), np.diff(offsets), offsets, np.array([w for s in sets for w in s]))
    want = {(a, b) for a in range(120) for b in range(a) if 180 * len({*sets[a]} & {*sets[b]}) >= 80 * (len(sets[a]) + len(sets[b]))}
    assert want
    hits = set()
    for x in range(120):
        key = int(index.keys[x])
        nx = int(index.sizes[x])
        for y, seen, probes in index.candidates(x, -(-80 * nx // 100), 0, 120, np.arange(120) == x):
            if index.reaches(y, seen, probes, -(-80 * (nx + int(index.sizes[y])) // 180)):
                hits.add(tuple(sorted((key, int(index.keys[y])), reverse=True)))
    assert hits == want


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_plain(spark, seed):
    rows = corpus(seed)
    want = plain_components(rows)
    assert len({c for _, _, c in want}) < len(rows)
    assert got(spark, rows) == want


def test_large_families_in_chunks(spark):
    """Blocks so small that every family is cut into chunks, with chains that only leave the largest group by one link."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(120)]
    rows = [edited(rng, words, rng.randrange(4)) for _ in range(60)]
    chain = list(words)
    for k in range(25):  # each step links to the last, not to the first
        chain[5 * k : 5 * k + 1] = [f"c{k}"]
        rows.append(" ".join(chain))
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    assert got(spark, rows, block=1500) == plain_components(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One\nTWO"), (6, "one two three"), (None, "one two"), (None, None), (7, "a b c d e"), (7, "a b c d e"), (7, "z y x w v u"),
            (8, "É b c d e"), (9, "é b c d e"), (10, "a " * 9000), (11, "A " * 20), (12, "x\x1cy b c d"), (13, " ".join(f"w{k}" for k in range(20000))), (14, " ".join(f"w{k}" for k in range(19000)))]
    assert got(spark, rows) == plain_components(rows)
    assert got(spark, []) == []


def test_equal_at_the_threshold(spark):
    """8 of 10 shingles link, 79 of 99 don't."""
    a = [f"a{k}" for k in range(13)]  # 9 shingles
    b = a[:12] + ["x"]  # shares 8, 10 in both
    c = [f"c{k}" for k in range(93)]  # 89 shingles
    d = c[:83] + [f"d{k}" for k in range(10)]  # shares 79, 99 in both
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(d))]
    assert got(spark, rows) == plain_components(rows) == [(1, 9, 1), (2, 9, 1), (3, 89, 3), (4, 89, 4)]


def test_query_over_documents(spark):
    from paygrove.llm.queries import op12_ngram_jaccard

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op12_ngram_jaccard(spark, sf).collect()), key=str) == plain_components(docs)
