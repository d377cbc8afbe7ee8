import random
from itertools import product

from paygrove.operators import screening


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_candidates_lose_no_match(spark):
    r = random.Random(4)
    base = ["jonathan smith", "muhammad ali khan", "maria de la cruz", "acme trading limited", "li", "a b", "party 0000000123", "party 0000000124", "x" * 40]

    def spoilt(s: str) -> str:
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(s) + 1)
            s = r.choice([s[:k] + r.choice("abcxyz ") + s[k:], s[:k] + s[k + 1 :], s[:k] + r.choice("abcxyz") + s[k + 1 :]]) or "a"
        return s

    names = [spoilt(r.choice(base)) for _ in range(120)]
    lists = [spoilt(r.choice(base)) for _ in range(60)]
    q = spark.createDataFrame(list(enumerate(names)), "query_id long, name string")
    w = spark.createDataFrame([(f"L{k}", n) for k, n in enumerate(lists)], "reference string, name string")
    for threshold in (0.8, 0.85):
        got = {(x.query_id, x.reference) for x in screening.screen(q, w, threshold, top=1000).filter("method in ('similar', 'equal')").collect()}
        norm = lambda s: " ".join("".join(c if c.isalnum() else " " for c in s).split())
        toks = lambda s: {t for t in norm(s).split() if len(t) > 1}
        want = set()
        for (i, a), (k, b) in product(enumerate(names), enumerate(lists)):
            x, y = norm(a), norm(b)
            sub = min(len(toks(a)), len(toks(b))) >= 2 and len(toks(a) & toks(b)) == min(len(toks(a)), len(toks(b)))
            if x == y or (not sub and 1 - distance(x, y) / max(len(x), len(y), 1) >= threshold):
                want.add((i, f"L{k}"))
        assert got == want


def test_typos_and_accents(spark):
    q = spark.createDataFrame([(1, "Jonathon Smyth"), (2, "muhamad"), (3, "Łukasz Żółć"), (4, "ﬁona müller-straße"), (5, "OFAC-1"), (6, None), (7, "")], "query_id long, name string")
    w = spark.createDataFrame([("A", "Jonathan Smith"), ("B", "muhammad"), ("C", "Fiona Muller Strasse"), ("OFAC-1", "somebody"), ("D", None), ("E", "Żółć zolc")], "reference string, name string")
    got = {(x.query_id, x.reference, x.method) for x in screening.screen(q, w, 0.8).collect()}
    assert {(1, "A", "similar"), (2, "B", "similar"), (4, "C", "equal"), (5, "OFAC-1", "identifier")} <= got
    assert not {x for x in got if x[0] == 6}


def test_names_alike_rank_as_all_pairs_do(spark):
    """Names that differ in digits only, far more alike than are kept: the same best five as all pairs give, ties by reference."""
    names = [(k, f"party {k * 7:09d}") for k in range(60)] + [(900, "party 00000012"), (901, "party 1000000123")]
    lists = [(f"S{k}", f"party {k:09d}") for k in range(120)] + [("T1", "party 00000011"), ("T2", "party 0000000123")]
    q, w = spark.createDataFrame(names, "query_id long, name string"), spark.createDataFrame(lists, "reference string, name string")
    want = set()
    for i, a in names:
        near = sorted((-1.0 if a == b else distance(a, b) / max(len(a), len(b)) - 1, r) for r, b in lists)
        want |= {(i, r, round(-x, 9), n) for n, (x, r) in enumerate(near[:5], 1) if -x >= 0.85}
    got = {(x.query_id, x.reference, round(x.similarity, 9), x.rank) for x in screening.screen(q, w).collect()}
    assert got == want


def test_short_names_make_no_pairs_by_segments(spark):
    """All names here begin alike, so segments would pair every name with every entry."""
    q = spark.range(300).selectExpr("id as query_id", "concat('party ', lpad(id, 9, '0')) as name")
    w = spark.range(300).selectExpr("concat('S', id) as reference", "concat('party ', lpad(id, 9, '0')) as name")
    from pyspark.sql import functions as F

    a = q.select("query_id", F.col("name").alias("q"), screening.normalised(F.col("name")).alias("qn"), screening.tokens(F.col("name")).alias("qt"))
    b = w.select("reference", screening.normalised(F.col("name")).alias("wn"), screening.tokens(F.col("name")).alias("wt"))
    assert screening._near(a, b, 0.85, 512).count() == 0
