import hashlib
import random
import re
from collections import defaultdict

from paygrove.llm import dedup, mixing, rules, sharding

SF = "/root/testdata/sf0.001"


def odd(spark):
    rows = [(5, "a  b\tc", "s", 1), (3, "a b c", "s", 1), (None, "a b c", None, 2), (7, None, "t", 3), (8, "", "t", 3), (9, "x " * 60000, None, 4), (9, "x " * 60000, None, 4), (2, "a b c", "u", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, keep_id long")


def test_exact_groups(spark):
    got = dedup.exact_groups(odd(spark)).collect()
    assert len(got) == 8
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    abc = by[hashlib.sha256(b"a b c").hexdigest()]
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in abc} == {(5, 3, 3, False), (3, 3, 3, True), (None, 3, 3, False)}
    assert sorted(r.kept for r in by[hashlib.sha256(b"").hexdigest()]) == [False, True]
    nine = [r for r in got if r.doc_id == 9]
    assert sorted(r.kept for r in nine) == [False, True] and {r.group_size for r in nine} == {2}
    assert dedup.exact_groups(odd(spark).limit(0)).count() == 0
    kept = dedup.keep_first(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 7, 9]


def test_clashing_names_and_ties(spark):
    """Rows of one id and normalised text that differ otherwise: the least by all columns stays, in any partitioning."""
    rows = [(1, "a  b", "z", 5), (1, "a b", "y", 4), (1, "a b", "x", 9), (2, "c", "x", 1), (2, "c", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row string, __nth int").selectExpr("*", "1 as k", "2 as g", "3 as x", "map('m', 1) as row", "4 as nth")
    want = None
    for n in (1, 3, 5):
        got = sorted((r.doc_id, r.text, r["__row"], r["__nth"], r.k, r.nth) for r in dedup.keep_first(df.repartition(n)).collect())
        assert want in (None, got)
        want = got
    assert want == [(1, "a  b", "z", 5, 1, 4), (2, "c", "x", 1, 1, 4)]
    for name in ("rows", "fan"):
        assert sharding.shard(df.withColumnRenamed("k", name), 100).count() == 5
    assert rules.ledger(df.selectExpr("*", "1 as i", "2 as t", "3 as n_words")).count() == 5
    assert mixing.mix_sources(df.selectExpr("*", "'s' as source", "1 as h", "2 as size", "3 as weight", "4 as rate")).count() == 5


def test_one_text_in_most_rows(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, concat('own ', id), 'the same text') as text").repartition(20)
    r = dedup.exact_groups(df).filter("kept").collect()
    assert len(r) == 1001 and max(x.group_size for x in r) == 2000


def plain_targets(sizes):
    """Hand out by weight, cap, and share the excess again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, t = 1.5 * sum(sizes.values()), set(order), dict.fromkeys(order, 0.0)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return t | share
        for s in over:
            t[s] = 2.0 * sizes[s]
            left -= t[s]
        open_ -= over
    return t


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd(spark).select("doc_id", "text", "source").selectExpr("doc_id + 100000 as doc_id", "text", "source"), allowMissingColumns=True)
    a = mixing.mix_sources(docs).collect()
    rows = docs.collect()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len((r.text or "").encode().split())
    want = plain_targets(size)
    taken = defaultdict(int)
    for r in a:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
        taken[r.source] += r.taken
    for s, t in want.items():
        largest = max(len((r.text or "").encode().split()) for r in rows if r.source == s)
        assert t - largest - 1 <= taken[s] <= t + 1, (s, t, taken[s])
    key = lambda r: (r.doc_id is None, r.doc_id, r.taken)
    assert sorted(map(key, a)) == sorted(map(key, mixing.mix_sources(docs.repartition(7)).collect()))
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns and mix.count() == sum(r.copies for r in a)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_cells(spark, monkeypatch):
    """Many cells of ranks: the cut is still the source's own, and close to its target."""
    monkeypatch.setattr(mixing, "BUCKET", 16)
    monkeypatch.setattr(mixing, "FAN", 8)
    df = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', int(1 + pmod(id * 7919, 40))) as text", "if(id % 3 = 0, 'hot', concat('s', id % 5)) as source")
    a = mixing.mix_sources(df).toPandas()
    g = a.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((g.target - g.taken).abs() <= 41).all()


def plain_mix(rows, target, most=2.0):
    """Pareto sample of one source: (id, h, size, weight) rows in order of their ranks, first fit."""
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(s * min(most, mid * w) for _, _, s, w in rows) < target else (lo, mid)
    copies, queue = {}, []
    for i, h, s, w in rows:
        r = min(most, hi * w)
        whole = int(r + 1e-9)
        pi = min(1.0, max(0.0, r - whole))
        copies[i] = whole
        if pi >= 1e-9:
            u = (((h & (1 << 64) - 1) >> 11) + 0.5) * 2.0**-53
            queue.append((u / (1 - u) * (1 - pi) / pi, i, s))
    left = target - sum(copies[i] * s for i, _, s, _ in rows)
    for _, i, s in sorted(queue):
        if s <= left + 1e-6:
            copies[i] += 1
            left -= s
    return copies


def test_mixing_equals_the_plain_sample(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD))
    for weight in (None, F.lit(1.0), F.col("doc_id") % 7 + 1):
        n, plan = mixing.plan_mix(docs, size, weight=weight)
        by = defaultdict(list)
        for r in n.collect():
            by[r.source].append((r.i, r.h, r.size, r.weight))
        assert weight is not None or len({w for rows in by.values() for _, _, _, w in rows}) > 5
        want = {}
        for r in plan.collect():
            want |= plain_mix(by[r.source], r.target)
        assert {r.doc_id: r.copies for r in mixing.mix_sources(docs, weight=weight).collect()} == want


def test_unequal_odds(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "'w w w w' as text", "'one' as source", "if(id % 2 = 0, 3.0, 1.0) as w")
    from pyspark.sql import functions as F

    a = mixing.mix_sources(df, weight=F.col("w"), share=0.25).toPandas()
    even = a[a.doc_id % 2 == 0].copies.mean()
    assert abs(even - 0.375) < 0.03 and abs(a.taken.sum() - 6000) <= 4


def test_shards_fit(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(i, "x" * r.randint(0, 400)) for i in range(2000)] + [(5000, "y" * 9000), (5001, None)] + [(7, "same")] * 300, "doc_id long, text string")
    got = sharding.shard(docs, 2000).collect()
    assert len(got) == docs.count()
    total, n, name = defaultdict(int), defaultdict(int), {}
    for x in got:
        total[x.shard_id] += x.doc_bytes
        n[x.shard_id] += 1
        name[x.shard_id] = (x.shard_bytes, x.shard_docs, x.oversized)
    for k in total:
        assert name[k] == (total[k], n[k], total[k] > 2000)
        assert total[k] <= 2000 or n[k] == 1
    bits = [k.split(".")[0] for k in total if k != "root"]
    assert all(not (a != b and b.startswith(a)) for a in bits for b in bits)
    # only a bucket over the limit was split
    for k in {b[:-1] for b in bits if len(b) > 1}:
        assert sum(v for s, v in total.items() if s.split(".")[0].startswith(k)) > 2000
    assert sharding.shard(docs.limit(0), 2000).count() == 0


def plain_measure(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    seen = {g for g in grams if grams.count(g) > 1} if len(grams) < 400 else {g for g, c in __import__("collections").Counter(grams).items() if c > 1}
    covered = {j for i, g in enumerate(grams) if g in seen for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(odd(spark).select("doc_id", "text")).union(spark.createDataFrame([(1, "a a a a a"), (2, "x\nx\n\n x\n"), (3, "a b \x1c c É#")], "doc_id long, text string"))
    led = rules.ledger(docs)
    text = defaultdict(list)
    for r in docs.collect():
        text[r.doc_id].append(plain_measure(r.text))
    for r in led.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in text[r.doc_id]
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert bool(r.failed_bits & rules.BASE.mask) == base
    n = led.count()
    kept = rules.apply_policy(led, rules.STRICT).filter("kept").count()
    assert rules.passing(docs).count() == kept and rules.passing(docs).columns == docs.columns
    ab = {r.rule: r for r in rules.ablation(led, rules.STRICT).collect()}
    for b, name, fails in rules.RULES:
        assert ab[name].failed == led.filter(fails).count()
        assert ab[name].kept_without == kept + ab[name].failed_alone == n - led.filter(f"(failed_bits & ~{1 << b}) <> 0").count()
    assert rules.ledger(docs.limit(0)).count() == 0
    assert rules.union_bits(led).count() == 1


def test_mixing_repeated_ids(spark, monkeypatch):
    """Rows of one id with other texts draw for themselves; equal rows share their copies; sources still meet their targets."""
    monkeypatch.setattr(mixing, "BUCKET", 64)
    df = spark.range(900).selectExpr("pmod(id, 600) as doc_id", "repeat('w ', int(1 + pmod(id * 7919, 61))) as text", "concat('s', pmod(id, 3)) as source")
    df = df.union(df.filter("doc_id = 5").limit(1))
    a = mixing.mix_sources(df).toPandas()
    g = a.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((g.target - g.taken).abs() <= 122).all() and (g.taken <= g.target + 1e-6).all()
    assert (a.groupby(["source", "doc_id", "size"]).copies.nunique() == 1).all()
    assert mixing.mixed(df).count() == a.copies.sum()
