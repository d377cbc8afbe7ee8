import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from paygrove.llm import bpe, simhash

SF = "/root/testdata/sf0.001"
ODD = [None, "", "  \n\t ", "don't We'LL 'Sx", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "Éeau çouè\n\tß ﬁ ΑΣ ΣΑΣ İ", "日本語 テスト🙂 é",
       "K ẖ H̱  x y\x1cz", "<|startoftext|", "1234 ½ ٣", "a" * 5000, "word " * 3000, "Hello World", "Hello World"]


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    texts = [*docs.text, *ODD]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "doc_id long, text string, n_tokens string")
    for distinct in (50, bpe.DISTINCT):
        got = {r.doc_id: r for r in bpe.encode_decode(df, distinct=distinct, with_ids=True).collect()}
        assert len(got) == len(texts)
        for i, x in enumerate(texts):
            ids = t.encode(x or "", add_special_tokens=False).ids
            assert got[i].n_tokens == len(ids), (i, x)
            assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert got[i].ids == ids and got[i].decoded == t.decode(ids, skip_special_tokens=False)
            assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_words_of_every_code_point():
    """Splitting agrees with the library on each character between two letters."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    enc = bpe.Encoder(bpe.default_path())
    texts = ["".join(f"a{chr(c)}b{chr(c)} " for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x110000, 64)]
    split = bpe.splitter(bpe.default_path())
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    bad = [texts[k] for k, w in enumerate(want) if [i for ids in enc(split(texts[k])) for i in ids] != w]
    assert not bad


def test_bpe_empty(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(prints, radius=4):
    at = {}
    for i, f in prints:
        at.setdefault(f, []).append(i)
    fs, root = list(at), {}
    root = {f: f for f in fs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(fs, 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    low = {}
    for f in fs:
        low[find(f)] = min([*at[f], low.get(find(f), 1 << 62)])
    return {i: low[find(f)] for i, f in prints}


def test_masks_cover_all_pairs():
    masks = simhash.covering_masks()
    assert len(masks) == 31
    for diff in combinations(range(0, 64), 2):
        assert any(not m & (1 << diff[0] | 1 << diff[1]) for m in masks)
    r = random.Random(1)
    for _ in range(5000):
        d = sum(1 << b for b in r.sample(range(64), 4))
        assert any(not m & d for m in masks)


@pytest.mark.parametrize("sf", [SF])
def test_simhash_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [(r.doc_id, plain_print(r.text)) for r in rows]
    want = plain_components(prints)
    got = {r.doc_id: r for r in simhash.near_components(docs).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in prints}
    assert {i: r.component_id for i, r in got.items()} == want


@pytest.mark.parametrize("bucket", [2, 2048])
def test_components_of_dense_groups(spark, bucket):
    """A chain and a dense ball, also by the way for large buckets."""
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(4)]
    fs = {b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(120)}
    chain = [0]
    for _ in range(12):
        chain.append(chain[-1] ^ sum(1 << x for x in r.sample(range(64), 4)))
    fs |= set(chain)
    prints = list(enumerate(fs))
    df = spark.createDataFrame([(simhash._signed(f),) for f in fs], "f long")
    got = {x.f: x.component for x in simhash.fingerprint_components(df, bucket=bucket).collect()}
    low = plain_components(prints)
    parts, mine = {}, {}
    for i, f in prints:
        parts.setdefault(low[i], set()).add(f)
        mine.setdefault(got.get(simhash._signed(f), f"alone{f}"), set()).add(f)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, mine.values()))


def test_simhash_edge_cases(spark):
    rows = [(5, None), (3, ""), (7, " \n"), (None, "one two"), (9, "one two"), (9, "one two"), (2, "x " * 50000)]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, fingerprint string, f int")
    got = simhash.near_components(df).collect()
    assert len(got) == 7
    zero = {r.doc_id: r.component_id for r in got if r.fingerprint == "0" * 16}
    assert zero[5] == zero[3] == zero[7] == 3
    assert {r.component_id for r in got if r.doc_id in (9, None)} == {9}
    assert simhash.near_components(df.limit(0)).count() == 0
    assert simhash.keep_one(df).count() == 4
