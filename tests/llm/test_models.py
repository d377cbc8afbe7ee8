import json
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paygrove.llm import chat, langid, lm, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in want if got[i].held_out]
    assert np.mean([got[i].lang_pred == want[i] for i in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de")] * 20
    odd = [(100, None, "en"), (101, "", None), (102, "123 !!", "de"), (None, "und der hund", None), (103, "the dog " * 20000, None)]
    df = spark.createDataFrame([(i + 10 * k, t, g) for k, (i, t, g) in enumerate(rows)] + odd, "doc_id long, text string, lang string").withColumnRenamed("lang", "lang")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[None].lang_pred == "de" and not got[None].held_out and got[103].lang_pred == "en"
    none = langid.identify(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_language_clashing_columns_and_far_letters(spark):
    rows = [(k, "der hund und die katze" if k % 2 else "the cat and the dog", "de" if k % 2 else "en") for k in range(40)] + [(100, "\U00030010" * 5, None), (100, "\U00030010" * 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as share", "2 as l", "3 as i", "4 as t", "5 as idx", "6 as score", "true as held_out")
    got = langid.identify(df).collect()
    assert len(got) == 42 and all(r.lang_pred in ("de", "en") for r in got)  # those letters are letters, so not und


def test_filter_has_no_false_negatives():
    f = langid.Filter(["a", "b"], np.zeros((1, langid.CELLS), np.uint64))
    g = langid._grams(langid._codes("some words of a language"))[2]
    for p in f.places(g):
        f.cells[0][p] |= np.uint64(2)
    said, score = f.decide(["some words of a language"])
    assert said == ["b"] and score[0] == 1.0


def plain_marginals(e, m):
    """By enumeration of all labellings."""
    from itertools import product

    z, p = 0.0, np.zeros(len(e))
    for y in product((0, 1), repeat=len(e)):
        s = m.start * y[0] + sum(e[i] * y[i] for i in range(len(e))) + sum(m.step[y[i - 1]][y[i]] for i in range(1, len(e)))
        z += np.exp(s)
        p += np.exp(s) * np.array(y)
    return p / z


def test_marginals():
    m = toxicity.Model(np.zeros(1), -0.7, np.array([[0.0, -1.0], [0.2, 0.8]]))
    rng = np.random.default_rng(0)
    docs = [rng.normal(size=n) for n in (5, 1, 9, 3)]
    got = toxicity.marginals(np.concatenate(docs), np.array([0, 5, 1, 0, 9, 3]), m)
    assert got == pytest.approx(np.concatenate([plain_marginals(d, m) for d in docs]))
    long = rng.normal(size=1000)
    a = toxicity.marginals(long, np.array([1000]), m)
    f = np.zeros((1000, 2))
    t = np.exp(m.step)
    f[0] = 1, np.exp(m.start + long[0])
    for i in range(1, 1000):
        f[i] = (f[i - 1] @ t) * (1, np.exp(long[i]))
        f[i] /= f[i].sum()
    b, want = np.ones(2), np.zeros(1000)
    for i in range(999, -1, -1):
        want[i] = f[i, 1] * b[1] / (f[i] @ b)
        b = t @ (b * (1, np.exp(long[i])))
        b /= b.sum()
    assert a == pytest.approx(want)


def test_pair_marginals():
    """Against enumeration of all labellings."""
    from itertools import product

    m = toxicity.Model(np.zeros(1), -0.7, np.array([[0.0, -1.0], [0.2, 0.8]]))
    rng = np.random.default_rng(5)
    docs = [rng.normal(size=n) for n in (1, 4, 7)]
    _, p01, p11 = toxicity.posteriors(np.concatenate(docs), np.array([1, 4, 7]), m, pairs=True)
    at = 0
    for e in docs:
        z, want = 0.0, np.zeros((len(e), 2))
        for y in product((0, 1), repeat=len(e)):
            w = np.exp(m.start * y[0] + sum(e[i] * y[i] for i in range(len(e))) + sum(m.step[y[i - 1]][y[i]] for i in range(1, len(e))))
            z += w
            for i in range(1, len(e)):
                want[i, y[i - 1]] += w * y[i]
        assert np.stack([p01[at : at + len(e)], p11[at : at + len(e)]], 1) == pytest.approx(want / z)
        at += len(e)
    long = rng.normal(size=500)
    p, p01, p11 = toxicity.posteriors(long, np.array([500]), m, pairs=True)
    assert (p01 + p11)[1:] == pytest.approx(p[1:])  # also across blocks


def test_toxicity_clashing_columns(spark):
    docs = spark.createDataFrame([(k, "you scoundrel here" if k % 4 == 0 else "plain things") for k in range(200)], "doc_id long, text string").selectExpr("*", "1 as y", "2 as t", "3 as i", "'a' as __i", "true as held_out")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int").selectExpr("*", "5 as y", "6 as text")
    assert toxicity.score(docs, labels).count() == 200


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    r = {x.doc_id: x for x in toxicity.score(docs, labels).collect()}
    held = [(x.toxic, r[x.doc_id].predicted) for x in labels.collect() if r[x.doc_id].held_out]
    assert sum(p for y, p in held if not y) <= 0.02 * len(held)
    assert np.mean([p for y, p in held if y]) > 0.7


def test_toxicity_edge_cases(spark):
    rows = [(k, f"some plain words {'you scoundrel here' if k % 4 == 0 else 'about plain things'} and more") for k in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "a SCOUNDREL, " + "word " * 30000)], "doc_id long, text string").selectExpr("*", "1 as score")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score(docs, labels, spans=True).collect()}
    assert got[1000].score == got[1001].score and got[1000].predicted == 0 and got[1000].spans == []
    s = got[1002].spans
    assert len(s) >= 1 and "scoundrel" in ("a SCOUNDREL, ".lower() + "word ")[s[0].begin : s[0].end]
    assert all(got[k].predicted == int(k % 4 == 0) for k in range(400))
    plain = toxicity.score(docs, labels.filter("toxic = 0")).collect()
    assert max(x.score for x in plain) < 0.01
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_lm_prefers_the_corpus_order(spark):
    df = spark.createDataFrame([(k, "the cat sat on a mat while the dog ran in a park " * 20) for k in range(40)] + [(100, None), (101, " "), (102, "unseen zebra " * 3)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.pseudo_likelihood(df).collect()}
    assert got[100].pll == 0 and got[100].mean_pll is None and got[101].n_tokens == 0
    assert got[102].mean_pll < got[0].mean_pll < 0
    lexicon, corpus = lm.coded(df, "doc_id", "text", 1000, lm.word_table(df))
    net = lm.train(corpus, lexicon.tables)
    ws = ("the cat sat on a mat while the dog ran in a park " * 5).encode().split()
    mixed = list(np.random.default_rng(0).permutation(np.array(ws, object)))

    def score(x):
        k, t = lexicon.places(x), lexicon.tables
        return (t.log_p[k] + net.log_probs(lm._windows(t.seen[k], np.array([len(x)])), t.classes[k], t.within[k])).sum()

    assert score(ws) > score(mixed) + 10
    assert lm.pseudo_likelihood(df.limit(0)).count() == 0


def test_lm_trains_on_every_position(spark):
    """The positions that tasks say they learned from add up to all words, once over the rounds."""
    df = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 7}" for j in range(k % 50))) for k in range(300)] + [(900, None)], "doc_id long, text string").repartition(9)
    lexicon, corpus = lm.coded(df, "doc_id", "text", 1000, lm.word_table(df))
    assert corpus.selectExpr("sum(aggregate(sizes, 0, (a, x) -> a + x))").first()[0] == sum(k % 50 for k in range(300))
    shared = spark.sparkContext.broadcast((lexicon.tables, lm.Net().flat))
    n = 0
    for turn in range(lm.ROUNDS):
        own = corpus.filter(F.pmod(F.xxhash64("b"), F.lit(lm.ROUNDS)) == turn).select("sizes", "codes")
        last = own.mapInArrow(lm._trained(shared), "salt int, block int, v binary").collect()
        n += sum(int(np.frombuffer(r.v, "<i8")[-1]) for r in last if r.block == max(x.block for x in last))
    assert n == sum(k % 50 for k in range(300))


def plain_score(ws, n, top, net):
    """Word by word, with plain softmaxes over all classes and over a block."""
    block = {w: k for k, w in enumerate(top[: lm.BLOCKS * lm.BLOCK])}
    own = {w: k for k, w in enumerate(top[: lm.OWN])}
    rest = Counter()
    for w, c in n.items():
        if w not in block:
            rest[lm.ending(w)] += c
    total = 0.0
    for at, w in enumerate(ws):
        h = net.bias.astype(float)
        for k, off in enumerate(lm.AROUND):
            x = ws[at + off] if 0 <= at + off < len(ws) else None
            h = h + net.near[k][lm.SEEN if x is None else own.get(x, lm.OWN + lm.ending(x))]
        h = np.tanh(h)
        soft = lambda z: z - np.log(np.exp(z).sum())
        h = np.append(h, 1.0)
        z = soft(h @ net.out)
        if w in block:
            b, m = divmod(block[w], lm.BLOCK)
            total += z[b] + soft(h @ net.inner[b])[m]
        else:
            total += z[lm.BLOCKS + lm.ending(w)] + np.log((n[w] - 1 + lm.OTHERS) / rest[lm.ending(w)])
    return total


def test_lm_equals_plain_scores(spark, monkeypatch):
    """Also repeated rows, nulls, very long texts and clashing columns; all words have their own count, in the broadcast or not."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in np.minimum(rng.geometric(0.03, n), 200)) for n in rng.integers(1, 60, 50)]
    texts += ["seen-once alone", "Twice-ab twice-ab", "", None, "w1 w2 " * 3000]
    texts += [" ".join(f"many{k * 7}" for k in range(4500))] * 2 + texts[:3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as b", "'x' as w", "2 as n", "3 as pll").repartition(3)
    n = Counter(w for t in texts for w in lm.words(t))
    nets = []
    plain = lm.train
    monkeypatch.setattr(lm, "train", lambda *a: nets.append(plain(*a)) or nets[-1])
    for vocab in (150, lm.VOCAB):
        got = lm.pseudo_likelihood(df, vocab=vocab).collect()
        assert sorted(r.doc_id for r in got) == list(range(len(texts)))
        top = sorted((w for w in n if n[w] > 1), key=lambda w: (-n[w], w))
        cut = [w for w in top if sum(n[x] >= n[w] for x in top) <= vocab]
        for r in got:
            ws = lm.words(texts[r.doc_id])
            assert r.n_tokens == len(ws) and r.n_alone == sum(n[w] == 1 for w in ws)
            assert r.pll == pytest.approx(plain_score(ws, n, cut, nets[-1]), rel=1e-4, abs=1e-3), r.doc_id
            assert r.mean_pll == (r.pll / len(ws) if ws else None)


def test_lm_gradient():
    """Against differences of the log probability."""
    rng = np.random.default_rng(1)
    net = lm.Net()
    ctx = rng.integers(0, lm.SEEN + 1, (4, 40)).astype(np.int16)
    c = rng.integers(0, lm.CLASSES, 40).astype(np.int16)
    m = np.where(c < lm.BLOCKS, rng.integers(0, lm.BLOCK, 40), -1).astype(np.int16)
    grad = net.gradient(ctx, c, m)
    some = np.concatenate([rng.choice(np.flatnonzero(np.abs(grad) > 1e-4), 60), rng.integers(0, len(grad), 10)])
    for k in some:
        sides = []
        for d in (0.01, -0.01):
            flat = net.flat.copy()
            flat[k] += d
            sides.append(-lm.Net(flat).log_probs(ctx, c, m).astype(float).mean())
        assert grad[k] == pytest.approx((sides[0] - sides[1]) / 0.02, abs=2e-4)


def test_lm_blocks_are_spans_of_one_order(monkeypatch):
    """A step orders its positions by class once: no block copies its rows out, and results come back in the given order."""
    copies = []

    class Rows(np.ndarray):
        def __getitem__(self, at):
            copies.append(isinstance(at, np.ndarray))
            return super().__getitem__(at)

    rng = np.random.default_rng(3)
    ctx = rng.integers(0, lm.SEEN + 1, (4, 500)).astype(np.int16)
    c = rng.integers(0, lm.CLASSES, 500).astype(np.int16)
    m = np.where(c < lm.BLOCKS, rng.integers(0, lm.BLOCK, 500), -1).astype(np.int16)
    net, plain = lm.Net(), lm.Net.hidden
    apart = np.concatenate([net.log_probs(ctx[:, k : k + 1], c[k : k + 1], m[k : k + 1]) for k in range(500)])
    steps = [net.gradient(ctx[:, k : k + 1], c[k : k + 1], m[k : k + 1]) for k in range(500)]
    monkeypatch.setattr(lm.Net, "hidden", lambda *a: plain(*a).view(Rows))
    assert np.allclose(net.log_probs(ctx, c, m), apart, atol=1e-5)
    assert np.allclose(net.gradient(ctx, c, m), np.mean(steps, 0), atol=1e-6)
    assert copies and not any(copies)
    for some in (c < lm.BLOCKS, c >= lm.BLOCKS, c < 0):
        assert np.allclose(net.log_probs(ctx[:, some], c[some], m[some]), apart[some], atol=1e-5)


def test_quotes(spark):
    conv = [
        (1, 0, "user", "How do I sort?\nIt is slow."), (1, 1, "assistant", "Use an index."),
        (1, 2, "user", "On Monday X wrote:\n> Use an INDEX.\nWhich one?"), (1, 3, "assistant", "> > Use an index.\n> Which one?\nThe first."),
        (1, 4, "user", "> nobody said this\n> it is  slow.\nThanks"), (2, 0, "user", "Use an index."), (2, 1, "user", "> The first."), (3, 0, None, None), (None, 0, "user", "x"), (None, 1, "user", "> x\nyes"),
        (4, 0, "user", "same"), (4, 1, "user", "same"), (4, 2, "user", "> same\n"), (4, 2, "user", "> same\n"),
    ]
    df = spark.createDataFrame(conv, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as depth", "9 as ck")
    got = {(r.conv_id, r.turn): r for r in chat.link_quotes(df).collect()}
    assert chat.link_quotes(df).count() == len(conv)
    assert got[1, 2].text == "Which one?" and got[1, 2].reply_to == 1 and got[1, 2].depth == 1 and got[1, 2].thread == 1
    assert got[1, 3].reply_to == 2 and got[1, 3].depth == 2 and got[1, 3].thread == 1 and got[1, 3].n_linked == 2
    assert got[1, 4].reply_to == 0 and got[1, 4].n_quoted == 2 and got[1, 4].n_linked == 1 and got[1, 4].text == "Thanks"
    assert got[2, 1].reply_to is None and got[2, 1].depth == 0
    assert got[None, 1].reply_to == 0 and got[4, 2].reply_to == 1 and got[3, 0].text == ""
    assert [t for (c, t), r in sorted(((k, r) for k, r in got.items() if k[0] == 1), key=lambda x: x[1].position)] == [0, 4, 1, 2, 3]
    assert chat.link_quotes(df.limit(0)).count() == 0


def plain_links(messages):
    """(conv, turn) -> (text, quoted, linked, reply_to, depth, thread), and each conversation's order of (thread, turn)."""
    by = {}
    for c, n, _, t in messages:
        by.setdefault(c, []).append((n, *chat.parse(t)))
    out = {}
    for c, rows in by.items():
        rows.sort(key=lambda r: r[0])
        reply = {}
        for n, own, _, quoted in rows:
            hits = []
            for level, h in quoted:
                before = [m for m, _, mine, _ in rows if m < n and h in mine]
                hits.append((level, max(before) if before else None))
            first = Counter(m for level, m in hits if level == 1 and m is not None)
            to = max(first, key=lambda m: (first[m], m)) if first else None
            reply[n] = to
            out[c, n] = [own, len(quoted), sum(m is not None for _, m in hits), to]
        for n in reply:
            depth, at = 0, n
            while reply.get(at) is not None:
                depth, at = depth + 1, reply[at]
            out[c, n] += [depth, at]
    return out


def test_quotes_equal_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    want = plain_links(rows)
    got = chat.link_quotes(df.selectExpr("*", "1 as r", "2 as ck", "'z' as h", "3 as part")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [r.text, r.n_quoted, r.n_linked, r.reply_to, r.depth, r.thread] == want[r.conv_id, r.turn]
    for part in (2, 256):
        convs = chat.conversations(df, part=part).collect()
        whole = {}
        for c in sorted(convs, key=lambda c: c.part):
            assert c.n_messages == len(c.messages) <= part
            whole.setdefault(c.conv_id, []).extend(c.messages)
        assert sum(map(len, whole.values())) == len(rows)
        for c, ms in whole.items():
            assert [m.position for m in ms] == list(range(1, len(ms) + 1))
            assert [(m.thread, m.turn) for m in ms] == sorted((m.thread, m.turn) for m in ms)


def test_one_conversation_has_most_rows(spark):
    """Everybody quotes the first turn of one conversation; a very long text is in it."""
    rows = [(1, 0, "user", "first line")] + [(1, k, "user", "> first line\nown " + str(k)) for k in range(1, 600)] + [(2, 0, "user", "x " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = chat.link_quotes(df).collect()
    assert sorted(r.position for r in got if r.conv_id == 1) == list(range(1, 601))
    assert all(r.reply_to == 0 and r.depth == 1 for r in got if r.conv_id == 1 and r.turn > 0)
    assert chat.conversations(df).count() == 4


def test_long_thread(spark):
    df = spark.createDataFrame([(1, 0, "user", "line 0")] + [(1, k, "user", f"> line {k - 1}\nline {k}") for k in range(1, 70)], "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in chat.link_quotes(df).collect()}
    assert all(got[k].depth == k and got[k].thread == 0 for k in range(70))


def test_parse_levels():
    own, mine, quoted = chat.parse(">> deep\n> near\nown\n\n\n\n\nmore")
    assert own == "own\n\nmore" and len(mine) == 2 and [q[0] for q in quoted] == [2, 1]
    assert json.dumps(chat.level_of("  > > x")) == '[2, "x"]'


def test_toxic_sample_is_bounded(spark):
    """One id in half of all rows, repeated labels and very long texts: the sample keeps its bound and its order."""
    docs = spark.range(4000).selectExpr("if(id % 2 = 0, 1, id) as doc_id", "concat('text ', id % 7) as text")
    docs = docs.union(spark.sql("select 3 as doc_id, repeat('long ', 10000) as text"))
    labels = spark.range(4000).selectExpr("id as doc_id", "int(id % 3 = 0) as toxic").union(spark.sql("select 7L as doc_id, 1 as toxic"))
    a = toxicity.sample(docs, labels, "doc_id", "text", "toxic", 50).collect()
    assert len(a) <= 100 and max(len(r.t) for r in a) <= toxicity.LONGEST
    assert sorted(a) == sorted(toxicity.sample(docs.repartition(5), labels.repartition(3), "doc_id", "text", "toxic", 50).collect())
    assert toxicity.sample(docs.limit(0), labels, "doc_id", "text", "toxic", 50).count() == 0
