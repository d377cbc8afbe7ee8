import hashlib
import random
import re

from paygrove.llm import fim
from paygrove.llm.queries import op11_fill_in_middle

ODD = [None, "", " ", "a", "abc", "a b", "a<P>b", "x<S>", "<M>", "<", "<P", "a<<S", "日本語 テスト🙂é", "A1b2\n\tC", "word " * 4000, "x" * 70000, "🙂" * 3000 + "ab", "a\x00b", "KKſ ab"]


def plain_fim(i, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    hexed = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_skip_list_offsets():
    rng = random.Random(5)
    for size in (0, 1, 7, 8, 9, 500, 20000):
        text = "".join(rng.choice("ab <.é🙂") for _ in range(size))
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        lanes = fim.SkipList(text)
        assert lanes.n == len(units)
        upto = [0]
        for u in units:
            upto.append(upto[-1] + len(u))
        for r in sorted({0, len(units), *(rng.randrange(len(units) + 1) for _ in range(200))}):
            assert lanes.offset(r) == upto[r]
        if len(units) > 1000:
            assert len(lanes.lanes) > 3
            for unit, char, _ in lanes.lanes:
                assert unit.sum() == len(units) and char.sum() == len(text)


def test_transform_equals_plain(spark):
    rows = [(i, t, "n", "output") for i, t in enumerate(ODD * 12)] + [(None, "no id", "x", "y"), (3, "twice", "", ""), (3, "twice", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, output string")
    out = fim.transform(df)
    out = out.withColumn("back", fim.restored(out.output, out.form)).collect()
    assert len(out) == len(rows)
    forms = set()
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text)
        assert r.back == r.text
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).count() == 0


def test_query_over_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op11_fill_in_middle(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        n, form, p, m, output = plain_fim(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
