import corpus_pipeline
from paygrove.llm import bpe, rules

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    """Each stage against its brute-force meaning on the rows the last one kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, rows = docs.columns, docs.collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        got = out.collect()
        if name == "quality_rules":
            led = {r.doc_id for r in rules.apply_policy(rules.ledger(docs), rules.STRICT).filter("kept").collect()}
            assert {r.doc_id for r in got} == led
        elif name == "exact_dedup":
            first = {}
            for r in rows:
                key = " ".join(__import__("re").split(r"[\x20\x09-\x0D]+", r.text or ""))
                first[key] = min(r.doc_id, first.get(key, r.doc_id))
            assert sorted(r.doc_id for r in got) == sorted(first.values())
        elif name == "near_dedup":
            from tests.llm.test_bpe_simhash import plain_components, plain_print

            low = plain_components([(r.doc_id, plain_print(r.text)) for r in rows])
            assert sorted(r.doc_id for r in got) == sorted(set(low.values()))
        elif name == "mixing":
            assert {r.doc_id for r in got} <= {r.doc_id for r in rows}
            assert max(sum(1 for x in got if x.doc_id == r.doc_id) for r in got) <= 2
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(bpe.default_path())
            assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((r.doc_id, len(t.encode(r.text, add_special_tokens=False).ids)) for r in rows)
            continue
        assert out.columns == cols
        docs, rows = out, got


def test_odd_rows(spark):
    """Nulls everywhere, repeated rows and clashing extra columns pass through all stages."""
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)] + [(k, " ".join(f"w{k}x{j}" for j in range(80)), None, None if k % 2 else "s", None) for k in (5, 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as kept", "'a' as f", "2 as copies")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} <= {5, 6, 7}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
