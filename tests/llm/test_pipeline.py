import collections

import public_tokenizers as P

import corpus_pipeline as cp
from murmur.llm import bpe, quality_rules


def test_stages_follow_their_contract(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    seen = {}
    for name, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, sf), f"test-{name}")
        seen[name] = docs
        if name != "encoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 0 < seen["quality_rules"].count() < before
    assert all(not quality_rules.stats(r.text)[0][0] < 50 for r in seen["quality_rules"].collect())
    ids = [r.doc_id for r in seen["near_dedup"].select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and len(ids) < seen["quality_rules"].count()
    assert seen["secret_scan"].count() == len(ids)
    v = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = collections.defaultdict(set)  # a document drawn twice may have a copy that its source's cut shortens
    for r in seen["mixing"].collect():
        texts[r.doc_id].add(r.text)
        assert r.n_chars == len(r.text)
    assert docs.count() == seen["mixing"].count()
    for r in docs.limit(20).collect():
        assert v.decode(r.ids).decode() in texts[r.doc_id]
