"""The pipeline: each stage keeps the columns, its decisions take effect, all but the copies and the bad rows stay."""

from collections import Counter

import corpus_pipeline
from stackroom.llm import simhash


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        docs = docs.cache()
        assert 0 < docs.count() <= n
        n = docs.count()
    texts = [r.text for r in docs.collect()]
    assert len({"".join(t.split()) for t in texts}) == len(texts)
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    assert not [1 for i, a in enumerate(sets) for b in sets[:i] if len(a & b) >= 0.8 * len(a | b)]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    whole = Counter()
    for r in packed:
        whole[r.doc_id] += r.length
    assert all(whole[r.doc_id] == r.doc_tokens for r in packed)


def test_empty_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
