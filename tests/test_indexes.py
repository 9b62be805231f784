"""The persistent indexes: recall against brute force, folders and postings that a search doesn't read, odd rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackroom.operators import retrieval
from stackroom.operators.sparse_index import SparseIndex, pruned, query_weights
from stackroom.operators.vector_index import VectorIndex, recall
from stackroom.sources import store


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 24))
    return (centers[rng.integers(0, 40, 2000)] + 0.25 * rng.normal(size=(2000, 24))).astype("float32")


@pytest.fixture(scope="module")
def vectors(spark, clustered):
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(clustered)] + [(5000, None, 0), (5001, [0.0] * 24, 1), (5002, [float("nan")] * 24, 1), (5003, [1.0, 2.0], 2), (5004, [1.0, None] * 12, 2), (5005, [], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)


@pytest.fixture(scope="module")
def index(spark, vectors):
    return VectorIndex.build(vectors, store.scratch(spark, "ivf"), keep=("label",))


def asked(vectors, every=20):
    return vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def brute(m, q, k, allowed=None):
    m = m.astype("float64")
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = np.round(m @ m[q], 6)
    return [(i, near[i]) for i in sorted((i for i in range(len(m)) if allowed is None or i % 4 == allowed), key=lambda i: (-near[i], i))[:k]]


def test_recall_with_few_lists(spark, index, vectors, clustered):
    assert index.nprobe < len(index.centroids) / 2
    exact = index.search(asked(vectors), 10, exact=True)
    want = {(q, r, i, round(float(s), 6)) for q in range(0, 2000, 20) for r, (i, s) in enumerate(brute(clustered, q, 10), 1)}
    assert {(r.query, r["rank"], r.vec_id, round(r.score, 6)) for r in exact.collect()} == want
    got = recall(index.search(asked(vectors), 10), exact).head()
    assert got.queries == 100 and got.recall >= 0.9


def test_search_reads_only_lists_of_its_queries(index, vectors):
    one = asked(vectors, 5000).limit(1)
    plan = index.search(one, 5, nprobe=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan
    flags = index.probes(np.ones((3, index.dim)), 2)
    assert flags.sum(1).tolist() == [2, 2, 2]


def test_filter_open_and_add(spark, index, vectors, clustered):
    again = VectorIndex.open(spark, index.path)
    got = again.search(asked(vectors, 500), 3, where=F.col("label") == 3, exact=True).collect()
    assert {(r.query, r.vec_id) for r in got} == {(q, i) for q in range(0, 2000, 500) for i, _ in brute(clustered, q, 3, 3)}
    assert again.rows(spark).count() == vectors.count()
    other = VectorIndex.build(vectors.filter("vec_id < 1000"), store.scratch(spark, "ivf"), keep=("label",))
    other.add(vectors.filter("vec_id >= 1000").select("vec_id", "embedding", "label"))
    assert {r.vec_id for r in other.search(asked(vectors, 5000).limit(1), 2000, exact=True).collect()} == set(range(2000))


def test_odd_vectors_and_empty_tables(spark, index, vectors):
    odd = spark.createDataFrame([("a", None), ("b", [0.0] * 24), ("c", [1.0])], "query string, vector array<double>")
    assert index.search(odd, 5).collect() == []
    assert index.search(asked(vectors).filter("false"), 5).collect() == []
    none = VectorIndex.build(vectors.filter("false"), store.scratch(spark, "ivf"))
    assert none.search(asked(vectors, 1000), 5).collect() == []


def test_index_that_lacks_columns_is_not_thrown_away(spark, vectors):
    path, some = store.scratch(spark, "ivf"), vectors.filter("vec_id < 50")
    first = VectorIndex.ensure(some, path)
    assert VectorIndex.ensure(vectors, path).rows(spark).count() == first.rows(spark).count() == 50  # it is there already
    with pytest.raises(RuntimeError, match="label"):
        VectorIndex.ensure(vectors, path, keep=("label",))
    assert "label" in VectorIndex.ensure(some, path, keep=("label",), recreate=True).rows(spark).columns


def skewed_postings(n=2000, seed=2):
    """Keys whose heavy tokens lie together, so that most ranges can't reach the best scores."""
    r = random.Random(seed)
    return [(k, t, round((5.0 if k // 100 == 7 else 1.0) * r.random() + 0.01, 4)) for k in range(n) for t in ("a", "b", "c", "dé") if r.random() < 0.7]


def best(postings, queries, k):
    scores = defaultdict(Counter)
    for q, t, w in queries:
        for key, token, weight in postings:
            if token == t:
                scores[q][key] += w * weight
    return {(q, r, key, round(s, 5)) for q, c in scores.items() for r, (key, s) in enumerate(sorted(c.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k], 1)}


def test_blocks_that_cannot_reach_the_best_are_not_read(spark):
    rows, asked = skewed_postings(), [(1, "a", 1.0), (1, "b", 0.5), (2, "dé", 2.0), (3, "zz", 1.0), (4, "a", 0.1)]
    postings = spark.createDataFrame(rows, "doc_id long, token string, weight double")
    queries = spark.createDataFrame(asked, "query long, token string, weight double")
    index = SparseIndex.build(postings, store.scratch(spark, "sparse"), drop=0.0, range_size=50)
    got = SparseIndex.open(spark, index.path).search(queries, 5)
    assert {(r.query, r["rank"], r.doc_id, round(r.score, 5)) for r in got.collect()} == best(rows, asked, 5)
    first, rest = index.waves(queries, 5)
    read = sum(r.n for r in first.unionByName(rest).select("n").collect())
    whole = index.bounds(queries).agg(F.sum("n")).head()[0]
    assert whole == sum(t == w for _, w, _ in asked for _, t, _ in rows)
    assert read < whole / 3


def test_more_tokens_than_a_filter_holds(spark, monkeypatch):
    from stackroom.operators import sparse_index

    rows, asked = skewed_postings(300), [(1, "a", 1.0), (1, "b", 0.5), (1, "c", 0.2)]
    index = SparseIndex.build(spark.createDataFrame(rows, "doc_id long, token string, weight double"), store.scratch(spark, "sparse"), drop=0.0)
    monkeypatch.setattr(sparse_index, "MOST_NAMED", 2)
    queries = spark.createDataFrame(asked, "query long, token string, weight double")
    empty = SparseIndex.build(spark.createDataFrame([], "doc_id long, token string, weight double"), store.scratch(spark, "sparse"))
    assert empty.search(queries, 5).collect() == []
    got = index.search(queries, 400)
    assert {(r.query, r["rank"], r.doc_id, round(r.score, 5)) for r in got.collect()} == best(rows, asked, 400)


def test_drop_quantile_and_query_weights(spark):
    texts = spark.createDataFrame([(1, "a a a b b c D"), (2, ""), (3, None)], "item long, text string")
    got = {(r.query, r.token): round(r.weight, 6) for r in query_weights(texts, query="item", drop=0.5).collect()}
    weights = sorted(math.log1p(n) for n in (3, 2, 1, 1))
    assert got == {(1, t): round(math.log1p(n), 6) for t, n in (("a", 3), ("b", 2)) if math.log1p(n) >= (weights[1] + weights[2]) / 2}
    assert pruned(retrieval.postings(texts, "item"), "item", 0.0).count() == 4


def test_index_of_texts_shuffles_only_texts(spark, tmp_path, monkeypatch):
    """What is written comes from one exchange, which deals texts by range; duplicates of a key are one text."""
    from pyspark.sql import DataFrameWriter

    texts = [(i % 700, f"common w{i % 5} w{i % 5} rare{i}") for i in range(900)]
    docs, plans, save = spark.createDataFrame(texts, "doc_id long, text string"), [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (plans.append((path, self._df._jdf.queryExecution().sparkPlan().toString(), self._df._jdf.queryExecution().executedPlan().toString())), save(self, path, *a, **b))[1])
    index = SparseIndex.of_texts(docs, f"{tmp_path}/index", drop=0.2)
    plan = next(p for path, _, p in plans if path.endswith("/blocks"))
    assert plan.count("Exchange") == 1
    got = {(t, k): w for t, keys, ws in spark.read.parquet(f"{tmp_path}/index/blocks").select("token", "keys", "weights").collect() for k, w in zip(keys, ws)}
    want = {(r.token, r.doc_id): r.weight for r in pruned(retrieval.postings(docs), "doc_id", 0.2).collect()}
    assert got == want and index.key == "doc_id"
