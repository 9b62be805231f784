"""Persistent indexes over the driver's tables: inverted lists of vectors, blocks of sparse postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.operators import retrieval
from stackroom.operators.sparse_index import SparseIndex, query_weights
from stackroom.operators.vector_index import VectorIndex, recall
from stackroom.sources.store import scratch

from .registry import query, table

_TOKENS = "SELECT {0} AS k, unnest(string_split_regex(lower(text), '[ \\n]+')) AS t FROM {1}"
_POSTINGS = "SELECT k, t, ln(1 + count(*)) AS w FROM (" + _TOKENS + ") WHERE t <> '' GROUP BY k, t"
_DROPPED = "SELECT k, t, w FROM (SELECT *, quantile_cont(w, 0.2) OVER (PARTITION BY k) AS least FROM ({0})) WHERE w >= least"


@query(_POSTINGS.format("doc_id", "documents").replace("SELECT k, t, ln(1 + count(*)) AS w", "SELECT k AS doc_id, t AS token, round(ln(1 + count(*)), 6) AS weight"))
def vec01_sparse_weights(spark, d) -> DataFrame:
    return retrieval.postings(table(spark, d, "documents")).select("doc_id", "token", F.round("weight", 6).alias("weight"))


@query(f"""WITH w AS (SELECT k, md5(t) AS m FROM ({_TOKENS.format('doc_id', 'documents')}) WHERE t <> ''), s AS (SELECT k, CAST(('0x' || substr(m, 1, 4))::BIGINT % 64 AS INTEGER) AS bucket, sum(CASE WHEN substr(m, 5, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0 END) AS v FROM w GROUP BY ALL HAVING v <> 0)
    SELECT k AS doc_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY k)), 6) AS value FROM s""")
def vec01_dense_hashed(spark, d) -> DataFrame:
    return retrieval.dense_hashed(table(spark, d, "documents"))


def _asked(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def _vectors(spark, d) -> VectorIndex:
    return VectorIndex.build(table(spark, d, "embeddings"), scratch(spark, "vectors"), keep=("label",))


_UNIT = "SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings"


@query(f"WITH v AS ({_UNIT}), s AS (SELECT q.vec_id AS query, v.vec_id, round(list_dot_product(q.e, v.e) / (q.n * v.n), 6) AS score FROM v q, v WHERE q.vec_id % 20 = 0 AND q.n > 0 AND v.n > 0) SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10")
def vec02_exact_topk(spark, d) -> DataFrame:
    """The exact way beside the index: every list is read for every query."""
    return _vectors(spark, d).search(_asked(spark, d), 10, exact=True)


@query()
def vec02_ivf_topk(spark, d) -> DataFrame:
    """Ten nearest of every query by the lists near it; vec02_ivf_recall holds them against the exact way."""
    return _vectors(spark, d).search(_asked(spark, d), 10)


@query("SELECT count(*) AS queries, CAST(sum(least(10, n)) AS BIGINT) AS wanted, true AS enough FROM (SELECT q.vec_id, (SELECT count(*) FROM embeddings) AS n FROM embeddings q WHERE q.vec_id % 20 = 0)")
def vec02_ivf_recall(spark, d) -> DataFrame:
    """Whether the index finds nine of ten exact hits, over all queries."""
    index, asked = _vectors(spark, d), _asked(spark, d)
    return recall(index.search(asked, 10), index.search(asked, 10, exact=True)).select("queries", "wanted", (F.col("recall") >= 0.9).alias("enough"))


@query("WITH v AS (" + _UNIT + "), s AS (SELECT q.vec_id AS query, v.vec_id, round(list_dot_product(q.e, v.e) / (q.n * v.n), 6) AS score FROM v q, v WHERE q.vec_id % 20 = 0 AND v.label = 3 AND q.n > 0 AND v.n > 0) SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5")
def vec02_filtered_topk(spark, d) -> DataFrame:
    """A filter on a kept column is part of the scan."""
    return _vectors(spark, d).search(_asked(spark, d), 5, where=F.col("label") == 3, exact=True)


def _sparse_sql(documents: str) -> str:
    return f"""WITH p AS ({documents}), q AS ({_DROPPED.format(_POSTINGS.format('item_id', 'benchmark'))}),
        s AS (SELECT q.k AS query, p.k AS doc_id, round(sum(p.w * q.w), 6) AS score FROM p JOIN q USING (t) GROUP BY ALL)
        SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s QUALIFY rank <= 10"""


def _sparse(spark, d, drop: float) -> DataFrame:
    index = SparseIndex.of_texts(table(spark, d, "documents"), scratch(spark, "postings"), drop=drop)
    return index.search(query_weights(table(spark, d, "benchmark"), query="item_id"), 10)


@query(_sparse_sql(_POSTINGS.format("doc_id", "documents")))
def vec03_index_topk(spark, d) -> DataFrame:
    return _sparse(spark, d, 0.0)


@query(_sparse_sql(_DROPPED.format(_POSTINGS.format("doc_id", "documents"))))
def vec03_index_dropped(spark, d) -> DataFrame:
    """Small weights are dropped when the index is built, as well as from the query."""
    return _sparse(spark, d, 0.2)
