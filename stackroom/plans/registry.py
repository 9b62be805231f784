"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def book_of(doc_id):
    return F.format_string("b%06d", F.floor(doc_id / 8))


#: The binding of chunks to documents, in both languages.
CHUNKS = """chunks AS (SELECT doc_id, 'b' || lpad(CAST(doc_id // 8 AS VARCHAR), 6, '0') AS book_id, CAST(doc_id % 8 - 1 AS INTEGER) AS chunk_idx,
    CAST(2000 + doc_id % 25 AS VARCHAR) AS pub_date, ['paper', 'book', 'literature', 'policy'][doc_id % 4 + 1] AS doc_type, coalesce(text, '') AS text, doc_id % (SELECT count(*) FROM embeddings) AS vec_id, source, lang FROM documents)"""


def n_vectors(spark: SparkSession, sf_dir: str):
    """The number of embeddings, one at least: a subquery of the plan, so building a plan runs nothing."""
    return table(spark, sf_dir, "embeddings").agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    kinds = F.array(*map(F.lit, ("paper", "book", "literature", "policy")))
    return d.select("doc_id", book_of(i).alias("book_id"), (i % 8 - 1).cast("int").alias("chunk_idx"), (2000 + i % 25).cast("string").alias("pub_date"), F.get(kinds, (i % 4).cast("int")).alias("doc_type"), F.coalesce("text", F.lit("")).alias("text"), (i % n_vectors(spark, sf_dir)).alias("vec_id"), "source", "lang")


ITEMS = """items AS (SELECT event_id AS id, user_id % 10 AS job_id, 'b' || CAST(event_id AS VARCHAR) AS book_id,
    CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'dispatched' WHEN 'signup' THEN 'done' WHEN 'purchase' THEN 'running' ELSE 'failed' END AS status,
    ['pending', 'extracted', 'summarized', 'indexed', 'finalized'][k % 5 + 1] AS stage, k % 4 AS attempt, ts AS updated_at,
    CASE WHEN event_type = 'error' AND k % 3 > 0 THEN ['llm_timeout', 'milvus_error'][k % 3] END AS error_group, 'error ' || CAST(k AS VARCHAR) AS last_error, value, k
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "dispatched").when(F.col("event_type") == "signup", "done").when(F.col("event_type") == "purchase", "running").otherwise("failed")
    stages = F.array(*map(F.lit, ("pending", "extracted", "summarized", "indexed", "finalized")))
    group = F.when((F.col("event_type") == "error") & (k % 3 > 0), F.get(F.array(F.lit("llm_timeout"), F.lit("milvus_error")), k % 3 - 1))
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("job_id"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("book_id"), status.alias("status"), F.get(stages, k % 5).alias("stage"), (k % 4).alias("attempt"), F.col("ts").alias("updated_at"), group.alias("error_group"), F.concat(F.lit("error "), k.cast("string")).alias("last_error"), "value", "k")


NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


#: A page's title.
TITLES = "titles AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
