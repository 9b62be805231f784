"""An inverted index of sparse token weights in blocks, and exact top-k search that skips blocks by their greatest weight.

A block holds the postings of one token in one range of keys, with their greatest weight. A range can give a query at
most the sum, over its tokens, of query weight times the token's greatest weight there. Search first scores the few
ranges with the highest such bounds, whose k-th score is then a floor; only ranges whose bound reaches it are scored
after that, so the result is exact. Bounds need the blocks' heads only (column pruning leaves the postings on disk), and
both reads are restricted to the folders, row groups and pages of the query's tokens.

Texts (or postings) are dealt by range once. Counting, pruning and blocks follow in the same tasks, which write them as
they are, so a file holds all tokens of its ranges and a search sums up a key's score before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackroom.config import CONFIG
from stackroom.functions.text import tokens
from stackroom.sources.store import scratch

#: Keys of a range, folders that tokens are dealt to (a key's score is summed up in each), ranges scored first, and query
#: tokens that become a filter.
RANGE, FOLDERS, FIRST_RANGES, MOST_NAMED = 256, 1, 4, 10_000
#: Rows of query weights, and of ranges of queries, that are sent to all tasks; more of them are joined by a shuffle.
MOST_SENT, MOST_RANGES = 100_000, 1_000_000
#: Scores are rounded to six digits, so a bound may be that much lower.
SLACK = 1e-6


def pruned(postings: DataFrame, key: str, drop: float, *within: str) -> DataFrame:
    """Postings without each key's weights below its drop quantile (linear between weights); 0 keeps all. within: columns
    that go by the key and that postings are dealt by, so that they needn't be dealt again."""
    if not drop:
        return postings
    least = F.percentile("weight", F.lit(drop)).over(Window.partitionBy(*within, key))
    return postings.withColumn("_least", least).filter(F.col("weight") >= F.col("_least")).drop("_least")


def _sent(rows: DataFrame, most: int) -> DataFrame:
    """Rows that are few go to all tasks, so that blocks needn't be shuffled to meet them."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


@dataclass(frozen=True)
class SparseIndex:
    path: str
    key: str
    range_size: int = RANGE

    @staticmethod
    def build(postings: DataFrame, path: str, key: str = "doc_id", drop: float = CONFIG.drop_ratio, range_size: int = RANGE, folders: int = FOLDERS) -> SparseIndex:
        """Write the index of postings (key, token, weight above 0; key a whole number), pruned by drop."""
        at = F.floor(F.col(key) / range_size).cast("long")
        return SparseIndex._write(postings.select(at.alias("range"), key, "token", "weight").repartition("range"), path, key, drop, range_size, folders)

    @staticmethod
    def of_texts(texts: DataFrame, path: str, key: str = "doc_id", drop: float = CONFIG.drop_ratio, range_size: int = RANGE, folders: int = FOLDERS) -> SparseIndex:
        """`build` of the postings of texts (key, text), of which only the texts are shuffled."""
        at = F.floor(F.col(key) / range_size).cast("long")
        words = texts.select(at.alias("range"), key, "text").repartition("range").select("range", key, F.explode(tokens(F.col("text"))).alias("token"))
        counted = words.groupBy("range", key, "token").agg(F.log1p(F.count(F.lit(1))).alias("weight"))
        return SparseIndex._write(counted, path, key, drop, range_size, folders)

    @staticmethod
    def _write(postings: DataFrame, path: str, key: str, drop: float, range_size: int, folders: int) -> SparseIndex:
        rows = pruned(postings, key, drop, "range")
        entry = F.struct(F.col(key).cast("long").alias("k"), F.col("weight").cast("double").alias("w"))
        blocks = rows.groupBy("token", "range").agg(F.max(F.col("weight").cast("double")).alias("most"), F.array_sort(F.collect_list(entry)).alias("entries"))  # range_size entries at most
        blocks = blocks.select("token", "range", "most", F.size("entries").alias("n"), F.col("entries.k").alias("keys"), F.col("entries.w").alias("weights"), F.pmod(F.xxhash64("token"), F.lit(folders)).cast("int").alias("folder"))
        blocks.sortWithinPartitions("folder", "token", "range").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/blocks")
        postings.sparkSession.createDataFrame([(key, range_size, folders)], "key string, range_size int, folders int").coalesce(1).write.mode("overwrite").parquet(f"{path}/rules")
        return SparseIndex(path, key, range_size)

    @staticmethod
    def open(spark: SparkSession, path: str) -> SparseIndex:
        r = spark.read.parquet(f"{path}/rules").head()
        return SparseIndex(path, r.key, r.range_size)

    def blocks(self, queries: DataFrame) -> DataFrame:
        """Blocks of the tokens that queries name. Few tokens are a filter that reaches folders and row groups."""
        spark = queries.sparkSession
        rules = spark.read.parquet(f"{self.path}/rules").head()
        rows = spark.read.schema("token string, range long, most double, n int, keys array<long>, weights array<double>, folder int").parquet(f"{self.path}/blocks")
        named = queries.select("token").distinct().limit(MOST_NAMED + 1).collect()
        if len(named) > MOST_NAMED:
            return rows.join(queries.select("token").distinct(), "token", "left_semi")
        tokens = [r.token for r in named]
        folder = spark.createDataFrame([(t,) for t in tokens], "token string").select(F.pmod(F.xxhash64("token"), F.lit(rules.folders)).alias("f")).distinct().collect() if tokens else []
        return rows.filter(F.col("folder").isin([int(r.f) for r in folder]) & F.col("token").isin(tokens))

    def bounds(self, queries: DataFrame) -> DataFrame:
        """query, range, bound, n: the most that a key of each range can score, and the postings there."""
        heads = self.blocks(queries).select("token", "range", "most", "n")
        return heads.join(_sent(queries, MOST_SENT), "token").groupBy("query", "range").agg(F.sum(F.col("most") * F.col("weight")).alias("bound"), F.sum("n").alias("n"))

    def _scored(self, queries: DataFrame, ranges: DataFrame) -> DataFrame:
        """query, key, score of all keys in the given ranges of each query."""
        asked = queries.select("query", "token", F.col("weight").alias("q"))
        found = self.blocks(queries).select("token", "range", "keys", "weights").join(_sent(asked, MOST_SENT), "token").join(_sent(ranges.select("query", "range"), MOST_RANGES), ["query", "range"])
        parts = found.select("query", "q", F.explode(F.arrays_zip("keys", "weights")).alias("p"))
        return parts.groupBy("query", F.col("p.keys").alias(self.key)).agg(F.round(F.sum(F.col("q") * F.col("p.weights")), 6).alias("score"))

    def _best(self, scored: DataFrame, k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), self.key))
        return scored.withColumn("rank", place).filter(F.col("rank") <= k)

    def waves(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """Ranges scored first, and the others whose bound reaches the k-th score of the first ones."""
        spark, path = queries.sparkSession, scratch(queries.sparkSession, "bounds")
        self.bounds(queries).write.parquet(path)  # a row for each query and range; read again and again
        bounds = spark.read.parquet(path).withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("bound").desc(), "range")))
        first = bounds.filter(F.col("place") <= FIRST_RANGES)
        floor = self._best(self._scored(queries, first), k).filter(F.col("rank") == k).select("query", F.col("score").alias("floor"))
        rest = bounds.filter(F.col("place") > FIRST_RANGES).join(floor, "query", "left")
        return first, rest.filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK)).drop("floor")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query, rank, key, score): the k highest inner products for each query of (query, token, weight)."""
        spark, path = queries.sparkSession, scratch(queries.sparkSession, "asked")
        queries.select("query", "token", "weight").write.parquet(path)  # each step joins them
        queries = spark.read.parquet(path)
        first, rest = self.waves(queries, k)
        best = self._best(self._scored(queries, first.select("query", "range").unionByName(rest.select("query", "range"))), k)
        return best.select("query", "rank", self.key, "score")


def query_weights(queries: DataFrame, text: str = "text", query: str = "query", drop: float = CONFIG.drop_ratio) -> DataFrame:
    """(query, token, weight) of texts in words: ln(1 + frequency), without weights below the drop quantile."""
    from stackroom.operators.retrieval import postings

    return pruned(postings(queries.select(F.col(query).alias("query"), F.col(text).alias("text")), "query"), "query", drop)
