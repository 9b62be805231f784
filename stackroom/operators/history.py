"""Search history on disk: appended, split by type, looked up, cleared by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.operators.tables import top_per_group
from stackroom.sources.buckets import BucketTable

ENTRIES = "id string, session_id string, type string, query string, mode string, result string, created_at timestamp_ntz"


def entries(searches: DataFrame, result: Column, kind: Column) -> DataFrame:
    """Entries of searches (session_id, query, mode, created_at); result is written as JSON. The id follows from the
    search, so that one that is written again stays one."""
    key = F.md5(F.concat_ws("\n", F.col("session_id").cast("string"), F.col("created_at").cast("string"), "mode", "query"))
    return searches.select(key.alias("id"), F.col("session_id").cast("string").alias("session_id"), kind.alias("type"), "query", "mode", F.to_json(result).alias("result"), F.col("created_at").cast("timestamp_ntz").alias("created_at"))


class History:
    """Entries lie in buckets of their session: adding to some sessions leaves the others' files."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.table = BucketTable.open(spark, path) if BucketTable.there(spark, path) else BucketTable.create(spark.createDataFrame([], ENTRIES), path, ("session_id",), buckets)

    def add(self, rows: DataFrame) -> None:
        self.table.upsert(rows, lambda old, new: old.join(new.select("session_id", "id"), ["session_id", "id"], "left_anti").select(*old.columns).unionByName(new.dropDuplicates(["session_id", "id"])))

    def of_type(self, kind: str) -> DataFrame:
        return self.table.read().filter(F.col("type") == kind)

    def newest(self, most: int = 50) -> DataFrame:
        return top_per_group(self.table.read(), ["session_id"], [F.col("created_at").desc(), "id"], most, "place")

    def entry(self, key: str) -> DataFrame:
        return self.table.read().filter(F.col("id") == key)

    def clear(self, kind: str) -> None:
        """Remove the entries of a type."""
        self.table.delete_where(F.col("type") == kind)
