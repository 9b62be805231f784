"""A table on disk whose rows lie in buckets of their keys; a change rewrites the touched buckets and no others.

Writes are dynamic partition overwrites: new files of the touched buckets are staged, and take the place of the old ones
when the job commits, so a lost task or a failed job leaves the table as it was. `replace` and `upsert` may be run again
with the same rows. Only one writer may work at a time; a driver that dies while it commits can leave buckets half moved.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from stackroom.sources.store import exists, remove

#: Buckets of a table: a share of a bucket's rows must fit a task.
BUCKETS = 64


@dataclass(frozen=True)
class BucketTable:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: StructType
    buckets: int = BUCKETS

    @staticmethod
    def create(rows: DataFrame, path: str, keys: tuple[str, ...], buckets: int = BUCKETS) -> BucketTable:
        """Write rows as a new table."""
        spark = rows.sparkSession
        table = BucketTable(spark, path, tuple(keys), rows.schema, buckets)
        spark.createDataFrame([(list(keys), rows.schema.json(), buckets)], "keys array<string>, schema string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/rules")
        table._put(table._dealt(rows))
        return table

    @staticmethod
    def open(spark: SparkSession, path: str) -> BucketTable:
        r = spark.read.parquet(f"{path}/rules").head()
        return BucketTable(spark, path, tuple(r["keys"]), StructType.fromJson(json.loads(r["schema"])), r["buckets"])

    @staticmethod
    def there(spark: SparkSession, path: str) -> bool:
        return exists(spark, f"{path}/rules/_SUCCESS")

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema, StructField("bucket", IntegerType())])).parquet(f"{self.path}/data")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _put(self, dealt: DataFrame) -> None:
        columns = [*self.schema.names, "bucket"]
        dealt.select(*columns).hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/data")

    def _touched(self, dealt: DataFrame) -> tuple[list[int], DataFrame]:
        """Numbers of the buckets that hold keys of some rows (the number of buckets at most), and what is there."""
        some = [r.bucket for r in dealt.select("bucket").distinct().collect()]
        return some, self._stored().filter(F.col("bucket").isin(some) if some else F.lit(False))

    def replace(self, rows: DataFrame) -> None:
        """All rows of a key in rows take the place of that key's rows."""
        new = self._dealt(rows.select(*self.schema.names))
        _, old = self._touched(new)
        stays = old.join(new.select(*self.keys).distinct(), list(self.keys), "left_anti")
        self._put(stays.select(*new.columns).unionByName(new))

    def delete(self, keys: DataFrame) -> None:
        """Remove the rows of some keys."""
        gone = self._dealt(keys.select(*self.keys).distinct())
        some, old = self._touched(gone)
        self._keep(old.join(gone.drop("bucket"), list(self.keys), "left_anti"), some)

    def delete_where(self, condition: Column) -> None:
        """Remove the rows that meet a condition; buckets without such rows keep their files."""
        some, old = self._touched(self._stored().filter(condition))
        self._keep(old.filter(~F.coalesce(condition, F.lit(False))), some)

    def _keep(self, stays: DataFrame, touched: list[int]) -> None:
        """Leave these rows in the touched buckets; a bucket left empty goes as a whole, since no new file replaces it."""
        filled = {r.bucket for r in stays.select("bucket").distinct().collect()}
        self._put(stays)
        for b in set(touched) - filled:
            remove(self.spark, f"{self.path}/data/bucket={b}")

    def upsert(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """merge(old, rows) gives the rows of the touched buckets, at least all keys of rows, with the table's columns."""
        new = self._dealt(rows)
        _, old = self._touched(new)
        self._put(self._dealt(merge(old.drop("bucket"), rows)))
