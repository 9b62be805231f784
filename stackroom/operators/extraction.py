"""Page lists of several extractors side by side, in one grouped pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stacked(lists: dict[str, DataFrame]) -> DataFrame:
    """source, page, text, confidence of all lists."""
    return reduce(DataFrame.unionByName, [p.select(F.lit(name).alias("source"), "page", "text", F.col("confidence").cast("double").alias("confidence")) for name, p in lists.items()])


def aligned(lists: dict[str, DataFrame], texts: bool = False) -> DataFrame:
    """Each page of any list once: characters (0 where a list lacks the page) and confidence (null there) of each list."""
    columns = []
    for name in lists:
        mine = F.col("source") == name
        columns += [F.coalesce(F.max(F.when(mine, F.coalesce(F.length("text"), F.lit(0)))), F.lit(0)).alias(f"{name}_chars"), F.max(F.when(mine, F.col("confidence"))).alias(f"{name}_confidence")]
        if texts:
            columns.append(F.coalesce(F.max(F.when(mine, F.col("text"))), F.lit("")).alias(f"{name}_text"))
    return stacked(lists).groupBy("page").agg(*columns)


def totals(lists: dict[str, DataFrame]) -> DataFrame:
    """source, total_pages (of any list), processed_pages, total_chars and mean_confidence of each list, empty ones too."""
    size = F.coalesce(F.length("text"), F.lit(0))
    sums = stacked(lists).groupBy("source").agg(F.countDistinct("page").alias("processed_pages"), F.sum(size).alias("total_chars"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    pages = stacked(lists).agg(F.countDistinct("page")).scalar()
    names = sums.sparkSession.createDataFrame([(n,) for n in lists], "source string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return names.join(sums, "source", "left").select("source", pages.alias("total_pages"), zero("processed_pages"), zero("total_chars"), "mean_confidence")
