"""The rules of a listing crawl over what was fetched: tries, the empty streak that ends it, resuming, first item wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Empty pages in a row that end a crawl, and tries that a page gets. Fixed values.
MOST_EMPTY, MOST_TRIES = 5, 3


@dataclass(frozen=True)
class Progress:
    """last: the last page with items (None if there was none); next: where a later run begins; ended: by empty pages."""

    last: int | None
    next: int
    ended: bool


def settled(tries: DataFrame, most: int = MOST_TRIES) -> DataFrame:
    """Items of each page from its first try that had any; tries after the last allowed one don't count."""
    counted = tries.filter(F.col("attempt") <= most)
    first = counted.groupBy("page_num").agg(F.min("attempt").alias("attempt"))
    return counted.join(first, ["page_num", "attempt"], "left_semi").drop("attempt")


def crawled(items: DataFrame, start: int = 1, total: int | None = None, most_empty: int = MOST_EMPTY) -> tuple[DataFrame, Progress]:
    """Items (page_num, ...) that a crawl from start reads before so many empty pages in a row, and how far it came.

    A page without items is a page without rows. An island of pages begins where none of the most_empty pages before is
    filled, which an equi-join tells; so no window goes over all pages, and the crawl ends before the first new island.
    """
    rows = items.filter(F.col("page_num") >= start)
    if total is not None:
        rows = rows.filter(F.col("page_num") <= total)
    pages = rows.select("page_num").distinct()
    near = pages.select(F.explode(F.sequence(F.col("page_num") + 1, F.col("page_num") + most_empty)).alias("page_num")).distinct()
    island = pages.filter(F.col("page_num") >= start + most_empty).join(near, "page_num", "left_anti").agg(F.min("page_num")).head()[0]
    kept = rows if island is None else rows.filter(F.col("page_num") < island)
    last = kept.agg(F.max("page_num")).head()[0]
    stop = (start - 1 if last is None else last) + most_empty
    ended = total is None or stop <= total
    return kept, Progress(last, (stop if ended else total) + 1, ended)


def collected(kept: DataFrame, key: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """One row a key: what exists already, else the first in order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("_new", *order))
    rows = kept.withColumn("_new", F.lit(1))
    if existing is not None:
        rows = existing.withColumn("_new", F.lit(0)).unionByName(rows)
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place", "_new")
