"""Relational building blocks: upsert, replace, reconcile, dedup, paging, range joins, top-k per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackroom.functions.biblio import merged


def last_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the last in order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc() if isinstance(c, str) else c for c in order)))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row a key, the first in order; and the keys that came again."""
    numbered = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter("_place = 1").drop("_place"), numbered.filter("_place > 1").select(*keys).distinct()


def upsert(old: DataFrame, new: DataFrame, key: str, order: str, protected: tuple[str, ...] = (), maps: tuple[str, ...] = ()) -> DataFrame:
    """old with new merged in, and `_change` (created, updated, kept).

    Of rows with the same key in new the last by order counts. Nulls of new never overwrite; protected columns of a
    row that exists stay; map columns merge, new entries winning.
    """
    batch = last_wins(new, [key], [order]).drop(order)
    o, n = old.alias("o"), batch.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    exists, comes = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    given = set(batch.columns)

    def value(c: str) -> Column:
        if c not in given:
            return F.col(f"o.{c}")
        if c in maps:
            empty = F.create_map().cast(old.schema[c].dataType)
            return merged(F.coalesce(F.col(f"o.{c}"), empty), F.coalesce(F.col(f"n.{c}"), empty))
        if c in protected:
            return F.when(exists, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))

    change = F.when(~exists, "created").when(comes, "updated").otherwise("kept")
    return both.select(*(value(c).alias(c) for c in old.columns), change.alias("_change"))


def replace_groups(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of a key in new take the place of that key's rows in old."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each key once, with where it was found: both, left or right."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.select(key, F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both").alias("side"))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of rows. Spark's offset keeps a sort that ends in a bounded top-k."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def top_per_group(rows: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key; the planner cuts each task's rows to k before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def point_in_range(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, start: str, stop: str) -> DataFrame:
    """Each point with the range of its key that holds it, else with the key's last range."""
    r = ranges.withColumn("_last", F.max(start).over(Window.partitionBy(*keys)))
    hit = points.join(r, keys, "left").filter(F.col(start).isNull() | ((F.col(point) >= F.col(start)) & (F.col(point) < F.col(stop))) | ((F.col(start) == F.col("_last")) & (F.col(point) >= F.col(stop))))
    return hit.drop("_last")


def band_join(points: DataFrame, rows: DataFrame, keys: list[str], center: str, position: str, reach: int) -> DataFrame:
    """Rows of the same key within reach of a center; cells of 2 * reach + 1 positions keep the join an equi-join."""
    width = 2 * reach + 1
    cells = points.withColumn("_cell", F.explode(F.array_distinct(F.array(F.floor((F.col(center) - reach) / width), F.floor((F.col(center) + reach) / width)))))
    return cells.join(rows.withColumn("_cell", F.floor(F.col(position) / width)), [*keys, "_cell"]).filter(F.abs(F.col(position) - F.col(center)) <= reach).drop("_cell")


def page_buttons(current: Column, total: Column) -> Column:
    """Labels of page buttons: all of up to seven pages, else the first, the last and those around the current one, with
    an ellipsis for what lies between."""
    near = F.sequence(F.greatest(F.lit(2), current - 1), F.greatest(F.least(total - 1, current + 1), F.greatest(F.lit(2), current - 1)))
    near = F.filter(near, lambda p: (p >= current - 1) & (p <= current + 1) & (p <= total - 1))
    gap = lambda there: F.when(there, F.array(F.lit("..."))).otherwise(F.array().cast("array<string>"))
    some = F.concat(F.array(F.lit("1")), gap(current > 3), near.cast("array<string>"), gap(current < total - 2), F.array(total.cast("string")))
    every = F.filter(F.sequence(F.lit(1), F.greatest(total, F.lit(1))), lambda p: p <= total).cast("array<string>")
    return F.when(total <= 7, every).otherwise(some)
