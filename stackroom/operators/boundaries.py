"""Topic boundaries between sentence vectors, as window aggregates over their components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackroom.config import CONFIG


def boundaries(rows: DataFrame, window: int = CONFIG.window, percentile: float = CONFIG.percentile) -> DataFrame:
    """rows: doc, i (from 0), embedding. doc, i, similarity of the sentences at which a new topic starts.

    The mean vectors before and after i come from frames of a window per document and component.
    """
    wide = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc")))
    flat = wide.select("doc", "i", "n", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    w = Window.partitionBy("doc", "dim").orderBy("i")
    means = flat.select("doc", "i", "n", "dim", F.avg("x").over(w.rowsBetween(-window, -1)).alias("l"), F.avg("x").over(w.rowsBetween(0, window - 1)).alias("r"))
    inner = means.filter((F.col("i") >= window) & (F.col("i") < F.col("n") - window))
    cos = F.sum(F.col("l") * F.col("r")) / (F.sqrt(F.sum(F.col("l") ** 2)) * F.sqrt(F.sum(F.col("r") ** 2)) + 1e-8)
    similar = inner.groupBy("doc", "i").agg(F.round(cos, 6).alias("similarity"))
    least = similar.groupBy("doc").agg(F.percentile("similarity", percentile / 100).alias("least"))
    return similar.join(least, "doc").filter("similarity < least").drop("least")
