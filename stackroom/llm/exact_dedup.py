"""Skew-safe exact deduplication with DataFrame functions only.

1. Locally: a partial aggregate on (digest, text, salt) leaves one row of each content per task before any shuffle.
2. Salted digest groups: these partial rows meet by (digest, text, salt).
3. Globally: the salt winners meet by (digest, text).
Every stage compares the full normalised text. Stage 3 also counts the contents of each digest; each row then finds
its winner by the digest, and by the text as well for a digest of several contents. A content held by a large share
of all rows is at most one row per task and salt in any shuffle of steps 1 to 3, and the last join splits it.

Defined results: a null text is the empty text. Rows with equal texts form one group whatever their other columns;
the row with the most code points in the original text, then the smallest id, stays (null ids come last). Rows that
repeat id and text all name that id; `kept_rows` leaves one of them. An empty table gives an empty table.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh

#: Salts per digest.
SALTS = 16
#: White space to delete. Fixed value.
SPACE = r"[\x20\x09-\x0D]"
_IDS = "decimal(38,0)"
_LAST, _SCALE = 9223372036854775807, Decimal(10) ** 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def _rank(length: Column, key: Column) -> Column:
    """Larger is better: code points first, then the smaller id. Fits 38 digits for any long id."""
    low = F.lit(_LAST).cast(_IDS) - F.coalesce(key.cast(_IDS), F.lit(_LAST).cast(_IDS))
    return (length.cast(_IDS) * F.lit(_SCALE).cast(_IDS) + low).cast(_IDS)


def winners(rows: DataFrame) -> DataFrame:
    """rows: digest, body, n_chars, id. One row per content: digest, body, best, n."""
    first = (
        rows.withColumn("best", _rank(F.col("n_chars"), F.col("id")))
        .withColumn("salt", F.pmod(F.xxhash64("id", "n_chars"), F.lit(SALTS)).cast("int"))
        .groupBy("digest", "body", "salt")
        .agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n"))
    )
    return first.groupBy("digest", "body").agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256."""
    text = docs[text_col]
    rows = docs.select(docs[id_col].cast("long").alias("id"), normalised(text).alias("body"), F.length(F.coalesce(text.cast("string"), F.lit(""))).alias("n_chars"))
    rows = rows.withColumn("digest", F.sha2(F.col("body"), 256))
    won = winners(rows)
    keep = F.lit(_LAST).cast(_IDS) - F.pmod(F.col("best"), F.lit(_SCALE).cast(_IDS))
    won = won.select("digest", "n", F.col("best"), keep.cast("long").alias("keep_id"), F.xxhash64("body").alias("check"), F.length("body").alias("size"))
    # A second hash and the length stand for the text here: stage 3 has compared the texts themselves, and a digest
    # with two contents of equal length and equal second hash would show up as two rows, which raises an error.
    seen = won.groupBy("digest", "check", "size").agg(F.max("n").alias("n"), F.max("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("contents"))
    seen = seen.select("digest", "check", "size", "n", F.when(F.col("contents") == 1, F.col("keep_id")).otherwise(F.raise_error(F.lit("two texts share SHA-256, XXH64 and length")).cast("long")).alias("keep_id"))
    left = rows.select("id", "digest", F.xxhash64("body").alias("check"), F.length("body").alias("size"))
    joined = left.join(seen, ["digest", "check", "size"])
    keep_id = F.when(F.col("keep_id") != F.lit(_LAST), F.col("keep_id"))
    return joined.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), F.col("digest").alias("text_sha256"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text; of rows that repeat the winner's id, text and length, one."""
    found = checkpoint(dedup(docs, id_col, text_col).filter("group_size > 1"))
    row_id, sha, place = fresh(docs.columns, "row_id", "row_sha", "row_place")
    gone = found.filter("not kept").select(F.col(id_col).cast("long").alias(row_id), F.col("text_sha256").alias(sha)).distinct()
    repeated = found.filter("kept").groupBy(id_col, "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() > 0
    out = docs.withColumns({row_id: docs[id_col].cast("long"), sha: F.sha2(normalised(docs[text_col]), 256)})
    out = out.join(gone, out[row_id].eqNullSafe(gone[row_id]) & (out[sha] == gone[sha]), "left_anti")
    if repeated:
        out = out.withColumn(place, F.row_number().over(Window.partitionBy(row_id, sha).orderBy(*(F.col(f"`{c}`").cast("string") for c in docs.columns)))).filter(F.col(place) == 1)
    return out.select(*docs.columns)
