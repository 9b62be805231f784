"""What a stage leaves for the next one: rows with nested columns by book, saved, loaded, deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.sources.buckets import BucketTable

#: Characters between pages in a whole text. Fixed value.
GAP = "\n\n"


class Artifacts:
    """One kind of artifact below a path. Saving a book's artifact again replaces it; other books' files stay."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, rows: DataFrame) -> None:
        """rows: book_id and any nested columns, the same at every save, a row a book."""
        if BucketTable.there(self.spark, self.path):
            BucketTable.open(self.spark, self.path).replace(rows)
        else:
            BucketTable.create(rows, self.path, ("book_id",), 16)

    def load(self, books: DataFrame) -> DataFrame:
        """The artifacts of books, and error = artifact_missing for those that have none."""
        have = BucketTable.open(self.spark, self.path).read().withColumn("_there", F.lit(True))
        return books.select("book_id").join(have, "book_id", "left").withColumn("error", F.when(F.col("_there").isNull(), "artifact_missing")).drop("_there")

    def delete(self, books: DataFrame) -> None:
        BucketTable.open(self.spark, self.path).delete(books)


def of_pages(pages: DataFrame) -> DataFrame:
    """book_id, total_pages, pages: an extraction's artifact from its rows (book_id, page_num, text, method, confidence)."""
    page = F.struct("page_num", "text", "method", "confidence")
    return pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("total_pages"), F.array_sort(F.collect_list(page)).alias("pages"))


def text_and_spans(artifacts: DataFrame) -> DataFrame:
    """book_id, full_text, spans: the text of all filled pages, and where in it each page lies (page_num, start, stop)."""
    filled = F.filter("pages", lambda p: F.coalesce(p["text"], F.lit("")) != "")
    none = F.array().cast("array<struct<page_num:bigint,start:int,stop:int>>")

    def step(s, p):
        stop = s["at"] + F.length(p["text"])
        span = F.struct(p["page_num"].cast("long").alias("page_num"), s["at"].alias("start"), stop.alias("stop"))
        return F.struct((stop + len(GAP)).alias("at"), F.concat(s["done"], F.array(span)).alias("done"))

    spans = F.aggregate(filled, F.struct(F.lit(0).alias("at"), none.alias("done")), step, lambda s: s["done"])
    return artifacts.select("book_id", F.array_join(F.transform(filled, lambda p: p["text"]), GAP).alias("full_text"), spans.alias("spans"))
