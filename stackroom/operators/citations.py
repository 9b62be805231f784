"""Which hits an answer cites, by the pages it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word of a page behind its number, and dashes of a range of pages. Fixed values.
PAGE, DASH = "페이지", "[–\\-~]"
_NO_WORD_BEFORE, _NO_WORD_BEHIND = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def cited_pages(text: Column) -> Column:
    """Pages that a text names, as distinct structs (first, last): "p.7" (and so "p.7–9"), "7페이지", "7–9페이지".

    last is null where the text names a first page alone, which any hit that starts there answers. A number goes on to
    its last digit and has no leading zero.
    """
    number = "([1-9][0-9]{0,8})"
    named = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    single = F.concat(named(r"p\." + number + _NO_WORD_BEHIND, 1), named(_NO_WORD_BEFORE + number + PAGE, 1))
    both = _NO_WORD_BEFORE + number + DASH + number + PAGE
    alone = F.transform(single, lambda x: F.struct(x.cast("int").alias("first"), F.lit(None).cast("int").alias("last")))
    ranges = F.zip_with(named(both, 1), named(both, 2), lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last")))
    return F.array_distinct(F.concat(alone, ranges))


def cited_hits(answers: DataFrame, hits: DataFrame, answer: str = "answer", text: str = "said") -> DataFrame:
    """Hits (answer, page_start, page_end, ...) that their answer's text cites, each once, in an equi-join on pages.

    Hits without a page (page_start of 0 or less, or null) are never cited; an answer that names no page cites nothing.
    """
    named = answers.select(answer, F.explode(cited_pages(F.col(text))).alias("_p")).select(answer, F.col("_p.first").alias("_first"), F.col("_p.last").alias("_last"))
    by_page = named.groupBy(answer, "_first").agg(F.collect_set("_last").alias("_ends"), F.count_if(F.col("_last").isNull()).alias("_open"))
    rows = hits.filter(F.col("page_start") > 0)
    joined = rows.join(by_page, (rows[answer] == by_page[answer]) & (rows["page_start"] == by_page["_first"]))
    return joined.filter((F.col("_open") > 0) | F.array_contains("_ends", F.col("page_end").cast("int"))).select(*(rows[c] for c in rows.columns))
