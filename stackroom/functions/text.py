"""Text expressions: token estimates, line breaks, sentences, previews, keywords. All are Column -> Column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stackroom.session import ship

#: Characters that one token stands for.
CHARS_PER_TOKEN = 1.5


def token_estimate(text: Column) -> Column:
    """At least one token, else length over CHARS_PER_TOKEN, rounded down."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(CHARS_PER_TOKEN))).cast("long")


def normalize_breaks(text: Column) -> Column:
    """Blank lines stay paragraph breaks; single line breaks and runs of spaces become one space; trimmed."""
    text = F.regexp_replace(text, r"\n{2,}", "\u0001")
    text = F.regexp_replace(text, r"\n", " ")
    text = F.regexp_replace(text, "\u0001", "\n\n")
    return F.regexp_replace(F.regexp_replace(text, r" {2,}", " "), r"^\s+|\s+$", "")


def sentences(text: Column, least: int = 6) -> Column:
    """Split after sentence marks and white space; sentences shorter than least are dropped."""
    parts = F.split(F.regexp_replace(text, r"([.?!。])\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def sentence_spans(text: Column, least: int = 6) -> Column:
    """Sentences as structs (text, start, stop), each found after the one before; positions count from 0."""
    first = F.array(F.struct(F.lit("").alias("text"), F.lit(0).alias("start"), F.lit(0).alias("stop")))

    def step(found: Column, s: Column) -> Column:
        at = F.call_function("locate", s, text, F.element_at(found, -1)["stop"] + 1)
        span = F.struct(s.alias("text"), (at - 1).alias("start"), (at - 1 + F.length(s)).alias("stop"))
        return F.when(at > 0, F.concat(found, F.array(span))).otherwise(found)

    return F.aggregate(sentences(text, least), first, step, lambda found: F.slice(found, 2, F.size(found)))


def clean_page(text: Column) -> Column:
    """Strip lines, drop page-number lines ("12", "- 12 -", "12 / 80"), collapse runs of blank lines."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s))
    lines = F.filter(lines, lambda s: ~s.rlike(r"^(-\s*\d+\s*-|\d+|\d+\s*/\s*\d+)$"))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def preview(text: Column, n: int) -> Column:
    """The first n characters, with an ellipsis where text was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def cut_at_word(text: Column, n: int) -> Column:
    """Cut to n characters, back to the last space, with an ellipsis where text was cut."""
    head = F.substring(text, 1, n)
    return F.when(F.length(text) > n, F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("…"))).otherwise(text)


def strip_punctuation(text: Column) -> Column:
    """Without the closing punctuation that cataloguing leaves."""
    return F.regexp_replace(F.trim(text), r"[ ,./;:]+$", "")


def year(text: Column) -> Column:
    """The first four digits, else the trimmed text."""
    found = F.regexp_extract(text, r"(\d{4})", 1)
    return F.when(found != "", found).otherwise(F.trim(text))


def keyword_list(text: Column, most: int, separators: str = r"[,;|/·]") -> Column:
    """Trimmed non-empty parts, the first most of them."""
    return F.slice(F.filter(F.transform(F.split(text, separators), lambda s: F.trim(s)), lambda s: s != ""), 1, most)


def evenly_spaced(items: Column, keep: Column) -> Column:
    """keep items spread evenly over the list, in order."""
    n = F.size(items)
    return F.when(keep >= n, items).otherwise(F.transform(F.sequence(F.lit(0), keep - 1), lambda i: F.element_at(items, (F.least(n - 1, F.floor(i * n / keep)) + 1).cast("int"))))


@F.pandas_udf(StringType())
def _byte_prefix(text: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else t.encode()[:k].decode(errors="ignore") for t, k in zip(text, n)])


def truncate_bytes(text: Column, n: int) -> Column:
    """The longest prefix of whole characters within n bytes of UTF-8; only longer texts leave the JVM's fast path."""
    ship(SparkSession.active())
    return F.when(F.octet_length(text) <= n, text).otherwise(_byte_prefix(text, F.lit(n)))


def normalized_title(text: Column) -> Column:
    """Lower case; only digits, Latin letters and Hangul stay."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^0-9a-z가-힣]", "")


def bigrams(text: Column) -> Column:
    """The set of character pairs; a single character stands for itself."""
    n = F.length(text)
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(2))))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(pairs)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \n]+"), lambda s: s != "")


#: What likens a book to another in a query, before the word for book. Fixed values.
LIKENESS, BOOK = ("같은", "처럼", r"과\s*비슷한", r"와\s*비슷한", r"과\s*유사한", r"와\s*유사한", "비슷한"), "책"
SIMILAR_TO = rf"[\"']?(.+?)[\"']?\s*(?:{'|'.join(LIKENESS)})\s*{BOOK}"
SIMILAR_TO_ENGLISH = r"(?i)^\s*books? (?:like|similar to) (.+?)\s*$"


def similar_to(query: Column) -> Column:
    """The title that a query likens its books to; null if it likens to none."""
    english, korean = F.regexp_extract(query, SIMILAR_TO_ENGLISH, 1), F.regexp_extract(query, SIMILAR_TO, 1)
    return F.when(english != "", english).when(korean != "", F.regexp_replace(korean, r"^\s+|\s+$", ""))
