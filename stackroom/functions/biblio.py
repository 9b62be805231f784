"""Bibliographic expressions: ids, document types, authors, citations, context texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import year

#: Fixed values.
PAPER_GENRES = ["paper", "thesis", "report"]
POLICY_TITLE_WORDS = ["법", "령", "규정", "고시", "지침", "매뉴얼", "조달", "입찰", "계약", "공고", "훈령", "예규", "시행", "규칙", "조례"]
DOC_TYPES = ["paper", "book", "literature", "policy"]


def clean_id(raw: Column) -> Column:
    """Trimmed, without closing underscores."""
    return F.trim(F.regexp_replace(F.trim(raw), r"_+$", ""))


def id_of_key(key: Column, extension: str = ".pdf") -> Column:
    """Three parts: the middle one; two parts: the file's stem; anything else, or another extension, is null."""
    parts = F.split(key, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return F.when(F.lower(key).endswith(extension), F.when(F.size(parts) == 3, F.element_at(parts, 2)).when(F.size(parts) == 2, stem))


def doc_type(genre: Column, kdc: Column, title: Column) -> Column:
    """Genre first, then class numbers 800-899 and 320-359, then words of the title."""
    digits = F.substring(F.regexp_replace(F.coalesce(kdc, F.lit("")), "[^0-9]", ""), 1, 3)
    number = F.when(digits != "", digits.cast("int"))
    return (
        F.when(genre.isin(PAPER_GENRES), "paper")
        .when(number.between(800, 899), "literature")
        .when(number.between(320, 359), "policy")
        .when(title.rlike("|".join(POLICY_TITLE_WORDS)), "policy")
        .otherwise("book")
    )


def known_type(kind: Column) -> Column:
    return F.when(kind.isin(DOC_TYPES), kind).otherwise("book")


def year_or_nd(date: Column) -> Column:
    found = F.regexp_extract(F.coalesce(date, F.lit("")), r"(\d{4})", 1)
    return F.when(found != "", found).otherwise("n.d.")


def author_names(raw: Column) -> Column:
    """Semicolons separate names where there are any, else commas."""
    parts = F.when(F.contains(raw, F.lit(";")), F.split(raw, ";")).otherwise(F.split(raw, ","))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def authors(raw: Column, unknown: str = "Unknown Author", most: int | None = None) -> Column:
    """Names joined by commas; more than most are shortened to the first."""
    names = author_names(F.coalesce(raw, F.lit("")))
    text = F.array_join(names, ", ")
    if most:
        text = F.when(F.size(names) > most, F.concat(F.element_at(names, 1), F.lit(" et al."))).otherwise(text)
    return F.when(F.size(names) == 0, F.lit(unknown)).otherwise(text)


def citation(author: Column, date: Column, title: Column, journal: Column, issue: Column, link: Column) -> Column:
    """Author (Year). Title. Journal, Issue. Link; empty parts are left out."""
    none = lambda c: F.when(F.trim(c) != "", F.trim(c))
    place = F.concat_ws(", ", none(journal), none(issue))
    head = F.concat(author, F.lit(" ("), year_or_nd(date), F.lit(")"))
    return F.concat(F.concat_ws(". ", head, none(F.regexp_replace(title, r"\.+$", "")), none(place), none(link)), F.lit("."))


def meta_text(*fields: Column) -> Column:
    """The fields present, joined by a bar: the text of a book's meta chunk."""
    return F.concat_ws(" | ", *(F.when(F.trim(f) != "", f) for f in fields))


def contextual_text(themes: Column, summary: Column, body: Column) -> Column:
    return F.concat_ws("\n", F.when(themes != "", F.concat(F.lit("[themes] "), themes)), F.when(summary != "", F.concat(F.lit("[context] "), summary)), F.concat(F.lit("[body] "), body))


def chunk_id(book: Column, index: Column) -> Column:
    return F.format_string("%s__%04d", book, index)


def split_core(record: Column, core: list[str]) -> tuple[Column, Column]:
    """A map's core fields and its other fields, each without nulls."""
    names = F.array(*(F.lit(c) for c in core))
    return F.map_filter(record, lambda k, v: F.array_contains(names, k) & v.isNotNull()), F.map_filter(record, lambda k, v: ~F.array_contains(names, k) & v.isNotNull())


def merged(old: Column, new: Column) -> Column:
    """A shallow merge in which new wins."""
    keys = F.map_keys(new)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(keys, k)), new)


def short_year(date: Column) -> Column:
    return year(date)


def record_rows(records: DataFrame, columns: list[str]) -> DataFrame:
    """Catalogue rows of records (source_id, source_format, core, extra): a column's value is the core's, else the extra
    map's, which is kept whole beside it. A missing format is the record's own, a missing title its id."""
    core, extra = F.col("core"), F.col("extra")

    def value(c: str) -> Column:
        own = F.nullif("source_format", F.lit("")) if c == "source_format" else None
        rest = extra[c] if own is None else F.coalesce(own, extra[c])
        rest = F.when(F.map_contains_key(extra, F.lit(c)), rest).otherwise(F.col("source_id")) if c == "title" else rest
        return F.when(F.map_contains_key(core, F.lit(c)), core[c]).otherwise(rest).alias(c)

    return records.select(F.col("source_id").alias("cnts_id"), *map(value, columns), extra)
