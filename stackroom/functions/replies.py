"""Model replies: fenced JSON, labelled summaries, streams that have ended."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import keyword_list

ITEMS = "struct<intro:string,items:array<struct<book_id:string,reason:string,quote:string>>>"


def fenced_json(reply: Column) -> Column:
    """What lies between the first brace and the last one, inside a code fence or not; null without braces."""
    found = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def reply_items(reply: Column, need: tuple[str, ...] = ("book_id",)) -> Column:
    """Items of a reply that have all needed fields; an empty array for a reply that can't be parsed."""
    items = F.from_json(fenced_json(reply), ITEMS)["items"]
    keep = lambda x: F.array_min(F.array(*(F.coalesce(x[f], F.lit("")) != "" for f in need)))
    return F.filter(F.coalesce(items, F.array().cast("array<struct<book_id:string,reason:string,quote:string>>")), keep)


#: Labels of search words that a model may put below a summary. Fixed values.
SEARCH_WORDS = ("비슷한 감성으로 찾을 독자의 검색어", "관련 검색어", "검색어")


def summary_and_themes(reply: Column, most: int = 20) -> tuple[Column, Column]:
    """Text under a SUMMARY label, and the list under a THEMES label; labels may carry markdown.

    Search words at the end of the summary don't belong to it; without a THEMES label they are the themes.
    """
    mark = r"(?s)\n*[*#]*\s*THEMES\s*:\s*[*#]*\s*\n?"
    parts = F.split(F.trim(reply), mark, 2)
    body = F.regexp_replace(F.trim(parts[0]), r"^[*#]*\s*SUMMARY\s*:\s*[*#]*\s*\n?", "")
    strip = lambda c: F.regexp_replace(F.trim(c), r"^[*#\s]+|[*#\s]+$", "")
    words = lambda c: F.slice(F.filter(F.transform(F.split(c, r"[,，\n]"), strip), lambda s: s != ""), 1, most)
    label = rf"(?s)\n+(?:{'|'.join(SEARCH_WORDS)})\s*:\s*"
    cut = F.split(body, label, 2)
    found = F.when(F.size(parts) == 2, words(F.element_at(parts, 2))).otherwise(F.array().cast("array<string>"))
    themes = F.when((F.size(found) == 0) & (F.size(cut) == 2), words(F.element_at(cut, 2))).otherwise(found)
    return strip(cut[0]), themes


def ended_stream(text: Column, marker: str = "###EFFECT###", most: int = 5) -> Column:
    """(keywords, body, effect) of a finished stream: a first #KW: line, the text, and what follows the marker."""
    has = text.rlike(r"^\s*#KW[^\n]*\n")
    keywords = F.when(has, keyword_list(F.regexp_extract(text, r"^\s*#KW:?([^\n]*)\n", 1), most, ","))
    rest = F.when(has, F.regexp_replace(text, r"^\s*#KW[^\n]*\n", "")).otherwise(text)
    at = F.locate(marker, rest)
    body = F.when(at > 0, F.substr(rest, F.lit(1), at - 1)).otherwise(rest)
    effect = F.when(at > 0, F.regexp_replace(F.substr(rest, at + len(marker)), r"^\n+", ""))
    return F.struct(keywords.alias("keywords"), body.alias("body"), effect.alias("effect"))
