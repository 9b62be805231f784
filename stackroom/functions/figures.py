"""Figures inside page text: their places, images and the text around them. All are Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackroom.functions.text import clean_page

#: An image with its data in the text, any image, what stands for one, and characters around one. Fixed values.
INLINE = r"!\[([^\]]*)\]\(data:image/[^;]+;base64,([^)]+)\)"
ANY = r"!\[[^\]]*\]\([^)]+\)"
MARK = "[그림]"
AROUND = 300


def places(text: Column, pattern: str) -> Column:
    """Matches of a pattern as structs (start, stop, found), positions from 0: a fold over the lengths of the parts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda before, m: F.struct(F.length(before).alias("gap"), m.alias("found")))
    none = F.array().cast("array<struct<start:int,stop:int,found:string>>")

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        stop = start + F.length(x["found"])
        return F.struct(stop.alias("at"), F.concat(s["done"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["found"].alias("found")))).alias("done"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("done")), step, lambda s: s["done"])


def figures(text: Column, around: int = AROUND) -> Column:
    """Inline images as structs (img_idx, start, stop, image, before, after); those that can't be decoded are left out.

    img_idx counts all inline images of the page. Other inline images that lie whole within the text around are marks.
    """
    tidy = lambda s: F.regexp_replace(F.regexp_replace(s, INLINE, MARK), r"^\s+|\s+$", "")
    first = lambda p: F.greatest(F.lit(0), p["start"] - around)
    image = lambda p: F.try_to_binary(F.regexp_replace(F.regexp_extract(p["found"], INLINE, 2), r"[^A-Za-z0-9+/=]", ""), F.lit("base64"))
    rows = F.transform(
        places(text, INLINE),
        lambda p, i: F.struct(i.alias("img_idx"), p["start"].alias("start"), p["stop"].alias("stop"), image(p).alias("image"), tidy(F.substr(text, first(p) + 1, p["start"] - first(p))).alias("before"), tidy(F.substr(text, p["stop"] + 1, F.lit(around))).alias("after")),
    )
    return F.filter(rows, lambda r: r["image"].isNotNull())


def text_with_marks(text: Column) -> Column:
    """Page text with a mark in the place of every image, cleaned."""
    return clean_page(F.regexp_replace(text, ANY, MARK))


def figure_key(book: Column, page: Column, idx: Column) -> Column:
    """Object key of a figure's image."""
    return F.format_string("figures/%s/p%s_i%s.jpg", book, page, idx)
