"""All chunks of a book in one plan: its body with the context they are embedded with, what enrichment adds, its meta chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.config import CONFIG
from stackroom.functions.text import truncate_bytes

#: Labels of a chunk's parts, and of a book's fields in their order. Fixed values.
THEMES, SUMMARY, BODY = "[핵심 테마] ", "[섹션 요약] ", "[본문] "
ABSTRACT, KEYWORDS, TABLE, TABLE_SAYS, FIGURE_SAYS = "[초록] ", "[키워드] ", "[표]\n", "[표 설명] ", "[그림 설명] "
META = {"title": "제목", "corporate_author": "기관", "personal_author": "저자", "publisher": "출판사", "pub_date": "발행년도", "kdc": "KDC분류", "subject": "주제", "keyword": "키워드", "abstract": "초록"}
COLUMNS = ["book_id", "chunk_idx", "kind", "section_idx", "text", "embed_text"]


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _entry(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"))


def body_chunks(body: DataFrame, sections: DataFrame) -> DataFrame:
    """Body chunks (book_id, chunk_idx, section_idx, text), embedded behind their section's themes and summary."""
    rows = body.join(sections.select("book_id", "section_idx", "summary", F.array_join(F.filter(F.transform(F.split("themes", ","), lambda t: F.trim(t)), lambda t: t != ""), ", ").alias("themes")), ["book_id", "section_idx"], "left")
    parts = [F.when(_some(F.col("themes")), F.concat(F.lit(THEMES), "themes")), F.when(_some(F.col("summary")), F.concat(F.lit(SUMMARY), "summary")), F.concat(F.lit(BODY), "text")]
    return rows.select("book_id", "chunk_idx", F.lit("body").alias("kind"), "section_idx", "text", F.concat_ws("\n", *parts).alias("embed_text"))


def added_chunks(enrichment: DataFrame, body: DataFrame, table_bytes: int | None = CONFIG.chunk_bytes) -> DataFrame:
    """What enrichment adds to papers, numbered on from their body: abstract, keywords, each table and what a model says
    of it, what a model says of figures.

    enrichment: book_id, abstract, keywords (array), tables (array of context, markdown, description), figures (array of
    descriptions). table_bytes: a table's text is cut there; None keeps it whole.
    """
    none = F.array().cast("array<struct<kind:string,text:string>>")
    if_there = lambda holds, entry: F.when(holds, F.array(entry)).otherwise(none)
    whole = lambda t: F.concat(F.lit(TABLE), F.when(_some(t["context"]), F.concat(t["context"], F.lit("\n\n"))).otherwise(""), F.coalesce(t["markdown"], F.lit("")))
    tables = F.flatten(F.transform(F.coalesce("tables", F.array().cast(enrichment.schema["tables"].dataType)), lambda t: F.concat(F.array(_entry("table", whole(t))), if_there(_some(t["description"]), _entry("table description", F.concat(F.lit(TABLE_SAYS), t["description"]))))))
    figures = F.transform(F.coalesce("figures", F.array().cast("array<string>")), lambda f: _entry("figure description", F.concat(F.lit(FIGURE_SAYS), f)))
    entries = F.concat(
        if_there(_some(F.col("abstract")), _entry("abstract", F.concat(F.lit(ABSTRACT), "abstract"))),
        if_there(F.coalesce(F.size("keywords"), F.lit(0)) > 0, _entry("keywords", F.concat(F.lit(KEYWORDS), F.array_join("keywords", ", ")))),
        tables,
        figures,
    )
    counts = body.groupBy("book_id").agg(F.count(F.lit(1)).alias("_base"))
    rows = enrichment.select("book_id", F.posexplode(entries).alias("_at", "e")).join(counts, "book_id", "left")
    text = F.col("e.text")
    if table_bytes is not None:
        text = F.when(F.col("e.kind") == "table", truncate_bytes(text, table_bytes)).otherwise(text)
    return rows.select("book_id", (F.coalesce("_base", F.lit(0)) + F.col("_at")).cast("int").alias("chunk_idx"), F.col("e.kind").alias("kind"), F.lit(None).cast("int").alias("section_idx"), text.alias("text"), text.alias("embed_text"))


def meta_chunks(books: DataFrame) -> DataFrame:
    """One chunk a book, of index -1: its filled fields behind their labels; a missing title is the id."""
    value = {c: F.coalesce(F.nullif(c, F.lit("")), F.col("book_id")) if c == "title" else F.col(c) for c in META if c in books.columns or c == "title"}
    text = F.concat_ws(" | ", *(F.when(_some(v), F.concat(F.lit(f"{META[c]}: "), v)) for c, v in value.items()))
    return books.select("book_id", F.lit(-1).alias("chunk_idx"), F.lit("meta").alias("kind"), F.lit(None).cast("int").alias("section_idx"), text.alias("text"), text.alias("embed_text"))


def chunk_stream(books: DataFrame, body: DataFrame, sections: DataFrame, enrichment: DataFrame, table_bytes: int | None = CONFIG.chunk_bytes) -> DataFrame:
    """COLUMNS of all chunks of books. Only papers are enriched; what they lack is left out. table_bytes: as of `added_chunks`."""
    papers = enrichment.join(books.filter(F.col("doc_type") == "paper").select("book_id"), "book_id", "left_semi")
    parts = [body_chunks(body, sections), added_chunks(papers, body, table_bytes), meta_chunks(books)]
    return parts[0].select(*COLUMNS).unionByName(parts[1].select(*COLUMNS)).unionByName(parts[2].select(*COLUMNS))
