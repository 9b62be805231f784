"""The public search calls: a query in words becomes one lazy plan."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.config import CONFIG
from stackroom.functions import biblio
from stackroom.functions.text import SIMILAR_TO, SIMILAR_TO_ENGLISH
from stackroom.operators import retrieval


@dataclass(frozen=True)
class Filter:
    year_from: int | None = None
    year_to: int | None = None
    sort_by: str = "relevance"


def read_filter(query: str, this_year: int = 2024) -> Filter:
    """Year bounds and a sort hint in a query, by rules."""
    q = query.lower()
    years = [int(y) for y in re.findall(r"(?<!\d)(1[89]\d\d|20\d\d)(?!\d)", q)]
    first = last = None
    if m := re.search(r"(?:last|recent|최근)\s*(\d{1,2})\s*(?:years?|년)", q):
        first = this_year - int(m[1])
    elif len(years) >= 2 and re.search(r"between|from|~|-|부터|에서", q):
        first, last = min(years[:2]), max(years[:2])
    elif years and re.search(r"since|after|from|이후|부터", q):
        first = years[0]
    elif years and re.search(r"before|until|by |이전|까지", q):
        last = years[0] - bool(re.search(r"before|이전", q))
    elif years:
        first = last = years[0]
    sort = "date_desc" if re.search(r"newest|latest|most recent|최신", q) else "date_asc" if re.search(r"oldest|earliest|오래된", q) else "relevance"
    return Filter(first, last, sort)


def rewrite(query: str, catalog: DataFrame | None = None) -> str:
    """"books like X" becomes the themes of X where the catalogue has it; any other query stays."""
    m = re.search(SIMILAR_TO_ENGLISH, query) or re.search(SIMILAR_TO, query)
    if not m or catalog is None:
        return query
    found = catalog.filter(F.col("title").ilike("%" + m[1].strip().replace("%", r"\%").replace("_", r"\_") + "%")).orderBy("book_id").limit(1).select("themes").head()
    return found.themes if found and found.themes else query


def search(chunks: DataFrame, catalog: DataFrame, query: str, vector: list[float], k: int = 5, wanted: str | None = "book", mode: str = "book") -> DataFrame:
    """Ranked books (or chunks) for a query of 1 to 500 characters, k of 1 to 20, with titles weighed in.

    Without a hit in the wanted scope, hits of any scope come instead; both are parts of one plan.
    """
    if not 1 <= len(query) <= 500 or not 1 <= k <= 20 or mode not in ("book", "chunk"):
        raise ValueError("query of 1 to 500 characters, k of 1 to 20, mode book or chunk")
    f, words = read_filter(query), rewrite(query, catalog if "themes" in catalog.columns else None)
    if mode == "chunk":
        some = chunks.filter(retrieval.scope(F.col("doc_type"), F.col("book_id"), wanted) & retrieval.years(F.col("pub_date"), f.year_from, f.year_to))
        wide = k * CONFIG.chunk_multiplier
        fused = retrieval.fuse([retrieval.dense_top(some, vector, wide), retrieval.sparse_top(some, retrieval.sparse_query(words), wide)], wide)
        return retrieval.lexical_rerank(some.join(F.broadcast(fused), "doc_id"), words).orderBy(F.col("rerank").desc(), F.col("score").desc(), "doc_id").limit(k)
    tiers = [(0, wanted)] + ([(1, None)] if wanted else [])
    parts = [retrieval.search(chunks, vector, words, k, scope, f.year_from, f.year_to, f.sort_by).withColumn("tier", F.lit(tier)) for tier, scope in tiers]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    best = both.join(F.broadcast(both.agg(F.min("tier").alias("tier"))), "tier").drop("tier")
    return retrieval.with_titles(best, catalog, [query, words]).orderBy(F.col("relevance").desc(), "book_id")


def related(chunks: DataFrame, book_id: str, vector: list[float], k: int = 5) -> DataFrame:
    """Other books near a book's vector, scores to 4 digits; k of 1 to 10."""
    if not 1 <= k <= 10:
        raise ValueError("k of 1 to 10")
    hits = retrieval.dense_top(chunks.filter(F.col("book_id") != book_id), vector, 5 * k)
    best = chunks.select("doc_id", "book_id").join(F.broadcast(hits), "doc_id").groupBy("book_id").agg(F.max("score").alias("best"))
    return best.orderBy(F.col("best").desc(), "book_id").limit(k).select("book_id", F.round("best", 4).alias("score"))


def citations(catalog: DataFrame) -> DataFrame:
    """book_id and the citation in both languages."""
    part = lambda author, title: biblio.citation(author, F.col("pub_date"), title, F.col("publisher"), F.col("vol_issue"), F.coalesce(F.nullif("uci", F.lit("")), F.col("url"), F.lit("")))
    raw: Column = F.coalesce(F.nullif("personal_author", F.lit("")), F.col("corporate_author"))
    return catalog.select("book_id", part(biblio.authors(raw, "저자 미상"), F.col("title")).alias("korean"), part(biblio.authors(raw, most=3), F.coalesce(F.nullif("title_remainder", F.lit("")), F.col("title"))).alias("english"))
