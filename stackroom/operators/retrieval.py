"""Hybrid retrieval over chunks: dense and sparse ranks, fusion, grouping to books, scores, context."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackroom.config import CONFIG
from stackroom.functions.scoring import boosted, combined, cosine, rrf, title_match
from stackroom.functions.text import tokens


def scope(kind: Column, book: Column, wanted: str | None, prefix: str = "KCI") -> Column:
    """Papers by type or id prefix; books are all others."""
    paper = (kind == "paper") | book.startswith(prefix)
    return paper if wanted == "paper" else ~paper if wanted == "book" else F.lit(True)


def years(date: Column, first: int | None, last: int | None) -> Column:
    """Dates compare as strings, so that YYYY and YYYYMM both work; the upper bound is open at the next year."""
    ok = F.lit(True)
    if first is not None:
        ok = ok & (date >= str(first))
    if last is not None:
        ok = ok & (date < str(last + 1))
    return ok


def dense_top(chunks: DataFrame, query: list[float], k: int, key: str = "doc_id") -> DataFrame:
    """key, score, rank of the k nearest by cosine; ends in a bounded top-k, not a sort of all rows."""
    vector = F.array(*(F.lit(float(x)) for x in query))
    scored = chunks.select(key, F.round(cosine(F.col("embedding"), vector), 6).alias("score"))
    top = scored.orderBy(F.col("score").desc(), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), key)))


def postings(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, token, weight: ln(1 + frequency)."""
    words = chunks.select(key, F.explode(tokens(F.col("text"))).alias("token"))
    return words.groupBy(key, "token").agg(F.log1p(F.count(F.lit(1))).alias("weight"))


def dense_hashed(chunks: DataFrame, key: str = "doc_id", dim: int = 64) -> DataFrame:
    """key, bucket, value: the part of a dense embedding of length 1 that differs from 0, without a model or Python.

    A token goes to the bucket that its MD5 names, with a sign; equal texts have equal vectors, common tokens pull alike.
    """
    words = chunks.select(key, F.explode(tokens(F.col("text"))).alias("token"))
    name = F.md5(F.col("token").cast("binary"))
    signed = words.select(key, (F.conv(F.substring(name, 1, 4), 16, 10).cast("long") % dim).cast("int").alias("bucket"), F.when(F.substring(name, 5, 1) < "8", 1.0).otherwise(-1.0).alias("sign"))
    sums = signed.groupBy(key, "bucket").agg(F.sum("sign").alias("value")).filter("value <> 0")
    lengths = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_length"))
    return sums.join(lengths, key).select(key, "bucket", F.round(F.col("value") / F.col("_length"), 6).alias("value"))


def sparse_query(text: str, drop: float = CONFIG.drop_ratio) -> dict[str, float]:
    """Token weights of a query, without those below the drop quantile."""
    from math import log1p

    words = pd.Series(text.lower().replace("\n", " ").split(" "))
    weights = words[words != ""].value_counts().map(log1p)
    return weights[weights >= weights.quantile(drop)].to_dict() if len(weights) else {}


def sparse_top(chunks: DataFrame, query: dict[str, float], k: int, key: str = "doc_id") -> DataFrame:
    """key, score, rank of the k best inner products. Query tokens filter the words before they are counted."""
    weights = F.create_map(*(x for t, w in query.items() for x in (F.lit(t), F.lit(w)))) if query else F.create_map().cast("map<string,double>")
    words = chunks.select(key, F.explode(F.filter(tokens(F.col("text")), lambda t: F.map_contains_key(weights, t))).alias("token"))
    found = words.groupBy(key, "token").agg((F.log1p(F.count(F.lit(1))) * F.first(F.element_at(weights, F.col("token")))).alias("w"))
    top = found.groupBy(key).agg(F.round(F.sum("w"), 6).alias("score")).orderBy(F.col("score").desc(), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), key)))


def candidate_sizes(k: Column, by_book: Column, by_date: Column) -> Column:
    """books and chunks to fetch for k results: books only where books are wanted, more of them for a sort by date."""
    books = k * F.when(by_date, CONFIG.sorted_multiplier).otherwise(CONFIG.book_multiplier)
    return F.struct(F.when(by_book, books).alias("books"), F.when(by_book, books * CONFIG.chunks_per_book).otherwise(k * CONFIG.chunk_multiplier).alias("chunks"))


def fuse(lists: list[DataFrame], k: int, key: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of ranked lists of bounded length."""
    both = lists[0].select(key, rrf(F.col("rank")).alias("part"))
    for other in lists[1:]:
        both = both.unionByName(other.select(key, rrf(F.col("rank")).alias("part")))
    return both.groupBy(key).agg(F.round(F.sum("part"), 6).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def by_book(hits: DataFrame) -> DataFrame:
    """book_id, hits, best, score, pub_date: meta chunks (index -1) count only where a book has no other hit."""
    body = F.col("chunk_idx") != -1
    rerank = F.coalesce(F.nullif(F.col("rerank"), F.lit(0.0)), F.col("score")) if "rerank" in hits.columns else F.col("score")
    out = hits.groupBy("book_id").agg(F.count_if(body).alias("hits"), F.coalesce(F.max(F.when(body, rerank)), F.max("score")).alias("best"), F.max_by("pub_date", F.struct("score", -F.col("chunk_idx"))).alias("pub_date"))
    return out.withColumn("score", F.round(boosted(F.col("best"), F.col("hits")), 6))


def lexical_rerank(hits: DataFrame, query: str) -> DataFrame:
    """Deterministic stand-in for a cross-encoder: sigmoid of the share of query tokens that a chunk holds."""
    words = sorted(set(query.lower().split()))
    share = F.size(F.array_intersect(F.array(*map(F.lit, words)), F.array_distinct(tokens(F.col("text"))))) / F.lit(max(1, len(words)))
    return hits.withColumn("rerank", F.round(1 / (1 + F.exp(-(8 * share - 4))), 6))


def search(chunks: DataFrame, vector: list[float], text: str, k: int = 5, wanted: str | None = None, first: int | None = None, last: int | None = None, sort: str = "relevance", limit: int | None = None) -> DataFrame:
    """Books for a query: filtered hybrid retrieval, fusion, grouping, boost. One lazy plan.

    sort: relevance, date_asc or date_desc; a date sort keeps the first k by date. limit cuts the result; without it
    up to the number of candidate books come back.
    """
    books = k * (CONFIG.book_multiplier if sort == "relevance" else CONFIG.sorted_multiplier)
    wide = books * CONFIG.chunks_per_book
    some = chunks.filter(scope(F.col("doc_type"), F.col("book_id"), wanted) & years(F.col("pub_date"), first, last))
    fused = fuse([dense_top(some, vector, wide), sparse_top(some, sparse_query(text), wide)], wide)
    hits = some.select("doc_id", "book_id", "chunk_idx", "pub_date").join(F.broadcast(fused), "doc_id")
    ranked = by_book(hits)
    if sort != "relevance":
        order = F.col("pub_date").asc() if sort == "date_asc" else F.col("pub_date").desc()
        return ranked.orderBy(order, "book_id").limit(k)
    ranked = ranked.orderBy(F.col("score").desc(), "book_id").limit(books)
    return ranked.limit(limit) if limit else ranked


def with_titles(books: DataFrame, catalog: DataFrame, queries: list[str]) -> DataFrame:
    """Scores combined with the best title match over the queries; books without a title keep theirs."""
    named = books.join(catalog.select("book_id", "title"), "book_id", "left")
    match = F.greatest(*(title_match(F.lit(q), F.col("title")) for q in queries), F.lit(0.0))
    return named.withColumn("relevance", F.when(F.coalesce(F.col("title"), F.lit("")) == "", F.col("score")).otherwise(combined(match, F.col("score"))))


def expand_context(hits: DataFrame, sections: DataFrame, budget: int = CONFIG.context_budget, reach: int = CONFIG.context_reach) -> DataFrame:
    """Sections around the hits of each query, in rank order, until the token budget is reached.

    hits: query_id, rank, book_id, center. A (book, center) seen before is skipped; a section is taken once; the first
    section that would overflow ends its hit. A query's hits are few (the caller's top-k), so one group is small.
    """
    from stackroom.operators.tables import band_join

    near = band_join(hits, sections.select("book_id", "section_idx", "tokens"), ["book_id"], "center", "section_idx", reach)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        spent, centers, taken, out = 0, set(), set(), []
        for (rank, book, center), part in pdf.sort_values(["rank", "section_idx"]).groupby(["rank", "book_id", "center"], sort=True):
            if (book, center) in centers:
                continue
            centers.add((book, center))
            for row in part.itertuples():
                if (book, row.section_idx) in taken:
                    continue
                if spent + row.tokens > budget:
                    break
                spent += row.tokens
                taken.add((book, row.section_idx))
                out.append((row.query_id, rank, book, row.section_idx, row.tokens))
        return pd.DataFrame(out, columns=["query_id", "rank", "book_id", "section_idx", "tokens"])

    return near.groupBy("query_id").applyInPandas(walk, "query_id long, rank int, book_id string, section_idx int, tokens long")


def embed_hashed(texts: Column, dim: int = 64) -> Column:
    """Deterministic stand-in for a dense embedder: a signed hashed bag of tokens, of length 1."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zlib

        import numpy as np

        for s in parts:
            rows = []
            for t in s:
                v = np.zeros(dim)
                for w in (t or "").lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % dim] += 1 if h >> 16 & 1 else -1
                n = np.linalg.norm(v)
                rows.append((v / n if n else v).astype("float32").tolist())
            yield pd.Series(rows)

    return run(texts)
