"""Scores: similarity, rank fusion, boosts and title matches. All are Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bigrams, normalized_title

#: Fixed values of the ranking.
RRF_K, BOOST, SECOND_WEIGHT, LEAST_TITLE = 60, 0.1, 0.4, 4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rrf(rank: Column, k: int = RRF_K) -> Column:
    return F.lit(1.0) / (rank + F.lit(k))


def boosted(best: Column, hits: Column) -> Column:
    """More hits close part of the gap to 1."""
    return F.when(hits > 1, 1 - (1 - best) / (1 + BOOST * F.log2(hits))).otherwise(best)


def title_match(query: Column, title: Column) -> Column:
    """1 for an equal title or one inside the query; the covered share for a query inside the title; else Dice of character pairs."""
    q, t = normalized_title(query), normalized_title(title)
    a, b = bigrams(q), bigrams(t)
    dice = 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))
    score = F.when((q == "") | (t == ""), 0.0).when(q == t, 1.0).when((F.length(t) >= LEAST_TITLE) & F.contains(q, t), 1.0).when(F.contains(t, q), F.length(q) / F.length(t)).otherwise(dice)
    return F.round(F.least(score, F.lit(1.0)), 4)


def combined(a: Column, b: Column) -> Column:
    """The larger score, raised by part of the smaller one."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.round(F.least(F.lit(1.0), high + (1 - high) * low * SECOND_WEIGHT), 4)
