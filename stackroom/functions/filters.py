"""Year bounds and a sort hint in queries in words, by rules: the rules of `search.read_filter` as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_filter(query: Column, this_year: int = 2024) -> Column:
    """year_from, year_to, sort_by, has_filter of a query; null counts as empty."""
    q = F.lower(F.coalesce(query, F.lit("")))
    years = F.transform(F.regexp_extract_all(q, F.lit(r"(?<![0-9])(1[89][0-9]{2}|20[0-9]{2})(?![0-9])"), F.lit(1)), lambda y: y.cast("int"))
    recent = F.regexp_extract(q, r"(?:last|recent|최근)\s*([0-9]{1,2})\s*(?:years?|년)", 1)
    one, two = F.get(years, F.lit(0)), F.get(years, F.lit(1))
    says = lambda pattern: q.rlike(pattern)
    # the first rule that holds decides both bounds
    rules = [
        (recent != "", F.lit(this_year) - F.try_to_number(recent, F.lit("99")).cast("int"), None),
        (two.isNotNull() & says("between|from|~|-|부터|에서"), F.least(one, two), F.greatest(one, two)),
        (one.isNotNull() & says("since|after|from|이후|부터"), one, None),
        (one.isNotNull() & says("before|until|by |이전|까지"), None, one - says("before|이전").cast("int")),
        (one.isNotNull(), one, one),
    ]
    none = F.lit(None).cast("int")
    first, last = none, none
    for holds, low, high in reversed(rules):
        first = F.when(holds, none if low is None else low).otherwise(first)
        last = F.when(holds, none if high is None else high).otherwise(last)
    sort = F.when(says("newest|latest|most recent|최신"), "date_desc").when(says("oldest|earliest|오래된"), "date_asc").otherwise("relevance")
    return F.struct(first.alias("year_from"), last.alias("year_to"), sort.alias("sort_by"), (first.isNotNull() | last.isNotNull() | (sort != "relevance")).alias("has_filter"))
