"""Vectors, ranking, filters and joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackroom.functions import biblio as B
from stackroom.functions import scoring as S
from stackroom.functions import text as T
from stackroom.operators import chunker, retrieval
from stackroom.operators.tables import band_join, reconcile, top_per_group

from .registry import CHUNKS, ITEMS, TITLES, chunks, items, query, table, titles

QUERY_TEXT = "the and onen threst hein"
_VEC = "q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0), v AS (SELECT c.*, e.embedding FROM chunks c JOIN embeddings e ON c.vec_id = e.vec_id)"
_COS = "round(list_dot_product(v.embedding::DOUBLE[], qe::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(qe::DOUBLE[], qe::DOUBLE[]))), 6)"
_WEIGHTS = "qw AS (SELECT t, ln(1 + count(*)) AS w FROM (SELECT unnest(string_split('" + QUERY_TEXT + "', ' ')) AS t) GROUP BY t)"
_WORDS = "SELECT doc_id, unnest(string_split_regex(lower(text), '[ \\n]+')) AS t FROM "


def _dense(where: str = "true", k: int = 150, src: str = "v") -> str:
    return f"dense AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, {_COS} AS score FROM v, q WHERE {where}) QUALIFY rank <= {k})"


def _sparse(where: str = "true", k: int = 150) -> str:
    return f"""tf AS (SELECT doc_id, t, ln(1 + count(*)) AS w FROM ({_WORDS} chunks v WHERE {where}) GROUP BY doc_id, t),
    sparse AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, round(sum(tf.w * qw.w), 6) AS score FROM tf JOIN qw USING (t) GROUP BY doc_id) QUALIFY rank <= {k})"""


def _fused(k: int = 150) -> str:
    return f"fused AS (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT doc_id, rank FROM dense UNION ALL SELECT doc_id, rank FROM sparse) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {k})"


_BOOKS = """b AS (SELECT book_id, count(*) FILTER (chunk_idx <> -1) AS hits, coalesce(max(score) FILTER (chunk_idx <> -1), max(score)) AS best, arg_max(pub_date, (score, -chunk_idx)) AS pub_date FROM fused JOIN chunks USING (doc_id) GROUP BY book_id),
    books AS (SELECT book_id, hits, best, pub_date, round(CASE WHEN hits > 1 THEN 1 - (1 - best) / (1 + 0.1 * log2(hits)) ELSE best END, 6) AS score FROM b)"""


def vectors(spark, d) -> DataFrame:
    return chunks(spark, d).join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")


def query_vector(spark, d) -> list[float]:
    return list(table(spark, d, "embeddings").filter("vec_id = 0").head()["embedding"])


@query(f"WITH {CHUNKS}, {_VEC}, {_dense(k=50)} SELECT * FROM dense")
def vec02_dense_topk(spark, d) -> DataFrame:
    return retrieval.dense_top(vectors(spark, d), query_vector(spark, d), 50)


@query(f"WITH {CHUNKS}, {_WEIGHTS}, {_sparse(k=50)} SELECT * FROM sparse")
def vec03_sparse_topk(spark, d) -> DataFrame:
    return retrieval.sparse_top(chunks(spark, d), retrieval.sparse_query(QUERY_TEXT), 50)


@query(f"WITH {CHUNKS}, {_VEC}, {_WEIGHTS}, {_dense()}, {_sparse()}, {_fused()} SELECT * FROM fused")
def vec04_rrf(spark, d) -> DataFrame:
    lists = [retrieval.dense_top(vectors(spark, d), query_vector(spark, d), 150), retrieval.sparse_top(chunks(spark, d), retrieval.sparse_query(QUERY_TEXT), 150)]
    return retrieval.fuse(lists, 150)


@query(f"WITH {CHUNKS}, {_VEC}, {_dense(k=60)} SELECT book_id, max(score) AS best, count(*) AS hits FROM dense JOIN chunks USING (doc_id) GROUP BY book_id ORDER BY best DESC, book_id LIMIT 10")
def vec06_by_book(spark, d) -> DataFrame:
    hits = retrieval.dense_top(vectors(spark, d), query_vector(spark, d), 60).join(chunks(spark, d), "doc_id")
    return hits.groupBy("book_id").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("hits")).orderBy(F.col("best").desc(), "book_id").limit(10)


@query(f"WITH {CHUNKS}, {_VEC}, {_dense('book_id <> (SELECT book_id FROM chunks WHERE doc_id = 0)', 25)} SELECT book_id, round(max(score), 4) AS score FROM dense JOIN chunks USING (doc_id) GROUP BY book_id ORDER BY max(score) DESC, book_id LIMIT 5")
def vec08_related(spark, d) -> DataFrame:
    mine = chunks(spark, d).filter("doc_id = 0").head()["book_id"]
    some = vectors(spark, d).filter(F.col("book_id") != mine)
    hits = retrieval.dense_top(some, query_vector(spark, d), 25).join(chunks(spark, d), "doc_id")
    best = hits.groupBy("book_id").agg(F.max("score").alias("best")).orderBy(F.col("best").desc(), "book_id").limit(5)
    return best.select("book_id", F.round("best", 4).alias("score"))


@query("""WITH h AS (SELECT doc_id, list_distinct(string_split_regex(lower(text), '[ \\n]+')) AS t FROM documents)
    SELECT doc_id, round(1 / (1 + exp(-(8 * len(list_intersect(t, ['the', 'and', 'onen', 'threst', 'hein'])) / 5.0 - 4))), 6) AS rerank FROM h""")
def rnk01_rerank(spark, d) -> DataFrame:
    return retrieval.lexical_rerank(table(spark, d, "documents"), QUERY_TEXT).select("doc_id", "rerank")


@query("""WITH h AS (SELECT doc_id, list_distinct(string_split_regex(lower(text), '[ \\n]+')) AS t FROM documents), r AS (SELECT doc_id, round(1 / (1 + exp(-(8 * len(list_intersect(t, ['the', 'and', 'onen', 'threst', 'hein'])) / 5.0 - 4))), 6) AS rerank FROM h)
    SELECT doc_id, rerank, row_number() OVER (ORDER BY rerank DESC, doc_id) AS place FROM r QUALIFY place <= 20""")
def rnk02_rerank_top(spark, d) -> DataFrame:
    top = rnk01_rerank(spark, d).orderBy(F.col("rerank").desc(), "doc_id").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("rerank").desc(), "doc_id")))


@query(f"WITH {CHUNKS}, {_VEC}, {_WEIGHTS}, {_dense()}, {_sparse()}, {_fused()}, {_BOOKS} SELECT * FROM books")
def rnk03_book_scores(spark, d) -> DataFrame:
    hits = chunks(spark, d).join(vec04_rrf(spark, d), "doc_id")
    return retrieval.by_book(hits).select("book_id", "hits", "best", "pub_date", "score")


_YEARS = "pub_date >= '2005' AND pub_date < '2021'"


@query(f"WITH {CHUNKS}, {_VEC}, {_WEIGHTS}, {_dense(_YEARS)}, {_sparse(_YEARS)}, {_fused()}, {_BOOKS} SELECT * FROM books ORDER BY score DESC, book_id LIMIT 15")
def rnk10_book_search(spark, d) -> DataFrame:
    got = retrieval.search(vectors(spark, d), query_vector(spark, d), QUERY_TEXT, 5, None, 2005, 2020)
    return got.select("book_id", "hits", "best", "pub_date", "score")


@query(f"WITH {CHUNKS}, {_VEC}, {_WEIGHTS}, {_dense(_YEARS, 200)}, {_sparse(_YEARS, 200)}, {_fused(200)}, {_BOOKS} SELECT * FROM books ORDER BY pub_date DESC, book_id LIMIT 5")
def rnk05_date_sorted(spark, d) -> DataFrame:
    got = retrieval.search(vectors(spark, d), query_vector(spark, d), QUERY_TEXT, 5, None, 2005, 2020, "date_desc")
    return got.select("book_id", "hits", "best", "pub_date", "score")


_NORM = "regexp_replace(lower(coalesce({0}, '')), '[^0-9a-z가-힣]', '', 'g')"
_BI = "CASE WHEN length({0}) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1) + 1), lambda i: substr({0}, i, 2))) END"
_MATCH = f"""n AS (SELECT page_id, title, {_NORM.format("'the erth than ' || title[1:12]")} AS q, {_NORM.format('title')} AS t FROM titles),
    g AS (SELECT *, {_BI.format('q')} AS a, {_BI.format('t')} AS b FROM n),
    m AS (SELECT page_id, title, round(least(1.0, CASE WHEN q = '' OR t = '' THEN 0.0 WHEN q = t THEN 1.0 WHEN length(t) >= 4 AND contains(q, t) THEN 1.0 WHEN contains(t, q) THEN length(q) / length(t) ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END), 4) AS score FROM g)"""


@query(f"WITH {TITLES}, {_MATCH} SELECT page_id, score FROM m")
def rnk06_title_match(spark, d) -> DataFrame:
    q = F.concat(F.lit("the erth than "), F.substring("title", 1, 12))
    return titles(spark, d).select("page_id", S.title_match(q, F.col("title")).alias("score"))


@query("SELECT doc_id, round(least(1.0, greatest(a, b) + (1 - greatest(a, b)) * least(a, b) * 0.4), 4) AS score FROM (SELECT doc_id, (doc_id % 7) / 7.0::DOUBLE AS a, (doc_id % 11) / 11.0::DOUBLE AS b FROM documents)")
def rnk07_combine(spark, d) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", S.combined(i % 7 / 7.0, i % 11 / 11.0).alias("score"))


@query(f"WITH {TITLES}, {_MATCH}, s AS (SELECT page_id, title, score, (page_id % 9) / 9.0::DOUBLE AS content FROM m) SELECT page_id, CASE WHEN title = '' THEN content ELSE round(least(1.0, greatest(score, content) + (1 - greatest(score, content)) * least(score, content) * 0.4), 4) END AS relevance FROM s")
def rnk08_title_scores(spark, d) -> DataFrame:
    q = F.concat(F.lit("the erth than "), F.substring("title", 1, 12))
    t = titles(spark, d).withColumn("score", F.col("page_id") % 9 / 9.0)
    return t.select("page_id", F.when(F.col("title") == "", F.col("score")).otherwise(S.combined(S.title_match(q, F.col("title")), F.col("score"))).alias("relevance"))


@query(f"""WITH RECURSIVE {CHUNKS}, c AS (SELECT doc_id, book_id, chunk_idx, CAST(greatest(1, floor(length(text) / 1.5)) AS BIGINT) AS tokens FROM chunks WHERE chunk_idx >= 0), h AS (SELECT doc_id // 200 AS query_id, CAST(doc_id % 200 AS INTEGER) AS rank, book_id, chunk_idx AS center FROM c WHERE doc_id % 20 = 0),
    n AS (SELECT query_id, rank, h.book_id, c.chunk_idx AS section_idx, tokens, row_number() OVER (PARTITION BY query_id ORDER BY rank, h.book_id, c.chunk_idx) AS i FROM h JOIN c ON h.book_id = c.book_id AND c.chunk_idx BETWEEN center - 2 AND center + 2),
    r AS (SELECT query_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS spent, []::VARCHAR[] AS taken, -1 AS stopped, false AS takes FROM (SELECT DISTINCT query_id FROM n)
        UNION ALL SELECT query_id, i, CASE WHEN fits THEN spent + tokens ELSE spent END, CASE WHEN fits THEN list_append(taken, k) ELSE taken END, CASE WHEN open AND NOT fits THEN rank ELSE stopped END, fits
        FROM (SELECT *, open AND spent + tokens <= 8000 AS fits FROM (SELECT r.query_id, n.i, spent, taken, stopped, n.rank, n.tokens, n.book_id || '/' || n.section_idx AS k, n.rank <> stopped AND NOT list_contains(taken, n.book_id || '/' || n.section_idx) AS open FROM r JOIN n ON n.query_id = r.query_id AND n.i = r.i + 1)))
    SELECT n.query_id, n.rank, n.book_id, CAST(n.section_idx AS INTEGER) AS section_idx, n.tokens FROM r JOIN n USING (query_id, i) WHERE takes""")
def rnk11_context(spark, d) -> DataFrame:
    c = chunks(spark, d).filter("chunk_idx >= 0")
    sections = c.select("book_id", F.col("chunk_idx").alias("section_idx"), T.token_estimate(F.col("text")).alias("tokens"))
    hits = c.filter("doc_id % 20 = 0").select(F.floor(F.col("doc_id") / 200).alias("query_id"), (F.col("doc_id") % 200).cast("int").alias("rank"), "book_id", F.col("chunk_idx").alias("center"))
    return retrieval.expand_context(hits, sections, budget=8000)


@query(f"WITH {CHUNKS} SELECT doc_id FROM chunks WHERE NOT (doc_type = 'paper' OR book_id LIKE 'b00000%')")
def flt01_scope(spark, d) -> DataFrame:
    return chunks(spark, d).filter(retrieval.scope(F.col("doc_type"), F.col("book_id"), "book", "b00000")).select("doc_id")


@query(f"WITH {CHUNKS} SELECT doc_id, pub_date FROM chunks WHERE doc_type = 'paper' AND {_YEARS}")
def flt02_scope_and_years(spark, d) -> DataFrame:
    c = chunks(spark, d)
    return c.filter(retrieval.scope(F.col("doc_type"), F.col("book_id"), "paper") & retrieval.years(F.col("pub_date"), 2005, 2020)).select("doc_id", "pub_date")


@query(f"WITH {CHUNKS} SELECT doc_id FROM chunks WHERE book_id = 'b000003'")
def flt04_one_book(spark, d) -> DataFrame:
    return chunks(spark, d).filter("book_id = 'b000003'").select("doc_id")


@query(f"WITH {TITLES} SELECT page_id, title FROM titles WHERE title ILIKE '%the%' ORDER BY page_id LIMIT 1")
def flt07_title_like(spark, d) -> DataFrame:
    return titles(spark, d).filter(F.col("title").ilike("%the%")).orderBy("page_id").limit(1).select("page_id", "title")


@query(f"WITH {ITEMS} SELECT id, job_id, stage FROM items WHERE status = 'failed' AND stage = 'indexed' AND coalesce(error_group, 'unknown') = 'llm_timeout'")
def flt08_item_filters(spark, d) -> DataFrame:
    return items(spark, d).filter("status = 'failed' AND stage = 'indexed' AND coalesce(error_group, 'unknown') = 'llm_timeout'").select("id", "job_id", "stage")


@query("SELECT doc_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS preview FROM documents")
def flt09_preview(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text"), 150).alias("preview"))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS embedded FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id)")
def flt10_embedded(spark, d) -> DataFrame:
    done = table(spark, d, "labels").filter("quality = 1").select("doc_id").distinct().withColumn("e", F.lit(True))
    return table(spark, d, "documents").select("doc_id").join(done, "doc_id", "left").select("doc_id", F.col("e").isNotNull().alias("embedded"))


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.plot') IS NULL AND event_type IN ('view', 'click')")
def flt11_missing_key(spark, d) -> DataFrame:
    return table(spark, d, "events").filter(F.get_json_object("props", "$.plot").isNull() & F.col("event_type").isin("view", "click")).select("event_id")


@query(f"WITH {CHUNKS} SELECT book_id, count(*) AS n FROM chunks WHERE length(text) > 500 GROUP BY book_id HAVING count(*) > 0")
def flt12_context_guard(spark, d) -> DataFrame:
    return chunks(spark, d).filter(F.length("text") > 500).groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT field, count(*) FILTER (v IS NOT NULL AND v <> '') AS filled, count(*) FILTER (v IS NULL OR v = '') AS empty FROM (SELECT unnest(['text', 'lang', 'source']) AS field, unnest([text, lang, CASE WHEN doc_id % 3 > 0 THEN source END]) AS v FROM documents) GROUP BY field")
def flt13_field_profile(spark, d) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "text", "lang", F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("source"))
    full = F.coalesce(F.col("v"), F.lit("")) != ""
    return t.unpivot("doc_id", ["text", "lang", "source"], "field", "v").groupBy("field").agg(F.count_if(full).alias("filled"), F.count_if(~full).alias("empty"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def flt14_lookup(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").filter("toxic = 1"), "doc_id", "left_semi")


@query(f"WITH {CHUNKS} SELECT doc_id FROM chunks WHERE book_id = 'b000001' AND chunk_idx BETWEEN 2 AND 4")
def flt15_section_range(spark, d) -> DataFrame:
    return chunks(spark, d).filter("book_id = 'b000001' AND chunk_idx BETWEEN 2 AND 4").select("doc_id")


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn01_hits_catalog(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")


@query("WITH i AS (SELECT unnest([5, 3, 999999, 8, 1]) AS doc_id, generate_subscripts([5, 3, 999999, 8, 1], 1) AS pos) SELECT CAST(pos AS INTEGER) AS pos, d.doc_id, source FROM i JOIN documents d ON i.doc_id = d.doc_id")
def jn02_ordered_ids(spark, d) -> DataFrame:
    ids = spark.range(1).select(F.posexplode(F.array(*map(F.lit, (5, 3, 999999, 8, 1)))).alias("p", "doc_id"))
    return table(spark, d, "documents").join(F.broadcast(ids), "doc_id").select((F.col("p") + 1).alias("pos"), "doc_id", "source")


@query("SELECT 7 - i AS id, i / 10.0::DOUBLE AS score FROM range(1, 6) t(i)")
def jn03_zip_scores(spark, d) -> DataFrame:
    pair = F.arrays_zip(F.array(*map(F.lit, (6, 5, 4, 3, 2))).alias("id"), F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.4, 0.5))).alias("score"))
    return spark.range(1).select(F.inline(pair).alias("id", "score")).withColumn("id", F.col("id").cast("long"))


_PIECES = "p AS (SELECT book_id, chunk_idx, length(text) AS n FROM chunks)"


@query(f"""WITH {CHUNKS}, {_PIECES}, c AS (SELECT book_id, chunk_idx, sum(n + 1) OVER w - n - 1 + n // 2 AS mid FROM p WINDOW w AS (PARTITION BY book_id ORDER BY chunk_idx)),
    s AS (SELECT book_id, chunk_idx // 2 AS section_idx, sum(n) + count(*) - 1 AS n FROM (SELECT book_id, chunk_idx + 1 AS chunk_idx, n FROM p) GROUP BY ALL),
    r AS (SELECT book_id, section_idx, sum(n + 2) OVER w - n - 2 AS a, sum(n + 2) OVER w AS b, max(section_idx) OVER (PARTITION BY book_id) AS last FROM s WINDOW w AS (PARTITION BY book_id ORDER BY section_idx)),
    hit AS (SELECT c.book_id, c.chunk_idx, CASE WHEN mid >= a AND mid < b THEN section_idx END AS section_idx, last FROM c JOIN r USING (book_id))
    SELECT book_id, chunk_idx, CAST(coalesce(max(section_idx), max(last)) AS BIGINT) AS section_idx FROM hit GROUP BY ALL""")
def jn04_chunk_sections(spark, d) -> DataFrame:
    c = chunks(spark, d).select("book_id", "chunk_idx", "text")
    joined = c.groupBy("book_id", F.floor((F.col("chunk_idx") + 1) / 2).alias("section_idx")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))), lambda x: x["text"]), " ").alias("text"))  # two chunks a section
    return chunker.assign_sections(c, joined)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents), s AS (SELECT * FROM l WHERE trim(t) <> ''),
    r AS (SELECT doc_id, page, sum(length(t) + 2) OVER w - length(t) - 2 AS a, sum(length(t) + 2) OVER w - 2 AS b FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
    p AS (SELECT doc_id, unnest([0, 100, 500]) AS pos FROM documents)
    SELECT p.doc_id, p.pos, page FROM p JOIN r ON p.doc_id = r.doc_id AND pos >= a AND pos < b""")
def jn05_positions_pages(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).withColumn("page_num", F.col("p") + 1)
    spans = chunker.joined_pages(lines, "doc_id").withColumnRenamed("page_num", "page")
    points = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(100), F.lit(500))).alias("pos"))
    return points.join(spans, "doc_id").filter("pos >= start AND pos < stop").select("doc_id", "pos", "page")


@query(f"WITH {CHUNKS}, t AS (SELECT book_id, arg_min(lang, chunk_idx) AS theme FROM chunks WHERE chunk_idx >= 0 AND source <> 'src0' GROUP BY book_id) SELECT doc_id, coalesce(theme, '') AS theme FROM chunks LEFT JOIN t USING (book_id)")
def jn06_chunk_themes(spark, d) -> DataFrame:
    c = chunks(spark, d)
    t = c.filter("chunk_idx >= 0 AND source <> 'src0'").groupBy("book_id").agg(F.min_by("lang", "chunk_idx").alias("theme"))
    return c.join(t, "book_id", "left").select("doc_id", F.coalesce("theme", F.lit("")).alias("theme"))


@query(f"WITH {CHUNKS}, h AS (SELECT doc_id AS hit, book_id, chunk_idx AS center FROM chunks WHERE doc_id % 20 = 0) SELECT hit, c.doc_id FROM h JOIN chunks c ON h.book_id = c.book_id AND c.chunk_idx BETWEEN center - 2 AND center + 2")
def jn07_band(spark, d) -> DataFrame:
    c = chunks(spark, d)
    h = c.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("hit"), "book_id", F.col("chunk_idx").alias("center"))
    return band_join(h, c.select("book_id", "chunk_idx", "doc_id"), ["book_id"], "center", "chunk_idx", 2).select("hit", "doc_id")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' WHEN d.doc_id IS NULL THEN 'right' ELSE 'both' END AS side FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def jn09_reconcile(spark, d) -> DataFrame:
    return reconcile(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("""SELECT coalesce(d.doc_id, l.doc_id, b.item_id) AS page, length(d.text) AS a, l.quality AS b, length(b.text) AS c FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id FULL JOIN benchmark b ON coalesce(d.doc_id, l.doc_id) = b.item_id""")
def jn10_three_extractors(spark, d) -> DataFrame:
    a = table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.length("text").alias("a"))
    b = table(spark, d, "labels").select(F.col("doc_id").alias("page"), F.col("quality").alias("b"))
    c = table(spark, d, "benchmark").select(F.col("item_id").alias("page"), F.length("text").alias("c"))
    return a.join(b, "page", "full_outer").join(c, "page", "full_outer").select("page", "a", "b", "c")


@query(f"WITH {CHUNKS}, {TITLES} SELECT c.doc_id, t.title FROM chunks c LEFT JOIN titles t ON c.doc_id = t.page_id")
def jn11_indexed_titles(spark, d) -> DataFrame:
    return chunks(spark, d).select("doc_id").join(titles(spark, d), F.col("doc_id") == F.col("page_id"), "left").select("doc_id", "title")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def jn12_id_sets(spark, d) -> DataFrame:
    labels = table(spark, d, "labels")
    return table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left_semi").join(labels.filter("quality = 1"), "doc_id", "left_anti").distinct()


@query("SELECT a.item_id AS answer, d.doc_id FROM benchmark a JOIN documents d ON d.doc_id // 100 = a.item_id WHERE regexp_matches('see p. ' || (a.item_id * 100 + 7) || ', ' || (a.item_id * 100 + 9), '(^|[^0-9])' || d.doc_id || '([^0-9]|$)')")
def jn14_citations(spark, d) -> DataFrame:
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("answer"), F.format_string("see p. %d, %d", F.col("item_id") * 100 + 7, F.col("item_id") * 100 + 9).alias("said"))
    hits = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 100).alias("answer"))
    return a.join(hits, "answer").filter(F.regexp(F.col("said"), F.concat(F.lit("(^|[^0-9])"), F.col("doc_id").cast("string"), F.lit("([^0-9]|$)")))).select("answer", "doc_id")


@query(f"WITH {TITLES}, q AS (SELECT unnest(['the', 'and']) AS q) SELECT q, page_id, contains(lower(title), q) AS found FROM q, titles")
def jn15_queries_candidates(spark, d) -> DataFrame:
    both = titles(spark, d).select("page_id", F.explode(F.array(F.lit("the"), F.lit("and"))).alias("q"), "title")
    return both.select("q", "page_id", F.contains(F.lower("title"), F.col("q")).alias("found"))


@query(f"WITH {CHUNKS} SELECT book_id, doc_id, row_number() OVER (PARTITION BY book_id ORDER BY length(text) DESC, doc_id) AS rank FROM chunks QUALIFY rank <= 3")
def ord06_top_chunks(spark, d) -> DataFrame:
    return top_per_group(chunks(spark, d).select("book_id", "doc_id", F.length("text").alias("n")), ["book_id"], [F.col("n").desc(), "doc_id"], 3).select("book_id", "doc_id", "rank")


@query("SELECT doc_id, 'b' || lpad(CAST(doc_id // 8 AS VARCHAR), 6, '0') || '__' || CASE WHEN doc_id % 8 = 0 THEN '-001' ELSE lpad(CAST(doc_id % 8 - 1 AS VARCHAR), 4, '0') END AS chunk_id FROM documents")
def snk03_chunk_id(spark, d) -> DataFrame:
    return chunks(spark, d).select("doc_id", B.chunk_id(F.col("book_id"), F.col("chunk_idx")).alias("chunk_id"))




@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'refs: ' || source WHEN doc_id % 3 = 0 THEN '[p. ' || (doc_id % 9) || '] ' || text ELSE 'question' END AS context FROM documents")
def msc14_chat_context(spark, d) -> DataFrame:
    i = F.col("doc_id")
    page = F.concat(F.lit("[p. "), (i % 9).cast("string"), F.lit("] "), "text")
    return table(spark, d, "documents").select("doc_id", F.when(i % 2 == 0, F.concat(F.lit("refs: "), "source")).when(i % 3 == 0, page).otherwise("question").alias("context"))


@query("WITH p AS (SELECT doc_id, doc_id // 8 AS paper, coalesce(CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 800) END, substr(source, 1, 800)) AS t FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY doc_id) AS place FROM p QUALIFY place <= 5) SELECT paper, md5(string_agg('[' || place || '] ' || substr(t, 1, 500), chr(10) ORDER BY place)) AS digest FROM r GROUP BY paper")
def msc15_paper_context(spark, d) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 8).alias("paper"), F.substring(F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("text")), F.col("source")), 1, 500).alias("t"))
    top = top_per_group(t, ["paper"], ["doc_id"], 5, "place")
    lines = top.groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("place", "t"))).alias("l"))  # at most 5 a paper
    return lines.select("paper", F.md5(F.array_join(F.transform("l", lambda x: F.concat(F.lit("["), x["place"].cast("string"), F.lit("] "), x["t"])), "\n")).alias("digest"))


@query(f"WITH {CHUNKS}, r AS (SELECT book_id, source, text, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) AS place FROM chunks QUALIFY place <= 5) SELECT book_id, place, '<' || source || '> ' || text AS line FROM r")
def msc16_answer_context(spark, d) -> DataFrame:
    top = top_per_group(chunks(spark, d).select("book_id", "doc_id", "source", "text"), ["book_id"], ["doc_id"], 5, "place")
    return top.select("book_id", "place", F.concat(F.lit("<"), "source", F.lit("> "), "text").alias("line"))


@query()
def rnk09_search_with_titles(spark, d) -> DataFrame:
    from stackroom.search import search

    catalog = chunks(spark, d).filter("chunk_idx = 0").select("book_id", F.substring("text", 1, 40).alias("title"))
    return search(vectors(spark, d), catalog, "the newest onen threst since 2005", query_vector(spark, d), 5)
