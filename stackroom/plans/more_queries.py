"""The smaller operators of the inventory over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackroom.functions import biblio as B
from stackroom.functions import scoring as S
from stackroom.functions import text as T
from stackroom.operators import retrieval
from stackroom.operators.tables import first_wins
from stackroom.sources import catalog as C

from .registry import CHUNKS, ITEMS, NOW, TITLES, chunks, items, now, query, table, titles
from .search_queries import _COS, _VEC, query_vector, vectors


@query("SELECT CAST(o_orderkey AS VARCHAR) AS cnts_id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderstatus END AS title, CAST(o_custkey AS INTEGER) AS kci_citations, 0 AS wos_citations FROM orders WHERE o_orderkey % 5 > 0")
def src01_article_sheet(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    sheet = table(spark, d, "orders").select(F.when(k % 5 > 0, k.cast("string")).otherwise(" ").alias("kci_fi_id"), F.when(k % 3 > 0, F.col("o_orderstatus")).alias("Title_KR"), F.col("o_custkey").cast("string").alias("KCI_CITATIONS"), F.lit("n/a").alias("WOS_CITATIONS"))
    return C.articles(sheet).select("cnts_id", "title", "kci_citations", "wos_citations")


@query("SELECT CAST(page_id AS VARCHAR) AS cnts_id, CASE WHEN page_id % 3 = 0 THEN 'M' || page_id WHEN page_id % 2 = 0 THEN url ELSE CAST(page_id AS VARCHAR) END AS title, CASE WHEN page_id % 3 = 0 THEN 'MODS' ELSE 'NONE' END AS source_format FROM pages")
def src04_row_merge(spark, d) -> DataFrame:
    i = F.col("page_id")
    mods = F.concat(F.lit("<mods><titleInfo><title>M"), i.cast("string"), F.lit("</title></titleInfo></mods>"))
    sheet = table(spark, d, "pages").select(i.cast("string").alias("CONTENTS_ID"), F.when(i % 2 == 0, F.col("url")).otherwise("").alias("TITLE_INFO"), F.lit("").alias("MARC"), F.when(i % 3 == 0, mods).alias("MODS"))
    return C.merged_records(sheet).select("cnts_id", "title", "source_format")


@query("SELECT doc_id, source AS title, 'House ' || lang AS publisher FROM documents")
def src10_marc_loose(spark, d) -> DataFrame:
    raw = F.concat(F.lit("245 10$a"), "source", F.lit(" /$cX 260  $aPlace :$bHouse "), "lang", F.lit(",$c1999"))
    got = table(spark, d, "documents").withColumn("m", C.marc_loose(raw))
    return got.select("doc_id", "m.title", "m.publisher")


@query("SELECT doc_id, lang || chr(31) || source || chr(30) AS x FROM documents")
def src11_restore_controls(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.restore_controls(F.concat("lang", F.lit("_x001F_"), "source", F.lit("_x001E_"))).alias("x"))


@query("SELECT doc_id, '<a>' || source || ' &amp; ' || lang || ' &lt;</a>' AS x FROM documents")
def src13_clean_xml(spark, d) -> DataFrame:
    raw = F.concat(F.lit('<m:a xmlns:m="u">'), "source", F.lit(" & \x07"), "lang", F.lit(" &lt;</m:a>"))
    return table(spark, d, "documents").select("doc_id", C.clean_xml(raw).alias("x"))


@query("SELECT coalesce(a.page, b.page) AS page, coalesce(a.n, 0) AS chars_a, coalesce(b.n, 0) AS chars_b, CASE WHEN coalesce(a.n, 0) >= coalesce(b.n, 0) THEN 'a' ELSE 'b' END AS longer FROM (SELECT doc_id AS page, length(text) AS n FROM documents) a FULL JOIN (SELECT page_id AS page, length(html) AS n FROM pages) b ON a.page = b.page")
def src21_compare_extractors(spark, d) -> DataFrame:
    a = table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.length("text").alias("a"))
    b = table(spark, d, "pages").select(F.col("page_id").alias("page"), F.length("html").alias("b"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return a.join(b, "page", "full_outer").select("page", n("a").alias("chars_a"), n("b").alias("chars_b"), F.when(n("a") >= n("b"), "a").otherwise("b").alias("longer"))


@query("SELECT id, min(path) AS path, count(*) - 1 AS again FROM (SELECT trim(regexp_replace(source, '_+$', '')) AS id, lang || '/' || source || '/' || doc_id AS path FROM documents) GROUP BY id")
def src26_path_scan(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select(B.clean_id(F.col("source")).alias("id"), F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"))
    first, _ = first_wins(rows, ["id"], ["path"])
    return first.join(rows.groupBy("id").agg((F.count(F.lit(1)) - 1).alias("again")), "id")


@query("SELECT DISTINCT source AS id, min(doc_id) OVER (PARTITION BY source) AS first FROM documents")
def src30_listing_dedup(spark, d) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.col("source").alias("id")).agg(F.min("doc_id").alias("first"))


@query("SELECT doc_id, source AS grade, lang AS extra_grade FROM documents WHERE lang IS NOT NULL")
def snk02_dual_write(spark, d) -> DataFrame:
    extra = F.create_map(F.lit("grade"), F.col("source"), F.lit("lang"), F.col("lang"))
    return table(spark, d, "documents").dropna(subset=["lang"]).withColumn("extra", extra).select("doc_id", F.col("extra")["grade"].alias("grade"), F.col("extra")["lang"].alias("extra_grade"))


@query(f"WITH {CHUNKS} SELECT doc_id, doc_type, pub_date, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS publisher FROM chunks")
def snk04_scalar_meta(spark, d) -> DataFrame:
    return chunks(spark, d).select("doc_id", F.coalesce("doc_type", F.lit("")).alias("doc_type"), F.coalesce("pub_date", F.lit("")).alias("pub_date"), F.coalesce(F.when(F.col("doc_id") % 3 > 0, F.col("source")), F.lit("")).alias("publisher"))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'pending' ELSE 'embedded' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def snk11_finalize(spark, d) -> DataFrame:
    l = table(spark, d, "labels").select("doc_id", "quality")
    return table(spark, d, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.when(F.col("quality").isNull(), "pending").otherwise("embedded").alias("state"))


@query("SELECT user_id AS session_id, ts AS created_at, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'view'")
def snk12_history_rows(spark, d) -> DataFrame:
    e = table(spark, d, "events").filter("event_type = 'view'")
    return e.select(F.col("user_id").alias("session_id"), F.col("ts").alias("created_at"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT doc_id, 'originals/' || doc_id || '/' || doc_id || '.pdf' AS object_key FROM documents")
def snk15_manifest_rows(spark, d) -> DataFrame:
    line = F.to_json(F.struct("doc_id", F.format_string("originals/%d/%d.pdf", "doc_id", "doc_id").alias("object_key")))
    return table(spark, d, "documents").select(F.from_json(line, "doc_id long, object_key string").alias("m")).select("m.*")


@query(f"WITH {CHUNKS} SELECT book_id, count(*) FILTER (chunk_idx <> -1) AS shown, count(*) AS scored FROM chunks GROUP BY book_id")
def flt05_meta_hidden(spark, d) -> DataFrame:
    return chunks(spark, d).groupBy("book_id").agg(F.count_if(F.col("chunk_idx") != -1).alias("shown"), F.count(F.lit(1)).alias("scored"))


@query(f"WITH {CHUNKS} SELECT doc_id FROM chunks WHERE doc_type = 'paper' AND book_id <> 'b000000'")
def flt06_not_self(spark, d) -> DataFrame:
    return chunks(spark, d).filter("doc_type = 'paper' AND book_id <> 'b000000'").select("doc_id")


@query(f"WITH {CHUNKS}, {_VEC}, r AS (SELECT doc_id, {_COS} AS score FROM v, q WHERE doc_type = 'book') SELECT r.doc_id, score, coalesce(source, '') AS source, coalesce(pub_date, '') AS pub_date FROM r JOIN chunks USING (doc_id) ORDER BY score DESC, r.doc_id LIMIT 20")
def vec05_chunk_hits(spark, d) -> DataFrame:
    v = vectors(spark, d).filter("doc_type = 'book'")
    top = retrieval.dense_top(v, query_vector(spark, d), 20).drop("rank")
    return v.join(F.broadcast(top), "doc_id").select("doc_id", "score", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("pub_date", F.lit("")).alias("pub_date"))


@query("SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def mth02_dot(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select("vec_id", F.round(S.dot(F.col("embedding"), F.col("next")), 6).alias("dot"))


@query("SELECT n AS hits, round(CASE WHEN n > 1 THEN 1 - 0.5 / (1 + 0.1 * log2(n)) ELSE 0.5 END, 6) AS score FROM (SELECT DISTINCT l_linenumber AS n FROM lineitem)")
def rnk04_boost(spark, d) -> DataFrame:
    n = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("hits")).distinct()
    return n.select("hits", F.round(S.boosted(F.lit(0.5), F.col("hits")), 6).alias("score"))


@query("SELECT lang, count(DISTINCT source) AS sources, list_sort(list(DISTINCT source)) AS names FROM documents GROUP BY lang")
def agg11_manifest_report(spark, d) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.array_sort(F.collect_set("source")).alias("names"))


@query("SELECT user_id, max(value) AS best FROM events GROUP BY user_id")
def agg13_max_per_group(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("best"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'n.d.' ELSE CAST(1900 + doc_id % 99 AS VARCHAR) END AS year FROM documents")
def str09_citation_year(spark, d) -> DataFrame:
    date = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("c"), (1900 + F.col("doc_id") % 99).cast("string"), F.lit(" rev.")))
    return table(spark, d, "documents").select("doc_id", B.year_or_nd(date).alias("year"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['A', 'B, C'] WHEN 1 THEN ['A', 'B'] ELSE [] END AS names FROM documents")
def str10_author_names(spark, d) -> DataFrame:
    i = F.col("doc_id")
    raw = F.when(i % 3 == 0, " A ;B, C; ").when(i % 3 == 1, "A, ,B").otherwise("  ")
    return table(spark, d, "documents").select("doc_id", B.author_names(raw).alias("names"))


@query("SELECT doc_id, string_split(source, 'c')[1] || ' and ' || (doc_id % 4) || ' more' AS shown, CAST(2000 + doc_id % 25 AS VARCHAR) || '.07' AS date FROM documents")
def str24_display(spark, d) -> DataFrame:
    i = F.col("doc_id")
    raw = F.concat((2000 + i % 25).cast("string"), F.lit("07"))
    return table(spark, d, "documents").select("doc_id", F.concat(F.get(F.split("source", "c"), F.lit(0)), F.lit(" and "), (i % 4).cast("string"), F.lit(" more")).alias("shown"), F.regexp_replace(raw, r"^(\d{4})(\d{2})$", "$1.$2").alias("date"))


@query("SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n, list_filter(list_transform(string_split(source || ',' || lang, ','), lambda s: trim(s)), lambda s: s <> '')[1:12] AS words FROM documents")
def str08_legacy_summary(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("n"), T.keyword_list(F.concat_ws(",", "source", "lang"), 12, ",").alias("words"))


@query(f"WITH {ITEMS} SELECT id, CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(updated_at)) / 1000000) AS BIGINT) AS age, updated_at >= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AS recent FROM items")
def dat01_age(spark, d) -> DataFrame:
    age = F.floor((F.unix_micros(now().cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 1_000_000)
    return items(spark, d).select("id", age.alias("age"), (F.col("updated_at") >= now() - F.expr("INTERVAL 1 HOUR")).alias("recent"))


@query("SELECT vec_id, CAST(floor(label / 10.0::DOUBLE * 100) AS BIGINT) AS percent FROM embeddings")
def ui09_percent(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.floor(F.col("label") / 10 * 100).alias("percent"))


@query("SELECT page_id, string_split(url, '/')[3] AS host, list_filter(string_split(url, '/'), lambda s: s LIKE '%e%') AS with_e FROM pages")
def msc06_first_and_all(spark, d) -> DataFrame:
    parts = F.split("url", "/")
    return table(spark, d, "pages").select("page_id", F.get(parts, F.lit(2)).alias("host"), F.filter(parts, lambda s: s.contains("e")).alias("with_e"))


@query("SELECT doc_id, CASE WHEN length(text) < 200 THEN 'skip' WHEN len(string_split(text, chr(10))) < 3 THEN 'ask' WHEN len(string_split(text, chr(10))) > 50 THEN 'ask' ELSE 'keep' END AS step FROM documents")
def msc08_enrichment_steps(spark, d) -> DataFrame:
    n = F.size(F.split("text", "\n"))
    return table(spark, d, "documents").select("doc_id", F.when(F.length("text") < 200, "skip").when((n < 3) | (n > 50), "ask").otherwise("keep").alias("step"))


@query(f"""WITH {ITEMS} SELECT id, '{{"id":' || id || ',"status":"' || status || '"}}' AS row FROM items""")
def msc09_row_json(spark, d) -> DataFrame:
    return items(spark, d).select("id", F.to_json(F.struct("id", "status")).alias("row"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE lang || ' ' || source END AS cited FROM documents")
def msc12_language_pick(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", F.col("source")).otherwise(F.concat_ws(" ", "lang", "source")).alias("cited"))


@query(f"WITH {TITLES} SELECT page_id, title FROM titles WHERE NOT (title <> '' AND page_id % 2 = 0)")
def stm13_still_to_do(spark, d) -> DataFrame:
    return titles(spark, d).filter(~((F.col("title") != "") & (F.col("page_id") % 2 == 0))).select("page_id", "title")


@query("SELECT l_suppkey, n_name, sum(l_quantity) AS quantity, rank() OVER (PARTITION BY n_name ORDER BY sum(l_quantity) DESC) AS place FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_shipdate >= DATE '1995-01-01' GROUP BY l_suppkey, n_name")
def ext01_star_join_rank(spark, d) -> DataFrame:
    supplier = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    rows = table(spark, d, "lineitem").filter("l_shipdate >= DATE '1995-01-01'").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_suppkey", "n_name").agg(F.sum("l_quantity").alias("quantity"))
    return rows.select("l_suppkey", "n_name", "quantity", F.rank().over(Window.partitionBy("n_name").orderBy(F.col("quantity").desc())).alias("place"))
