"""Chunking, string and JSON operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackroom.functions import biblio as B
from stackroom.functions import replies as R
from stackroom.functions import text as T
from stackroom.operators import boundaries, chunker, papers

from .registry import CHUNKS, TITLES, chunks, query, table, titles

_BREAKS = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\n{2,}', chr(1), 'g'), '\n', ' ', 'g'), chr(1), chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))"
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.?!。])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 6)"


@query("SELECT doc_id, greatest(1, CAST(floor(length(text) / 1.5) AS BIGINT)) AS tokens FROM documents")
def ch01_token_estimate(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, md5({_BREAKS}) AS digest FROM documents")
def ch02_line_breaks(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_breaks(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, len(s) AS n, CAST(list_sum(list_transform(s, lambda x: length(x))) AS BIGINT) AS chars FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents) WHERE len(s) > 0")
def ch03_sentences(spark, d) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s")).filter(F.size("s") > 0)
    return s.select("doc_id", F.size("s").alias("n"), F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x)).alias("chars"))


@query(f"""WITH RECURSIVE b AS (SELECT item_id, text, {_SENTENCES} AS s FROM benchmark WHERE text IS NOT NULL), r AS (SELECT item_id, text, s, 0 AS i, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS stop, CAST(NULL AS VARCHAR) AS found FROM b
    UNION ALL SELECT item_id, text, s, i + 1, stop + pos - 1, CASE WHEN pos > 0 THEN stop + pos - 1 + length(s[i + 1]) ELSE stop END, CASE WHEN pos > 0 THEN s[i + 1] END FROM (SELECT *, instr(substr(text, stop + 1), s[i + 1]) AS pos FROM r WHERE i < len(s)))
    SELECT item_id, found AS text, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM r WHERE found IS NOT NULL""")
def ch04_sentence_spans(spark, d) -> DataFrame:
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.explode(T.sentence_spans(F.col("text"))).alias("s")).select("item_id", "s.text", "s.start", "s.stop")


@query()
def ch05_byte_split(spark, d) -> DataFrame:
    return chunker.chunks(table(spark, d, "documents"), least=1, most=1 << 30)


@query("""WITH v AS (SELECT label AS doc, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n, embedding FROM embeddings),
    x AS (SELECT doc, i, n, unnest(range(1, len(embedding) + 1)) AS dim, unnest(embedding)::DOUBLE AS x FROM v),
    m AS (SELECT doc, i, n, dim, avg(x) OVER (PARTITION BY doc, dim ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l, avg(x) OVER (PARTITION BY doc, dim ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS r FROM x),
    s AS (SELECT doc, i, round(sum(l * r) / (sqrt(sum(l * l)) * sqrt(sum(r * r)) + 1e-8), 6) AS similarity FROM m WHERE i >= 3 AND i < n - 3 GROUP BY doc, i),
    t AS (SELECT doc, quantile_cont(similarity, 0.25) AS least FROM s GROUP BY doc)
    SELECT s.doc, s.i, similarity FROM s JOIN t USING (doc) WHERE similarity < least""")
def ch06_boundaries(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    return boundaries.boundaries(e.select(F.col("label").alias("doc"), "i", "embedding"))


@query()
def ch09_semantic_chunks(spark, d) -> DataFrame:
    return chunker.chunks(table(spark, d, "documents"))


@query()
def ch10_sections(spark, d) -> DataFrame:
    return chunker.sections(table(spark, d, "documents"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS page_num FROM documents), s AS (SELECT * FROM p WHERE trim(t) <> '')
    SELECT doc_id, page_num, CAST(sum(length(t) + 2) OVER w - length(t) - 2 AS BIGINT) AS start, CAST(sum(length(t) + 2) OVER w - 2 AS BIGINT) AS stop FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY page_num)""")
def ch11_page_offsets(spark, d) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).withColumn("page_num", F.col("p") + 1)
    return chunker.joined_pages(lines, "doc_id")


@query(f"WITH {CHUNKS} SELECT doc_id, md5(concat_ws(chr(10), CASE WHEN chunk_idx % 2 = 0 THEN '[themes] ' || source END, CASE WHEN chunk_idx % 3 = 0 THEN '[context] ' || lang END, '[body] ' || text)) AS digest FROM chunks")
def ch12_contextual_text(spark, d) -> DataFrame:
    c = chunks(spark, d)
    return c.select("doc_id", F.md5(B.contextual_text(F.when(F.col("chunk_idx") % 2 == 0, F.col("source")), F.when(F.col("chunk_idx") % 3 == 0, F.col("lang")), F.col("text"))).alias("digest"))


@query(f"WITH {CHUNKS} SELECT doc_id, concat_ws(' | ', CASE WHEN chunk_idx = 2 THEN NULL ELSE source END, lang, pub_date) AS meta FROM chunks")
def ch13_meta_text(spark, d) -> DataFrame:
    return chunks(spark, d).select("doc_id", B.meta_text(F.when(F.col("chunk_idx") != 2, F.col("source")).otherwise(""), F.col("lang"), F.col("pub_date")).alias("meta"))


@query("SELECT doc_id, md5(coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE nullif(text, '') END, CASE WHEN doc_id % 2 = 0 THEN source END, concat_ws(' | ', source, lang))) AS digest FROM documents")
def ch14_fallback_text(spark, d) -> DataFrame:
    t = table(spark, d, "documents")
    body = F.when(F.col("doc_id") % 3 != 0, F.nullif("text", F.lit("")))
    return t.select("doc_id", F.md5(F.coalesce(body, F.when(F.col("doc_id") % 2 == 0, F.col("source")), B.meta_text(F.col("source"), F.col("lang")))).alias("digest"))


@query("""WITH c AS (SELECT doc_id // 8 AS book, 0 AS kind, doc_id AS k FROM documents UNION ALL SELECT doc_id // 8, 1, doc_id FROM labels)
    SELECT book, kind, k, row_number() OVER (PARTITION BY book ORDER BY kind, k) - 1 AS chunk_idx FROM c""")
def ch15_appended_chunks(spark, d) -> DataFrame:
    part = lambda t, kind: table(spark, d, t).select(F.floor(F.col("doc_id") / 8).alias("book"), F.lit(kind).alias("kind"), F.col("doc_id").alias("k"))
    return part("documents", 0).unionByName(part("labels", 1)).withColumn("chunk_idx", F.row_number().over(Window.partitionBy("book").orderBy("kind", "k")) - 1)


@query(r"""SELECT doc_id, md5(trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(text || chr(10) || '- 12 -' || chr(10) || '7' || chr(10) || ' 3 / 80 ', chr(10)), lambda s: trim(s)), lambda s: NOT regexp_full_match(s, '-\s*\d+\s*-|\d+|\d+\s*/\s*\d+')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'))) AS digest FROM documents""")
def ch16_clean_page(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_page(F.concat("text", F.lit("\n- 12 -\n7\n 3 / 80 ")))).alias("digest"))


@query("""WITH l AS (SELECT doc_id, string_split(text, ' ') AS items FROM documents), n AS (SELECT *, len(items) AS n, 7 AS keep FROM l)
    SELECT doc_id, md5(array_to_string(CASE WHEN keep >= n THEN items ELSE list_transform(range(0, keep), lambda i: items[least(n - 1, CAST(floor(i * n / keep) AS BIGINT)) + 1]) END, ' ')) AS digest FROM n""")
def ch18_even_sample(spark, d) -> DataFrame:
    items = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("items"))
    return items.select("doc_id", F.md5(F.array_join(T.evenly_spaced(F.col("items"), F.lit(7)), " ")).alias("digest"))


@query("SELECT doc_id, trim(regexp_replace(trim(' ' || source || '__ '), '_+$', '')) AS id FROM documents")
def str01_clean_id(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", B.clean_id(F.concat(F.lit(" "), "source", F.lit("__ "))).alias("id"))


_KEY = "CASE doc_id % 4 WHEN 0 THEN 'originals/' || source || '/' || doc_id || '.pdf' WHEN 1 THEN 'originals/' || doc_id || '.PDF' WHEN 2 THEN doc_id || '.pdf' ELSE 'originals/' || doc_id || '.txt' END"


@query(f"""WITH k AS (SELECT doc_id, {_KEY} AS key FROM documents), p AS (SELECT doc_id, key, string_split(key, '/') AS p FROM k)
    SELECT doc_id, CASE WHEN lower(key) LIKE '%.pdf' THEN CASE len(p) WHEN 3 THEN p[2] WHEN 2 THEN regexp_replace(p[2], '\\.[^.]*$', '') END END AS id FROM p""")
def str02_id_of_key(spark, d) -> DataFrame:
    i = F.col("doc_id").cast("string")
    r = F.col("doc_id") % 4
    key = F.when(r == 0, F.concat(F.lit("originals/"), "source", F.lit("/"), i, F.lit(".pdf"))).when(r == 1, F.concat(F.lit("originals/"), i, F.lit(".PDF"))).when(r == 2, F.concat(i, F.lit(".pdf"))).otherwise(F.concat(F.lit("originals/"), i, F.lit(".txt")))
    return table(spark, d, "documents").select("doc_id", B.id_of_key(key).alias("id"))


@query("""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'thesis' END AS genre, CASE WHEN doc_id % 7 > 0 THEN CAST(doc_id % 1000 AS VARCHAR) || '.1' END AS kdc, CASE WHEN doc_id % 5 = 0 THEN '조달 안내' ELSE source END AS title FROM documents),
    n AS (SELECT *, CAST(nullif(substr(regexp_replace(coalesce(kdc, ''), '[^0-9]', '', 'g'), 1, 3), '') AS INTEGER) AS n FROM m)
    SELECT doc_id, CASE WHEN genre IN ('paper', 'thesis', 'report') THEN 'paper' WHEN n BETWEEN 800 AND 899 THEN 'literature' WHEN n BETWEEN 320 AND 359 THEN 'policy' WHEN title LIKE '%조달%' THEN 'policy' ELSE 'book' END AS doc_type FROM n""")
def str03_doc_type(spark, d) -> DataFrame:
    i = F.col("doc_id")
    genre = F.when(i % 11 == 0, "thesis")
    kdc = F.when(i % 7 > 0, F.concat((i % 1000).cast("string"), F.lit(".1")))
    title = F.when(i % 5 == 0, "조달 안내").otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", B.doc_type(genre, kdc, title).alias("doc_type"))


@query(r"SELECT doc_id, regexp_replace(trim(source || ' / , '), '[ ,./;:]+$', '') AS name, coalesce(nullif(regexp_extract('c' || (1900 + doc_id % 120) || '.', '(\d{4})', 1), ''), '') AS year FROM documents")
def str04_punctuation_and_year(spark, d) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select("doc_id", T.strip_punctuation(F.concat("source", F.lit(" / , "))).alias("name"), T.year(F.concat(F.lit("c"), (1900 + F.col("doc_id") % 120).cast("string"), F.lit("."))).alias("year"))


@query("SELECT doc_id, CASE WHEN k IN ('paper', 'book', 'literature', 'policy') THEN k ELSE 'book' END AS kind FROM (SELECT doc_id, ['paper', 'x', 'policy'][doc_id % 3 + 1] AS k FROM documents)")
def str05_known_type(spark, d) -> DataFrame:
    kinds = F.array(*map(F.lit, ("paper", "x", "policy")))
    return table(spark, d, "documents").select("doc_id", B.known_type(F.get(kinds, (F.col("doc_id") % 3).cast("int"))).alias("kind"))


@query(f"WITH {TITLES} SELECT page_id, trim(title) AS summary, [x FOR x IN list_transform(string_split(title, ' '), lambda s: regexp_replace(s, '^[*#\\s]+|[*#\\s]+$', '', 'g')) IF x <> ''][1:20] AS themes FROM titles WHERE title <> '' AND NOT regexp_matches(title, '[*#,]')")
def str06_summary_themes(spark, d) -> DataFrame:
    t = titles(spark, d).filter((F.col("title") != "") & ~F.col("title").rlike("[*#,]"))
    body, themes = R.summary_and_themes(F.concat(F.lit("**SUMMARY:** "), "title", F.lit("\n**THEMES:** "), F.translate("title", " ", ",")))
    return t.select("page_id", body.alias("summary"), themes.alias("themes"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN regexp_replace(substr(text, 1, 200), ' [^ ]*$', '') || '…' ELSE text END AS cut FROM documents")
def str07_cut_at_word(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.cut_at_word(F.col("text"), 200).alias("cut"))


_AUTHORS = "CASE doc_id % 4 WHEN 0 THEN 'A. One; B. Two' WHEN 1 THEN 'A, B , C, D' WHEN 2 THEN '' ELSE source END"


@query(f"""WITH a AS (SELECT doc_id, source, {_AUTHORS} AS raw FROM documents), n AS (SELECT *, list_filter(list_transform(string_split(raw, CASE WHEN contains(raw, ';') THEN ';' ELSE ',' END), lambda s: trim(s)), lambda s: s <> '') AS names FROM a)
    SELECT doc_id, CASE WHEN len(names) = 0 THEN 'Unknown Author' WHEN len(names) > 3 THEN names[1] || ' et al.' ELSE array_to_string(names, ', ') END || ' (' || (CASE WHEN doc_id % 5 = 0 THEN 'n.d.' ELSE CAST(2000 + doc_id % 25 AS VARCHAR) END) || '). ' || source || '. Journal' || CASE WHEN doc_id % 2 = 0 THEN ', 3(1)' ELSE '' END || '.' AS cited FROM n""")
def str11_citation(spark, d) -> DataFrame:
    i = F.col("doc_id")
    raw = F.when(i % 4 == 0, "A. One; B. Two").when(i % 4 == 1, "A, B , C, D").when(i % 4 == 2, "").otherwise(F.col("source"))
    date = F.when(i % 5 != 0, F.concat((2000 + i % 25).cast("string"), F.lit("07")))
    cited = B.citation(B.authors(raw, most=3), date, F.concat("source", F.lit("..")), F.lit("Journal"), F.when(i % 2 == 0, "3(1)"), F.lit(""))
    return table(spark, d, "documents").select("doc_id", cited.alias("cited"))


@query("SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[,;|/·]'), lambda s: trim(s)), lambda s: s <> '')[1:5] AS words FROM documents")
def str12_keywords(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.keyword_list(F.col("text"), 5).alias("words"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN source END, CASE WHEN doc_id % 2 = 0 THEN lang END, 'none') AS keyword FROM documents")
def str13_keyword_fallback(spark, d) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.when(i % 3 == 0, F.col("source")), F.when(i % 2 == 0, F.col("lang")), F.lit("none")).alias("keyword"))


@query()
def str14_to_18_paper_parts(spark, d) -> DataFrame:
    return papers.enrich(table(spark, d, "documents"))


@query("""SELECT conv_id, turn, array_to_string(array_agg(upper(role) || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), chr(10)) AS history FROM conversations WHERE trim(coalesce(text, '')) <> ''""")
def str19_chat_history(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-5, 0)
    return c.select("conv_id", "turn", F.array_join(F.collect_list(F.concat(F.upper("role"), F.lit(": "), "text")).over(w), "\n").alias("history"))


@query("SELECT conv_id, turn, regexp_matches(lower(text), 'the|que|der') AS asks FROM conversations WHERE text IS NOT NULL")
def str20_intent(spark, d) -> DataFrame:
    return table(spark, d, "conversations").dropna(subset=["text"]).select("conv_id", "turn", F.lower("text").rlike("the|que|der").alias("asks"))


@query("SELECT doc_id, nullif(regexp_extract('books like ' || source || ' please', '^books like (.+?) please$', 1), '') AS like_title FROM documents")
def str21_books_like(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.nullif(F.regexp_extract(F.concat(F.lit("books like "), "source", F.lit(" please")), "^books like (.+?) please$", 1), F.lit("")).alias("like_title"))


@query(f"WITH {CHUNKS} SELECT book_id, array_to_string(list('[' || (chunk_idx + 2) || '] ' || source || ': ' || substr(text, 1, 50) ORDER BY chunk_idx), chr(10)) AS block FROM chunks GROUP BY book_id")
def str22_context_blocks(spark, d) -> DataFrame:
    line = F.concat(F.lit("["), (F.col("chunk_idx") + 2).cast("string"), F.lit("] "), "source", F.lit(": "), F.substring("text", 1, 50))
    lines = chunks(spark, d).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", line.alias("line")))).alias("l"))  # at most 8 chunks a book
    return lines.select("book_id", F.array_join("l.line", "\n").alias("block"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [] ELSE [source] END AS ids FROM documents")
def jsn01_reply_items(spark, d) -> DataFrame:
    i = F.col("doc_id")
    good = F.concat(F.lit('Here:\n```json\n{"intro":"x","items":[{"book_id":"'), "source", F.lit('","reason":"r"},{"reason":"no id"}]}\n```'))
    reply = F.when(i % 3 == 0, F.lit("no json {broken")).otherwise(good)
    return table(spark, d, "documents").select("doc_id", F.transform(R.reply_items(reply), lambda x: x["book_id"]).alias("ids"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [lang] ELSE [source] END AS ids FROM documents")
def jsn02_fallback_items(spark, d) -> DataFrame:
    found = jsn01_reply_items(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return found.select("doc_id", F.when(F.size("ids") > 0, F.col("ids")).otherwise(F.array("lang")).alias("ids"))


@query("SELECT doc_id, 2000 + doc_id % 20 AS year_from, CASE WHEN doc_id % 2 = 0 THEN 'date_desc' ELSE 'relevance' END AS sort_by FROM documents")
def jsn03_filter_reply(spark, d) -> DataFrame:
    i = F.col("doc_id")
    reply = F.concat(F.lit('```json\n{"year_from": '), (2000 + i % 20).cast("string"), F.when(i % 2 == 0, ', "sort_by": "date_desc"').otherwise(""), F.lit("}\n```"))
    got = F.from_json(R.fenced_json(reply), "year_from long, sort_by string")
    return table(spark, d, "documents").select("doc_id", got["year_from"].alias("year_from"), F.coalesce(got["sort_by"], F.lit("relevance")).alias("sort_by"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS a, 'old' AS b, CASE WHEN doc_id % 2 = 0 THEN 'new' END AS c FROM documents")
def jsn04_merge(spark, d) -> DataFrame:
    old = F.create_map(F.lit("a"), F.col("source"), F.lit("b"), F.lit("old"))
    new = F.create_map(F.lit("a"), F.col("lang"), F.lit("c"), F.lit("new"))
    m = F.when(F.col("doc_id") % 2 == 0, B.merged(old, new)).otherwise(old)
    return table(spark, d, "documents").withColumn("m", m).select("doc_id", *(F.col("m")[k].alias(k) for k in "abc"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 1 AS n_kept FROM events")
def jsn05_scalar_meta(spark, d) -> DataFrame:
    m = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("list"), F.lit("[1]"), F.lit("none"), F.lit(None).cast("string"))
    kept = F.map_filter(m, lambda k, v: v.isNotNull() & ~v.rlike(r"^[\[{]"))
    return table(spark, d, "events").withColumn("m", kept).select("event_id", F.col("m")["k"].cast("int").alias("k"), F.size("m").alias("n_kept"))


@query("SELECT doc_id, list_slice(list_filter(string_split(text, ' '), lambda s: s <> ''), 1, 3) AS head, list_position(string_split(text, ' '), 'the') AS at FROM documents")
def arr01_lists(spark, d) -> DataFrame:
    words = F.split("text", " ")
    return table(spark, d, "documents").select("doc_id", F.slice(F.filter(words, lambda s: s != ""), 1, 3).alias("head"), F.nullif(F.array_position(words, "the"), F.lit(0)).cast("int").alias("at"))


@query("SELECT doc_id, length(text) AS n, round(log2(length(text) + 1), 6) AS l, round(1 / (1 + exp(-(length(text) % 10) / 3.0)), 6) AS s FROM documents")
def mth01_math(spark, d) -> DataFrame:
    n = F.length("text")
    return table(spark, d, "documents").select("doc_id", n.alias("n"), F.round(F.log2(n + 1), 6).alias("l"), F.round(1 / (1 + F.exp(-(n % 10) / 3.0)), 6).alias("s"))


@query("SELECT doc_id, substr(text, 1, list_max(list_filter(range(0, 101), lambda k: strlen(substr(text, 1, CAST(k AS INTEGER))) <= 100))) AS cut FROM documents")
def snk05_truncate_bytes(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.truncate_bytes(F.col("text"), 100).alias("cut"))


@query("SELECT doc_id, [lang, source] AS keywords, 'Body ' || source AS body, 'After ' || lang AS effect FROM documents")
def stm01_reply_parts(spark, d) -> DataFrame:
    text = F.concat(F.lit("#KW: "), "lang", F.lit(", "), "source", F.lit("\nBody "), "source", F.lit("###EFFECT###\nAfter "), "lang")
    return table(spark, d, "documents").withColumn("r", R.ended_stream(text)).select("doc_id", "r.keywords", "r.body", "r.effect")
