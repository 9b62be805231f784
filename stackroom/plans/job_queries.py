"""Aggregates, ordering, dedup, sets, sinks, sources, job state, streams and display operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackroom.functions import biblio as B
from stackroom.operators import jobs as J
from stackroom.operators import tables as O
from stackroom.sources import catalog as C
from stackroom.streaming import streams

from .registry import CHUNKS, ITEMS, NOW, TITLES, chunks, items, n_vectors, now, query, table, titles

_NOW = f"TIMESTAMP '{NOW}'"


@query("SELECT count(*) AS books, count(*) FILTER (quality = 1) AS embedded, count(*) - count(*) FILTER (quality = 1) AS waiting FROM documents LEFT JOIN labels USING (doc_id)")
def agg01_status(spark, d) -> DataFrame:
    done = F.count_if(F.coalesce(F.col("quality") == 1, F.lit(False)))
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").agg(F.count(F.lit(1)).alias("books"), done.alias("embedded"), (F.count(F.lit(1)) - done).alias("waiting"))


@query(f"WITH {ITEMS} SELECT job_id, status, stage, count(*) AS n FROM items GROUP BY GROUPING SETS ((job_id, status), (job_id, stage))")
def agg02_by_status_and_stage(spark, d) -> DataFrame:
    return items(spark, d).groupingSets([["job_id", "status"], ["job_id", "stage"]], "job_id", "status", "stage").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ITEMS}, c AS (SELECT job_id, count(*) FILTER (status = 'done' AND updated_at >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 1 HOUR) AS rate_per_hour, count(*) FILTER (status <> 'done') AS "left" FROM items GROUP BY job_id)
    SELECT job_id, rate_per_hour, "left", CASE WHEN rate_per_hour > 0 THEN round("left" / rate_per_hour, 1) END AS eta_hours FROM c""")
def agg03_progress(spark, d) -> DataFrame:
    return J.progress(items(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


@query(f"WITH {ITEMS} SELECT coalesce(error_group, 'unknown') AS error_group, count(*) AS n FROM items WHERE status = 'failed' GROUP BY 1")
def agg04_error_groups(spark, d) -> DataFrame:
    return items(spark, d).filter("status = 'failed'").groupBy(F.coalesce("error_group", F.lit("unknown")).alias("error_group")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ITEMS} SELECT coalesce(error_group, 'unknown') AS error_group, count(*) AS n, substr(max(last_error), 1, 300) AS sample FROM items WHERE status = 'failed' GROUP BY 1")
def agg05_failures(spark, d) -> DataFrame:
    return J.failures(items(spark, d))


@query(f"WITH {CHUNKS} SELECT book_id, count(*) AS n FROM chunks WHERE chunk_idx <> -1 GROUP BY book_id")
def agg06_chunks_per_book(spark, d) -> DataFrame:
    return chunks(spark, d).filter("chunk_idx <> -1").groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CHUNKS}, c AS (SELECT book_id, lang, count(*) AS n FROM chunks GROUP BY ALL) SELECT book_id, lang AS method, n FROM c QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY n DESC, lang) = 1")
def agg07_main_method(spark, d) -> DataFrame:
    n = chunks(spark, d).groupBy("book_id", F.col("lang").alias("method")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("book_id").agg(F.min_by("method", F.struct(-F.col("n"), "method")).alias("method"), F.max("n").alias("n"))


@query("SELECT count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang NOT IN ('en', 'fr')) AS other FROM documents")
def agg08_format_counts(spark, d) -> DataFrame:
    lang = F.col("lang")
    return table(spark, d, "documents").agg(F.count_if(lang == "en").alias("en"), F.count_if(lang == "fr").alias("fr"), F.count_if(~lang.isin("en", "fr")).alias("other"))


@query("SELECT user_id % 10 AS job_id, list_sort(list(DISTINCT user_id)) AS users FROM events GROUP BY 1")
def agg10_id_lists(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("job_id")).agg(F.array_sort(F.collect_set("user_id")).alias("users"))


@query(f"WITH {ITEMS} SELECT job_id, count(*) FILTER (status IN ('dispatched', 'running')) AS in_flight, count(*) FILTER (status IN ('pending', 'failed') AND attempt < 3) AS eligible, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM items GROUP BY job_id")
def agg12_job_counts(spark, d) -> DataFrame:
    return J.completion(items(spark, d)).drop("state")


@query("SELECT lang, count(*) AS pages, sum(length(text))::BIGINT AS chars, count(*) FILTER (length(trim(text)) >= 50) AS sure FROM documents GROUP BY lang")
def agg14_extractor_totals(spark, d) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("chars"), F.count_if(C.page_confidence(F.col("text")) == 1.0).alias("sure"))


@query(f"WITH {ITEMS} SELECT stage, count(*) AS total, count(*) FILTER (status = 'done') AS ok, count(*) FILTER (status = 'failed') AS failed FROM items GROUP BY stage")
def agg15_stage_counters(spark, d) -> DataFrame:
    s = F.col("status")
    return items(spark, d).groupBy("stage").agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "done").alias("ok"), F.count_if(s == "failed").alias("failed"))


@query("SELECT doc_id, l.quality IS NOT NULL AS has_label, len(string_split(text, chr(10))) AS lines FROM documents LEFT JOIN labels l USING (doc_id)")
def agg16_coverage(spark, d) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.col("quality").isNotNull().alias("has_label"), F.size(F.split("text", "\n")).alias("lines"))


@query("SELECT conv_id, sum(greatest(1, CAST(floor(length(text) / 1.5) AS BIGINT)))::BIGINT AS tokens FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def agg17_cited_tokens(spark, d) -> DataFrame:
    from stackroom.functions.text import token_estimate

    return table(spark, d, "conversations").dropna(subset=["text"]).groupBy("conv_id").agg(F.sum(token_estimate(F.col("text"))).alias("tokens"))


@query("SELECT DISTINCT source AS grade FROM documents")
def agg18_grades(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("grade")).distinct().orderBy("grade")


@query("SELECT doc_id, source, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY source, doc_id LIMIT 20 OFFSET 40")
def ord01_page(spark, d) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "source")
    total = t.agg(F.count(F.lit(1)).alias("total"))
    return O.page(t, ["source", "doc_id"], 40, 20).crossJoin(F.broadcast(total))  # one row of total


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 50")
def ord02_newest_of_session(spark, d) -> DataFrame:
    return O.top_per_group(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 50, "place").drop("ts")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def ord03_top_k(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "value").orderBy(F.col("value").desc(), "event_id").limit(25)


@query("WITH u AS (SELECT DISTINCT user_id FROM events) SELECT user_id FROM u ORDER BY user_id LIMIT 10 OFFSET 5")
def ord04_id_page(spark, d) -> DataFrame:
    return O.page(table(spark, d, "events").select("user_id").distinct(), ["user_id"], 5, 10)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def ord05_newest_jobs(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(100)


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def ded01_last_wins(spark, d) -> DataFrame:
    return O.last_wins(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"])


@query("SELECT user_id, min(event_id) AS event_id, count(*) > 1 AS again FROM events GROUP BY user_id")
def ded02_first_wins(spark, d) -> DataFrame:
    first, again = O.first_wins(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], ["event_id"])
    return first.join(again.withColumn("a", F.lit(True)), "user_id", "left").select("user_id", "event_id", F.coalesce("a", F.lit(False)).alias("again"))


@query("SELECT url, page_id, count(*) OVER (PARTITION BY regexp_extract(url, '//([^/]+)', 1)) AS n FROM pages")
def ded03_path_counts(spark, d) -> DataFrame:
    host = F.regexp_extract("url", "//([^/]+)", 1)
    return table(spark, d, "pages").select("url", "page_id", F.count(F.lit(1)).over(Window.partitionBy(host)).alias("n"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def ded04_seen_pairs(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("SELECT DISTINCT source, lang FROM documents")
def ded05_drop_duplicates(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("source", "lang").dropDuplicates()


@query("SELECT 'both' AS side, doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'left', doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'right', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def set01_intersection_differences(spark, d) -> DataFrame:
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    mark = lambda s, df: df.select(F.lit(s).alias("side"), "doc_id")
    return mark("both", a.intersect(b)).unionByName(mark("left", a.subtract(b))).unionByName(mark("right", b.subtract(a)))


@query("SELECT doc_id AS k FROM documents UNION SELECT item_id FROM benchmark UNION SELECT page_id FROM pages")
def set02_union_of_keys(spark, d) -> DataFrame:
    one = lambda t, c: table(spark, d, t).select(F.col(c).alias("k"))
    return one("documents", "doc_id").union(one("benchmark", "item_id")).union(one("pages", "page_id")).distinct()


@query("SELECT doc_id, len(list_intersect(list_distinct(string_split(text, ' ')), ['the', 'de', 'der'])) AS n FROM documents")
def set04_array_intersect(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(F.array_intersect(F.split("text", " "), F.array(*map(F.lit, ("the", "de", "der"))))).alias("n"))


@query("""WITH o AS (SELECT doc_id, source AS title, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, 'old' AS state, doc_id % 5 AS a FROM documents),
    n AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'new' END AS title, 'xx' AS lang, 'fresh' AS state FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY toxic DESC) = 1)
    SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.title, o.title) AS title, coalesce(n.lang, o.lang) AS lang, CASE WHEN o.doc_id IS NULL THEN n.state ELSE o.state END AS state, CAST(o.a AS VARCHAR) AS a, CASE WHEN n.doc_id IS NOT NULL THEN n.lang END AS b,
    CASE WHEN o.doc_id IS NULL THEN 'created' WHEN n.doc_id IS NULL THEN 'kept' ELSE 'updated' END AS _change FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def snk01_upsert(spark, d) -> DataFrame:
    i = F.col("doc_id")
    old = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.when(i % 2 == 0, F.col("lang")).alias("lang"), F.lit("old").alias("state"), F.create_map(F.lit("a"), (i % 5).cast("string")).alias("extra"))
    new = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "new").alias("title"), F.lit("xx").alias("lang"), F.lit("fresh").alias("state"), F.create_map(F.lit("b"), F.lit("xx")).alias("extra"), F.col("toxic").alias("seq"))
    got = O.upsert(old, new, "doc_id", "seq", protected=("state",), maps=("extra",))
    return got.select("doc_id", "title", "lang", "state", F.col("extra")["a"].alias("a"), F.col("extra")["b"].alias("b"), "_change")


@query("SELECT _change, count(*) AS n FROM (SELECT CASE WHEN o.doc_id IS NULL THEN 'created' WHEN n.doc_id IS NULL THEN 'kept' ELSE 'updated' END AS _change FROM (SELECT doc_id FROM documents) o FULL JOIN (SELECT DISTINCT doc_id FROM labels) n ON o.doc_id = n.doc_id) GROUP BY _change")
def agg09_upsert_counts(spark, d) -> DataFrame:
    return snk01_upsert(spark, d).groupBy("_change").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id // 8 AS book, doc_id AS k, 'old' AS v FROM documents WHERE doc_id // 8 NOT IN (SELECT doc_id // 8 FROM labels WHERE toxic = 1) UNION ALL SELECT doc_id // 8, doc_id, 'new' FROM labels WHERE toxic = 1")
def snk06_replace_groups(spark, d) -> DataFrame:
    row = lambda t, v: t.select(F.floor(F.col("doc_id") / 8).alias("book"), F.col("doc_id").alias("k"), F.lit(v).alias("v"))
    return O.replace_groups(row(table(spark, d, "documents"), "old"), row(table(spark, d, "labels").filter("toxic = 1"), "new"), ["book"])


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END, ''), lang) AS abstract, lang AS refs FROM documents")
def snk10_back_fill(spark, d) -> DataFrame:
    old = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(old, F.lit("")), F.col("lang")).alias("abstract"), F.col("lang").alias("refs"))


@query("SELECT doc_id, source FROM documents WHERE NOT (lang = 'fr' AND doc_id % 2 = 0)")
def snk13_delete_where(spark, d) -> DataFrame:
    return table(spark, d, "documents").filter(~((F.col("lang") == "fr") & (F.col("doc_id") % 2 == 0))).select("doc_id", "source")


@query("SELECT doc_id, CASE WHEN lang <> 'fr' THEN doc_id % (SELECT count(*) FROM embeddings) END AS vec_id, CASE WHEN lang <> 'fr' THEN 'embedded' ELSE 'pending' END AS state FROM documents")
def snk14_drop_vectors(spark, d) -> DataFrame:
    stays = F.col("lang") != "fr"
    return table(spark, d, "documents").select("doc_id", F.when(stays, F.col("doc_id") % n_vectors(spark, d)).alias("vec_id"), F.when(stays, "embedded").otherwise("pending").alias("state"))


@query("SELECT d.doc_id, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id = d.doc_id AND length(p.html) = d.n_chars)")
def snk16_upload_plan(spark, d) -> DataFrame:
    there = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.length("html").cast("long").alias("n_chars"))
    return table(spark, d, "documents").select("doc_id", "n_chars").join(there, ["doc_id", "n_chars"], "left_anti")


@query("SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN source END AS title, CASE WHEN doc_id % 3 > 0 THEN source END AS marc_title, 'x ' || lang AS kept FROM documents")
def src09_marc(spark, d) -> DataFrame:
    """Records are built from the rows, then parsed."""
    i, fe, sf, end = F.col("doc_id"), C.FIELD_END, C.SUBFIELD, C.RECORD_END
    entries = "001000600000" + "245002000006" + "300001000026"
    base = 24 + len(entries) + 1
    title = F.when(i % 3 > 0, F.concat(F.lit(f"10{sf}a"), "source", F.lit(" / "), F.lit(f"{sf}cA. Author"))).otherwise(F.lit(f"10{sf}cA. Author"))
    record = F.concat(F.lit(f"00000nam a22{base:05d}   4500"), F.lit(entries + fe), F.lit("ID1" + fe), title, F.lit(fe + f"  {sf}ax "), "lang", F.lit(" ;" + fe + end))
    got = table(spark, d, "documents").withColumn("m", C.marc(F.regexp_replace(record, fe, "_x001E_")))
    return got.select("doc_id", F.when(i % 4 > 0, F.col("source")).alias("title"), F.col("m.title").alias("marc_title"), F.col("m.extent").alias("kept"))


@query("SELECT doc_id, source || ' & ' || lang AS title, 'A' || doc_id || ' | B' AS people, CAST(1990 + doc_id % 30 AS VARCHAR) AS pub_date, '8' || lang AS kdc, 'CNTS' || doc_id AS record_id FROM documents")
def src12_mods(spark, d) -> DataFrame:
    i = F.col("doc_id").cast("string")
    xml = F.concat(
        F.lit('<mods xmlns="http://www.loc.gov/mods/v3"><titleInfo><title>'), "source", F.lit(" & "), "lang", F.lit('</title></titleInfo><name type="personal"><namePart>A'), i, F.lit("</namePart></name><name><namePart>B</namePart></name>"),
        F.lit('<originInfo><dateIssued>'), (1990 + F.col("doc_id") % 30).cast("string"), F.lit('07</dateIssued></originInfo><classification authority="KDC5">8'), "lang", F.lit("</classification><recordInfo><recordIdentifier>CNTS"), i, F.lit("</recordIdentifier></recordInfo></mods>"),
    )
    got = table(spark, d, "documents").select("doc_id", C.parse_mods(xml).alias("r")).withColumn("m", C.mods(F.col("r")))
    return got.select("doc_id", "m.title", F.col("m.personal_author").alias("people"), "m.pub_date", "m.kdc", "m.record_id")


@query("SELECT doc_id, source AS title, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS n_core, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS n_extra FROM documents")
def src15_core_extra(spark, d) -> DataFrame:
    i = F.col("doc_id")
    m = F.create_map(F.lit("title"), "source", F.lit("kdc"), F.when(i % 2 == 0, F.lit("800")), F.lit("plot"), F.when(i % 3 > 0, F.lit("p")))
    core, extra = B.split_core(F.col("m"), ["title", "kdc"])
    return table(spark, d, "documents").withColumn("m", m).select("doc_id", core["title"].alias("title"), F.size(core).alias("n_core"), F.size(extra).alias("n_extra"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'ocr' WHEN doc_id % 3 = 0 THEN CASE WHEN length(trim(text)) >= 80 THEN 'diagram' ELSE 'ocr' END WHEN length(trim(text)) >= 50 THEN 'keep' ELSE 'ocr' END AS route FROM documents")
def src17_page_route(spark, d) -> DataFrame:
    i = F.col("doc_id")
    text = F.when(i % 5 > 0, F.col("text"))
    return table(spark, d, "documents").select("doc_id", C.page_route(C.page_confidence(text), text, F.coalesce((i % 3 == 0) & (i % 5 > 0), F.lit(False))).alias("route"))


@query("SELECT doc_id, CASE WHEN length(trim(text)) >= 50 THEN 1.0 ELSE 0.3 END::DOUBLE AS confidence FROM documents")
def src19_confidence(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.page_confidence(F.col("text")).alias("confidence"))


@query("SELECT event_id, least(event_id % 7, event_id % 5) AS \"left\", greatest(event_id % 7, event_id % 5) AS \"right\" FROM events")
def src29_bounding_box(spark, d) -> DataFrame:
    i = F.col("event_id")
    point = lambda x: F.struct(x.alias("x"), F.lit(0).alias("y"))
    box = C.bounding_box(F.array(point(i % 7), point(i % 5)))
    return table(spark, d, "events").withColumn("b", box).select("event_id", "b.left", "b.right")


_PLAN = """m AS (SELECT doc_id // 2 AS book, doc_id AS seq, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id) AS place FROM documents)
    SELECT seq, CASE WHEN place > 1 THEN 'duplicate' WHEN book % 7 = 0 THEN 'missing_object' WHEN book NOT IN (SELECT doc_id FROM labels) THEN 'missing_meta' WHEN book IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'already_embedded' ELSE 'ingest' END AS action FROM m"""


def _planned(spark, d) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    book = F.floor(F.col("doc_id") / 2)
    key = lambda b: F.format_string("originals/%s/%s.pdf", b.cast("string"), b.cast("string"))
    manifest = docs.select(book.cast("string").alias("book_id"), F.col("doc_id").alias("seq"), F.lit(None).cast("string").alias("object_key"))
    known = labels.select(F.col("doc_id").cast("string").alias("book_id"), "quality")
    return J.plan(manifest, docs.filter(F.col("doc_id") % 7 != 0).select(key(F.col("doc_id")).alias("object_key")), known, known.filter("quality = 1"))


@query(f"WITH {_PLAN}")
def jn08_job_plan(spark, d) -> DataFrame:
    return _planned(spark, d).select("seq", "action")


@query(f"SELECT action, count(*) AS n FROM (WITH {_PLAN}) GROUP BY action")
def stm11_plan_report(spark, d) -> DataFrame:
    return J.plan_report(_planned(spark, d))


_NEXT = "CASE stage WHEN 'extracted' THEN 'summarize' WHEN 'summarized' THEN 'embed_index' WHEN 'indexed' THEN 'finalize' WHEN 'finalized' THEN NULL ELSE 'extract' END"
_LIMIT = f"CASE WHEN status = 'dispatched' THEN 14400 ELSE CASE coalesce({_NEXT}, 'extract') WHEN 'extract' THEN 1800 WHEN 'finalize' THEN 900 ELSE 1200 END END"


@query(f"WITH {ITEMS}, s AS (SELECT *, status IN ('dispatched', 'running') AND epoch_us({_NOW}) - epoch_us(updated_at) > ({_LIMIT})::BIGINT * 1000000 AS stale FROM items) SELECT id, CASE WHEN stale THEN 'failed' ELSE status END AS status, CASE WHEN stale THEN 'stale' ELSE error_group END AS error_group, attempt + CAST(stale AS INTEGER) AS attempt FROM s")
def stm03_recover_stale(spark, d) -> DataFrame:
    return J.recover_stale(items(spark, d), now()).select("id", "status", "error_group", "attempt")


@query(f"""WITH {ITEMS}, b AS (SELECT job_id, count(*) AS busy FROM items WHERE status IN ('dispatched', 'running') GROUP BY job_id), w AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY id) AS place FROM items WHERE status IN ('pending', 'failed') AND attempt < 3)
    SELECT w.job_id, id, place, CASE WHEN {_NEXT} IS NULL THEN 'done' ELSE 'dispatched' END AS status, {_NEXT} AS next_stage FROM w LEFT JOIN b USING (job_id) WHERE place <= 500 - coalesce(busy, 0)""")
def stm04_dispatch(spark, d) -> DataFrame:
    return J.dispatch(items(spark, d), high_water=500)


@query(f"""WITH {ITEMS}, b AS (SELECT job_id, count(*) FILTER (status IN ('dispatched', 'running')) AS busy, count(*) FILTER (status IN ('dispatched', 'running')) + count(*) // 20 AS high_water FROM items GROUP BY job_id), w AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY id) AS place FROM items WHERE status IN ('pending', 'failed') AND attempt < 3)
    SELECT w.job_id, id, CAST(place AS INTEGER) AS place, CASE WHEN {_NEXT} IS NULL THEN 'done' ELSE 'dispatched' END AS status, {_NEXT} AS next_stage FROM w JOIN b USING (job_id) WHERE place <= high_water - busy""")
def stm04_dispatch_by_limits(spark, d) -> DataFrame:
    """Jobs with bounds of their own, which leave room for a twentieth of each job's items."""
    rows = items(spark, d)
    bound = F.count_if(F.col("status").isin(J.IN_FLIGHT)) + F.floor(F.count(F.lit(1)) / 20)
    return J.dispatch(rows, limits=rows.groupBy("job_id").agg(bound.alias("high_water")))


@query(f"""WITH {ITEMS}, c AS (SELECT job_id, count(*) FILTER (status IN ('dispatched', 'running')) AS in_flight, count(*) FILTER (status IN ('pending', 'failed') AND attempt < 3) AS eligible, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM items WHERE job_id <> 3 OR status IN ('done') GROUP BY job_id)
    SELECT *, CASE WHEN in_flight > 0 OR eligible > 0 THEN 'running' WHEN failed > 0 THEN 'completed_with_errors' ELSE 'completed' END AS state FROM c""")
def stm05_completion(spark, d) -> DataFrame:
    return J.completion(items(spark, d).filter("job_id <> 3 OR status = 'done'"))


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS status, min(ts) FILTER (event_type = 'running') AS started_at, count(*) FILTER (event_type = 'failed') AS attempt, CASE WHEN arg_max(event_type, event_id) = 'failed' THEN arg_max(props, event_id) END AS last_error FROM (SELECT user_id, event_id, ts, props, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE event_type END AS event_type FROM events) GROUP BY user_id")
def stm06_fold_events(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "running").otherwise(F.col("event_type"))
    return J.fold_events(e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "ts", status.alias("status"), F.col("props").alias("error")))


@query(f"WITH {ITEMS} SELECT id, {_NEXT} AS next_stage FROM items")
def stm07_next_stage(spark, d) -> DataFrame:
    return items(spark, d).select("id", J.next_stage(F.col("stage")).alias("next_stage"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'llm_timeout' WHEN 1 THEN 'llm_error' WHEN 2 THEN 'milvus_error' WHEN 3 THEN 'minio_error' ELSE 'unknown' END AS error_group FROM events")
def stm08_error_group(spark, d) -> DataFrame:
    r = F.col("event_id") % 5
    kind = F.when(r == 0, "ReadTimeout").when(r == 1, "HTTPStatusError").when(r == 3, "S3Error").otherwise("ValueError")
    return table(spark, d, "events").select("event_id", J.error_group(kind, F.when(r == 2, "Milvus is down").otherwise("x")).alias("error_group"))


@query(f"WITH {ITEMS}, c AS (SELECT *, status = 'failed' AND coalesce(error_group, '') = 'llm_timeout' AS c FROM items) SELECT id, CASE WHEN c THEN 'pending' ELSE status END AS status, CASE WHEN c THEN 0 ELSE attempt END AS attempt, CASE WHEN c THEN 'extracted' ELSE stage END AS stage FROM c")
def stm09_retry(spark, d) -> DataFrame:
    return J.retry(items(spark, d), "llm_timeout", "extracted").select("id", "status", "attempt", "stage")


@query(f"WITH {ITEMS} SELECT id, CASE WHEN status IN ('pending', 'failed') THEN 'canceled' ELSE status END AS status FROM items")
def stm10_cancel(spark, d) -> DataFrame:
    return J.control(items(spark, d), "cancel").select("id", "status")


@query(f"WITH {ITEMS} SELECT id, CASE status WHEN 'done' THEN 'embedded' WHEN 'failed' THEN 'failed' WHEN 'pending' THEN 'pending' ELSE 'processing' END AS ingest_state, CASE WHEN status = 'done' THEN updated_at END AS embedded_at FROM items")
def stm15_ingest_state(spark, d) -> DataFrame:
    s = F.col("status")
    return items(spark, d).select("id", F.when(s == "done", "embedded").when(s.isin("failed", "pending"), s).otherwise("processing").alias("ingest_state"), F.when(s == "done", F.col("updated_at")).alias("embedded_at"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'not_found' WHEN l.quality = 1 THEN 'embedded' WHEN l.toxic = 1 THEN 'processing' WHEN d.doc_id % 7 = 0 THEN 'no_file' ELSE 'queued' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)")
def stm16_batch_skip(spark, d) -> DataFrame:
    l = table(spark, d, "labels").withColumn("there", F.lit(True))
    action = F.when(F.col("there").isNull(), "not_found").when(F.col("quality") == 1, "embedded").when(F.col("toxic") == 1, "processing").when(F.col("doc_id") % 7 == 0, "no_file").otherwise("queued")
    return table(spark, d, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", action.alias("action"))


@query("SELECT count(*) FILTER (l.quality IS NULL) AS candidates, count(*) FILTER (l.quality IS NULL AND length(text) > 100) AS able FROM documents d LEFT JOIN labels l USING (doc_id)")
def stm17_backfill_candidates(spark, d) -> DataFrame:
    rest = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti")
    return rest.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.length("text") > 100).alias("able"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 30")
def stm19_history_ring(spark, d) -> DataFrame:
    return O.top_per_group(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 30, "place").drop("ts")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stw01_tumbling(spark, d) -> DataFrame:
    out = streams.windowed(table(spark, d, "events"), "1 hour")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL")
def stw02_sliding(spark, d) -> DataFrame:
    out = streams.windowed(table(spark, d, "events"), "2 hours", "1 hour")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS starts FROM events), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s""")
def stw03_sessions(spark, d) -> DataFrame:
    out = streams.sessions(table(spark, d, "events"), "2 hours")
    return out.withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("SELECT a.event_id, b.event_id AS next_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def stw04_followed(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return streams.followed(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"))


@query(f"WITH {TITLES} SELECT page_id, row_number() OVER (ORDER BY title, page_id) AS place FROM titles QUALIFY place <= 50")
def ui01_sort(spark, d) -> DataFrame:
    top = titles(spark, d).orderBy("title", "page_id").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy("title", "page_id"))).select("page_id", "place")


@query("SELECT d.doc_id, i.item_id, row_number() OVER (ORDER BY i.item_id NULLS LAST, d.doc_id) AS place FROM documents d LEFT JOIN benchmark i ON d.doc_id = i.item_id * 5 WHERE source = 'src5' QUALIFY place <= 100")
def ui02_pinned(spark, d) -> DataFrame:
    cited = table(spark, d, "benchmark").select((F.col("item_id") * 5).alias("doc_id"), "item_id")
    order = [F.col("item_id").asc_nulls_last(), "doc_id"]
    top = table(spark, d, "documents").filter("source = 'src5'").select("doc_id").join(cited, "doc_id", "left").orderBy(*order).limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query("SELECT source, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM documents GROUP BY source")
def ui03_page_count(spark, d) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.ceil(F.count(F.lit(1)) / 20).alias("pages"))


@query("SELECT CASE WHEN k BETWEEN '0' AND '9' THEN k ELSE '?' END AS digit, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, substr(CASE WHEN doc_id % 6 = 0 THEN 'x' ELSE CAST(doc_id % 1000 AS VARCHAR) END, 1, 1) AS k FROM documents) GROUP BY 1")
def ui05_class_groups(spark, d) -> DataFrame:
    k = F.substring(F.when(F.col("doc_id") % 6 == 0, "x").otherwise((F.col("doc_id") % 1000).cast("string")), 1, 1)
    return table(spark, d, "documents").groupBy(F.when(k.rlike("[0-9]"), k).otherwise("?").alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("SELECT vec_id, label / 10.0::DOUBLE AS score FROM embeddings WHERE label / 10.0 >= 0.4 ORDER BY score DESC, vec_id LIMIT 12")
def ui06_collection(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", (F.col("label") / 10).alias("score")).filter("score >= 0.4").orderBy(F.col("score").desc(), "vec_id").limit(12)


@query("SELECT vec_id, label >= 7 AS first, row_number() OVER (ORDER BY label >= 7 DESC, vec_id) AS place FROM embeddings QUALIFY place <= 100")
def ui07_stable_partition(spark, d) -> DataFrame:
    order = [F.col("first").desc(), "vec_id"]
    top = table(spark, d, "embeddings").select("vec_id", (F.col("label") >= 7).alias("first")).orderBy(*order).limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query("SELECT event_id, CAST(floor(value) AS BIGINT) AS shown FROM events WHERE value >= 0.1")
def ui08_weak_cut(spark, d) -> DataFrame:
    return table(spark, d, "events").filter("value >= 0.1").select("event_id", F.floor("value").alias("shown"))


@query("SELECT user_id, event_type FROM events WHERE event_type <> 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100) GROUP BY ALL")
def ui10_cart(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    gone = e.filter("event_type = 'error' AND value > 100").select("user_id").distinct()
    return e.filter("event_type <> 'error'").select("user_id", "event_type").dropDuplicates().join(gone, "user_id", "left_anti")


@query(f"WITH {ITEMS} SELECT job_id, stage, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY job_id), 4) AS share FROM items GROUP BY job_id, stage")
def ui11_stage_share(spark, d) -> DataFrame:
    n = items(spark, d).groupBy("job_id", "stage").agg(F.count(F.lit(1)).alias("n"))
    return n.select("job_id", "stage", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("job_id")), 4).alias("share"))


@query("SELECT page_id, list_filter(list_transform(string_split_regex(url, '[/?]'), lambda s: trim(s)), lambda s: s <> '')[1:4] AS themes FROM pages")
def ui12_themes(spark, d) -> DataFrame:
    from stackroom.functions.text import keyword_list

    return table(spark, d, "pages").select("page_id", keyword_list(F.col("url"), 4, "[/?]").alias("themes"))


@query("SELECT d.doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN 'policy' END, CASE WHEN l.quality = 1 THEN 'paper' END, 'book') AS doc_type FROM documents d LEFT JOIN labels l USING (doc_id)")
def msc01_type_priority(spark, d) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return t.select("doc_id", F.coalesce(F.when(F.col("doc_id") % 5 == 0, "policy"), F.when(F.col("quality") == 1, "paper"), F.lit("book")).alias("doc_type"))


@query(f"WITH {ITEMS} SELECT id, CASE coalesce({_NEXT}, 'extract') WHEN 'extract' THEN 1800 WHEN 'finalize' THEN 900 ELSE 1200 END AS seconds FROM items")
def msc03_stage_timeout(spark, d) -> DataFrame:
    return items(spark, d).select("id", J.stage_timeout(F.coalesce(J.next_stage(F.col("stage")), F.lit("extract"))).alias("seconds"))


@query("SELECT l.doc_id, coalesce(min(CASE WHEN d.doc_id % 2 = 0 THEN 'originals/' || l.doc_id || '/a.pdf' END), 'originals/' || l.doc_id || '.pdf') AS key FROM labels l LEFT JOIN documents d USING (doc_id) GROUP BY l.doc_id")
def msc02_object_key(spark, d) -> DataFrame:
    l = table(spark, d, "labels").select("doc_id").join(table(spark, d, "documents").select("doc_id", F.lit(1).alias("there")), "doc_id", "left")
    folder = F.when((F.col("doc_id") % 2 == 0) & F.col("there").isNotNull(), F.format_string("originals/%d/a.pdf", "doc_id"))
    return l.groupBy("doc_id").agg(F.min(folder).alias("f")).select("doc_id", F.coalesce("f", F.format_string("originals/%d.pdf", "doc_id")).alias("key"))


@query(f"SELECT event_id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h' ELSE CAST(s // 86400 AS VARCHAR) || 'd' END AS label FROM (SELECT event_id, CAST(floor((epoch_us({_NOW}) - epoch_us(ts)) / 1000000) AS BIGINT) AS s FROM events)")
def msc10_relative_time(spark, d) -> DataFrame:
    s = F.floor((F.unix_micros(now().cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1_000_000)
    text = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    return table(spark, d, "events").select("event_id", F.when(s < 60, "now").when(s < 3600, text(60, "m")).when(s < 86400, text(3600, "h")).otherwise(text(86400, "d")).alias("label"))


@query("SELECT user_id FROM events WHERE event_type = 'click' GROUP BY user_id HAVING count(*) % 2 = 1")
def msc11_bookmarks(spark, d) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select("user_id")


@query("SELECT event_type, count(*) AS n, max(event_id) AS latest FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type")
def msc13_history_split(spark, d) -> DataFrame:
    return table(spark, d, "events").filter(F.col("event_type").isin("view", "click")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("latest"))


@query(f"WITH {CHUNKS} SELECT book_id, greatest(1200, 400 + 120 * count(*)) AS budget, greatest(1200, 600 + 250 * count(*)) AS wide FROM chunks GROUP BY book_id")
def msc17_output_budget(spark, d) -> DataFrame:
    n = F.count(F.lit(1))
    return chunks(spark, d).groupBy("book_id").agg(F.greatest(F.lit(1200), 400 + 120 * n).alias("budget"), F.greatest(F.lit(1200), 600 + 250 * n).alias("wide"))


@query("SELECT page_id, greatest(256, least(2048, (length(html) // 16) * 16)) AS width FROM pages")
def msc21_image_size(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.greatest(F.lit(256), F.least(F.lit(2048), (F.floor(F.length("html") / 16) * 16).cast("int"))).alias("width"))
