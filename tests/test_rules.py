"""Rules of chats, enrichment, records, histories, artifacts and pages on rows of their own."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from stackroom.functions import biblio, replies, text
from stackroom.operators import chunker, conversation, enrichment
from stackroom.operators.history import History, entries
from stackroom.operators.tables import page_buttons
from stackroom.plugins import TEMPLATES, Template, Templates
from stackroom.search import rewrite
from stackroom.sources import artifacts, catalog


def one(spark, column, value=""):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).head()["x"]


@pytest.mark.parametrize("reply, summary, themes", [
    ("**SUMMARY:**\nText here.\n\n**THEMES:** a, *b*，c\nd", "Text here.", ["a", "b", "c", "d"]),
    ("Text.\n\n관련 검색어: x, y", "Text.", ["x", "y"]),
    ("SUMMARY: Text.\n검색어: x\nTHEMES: t", "Text.", ["t"]),
    ("THEMES: " + ",".join(f"t{i}" for i in range(30)), "", [f"t{i}" for i in range(20)]),
    ("plain", "plain", []),
])
def test_summary_replies(spark, reply, summary, themes):
    body, found = replies.summary_and_themes(F.col("v"))
    assert one(spark, F.struct(body.alias("b"), found.alias("t")), reply) == (summary, themes)


@pytest.mark.parametrize("query, title", [("채식주의자 같은 책", "채식주의자"), ("'소년이 온다'와 비슷한 책 추천", "소년이 온다"), ("작별처럼  책", "작별"), ("Books similar to The Sea ", "The Sea"), ("바다 책", None), ("", None)])
def test_titles_that_a_query_names(spark, query, title):
    assert one(spark, text.similar_to(F.col("v")), query) == title
    books = spark.createDataFrame([("b", title or "x", "themes of it")], "book_id string, title string, themes string")
    assert rewrite(query, books) == ("themes of it" if title else query)


def test_user_content_by_precedence(spark):
    hits, refs = "array<struct<page_start:int,page_end:int,text:string>>", [f"r{i}" for i in range(60)]
    rows = spark.createDataFrame([(1, "인용 목록?", refs, [(1, 2, "t")]), (2, "참고문헌?", [], [(1, 2, "t")]), (3, "왜?", refs, [(3, 4, "a"), (5, 5, "b")]), (4, "왜?", None, None)], f"id int, m string, refs array<string>, hits {hits}")
    got = {r.id: r.c for r in rows.select("id", conversation.user_content(F.col("m"), F.col("refs"), F.col("hits")).alias("c")).collect()}
    assert got[1] == "[이 논문의 참고문헌 목록]\n" + "\n".join(f"{i + 1}. r{i}" for i in range(50)) + "\n\n[질문]\n인용 목록?"
    assert got[2] == "참고문헌?" and got[4] == "왜?"
    assert got[3] == "[참고 내용]\n[p.3–4]\na\n\n[p.5–5]\nb\n\n[질문]\n왜?"


def test_enrichment_plan_and_backfill(spark):
    schema = "id int, text string, abstract string, keywords array<string>, contents array<string>, references array<string>, tables array<string>, figures array<string>"
    many = [str(i) for i in range(60)]
    rows = spark.createDataFrame([(1, "x" * 200, "a", ["k"], ["c"], many[:3], many, many), (2, "x" * 300, None, [], None, many, [], None), (3, "short", "a", ["k"], ["c"], many[:3], many[:2], None)], schema)
    plan = enrichment.planned(rows)
    got = {r.id: (r.ask_keywords, r.ask_references, r.seed) for r in plan.collect()}
    assert got == {1: (False, False, "a"), 2: (True, True, "x" * 300), 3: (True, False, "short")}
    done = enrichment.completed(plan, F.when(F.col("id") == 2, F.array(F.lit("m"))), F.lit(None).cast("array<string>"))
    assert {tuple(r) for r in enrichment.coverage(done, "id").collect()} == {(1, True, 1, 3, 10, 8, 1), (2, False, 1, 60, 0, 0, 0), (3, False, 0, 0, 2, 0, 0)}
    books = spark.createDataFrame([(1, "book", True, {"plot": "p"}), (2, "book", True, {"plot": None, "x": "y"}), (3, "paper", True, None), (4, "policy", False, {}), (5, "policy", True, None), (6, "book", True, {}), (7, "book", True, {})], "id int, doc_type string, embedded boolean, extra map<string,string>")
    targets = enrichment.backfill_targets(books)
    assert {r.id for r in targets.collect()} == {2, 5, 6, 7} and enrichment.backfill_targets(books, force=True).count() == 5
    out = enrichment.backfilled(targets, F.when(F.col("id") == 5, F.array(F.lit(""))).otherwise(F.array(F.lit("s"))), F.when(F.col("id") == 2, "new").when(F.col("id") == 7, ""), F.when(F.col("id") == 6, "E"))
    assert {r.id: (r.outcome, r.extra) for r in out.collect()} == {2: ("done", {"x": "y", "plot": "new"}), 5: ("skipped", {}), 6: ("failed", {}), 7: ("skipped", {})}
    assert tuple(enrichment.outcomes(out).head()) == (1, 2, 1)


def test_record_rows(spark):
    rows = spark.createDataFrame([("1", "KCI", {"title": "T"}, {"kdc": "8", "title": "no"}), ("2", "", {}, {"title": "X", "source_format": "M"}), ("3", "K", {"source_format": "C", "title": None}, {})], "source_id string, source_format string, core map<string,string>, extra map<string,string>")
    got = {r.cnts_id: (r.title, r.kdc, r.source_format) for r in biblio.record_rows(rows, ["title", "kdc", "source_format"]).collect()}
    assert got == {"1": ("T", "8", "KCI"), "2": ("X", None, "M"), "3": (None, None, "C")}


def test_history_add_lookup_and_clear(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(f"s{i % 3}", f"q{i}", "book", t + dt.timedelta(hours=i), "paper" if i % 3 == 0 else "book") for i in range(9)], "session_id string, query string, mode string, created_at timestamp_ntz, type string")
    made = entries(rows, F.struct("query"), F.col("type"))
    history = History(spark, f"{tmp_path}/h", 4)
    for part in (made, made.filter("query < 'q4'")):
        history.add(part)
    again = History(spark, f"{tmp_path}/h")
    assert again.table.read().count() == 9 and again.of_type("paper").count() == 3
    key = made.filter("query = 'q5'").head().id
    assert [r.result for r in again.entry(key).collect()] == ['{"query":"q5"}']
    assert {(r.session_id, r.place, r.query) for r in again.newest(1).collect()} == {("s0", 1, "q6"), ("s1", 1, "q7"), ("s2", 1, "q8")}
    again.clear("paper")
    assert {r.query for r in again.table.read().collect()} == {f"q{i}" for i in range(9) if i % 3}
    again.clear("book")
    assert again.table.read().count() == 0


def test_artifacts(spark, tmp_path):
    page = "book_id string, page_num long, text string, method string, confidence double"
    pages = spark.createDataFrame([("a", 2, "two", "m", 1.0), ("a", 1, "하나", "m", 1.0), ("a", 3, "", "m", 0.3), ("a", 4, None, "m", 0.3), ("a", 5, "five", "m", 1.0), ("b", 1, "old", "m", 1.0)], page)
    store = artifacts.Artifacts(spark, f"{tmp_path}/a")
    store.save(artifacts.of_pages(pages))
    store.save(artifacts.of_pages(spark.createDataFrame([("b", 7, "new", "m", 1.0)], page)))
    books = spark.createDataFrame([("a",), ("b",), ("c",)], "book_id string")
    loaded = store.load(books)
    assert {(r.book_id, r.total_pages, r.error) for r in loaded.collect()} == {("a", 5, None), ("b", 1, None), ("c", None, "artifact_missing")}
    whole = {r.book_id: (r.full_text, [tuple(s) for s in r.spans]) for r in artifacts.text_and_spans(loaded.filter("error is null")).collect()}
    assert whole == {"a": ("하나\n\ntwo\n\nfive", [(1, 0, 2), (2, 4, 7), (5, 9, 13)]), "b": ("new", [(7, 0, 3)])}
    store.delete(books.filter("book_id = 'a'"))
    assert {r.book_id for r in store.load(books).filter("error is null").collect()} == {"b"}


def buttons(cur, total):
    if total <= 7:
        return [str(i) for i in range(1, total + 1)]
    near = [str(i) for i in range(max(2, cur - 1), min(total - 1, cur + 1) + 1)]
    return ["1", *["..."] * (cur > 3), *near, *["..."] * (cur < total - 2), str(total)]


def test_page_buttons(spark):
    rows = spark.createDataFrame([(c, t) for t in (0, 1, 7, 8, 12) for c in range(1, max(2, t + 1))], "cur int, total int")
    for r in rows.select("cur", "total", page_buttons(F.col("cur"), F.col("total")).alias("b")).collect():
        assert r.b == buttons(r.cur, r.total), (r.cur, r.total)


def test_templates_as_columns(spark):
    rows = spark.createDataFrame([("policy", "T", "x"), ("book", "U", None)], "kind string, title string, text string")
    got = [r.p for r in rows.select(TEMPLATES.column("section_summary", F.col("kind"), title=F.col("title"), text=F.col("text")).alias("p")).collect()]
    assert got == ["Regulation: T\n\nx", "Book: U\n\n"]
    with pytest.raises(KeyError):
        TEMPLATES.column("section_summary", F.col("kind"), title=F.col("title"))
    with pytest.raises(KeyError):
        TEMPLATES.column("none", F.col("kind"))
    typed = Templates(Template("only.policy", "", "{a}"))
    with pytest.raises(Exception, match="no template only for book"):
        rows.select(typed.column("only", F.col("kind"), a=F.col("title"))).collect()


def test_marc_tiers_and_getters(spark):
    fe, sf = catalog.FIELD_END, catalog.SUBFIELD
    entries_ = "245002000006" + "653001000026" * 2
    whole = f"00000nam a22{24 + len(entries_) + 1:05d}   4500{entries_}{fe}10{sf}aTitle /{fe}  {sf}bonly{fe}  {sf}afirst{sf}bx{fe}"
    rows = spark.createDataFrame([(1, whole), (2, "245 10$aLoose title /$cX"), (3, " "), (4, None), (5, "nothing")], "id int, raw string")
    got = {r.id: (r.record.title, r.record.tier) if r.record else None for r in catalog.marc_tiers(rows, "raw").collect()}
    assert got == {1: ("Title", "separators"), 2: ("Loose title", "loose"), 3: None, 4: None, 5: (None, "loose")}
    f = catalog.marc_fields(F.col("v"))
    assert one(spark, catalog.all_subfields(f, "653", "a"), whole) == ["first"] and one(spark, catalog.first_subfield(f, "653", "b"), whole) == "only"
    assert one(spark, catalog.first_subfield(f, "999", "a"), whole) is None and one(spark, f, "no record") is None


def test_folds_of_pieces(spark):
    rows = spark.createDataFrame([(1, ["a" * 10, "b" * 100, "c" * 4]), (2, []), (3, None), (4, ["short"])], "id int, p array<string>")
    got = [(r.id, r.place, len(r.text)) for r in chunker.regrouped(rows, "id", "p", least=40).orderBy("id", "place").collect()]
    assert got == [(1, 0, 116), (4, 0, 5)]
    said = " ".join(f"Sentence number {i} is here." for i in range(20))
    parts = [r.text for r in chunker.regrouped(spark.createDataFrame([(1, [said])], "id int, p array<string>"), "id", "p", most=60).orderBy("place").collect()]
    assert " ".join(parts) == said and all(len(p) / 1.5 < 61 + len(re.findall(r"\.", p)) for p in parts)


def test_filter_expression_follows_the_rules_of_search(spark):
    import random

    from stackroom.functions.filters import query_filter
    from stackroom.search import read_filter

    r = random.Random(4)
    parts = ["since", "before", "between", "from", "until", "by ", "2001", "1999", "12345", "1750", "최근 5년", "last 10 years", "newest", "oldest", "이전", "부터", "-", "Latest", "books", "2010년"]
    asked = ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 5))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(asked)), "id int, q string").select("id", query_filter(F.col("q")).alias("f")).collect()
    for row in rows:
        want = read_filter(asked[row.id])
        assert (row.f.year_from, row.f.year_to, row.f.sort_by) == (want.year_from, want.year_to, want.sort_by), asked[row.id]

def test_chunk_stream_of_odd_books(spark):
    from stackroom.operators import indexing

    books = spark.createDataFrame([("p", "paper", None, "2001"), ("q", "paper", "Q", None), ("b", "book", "B", "")], "book_id string, doc_type string, title string, pub_date string")
    body = spark.createDataFrame([("p", 0, 0, "one"), ("p", 1, 9, "two"), ("b", 0, 0, "three")], "book_id string, chunk_idx int, section_idx int, text string")
    sections = spark.createDataFrame([("p", 0, None, " x ,, y"), ("b", 0, "sum", None)], "book_id string, section_idx int, summary string, themes string")
    table = "array<struct<context:string,markdown:string,description:string>>"
    found = spark.createDataFrame([("p", "abs", None, [("c", "|m|", "says"), (None, "가" * 6000, None)], ["fig"]), ("q", None, [], None, None), ("b", "no", ["no"], [], [])], f"book_id string, abstract string, keywords array<string>, tables {table}, figures array<string>")
    got = {(r.book_id, r.chunk_idx): (r.kind, r.embed_text) for r in indexing.chunk_stream(books, body, sections, found).collect()}
    assert got["p", 0] == ("body", "[핵심 테마] x, y\n[본문] one") and got["p", 1] == ("body", "[본문] two") and got["b", 0] == ("body", "[섹션 요약] sum\n[본문] three")
    assert got["p", 2] == ("abstract", "[초록] abs") and got["p", 3] == ("table", "[표]\nc\n\n|m|") and got["p", 4] == ("table description", "[표 설명] says")
    assert got["p", 5][0] == "table" and len(got["p", 5][1].encode()) <= 15_500 and got["p", 6] == ("figure description", "[그림 설명] fig")
    assert (got["p", -1][1], got["q", -1][1], got["b", -1][1]) == ("제목: p | 발행년도: 2001", "제목: Q", "제목: B")
    assert len(got) == 11


def test_chunk_stream_query_keeps_long_tables(spark, tmp_path):
    """A line of over 15,500 bytes is whole in the query's result, as in its SQL."""
    import duckdb

    from stackroom import plans

    docs = [(i, f"head {i}\n" + ("가" * 6000 if i == 0 else "short"), "en", f"s{i}") for i in range(17)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0,)], "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = plans.QUERIES["ch15_chunk_stream"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.SQL['ch15_chunk_stream']})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
