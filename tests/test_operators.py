"""Behaviour that the driver's tables don't show, on small fixtures."""

import json

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stackroom.functions import biblio, replies, text
from stackroom.operators import chunker, jobs, papers, tables
from stackroom.sources import catalog
from stackroom.streaming import streams
from stackroom.streaming.streams import ReplySplitter


def one(spark, column, value=""):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).head()["x"]


def test_breaks_keep_paragraphs(spark):
    raw = " one\ntwo\n\n\nthree   four\n"
    assert one(spark, text.normalize_breaks(F.col("v")), raw) == chunker.normalize(raw) == "one two\n\nthree four"


def test_sentence_spans(spark):
    raw = "First one here. Second one! No. Third sentence?"
    got = one(spark, text.sentence_spans(F.col("v")), raw)
    assert [(s.text, raw[s.start : s.stop]) for s in got] == [(x, x) for x in ("First one here.", "Second one!", "Third sentence?")]


def test_truncate_bytes_keeps_characters(spark):
    raw = "가나다라"
    assert [one(spark, text.truncate_bytes(F.col("v"), n), raw) for n in (2, 3, 7, 12, 50)] == ["", "가", "가나", raw, raw]


def test_boundary_in_planted_vectors():
    a, b = np.array([1.0, 0, 0]), np.array([0, 1.0, 0])
    v = np.array([a] * 8 + [b] * 8) + 0.01 * np.random.default_rng(1).normal(size=(16, 3))
    assert 8 in chunker.boundaries(v) and all(6 <= i <= 10 for i in chunker.boundaries(v))
    assert chunker.boundaries(v[:5]) == []


def test_merge_split_and_bytes():
    p = [chunker.Piece("x" * n, i, i) for i, n in enumerate((30, 30, 300, 20))]
    merged = chunker.merge_small(p, 100)
    assert [(m.first, m.last) for m in merged] == [(0, 3)] and merged[0].text.count("\n") == 3
    long = chunker.Piece(" ".join(f"Sentence number {i} is here." for i in range(50)))
    parts = chunker.split_large(long, 100)
    assert " ".join(x.text for x in parts) == long.text and all(x.tokens <= 130 for x in parts)
    cut = chunker.split_bytes(chunker.Piece("가나다 라마바 " * 200), 300)
    assert all(len(x.text.encode()) <= 300 for x in cut) and "".join(x.text for x in cut).replace(" ", "") == "가나다라마바" * 200


@given(st.text(alphabet="ab .가\n", max_size=300), st.integers(20, 60))
def test_byte_split_loses_nothing(raw, most):
    cut = chunker.split_bytes(chunker.Piece(raw), most)
    assert "".join("".join(x.text.split()) for x in cut) == "".join(raw.split())
    assert all(len(x.text.encode()) <= most for x in cut)


def test_short_text_is_one_chunk():
    got = chunker.chunk("Just one sentence. And another one.\n", chunker.hashed_vectors)
    assert [x.text for x in got] == ["Just one sentence. And another one."]
    assert chunker.chunk("", chunker.hashed_vectors) == []


def test_sections_by_middle(spark):
    c = spark.createDataFrame([("b", i, "x" * 10) for i in range(4)] + [("c", 0, "y" * 99)], "book_id string, chunk_idx int, text string")
    s = spark.createDataFrame([("b", 0, "x" * 20), ("b", 1, "x" * 9), ("c", 0, "y")], "book_id string, section_idx int, text string")
    got = {(r.book_id, r.chunk_idx): r.section_idx for r in chunker.assign_sections(c, s).collect()}
    assert got == {("b", 0): 0, ("b", 1): 0, ("b", 2): 1, ("b", 3): 1, ("c", 0): 0}


BODY = "This study looks at how readers find what they want in a large library of many books."


def test_abstract_forms():
    for head in ("## Abstract\n", "Abstract: ", "초 록\n", "<국문 요약>\n", "초록 "):
        assert papers.abstract(f"Title\n{head}{BODY}\nKeywords: a, b\n") == BODY
    toc = "Abstract\nIntro ........ 1\nMethod ........ 5\nResults ....... 9\nConclusion text here ... 12\n"
    assert papers.abstract(toc) is None
    anchored = f"Journal of Things Vol. 3\n\n{BODY} {BODY}\n주제어: 책, 독서\n"
    assert papers.abstract(anchored) == f"{BODY} {BODY}"
    assert papers.abstract("nothing of that kind") is None


def test_keywords_contents_references():
    assert papers.keywords("**Keywords:** cats, dogs; birds / fish\n") == ["cats", "dogs", "birds", "fish"]
    assert papers.keywords("핵심어\n\n하나, 둘\n셋\n\nbody") == ["하나", "둘 셋"]
    assert papers.contents("Contents\n1. Start ... 1\n2. Middle ... 4\n3. End ... 9\nThen text") == ["1. Start ... 1", "2. Middle ... 4", "3. End ... 9"]
    assert papers.contents("Contents\n1. Start\n2. End\nText") is None
    refs = "References in passing\nReferences\n[1] First entry that\nwraps here.\n12 / Journal\n[2] Second.\n[3] Third.\nAppendix\n[4] no"
    assert papers.references(refs) == ["[1] First entry that wraps here.", "[2] Second.", "[3] Third."]
    assert papers.references("References\nsome book one\n\nsome book two\nits end\n") == ["some book one", "some book two its end"]
    table = "Before it.\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n"
    assert [c for c, _ in papers.tables(table)] == ["Before it."] and papers.tables(table.rsplit("|", 6)[0]) == []


@pytest.mark.parametrize("line", ["[12] Anything", "7. Title", "104. T", "Kim, Lee-Park. (2004) On", "Kim, Lee, 1999. On", "Kim and Lee,  2011, p", "김철수, 이영희. 책", "김철수 외. 책", "박민 등, 글", "Bogart, H. On"])
def test_lines_that_begin_a_reference(line):
    assert papers.begins_reference(line)


@pytest.mark.parametrize("line", ["", "[a] x", "[] x", "1999 was", "1234. x", "Kim. and 2004", "Ki.2004", "kim, lee. 2004", "김. 책", "Kim and Lee 1999.", "Bogart H.", "bogart, H.", "plain words"])
def test_lines_that_begin_no_reference(line):
    assert not papers.begins_reference(line)


@pytest.mark.parametrize("line, entry", [("3) Aims", True), ("IV. Aims", True), ("가. 목적", True), ("IV.Aims", False), ("··· 7", True), ("Aims ..... 12", True), ("Aims  12", True), ("Aims 12", False), ("12", False), ("", False)])
def test_entries_of_contents(line, entry):
    assert papers.contents_entry(line) is entry


def test_marc_loose_and_mods_quirks(spark):
    assert one(spark, catalog.marc_loose(F.col("v"))["title"], "245 10$aLost title /$cSomeone 260  $aSeoul :$bHouse,$c1999") == "Lost title"
    xml = "<mods><titleInfo><title>A & B</title></titleInfo><name type='corporate'><namePart>Corp</namePart></name><relatedItem type='series'><titleInfo><title>S</title></titleInfo></relatedItem><accessCondition><licenseType>open</licenseType></accessCondition></mods>"
    got = one(spark, catalog.mods(catalog.parse_mods(F.col("v"))), xml)
    assert (got.title, got.personal_author, got.corporate_author, got.series_title, got.access_condition) == ("A & B", None, "Corp", "S", "open")


def test_merged_records(spark):
    mods = "<mods><titleInfo><title>M</title></titleInfo></mods>"
    rows = spark.createDataFrame([("1", "sheet", "", mods), ("2", "sheet", "", ""), ("3", "", "garbage", None), ("", "x", "", "")], "CONTENTS_ID string, TITLE_INFO string, MARC string, MODS string")
    got = {r.cnts_id: (r.title, r.source_format) for r in catalog.merged_records(rows).collect()}
    assert got == {"1": ("M", "MODS"), "2": ("sheet", "NONE"), "3": ("3", "ERROR")}


def test_articles(spark, tmp_path):
    (tmp_path / "a.csv").write_text("kci_fi_id,title_kr,KCI_CITATIONS\nK1,Title,7\nK2,,x\n,none,1\n")
    sheet = catalog.read_sheet(spark, str(tmp_path / "a.csv"))
    assert catalog.resolve_loader(sheet.columns) == "articles"
    got = {r.cnts_id: (r.title, r.kci_citations, r.genre) for r in catalog.articles(sheet).collect()}
    assert got == {"K1": ("Title", 7, "paper"), "K2": ("K2", 0, "paper")}
    with pytest.raises(ValueError):
        catalog.articles(spark.createDataFrame([("a",)], "other string"))


def test_files_and_manifest(spark, tmp_path):
    for name, body in (("a/x_.pdf", b"%PDF-1"), ("b/x.pdf", b"%PDF-2"), ("b/y.pdf", b"none")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    first, again = catalog.files(spark, str(tmp_path))
    assert {(r.id, r.readable) for r in first.collect()} == {("x", True), ("y", False)} and [r.id for r in again.collect()] == ["x"]
    (tmp_path / "m.jsonl").write_text('{"book_id": "1"}\n\n{"book_id": "2", "title": "t"}\n')
    assert catalog.manifest(spark, str(tmp_path / "m.jsonl")).count() == 2


def test_plan_again_ignores_vectors(spark):
    m = spark.createDataFrame([("a", "k", 1), ("a", "k", 2), ("", "k", 3)], "book_id string, object_key string, seq long")
    objects, known = spark.createDataFrame([("k",)], "object_key string"), spark.createDataFrame([("a",)], "book_id string")
    do = lambda again: [r.action for r in jobs.plan(m, objects, known, known, again).orderBy("seq").collect()]
    assert do(False) == ["already_embedded", "duplicate", "skip"] and do(True)[0] == "ingest"


def test_upsert_of_new_and_empty(spark):
    schema = "id long, a string, p string, m map<string,string>"
    old = spark.createDataFrame([(1, "x", "keep", {"k": "1", "l": "2"})], schema)
    new = spark.createDataFrame([(1, None, "no", {"k": "9"}, 1), (2, "y", "p", None, 1), (2, "z", "p", None, 2)], schema + ", seq int")
    got = {r.id: (r.a, r.p, r.m, r._change) for r in tables.upsert(old, new, "id", "seq", ("p",), ("m",)).collect()}
    assert got == {1: ("x", "keep", {"k": "9", "l": "2"}, "updated"), 2: ("z", "p", {}, "created")}


def test_replies(spark):
    assert one(spark, replies.fenced_json(F.col("v")), "no braces") is None
    assert one(spark, replies.reply_items(F.col("v"), ("book_id", "reason")), json.dumps({"items": [{"book_id": "1"}, {"book_id": "2", "reason": "r"}]}))[0].book_id == "2"
    body, themes = replies.summary_and_themes(F.col("v"))
    got = spark.createDataFrame([("**SUMMARY:** text **bold**\n## THEMES: a, *b*",)], "v string").select(body.alias("b"), themes.alias("t")).head()
    assert got.b == "text **bold" and got.t == ["a", "b"]


def test_types_and_authors(spark):
    df = spark.createDataFrame([("thesis", "813", "x"), (None, "813.7", "x"), (None, "KDC 325", "x"), (None, None, "조례 해설"), (None, "", "plain")], "g string, k string, t string")
    assert [r.x for r in df.select(biblio.doc_type(F.col("g"), F.col("k"), F.col("t")).alias("x")).collect()] == ["paper", "literature", "policy", "policy", "book"]


@pytest.mark.parametrize("size", range(1, 12))
def test_reply_splitter_at_every_cut(size):
    said = "#KW: a, b\nThe reason.\n###EFFECT###\nThe effect."
    s, out = ReplySplitter(), []
    parts = [said[i : i + size] for i in range(0, len(said), size)]
    for i, p in enumerate(parts):
        out += s.feed(p, i == len(parts) - 1)
    joined = {k: "".join(t for kind, t in out if kind == k) for k in ("keywords", "text", "effect")}
    assert joined == {"keywords": "a,b", "text": "The reason.\n", "effect": "The effect."}


def test_split_replies_as_a_stream(spark, tmp_path):
    said = {1: "#KW: a\nBody###EFFECT###Then", 2: "Only text"}
    rows = [(k, i, t[i : i + 4], i + 4 >= len(t)) for k, t in said.items() for i in range(0, len(t), 4)]
    schema = "stream_id long, seq int, delta string, last boolean"
    spark.createDataFrame(rows[:4], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    spark.createDataFrame(rows[4:], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = streams.split_replies(source).writeStream.format("memory").queryName("parts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT stream_id, kind, seq, text FROM parts ORDER BY stream_id, seq").collect()
    assert "".join(r.text for r in got if r.stream_id == 1 and r.kind == "text") == "Body"
    assert "".join(r.text for r in got if r.stream_id == 1 and r.kind == "effect") == "Then"
    assert "".join(r.text for r in got if r.stream_id == 2) == "Only text"


def test_stream_windows_equal_batch(spark, sf_dir, tmp_path):
    path = f"{sf_dir}/events.parquet"
    batch = spark.read.parquet(path)
    (tmp_path / "e").mkdir()
    batch.write.mode("overwrite").parquet(str(tmp_path / "e"))
    stream = streams.timed(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "e")))
    q = streams.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = streams.windowed(batch.withColumn("ts", F.col("ts").cast("timestamp")))
    assert spark.table("w").exceptAll(want).count() == 0 == want.exceptAll(spark.table("w")).count()


def test_followed_events_meet_by_cells(spark):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    a, b = [(1, 7, 0), (2, 7, 3599), (3, 7, 3600), (4, 8, 10)], [(11, 7, 0), (12, 7, 3600), (13, 7, 7199), (14, 7, 7200), (15, 7, 7201), (16, 8, 10), (17, 8, 3610)]
    first, second = (spark.createDataFrame([(i, u, at(s)) for i, u, s in x], "event_id long, user_id long, ts timestamp_ntz") for x in (a, b))
    want = {(i, j) for i, u, s in a for j, v, t in b if u == v and s < t <= s + 3600}
    got = streams.followed(first, second).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_dispatcher_ticks(spark, tmp_path):
    items = spark.createDataFrame([(1, 7, "pending", "extracted", 0), (2, 7, "failed", "finalized", 1)], "id long, job_id long, status string, stage string, attempt int").withColumns({"updated_at": F.lit("2024-01-01").cast("timestamp_ntz"), "error_group": F.lit(None).cast("string")})
    seen = {}
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    q = streams.run_dispatcher(ticks, lambda s: items, F.lit("2024-01-02").cast("timestamp_ntz"), lambda name, df: seen.__setitem__(name, df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()
    q.awaitTermination(60)
    assert {(r.id, r.status, r.next_stage) for r in seen["dispatch"]} == {(1, "dispatched", "summarize"), (2, "done", None)}


def test_read_filter_and_rewrite(spark):
    from stackroom.search import Filter, read_filter, rewrite

    assert read_filter("books since 2010") == Filter(2010, None) and read_filter("before 2000") == Filter(None, 1999)
    assert read_filter("from 2001 to 2005, newest") == Filter(2001, 2005, "date_desc") and read_filter("최근 5년 논문") == Filter(2019, None)
    assert read_filter("cats") == Filter() and read_filter("in 1999") == Filter(1999, 1999)
    catalog = spark.createDataFrame([("b", "The Old Sea", "sea, age")], "book_id string, title string, themes string")
    assert rewrite("books like old sea", catalog) == "sea, age" and rewrite("books like x", catalog) == "books like x"


def test_templates_and_generation(spark):
    from stackroom.plugins import TEMPLATES, generate, resume

    assert TEMPLATES.get("section_summary", "policy").parser == "plain" and TEMPLATES.get("section_summary", "book").parser == "labels"
    with pytest.raises(KeyError):
        TEMPLATES.get("nothing")
    with pytest.raises(KeyError):
        TEMPLATES.get("answer").render(context="c")
    df = spark.createDataFrame([(1, "A long sentence. Another. Third.", None), (2, None, None), (3, "x", "done")], "id int, p string, out string")
    got = {r.id: r.out for r in resume(df, "id", "p", "out").collect()}
    assert got[1].startswith("SUMMARY: A long sentence. Another.\nTHEMES: ") and got[2] is None and got[3] == "done"
    assert generate(df, "p", "r").filter("r IS NULL").count() == 1


def test_citations(spark):
    from stackroom.search import citations

    cols = "book_id string, personal_author string, corporate_author string, pub_date string, title string, title_remainder string, publisher string, vol_issue string, uci string, url string"
    rows = [("b", "A;B;C;D", None, "202305", "제목.", "Title", "Journal", "3(1)", "", "http://x"), ("c", "", None, None, "T", None, None, None, None, None)]
    got = {r.book_id: (r.korean, r.english) for r in citations(spark.createDataFrame(rows, cols)).collect()}
    assert got["b"] == ("A, B, C, D (2023). 제목. Journal, 3(1). http://x.", "A et al. (2023). Title. Journal, 3(1). http://x.")
    assert got["c"] == ("저자 미상 (n.d.). T.", "Unknown Author (n.d.). T.")


def test_texts_are_whole(spark, sf_dir):
    import re

    from stackroom import plans

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    words = {r.doc_id: r.words for r in plans.QUERIES["str12_keywords"](spark, sf_dir).collect()}
    assert words == {i: None if r.text is None else [w for w in (x.strip(" ") for x in re.split("[,;|/·]", r.text)) if w][:5] for i, r in docs.items()}
    said = {r.doc_id: r.context for r in plans.QUERIES["msc14_chat_context"](spark, sf_dir).collect()}
    assert all(said[i] == f"[p. {i % 9}] {r.text}" for i, r in docs.items() if i % 2 and i % 3 == 0)
    lines = {(r.book_id, r.place): r.line for r in plans.QUERIES["msc16_answer_context"](spark, sf_dir).collect()}
    assert lines == {(f"b{i // 8:06d}", i % 8 + 1): f"<{r.source}> {r.text or ''}" for i, r in docs.items() if i % 8 < 5}
