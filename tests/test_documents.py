"""Crawls, figures, citations, extractor comparison and resumable batches on rows of their own."""

import base64
import re

import pytest
from pyspark.sql import functions as F

from stackroom.functions import figures as G
from stackroom.operators import citations, crawl, extraction
from stackroom.operators.batches import AllFailed, ReplyTable


def listing(spark, pages):
    return spark.createDataFrame([(p, f"id{p % 7}", p) for p in pages], "page_num long, key string, n long")


def walked(pages, start, total, most):
    """The rule, page by page."""
    read, empty, page = [], 0, start
    while (total is None or page <= total) and page <= max([*pages, start]) + most + 1:
        if page in pages:
            read, empty = [*read, page], 0
        else:
            empty += 1
            if empty >= most:
                return read, page + 1, True
        page += 1
    return read, page, False


@pytest.mark.parametrize("pages", [[1, 2, 3, 8, 9, 20], [1, 2, 9], [6, 7], [5, 10, 15], [], [1], [3, 4, 10, 11]])
@pytest.mark.parametrize("start, total", [(1, 12), (1, 8), (4, 60), (1, 100)])
def test_crawl_ends_where_the_rule_says(spark, pages, start, total):
    kept, progress = crawl.crawled(listing(spark, pages), start, total)
    read, following, ended = walked(set(pages), start, total, crawl.MOST_EMPTY)
    assert sorted(r.page_num for r in kept.collect()) == read
    assert (progress.last, progress.next, progress.ended) == (read[-1] if read else None, following, ended)


def test_tries_and_first_item(spark):
    tries = spark.createDataFrame([(1, 2, "a"), (1, 3, "b"), (2, 4, "c"), (3, 1, "d"), (3, 1, "e"), (3, 2, "f")], "page_num long, attempt int, key string")
    assert {(r.page_num, r.key) for r in crawl.settled(tries).collect()} == {(1, "a"), (3, "d"), (3, "e")}
    old, new = listing(spark, [9]), listing(spark, [2, 16, 3])
    got = {(r.key, r.page_num) for r in crawl.collected(new, "key", ["page_num"], old).collect()}
    assert got == {("id2", 9), ("id3", 3)}


INLINE = re.compile(r"!\[([^\]]*)\]\(data:image/[^;]+;base64,([^)]+)\)")


def test_figures_like_a_walk_over_matches(spark):
    img = lambda s: f"![alt {s}](data:image/jpeg;base64,{base64.b64encode(s.encode()).decode()})"
    texts = [
        "",
        "no figure ![x](http://a/b.png) at all",
        img("first") + " middle " + img("two") + img("three"),
        "가" * 500 + img("é") + "나" * 250 + img("x" * 300) + "\n\n\n다" * 60,
        "bad ![z](data:image/png;base64,AAAAA) then " + img("good") + " \n ",
        "  \n" + "w" * 290 + img("a") + "  ",
    ]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "page int, text string")
    got = {(r.page, r.img_idx): (r.start, r.stop, bytes(r.image), r.before, r.after) for r in df.select("page", F.inline(G.figures(F.col("text")))).collect()}
    want = {}
    for page, t in enumerate(texts):
        for i, m in enumerate(INLINE.finditer(t)):
            try:
                image = base64.b64decode(m[2], validate=True)
            except ValueError:
                continue
            near = lambda s: INLINE.sub("[그림]", s).strip()
            want[page, i] = (m.start(), m.end(), image, near(t[max(0, m.start() - 300) : m.start()]), near(t[m.end() : m.end() + 300]))
    assert got == want
    marks = {r.page: r.t for r in df.select("page", G.text_with_marks(F.col("text")).alias("t")).collect()}
    assert marks[1] == "no figure [그림] at all" and marks[2] == "[그림] middle [그림][그림]" and marks[99] is None


SAID = ["see p.23–45 and p.7", "7페이지와 12페이지", "23-45페이지", "p.235", "p.23x", "p.023", "x7페이지", "쪽p.7", "nothing", None, "p.23–45페이지, 3~5페이지", "pp.7, 12-13", "p.7페이지"]


def test_citations_like_the_patterns(spark):
    pages = [(7, 9), (12, 12), (23, 45), (23, 50), (45, 46), (235, 236), (3, 5), (3, 6), (0, 3), (5, 5)]
    answers = spark.createDataFrame(list(enumerate(SAID)), "answer int, said string")
    hits = spark.createDataFrame([(a, s, e) for a in range(len(SAID)) for s, e in pages] + [(0, None, 1)], "answer int, page_start int, page_end int")
    want = set()
    for a, text in enumerate(SAID):
        for s, e in pages:
            forms = [rf"p\.{s}[–\-~]{e}\b", rf"p\.{s}\b", rf"\b{s}[–\-~]{e}페이지", rf"\b{s}페이지"]
            if s > 0 and any(re.search(f, text or "") for f in forms):
                want.add((a, s, e))
    assert {tuple(r) for r in citations.cited_hits(answers, hits).collect()} == want
    assert "ArrowEvalPython" not in citations.cited_hits(answers, hits)._jdf.queryExecution().executedPlan().toString()


def test_extractors_side_by_side(spark):
    page = "page long, text string, confidence double"
    lists = {"a": spark.createDataFrame([(1, "abc", 1.0), (2, None, None)], page), "b": spark.createDataFrame([(2, "xy", 0.5), (4, "", 0.3)], page), "c": spark.createDataFrame([], page)}
    got = {tuple(r) for r in extraction.aligned(lists, texts=True).select("page", "a_chars", "a_confidence", "a_text", "b_chars", "b_confidence", "c_chars", "c_text").collect()}
    assert got == {(1, 3, 1.0, "abc", 0, None, 0, ""), (2, 0, None, "", 2, 0.5, 0, ""), (4, 0, None, "", 0, 0.3, 0, "")}
    assert {tuple(r) for r in extraction.totals(lists).collect()} == {("a", 3, 2, 3, 1.0), ("b", 3, 2, 2, 0.4), ("c", 3, 0, 0, None)}


def test_batch_is_taken_up_again(spark, tmp_path):
    def upper(prompts):
        return [p.upper() for p in prompts]

    def only_short(prompts):
        if any(len(p) > 3 for p in prompts):
            raise TimeoutError("too long")
        return upper(prompts)

    def never(prompts):
        raise ConnectionError("down")

    rows = spark.createDataFrame([(1, "abc"), (2, "abcdef"), (3, None), (4, "abc"), (5, "x"), (6, "longer")], "id int, prompt string")
    replies = ReplyTable(spark, f"{tmp_path}/r", "m")
    with pytest.raises(AllFailed, match="down"):
        replies.ask(rows, "prompt", never)
    assert replies.ask(rows, "prompt", only_short) == (2, 2)
    got = {r.id: (r.reply, r.error) for r in replies.joined(rows, "prompt").collect()}
    assert got == {1: ("ABC", None), 2: (None, "TimeoutError: too long"), 3: (None, None), 4: ("ABC", None), 5: ("X", None), 6: (None, "TimeoutError: too long")}
    assert replies.ask(rows, "prompt", upper) == (2, 0)
    assert replies.ask(rows, "prompt", never) == (0, 0)  # nothing is left to ask
    assert {r.id: r.reply for r in replies.joined(rows, "prompt").collect()} == {1: "ABC", 2: "ABCDEF", 3: None, 4: "ABC", 5: "X", 6: "LONGER"}
    assert replies.ask(rows.filter("id = 1"), "prompt", lambda ps: [p + "!" for p in ps], again=True) == (1, 0)
    assert replies.joined(rows.filter("id = 1"), "prompt").head().reply == "abc!"
    assert ReplyTable(spark, f"{tmp_path}/r", "other").ask(rows, "prompt", upper) == (4, 0)  # another model is asked anew

def test_paper_parts_go_in_small_batches(spark):
    """What a worker holds doesn't grow with a task's rows."""
    from stackroom.operators import papers

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(5000, numPartitions=1).selectExpr("id AS doc_id", "if(id % 7 = 0, null, concat('Abstract: ', repeat('word ', 30), id, '\\nKeywords: a, b')) AS text")
    got = papers.enrich(docs)
    sizes = [len(b) for b in docs.mapInArrow(lambda bs: (b for b in bs), "doc_id long, text string").toArrow().to_batches()]
    rows = {r.doc_id: r for r in got.collect()}
    assert max(sizes) <= 1000 and len(rows) == 5000
    assert rows[7].abstract is None and rows[8].keywords == ["a", "b"] and rows[4999].abstract.endswith("4999")
