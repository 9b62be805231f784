"""What a paper's text says about itself: abstract, keywords, contents, references, tables.

A text becomes a list of lines, cut once for all extractors; a line remembers which labels it opens with. Whether it
looks like an entry, a page mark or a table row, predicates on the line tell. Every extractor works on places in this
list. `enrich` runs all of them in Arrow batches, one pass, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import dropwhile, islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stackroom.session import small_batches

# Labels as they appear in papers.
LABELS = {
    "abstract": ["초록", "국문초록", "영문초록", "한글요약", "국문요약", "영문요약", "요약", "Korean Abstract", "English Abstract", "Abstract", "Summary"],
    "plain abstract": ["초록", "국문초록", "영문초록", "Korean Abstract", "English Abstract", "Abstract"],
    "keywords": ["주제어", "핵심어", "색인어", "중심어", "주요어", "키워드", "Key words", "Keywords", "Key word", "Keyword"],
    "body": ["서론", "Introduction", "연구방법", "연구배경", "연구문제", "연구목적", "Methods", "Method", "Background", "결론", "Conclusion"],
    "references": ["참고문헌", "참고자료", "References", "Reference", "Bibliography"],
    "back": ["저자정보", "저자소개", "저자", "Author", "부록", "Appendix", "감사", "Acknowledgment", "연락처", "Contact", "Abstract", "초록", "요약", "국문초록", "국문요약", "영문초록", "영문요약"],
    "contents": ["목차", "차례", "Contents", "Content", "Table of Contents"],
}
# Bounds, in characters, lines or entries.
MIN_ABSTRACT, MAX_ABSTRACT, ANCHOR_WITHIN, MIN_ANCHORED = 50, 2000, 6000, 100
MAX_ENTRY, MAX_STRAY, MAX_REFERENCES, MAX_CONTENTS = 600, 4, 200, 60
TABLE_CONTEXT, BLOCK_LINES, LEAST_ENTRIES = 200, 5, 3
# What marks a line as no prose; words behind a list of names; dots and dashes of a leader; Roman numbers.
NOISE = ["Vol.", "No.", "p.", "pp.", "@", "Tel:", "Tel.", "Fax:", "Fax.", "Email", "E-mail", "대학교", "대학원", "학회", "저널", "Journal", "University"]
AND_OTHERS = ("외", "등")
LEADERS, ROMAN = ".·-", "IVXivxⅠⅡⅢⅣⅤⅥⅦⅧⅨ"
DECORATION = " \t#*-_<>[]【】()（）"

#: What is found in a text; texts that are Python objects at once.
COLUMNS, ROWS = ["abstract", "keywords", "contents", "references", "tables"], 64

_NUMBERING = re.compile(r"(?:\d+[.)]|[IVX]+\.)\s+", re.I)
_HEADING = re.compile(r"\d+[.)]|[A-Z가-힣]{2,}[.)]\s")
_SQUEEZED = {kind: sorted(("".join(x.lower().split()) for x in labels), key=len, reverse=True) for kind, labels in LABELS.items()}


def hangul(c: str) -> bool:
    return "가" <= c <= "힣"


def latin(c: str) -> bool:
    return c.isascii() and c.isalpha()


def year_at(s: str) -> bool:
    """Does s begin with a year of the last or this century?"""
    return s[:2] in ("19", "20") and len(s) >= 4 and s[2:4].isdecimal()


def run(s: str, test) -> int:
    """Length of the run of characters at the start of s that pass a test."""
    return next((i for i, c in enumerate(s) if not test(c)), len(s))


def numbered_reference(s: str) -> bool:
    """A number in brackets, or one of up to three digits and a dot."""
    if s.startswith("["):
        n = run(s[1:], str.isdecimal)
        return n > 0 and s[n + 1 : n + 2] == "]"
    n = run(s, str.isdecimal)
    return 1 <= n <= 3 and s[n : n + 1] == "."


def names_and_year(s: str) -> bool:
    """Names, then a dot and a year (in brackets or not), or a comma and a year that a comma or dot closes."""
    if not s or not (hangul(s[0]) or latin(s[0]) and s[0].isupper()):
        return False
    n = run(s, lambda c: hangul(c) or latin(c) or c.isspace() or c in ",-")
    names, rest = s[:n], s[n:]
    if rest.startswith("."):
        after = rest[1:].lstrip()
        return n >= 3 and after != rest[1:] and year_at(after.removeprefix("("))
    bare = names.rstrip()
    return year_at(rest) and rest[4:5] in (",", ".") and bare.endswith(",") and bare != names and len(bare) > 3


def names_in_hangul(s: str) -> bool:
    """A name in Hangul before a comma or dot, with or without a word for others."""
    n = run(s, hangul)
    rest = s[n:].lstrip()
    if rest.startswith(AND_OTHERS):
        rest = rest[1:].lstrip()
    return n >= 2 and rest[:1] in (",", ".")


def surname_and_initial(s: str) -> bool:
    n = run(s, lambda c: latin(c) or c == "-")
    rest = s[n + 1 :].lstrip()
    return n >= 2 and latin(s[0]) and s[0].isupper() and s[n : n + 1] == "," and rest != s[n + 1 :] and latin(rest[:1]) and rest[:1].isupper()


def begins_reference(s: str) -> bool:
    return numbered_reference(s) or names_and_year(s) or names_in_hangul(s) or surname_and_initial(s)


def ends_in_page(s: str) -> bool:
    """Something, a leader or a gap, and a number at the end."""
    stem = s.rstrip()
    before = stem.rstrip("0123456789")
    gap = before.rstrip()
    leader = len(gap) - len(gap.rstrip(LEADERS))
    return before != stem and (leader >= 3 and len(gap) > 3 or len(before) - len(gap) >= 2 and bool(gap))


def leads_to_page(s: str) -> bool:
    """Dots or a gap, then a number at the end: what lines of a table of contents look like within prose."""
    before = s.rstrip("0123456789")
    gap = before.rstrip()
    return before != s and (gap[-3:].strip(".·") == "" and len(gap) >= 3 or len(before) - len(gap) >= 2)


def contents_entry(s: str) -> bool:
    """A line of a table of contents: numbered in digits, Roman or Hangul, or with a leader, or with a page at its end."""
    digits = run(s, str.isdecimal)
    letters = run(s, lambda c: c in ROMAN or hangul(c))
    numbered = digits and s[digits : digits + 1] in (".", ")") or letters and s[letters : letters + 1] in (".", ")") and s[letters + 1 : letters + 2].isspace()
    return bool(numbered) or run(s, lambda c: c in LEADERS) >= 3 or ends_in_page(s)


def _label(body: str, kind: str) -> int:
    """Where the longest label of this kind that the line begins with ends, whatever its spacing; 0 if there is none."""
    places = [i for i, c in enumerate(body[:60]) if not c.isspace()]
    squeezed = "".join(body[i] for i in places).lower()
    found = next((x for x in _SQUEEZED[kind] if squeezed.startswith(x)), "")
    return places[len(found) - 1] + 1 if found else 0


@dataclass
class Line:
    """A line without the white space around it, and where it and what follows it lie in the text."""

    text: str
    start: int
    next: int
    at: dict[str, int] = field(default_factory=dict)
    body: str = ""
    shift: int = 0

    def __post_init__(self) -> None:
        self.body = self.text.lstrip(DECORATION)
        self.shift = len(self.text) - len(self.body)

    def label(self, kind: str) -> int:
        if kind not in self.at:
            self.at[kind] = _label(self.body, kind)
        return self.at[kind]

    def opens(self, kind: str, numbered: bool = False) -> bool:
        """Does a label of this kind begin the line, behind decoration (and a number)?"""
        if numbered and (m := _NUMBERING.match(self.body)):
            return _label(self.body[m.end() :], kind) > 0
        return self.label(kind) > 0

    def alone(self, kind: str) -> bool:
        return self.opens(kind) and not self.body[self.label(kind) :].strip(DECORATION)

    def value(self, kind: str) -> tuple[str, int] | None:
        """What follows the label and a colon, and its place in the line; None without a colon."""
        rest = self.body[self.label(kind) :].lstrip(DECORATION) if self.opens(kind) else ""
        if not rest.startswith((":", "：")):
            return None
        said = rest[1:].lstrip()
        return said, len(self.text) - len(said)

    @property
    def page_mark(self) -> bool:
        """A number before or after a slash, as in running heads."""
        first, _, rest = self.text.partition("/")
        last = self.text.rpartition("/")[2]
        return "/" in self.text and (first.strip().isdigit() or (last.strip().isdigit() and rest != ""))

    @property
    def noise(self) -> bool:
        low = self.text.lower()
        return self.text.isdigit() or any(year_at(self.text[i:]) for i, c in enumerate(self.text) if c in "12") or any(x.lower() in low for x in NOISE)

    @property
    def row(self) -> bool:
        return len(self.text) > 2 and self.text[0] == self.text[-1] == "|"

    @property
    def divider(self) -> bool:
        return self.row and not self.text.strip("|-: ")


def lines_of(text: str) -> list[Line]:
    out, at = [], 0
    for raw in text.splitlines(keepends=True):
        out.append(Line(raw.strip(), at + len(raw) - len(raw.lstrip()), at + len(raw)))
        at += len(raw)
    return out


def first_of(lines: list[Line], start: int, test) -> int:
    return next((i for i in range(start, len(lines)) if test(lines[i])), len(lines))


def ends_abstract(line: Line) -> bool:
    return line.opens("body", numbered=True) or line.opens("keywords", numbered=True)


def prose(body: str, least: int) -> str | None:
    """The body, cut, if it is long enough and no table of contents."""
    seen = list(islice((x for x in map(str.strip, body.splitlines()) if x), 8))
    dotted = sum(map(leads_to_page, seen))
    return body[:MAX_ABSTRACT] if len(body) >= least and not (seen and dotted >= max(2, len(seen) // 2)) else None


def abstract(text: str, lines: list[Line] | None = None) -> str | None:
    """Behind the first label that fitting prose follows, else the paragraph above the keyword line."""
    lines = lines or lines_of(text)
    for i, line in enumerate(lines):
        said = line.value("abstract")
        if line.alone("abstract"):
            start = line.next
        elif said:
            start = line.start + said[1]
        elif line.opens("plain abstract") and line.body[line.label("plain abstract") :][:1].isspace():
            start = line.start + line.shift + line.label("plain abstract")
        else:
            continue
        stop = first_of(lines, i + 1, ends_abstract)
        body = text[start : lines[stop].start] if stop < len(lines) else text[start : start + MAX_ABSTRACT]
        if found := prose(body.strip().lstrip(":：").strip(), MIN_ABSTRACT):
            return found
    anchor = first_of(lines, 0, lambda x: x.value("keywords") is not None)
    if anchor == len(lines) or lines[anchor].start > ANCHOR_WITHIN:
        return None
    above = dropwhile(lambda x: not x.text, reversed(lines[:anchor]))
    paragraph = [x.text for x in takewhile(lambda x: x.text and not x.noise and not ends_abstract(x), above)]
    return prose(" ".join(reversed(paragraph)), MIN_ANCHORED)


def keywords(text: str, lines: list[Line] | None = None) -> list[str] | None:
    """Behind the label and a colon, else in BLOCK_LINES lines from a label alone on."""
    lines = lines or lines_of(text)
    here = first_of(lines, 0, lambda x: bool((x.value("keywords") or ("",))[0].strip(DECORATION)))
    if here < len(lines):
        raw = lines[here].value("keywords")[0].lstrip(DECORATION)
    else:
        label = first_of(lines, 0, lambda x: x.alone("keywords") or (x.value("keywords") or ("none",))[0].strip(DECORATION) == "")
        below = islice(dropwhile(lambda x: not x.text, lines[label + 1 :]), BLOCK_LINES - 1)
        raw = " ".join(x.text for x in takewhile(lambda x: x.text and not _HEADING.match(x.text), below))
    return [w for w in map(str.strip, re.split(r"[,;/，；]", raw)) if w] or None


def contents(text: str, lines: list[Line] | None = None) -> list[str] | None:
    """Entries below the label, up to the first line that is none, or a gap of three lines."""
    lines = lines or lines_of(text)
    label = first_of(lines, 0, lambda x: x.alone("contents") and x.shift == 0)
    some = lines[label + 1 : label + 1 + MAX_CONTENTS + 20]
    entry = np.array([bool(x.text) and contents_entry(x.text) for x in some], bool)
    blank = np.array([not x.text for x in some], bool)
    stops = [len(some)]
    stops += np.flatnonzero(blank[2:] & blank[1:-1] & blank[:-2])[:1].tolist() if len(some) > 2 else []
    stops += np.flatnonzero(~entry & ~blank & (np.cumsum(entry) > 0))[:1].tolist()
    found = [x.text for x, ok in zip(some[: min(stops)], entry) if ok][:MAX_CONTENTS]
    return found if len(found) >= LEAST_ENTRIES else None


def references(text: str, lines: list[Line] | None = None) -> list[str]:
    """Entries below the last label, wrapped lines joined; by paragraphs where hardly an entry is recognised."""
    lines = lines or lines_of(text)
    labels = [i for i, x in enumerate(lines) if x.alone("references")]
    if not labels:
        return []
    part = [x for x in lines[labels[-1] + 1 : first_of(lines, labels[-1] + 1, lambda x: x.opens("back"))] if not x.page_mark]
    some = [x.text for x in part if x.text]
    begins = np.array([begins_reference(x) for x in some], bool)
    starts = np.flatnonzero(begins)
    found: list[str] = []
    if len(starts) and starts[0] < MAX_STRAY:
        length = np.cumsum([len(x) for x in some])
        group = np.cumsum(begins) - 1
        within = length - np.concatenate([[0], length])[starts[np.maximum(group, 0)]]
        stop = min([*np.flatnonzero((group >= 0) & ~begins & (within > MAX_ENTRY)).tolist(), len(some)])
        found = [" ".join(some[a:min(b, stop)]) for a, b in zip(starts, [*starts[1:], len(some)]) if a < stop]
    if len(found) < LEAST_ENTRIES:
        number = np.cumsum([not x.text for x in part])
        paragraphs = [" ".join(x.text for x, k in zip(part, number) if k == n and x.text) for n in sorted(set(number.tolist()))]
        found = max(found, [x for x in paragraphs if x], key=len)
    return found[:MAX_REFERENCES]


def tables(text: str, lines: list[Line] | None = None) -> list[tuple[str, str]]:
    """(context before, markdown) of tables of at least two data rows and two columns."""
    lines, out = lines or lines_of(text), []
    for i, line in enumerate(lines):
        if not line.divider:
            continue
        header = next((x for x in reversed(lines[:i]) if x.text), line)  # blank lines may lie between
        if header.row and not header.divider:
            stop = first_of(lines, i + 1, lambda x: not x.row)
            data = sum("---" not in x.text for x in lines[i + 1 : stop])
            if data >= 2 and header.text.count("|") >= 3:
                out.append((text[max(0, header.start - TABLE_CONTEXT) : header.start].strip(), text[header.start : lines[stop - 1].next].strip()))
    return out


def enrich(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, abstract, keywords, contents, references, tables of each document."""
    small_batches(docs.sparkSession)
    words = pa.list_(pa.string())
    kinds = [pa.string(), words, words, words, pa.list_(pa.struct([("context", pa.string()), ("markdown", pa.string())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some, rows = batch.slice(at, ROWS), []
                for text in some.column(1):
                    text = text.as_py() or ""
                    lines = lines_of(text)
                    rows.append((abstract(text, lines), keywords(text, lines), contents(text, lines), references(text, lines), [{"context": c, "markdown": m} for c, m in tables(text, lines)]))
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, kind) for c, kind in zip(zip(*rows), kinds))], names=[key, *COLUMNS])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, abstract string, keywords array<string>, contents array<string>, references array<string>, tables array<struct<context:string,markdown:string>>")
