"""Questions about a book: what a message asks for, the context it is answered from, and the turns that go with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.config import CONFIG
from stackroom.operators.tables import top_per_group

#: Words by which a message asks for references, and the headings of a question's parts. Fixed values.
REFERENCE_WORDS = ("참고문헌", "참고 문헌", "인용", "reference", "cited", "출처", "bibliography", "참고자료", "인용문헌", "인용 문헌")
REFERENCES_HEAD, CONTENT_HEAD, QUESTION_HEAD = "[이 논문의 참고문헌 목록]", "[참고 내용]", "[질문]"
#: References that a context holds at most. Fixed value.
MOST_REFERENCES = 50


def asks_for_references(message: Column) -> Column:
    """Does the message hold one of the words, in any case?"""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(False)
    for word in REFERENCE_WORDS:
        out = out | low.contains(word)
    return out


def numbered(lines: Column, most: int = MOST_REFERENCES) -> Column:
    """The first lines of an array, each behind its number."""
    return F.array_join(F.transform(F.slice(lines, 1, most), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def user_content(message: Column, references: Column, hits: Column) -> Column:
    """What is asked: references first where the message asks for them, else the hits by page, else the bare message.

    references: array of strings; hits: array of structs (page_start, page_end, text). A message that asks for
    references that aren't there stays bare.
    """
    wants = asks_for_references(message)
    block = F.array_join(F.transform(hits, lambda h: F.concat(F.lit("[p."), h["page_start"].cast("string"), F.lit("–"), h["page_end"].cast("string"), F.lit("]\n"), h["text"])), "\n\n")
    asked = F.concat(F.lit(f"\n\n{QUESTION_HEAD}\n"), message)
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return F.when(wants & some(references), F.concat(F.lit(f"{REFERENCES_HEAD}\n"), numbered(references), asked)).when(~wants & some(hits), F.concat(F.lit(f"{CONTENT_HEAD}\n"), block, asked)).otherwise(message)


def recent_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", most: int = CONFIG.history) -> DataFrame:
    """The last turns of each conversation, with their place from the end."""
    return top_per_group(turns, [conv], [F.col(turn).desc_nulls_last()], most, "from_end")
