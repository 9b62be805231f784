"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

Training counts the 1- to 3-grams of letters of every labelled text, by language, and keeps the most frequent ones in
order. A document's own most frequent n-grams are compared with each profile: the distance is the sum of how far each
n-gram is out of place, and one that a profile lacks is as far as the profile is long.

Defined results: a null text, or one without a letter, is `und` with score 0. Rows without text or language teach
nothing. Equal counts are ordered by n-gram, equal distances by language. Without any training row every document is
`und`. Rows are never joined, so null or repeated ids pass through. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quiet_gc, small_batches

#: N-grams in a profile.
PROFILE = 400
UNKNOWN = "und"
#: N-grams held before they are counted.
HELD = 1 << 22
_SALTS = 16
_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """For each code point the lower-case letter, or 0 for what is no letter."""
    global _fold
    if _fold is None:
        table = np.zeros(0x110000, np.int64)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold = table
    return _fold


def grams(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams, 21 bits a letter; 0 stands for a word's edge."""
    points = fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate([[0], points, [0]])
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    p = points[keep]
    if len(p) < 3:
        return np.zeros(0, np.int64)
    two = p[:-1] << 21 | p[1:]
    three = two[:-1] << 21 | p[2:]
    return np.concatenate([p[p != 0], two, three[p[1:-1] != 0]])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[at], np.diff([*at, len(codes)])


def top(codes: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The k most frequent codes, in order."""
    return codes[np.lexsort((codes, -counts))[:k]]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Profiles by language: PROFILE n-grams for each, which is all that reaches the driver."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            codes, counts = counted(np.concatenate(held.pop(lang)))
            size.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = grams(text)
                held.setdefault(lang, []).append(got)
                size[lang] = size.get(lang, 0) + len(got)
                if size[lang] > HELD:
                    yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    rows = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).dropna()
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), "gram"]
    counts = counts.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(_SALTS)))
    for by in (["lang", "salt"], ["lang"]):
        counts = counts.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= PROFILE)
    found: dict[str, list] = {}
    for r in counts.select("lang", "gram", "place").collect():
        found.setdefault(r.lang, []).append((r.place, r.gram))
    return {lang: [g for _, g in sorted(p)] for lang, p in sorted(found.items())}


class Profiles:
    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = list(profiles)
        self.codes = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.place = np.full((len(self.codes) + 1, len(self.langs)), PROFILE, np.int64)
        for j, p in enumerate(profiles.values()):
            self.place[np.searchsorted(self.codes, np.array(p, np.int64)), j] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = grams(text) if text and self.langs else ()
        if not len(codes):
            return UNKNOWN, 0.0
        own = top(*counted(codes))
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at[self.codes[at] != own] = len(self.codes)
        place = self.place[at]
        far = np.where(place == PROFILE, PROFILE, np.abs(place - np.arange(len(own))[:, None])).sum(0)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (PROFILE * len(own)))


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text") -> DataFrame:
    """docs with the columns lang_pred and score added; other columns of these names are replaced."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Profiles(known.value)
        with quiet_gc():
            for texts in parts:
                yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    (found,) = fresh(docs.columns, "found")
    out = docs.withColumn(found, predict(docs[text_col].cast("string"))).drop("lang_pred", "score")
    return out.withColumns({"lang_pred": F.col(found)["lang_pred"], "score": F.col(found)["score"]}).drop(found)
