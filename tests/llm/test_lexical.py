"""Ranked lexical search against a brute-force ranking: odd rows, blocks of items, small windows, long texts in slices."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stackroom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k=10):
    """docs: (id, text); items: (id, text). All rows of the k best, as sorted tuples."""
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    counted = [x for x in counted if x[2]]
    total, df = sum(n for _, _, n in counted), Counter(t for _, c, _ in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counted:
            m = 10 + 90 * n * len(counted) // total
            s = sum(weight[t] * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "bado KELU mira"), (2, "zhyn wroth, ghule. fyrd"), (3, None), (4, ""), (5, "notthere"), (6, "bado bado 7 8 x"), (7, "éa Éa straße"), (1, "bado KELU mira"), (None, "tosu")]


@pytest.fixture(scope="module")
def texts(fixture_rows):
    r = random.Random(8)
    return [x[:2] for x in fixture_rows] + [(1000 + i, " ".join(r.choice(["bado", "KELU", "éa", "Éa", "straße", "x-y", "7"]) for _ in range(r.randint(1, 12)))) for i in range(150)]


def frames(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("n", "codes", "counts", "place", "score", "item_id")})
    return docs.repartition(5), spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit(c) for c in ("doc_id", "terms", "place", "rank")})


@pytest.mark.parametrize("pairs", [lexical.BLOCK_PAIRS, 4])
def test_against_brute_force(spark, texts, monkeypatch, pairs):
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", pairs)
    got = lexical.search(*frames(spark, texts))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(texts, ITEMS)


def test_empty_tables(spark, texts):
    docs, items = frames(spark, texts)
    assert lexical.search(docs.filter("false"), items).collect() == []
    assert lexical.search(docs, items.filter("false")).collect() == []


def test_windows_and_slices(texts, monkeypatch):
    monkeypatch.setattr(lexical, "WINDOW", 16)
    monkeypatch.setattr(lexical, "SLICE", 50)
    docs = sorted((x for x in texts if x[0] is not None), key=lambda x: x[0])
    asked = sorted({t for _, x in ITEMS for t in terms(x)})
    vocabulary = lexical.Vocabulary([t.encode() for t in asked])
    rows = []
    for i, t in docs:
        for _, n, sizes, codes, counts in vocabulary.counted(pa.array([t or ""])):
            want = Counter(terms(t))
            assert int(n[0]) == sum(want.values())
            assert dict(zip(codes.tolist(), counts.tolist())) == {asked.index(x): c for x, c in want.items() if x in asked}
            rows.append((i, int(n[0]), codes.tolist(), counts.tolist()))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["doc_id", "n", "codes", "counts"])
    documents, length, df = sum(r[1] > 0 for r in rows), sum(r[1] for r in rows), Counter(c for r in rows for c in r[2])
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df[i] + 1))) for i in range(len(asked))])
    codes = [[asked.index(t) for t in sorted(set(terms(x)))] for _, x in ITEMS]
    starts = np.cumsum([0, *map(len, codes)])
    buckets = lexical.Buckets(starts, np.array([c for x in codes for c in x]), weights, documents, length, 10)
    for window in lexical._windows(iter([batch.slice(0, 7), batch.slice(7)])):
        assert len(window[0]) <= 16
        buckets.window(*window)
        assert not buckets.scores.any()
    got = [(item, r, -d, s) for (item, _), heap in zip(ITEMS, buckets.heaps) for r, (s, d) in enumerate(sorted(heap, key=lambda x: (-x[0], -x[1])), 1)]
    assert sorted(got, key=str) == brute(docs, ITEMS)


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**9, 2 * 10**9])
    assert lexical.length_parts(n, 10**9, 10**15).tolist() == [10 + 90 * int(x) * 10**9 // 10**15 for x in n]
