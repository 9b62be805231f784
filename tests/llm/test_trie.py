"""The prefix trie against a brute-force trie: odd rows, long chains, many radix rounds, conversations without turns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stackroom.llm import trie


def tie(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:15]


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, tie(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items()), key=str)


def made(seed=4, n=130):
    r = random.Random(seed)
    out = []
    for c in range(n):
        if c % 9 == 4:
            continue  # absent conversations
        for t in range(r.randint(1, 7)):
            out.append((c, t, r.choice(["user", "assistant"]), " ".join(r.choice(["a", "b c", "d\te"]) for _ in range(r.randint(0, 2)))))
    long = [(200, t, "user", r.choice("xy")) for t in range(60)]
    out += long + [(201, t, x, y) for _, t, x, y in long] + [(202, t, x, y) for _, t, x, y in long[:50]] + [(203, t, x, y if t < 58 else "z") for _, t, x, y in long]
    out += [(204 + i, 0, "user", "same first") for i in range(40)]
    out += [(1, None, None, None), (1, 2, "user", "tie"), (1, 2, "user", "eit"), (1, 2, "user", "tie"), (None, 0, "user", "lost"), (300, 0, "user", "word " * 30_000)]
    return out


@pytest.fixture(scope="module")
def frame(spark):
    rows = spark.createDataFrame(made(), "conv_id long, turn long, role string, text string").withColumns({c: F.lit(c) for c in ("id", "ids", "words", "digest", "key", "n", "base", "h")})
    return rows.repartition(4)


@pytest.mark.parametrize("local", [trie.LOCAL_TURNS, 12])
def test_against_brute_force(spark, frame, monkeypatch, local):
    monkeypatch.setattr(trie, "LOCAL_TURNS", local)
    got = trie.nodes(trie.rebuilt(trie.sequences(frame)))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rebuilt(ordered(made())))


def test_conversations_as_they_are_with_every_turn_by_broadcast(spark, frame, monkeypatch):
    monkeypatch.setattr(trie, "HOT_SHARE", 10**9)
    assert sorted(map(tuple, trie.of_conversations(frame).collect()), key=str) == brute(ordered(made()))


def test_empty_and_turnless(spark, frame):
    assert trie.of_conversations(frame.filter("false")).collect() == []
    one = spark.createDataFrame([(c, 0, "user", "x") for c in (2, 5, 7)], "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, trie.nodes(trie.rebuilt(trie.sequences(one))).collect()), key=str) == brute(rebuilt({c: [("user", "x")] for c in (2, 5, 7)}))
