"""BPE, packing, language ID, quality, LM scoring: against the library, round trips, brute force, held-out accuracy."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stackroom.llm import bpe, language, lm, packing, quality, units
from stackroom.llm.queries import subword_vocabulary, word_tokenizer


@pytest.fixture(scope="module")
def own():
    with open(word_tokenizer(), "rb") as f:
        return bpe.WordBpe(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_tokenizer())


ODD = st.text(alphabet=list("abAZ'sdé́ßΣİ \x1c\x1f\x85\xa0ﬁ中🙂0٣½\n\t<|endoftext|>$%.ẛ̣한가Å"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=8))
def test_bpe_equals_library(own, library, texts):
    column = pa.array(texts, pa.string())
    got = [ids[a:b] for _, ids, at in own.encode_column(column) for a, b in zip(at, at[1:])]
    decoded = [d for _, ids, at in own.encode_column(column) for d in bpe.joined(own.names, ids, at).to_pylist()]
    packed = [ids[a:b].tolist() for _, ids, at in own.encode_column(column, 1) for a, b in zip(at, at[1:])]
    assert len(got) == len(decoded) == len(packed) == len(texts)
    for text, ids, line, closed in zip(texts, got, decoded, packed):
        want = library.encode(text, add_special_tokens=False)
        assert ids.tolist() == want.ids == closed[:-1] and closed[-1] == 1
        assert line == library.decode(want.ids, skip_special_tokens=False) == own.decode(want.ids)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abcdefinth", min_size=1, max_size=400))
def test_blocks_of_trees_equal_one_tree(own, word):
    flat, counts = own.merge_flat(np.frombuffer(word.encode(), np.uint8), np.array([len(word)]))
    assert flat.tolist() == own.merge(own.byte_ids(word)) and counts.tolist() == [len(flat)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abAB \x00\t\n\xa0é漢", max_size=40), max_size=12), st.integers(1, 40))
def test_units_number_the_words(texts, most):
    table, seen = units.Units(), {}
    for row, data, offsets in units.texts_of(pa.array(["", *texts], pa.string()).slice(1), most):
        low = units.lowered(data)
        starts, sizes, at = units.words(low, offsets)
        want = [t.encode().lower().split() for t in texts[row : row + len(offsets) - 1]]
        assert [low[a : a + n].tobytes() for a, n in zip(starts, sizes)] == [w for ws in want for w in ws]
        assert np.diff(at).tolist() == [len(ws) for ws in want]
        codes, new = table.codes(low, starts, sizes)
        for i, (c, w) in enumerate(zip(codes.tolist(), [w for ws in want for w in ws])):
            assert (i in new) == (w not in seen) and seen.setdefault(w, c) == c
    assert sorted(seen.values()) == list(range(len(table)))


def test_bpe_rows(docs, no_docs, library):
    got = bpe.encode(docs, word_tokenizer()).collect()
    want = Counter((r.doc_id, " ".join(map(str, library.encode(r.text or "", add_special_tokens=False).ids))) for r in docs.collect())
    assert Counter((r.doc_id, r.ids) for r in got) == want and all(r.n_tokens == len(r.ids.split()) for r in got)
    assert bpe.encode(no_docs, word_tokenizer()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60))
def test_packing_is_a_partition(lengths):
    sequences = packing.best_fit(lengths)
    seen = sorted((d, s, n) for q in sequences for d, s, n in q)
    for doc, n in enumerate(lengths):
        at = 0
        for d, s, k in seen:
            if d == doc:
                assert s == at and k > 0
                at += k
        assert at == n
    sizes = [sum(p[2] for p in q) for q in sequences]
    assert all(0 < n <= 2048 for n in sizes)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding <= 0.02 * 2048 * max(1, len(sizes))


def test_capacity_tree_takes_the_tightest():
    r, tree, rooms = random.Random(1), packing.CapacityTree(100), []
    for i in range(500):
        if r.random() < 0.5:
            rooms.append(r.randint(1, 100))
            tree.add(rooms[-1], i)
        else:
            need = r.randint(1, 100)
            fits = [x for x in rooms if x >= need]
            got = tree.take(need)
            assert (got[0] if got else None) == (min(fits) if fits else None)
            if fits:
                rooms.remove(min(fits))


def test_pack_rows(docs, no_docs, library):
    got = packing.pack(docs, word_tokenizer()).collect()
    ids = sorted((tuple(library.encode(r.text or "", add_special_tokens=False).ids) + (1,) for r in docs.collect()), key=repr)
    pieces = {}
    for r in got:
        assert r.length * 4 == len(r.ids)
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sum(r.length for r in got) == sum(map(len, ids))
    for q in {r.sequence_id for r in got}:
        inside = sorted((r.offset, r.length) for r in got if r.sequence_id == q)
        assert inside[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(inside, inside[1:]))
    one = [r for r in got if r.doc_id == 5]
    want = np.array(library.encode(docs.filter("doc_id = 5").head().text, add_special_tokens=False).ids + [1], "<u4").tobytes()
    assert b"".join(bytes(r.ids) for r in sorted(one, key=lambda r: r.start)) == want
    assert packing.pack(no_docs, word_tokenizer()).count() == 0


def test_language_held_out_and_odd_rows(docs, no_docs):
    known = docs.filter("doc_id < 60 OR doc_id >= 300 OR doc_id IS NULL")
    profiles = language.learn(known.filter("doc_id % 4 <> 2 OR doc_id IS NULL"))
    got = language.identify(docs, profiles).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 4 == 2]
    assert held and all(r.lang_pred == r.lang for r in held)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (300, 301, 302, 303)}
    assert set(odd.values()) == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got) and len(got) == docs.count()
    assert language.learn(no_docs) == {} and language.identify(docs, {}).filter("lang_pred <> 'und'").count() == 0
    assert language.identify(no_docs, profiles).count() == 0


def test_grams_by_hand():
    codes = {"a": ord("a"), "b": ord("b"), "_": 0}
    want = Counter(sum(codes[c] << 21 * (len(g) - 1 - i) for i, c in enumerate(g)) for g in ("a", "b", "a", "_a", "ab", "b_", "_a", "a_", "_ab", "ab_", "_a_"))
    assert Counter(language.grams("Ab 7a!").tolist()) == want


def test_quality_learns_and_shrinks(spark, no_docs):
    r = random.Random(5)
    good = [" ".join(r.choice(["tree", "river", "stone", "cloud", "field", "wind"]) for _ in range(r.randint(2, 60))) for _ in range(300)]
    bad = [t.replace("tree", "tree%%%").replace("wind", "wind$$$") if i % 2 else t + " vilest" for i, t in enumerate(good[:100])]
    docs = [(i, t, f"host{i % 5}/p{i % 2}") for i, t in enumerate(good + bad)]
    labels = [(i, int(not (i >= 300 and (i - 300) % 2)), int(i >= 300 and (i - 300) % 2 == 0)) for i, _, _ in docs]
    d = spark.createDataFrame([*docs, (None, None, None), (900, "", "host1"), (901, "tree river", None)], "doc_id long, text string, source string")
    l = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1, 1), (900, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(d, l).collect()}
    held = [(got[i].kept, i < 300) for i, _, _ in docs if i % 3 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97 and got[None] is not None and got[901].kept
    assert quality.classify(d, l.limit(0)).filter("kept").count() == d.count()
    assert quality.classify(no_docs.select("doc_id", "text", "source"), l).count() == 0
    marks = [(i, 0 if i % 5 == 1 else 1, 0) for i in range(100)]
    paths, hosts, prior = quality.sites(d, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    post, host_post = {r.path: r.path_logit for r in paths.collect()}, {r.host: r.host_logit for r in hosts.collect()}
    assert 0.7 < prior < 0.9 and max(v for k, v in post.items() if k.startswith("host1")) < 0 < min(v for k, v in post.items() if not k.startswith("host1"))
    assert host_post["host1"] < 0 < host_post["host0"]


def test_sites_equal_brute_force(spark):
    r = random.Random(9)
    rows = [(i, "", f"https://h{(h := r.randrange(6))}/p{(p := r.randrange(4))}/x?y") for i in range(400)]
    marks = [(i, int(r.random() < 0.2 + 0.12 * int(s[9]) + (0.2 if s[12] == "1" else 0)), int(r.random() < 0.05)) for i, _, s in rows if i % 4]
    d, l = spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    paths, hosts, prior = quality.sites(d, l)
    n, g = Counter(), Counter()
    for i, q, t in marks:
        path = rows[i][2][8:13]
        n[path] += 1
        g[path] += q * (1 - t)
    hn, hg, parts = Counter(), Counter(), Counter()
    for k in n:
        hn[k[:2]] += n[k]
        hg[k[:2]] += g[k]
        parts[k[:2]] += 1
    total, good = sum(n.values()), sum(g.values())
    m = (good + 1) / (total + 2)
    k_of = lambda spread, free, spare: min(1e6, max(2.0, m * (1 - m) / max(1e-9, (spread - free * m * (1 - m)) / spare) - 1))
    host_k = k_of(sum(hg[h] ** 2 / hn[h] for h in hn) - good**2 / total, len(hn) - 1, total - sum(x * x for x in hn.values()) / total)
    path_k = k_of(sum(g[k] ** 2 / n[k] for k in n) - sum(hg[h] ** 2 / hn[h] for h in hn), sum(parts.values()) - len(parts), sum(hn[h] - sum(n[k] ** 2 for k in n if k[:2] == h) / hn[h] for h in hn))
    host = {h: (host_k * m + hg[h]) / (host_k + hn[h]) for h in hn}
    path = {k: (path_k * host[k[:2]] + g[k]) / (path_k + n[k]) for k in n}
    logit = lambda x: math.log(x / (1 - x))
    assert prior == pytest.approx(m)
    assert {r.host: r.host_logit for r in hosts.collect()} == pytest.approx({h: logit(x) for h, x in host.items()})
    assert {r.path: r.path_logit for r in paths.collect()} == pytest.approx({k: logit(x) for k, x in path.items()})


def test_sites_join_is_the_same_beyond_the_small_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"h{i % 3}") for i in range(50)] + [(99, None)], "doc_id long, source string")
    sites = spark.createDataFrame([("h0", 1.5), ("h1", -2.0)], "a string, b double")
    want = sorted(map(tuple, quality.at_sites(docs, F.col("source"), sites, "found").collect()))
    monkeypatch.setattr(quality, "SMALL_SITES", 0)
    assert sorted(map(tuple, quality.at_sites(docs, F.col("source"), sites, "found").collect())) == want


def test_language_distance_equals_brute_force(spark):
    texts = [("aa", "banana bandana band"), ("aa", "cabana banal"), ("bb", "krk trk prk zrk"), ("bb", "krk krt")]
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts)], "doc_id long, text string, lang string")

    def ranks(some, size=language.PROFILE):
        n = Counter(g.tolist()[0] if hasattr(g, "tolist") and g.ndim else int(g) for t in some for g in language.grams(t))
        return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:size]]

    profiles = {k: ranks([t for q, t in texts if q == k]) for k in ("aa", "bb")}
    assert {k: [int(g) for g in v] for k, v in language.learn(docs).items()} == profiles
    ask = ["bananas", "krk", "xyz banana krk", "a"]
    for r in language.identify(spark.createDataFrame([(i, t) for i, t in enumerate(ask)], "doc_id long, text string"), profiles).collect():
        own = ranks([r.text])
        far = {k: sum(abs(p.index(g) - i) if g in p else language.PROFILE for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k))
        assert r.lang_pred == best and r.score == pytest.approx(1 - far[best] / (language.PROFILE * len(own)))


def toy_facts(n=40, seed=1):
    """Facts of a made-up vocabulary whose even ids open words; the last one is the end."""
    r = np.random.default_rng(seed)
    opens = np.arange(n) % 2 == 0
    opens[-1] = True
    facts = lm.Facts(r.integers(0, 50, n).astype(float), opens)
    pairs = np.zeros((lm.CLASSES, lm.CLASSES))
    some = np.unique(facts.of)
    pairs[np.ix_(some, some)] = r.integers(0, 9, (len(some), len(some)))
    facts.learn(pairs, r.random((n, lm.TOPICS)) * 9)
    return facts


def noisy_params(seed=2):
    return {k: v + np.random.default_rng(seed).normal(0, 0.3, v.shape).astype(v.dtype) for k, v in lm.init_params().items()}


def test_lm_gradients():
    facts, r = toy_facts(), np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in noisy_params().items()}
    ids, real = r.integers(0, 40, (3, lm.WINDOW)), r.random((3, lm.WINDOW)) < 0.9
    x = facts.of[r.integers(0, 40, (3, lm.WINDOW))]
    g, _, _ = lm.gradients(p, facts, x, ids, real)

    def loss(q):
        return lm.gradients(q, facts, x, ids, real)[2] / real.sum()

    def slope(k, at, step):
        up, down = {**p, k: p[k].copy()}, {**p, k: p[k].copy()}
        up[k][at] += step
        down[k][at] -= step
        return (loss(up) - loss(down)) / (2 * step)

    for k in ("out", "up", "down", "bias"):
        at = (int(x[0, 1]), 1) if k == "bias" else tuple(n // 3 for n in p[k].shape)
        assert slope(k, at, 1e-3) == pytest.approx(g[k][at], rel=0.02, abs=2e-4), k
    # Attention weights are straight between powers of two, so what goes through them is close, not equal.
    for k in ("embed", "qkv", "far"):
        places = [np.unravel_index(i, p[k].shape) for i in np.argsort(-np.abs(g[k]).ravel())[:30]]
        want, got = np.array([slope(k, at, 0.03) for at in places]), np.array([g[k][at] for at in places])
        assert want @ got > 0.95 * np.linalg.norm(want) * np.linalg.norm(got), k


def toy_scorer(facts, params=None):
    scorer = lm.Scorer.__new__(lm.Scorer)
    scorer.model = lm.Model(params or noisy_params(), facts, np.zeros((len(facts.of), 3)), 0, (np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)))
    return scorer


def test_lm_windows_score_each_id_once_and_causally():
    r, facts = np.random.default_rng(4), toy_facts(400)
    scorer = toy_scorer(facts)
    texts = [r.integers(0, 399, n) for n in (1, 23, 24, 25, 200)]
    texts = [np.append(t, 399) for t in texts]

    def run(some):
        return np.stack(scorer.windows(np.concatenate(some), np.cumsum([0, *map(len, some)])), axis=1)

    all_ = run(texts)
    assert len(all_) == sum(map(len, texts)) and (all_[:, 0] < 0).all() and np.isfinite(all_).all()
    assert np.allclose(np.concatenate([run([t]) for t in texts]), all_, atol=1e-4)
    other = texts[-1].copy()
    other[100] = (other[100] + 1) % 250
    assert np.allclose(run([texts[-1]])[:100], run([other])[:100], atol=1e-4)


def test_lm_next_ids_add_up_to_one():
    facts = toy_facts()
    scorer, total = toy_scorer(facts), 0.0
    for c in range(40):
        log, odds = scorer.windows(np.array([6, 9, c]), np.array([0, 3]))
        total += math.exp(log[2]) / (1 + math.exp(-odds[2] if facts.opens[c] else odds[2]))
    assert total == pytest.approx(1, abs=1e-3)


def test_lm_texts_add_up_to_one(monkeypatch):
    """A coder of three ids, "_a", "a" and the end: texts are rows of words a, aa, aaa, ... With all words of up to 14
    letters, two words at most and the end, little is left of one."""
    class Toy(lm.Subwords):
        def __init__(self):
            self.end, self.opens = 2, np.array([True, False, True])
            self.forget()

        def encode(self, some):
            return np.array([i for w in some for i in [0] + [1] * (len(w) - 1)], np.int64), np.array([len(w) for w in some], np.int64)

    coder = Toy()
    single = np.array([[40, 40, 3], [30, 0, 0], [25, 25, 0]], float)
    facts = lm.Facts(single[:, 0], coder.opens)
    pairs = np.zeros((lm.CLASSES, lm.CLASSES))
    pairs[:3, :3] = [[3, 30, 60], [20, 10, 60], [30, 0, 200]]
    facts.learn(pairs, np.random.default_rng(0).random((3, lm.TOPICS)) * 40)
    words = [b"a", b"aa", b"aaaa"]
    head = np.frombuffer(b"".join(words), np.uint8), np.array([1, 2, 4]), np.array([20, 17, 3])
    scorer = lm.Scorer.__new__(lm.Scorer)
    scorer.coder, scorer.model = coder, lm.Model(noisy_params(), facts, single, 25, head)
    scorer.forget()
    texts = [" ".join(t) for k in range(4) for t in itertools.product(["a" * n for n in range(1, 9)], repeat=k)]
    for row, data, offsets in units.texts_of(pa.array(texts)):
        got = scorer.score(data, offsets)[3]
    by_words = Counter()
    for t, x in zip(texts, got):
        by_words[len(t.split())] += 10**x
    whole = sum(by_words.values())
    assert 0.9 < whole <= 1 + 1e-6, by_words


def test_lm_rounds_train_every_text_once():
    first, seen = 0, []
    for parts in lm.ROUNDS:
        seen += range(first, first + parts)
        first += parts
    assert seen == list(range(lm.PARTS))


def test_lm_learns_every_id_of_its_texts():
    facts, r = toy_facts(), np.random.default_rng(3)
    texts = [np.append(r.integers(0, 39, n), 39) for n in (0, 1, 31, 32, 33, 700)]
    learner = lm.Learner(lm.init_params(), facts, lm.RATE)
    learner.texts(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
    learner.close()
    n = sum(map(len, texts))
    assert learner.seen == n == learner.pairs.sum() and learner.sums()[lm.flat_params(learner.params).size] == n
    want = np.zeros((lm.CLASSES, lm.CLASSES))
    for t in texts:
        np.add.at(want, (facts.of[np.append(39, t[:-1])], facts.of[t]), 1)
    assert (learner.pairs.reshape(want.shape) == want).all()


def test_lm_score_has_no_head_of_words(docs, monkeypatch):
    held = F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False))
    want = sorted((r.doc_id or 0, r.n_tokens, round(r.score, 6)) for r in lm.score(docs, held, subword_vocabulary()).collect())
    monkeypatch.setattr(lm, "HEAD_WORDS", 5)
    got = sorted((r.doc_id or 0, r.n_tokens, round(r.score, 6)) for r in lm.score(docs, held, subword_vocabulary()).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=1e-4)


def test_lm_counts_of_long_words(spark):
    """A long word among the most frequent ones keeps its own count."""
    texts = ["donaudampfschifffahrt " * 5 + "the", "the internationalization the", "internationalization a", "the \x00 unknowninallothertexts"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = Counter(w for t in texts[:3] for w in t.split(" "))
    total, kinds = counts.total() + 3, len(counts) + 1
    want = [math.log10(4 / (total + kinds + 1)) + sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in t.split(" ")) for t in texts]
    got = lm.score(docs, F.col("doc_id") == 3, subword_vocabulary()).orderBy("doc_id").collect()
    assert [r.base_score for r in got] == pytest.approx(want)
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(7, 7, total), (4, 4, total), (3, 3, total), (4, 2, total)]


def test_lm_cuts_texts_once(spark, docs):
    """Each text is read and cut into ids once, whatever looks at the ids later."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = docs.select("doc_id", "text")
    assert lm.score(rows.mapInArrow(count, rows.schema), F.lit(False), subword_vocabulary()).count() == rows.count()
    assert seen.value == rows.count()


def test_lm_words_come_back_from_ids():
    with open(subword_vocabulary(), "rb") as f:
        coder = lm.Subwords(f.read())
    texts = ["", " a  bc\tDEF\n", "\u3000 \u3000 x\u3000y \u00a0", "donaudampfschifffahrtsgesellschaft" * 3, "\x00 \U0001f600\u00e9 \ud7ff'll"]
    for _, data, offsets in units.texts_of(pa.array(texts)):
        low = units.lowered(data)
        starts, sizes, at = units.words(low, offsets)
        ids, stops, _ = coder.ids(low, starts, sizes, at)
        got, g_starts, g_sizes, g_at = coder.spell(ids, stops)
        want = [low[a : a + n].tobytes() for a, n in zip(starts, sizes)]
        assert [got[a : a + n].tobytes() for a, n in zip(g_starts, g_sizes)] == want and (g_at == at).all()
        assert sum(map(len, want)) > 100 and len(stops) == len(texts) + 1


def test_lm_halves_of_characters(spark):
    """Words that ids don't give back keep counts of their own."""
    docs = spark.sql("select * from values (1, 'a b'), (2, null) as t(doc_id, text) union all select 3, cast(X'6120EDA080204220EDA081' as string) union all select 4, cast(X'EDA0802061' as string)")
    got = lm.score(docs, F.col("doc_id") == 4, subword_vocabulary()).orderBy("doc_id").collect()
    total, kinds = 4 + 2 + 3, 4 + 1  # a, b and two halves
    one = lambda c: math.log10((c + 1) / (total + kinds + 1))
    want = [one(2) + one(2), 0, one(2) + one(1) + one(2) + one(1), one(1) + one(2)]
    assert [r.base_score for r in got] == pytest.approx([x + one(3) for x in want])
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 3, 9), (1, 1, 9), (5, 5, 9), (3, 3, 9)]


def test_lm_rows(docs, no_docs):
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    got = lm.score(docs, held, subword_vocabulary()).collect()
    texts = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts, n = Counter(), 0
    for i, ws in texts:
        if not out(i):
            counts.update(ws)
            n += 1
    total, kinds = sum(counts.values()) + n, len(counts) + 1
    one = lambda c: math.log10((c + 1) / (total + kinds + 1))
    want = Counter((i, out(i), len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, round(sum(one(counts[w]) for w in ws) + one(n), 6)) for i, ws in texts)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 and r.train_tokens == total for r in got)
    assert lm.score(no_docs, F.lit(False), subword_vocabulary()).count() == 0


def test_digest_columns(docs, library):
    from stackroom.llm.queries import op2_bpe  # noqa: F401

    got = bpe.encode(docs.filter("doc_id = 7"), word_tokenizer()).select(F.sha2("ids", 256).alias("a"), F.sha2("decoded", 256).alias("b")).head()
    ids = library.encode(docs.filter("doc_id = 7").head().text, add_special_tokens=False).ids
    assert got.a == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got.b == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_packing_holds_a_bounded_shard(docs, monkeypatch):
    """Pieces come out long before a task's input ends, a few at a time."""
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("One", (), {"partitionId": staticmethod(lambda: 0)}))}))
    read, n = [], 60_000

    def batches():
        for i in range(100):
            read.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array(["a " * n])], names=["id", "text"])

    run, tokens, first = packing.pack(docs, word_tokenizer()), 0, None
    for batch in run(batches()):
        first = first or len(read)
        tokens += sum(batch.column(2).to_pylist())
        assert sum(map(len, batch.column(3).to_pylist())) <= 4 * 500 * packing.WINDOW
    assert tokens == 100 * (n + 1) and first * n < 5_000_000
