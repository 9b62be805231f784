"""Exact, SimHash and embedding dedup, WARC and chat: against brute force and round trips."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stackroom.llm import chat, embedding_dedup, exact_dedup, graph, simhash, units, warc


def groups_of(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_exact_dedup(docs, no_docs):
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup(docs).collect())
    by = defaultdict(list)
    for r in docs.collect():
        by[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0, r.doc_id))
    want = Counter((x[3], min(v)[3], len(v), x[3] == min(v)[3], hashlib.sha256(k.encode()).hexdigest()) for k, v in by.items() for x in v)
    assert got == want and exact_dedup.dedup(no_docs).count() == 0
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == len(by)


def brute_fingerprint(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash(docs, no_docs):
    rows = [(r.doc_id, brute_fingerprint(r.text or "", 3)) for r in docs.collect()]
    at = groups_of(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 2])
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[at[i]] += [d] if d is not None else []
    want = Counter((d, f"{f:016x}", min(least[at[i]], default=None)) for i, (d, f) in enumerate(rows))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.group(docs).collect()) == want
    assert simhash.group(no_docs).count() == 0


@pytest.mark.parametrize("block", [3, 64])
def test_pigeonring_finds_all(spark, block, monkeypatch):
    r = np.random.default_rng(8)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in r.integers(0, 64, (8, 2))]
    fps = sorted({*map(int, base), *near})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    monkeypatch.setattr(graph, "BLOCK", block)
    monkeypatch.setattr(graph.blocks, "__defaults__", (block,))
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {x.node: x.root for x in graph.components(simhash.close_pairs(df, 2)).collect()}
    want = groups_of(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    mine = groups_of(range(len(fps)), [(i, signed.index(got[s])) for i, s in enumerate(signed) if s in got])
    assert mine == want


def test_near_duplicates(docs, no_docs):
    rows = {r.doc_id: set(simhash.shingle_hashes(r.text or "", 5).tolist()) for r in docs.collect() if r.doc_id is not None}
    same = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    ids = sorted(rows)
    want = groups_of(ids, [(a, b) for a in ids for b in ids if b < a and same(rows[a], rows[b])])
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    kept = {r.doc_id for r in left.collect() if r.doc_id is not None}
    missed = {d for d in ids if want[d] != d} & kept
    assert not missed and all(d in kept for d in ids if want[d] == d)
    assert simhash.drop_near_duplicates(no_docs).count() == 0


def true_groups(texts):
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    return groups_of(range(len(sets)), [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b)])


def kept_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}


def test_near_duplicates_behind_false_candidates(spark):
    r = np.random.default_rng(12)
    texts = []
    for f in range(40):
        base = [f"w{f}x{i}" for i in range(400)]
        for v in range(8):
            words = list(base)
            for i in r.choice(400, int(r.integers(3, 6)), replace=False):
                words[i] = f"r{f}v{v}x{i}"
            texts.append(" ".join(words))
    want = true_groups(texts)
    assert kept_of(spark, texts) == {i for i in want if want[i] == i}


def test_near_duplicates_far_in_fingerprint(spark):
    texts = []
    for f in range(12):
        period = [f"p{f}x{i}" for i in range(12)]
        rest = [f"q{f}x{i}" for i in range(200)]
        texts += [" ".join(period * 2 + rest), " ".join(period * 30 + rest)]  # the same shingles, some of them often
    for f in range(150):
        short = [f"s{f}x{i}" for i in range(9)]
        texts += [" ".join(short[:8]), " ".join(short)]  # 4 and 5 shingles: 0.8
    want = true_groups(texts)
    assert sum(want[i] != i for i in want) >= 12 + 150
    assert kept_of(spark, texts) == {i for i in want if want[i] == i}


def test_prefix_loses_no_pair():
    r = np.random.default_rng(8)
    for _ in range(3000):
        n, m = (int(x) for x in r.integers(1, 60, 2))
        both = r.integers(0, 1 << 63, n, dtype=np.uint64)
        x, y = np.unique(both), np.unique(np.concatenate([both[: n - n // 8], r.integers(0, 1 << 63, m // 8, dtype=np.uint64)]))
        common = len(np.intersect1d(x, y))
        if common >= 0.8 * (len(x) + len(y) - common):
            assert set(x[: simhash.prefix_length(len(x), 0.8)]) & set(y[: simhash.prefix_length(len(y), 0.8)])


def test_shingles_equal_one_by_one():
    texts = ["", "a", "A  b", "a b c d e", "A b c d e f g a b c d e", "x" * 40 + " y z " + "é" * 30 + " q r", "a\u00a0b c", "a b c d e"]
    for row, data, offsets in units.texts_of(pa.array(texts)):
        rows, found = units.shingles(units.lowered(data), offsets, 5)
    names = [" ".join(g) for t in texts for ws in [t.lower().encode().decode().split(" ")] for ws in [[w for w in ws if w]] for g in ([ws[i : i + 5] for i in range(len(ws) - 4)] if len(ws) >= 5 else [ws] if ws else [])]
    assert len(names) == len(found) and len(set(names)) == len(set(found.tolist())) == len(set(zip(names, found.tolist())))
    assert Counter(rows.tolist()) == Counter(i for i, t in enumerate(texts) for _ in range(max(min(1, len(t)), len([w for w in t.split(" ") if w]) - 4)))


def test_near_duplicates_of_whole_table(spark):
    """Recall and precision against all pairs that share a shingle, on the documents of sf0.01, by length."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, np.unique(simhash.shingle_hashes(r.text or "", 5))) for r in docs.select("doc_id", "text").collect()]
    where = defaultdict(list)
    for i, (_, s) in enumerate(rows):
        for h in s.tolist():
            where[h].append(i)
    common = Counter(p for some in where.values() if len(some) > 1 for p in itertools.combinations(some, 2))
    true = [(i, j) for (i, j), n in common.items() if n >= 0.8 * (len(rows[i][1]) + len(rows[j][1]) - n)]
    empty = [i for i, (_, s) in enumerate(rows) if not len(s)]
    true += list(zip(empty, empty[1:]))
    got = groups_of(range(len(rows)), true)
    least = {i: min(rows[k][0] for k in got if got[k] == got[i]) for i in set(got.values())}
    want = {rows[i][0] for i in got if least[got[i]] == rows[i][0]}
    assert len(true) > 50 and {r.doc_id for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()} == want


def test_near_duplicates_keep_clashing_columns_and_one_of_repeats(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, text + " x" * (i % 2), "a", "b", "c", "d") for i in (5, 5, 6, 7)] + [(None, None, "a", "b", "c", "d"), (9, "alone here", "k", "l", "m", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, near_key string, NEAR_MORE string, node string, root string")
    left = simhash.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert Counter((r.doc_id, r.near_key) for r in left.collect()) == Counter([(5, "a"), (None, "a"), (9, "k")])


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


@pytest.mark.parametrize("slot", [5, 8192])
def test_embeddings(spark, slot):
    r = np.random.default_rng(6)
    base = r.normal(size=(30, 16))
    v = [*base.tolist(), *(base[:12] + 0.2 * r.normal(size=(12, 16))).tolist(), *base[:5].tolist(), *(3 * base[5:8]).tolist()]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows = [(i, x) for i, x in enumerate([*v, *odd])] + [(3, base[3].tolist()), (None, base[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ok = [x is not None and len(x) == 16 and None not in x and np.isfinite(x).all() and any(x) for _, x in rows]
    u = [np.array(x) / np.linalg.norm(x) if k else None for (_, x), k in zip(rows, ok)]
    links = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and ok[i] and ok[j] and u[i] @ u[j] >= 0.95]
    at = groups_of(range(len(rows)), links)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[at[i]] += [d] if d is not None else []
    n = Counter(i for i, _ in links)
    want = Counter((d, n[i], min(least[at[i]], default=None)) for i, (d, _) in enumerate(rows))
    got = embedding_dedup.group(df, slot=slot)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == want
    assert embedding_dedup.group(df.limit(0)).count() == 0


def test_long_embeddings_have_leading_axes(spark):
    r = np.random.default_rng(9)
    plain = r.normal(size=(20, 768))
    base = r.normal(size=(150, 20)) @ plain + 0.3 * r.normal(size=(150, 768))
    m = np.concatenate([base, base[:60] + 0.9 * r.normal(size=(60, 768)), base[:5]])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(1000, [1.0, 0.0]), (1001, [0.99, 0.01])], "vec_id long, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1)[:, None]
    links = [(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.95)) if i != j]
    at, n = groups_of(range(len(m)), links), Counter(i for i, _ in links)
    least = {}
    for i in range(len(m)):
        least[at[i]] = min(least.get(at[i], i), i)
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.group(df, slot=64).collect()}
    assert len(links) > 50 and got == {i: (n[i], least[at[i]]) for i in range(len(m))} | {1000: (1, 1000), 1001: (1, 1000)}
    q = embedding_dedup.axes(embedding_dedup.units(df, "vec_id", "embedding"))[768]
    assert np.allclose(q.T @ q, np.eye(768), atol=1e-9)
    share = ((u @ q) ** 2).mean(0)
    assert share[:20].sum() > 0.9 and share[:16].sum() > 2 * share[16:].sum()


def test_early_stop_is_exact():
    r = np.random.default_rng(0)
    for dim in (1, 3, 8, 20, 64):
        m = r.normal(size=(300, dim))
        m[150:] = m[:150] + 0.2 * r.normal(size=(150, dim))
        m /= np.linalg.norm(m, axis=1)[:, None]
        q = np.linalg.eigh(m.T @ m)[1][:, ::-1]
        x, y = embedding_dedup.close(m, m, m @ q, m @ q, 0.95)
        assert set(zip(x.tolist(), y.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(m @ m.T >= 0.95))))


def test_warc_round_trip(spark, tmp_path):
    big = "<html>" + "é" * 900 + "</html>"
    rows = [(1, "http://a/x y", big), (2, "http://b", big), (3, None, None), (4, "http://c\r\nWARC-Type: x", "short"), (5, "u", "short"), (2, "http://b", big), (None, "n", "null id"), (6, "d", "z" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    archives, folder = warc.archive(df, str(tmp_path / "w"))
    for split in (97, 1000, 1 << 20):
        got = warc.read(archives, folder, split).collect()
        assert sorted((r.page_id or 0, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to or 0) for r in got) == sorted((p or 0, "revisit" if p == 1 else "response", len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), 2 if p == 1 else 0) for p, _, h in rows)
        assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {h or "" for _, _, h in rows}
    none, where = warc.archive(df.limit(0), str(tmp_path / "n"))
    assert warc.read(none, where).count() == 0


def test_warc_reader_skips_damage_and_nested_archives(tmp_path):

    class File:
        def __init__(self, data):
            self.data = data

        def size(self):
            return len(self.data)

        def read_at(self, n, at):
            return self.data[at : at + n]

    inner = warc.member(warc.record(9, "i", b"inner", None), 0)
    data, at = b"", []
    for i, body in enumerate((b"a", inner * 3, b"c")):
        at.append(len(data))
        data += warc.member(warc.record(i, "u", body, None), len(data))
    for cuts in ([0, len(data)], [0, at[1] + 40, at[2] + 1, len(data)], list(range(0, len(data), 50)) + [len(data)]):
        got = [warc.parse(x)[0]["X-Page-Id"] for a, b in zip(cuts, cuts[1:]) for x in warc.scan(File(data), a, b)]
        assert got == ["0", "1", "2"]
    hurt = data[: at[1] + 30] + b"\xff\xff\xff" + data[at[1] + 33 :]
    assert [warc.parse(x)[0]["X-Page-Id"] for x in warc.scan(File(hurt), 0, len(hurt))][-1] == "2"
    # Strict readers lose nothing in silence, whatever is hurt and wherever ranges are cut.
    for cuts in ([0, len(data)], [0, at[1] + 40, at[2] + 1, len(data)], list(range(0, len(data), 50)) + [len(data)]):
        assert len([x for a, b in zip(cuts, cuts[1:]) for x in warc.scan(File(data), a, b, True)]) == 3
        for bad in (hurt, b"\0" + data[1:], data[: at[2]] + b"\0" + data[at[2] + 1 :], data[:-9], data[: at[1]] + b"junk" + data[at[1] :]):
            with pytest.raises(ValueError):
                [x for a, b in zip(cuts, [*cuts[1:-1], len(bad)]) for x in warc.scan(File(bad), a, b, True)]


def test_warc_groups_beyond_the_small_bound(spark, monkeypatch):
    big = "y" * 1500
    df = spark.createDataFrame([(i, f"u{i}", big if i % 2 else f"{big}{i % 3}") for i in range(30)] + [(50, "u", "small"), (51, "u", "small")], "page_id long, url string, html string")
    want = sorted((r.page_id, r.refers_to) for r in warc.assign(df).collect())
    monkeypatch.setattr(warc, "SMALL_GROUPS", 0)
    assert sorted((r.page_id, r.refers_to) for r in warc.assign(df).collect()) == want


def test_read_back_refuses_other_orders(spark):
    df = spark.createDataFrame([(i, t, "user", "x") for i in range(3) for t in range(4)], "conv_id long, turn long, role string, text string")
    parts = chat.segments(df).cache()
    with pytest.raises(Exception, match="isn't where it belongs"):
        chat.read_back(parts.coalesce(1).sortWithinPartitions(F.desc("position"))).collect()
    again = chat.read_back(parts.repartition("conv_id").sortWithinPartitions("conv_id", "position"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chat.read_back(parts).collect()))


def test_chat_round_trip(spark):
    said = "<|im_end|><|im_start|>assistant ok <\\|x <\\\\| <|"
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u\n"), (1, 2, "assistant", said), (2, 0, "assistant", "out of turn"), (3, 1, "user", None), (3, 0, None, said), (4, 0, "user\n\\n", "x"), (None, 0, "user", "n"), (None, 1, "assistant", ""), (5, 0, "user", "t"), (5, 0, "user", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.segments(df)
    assert parts.filter("loss").count() == 3
    got = {r.conv_id: r for r in chat.read_back(parts).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: True, 5: False}
    assert chat.read_back(chat.segments(df.limit(0))).count() == 0


PLAIN = chat.Template(parts=(("{role}: {text}\n\n", True),), trained=frozenset({"bot"}), order={"": ("me",), "me": ("bot",), "bot": ("me",)}, final=("bot",))
SPLIT = chat.Template(parts=(("<|{role}|>", False), ("[{text}]", True), ("</{role}>\n", False)), trained=frozenset({"bot"}))


@pytest.mark.parametrize("template", [PLAIN, SPLIT])
def test_chat_with_other_templates(spark, template):
    said = "{role}: {text}\n\nme: <|bot|>[x]</bot>\n"
    rows = [(1, 0, "me", "hi"), (1, 1, "bot", said), (2, 0, "a: b\n\\u00003a", "c: d"), (3, 0, None, None), (3, 1, "{text}", "{role}")]
    parts = chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template)
    got = {r.conv_id: r for r in chat.read_back(parts, template).collect()}
    for conv in (1, 2, 3):
        turns = [(r or "", x or "") for c, _, r, x in rows if c == conv]
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
    loss = f"bot: {said}\n\n" if template is PLAIN else f"[{said}]"
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("parts", [(("{role}", False),), (("{text}: {role}", True),), (("{role}{text}", True),), (("{role}x{text}", True),)])
def test_templates_that_cannot_be_read_back(parts):
    with pytest.raises(ValueError):
        chat.Template(parts=parts)


def test_cut_archive_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/ä b?q=50%&x=%20", "one" * 40), (2, "http://a/2", "two" * 40)], "page_id long, url string, html string").coalesce(1)
    archives, folder = warc.archive(df, str(tmp_path / "w"))
    assert {r.url for r in warc.read(archives, folder).collect()} == {"http://a/ä b?q=50%&x=%20", "http://a/2"}
    path = next((tmp_path / "w").glob("*.gz"))
    data = path.read_bytes()
    cut = data.rindex(b"\x1f\x8b\x08\x04")
    path.write_bytes(data[:cut])
    for split in (200, 1 << 20):
        with pytest.raises(Exception, match="bytes, not the"):
            warc.read(archives, folder, split).collect()
    assert warc.read(archives, folder, 200, strict=False).count() == 1


@pytest.mark.parametrize("text", ["<|", "<\\|", "<\\\\|", "a<|im_end|>b", "|<|", "<<||"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
