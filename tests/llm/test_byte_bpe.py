"""Byte-level BPE against the tiktoken library: pieces, ids, decoding, odd rows."""

import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stackroom.llm import byte_bpe, queries
from stackroom.llm.queries import subword_vocabulary


@pytest.fixture(scope="module")
def encoder():
    with open(subword_vocabulary(), "rb") as f:
        return byte_bpe.ByteBpe(f.read())


@pytest.fixture(scope="module")
def library():
    with open(subword_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(encoder, texts):
    return [ids[a:b].tolist() for _, ids, at in encoder.encode_column(pa.array(texts, pa.string())) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def test_every_kind_of_piece(encoder, library):
    r = random.Random(5)
    parts = [*"  \n\t'''srtvemldlabz019.,!", "é", "中文", "　", " ", "́", "½", "٣", "😀", "\x1c", "\x85", "'re", "'S", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(4000)]
    texts += ["", " ", "   ", "a" * 63 + "b" * 65, "x" * 30_000, "ab" * 5000 + " " * 700, "'", "''s", "it's'll 've"]
    assert ids_of(encoder, texts) == [library.encode_ordinary(t) for t in texts]
    assert [encoder.decode(x) for x in ids_of(encoder, texts)] == texts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Cn"))), max_size=6))
def test_any_text(encoder, library, texts):
    assert ids_of(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_small_rank_file_with_two_ways_to_cut():
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"aa", b"aaaa"]
    raw = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    made, want = byte_bpe.ByteBpe(raw), tiktoken.Encoding("toy", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    texts = ["abc", "abcabc", "aaaaa", "a" * 200 + "bc", "bcab", "aabaabc" * 30]
    assert ids_of(made, texts) == [want.encode_ordinary(t) for t in texts]


def test_table_of_the_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op13_byte_bpe(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids, r = library.encode_ordinary(d.text or ""), got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_odd_rows(spark, docs, library):
    odd = docs.select("doc_id", "text", *(F.lit(c).alias(c) for c in ("ids", "decoded", "n_tokens", "ID")))
    got = byte_bpe.encode(odd, subword_vocabulary())
    want = sorted((str(r.doc_id), len(library.encode_ordinary(r.text or "")), r.text or "") for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded) for r in got.collect()) == want
    assert byte_bpe.encode(docs.filter("false"), subword_vocabulary()).collect() == []
