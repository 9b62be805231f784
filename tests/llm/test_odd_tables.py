"""All operators and stages on one odd table: nulls, ties, repeated rows, long texts, clashing column names; and the
opN_ functions against their contracts' columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stackroom.llm import bpe, exact_dedup, language, lm, packing, quality, queries, simhash
from stackroom.llm.queries import subword_vocabulary, word_tokenizer

CLASHES = ["_id", "_sha256", "_place", "row_id", "row_sha", "_path", "_p", "path_logit", "host_logit", "site", "salt", "found", "_found", "_gone", "near_key", "NEAR_MORE", "node", "root", "key", "more", "fp", "set", "held_out", "word", "n", "low", "toxic", "digest", "body", "row"]


@pytest.fixture(scope="module")
def odd(docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars").withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce("text", F.lit("-")).substr(1, 3)) for c in CLASHES}).cache()


def as_rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_filters_keep_the_columns(spark, odd, tmp_path):
    labels = odd.filter("doc_id is not null").select("doc_id", F.lit(1).alias("quality"), F.when(F.col("doc_id") % 5 == 1, 1).otherwise(0).alias("toxic"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    whole = set(as_rows(odd, odd.columns))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns, name
        assert set(as_rows(out, odd.columns)) <= whole, name
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, str(tmp_path))
    assert packed.agg(F.sum("length")).head()[0] > 0


def test_operators_do_not_mind_the_columns(spark, odd):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    held = lambda d: F.coalesce(d["doc_id"] % 7 == 2, F.lit(False))
    labels = plain.filter("doc_id is not null").select("doc_id", F.lit(1).alias("quality"), F.when(F.col("doc_id") % 5 == 1, 1).otherwise(0).alias("toxic"))
    runs = {
        "bpe": lambda d: bpe.encode(d, word_tokenizer()),
        "language": lambda d: language.identify(d, language.learn(d)).select("doc_id", "lang_pred", "score"),
        "quality": lambda d: quality.classify(d, labels).select("doc_id", F.round("quality_score", 6).alias("s"), "kept"),
        "exact": exact_dedup.dedup,
        "packing": lambda d: packing.pack(d, word_tokenizer()).groupBy("doc_id").agg(F.sum("length").alias("n")),
        "simhash": simhash.group,
        "lm": lambda d: lm.score(d, held(d), subword_vocabulary()).select("doc_id", "n_tokens", F.round("base_score", 6).alias("b")),
    }
    for name, run in runs.items():
        a, b = run(odd), run(plain)
        assert a.columns == b.columns and as_rows(a, a.columns) == as_rows(b, b.columns), name


WANT = {
    "op1_lm_score": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op2_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op3_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op4_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_quality": {"doc_id": "bigint"},
    "op6_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op7_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8_embedding_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_chat": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
}


@pytest.mark.parametrize("name", WANT)
def test_queries_meet_their_contracts(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir)
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c in WANT[name]} == WANT[name]
    key = next(iter(WANT[name]))
    table = {"op3_warc": "pages", "op8_embedding_dedup": "embeddings", "op10_chat": "conversations"}.get(name, "documents")
    want = {r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect()}
    got = got.collect()
    assert {r[0] for r in got} == want | ({-1} if name == "op10_chat" else set())
    if name == "op4_language":
        lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
        held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and lang[r.doc_id] is not None and r.lang_pred != "und"]
        assert held and sum(held) / len(held) > 0.9
    if name == "op10_chat":
        said = "<|im_end|><|im_start|>assistant ok"
        r = next(r for r in got if r.conv_id == -1)
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
