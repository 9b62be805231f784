"""The opN_ queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_bpe, chat, embedding_dedup, exact_dedup, language, lexical, lm, packing, quality, simhash, trie, warc
from .common import doc_hash, small_batches, table, written


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def subword_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, doc_hash(docs["doc_id"], 7) == 2, subword_vocabulary())


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode(table(spark, sf_dir, "documents"), word_tokenizer())
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, folder = warc.archive(table(spark, sf_dir, "pages"))
    got = warc.read(archives, folder, payloads=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", doc_hash(F.col("doc_id"), 4) == 2)
    profiles = language.learn(docs.filter("not held_out"))
    return language.identify(docs, profiles).select("doc_id", "held_out", "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "p_low", "p_toxic", "quality_score", "kept")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.group(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(table(spark, sf_dir, "documents"), words=3, distance=2)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.segments(turns.unionByName(extra)))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return trie.nodes(trie.rebuilt(written(trie.sequences(table(spark, sf_dir, "conversations")))))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = byte_bpe.encode(table(spark, sf_dir, "documents"), subword_vocabulary())
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_bpe, op3_warc, op4_language, op5_quality, op6_exact_dedup, op7_packing, op8_embedding_dedup, op9_simhash, op10_chat, op11_lexical_search, op12_prefix_trie, op13_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": r"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
            g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first_id FROM p)
            SELECT page_id, payload_bytes, sha1(h) AS payload_digest,
                   CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
            FROM g""",
        "op6_exact_dedup": r"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
            g AS (SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM d)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g""",
        "op11_lexical_search": r"""
            WITH found AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
            d AS (SELECT doc_id, terms, len(terms) AS n FROM found WHERE len(terms) > 0),
            total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
            t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM d) GROUP BY ALL),
            q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
            w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(total.docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, total GROUP BY term),
            s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total.terms)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN t USING (term), total GROUP BY ALL)
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
        "op12_prefix_trie": r"""
            WITH t AS (SELECT conv_id, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_id, turn FROM conversations WHERE conv_id IS NOT NULL),
            o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(turn_id, 1, 15)) AS pos FROM t),
            crc AS (SELECT conv_id, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS v FROM (SELECT DISTINCT conv_id FROM t)),
            h AS (SELECT conv_id, xor(v, 4294967295) % 4 AS h FROM crc),
            r AS (SELECT h.conv_id, 0 AS part, pos, turn_id, text FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20 AND o.pos <= h.h UNION ALL SELECT h.conv_id, 1, pos, turn_id, text FROM h JOIN o ON o.conv_id = h.conv_id AND o.pos > h.h),
            s AS (SELECT h.conv_id, coalesce(list(turn_id ORDER BY part, pos) FILTER (turn_id IS NOT NULL), []) AS s, coalesce(list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY part, pos) FILTER (turn_id IS NOT NULL), []) AS w FROM h LEFT JOIN r ON h.conv_id = r.conv_id GROUP BY h.conv_id),
            p AS (SELECT conv_id, d AS depth, s[1:d] AS prefix, w[d] AS words, len(s) = d AS ended FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM s)),
            n AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(words), 0) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM p GROUP BY ALL),
            c AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
            k AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (prefix)),
            a AS (SELECT prefix[1:d] AS prefix, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum(CASE WHEN depth > 0 THEN (n_convs - 1) * words ELSE 0 END) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM k) GROUP BY ALL)
            SELECT k.conv_id, k.depth, up.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
            FROM k JOIN a USING (prefix) LEFT JOIN n up ON k.depth > 0 AND up.prefix = k.prefix[1:k.depth - 1]""",
    }
