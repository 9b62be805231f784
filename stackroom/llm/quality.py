"""Quality classifier with hierarchical empirical Bayes.

Two logistic models, of low quality and of toxicity, read a document: its words that tell the classes apart, and the
shape of its text. They are fitted on at most MAX_TRAIN labelled documents, chosen by a hash of the id.

Sites come in two levels, host and path. Over all labelled documents, grouped aggregation counts good ones a path and
a host. A host's posterior shrinks towards the global prior and a path's towards its host's, each by a strength of its
own, found by the method of moments: from the spread between hosts, and from that of paths within hosts. So sparse
sites say little. The document's evidence, its log-odds over the global prior, is then added to the log-odds of its
path, or of its host where no document of the path is labelled, or of the prior. A labelled document's own label is
among those of its site.

Defined results: a null text is the empty text. Documents of a null source share one site. Labels that are null, or
of no document, teach nothing; repeated labels of a document count once, by their means. Without labels every
document has score 0.5 and stays. Rows are never dropped here; extra columns stay. An empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, quiet_gc, small_batches, text_or_empty

#: Bounds of the fit: labelled documents, and words in the models.
MAX_TRAIN, MAX_WORDS = 20_000, 2048
#: Fewest training documents that a word of the model is in.
MIN_DOCS = 4
#: Sites up to this many are sent to all tasks; beyond, documents and sites meet by a shuffled join.
SMALL_SITES, SALTS = 20_000, 16
KEEP = 0.5
PREFIXES = (3, 5, 7)
#: A feature of the shape counts as spread out by at least LEAST_SPREAD, and as FAR deviations from the mean at most.
LEAST_SPREAD, FAR = 0.03, 4.0
_LETTERS = re.compile(r"[^\W\d_]+")
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """Per code point: 0 other, 1 lower-case or caseless letter, 2 upper-case letter, 3 digit, 4 white space, 5 usual punctuation."""
    global _kinds
    if _kinds is None:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            s = chr(c)
            table[c] = (2 if s.isupper() else 1) if s.isalpha() else 3 if s.isdigit() else 4 if s.isspace() else 5 if s in ".,;:'\"()-" else 0
        _kinds = table
    return _kinds


def words_of(text: str) -> set[str]:
    """The distinct words, and the beginnings of longer ones, marked by ^: stems tell more than rare words do."""
    words = set(_LETTERS.findall(text.lower()))
    return words | {"^" + w[:n] for n in PREFIXES for w in words if len(w) > n}


def shape(text: str) -> np.ndarray:
    """Numbers about the form of a text, each between 0 and about 1."""
    if not text:
        return np.zeros(9)
    n = np.bincount(kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=6)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    letters = max(1, n[1] + n[2])
    return np.array([
        math.sqrt(n[0] / n.sum()), n[2] / letters, math.sqrt(n[3] / n.sum()), math.sqrt(text.count("|") / n.sum()), math.sqrt(text.count("!") / n.sum()),
        len(set(words)) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines)), math.log1p(len(words)) / 10, min(2.0, letters / max(1, len(words)) / 8),
    ])


def fit_logistic(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, n_words: int, y: np.ndarray, steps: int = 300, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the dense columns, of the words present (row, column), and the intercept; by Adam on the whole sample."""
    n = len(y)
    params = [np.zeros(x.shape[1]), np.zeros(n_words), math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        z = x @ params[0] + np.bincount(rows, params[1][cols], n) + params[2]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grads = [x.T @ error / n + 0.1 * penalty * params[0] / n, np.bincount(cols, error[rows], n_words) / n + penalty * params[1] / n, error.mean()]
        for i, g in enumerate(grads):
            first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - 0.1 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return params[0], params[1], float(params[2])


def labelled(docs: DataFrame, labels: DataFrame, columns: list[Column]) -> DataFrame:
    """Labelled documents with columns, low and toxic (0 to 1)."""
    marks = labels.select(labels["doc_id"].alias("_id"), (1 - F.col("quality")).cast("double").alias("_low"), F.col("toxic").cast("double").alias("_toxic")).dropna()
    marks = marks.groupBy("_id").agg(F.avg("_low").alias("low"), F.avg("_toxic").alias("toxic"))
    return docs.select(docs["doc_id"].alias("_id"), *columns).join(marks, "_id")


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The two document models; None without labelled documents of both classes."""
    small_batches(docs.sparkSession)
    # Ids first, at most MAX_TRAIN of them, so that only their texts move. Of rows that repeat an id the first text counts.
    some = labelled(docs, labels, []).distinct().orderBy(F.xxhash64("_id"), "_id").limit(MAX_TRAIN)
    texts = docs.select(docs["doc_id"].alias("_id"), text_or_empty("text").alias("text")).join(F.broadcast(checkpoint(some)), "_id")
    rows = checkpoint(texts.groupBy("_id", "low", "toxic").agg(F.min("text").alias("text")).select("text", "low", "toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[float]] = {}
        for batch in batches:
            for text, low, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                for w in words_of(text):
                    n = seen.setdefault(w, [0, 0.0, 0.0])
                    n[0] += 1
                    n[1] += low
                    n[2] += toxic
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([n[i] for n in seen.values()], pa.float64()) for i in range(3))], names=["word", "n", "low", "toxic"])

    n, low, toxic = rows.agg(F.count(F.lit(1)), F.avg("low"), F.avg("toxic")).head()
    if not n or (not low and not toxic) or low == 1 or toxic == 1:
        return None
    words = rows.mapInArrow(count, "word string, n double, low double, toxic double").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "low", "toxic")))
    # How far a word's documents are from an average share of each class, in deviations.
    far = lambda c, m: F.abs(F.col(c) - F.col("n") * m) / F.sqrt(F.col("n") * m * (1 - m) + 1e-9)
    words = words.filter(F.col("n") >= MIN_DOCS).withColumn("far", F.greatest(far("low", low), far("toxic", toxic))).filter("far > 4")
    chosen = {r.word: i for i, r in enumerate(words.orderBy(F.round("far", 6).desc(), "word").limit(MAX_WORDS).select("word").collect())}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [np.array([chosen[w] for w in words_of(t) if w in chosen], np.int32).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([shape(t).tobytes() for t in texts], pa.binary()), batch.column(1), batch.column(2)], names=["words", "shape", "low", "toxic"])

    got = rows.mapInArrow(describe, "words binary, shape binary, low double, toxic double").toPandas()
    cols = [np.frombuffer(w, np.int32) for w in got["words"]]
    at, col = np.repeat(np.arange(len(cols)), [len(w) for w in cols]), np.concatenate(cols)
    y, x = got[["low", "toxic"]].to_numpy(), np.array([np.frombuffer(v, np.float64) for v in got["shape"]])
    mean, std = x.mean(0), np.maximum(x.std(0), LEAST_SPREAD)
    heads = [fit_logistic(np.clip((x - mean) / std, -FAR, FAR), at, col, len(chosen), y[:, k]) for k in (0, 1)]
    weights = {w: tuple(float(h[1][i]) for h in heads) for w, i in chosen.items()}
    return {"weights": weights, "shape": [h[0] for h in heads], "intercept": [h[2] for h in heads], "mean": mean, "std": std, "good": float(((1 - y[:, 0]) * (1 - y[:, 1])).mean())}


def chances(model: dict, text: str) -> tuple[float, float]:
    """Probabilities of low quality and of toxicity."""
    found = words_of(text) & model["weights"].keys()
    x = np.clip((shape(text) - model["mean"]) / model["std"], -FAR, FAR)
    z = (float(x @ model["shape"][k]) + sum(model["weights"][w][k] for w in found) + model["intercept"][k] for k in (0, 1))
    low, toxic = (1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z)
    return low, toxic


def host_of(source: Column) -> Column:
    return F.regexp_extract(F.coalesce(source.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1)


def path_of(source: Column) -> Column:
    return F.regexp_extract(F.coalesce(source.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*(?:/[^/?#]*)?)", 1)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def sites(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(path, path_logit) and (host, host_logit) of every labelled path and host, and the global share of good documents."""
    marked = labelled(docs, labels, [host_of(docs["source"]).alias("host"), path_of(docs["source"]).alias("path")])
    good = (1 - F.col("low")) * (1 - F.col("toxic"))
    paths = checkpoint(marked.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(good).alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"), F.sum(F.col("good") ** 2 / F.col("n")).alias("split"), F.sum(F.col("n") ** 2).alias("squares"), F.count(F.lit(1)).alias("parts"))
    hosts = checkpoint(hosts)
    share = F.col("host_good") ** 2 / F.col("host_n")
    t = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good"), F.sum(share).alias("split"), F.sum(F.col("host_n") ** 2).alias("squares"), F.count(F.lit(1)).alias("parts"), F.sum(F.col("split") - share).alias("within"), F.sum(F.col("parts") - 1).alias("free"), F.sum(F.col("host_n") - F.col("squares") / F.col("host_n")).alias("spare")).head()
    m = (t.good + 1) / (t.n + 2) if t.n else 0.5

    def strength(spread: float, free: float, spare: float) -> float:
        """How many documents the level above counts for, by the spread beyond what counting alone gives."""
        between = max(1e-9, (spread - free * m * (1 - m)) / max(1e-9, spare)) if spare > 1e-9 else 1e-9
        return min(1e6, max(2.0, m * (1 - m) / between - 1))

    host_k = strength(t.split - t.good**2 / t.n, t.parts - 1, t.n - t.squares / t.n) if t.n else 2.0
    path_k = strength(t.within, t.free, t.spare) if t.n else 2.0
    hosts = hosts.select("host", ((host_k * m + F.col("host_good")) / (host_k + F.col("host_n"))).alias("h"))
    paths = paths.join(hosts, "host").select("path", logit((path_k * F.col("h") + F.col("good")) / (path_k + F.col("n"))).alias("path_logit"))
    return paths, hosts.select("host", logit(F.col("h")).alias("host_logit")), m


def at_sites(docs: DataFrame, key: Column, table: DataFrame, value: str) -> DataFrame:
    """docs with the table's value for their key. Beyond SMALL_SITES rows both sides are salted, as a site may be hot."""
    spread, (site, salt) = docs, fresh([*docs.columns, value], "site", "salt")
    table = checkpoint(table.toDF(site, value))
    if table.limit(SMALL_SITES + 1).count() <= SMALL_SITES:
        return docs.withColumn(site, key).join(F.broadcast(table), site, "left").drop(site)
    spread = docs.withColumns({site: key, salt: F.floor(F.rand(7) * SALTS).cast("int")})
    table = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(table, [site, salt], "left").drop(site, salt)


def classify(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """docs with p_low, p_toxic, quality_score (posterior of a good document) and kept; columns so named are replaced."""
    spark = docs.sparkSession
    new = ["p_low", "p_toxic", "quality_score", "kept"]
    docs = docs.drop(*new)
    model = fit(docs, labels)
    if model is None:
        return docs.withColumns({"p_low": F.lit(0.5), "p_toxic": F.lit(0.5), "quality_score": F.lit(0.5), "kept": F.lit(True)})
    known = spark.sparkContext.broadcast(model)

    @F.pandas_udf("p_low double, p_toxic double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with quiet_gc():
            for texts in parts:
                yield pd.DataFrame([chances(known.value, t) for t in texts], columns=["p_low", "p_toxic"])

    paths, hosts, prior = sites(docs, labels)
    path, host, found = fresh([*docs.columns, *new], "path_logit", "host_logit", "found")
    out = at_sites(docs, path_of(docs["source"]), paths, path)
    out = at_sites(out, host_of(out["source"]), hosts, host).withColumn(found, judge(text_or_empty("text")))
    fit_prior = math.log(min(1 - 1e-6, max(1e-6, model["good"])) / (1 - min(1 - 1e-6, max(1e-6, model["good"]))))
    p_good = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), (1 - F.col(found)["p_low"]) * (1 - F.col(found)["p_toxic"])))
    z = logit(p_good) - F.lit(fit_prior) + F.coalesce(path, host, F.lit(math.log(prior / (1 - prior))))
    score = 1 / (1 + F.exp(-z))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(found)["p_low"].alias("p_low"), F.col(found)["p_toxic"].alias("p_toxic"), score.alias("quality_score"), (score >= keep).alias("kept"))
