"""Language-model scoring with a causal self-attention model, trained in numpy on subword ids.

Words (between ASCII white space, A-Z lowered) are cut into ids of a public byte-level BPE vocabulary, each word with
a space before it; one end id closes a text. An id either opens a word (it begins with the space, or is the end) or
goes on with one.

The model. One masked self-attention layer and a hidden layer over the last WINDOW ids give, before each next id, the
log-odds that a word opens (added to those counted after the last id), and the weights of experts. TOPICS experts are
distributions over all ids; the last one goes by the id before, counted between classes of ids. Each expert adds up to
one over the ids that open and over those that go on, so the model adds up to one over all next ids, at a cost that
doesn't depend on the number of ids.

Training. The layers learn by local Adam per task, and the tasks' parameters are averaged; topics learn by expectation
maximization, whose counts, like those between classes, are added up over all tasks. A start on a bounded sample
(START_IDS ids, in one task) tells the topics apart; then every training text trains once, in one of ROUNDS rounds.

The probability of a word is that of its first id, times a mixture: the word's share among the training words that
begin with this id, and the probability of its further ids and that the word then ends. The lexicon's weight is one
less the share of words seen once among those (Good and Turing's estimate of unseen mass). Both parts add up to one
over the words that begin with an id, so a text's score is the log of a probability.

Scoring cuts a text into windows of WINDOW ids that overlap by CONTEXT, and scores each id once, in the window where
it has at least CONTEXT ids before it (or the text's start); windows of many texts make one batch.

One pass over the texts writes their ids to a table and counts their words. What follows reads the ids: words come back
from them by the bytes of the vocabulary.

Also given: the add-one unigram score over whole words. For both, counts of the HEAD_WORDS most frequent words go to
all tasks; the others meet their counts by a shuffled join, so every training word counts.

Defined results: a null text is the empty text, whose one token is its end. Rows are numbered, not keyed, so null or
repeated ids pass through. Ties in frequency go by id or word. Without training texts N = V = 0 and the model is
near uniform. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, quiet_gc, small_batches, text_or_empty, written
from .units import PADDING, Pool, Units, lowered, spans, texts_of, words

#: Classes of ids: the most frequent ids, then all others that open a word, and all others that go on with one.
HEAD = 1022
OPENING, GOING = HEAD, HEAD + 1
CLASSES = HEAD + 2
TOPICS, DIM, HIDDEN = 16, 8, 16
EXPERTS = TOPICS + 1
WINDOW, CONTEXT = 32, 8
#: Windows in a step of Adam, its rate in the start and in the rounds; ids between two sums of pairs.
BATCH, START_RATE, RATE, HELD_IDS = 128, 2e-2, 2e-3, 1 << 19
START_IDS, START_EPOCHS = 600_000, 4
#: Each training text is in one of the rounds: of so many parts of the texts, this many.
ROUNDS, PARTS = (1, 3), 4
#: Weights of what is known without the id before, or the topic.
PAIR_PRIOR, TOPIC_PRIOR = 20.0, 20.0
LEAST_LEXICON, MOST_LEXICON = 0.02, 0.98
HEAD_WORDS = 131_072
#: Words remembered by a worker; numbers in one row of a task's sums.
KNOWN_WORDS, CHUNK = 1_000_000, 1 << 14
_LN10 = math.log(10)
#: What the split pattern of this vocabulary is. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Subwords:
    """Ids of words, remembered by their codes. The end id is the first free one."""

    def __init__(self, raw: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.coder = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)
        self.opens = np.zeros(self.end + 1, bool)
        for token, i in ranks.items():
            self.opens[i] = token.startswith(b" ")
        self.opens[self.end] = True
        self.spelled = Pool(np.uint8)
        tokens = sorted(ranks, key=ranks.get)
        self.spelled.add(np.frombuffer(b"".join(tokens), np.uint8), np.array([*map(len, tokens), 0]))
        self.forget()

    @property
    def kind(self) -> type:
        """Of the numbers that ids are kept as."""
        return np.uint16 if self.end < 1 << 16 else np.uint32

    def forget(self) -> None:
        self.units, self.pool, self.words = Units(), Pool(self.kind), Pool(np.uint8)
        self.pool.add(np.array([self.end]), np.array([1]))  # stretch 0 is the end; a word's is its code plus one

    def encode(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, and their numbers."""
        if not some:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = " " + b" ".join(some).decode("utf-8", "surrogatepass")
        try:
            ids = self.coder.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except UnicodeEncodeError:  # halves of characters
            ids = np.array(self.coder.encode_ordinary(text), np.int64)
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) == len(some):
            return ids, np.diff(starts, append=len(ids))
        if len(some) == 1:  # some other white space inside
            return ids, np.array([len(ids)])
        half = len(some) // 2
        (a, n), (b, m) = self.encode(some[:half]), self.encode(some[half:])
        return np.concatenate([a, b]), np.concatenate([n, m])

    def codes(self, low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of words; ids of the new ones are learned. Also which words were new."""
        codes, new = self.units.codes(low, starts, sizes)
        for at in range(0, len(new), 1 << 14):
            part = new[at : at + (1 << 14)]
            n = sizes[part] + 1
            apart = low[spans(starts[part] - 1, n)]
            apart[np.cumsum(n) - n] = ord(" ")
            self.pool.add(*self.encode(apart.tobytes()[1:].split(b" ")))
        self.words.add(low[spans(starts[new], sizes[new])], sizes[new])
        return codes, new

    def ids(self, low: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts of these words, each closed by the end id; where they stop, from 0 on; codes of the words."""
        codes, _ = self.codes(low, starts, sizes)
        ids, counts = self.pool.of(np.insert(codes + 1, at[1:], 0))
        return ids, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[at + np.arange(len(at))], codes

    def spell(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words of texts given as ids, as by `units.words`: bytes with PADDING, starts, sizes, words before each text."""
        low, sizes = self.spelled.of(ids)
        opened = np.flatnonzero(self.opens[ids])
        stops = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        word = opened[ids[opened] != self.end]
        starts = stops[word] + 1  # behind the space
        ends = stops[opened[np.flatnonzero(ids[opened] != self.end) + 1]]
        return np.concatenate([low, np.zeros(PADDING, np.uint8)]), starts, ends - starts, np.searchsorted(word, at)


def ids_of(column: pa.Array, kind: type, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, offsets of the rows in them) for runs of rows of a column of ids."""
    size = np.dtype(kind).itemsize
    for row, data, offsets in texts_of(column, most):
        yield row, data[:-PADDING].view(kind), offsets // size


_built: dict[int, Subwords] = {}


def worker_subwords(raw: bytes) -> Subwords:
    key = hash(raw)
    if key not in _built:
        _built[key] = Subwords(raw)
    return _built[key]


def init_params(seed: int = 11) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    near = lambda *s: r.normal(0, 1 / math.sqrt(s[0]), s).astype(np.float32)
    return {
        "embed": r.normal(0, 0.5, (CLASSES, DIM)).astype(np.float32),
        "qkv": near(DIM, 3 * DIM),
        "far": np.zeros(WINDOW, np.float32),
        "out": near(DIM, DIM),
        "up": near(DIM, HIDDEN),
        "down": near(HIDDEN, EXPERTS + 1),
        "bias": np.zeros((CLASSES, EXPERTS + 1), np.float32),
    }


class Facts:
    """What is counted: classes of ids, their shares, pairs of classes, topics."""

    def __init__(self, single: np.ndarray, opens: np.ndarray):
        """single: how often each id occurs in the training texts; the last id is the end."""
        end = len(single) - 1
        order = np.lexsort((np.arange(end + 1), -single))
        head = np.sort(np.concatenate([[end], order[order != end][: HEAD - 1]]))
        self.opens, self.of = opens, np.where(opens, OPENING, GOING).astype(np.int32)
        self.of[head] = np.arange(len(head))
        self.class_opens = np.zeros(CLASSES, bool)
        self.class_opens[: len(head)], self.class_opens[OPENING] = opens[head], True
        #: Of an id among its kind, and within its class.
        self.alone, self.share = np.zeros(end + 1), np.ones(end + 1, np.float32)
        for kind in (opens, ~opens):
            self.alone[kind] = (single[kind] + 1) / (single[kind] + 1).sum()
        for c in (OPENING, GOING):
            rest = self.of == c
            self.share[rest] = self.alone[rest] / max(1e-300, self.alone[rest].sum())
        self.class_alone = np.bincount(self.of, self.alone, CLASSES)
        self.learn(np.zeros((CLASSES, CLASSES)), np.zeros((end + 1, TOPICS)))

    def learn(self, pairs: np.ndarray, topics: np.ndarray) -> None:
        """pairs: counts of class after class; topics: counts of id by topic."""
        self.pairs, self.by_id = np.zeros((CLASSES, CLASSES), np.float32), np.zeros((len(self.of), EXPERTS + 1), np.float32)
        self.by_id[:, TOPICS], self.by_id[:, EXPERTS] = self.share, self.opens
        for c, kind in ((self.class_opens, self.opens), (~self.class_opens, ~self.opens)):
            n = pairs[:, c] + PAIR_PRIOR * self.class_alone[c]
            self.pairs[:, c] = n / np.maximum(1e-300, n.sum(1, keepdims=True))
            n = topics[kind] + TOPIC_PRIOR * self.alone[kind, None]
            self.by_id[kind, :TOPICS] = n / n.sum(0)
        opened, gone = pairs[:, self.class_opens].sum(1), pairs[:, ~self.class_opens].sum(1)
        mean = (opened.sum() + 1) / (pairs.sum() + 2)
        self.open_odds = np.log((opened + PAIR_PRIOR * mean) / (gone + PAIR_PRIOR * (1 - mean))).astype(np.float32)

    def part(self, texts: list[tuple[np.ndarray, np.ndarray]], rounds: int = 12, seed: int = 5) -> None:
        """Tell the topics apart: expectation maximization over whole texts, each of one topic, from random shares."""
        text = np.concatenate([np.repeat(np.arange(first, first + len(at) - 1), np.diff(at)) for (_, at), first in zip(texts, np.cumsum([0, *(len(at) - 1 for _, at in texts)]))])
        n_ids, n_texts = len(self.of), sum(len(at) - 1 for _, at in texts)
        pair, times = np.unique(text * n_ids + np.concatenate([ids for ids, _ in texts]), return_counts=True)
        text, ids = np.divmod(pair, n_ids)
        share = np.random.default_rng(seed).dirichlet(np.full(TOPICS, 0.1), n_texts)
        for _ in range(rounds):
            by = np.stack([np.bincount(ids, times * share[text, k], n_ids) for k in range(TOPICS)], axis=1)
            self.learn(np.zeros((CLASSES, CLASSES)), by)
            logs, weight = np.log(self.by_id[:, :TOPICS]), np.log(share.sum(0) + 1)
            z = np.stack([np.bincount(text, times * logs[ids, k], n_texts) for k in range(TOPICS)], axis=1) + weight
            share = np.exp(z - z.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)

    def experts(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Probability of each id among its kind by each expert; last, whether it opens a word. before: the class before."""
        out = np.take(self.by_id, ids, axis=0, mode="clip")
        out[:, TOPICS] *= np.take(self.pairs.ravel(), before * np.int32(CLASSES) + np.take(self.of, ids))
        return out



_gap = np.arange(WINDOW)[:, None] - np.arange(WINDOW)
_causal = _gap >= 0
#: Attention weights are exponentials read off the bits of a float: linear between powers of two, and cheap. They are
#: normalized as they are. Far below, they are zero.
_EXP_SCALE, _EXP_SHIFT = np.float32((1 << 23) / math.log(2)), np.float32(127 * (1 << 23) - 366_000)
#: Bounds of the bits: nothing of what comes later, and something of the position itself, so that weights have a sum.
_most = np.where(_causal, 190 << 23, 0).astype(np.float32)
_least = np.where(_gap == 0, 64 << 23, 0).astype(np.float32)
#: What the gradients of queries, keys and values lack; the queries at hand hold the scale of the exponentials.
_DQKV = np.repeat(np.array([1 / math.sqrt(DIM), 1 / _EXP_SCALE, 1], np.float32), DIM)


def tables(p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the classes: queries, which hold the scale of the exponentials, keys, values; of two positions: what their gap adds."""
    table = p["embed"] @ p["qkv"]
    values = np.concatenate([table[:, 2 * DIM :], np.ones((CLASSES, 1), np.float32)], axis=1)  # the one adds up the weights
    far = (p["far"][np.maximum(_gap, 0)] * _EXP_SCALE + _EXP_SHIFT).astype(np.float32)
    return table[:, :DIM] * (_EXP_SCALE / np.float32(math.sqrt(DIM))), np.ascontiguousarray(table[:, DIM : 2 * DIM]), values, far


def forward(p: dict, x: np.ndarray, first: np.ndarray | None = None, since: int = 0, known: tuple | None = None) -> tuple[np.ndarray, dict]:
    """Log-odds of the experts, and that a word opens, after each of the classes x (n, WINDOW) from position `since` on.

    first: the earliest position of each window that may be attended to; known: the parameters' tables.
    """
    n, m = len(x), WINDOW - since
    q_table, k_table, v_table, far = known or tables(p)
    k, v = np.take(k_table, x, axis=0), np.take(v_table, x, axis=0)
    here = x[:, since:].ravel()
    q = np.take(q_table, here, axis=0).reshape(n, m, DIM)
    s = q @ k.transpose(0, 2, 1)
    s += far[since:]
    low = _least[since:]
    if first is not None and first.any():
        some = np.flatnonzero(first)
        s[some] -= np.where(np.arange(WINDOW) < first[some, None], np.float32(1e12), np.float32(0))[:, None]
    np.minimum(s, _most[since:], out=s)
    a = np.maximum(s, low, out=s).astype(np.int32).view(np.float32)
    mix = (a @ v).reshape(-1, DIM + 1)
    total = mix[:, DIM:]
    mix = mix[:, :DIM] / total
    own = np.take(p["embed"], here, axis=0)
    flat = mix @ p["out"]
    flat += own
    up = flat @ p["up"]
    np.maximum(up, 0, out=up)
    z = up @ p["down"]
    z += np.take(p["bias"], here, axis=0)
    return z, {"q": q, "k": k, "v": v, "a": a, "total": total, "mix": mix, "own": own, "flat": flat, "up": up, "n": n, "m": m}


#: Adds up the experts, but not what stands behind them.
_experts = (np.arange(EXPERTS + 1) < EXPERTS).astype(np.float32)[:, None]


def weights(z: np.ndarray) -> np.ndarray:
    """Of the experts; the last column is of no use."""
    g = np.clip(z, -40, 40)
    np.exp(g, out=g)
    g /= g @ _experts
    return g


#: Where the numbers of a class lie in a flat array of all classes.
_places = {k: np.arange(CLASSES * n).reshape(CLASSES, n) for k, n in (("embed", DIM), ("bias", EXPERTS + 1))}


def gradients(p: dict, facts: Facts, x: np.ndarray, ids: np.ndarray, real: np.ndarray, losses: bool = True) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Of the mean loss over the real positions; the experts' shares in the ids, none in ids that aren't real; the loss,
    if asked for. x: the classes before the ids."""
    z, c = forward(p, x)
    n, m = c["n"], c["m"]
    flat_x, flat_ids, unreal = x.ravel(), ids.ravel(), np.flatnonzero(~real)
    g = weights(z)
    by = facts.experts(flat_x, flat_ids)
    opens = by[:, EXPERTS].copy()
    by *= g
    total = by @ _experts
    by /= total
    chance = 1 / (1 + np.exp(-(z[:, EXPERTS] + np.take(facts.open_odds, flat_x))))
    loss = -float((np.log(total[:, 0]) + np.log(np.where(opens > 0, chance, 1 - chance) + np.float32(1e-30)))[real.ravel()].sum()) if losses else math.nan
    d = g
    d -= by
    np.subtract(chance, opens, out=d[:, EXPERTS])
    d[unreal] = by[unreal] = 0
    out = {"down": c["up"].T @ d}
    du = d @ p["down"].T
    du *= c["up"] > 0
    out["up"] = c["flat"].T @ du
    dh = du @ p["up"].T
    out["out"] = c["mix"].T @ dh
    # The last column of v is one: there goes what the weights' sum takes away.
    beside = np.empty((n * m, DIM + 1), np.float32)
    np.matmul(dh, p["out"].T, out=beside[:, :DIM])
    np.matmul(beside[:, :DIM] * c["mix"], -_experts[:DIM, 0], out=beside[:, DIM])
    beside /= c["total"]
    beside = beside.reshape(n, m, DIM + 1)
    a = c["a"]
    da = beside @ c["v"].transpose(0, 2, 1)
    da *= a
    out["far"] = np.bincount(np.maximum(_gap, 0).ravel(), (da.sum(0) * _causal).ravel(), WINDOW).astype(np.float32)
    dqkv = np.empty((n, m, 3 * DIM), np.float32)
    np.matmul(da, c["k"], out=dqkv[:, :, :DIM])
    np.matmul(da.transpose(0, 2, 1), c["q"], out=dqkv[:, :, DIM : 2 * DIM])
    np.matmul(a.transpose(0, 2, 1), beside[:, :, :DIM], out=dqkv[:, :, 2 * DIM :])
    dqkv = dqkv.reshape(-1, 3 * DIM)
    out["qkv"] = (c["own"].T @ dqkv) * _DQKV
    dh += dqkv @ (p["qkv"] * _DQKV).T
    # By class: what reaches its embedding, and its bias.
    for name, rows in (("embed", dh), ("bias", d)):
        out[name] = np.zeros(p[name].shape, np.float32)
        np.add.at(out[name].ravel(), np.take(_places[name], flat_x, axis=0).ravel(), rows.astype(np.float32, copy=False).ravel())
    each = np.float32(1 / max(1, n * m - len(unreal)))
    return {k: x * each for k, x in out.items()}, by, loss


class Adam:
    """Changes numbers in place."""

    def __init__(self, size: int, rate: float):
        self.t, self.rate = 0, rate
        self.m, self.v, self.x = (np.zeros(size, np.float32) for _ in range(3))

    def step(self, params: np.ndarray, grads: np.ndarray) -> None:
        self.t += 1
        size = np.float32(self.rate * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        m, v, x = self.m, self.v, self.x
        np.subtract(grads, m, out=x)
        x *= np.float32(0.1)
        m += x
        np.multiply(grads, grads, out=x)
        x -= v
        x *= np.float32(0.01)
        v += x
        np.sqrt(v, out=x)
        x += np.float32(1e-7)
        np.divide(m, x, out=x)
        x *= size
        params -= x


class Learner:
    """Trains on windows of texts and sums up what is counted on the way."""

    def __init__(self, params: dict, facts: Facts, rate: float):
        self.flat = flat_params(params)
        self.params, self.facts, self.adam = shaped_params(self.flat), facts, Adam(len(self.flat), rate)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.ids_held, self.seen = 0, 0
        self.pairs, self.topics = np.zeros(CLASSES * CLASSES), np.zeros(len(facts.of) * TOPICS)
        self.met: list[np.ndarray] = []

    def texts(self, ids: np.ndarray, at: np.ndarray) -> None:
        """ids of texts, each closed by its end."""
        sizes = np.diff(at)
        counts = -(-sizes // WINDOW)
        starts = spans(np.zeros(len(sizes), np.int64), counts) * WINDOW
        lengths = np.minimum(np.repeat(sizes, counts) - starts, WINDOW)
        place = (np.repeat(at[:-1], counts) + starts)[:, None] + np.arange(WINDOW)
        real = np.arange(WINDOW) < lengths[:, None]
        ids = ids.astype(np.int32)
        before = np.concatenate([[len(self.facts.of) - 1], ids[:-1]])  # a text's end is also the next one's start
        place = np.minimum(place, len(ids) - 1)
        x, y = self.facts.of[before[place]], ids[place]
        self.held.append((x, y, real))
        self.ids_held += len(x)
        if self.ids_held >= BATCH:
            self.learn(BATCH)

    def learn(self, most: int) -> None:
        x, ids, real = (np.concatenate(c) for c in zip(*self.held)) if self.held else (np.zeros((0, WINDOW), np.int32),) * 3
        stop = len(x) // most * most if most > 1 else len(x)
        for a in range(0, stop, BATCH):
            b = min(a + BATCH, stop)
            grads, by, _ = gradients(self.params, self.facts, x[a:b], ids[a:b], real[a:b], losses=False)
            self.adam.step(self.flat, flat_params(grads))
            place = np.repeat(ids[a:b].astype(np.int64) * TOPICS, TOPICS).reshape(-1, TOPICS)
            place += np.arange(TOPICS)
            np.add.at(self.topics, place.ravel(), by[:, :TOPICS].astype(np.float64).ravel())
            self.met.append((x[a:b] * np.int32(CLASSES) + np.take(self.facts.of, ids[a:b]))[real[a:b]])
            self.seen += len(self.met[-1])
            if len(self.met) * BATCH * WINDOW >= HELD_IDS:
                self.count()
        self.held, self.ids_held = [(x[stop:], ids[stop:], real[stop:])], len(x) - stop

    def count(self) -> None:
        if self.met:
            self.pairs += np.bincount(np.concatenate(self.met), minlength=CLASSES * CLASSES)
            self.met = []

    def close(self) -> None:
        self.learn(1)
        self.count()

    def sums(self) -> np.ndarray:
        """Parameters times ids, ids, pairs, topics: all can be added up over tasks."""
        return np.concatenate([self.flat.astype(np.float64) * self.seen, [self.seen], self.pairs, self.topics])


def flat_params(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def shaped_params(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views, if the numbers are 32 bits wide."""
    out, at = {}, 0
    for k, v in sorted(init_params().items()):
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32, copy=False)
        at += v.size
    return out


def parted(sums: np.ndarray, params: dict) -> tuple[dict, np.ndarray, np.ndarray]:
    """Averaged parameters, pairs, topics. Without any id, the parameters as they were."""
    n = flat_params(params).size
    flat, seen = sums[:n], sums[n]
    at = n + 1 + CLASSES * CLASSES
    return (shaped_params(flat / seen) if seen else params), sums[n + 1 : at].reshape(CLASSES, CLASSES), sums[at:].reshape(-1, TOPICS)


def summed(rows: DataFrame, size: int, tasks: int) -> np.ndarray:
    """The sum of the tasks' vectors of this size, in rows (chunk, x) of doubles: one bounded vector reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(x, np.float64)
                total[chunk] = total[chunk] + x if chunk in total else x
        yield chunks_of(total)

    # Twice: first over some tasks' vectors, then over these sums.
    some = rows.repartition(max(1, tasks), "chunk", F.pmod("task", F.lit(64))).mapInArrow(add, "chunk int, x binary")
    out = np.zeros(size)
    for r in some.repartition(max(1, tasks), "chunk").mapInArrow(add, "chunk int, x binary").collect():
        out[r.chunk * CHUNK : r.chunk * CHUNK + len(r.x) // 8] = np.frombuffer(bytes(r.x), np.float64)
    return out


def chunks_of(total: dict[int, np.ndarray], **more) -> pa.RecordBatch:
    cols = [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())]
    names = ["chunk", "x"]
    for name, value in more.items():
        cols.append(pa.array([value] * len(total), pa.int32()))
        names.append(name)
    return pa.RecordBatch.from_arrays(cols, names=names)


def started(texts: Iterator[tuple[np.ndarray, np.ndarray]], params: dict, facts: Facts) -> Learner:
    """A learner after START_EPOCHS epochs over the first START_IDS ids; facts change."""
    held, n = [], 0
    for ids, at in texts:
        stop = max(1, int(np.searchsorted(at, START_IDS - n)))  # whole texts, but for one too long
        held.append((ids[: at[stop]][: 2 * START_IDS], np.minimum(at[: stop + 1], 2 * START_IDS)) if stop < len(at) else (ids, at))
        n += len(held[-1][0])
        if n >= START_IDS:
            break
    learner = Learner(params, facts, START_RATE)
    if held:
        facts.part(held)
    for k in range(START_EPOCHS if held else 0):
        learner = Learner(learner.params, facts, START_RATE / (1 + k))
        for ids, at in held:
            learner.texts(ids, at)
        learner.close()
        facts.learn(learner.pairs.reshape(CLASSES, CLASSES), learner.topics.reshape(-1, TOPICS))
    return learner


def learned(texts: DataFrame, kind: type, params: dict, facts: Facts, start: bool = False) -> np.ndarray:
    """The sums of all tasks' learners over the texts. start: of one task, which learns START_IDS ids again and again."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((params, facts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, facts = shared.value
        with quiet_gc():
            some = (part for batch in batches for _, *part in ids_of(batch.column(0), kind))
            if start:
                learner = started(some, params, facts)
            else:
                learner = Learner(params, facts, RATE)
                for ids, at in some:
                    learner.texts(ids, at)
                learner.close()
        sums = learner.sums()
        if learner.seen:
            yield chunks_of({i: sums[at : at + CHUNK] for i, at in enumerate(range(0, len(sums), CHUNK))}, task=TaskContext.get().partitionId())

    size = flat_params(params).size + 1 + CLASSES * CLASSES + len(facts.of) * TOPICS
    rows = texts.select("ids").mapInArrow(run, "chunk int, x binary, task int")
    return summed(rows, size, min(-(-size // CHUNK), int(spark.conf.get("spark.sql.shuffle.partitions"))))


def train(texts: DataFrame, n_texts: int, kind: type, single: np.ndarray, opens: np.ndarray) -> tuple[dict, Facts]:
    """texts: (ids, hash) of the training rows; single: counts of their ids."""
    params, facts = init_params(), Facts(single, opens)
    if not n_texts:
        return params, facts
    # The start: texts by their hash, so many that they hold more than enough ids. All tasks look for them; one gets
    # what they found, of a size that START_IDS bounds, in an order of its own.
    mean = max(1.0, single.sum() / n_texts)
    share = min(1.0, 2 * START_IDS / mean / n_texts)
    chosen = F.pmod(F.xxhash64("hash"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))
    some = texts.filter(chosen).repartition(1).sortWithinPartitions(F.xxhash64("hash"))
    params, pairs, topics = parted(learned(some, kind, params, facts, start=True), params)
    facts.learn(pairs, topics)
    pairs, topics, first = np.zeros_like(pairs), np.zeros_like(topics), 0
    for parts in ROUNDS:
        part = F.col("hash") % F.lit(PARTS)
        params, p, t = parted(learned(texts.filter((part >= first) & (part < first + parts)), kind, params, facts), params)
        pairs, topics, first = pairs + p, topics + t, first + parts
        facts.learn(pairs, topics)
    return params, facts


def tokenized(rows: DataFrame, raw: Broadcast) -> DataFrame:
    """One pass over (id, text, held_out, hash) gives two kinds of rows. Of each text: id, held_out, hash, its ids, and
    its lowered bytes where the ids don't give them back (halves of characters). Of each task: (word, n), counts in its
    training texts; the empty word counts these texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, counts, trained, id_type = worker_subwords(raw.value), np.zeros(0, np.int64), 0, None

        def out(**columns: pa.Array) -> pa.RecordBatch:
            """Rows with these columns; the others are null."""
            kinds = {"id": id_type, "held_out": pa.bool_(), "hash": pa.int64(), "ids": pa.binary(), "low": pa.binary(), "word": pa.binary(), "n": pa.int64()}
            size = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(size, kind) for k, kind in kinds.items()], names=list(kinds))

        def counted() -> pa.RecordBatch:
            some = np.flatnonzero(counts)
            return out(word=binaries(*coder.words.of(some)), n=pa.array(counts[some]))

        with quiet_gc():
            for batch in batches:
                id_type = batch.schema.field(0).type
                for row, data, offsets in texts_of(batch.column(1)):
                    if len(coder.units) > KNOWN_WORDS:
                        yield counted()
                        counts = np.zeros(0, np.int64)
                        coder.forget()
                    low = lowered(data)
                    starts, sizes, at = words(low, offsets)
                    ids, stops, codes = coder.ids(low, starts, sizes, at)
                    part = batch.slice(row, len(offsets) - 1)
                    trains = part.column(2).fill_null(True).to_numpy(zero_copy_only=False) == 0
                    more = np.bincount(codes[np.repeat(trains, np.diff(at))], minlength=len(coder.units))
                    more[: len(counts)] += counts
                    counts, trained = more, trained + int(trains.sum())
                    odd = np.flatnonzero((low[:-1] == 0xED) & (low[1:] >= 0xA0))
                    lost = np.isin(np.arange(len(part)), np.searchsorted(offsets, odd, "right") - 1) if len(odd) else np.zeros(len(part), bool)
                    kept = pa.array([low[a:b].tobytes() if x else None for x, a, b in zip(lost, offsets, offsets[1:])] if len(odd) else [None] * len(part), pa.binary())
                    yield out(id=part.column(0), held_out=part.column(2), hash=part.column(3), ids=binaries(ids.view(np.uint8), np.diff(stops) * ids.itemsize), low=kept)
            if id_type is not None:
                yield counted()
                yield out(word=pa.array([b""], pa.binary()), n=pa.array([trained]))

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, hash long, ids binary, low binary, word binary, n long")


def binaries(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def id_counts(counted: DataFrame, raw: Broadcast, end: int) -> np.ndarray:
    """(ids, 3): how often each id occurs, opens a word, opens a word seen once; from counted words.

    A row per id of the vocabulary at most reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, single = worker_subwords(raw.value), np.zeros((end + 1, 3), np.int64)
        for batch in batches:
            (ids, sizes), n = coder.encode(batch.column(0).to_pylist()), batch.column(1).to_numpy()
            first = ids[np.cumsum(sizes) - sizes]
            for k, (some, x) in enumerate(((ids, np.repeat(n, sizes)), (first, n), (first, n == 1))):
                single[:, k] += np.bincount(some, x, end + 1).astype(np.int64)
        at = np.flatnonzero(single[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(single[at, k]) for k in range(3))], names=["id", "n", "first", "once"])

    out = np.zeros((end + 1, 3))
    for r in counted.filter("word <> X''").mapInArrow(run, "id long, n long, first long, once long").groupBy("id").agg(*(F.sum(c).alias(c) for c in ("n", "first", "once"))).collect():
        out[r.id] = r.n, r.first, r.once
    return out


class Model:
    """All that scoring needs, of a size that doesn't grow with the corpus."""

    def __init__(self, params: dict, facts: Facts, single: np.ndarray, n_train: int, head: tuple[np.ndarray, np.ndarray, np.ndarray]):
        """single: as of `id_counts`."""
        self.params, self.facts, self.n_train = params, facts, n_train
        #: By first id: the lexicon's weight, and that weight over the number of training words that begin so.
        self.lexicon = np.where(single[:, 1] > 0, np.clip(1 - single[:, 2] / np.maximum(1, single[:, 1]), LEAST_LEXICON, MOST_LEXICON), 0.0)
        self.each = self.lexicon / np.maximum(1, single[:, 1])
        self.head = head  # bytes end to end, sizes, counts


def log_one_plus(odds: np.ndarray) -> np.ndarray:
    """Log of one plus the exponential."""
    return np.maximum(odds, 0) + np.log(1 + np.exp(-np.abs(odds)))


class Scorer:
    """A worker's: ids and counts of the words it knows, and batches of windows."""

    def __init__(self, coder: Subwords, model: Model):
        self.coder, self.model = coder, model
        self.forget()

    def forget(self) -> None:
        """Know the most frequent training words only."""
        flat, sizes, counts = self.model.head
        self.units = Units()
        codes, _ = self.units.codes(np.concatenate([flat, np.zeros(PADDING, np.uint8)]), np.cumsum(sizes) - sizes, sizes)
        self.counts = np.empty(len(counts))
        self.counts[codes] = counts  # long words have later codes than short ones, whatever their counts

    def windows(self, ids: np.ndarray, at: np.ndarray, batch: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Of each id: log of its probability among its kind, and log-odds that a word opens there."""
        facts, step = self.model.facts, WINDOW - CONTEXT
        sizes = np.diff(at)
        counts = -(-sizes // step)
        starts = spans(np.zeros(len(sizes), np.int64), counts) * step
        left = np.minimum(np.repeat(sizes, counts) - starts, step)
        place = np.repeat(at[:-1], counts) + starts
        first = np.where(starts == 0, CONTEXT, 0)
        line = np.concatenate([np.full(CONTEXT + 1, len(facts.of) - 1), ids, np.zeros(step, np.int64)])
        seen, then = (np.lib.stride_tricks.sliding_window_view(c, m) for c, m in ((facts.of[line], WINDOW), (line[CONTEXT + 1 :], step)))
        log, odds, done, known = np.empty(len(ids), np.float32), np.empty(len(ids), np.float32), 0, tables(self.model.params)
        for a in range(0, len(place), batch):
            some, n = place[a : a + batch], left[a : a + batch]
            x = seen[some]
            z, _ = forward(self.model.params, x, first[a : a + batch], CONTEXT, known)
            before, g = x[:, CONTEXT:].ravel(), weights(z)
            g *= facts.experts(before, then[some].ravel())
            # The windows' own positions follow each other as the ids do.
            real = (np.arange(step) < n[:, None]).ravel()
            to = slice(done, done + int(n.sum()))
            log[to] = np.log(g @ _experts)[real, 0]
            odds[to] = (z[:, EXPERTS] + np.take(facts.open_odds, before))[real]
            done = to.stop
        return log, odds

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of texts, see `rate`."""
        low = lowered(data)
        found = words(low, offsets)
        ids, stops, _ = self.coder.ids(low, *found)
        return self.rate(ids, stops, low, *found)

    def rate(self, ids: np.ndarray, stops: np.ndarray, low: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, known common tokens, logs of their counts plus one, score without the counts of words
        that are not common; then those words: how many a text has, where they lie, their bytes, and the log10 of what
        their probability without a count is in shares of the lexicon."""
        m = self.model
        codes = self.units.find(low, starts, sizes)
        opened = np.flatnonzero(self.coder.opens[ids])
        begins = ids[opened]
        word_at = at + np.arange(len(at))
        log, odds = self.windows(ids, stops)
        first, is_end = log[opened].astype(np.float64), begins == self.coder.end
        further = log - log_one_plus(odds)
        further[opened] = 0
        after = np.flatnonzero(~is_end)
        spelled = np.add.reduceat(further, opened).astype(np.float64)
        spelled[after] -= log_one_plus(-odds[opened[after + 1]])  # the word ends: another one opens, or the text does
        n = np.where(is_end, m.n_train, 0).astype(np.float64)
        common = np.zeros(len(opened), bool)
        common[after] = codes >= 0
        n[common] = self.counts[codes[codes >= 0]]
        with np.errstate(divide="ignore"):
            rest = np.log(1 - m.lexicon[begins]) + spelled
            each = np.log(m.each[begins])
            total = np.where(is_end, first, first + np.logaddexp(each + np.log(n), rest)) / _LN10
            ratio = np.maximum(rest - each, -1e4) / _LN10
        rows = word_at[:-1]
        rare = np.flatnonzero(~common & ~is_end)
        lies = np.searchsorted(after, rare)
        return np.diff(word_at), np.add.reduceat(n > 0, rows, dtype=np.int64), np.add.reduceat(np.log10(n + 1), rows), np.add.reduceat(total, rows), np.searchsorted(rare, word_at), low[spans(starts[lies], sizes[lies])], sizes[lies], np.minimum(ratio[rare], 1e4)

    def rate_ids(self, ids: np.ndarray, stops: np.ndarray, lost: pa.Array) -> tuple[np.ndarray, ...]:
        """Of texts given as ids. lost: the lowered bytes of those that the ids don't give back."""
        low, starts, sizes, at = self.coder.spell(ids, stops)
        for i in [i for i, x in enumerate(lost) if x.is_valid] if lost.null_count < len(lost) else ():
            raw = np.frombuffer(lost[i].as_py(), np.uint8)
            own, some, _ = words(raw, np.array([0, len(raw)]))
            starts[at[i] : at[i + 1]], sizes[at[i] : at[i + 1]] = own + len(low) - PADDING, some
            low = np.concatenate([low[:-PADDING], raw, low[-PADDING:]])
        return self.rate(ids, stops, low, starts, sizes, at)


_scorers: dict[str, Scorer] = {}


def head_words(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, sizes and counts of the most frequent words, at most so many; rarer ones never reach the driver."""
    level = F.floor(F.log2("n") * 32).cast("int")  # some hundred levels, whatever the corpus
    real = counted.filter("word <> X''").withColumn("level", level)
    held, least = 0, None
    for r in sorted(real.groupBy("level").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r.level):
        if held + r.words > most:
            break
        held, least = held + r.words, r.level
    if least is None:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = real.filter(F.col("level") >= least).select("word", "n").toArrow().combine_chunks().sort_by([("n", "descending"), ("word", "ascending")])
    some = got.column("word").to_pylist()
    return np.frombuffer(b"".join(some), np.uint8), np.array([len(w) for w in some], np.int64), got.column("n").to_numpy()


def score(docs: DataFrame, held_out, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row. held_out: a boolean column."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    coder = worker_subwords(raw.value)
    rows = docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text"), held_out.alias("held_out"), F.pmod(F.xxhash64(docs[id_col], text_or_empty(text_col)), F.lit(1 << 30)).alias("hash"))
    cut = written(tokenized(rows, raw))
    texts = cut.filter("hash is not null and not held_out").select("ids", "hash")
    counted = checkpoint(cut.filter("n is not null").groupBy("word").agg(F.sum("n").alias("n")))
    n_words, distinct, n_train = counted.agg(*(F.coalesce(F.sum(F.expr(x)), F.lit(0)) for x in ("if(word <> X'', n, 0)", "if(word <> X'', 1, 0)", "if(word = X'', n, 0)"))).head()
    total, kinds = n_words + n_train, distinct + (1 if n_train else 0)
    single = id_counts(counted, raw, coder.end)
    single[coder.end] = n_train, n_train, 0
    params, facts = train(texts, n_train, coder.kind, single[:, 0], coder.opens)
    model = spark.sparkContext.broadcast(Model(params, facts, single, n_train, head_words(counted, HEAD_WORDS)))
    key = f"{spark.sparkContext.applicationId}-{id(model)}"
    names = ["row", "id", "held_out", "n_tokens", "known", "logs", "score", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(worker_subwords(raw.value), model.value)
        scorer, row = _scorers[key], TaskContext.get().partitionId() << 33
        with quiet_gc():
            for batch in batches:
                for at, ids, offsets in ids_of(batch.column(1), scorer.coder.kind):
                    part = batch.slice(at, len(offsets) - 1)
                    n, known, logs, scores, stops, flat, sizes, ratio = scorer.rate_ids(ids, offsets, part.column(3))
                    rare = pa.StructArray.from_arrays([binaries(flat, sizes), pa.array(ratio.astype(np.float32))], ["word", "x"])
                    cols = [pa.array(np.arange(row, row + len(n))), part.column(0), part.column(2), pa.array(n), pa.array(known), pa.array(logs), pa.array(scores), pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), rare)]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    row += len(n)

    kind = docs.schema[id_col].dataType.simpleString()
    scored = written(cut.filter("hash is not null").select("id", "ids", "held_out", "low").mapInArrow(run, f"row long, id {kind}, held_out boolean, n_tokens long, known long, logs double, score double, rare array<struct<word:binary,x:float>>"))
    rare = scored.select("row", F.explode("rare").alias("w")).select("row", "w.word", F.col("w.x").cast("double").alias("x"))
    # What the lexicon adds to the log of the rest: the log of one plus its share over the rest's.
    odds = F.log10("n") - F.col("x")
    gain = F.when(odds > 300, odds).otherwise(F.log10(F.lit(1.0) + F.pow(F.lit(10.0), F.least(odds, F.lit(300.0)))))
    found = rare.join(counted.filter("word <> X''"), "word").groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs"), F.sum(gain).alias("gain"))
    out = scored.drop("rare").join(found, "row", "left")
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(total + 1 * (kinds + 1)))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"))
