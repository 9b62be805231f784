"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece's bytes are its first symbols. The tree's leaves hold `rank * width + position` of each pair of live
neighbours, so its root is the leftmost pair of the lowest rank; a merge changes three leaves, each in logarithmic
time, and the loop ends when no pair has a rank. Here a rank belongs to the joined bytes, so every way to cut a token
in two known halves is a pair, and a piece that is a token itself is taken whole. The trees are those of `bpe`: many
short pieces side by side in numpy, a long one alone.

Texts are cut into pieces in numpy, over all texts of a portion at once, by classes of code points (white space,
letters, numbers, others); this gives the matches of the usual pattern of the rank files:
contractions, ` ?letters`, ` ?numbers`, ` ?others`, white space but its last character before a word, white space.

Defined results: a null text is the empty text, with no ids and an empty decoding. Rows are never dropped or joined,
so null, repeated or tied ids pass through; other columns don't matter. An empty table gives an empty table. Decoding
joins the bytes of the ids, so it gives back the text. Rank files may have up to 65,535 tokens; a larger one is an error.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import KNOWN_PIECES, WordBpe, joined, load_tokenizer
from .common import quiet_gc, small_batches, text_or_empty
from .units import Pool, spans, texts_of

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: Code points with Unicode's White_Space property. Fixed values.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What may follow an apostrophe that opens a piece. Fixed values.
SHORT_ENDS, LONG_ENDS = ("s", "t", "m", "d"), ("re", "ve", "ll")
_MOST_TOKENS = 65_535


def _point_classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = _LETTER if kind == "L" else _NUMBER
    out[list(WHITE)] = _SPACE
    return out


_classes: list[np.ndarray] = []


def point_classes() -> np.ndarray:
    """The class of each code point, made once a process."""
    if not _classes:
        _classes.append(_point_classes())
    return _classes[0]


def characters(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the characters of n bytes of UTF-8 start, and their code points. data has three bytes more at least."""
    starts = np.flatnonzero((data[:n] & 0xC0) != 0x80)
    points = data[starts].astype(np.int32)
    for least, most, size in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0x100, 4)):
        some = np.flatnonzero((points >= least) & (points < most))  # code points so far are first bytes
        some = some[data[starts[some]] == points[some]]
        if len(some):
            at = starts[some]
            value = data[at].astype(np.int32) & (0x7F >> size)
            for k in range(1, size):
                value = value << 6 | data[at + k] & 0x3F
            points[some] = -np.minimum(value, 0x10FFFF)  # negative, so that it isn't taken for a first byte
    return starts, np.abs(points)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes in bytes of the pieces of all rows."""
    n = int(offsets[-1])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, points = characters(data, n)
    if not len(starts):  # broken text without a first byte
        starts, points = np.zeros(1, np.int64), np.full(1, 0xFFFD, np.int32)
    kind, m = point_classes()[points], len(starts)
    opens = np.zeros(m + 1, bool)
    opens[np.searchsorted(starts, offsets)] = True  # a row starts anew
    begins = opens[:m].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    white = np.flatnonzero(kind == _SPACE)
    last = white[~opens[white + 1]]
    last = last[kind[last + 1] != _SPACE]
    begins[last] = True
    begins[last[points[last] == 0x20] + 1] = False  # a space goes with the word behind it
    marks = np.flatnonzero((points == ord("'")) & begins)
    if len(marks):
        room = lambda k: ~opens[np.minimum(marks + 1, m)] & ((k < 2) | ~opens[np.minimum(marks + 2, m)])
        follow = [np.where(room(k), points[np.minimum(marks + k, m - 1)], 0) for k in (1, 2)]
        one = np.isin(follow[0], [ord(c) for c in SHORT_ENDS])
        two = np.logical_or.reduce([(follow[0] == ord(a)) & (follow[1] == ord(b)) for a, b in LONG_ENDS])
        for found, size in ((marks[one], 1), (marks[two], 2)):
            for k in range(1, size + 1):
                begins[found + k] = False
            rest = found + size + 1
            begins[rest[rest < m]] = True
    where = starts[begins]
    where[0] = 0
    return where, np.diff(np.append(where, n))


class ByteBpe(WordBpe):
    """Encoder and decoder for a file of ranks: no word ends, no special tokens, bytes as they are."""

    def __init__(self, raw: bytes):
        ranks: dict[bytes, int] = {}
        for line in raw.splitlines():
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        top = max(ranks.values()) + 1
        if top > _MOST_TOKENS:
            raise ValueError(f"{top} tokens; at most {_MOST_TOKENS} are supported")
        self.ranks_of = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.pairs, made = {}, []  # ranks of pairs are dense: places in made, the ids that pairs give
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            halves = [(ranks[a], ranks[b]) for cut in range(1, len(token)) if (a := token[:cut]) in ranks and (b := token[cut:]) in ranks]
            self.pairs |= {left << 32 | right: (len(made), rank) for left, right in halves}
            made += [rank] * bool(halves)
        self.first = self.last = [ranks[bytes([b])] for b in range(256)]
        self.first_ids = self.last_ids = np.array(self.first, np.int32)
        self.table = self.rank_table()
        self.merged = np.array(made, np.int32)
        self.kind = np.dtype("<u2")
        self.digits, self.names = Pool(np.uint8), Pool(np.uint8)
        for pool, made in ((self.digits, [b"%d " % i for i in range(top)]), (self.names, [self.tokens.get(i, b"") for i in range(top)])):
            pool.add(np.frombuffer(b"".join(made), np.uint8), np.array([len(x) for x in made], np.int32))
        self.forget()

    def learn_pieces(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Remember the ids of new pieces; one that is a token is not merged."""
        whole = np.array([self.ranks_of.get(data[at : at + n].tobytes(), -1) for at, n in zip(starts.tolist(), sizes.tolist())], np.int64)
        counts = np.ones(len(starts), np.int64)
        rest = np.flatnonzero(whole < 0)
        flat, counts[rest] = self.merge_flat(data[spans(starts[rest], sizes[rest])], sizes[rest])
        out, begins = np.zeros(counts.sum(), self.kind), np.cumsum(counts) - counts
        out[begins[whole >= 0]] = whole[whole >= 0]
        out[spans(begins[rest], counts[rest])] = flat
        self.pool.add(out, counts)

    def encode_column(self, column: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets of the rows in them) for runs of rows; with end_id, one closes each row."""
        for row, data, offsets in texts_of(column):
            if len(self.units) > KNOWN_PIECES:
                self.forget()
            starts, sizes = pieces(data, offsets)
            codes, new = self.units.codes(data, starts, sizes)
            self.learn_pieces(data, starts[new], sizes[new])
            ids, counts = self.pool.of(codes)
            at = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[np.searchsorted(starts, offsets)]
            if end_id is not None:
                wide = ids if end_id <= np.iinfo(self.kind).max else ids.astype("<u4")
                ids, at = np.insert(wide, at[1:], end_id), at + np.arange(len(at))
            yield row, ids, at

    def decode(self, ids: list[int]) -> str:
        return self.decoded(np.array(ids, np.int64), np.array([0, len(ids)])).to_pylist()[0]

    def decoded(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The bytes of the ids of each row, as text."""
        flat, sizes = self.names.of(ids)
        stops = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[at]
        return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(stops), pa.py_buffer(flat)])


_built: dict[bytes, ByteBpe] = {}


def worker_bpe(raw: bytes) -> ByteBpe:
    """One encoder per Python worker and file."""
    key = hashlib.sha1(raw).digest()
    if key not in _built:
        _built[key] = ByteBpe(raw)
    return _built[key]


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded) of each row: decimal ids joined by a space, and the text that they decode to.

    Whole texts, one pass, no shuffle. The rank file (under 1 MB, whatever the corpus) is read on the driver alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    raw = load_tokenizer(spark, ranks)
    rows = docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text"))
    names = [id_col, "n_tokens", "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with quiet_gc():
            bpe = worker_bpe(raw.value)
            for batch in batches:
                for row, ids, at in bpe.encode_column(batch.column(1)):
                    some = batch.column(0).slice(row, len(at) - 1)
                    yield pa.RecordBatch.from_arrays([some, pa.array(np.diff(at)), joined(bpe.digits, ids, at).cast(pa.string()), bpe.decoded(ids, at).cast(pa.string())], names=names)

    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids string, decoded string")
