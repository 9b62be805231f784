"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The tree's leaves hold `rank * width + position` of each pair of neighbours, so its root is the leftmost pair of
the lowest rank. A merge changes three leaves; the loop ends when the root holds no mergeable pair. Pieces repeat,
so each worker remembers the ids of those it met (up to KNOWN_PIECES, then it starts anew).

Texts are cut into pieces in numpy, over all texts of a portion at once: runs of letters, single digits, runs of
other characters. Words that need more than a table of two-byte characters (accents to be composed, contractions,
special tokens, rare scripts) are taken whole and cut by the tokenizer's own pattern when they are first met.

Defined results: a null text is the empty text, with no ids and an empty decoding. Rows are never dropped or joined,
so null, repeated or tied ids pass through. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .common import quiet_gc, small_batches, text_or_empty
from .units import PADDING, SPACES, Pool, Units, spans, texts_of

#: Pieces remembered by a worker, of some 40 bytes each.
KNOWN_PIECES = 1 << 19
#: Pieces of up to so many symbols are merged side by side, in trees of as many leaves; longer ones alone.
WIDTHS = (8, 16, 32, 64)
#: Trees held in memory at once.
BLOCK = 32_768
_PAD, _NONE = 65_535, 1 << 30
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Classes of bytes.
_GAP, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_MULTIPLIER, _RANK_BITS, _TABLE_BITS = np.uint64(0x9E3779B97F4A7C15), 17, 19


def _byte_classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[list(SPACES)] = _GAP
    for first, last in ("az", "AZ"):
        out[ord(first) : ord(last) + 1] = _LETTER
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[ord("'")] = _ODD  # may open a contraction
    out[128:] = _ODD  # but for what _two_byte_letters has
    return out


def _two_byte_letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point below 0x800: is it a letter that no normalization changes, and its lower case in two bytes too?"""
    plain, low = np.zeros(0x800, bool), np.arange(0x800, dtype=np.uint16)
    for c in range(0x80, 0x800):
        s = chr(c)
        if unicodedata.category(s)[0] == "L" and unicodedata.normalize("NFC", s) == s and len(s.lower()) == 1 and 0x80 <= ord(s.lower()) < 0x800:
            plain[c], low[c] = True, ord(s.lower())
    return plain, low


_CLASS, (_PLAIN, _LOW) = _byte_classes(), _two_byte_letters()
_ASCII_LOW = np.arange(256, dtype=np.uint8)
_ASCII_LOW[ord("A") : ord("Z") + 1] += 32


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes; starts and sizes of the pieces; which of them are whole words as they were, still to be cut."""
    n = int(offsets[-1])
    low, kind = _ASCII_LOW[data], _CLASS[data[:n]]
    lead = np.flatnonzero((data[:n] >= 0xC2) & (data[:n] < 0xE0))
    if len(lead):
        point = (data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F
        lead, point = lead[_PLAIN[point]], _LOW[point[_PLAIN[point]]]
        kind[lead] = kind[lead + 1] = _LETTER
        low[lead], low[lead + 1] = 0xC0 | point >> 6, 0x80 | point & 0x3F
    opens = np.zeros(n, bool)
    opens[offsets[:-1][offsets[:-1] < n]] = True
    inside = kind != _GAP
    mark = kind == _ODD
    mark[:-1] |= (data[: max(0, n - 1)] == ord("<")) & (data[1:n] == ord("|"))
    odd = np.flatnonzero(mark)
    if len(odd):
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | opens[1:]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | opens[1:]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        some = np.unique(np.searchsorted(first, odd, "right") - 1)
        at = spans(first[some], last[some] - first[some])
        kind[at], low[at] = _ODD, data[at]
    begins = inside
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | opens[1:]
    ends = kind != _GAP
    ends[:-1] &= (kind[1:] == _GAP) | begins[1:]
    starts = np.flatnonzero(begins)
    return low, starts, np.flatnonzero(ends) + 1 - starts, kind[starts] == _ODD


class PairTree:
    """Minimum segment tree with point updates."""

    __slots__ = ("none", "size", "tree")

    def __init__(self, leaves: list[int], none: int):
        size = 1
        while size < len(leaves):
            size *= 2
        tree = [none] * size + leaves + [none] * (size - len(leaves))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.size, self.tree, self.none = size, tree, none

    def root(self) -> int:
        return self.tree[1]

    def update(self, i: int, value: int) -> None:
        tree, i = self.tree, i + self.size
        tree[i] = value
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            low = a if a < b else b
            if tree[i] == low:
                break
            tree[i] = low


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next code point from 256."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class WordBpe:
    """Encoder and decoder for a tokenizer file with word ends, lower case and byte symbols."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(split["pattern"]["Regex"])
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.symbols = _byte_symbols()
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(self.vocab[a] << 32 | self.vocab[b], (rank, self.vocab[a + b]))
        self.first = [self.vocab[c] for c in self.symbols]
        self.last = [self.vocab[c + self.end] for c in self.symbols]
        self.first_ids, self.last_ids = np.array(self.first, np.int32), np.array(self.last, np.int32)
        self.table = self.rank_table()
        self.merged = np.zeros(len(model["merges"]), np.int32)
        for rank, new in self.pairs.values():
            self.merged[rank] = new
        top = max(self.tokens) + 1
        self.kind = np.dtype("<u2" if top <= 1 << 16 else "<u4")
        self.digits, self.names = Pool(np.uint8), Pool(np.uint8)
        for pool, made in ((self.digits, [b"%d " % i for i in range(top)]), (self.names, [self.tokens.get(i, "").encode() + b" " * (i in self.tokens) for i in range(top)])):
            pool.add(np.frombuffer(b"".join(made), np.uint8), np.array([len(x) for x in made], np.int32))
        self.forget()

    def merge(self, ids: list[int]) -> list[int]:
        """Merge until no pair of neighbours has a rank."""
        n, pairs = len(ids), self.pairs
        if n < 2:
            return ids
        none = len(pairs) * n + n
        leaves = [pairs[k][0] * n + i if (k := ids[i] << 32 | ids[i + 1]) in pairs else none for i in range(n - 1)]
        tree = PairTree(leaves, none)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        while (low := tree.root()) < none:
            i = low % n
            j = after[i]
            ids[i] = pairs[ids[i] << 32 | ids[j]][1]
            alive[j] = False
            after[i] = k = after[j]
            if j < n - 1:
                tree.update(j, none)
            if k < n:
                before[k] = i
                found = pairs.get(ids[i] << 32 | ids[k])
                tree.update(i, found[0] * n + i if found else none)
            else:
                tree.update(i, none)
            if (h := before[i]) >= 0:
                found = pairs.get(ids[h] << 32 | ids[i])
                tree.update(h, found[0] * n + h if found else none)
        return [x for x, ok in zip(ids, alive) if ok]

    def pieces(self, word: str) -> list[str | int]:
        """Pieces of a stretch of text without white space; a special token is its id."""
        out: list[str | int] = []
        for part in self.cut.split(word) if "<|" in word else (word,):
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii():
                out += (part.lower(),) if part.isalpha() else self.piece.findall(part.lower())
            else:
                out += self.piece.findall("".join([c.lower() for c in unicodedata.normalize("NFC", part)]))
        return out

    def byte_ids(self, piece: str) -> list[int]:
        raw = piece.encode()
        return [*map(self.first.__getitem__, raw[:-1]), self.last[raw[-1]]]

    def encode_word(self, word: str) -> list[int]:
        """Ids of a stretch of text without white space."""
        return [i for p in self.pieces(word) for i in ([p] if isinstance(p, int) else self.merge(self.byte_ids(p)))]

    def rank_table(self) -> np.ndarray:
        """Open-addressed: both ids of a pair (16 bits each), then its rank plus one."""
        table = np.zeros(1 << _TABLE_BITS, np.uint64)
        for pair, (rank, _) in self.pairs.items():
            key = (pair >> 32) << 16 | (pair & 0xFFFF)
            at = (key * int(_MULTIPLIER) & (1 << 64) - 1) >> (64 - _TABLE_BITS)
            while table[at]:
                at = (at + 1) % len(table)
            table[at] = key << _RANK_BITS | rank + 1
        return table

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        shape = left.shape
        key = (left.astype(np.uint64) << np.uint64(16) | right.astype(np.uint64)).ravel()
        at = (key * _MULTIPLIER >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        entry = self.table[at]
        out = np.where(entry >> np.uint64(_RANK_BITS) == key, (entry & np.uint64((1 << _RANK_BITS) - 1)).astype(np.int32) - 1, -1)
        left_over = np.flatnonzero((out < 0) & (entry != 0))
        while len(left_over):
            at[left_over] = (at[left_over] + 1) & (len(self.table) - 1)
            entry = self.table[at[left_over]]
            hit = entry >> np.uint64(_RANK_BITS) == key[left_over]
            out[left_over[hit]] = (entry[hit] & np.uint64((1 << _RANK_BITS) - 1)).astype(np.int32) - 1
            left_over = left_over[~hit & (entry != 0)]
        return out.reshape(shape)

    def merge_block(self, ids: np.ndarray) -> np.ndarray:
        """`merge` over many trees at once. ids: pieces x (width + 1), padded; merged-away symbols become padding."""
        n, width = len(ids), ids.shape[1] - 1
        leaves = self.ranks(ids[:, :-1], ids[:, 1:])
        leaves = np.where(leaves >= 0, leaves * width + np.arange(width), _NONE).astype(np.int32)
        leaves[:, -1] = _NONE
        tree = np.empty((n, 2 * width), np.int32)
        tree[:, width:] = leaves
        for top in (width >> k for k in range(1, width.bit_length())):
            tree[:, top : 2 * top] = np.minimum(tree[:, 2 * top : 4 * top : 2], tree[:, 2 * top + 1 : 4 * top : 2])
        after = np.tile(np.minimum(np.arange(1, width + 2), width).astype(np.int16), (n, 1))
        before = np.tile(np.arange(-1, width).astype(np.int16), (n, 1))
        before[:, 0] = width
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            low = tree[rows, 1]
            i, merged = low % width, self.merged[low // width]
            j = after[rows, i]
            k, h = after[rows, j], before[rows, i]
            ids[rows, i] = merged
            ids[rows, j] = _PAD
            after[rows, i] = k
            before[rows, k] = i
            before[:, width] = width
            right, left = self.ranks(merged, ids[rows, k]), self.ranks(ids[rows, h], merged)
            for leaf, rank in ((j, None), (i, right), (h, left)):
                at = np.minimum(leaf, width - 1).astype(np.int32)
                value = np.full(len(rows), _NONE, np.int32) if rank is None else np.where(rank >= 0, rank * width + at, _NONE).astype(np.int32)
                at += width
                tree[rows, at] = value
                while at[0] > 1:
                    value = np.minimum(value, tree[rows, at ^ 1])
                    at >>= 1
                    tree[rows, at] = value
            rows = rows[tree[rows, 1] < _NONE]
        return ids

    def merge_flat(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, given and returned end to end, and their numbers."""
        starts = np.cumsum(sizes) - sizes
        counts, found = np.zeros(len(sizes), np.int64), []
        for width, under in zip(WIDTHS, (0, *WIDTHS)):
            where = np.flatnonzero((sizes <= width) & (sizes > under))
            for at in range(0, len(where), BLOCK):
                some = where[at : at + BLOCK]
                n = sizes[some]
                flat = raw[spans(starts[some], n)]
                ids = np.full((len(some), width + 1), _PAD, np.int32)
                ids[np.arange(width + 1) < n[:, None]] = self.first_ids[flat]
                ids[np.arange(len(some)), n - 1] = self.last_ids[flat[np.cumsum(n) - 1]]
                left = self.merge_block(ids) != _PAD
                counts[some] = left.sum(1)
                found.append((some, ids[left]))
        for x in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
            body = raw[starts[x] : starts[x] + sizes[x]]
            ids = self.merge([*self.first_ids[body[:-1]].tolist(), int(self.last_ids[body[-1]])])
            counts[x] = len(ids)
            found.append((np.array([x]), np.array(ids)))
        flat, begins = np.zeros(counts.sum(), self.kind), np.cumsum(counts) - counts
        for some, ids in found:
            flat[spans(begins[some], counts[some])] = ids
        return flat, counts

    def words(self, text: str) -> list[str]:
        """Stretches between white space as the tokenizer sees it."""
        if any(c in text for c in _ODD_SPACE):
            return [w for w in regex.split(r"[\t-\r \x85\p{Z}]+", text) if w]
        return text.split()

    def learn(self, low: np.ndarray, starts: np.ndarray, sizes: np.ndarray, whole: np.ndarray) -> None:
        """Remember the ids of new pieces, and of words still to be cut."""
        texts = [low[at : at + n].tobytes().decode("utf-8", "surrogatepass") for at, n in zip(starts[whole].tolist(), sizes[whole].tolist())]
        cut = [[p for w in self.words(t) for p in self.pieces(w)] for t in texts]
        parts = [p.encode("utf-8", "surrogatepass") for ps in cut for p in ps if not isinstance(p, int)]
        plain = ~whole
        raw = np.concatenate([low[spans(starts[plain], sizes[plain])], np.frombuffer(b"".join(parts), np.uint8)])
        flat, n = self.merge_flat(raw, np.concatenate([sizes[plain], np.array([len(p) for p in parts], np.int64)]))
        stops = np.cumsum(n)
        own, at = [], int(plain.sum())
        for ps in cut:
            ids: list[int] = []
            for p in ps:
                if isinstance(p, int):
                    ids.append(p)
                else:
                    ids += flat[stops[at] - n[at] : stops[at]].tolist()
                    at += 1
            own.append(ids)
        counts = np.zeros(len(starts), np.int64)
        counts[plain], counts[whole] = n[: plain.sum()], [len(x) for x in own]
        out, begins = np.zeros(counts.sum(), self.kind), np.cumsum(counts) - counts
        out[spans(begins[plain], counts[plain])] = flat[: n[: plain.sum()].sum()]
        out[spans(begins[whole], counts[whole])] = [i for x in own for i in x]
        self.pool.add(out, counts)

    def forget(self) -> None:
        self.units, self.pool = Units(), Pool(self.kind)

    def encode_column(self, column: pa.Array, end_id: int | None = None, most: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets of the rows in them) for runs of rows of about so many bytes; with end_id, one closes
        each row."""
        for row, data, offsets in texts_of(column, most):
            if len(self.units) > KNOWN_PIECES:
                self.forget()
            low, starts, sizes, whole = segments(data, offsets)
            codes, new = self.units.codes(low, starts, sizes)
            self.learn(low, starts[new], sizes[new], whole[new])
            ids, counts = self.pool.of(codes)
            at = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[np.searchsorted(starts, offsets)]
            if end_id is not None:
                wide = ids if end_id <= np.iinfo(self.kind).max else ids.astype("<u4")
                ids, at = np.insert(wide, at[1:], end_id), at + np.arange(len(at))
            yield row, ids, at

    def encode_texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        for _, ids, at in self.encode_column(pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.binary())):
            yield from (ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist()))

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by single spaces; unknown ids vanish."""
        return joined(self.names, np.array(ids, np.int64), np.array([0, len(ids)])).to_pylist()[0]


def joined(pool: Pool, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """The pool's strings for the ids of each row, which close with a space each, without the last space."""
    flat, sizes = pool.of(ids)
    stops = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[at]
    filled = stops[1:] > stops[:-1]
    keep = np.ones(len(flat), bool)
    keep[stops[1:][filled] - 1] = False
    stops[1:] -= np.cumsum(filled)
    flat = flat[keep]
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(stops), pa.py_buffer(flat)])


_built: dict[bytes, WordBpe] = {}


def worker_bpe(raw: bytes) -> WordBpe:
    """One encoder per Python worker and file."""
    key = hashlib.sha1(raw).digest()
    if key not in _built:
        _built[key] = WordBpe(raw)
    return _built[key]


def load_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The file's bytes (under 2 MB, whatever the corpus), read on the driver alone."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded) of each row: decimal ids joined by a space, and the text that they decode to.

    Whole texts, one pass, no shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    raw = load_tokenizer(spark, tokenizer)
    rows = docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with quiet_gc():
            bpe = worker_bpe(raw.value)
            for batch in batches:
                for row, ids, at in bpe.encode_column(batch.column(1)):
                    some = batch.column(0).slice(row, len(at) - 1)
                    texts = [joined(pool, ids, at).cast(pa.string()) for pool in (bpe.digits, bpe.names)]
                    yield pa.RecordBatch.from_arrays([some, pa.array(np.diff(at)), *texts], names=names)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids string, decoded string")
