"""Best-fit decreasing packing of token sequences.

A document's ids, then one end id, are cut into full windows first. What is left of each document goes, longest
first, into the open window with the least room that still holds it: a segment tree indexed by remaining capacity
finds that window. Windows that stay badly filled are cut anew, end to end, and the very last stretch of a shard is
cut at powers of two, which need no padding.

A shard is what one task has read, up to SHARD_TOKENS at a time, so nothing is shuffled and memory is bounded
whatever the input. Row order within a shard decides ties.

Defined results: a null or empty text is the end id alone. Repeated or null ids are packed row by row. An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import load_tokenizer, worker_bpe
from .common import quiet_gc, small_batches, text_or_empty

WINDOW = 2048
#: Tokens packed together, 2 bytes each, and bytes of text encoded at once: a worker lives on beside tasks of other stages.
SHARD_TOKENS, RUN_BYTES = 1 << 22, 1 << 19
#: A window with more room than this share of it is cut anew.
SLACK = 0.02


class CapacityTree:
    """Open windows by remaining capacity. Each node counts the windows below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, window) with the least room of at least need."""
        count, i = self.count, need + self.size
        if not count[i]:
            while i > 1 and not (i & 1 == 0 and count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) over documents of these lengths."""
    full: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths):
        whole = n - n % window
        full += [[(doc, at, window)] for at in range(0, whole, window)]
        if n > whole:
            rest.append((doc, whole, n - whole))
    rest.sort(key=lambda p: -p[2])
    tree, bins = CapacityTree(window), []
    for piece in rest:
        room, at = tree.take(piece[2]) or (window, len(bins))
        if at == len(bins):
            bins.append([])
        bins[at].append(piece)
        if room > piece[2]:
            tree.add(room - piece[2], at)
    bad = window - int(window * SLACK)
    good, loose = [], []
    for b in bins:
        n = sum(p[2] for p in b)
        (good if n >= bad or n & (n - 1) == 0 else loose).append(b)
    return full + good + recut([p for b in loose for p in b], window)


def recut(pieces: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """Lay the pieces end to end; cut full windows, then stretches whose lengths are powers of two."""
    left = sum(p[2] for p in pieces)
    sizes = [window] * (left // window)
    left %= window
    if left >= window - int(window * SLACK):
        sizes.append(left)
    else:
        sizes += [1 << k for k in reversed(range(left.bit_length())) if left >> k & 1]
    out, queue = [], iter(pieces)
    doc = start = length = 0
    for size in sizes:
        sequence = []
        while size:
            if not length:
                doc, start, length = next(queue)
            n = min(size, length)
            sequence.append((doc, start, n))
            start, length, size = start + n, length - n, size - n
        out.append(sequence)
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    raw = load_tokenizer(spark, tokenizer)
    rows = docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def packed(keys: list, tokens: list[np.ndarray], sequences: list[list[tuple[int, int, int]]], id_type: pa.DataType, first: int) -> Iterator[pa.RecordBatch]:
        flat = [(k, off, p) for k, s in enumerate(sequences, first) for off, p in zip(np.cumsum([0, *(p[2] for p in s)]).tolist(), s)]
        for at in range(0, len(flat), 500):
            some = flat[at : at + 500]
            cols = [pa.array([keys[p[0]] for _, _, p in some], id_type), *(pa.array([p[i] for _, _, p in some], pa.int64()) for i in (1, 2))]
            cols += [pa.array([tokens[d][s : s + n].astype("<u4").tobytes() for _, _, (d, s, n) in some], pa.binary())]
            cols += [pa.array(c, pa.int64()) for c in ([len(tokens[p[0]]) for _, _, p in some], [k for k, _, _ in some], [o for _, o, _ in some])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with quiet_gc():
            bpe = worker_bpe(raw.value)
            at, held, keys, tokens, id_type = TaskContext.get().partitionId() << 32, 0, [], [], None
            for batch in batches:
                id_type = batch.schema.field(0).type
                batch_keys = batch.column(0).to_pylist()
                for row, ids, stops in bpe.encode_column(batch.column(1), end_id, RUN_BYTES):
                    keys += batch_keys[row : row + len(stops) - 1]
                    tokens += [ids[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
                    held += len(ids)
                    if held >= SHARD_TOKENS:
                        sequences = best_fit([len(t) for t in tokens], window)
                        yield from packed(keys, tokens, sequences, id_type, at)
                        at, held, keys, tokens = at + len(sequences), 0, [], []
            if keys:
                yield from packed(keys, tokens, best_fit([len(t) for t in tokens], window), id_type, at)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
