"""Ranked lexical search by windowed bucket scoring.

Texts are read once: each document becomes its length and, for the terms that the items ask for, term codes and counts,
written to the shared folder in doc_id order within each file. Document counts, lengths and document frequencies are
grouped sums over that table. Then each task goes through its postings in windows of WINDOW documents next to each other
in doc_id order: the window's postings are laid out by term and scored once for all items; for an item the parts of its
terms are scatter-added into one array of WINDOW numbers that fits a core's cache, and the terms' bitsets are or-ed to
the bitset of occupied slots; occupied slots are harvested into the item's heap of k. A task gives k rows an item at
most, and a window over them ranks the best.

Nothing grows in one place: items are taken in blocks of about BLOCK_PAIRS pairs of item and term, so that what is
broadcast (a block's terms and items) has a bound; a further block reads the texts again. No document is left out.

Defined results: a null or empty text has no terms; it isn't in N and is never a hit. An item without terms has no hits.
Documents with a null id count in the statistics but can't be named as hits. Rows with the same doc_id are documents of
their own, and repeated items are ranked each. Equal scores go by ascending doc_id. Very long texts are counted in
slices. Other columns don't matter. Empty tables give an empty table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quiet_gc, small_batches, text_or_empty, written
from .units import PADDING, Units, lowered, spans, texts_of

#: Documents of a window: 64 KB of scores and 1 KB of bits for each term.
WINDOW = 8192
#: Pairs of an item and a term that are asked for together.
BLOCK_PAIRS = 1 << 20
#: Bytes of one text that are cut into terms at once.
SLICE = 1 << 22
#: Weights of the scoring rule, in thousandths: a document of mean length counts 100, its base part 10. Fixed values.
BASE, BY_LENGTH, TF_SCALE, TF_UNIT, LENGTH_UNIT = 100 - 90, 90, 1_000_000_000, 1000, 8

_TERM = np.zeros(256, bool)
_TERM[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the terms of lowered texts (ASCII letters and digits, and all beyond ASCII), and their rows."""
    n = int(offsets[-1])
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = _TERM[data[:n]]
    edge = np.diff(inside)
    starts, stops = edge[:-1] > 0, edge[1:] < 0  # of a term that begins, or ends, with this byte
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[(inside[cuts] > 0) & (inside[cuts + 1] > 0)]  # terms of neighbouring rows touch
    starts[cuts], stops[cuts - 1] = True, True
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(stops) + 1 - at, np.searchsorted(offsets, at, "right") - 1


def _slices(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that no term crosses, each with padding."""
    n, at = len(data) - PADDING, 0
    while at < n:
        stop = min(n, at + SLICE)
        while stop < n and _TERM[data[stop]]:
            more = np.flatnonzero(~_TERM[data[stop : min(n, stop + SLICE)]])
            stop = stop + int(more[0]) if len(more) else min(n, stop + SLICE)
        part = np.zeros(stop - at + PADDING, np.uint8)
        part[:-PADDING] = data[at:stop]
        yield part
        at = stop


class Vocabulary:
    """Codes of the terms that are asked for: their places in a list."""

    def __init__(self, words: list[bytes]):
        self.units, self.size = Units(), len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        codes, _ = self.units.codes(np.frombuffer(b"".join(words) + bytes(PADDING), np.uint8), np.cumsum(sizes) - sizes, sizes)
        self.place = np.empty(len(words), np.int64)
        self.place[codes] = np.arange(len(words))

    def find(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The code of each term, -1 for terms that nobody asks for."""
        found = self.units.find(data, starts, sizes)
        return np.where(found < 0, -1, self.place[found]) if self.size else found

    def counted(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, terms of each row, codes of each row, codes row by row, their counts) for runs of rows."""
        for row, data, offsets in texts_of(column):
            if len(offsets) == 2 and offsets[-1] > SLICE:
                total, n = np.zeros(self.size, np.int64), 0
                for part in _slices(lowered(data)):
                    starts, sizes, _ = terms(part, np.array([0, len(part) - PADDING]))
                    codes = self.find(part, starts, sizes)
                    total += np.bincount(codes[codes >= 0], minlength=self.size)
                    n += len(starts)
                codes = np.flatnonzero(total)
                yield row, np.array([n]), np.array([len(codes)]), codes, total[codes]
                continue
            low = lowered(data)
            starts, sizes, rows = terms(low, offsets)
            codes = self.find(low, starts, sizes)
            known, most = codes >= 0, len(offsets) - 1
            keys, counts = np.unique(rows[known] * max(1, self.size) + codes[known], return_counts=True)
            yield row, np.bincount(rows, minlength=most), np.bincount(keys // max(1, self.size), minlength=most), keys % max(1, self.size), counts


_known: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """One table per Python worker; that of another block goes."""
    if shared.value["name"] not in _known:
        _known.clear()
        _known[shared.value["name"]] = Vocabulary(shared.value["words"])
    return _known[shared.value["name"]]


def _asked(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """place, item, terms: the distinct terms of each item, written."""
    rows = items.select(items[item_col].alias("item"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in texts_of(batch.column(1)):
                low = lowered(data)
                starts, sizes, rows = terms(low, offsets)
                own: list[set[bytes]] = [set() for _ in range(len(offsets) - 1)]
                for r, at, n in zip(rows.tolist(), starts.tolist(), sizes.tolist()):
                    own[r].add(low[at : at + n].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(own)), pa.array([sorted(x) for x in own], pa.list_(pa.binary()))], names=["item", "terms"])

    found = rows.mapInArrow(run, f"item {kind}, terms array<binary>")
    return written(found.withColumn("place", F.monotonically_increasing_id()))


def _forward(docs: DataFrame, shared) -> DataFrame:
    """doc_id, n, codes, counts of every document, written in the order of doc_id within each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with quiet_gc():
            vocabulary = _vocabulary(shared)
            for batch in batches:
                for row, n, sizes, codes, counts in vocabulary.counted(batch.column(1)):
                    at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(kind))) for x, kind in ((codes, np.int32), (counts, np.int64))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(n)), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "codes", "counts"])

    found = docs.mapInArrow(run, "doc_id long, n long, codes array<int>, counts array<long>")
    return written(found.sortWithinPartitions("doc_id"))


def length_parts(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """m of each document: whole numbers, beyond 64 bits where a product needs it."""
    if len(n) and int(n.max()) > (2**63 - 1) // (BY_LENGTH * documents):
        return np.array([BASE + BY_LENGTH * int(x) * documents // length for x in n], np.int64)
    return BASE + BY_LENGTH * n * documents // length


class Buckets:
    """Scores of one window at a time, and the heap of each item."""

    def __init__(self, starts: np.ndarray, codes: np.ndarray, weights: np.ndarray, documents: int, length: int, k: int):
        self.items = [codes[a:b].tolist() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        self.weights, self.documents, self.length, self.k = weights, documents, length, k
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in self.items]
        self.scores = np.zeros(WINDOW, np.int64)

    def window(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> None:
        """Score up to WINDOW documents; postings come row by row."""
        m = length_parts(n, self.documents, self.length)
        slots = np.repeat(np.arange(len(ids)), sizes)
        parts = self.weights[codes] * (TF_SCALE * counts // (TF_UNIT * counts + LENGTH_UNIT * m[slots]))
        order = np.argsort(codes, kind="stable")
        slots, parts = slots[order], parts[order]
        stops = np.cumsum(np.bincount(codes, minlength=len(self.weights))).tolist()
        bits: dict[int, np.ndarray] = {}
        flags = np.zeros(WINDOW, np.uint8)
        for heap, wanted in zip(self.heaps, self.items):
            occupied = None
            for code in wanted:
                first, stop = stops[code - 1] if code else 0, stops[code]
                if first == stop:
                    continue
                at = slots[first:stop]
                self.scores[at] += parts[first:stop]  # a document has a term once
                if code not in bits:
                    flags[at] = 1
                    bits[code] = np.packbits(flags)
                    flags[at] = 0
                if occupied is None:
                    occupied = bits[code].copy()
                else:
                    occupied |= bits[code]
            if occupied is not None:
                self.harvest(heap, ids, np.flatnonzero(np.unpackbits(occupied)))

    def harvest(self, heap: list[tuple[int, int]], ids: np.ndarray, at: np.ndarray) -> None:
        """The best of the occupied slots go to the heap; the slots are free again."""
        found = self.scores[at]
        self.scores[at] = 0
        least = heap[0][0] if len(heap) == self.k else 1
        if len(found) > self.k:
            least = max(least, int(np.partition(found, len(found) - self.k)[len(found) - self.k]))
        good = np.flatnonzero(found >= least)
        if not len(good):
            return
        good = good[np.lexsort((ids[at[good]], -found[good]))[: self.k]]
        for score, doc in zip(found[good].tolist(), ids[at[good]].tolist()):
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -doc))
            elif (score, -doc) > heap[0]:
                heapq.heapreplace(heap, (score, -doc))
            else:
                break


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of WINDOW documents each (the last one may be smaller): ids, lengths, numbers of postings, codes, counts."""
    held, rows = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            some = batch.slice(at, WINDOW - rows)
            at, rows = at + some.num_rows, rows + some.num_rows
            codes, counts = some.column(2), some.column(3)
            held.append((some.column(0).to_numpy(zero_copy_only=False), some.column(1).to_numpy(zero_copy_only=False), np.diff(codes.offsets.to_numpy()), codes.flatten().to_numpy(), counts.flatten().to_numpy()))
            if rows == WINDOW:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, rows = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _block(docs: DataFrame, asked: DataFrame, number: int, blocks: int, k: int) -> DataFrame:
    """place, doc_id, score: the best of each task for the items of a block."""
    spark = docs.sparkSession
    mine = asked.filter(F.pmod(F.xxhash64("place"), F.lit(blocks)) == number).select("place", "terms").toArrow()  # about BLOCK_PAIRS terms
    lists = mine.column("terms").combine_chunks()
    flat = lists.flatten().to_pylist()
    words = sorted(set(flat))
    code = {w: i for i, w in enumerate(words)}
    starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    codes, places = np.array([code[w] for w in flat], np.int64), mine.column("place").to_numpy()
    shared = spark.sparkContext.broadcast({"name": f"{number}/{id(mine)}", "words": words})
    index = _forward(docs, shared)
    total = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).head()
    documents, length = int(total[0]), int(total[1])
    frequency = np.zeros(len(words), np.int64)
    for row in index.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df")).collect():  # a block's terms at most
        frequency[row.code] = row.df
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
    rules = spark.sparkContext.broadcast((starts, codes, weights, places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with quiet_gc():
            starts, codes, weights, places = rules.value
            buckets = Buckets(starts, codes, weights, documents, length, k)
            for window in _windows(batches):
                buckets.window(*window)
            sizes = [len(h) for h in buckets.heaps]
            best = [x for h in buckets.heaps for x in h]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(places, sizes), pa.int64()), pa.array([-d for _, d in best], pa.int64()), pa.array([s for s, _ in best], pa.int64())], names=["place", "doc_id", "score"])

    return index.filter("doc_id is not null AND size(codes) > 0").mapInArrow(run, "place long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): the k best documents of each item, with a score above 0, from rank 1."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    asked = _asked(items, item_col, item_text)
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).head()[0] or 0) / BLOCK_PAIRS))
    parts = [_block(rows, asked, i, blocks, k) for i in range(blocks)]
    found = reduce(DataFrame.unionByName, parts if blocks == 1 else map(written, parts))
    best = Window.partitionBy("place").orderBy(F.col("score").desc(), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    named = ranked.join(asked.select("place", "item"), "place")
    return named.select(F.col("item").alias(item_col), "rank", F.col("doc_id").alias(id_col if id_col != item_col else "doc_id"), "score")
