"""SimHash near-deduplication with pigeonring filtering.

A fingerprint of 64 bits lies on a ring of m segments. If two fingerprints differ in at most t bits, some segment
starts a chain whose first l segments differ in at most floor(l * t / m) bits, for each l (the pigeonring principle,
Qin and Xiao 2018). While that budget is zero the segments are equal, and these form the bucket key; the rest of the
chain prunes the bucket's pairs before the full Hamming check.

Fingerprints first collapse to classes, so copies never pair up. A bucket of any size is dealt in blocks.

`near_duplicates` goes by the Jaccard similarity of shingle sets, and finds every link. Pigeonring links of fingerprints
join most copies first. Then prefix filtering finds what is left: with shingles in one order for all texts, sets that
are so similar share one of their first ones, so rows meet by these; sizes and the parities of classes of shingles,
which bound the difference of two sets, prune. The order puts frequent shingles last, so that a passage of many texts
brings few of them together. Links are those pairs whose shingles, compared in full, are similar enough.

Defined results: a null text is empty; a text of fewer words than a shingle is one shingle; no word gives fingerprint
0, linked like any other. Null ids are never the smallest of a group unless all are null. Repeated rows get the same
result. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import checkpoint, fresh, quiet_gc, small_batches, text_or_empty, tidy_shuffles, written
from .units import lowered, shingles, spans, texts_of

SEED = 42
#: Segments of the ring for links of a few bits.
SEGMENTS = 5
#: Of shingles that a task sees in many texts of a batch, so many are reported; of all reported, so many go last.
#: Any order gives all links: these bound what the order costs, not what is found.
REPORTED, FREQUENT = 20_000, 65_536
#: Rows of one shingle that a slot holds.
SLOT = 4096
#: Classes of shingles whose parities bound the difference of two sets.
CELLS = 1024
#: Sets of more shingles have finer parities too: 2 KB that are looked at before two long texts are brought together.
LONG_SET, FINE_CELLS = 256, 16_384
#: Rows whose texts are to be compared: up to so many, their keys go to all tasks, and no other text is moved.
SMALL_NEEDED = 500_000
#: Bytes of the texts of pairs that are compared together; a longer pair is a run of its own.
RUN_BYTES = 1 << 22


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    return np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[: len(found) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        votes += np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def parities(distinct: np.ndarray, cells: int = CELLS) -> bytes:
    """One bit for each class of hashes: is their number odd? Sets differ in at least as many members as these bits do."""
    odd = np.bincount((distinct & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with quiet_gc():
            for batch in batches:
                got = np.array([fingerprint(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def ring(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def free_length(distance: int, segments: int) -> int:
    """How many leading segments of a chain have no budget."""
    return max(1, next(n for n in range(1, segments + 2) if n * distance // segments > 0 or n > segments) - 1)


def close_pairs(classes: DataFrame, distance: int, segments: int = SEGMENTS) -> DataFrame:
    """(a, b): stars over the fingerprints (column fp, distinct) within distance bits."""
    if distance >= segments:
        raise ValueError("the ring needs more segments than bits of distance")
    cells = ring(segments)
    free = free_length(distance, segments)
    part = lambda c: F.shiftrightunsigned("fp", c[0]).bitwiseAND(F.lit((1 << c[1]) - 1))

    def key(start: int):
        out = F.lit(start).cast("long")
        for i in range(free):
            cell = cells[(start + i) % segments]
            out = F.shiftleft(out, cell[1]).bitwiseOR(part(cell))
        return out

    signed = classes.select("fp", F.posexplode(F.array(*(key(i) for i in range(segments)))).alias("start", "key"))

    def match(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        x = left[0].view(np.uint64) ^ right[0].view(np.uint64)
        start = left[1]
        near = np.bitwise_count(x) <= distance
        at = np.nonzero(near)
        if not len(at[0]):
            return near.astype(np.uint8)
        some, first = x[at], np.broadcast_to(start, x.shape)[at]
        gaps = np.stack([np.bitwise_count(some >> np.uint64(s) & np.uint64((1 << w) - 1)) for s, w in cells], axis=1).astype(np.int64)
        total, ok = np.zeros(len(some), np.int64), np.ones(len(some), bool)
        for n in range(1, segments + 1):
            total += gaps[np.arange(len(some)), (first + n - 1) % segments]
            ok &= total <= n * distance // segments
        near[at] = ok
        return near.astype(np.uint8)

    blocked = graph.blocks(signed, ["start", "key"], "fp")
    return graph.links(blocked, ["start", "key"], "fp", ["fp", "start"], match)


def group(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id, kept."""
    fps = checkpoint(fingerprints(docs, words, id_col, text_col))
    classes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    comps = graph.components(close_pairs(classes.select("fp"), distance))
    linked = checkpoint(comps.join(classes, comps.node == classes.fp).select("fp", "root", "least"))
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(linked.select("fp", "root").join(roots, "root").select("fp", "component_id"), "fp", "left")
    named = named.select("fp", F.coalesce("component_id", "least").alias("component_id"))
    out = fps.join(named, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def prefix_length(size: int, similarity: float) -> int:
    """Of two sets of this Jaccard similarity, sorted alike, so many first members of each hold a common one."""
    return size - math.ceil(similarity * size - 1e-6) + 1 if size else 0


def row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits of id and text."""
    row_id, text = docs[id_col].cast("long"), text_or_empty(text_col)
    return F.xxhash64(row_id, text), F.xxhash64(F.lit(7), text, row_id)


def frequent(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of the shingles that are in many texts, and how frequent (a level); at most FREQUENT of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        with quiet_gc():
            for batch in batches:
                for _, data, offsets in texts_of(batch.column(0)):
                    row, found = shingles(lowered(data), offsets, words)
                    found = found[distinct(row, found)[0]]
                    found, n = np.unique(found, return_counts=True)
                    many = n >= max(4, len(offsets) // 256)
                    both, at = np.unique(np.concatenate([held[0], found[many]]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([held[1], n[many]])).astype(np.int64)
                    most = np.sort(np.argsort(-n, kind="stable")[:REPORTED])
                    held = both[most], n[most]
        yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1])], names=["shingle", "n"])

    counts = checkpoint(rows.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")))
    level = F.floor(F.log2("n")).cast("int")
    kept, least = 0, 64
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):  # 63 levels at most
        if kept + r["count"] > FREQUENT:
            break
        kept, least = kept + r["count"], r.level
    got = counts.filter(level >= least).select("shingle", level.alias("level")).toPandas()
    found = got["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], got["level"].to_numpy(np.int64)[order]


def distinct(row: np.ndarray, found: np.ndarray, level: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct shingles of each row, by row, then level, then hash; and the rows at these places."""
    order = np.lexsort((found, row) if level is None else (found, level, row))
    row, found = row[order], found[order]
    new = np.ones(len(order), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    return order[new], row[new]


def marks(rows: DataFrame, words: int, similarity: float, often: Broadcast) -> DataFrame:
    """rows (key, more, id, text) with a number of their own (node), the digest and size of the shingle set, its
    fingerprint and parities (finer ones too for a long set), and its first shingles."""
    names = ["node", "key", "more", "id", "set", "size", "fp", "odd", "fine", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId() << 36
        known, levels = often.value
        with quiet_gc():
            for batch in batches:
                for at, data, offsets in texts_of(batch.column(3)):
                    n = len(offsets) - 1
                    row, found = shingles(lowered(data), offsets, words)
                    where = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
                    level = np.where(known[where] == found, levels[where], 0) if len(known) else np.zeros(len(found), np.int64)
                    places, row = distinct(row, found, level)
                    ordered = found[places]
                    stops = np.searchsorted(row, np.arange(n + 1))
                    sizes = np.diff(stops)
                    sets, fps, odd, fine = [], [], [], []
                    for a, b in zip(stops[:-1].tolist(), stops[1:].tolist()):
                        sets.append(xxhash.xxh3_128_digest(np.sort(ordered[a:b]).tobytes()))
                        fps.append(fingerprint(ordered[a:b]))
                        odd.append(parities(ordered[a:b]))
                        fine.append(parities(ordered[a:b], FINE_CELLS) if b - a > LONG_SET else None)
                    length = np.array([prefix_length(k, similarity) for k in sizes.tolist()], np.int64)
                    firsts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(ordered[spans(stops[:-1], length)].view(np.int64)))
                    part = batch.slice(at, n)
                    cols = [pa.array(np.arange(node, node + n)), part.column(0), part.column(1), part.column(2), pa.array(sets, pa.binary()), pa.array(sizes.astype(np.int32)), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(odd, pa.binary()), pa.array(fine, pa.binary()), firsts]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    node += n

    return written(rows.select("key", "more", "id", "text").mapInArrow(run, "node long, key long, more long, id long, set binary, size int, fp long, odd binary, fine binary, first array<long>"))


def similar(pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b) of the pairs (a, b, text_a, text_b) whose shingles are similar enough.

    Pairs are taken in runs of bounded text; a text that several pairs of a run share is cut into shingles once.
    """

    def sets(texts: pa.Array) -> list[np.ndarray]:
        out = []
        for _, data, offsets in texts_of(texts):
            row, found = shingles(lowered(data), offsets, words)
            stops = np.searchsorted(row, np.arange(len(offsets)))
            out += [np.unique(found[i:j]) for i, j in zip(stops[:-1].tolist(), stops[1:].tolist())]
        return out

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        least, most = sorted((len(x), len(y)))
        if least < similarity * most - 1e-9:
            return False
        both = np.concatenate([x, y])
        both.sort()
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return common >= similarity * (least + most - common) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with quiet_gc():
            for batch in batches:
                size = pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_numpy(zero_copy_only=False)
                ends = np.cumsum(size, dtype=np.int64)
                at = 0
                while at < len(batch):
                    stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_BYTES, "right")))
                    part = batch.slice(at, stop - at)
                    named = pa.concat_arrays([part.column(2), part.column(3)]).dictionary_encode()
                    of, index = sets(named.dictionary), named.indices.to_numpy().tolist()
                    keep = [linked(of[i], of[j]) for i, j in zip(index[: len(part)], index[len(part) :])]
                    yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))
                    at = stop

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, key, more, id, keep) of each row that shares a group with another: keep is true for one row, of the
    smallest id. key and more are 128 bits of id and text; node tells rows apart that repeat them."""
    small_batches(docs.sparkSession)
    with tidy_shuffles(docs.sparkSession):
        return _near_duplicates(docs, words, similarity, id_col, text_col)


def _near_duplicates(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    key, more = row_key(docs, id_col, text_col)
    rows = docs.select(key.alias("key"), more.alias("more"), docs[id_col].cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    marked = marks(rows, words, similarity, spark.sparkContext.broadcast(frequent(rows, words)))
    # Equal sets: one row stands for the others, so a group of copies is one row here.
    stands = checkpoint(marked.groupBy("set").agg(F.min("node").alias("node")))
    classes = marked.join(stands.select("node"), "node", "left_semi")
    facts = written(classes.select("node", "key", "more", "size", "fp", "odd", "fine"))
    most = (1 - similarity) / (1 + similarity)

    def possible(edges: DataFrame) -> DataFrame:
        """Edges (a, b) but for those of two long sets whose finer parities rule the similarity out."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                long = np.flatnonzero(pc.and_(batch.column(3).is_valid(), batch.column(5).is_valid()).to_numpy(zero_copy_only=False))
                keep = np.ones(len(batch), bool)
                x, y = (np.frombuffer(b"".join(batch.column(c).take(pa.array(long)).to_pylist()), np.uint64).reshape(len(long), FINE_CELLS // 64) for c in (3, 5))
                sizes = batch.column(2).to_numpy()[long].astype(np.int64) + batch.column(4).to_numpy()[long]
                keep[long] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most * sizes + 1e-6
                yield batch.select([0, 1]).filter(pa.array(keep))

        own = facts.select("node", "size", "fine")
        both = edges.join(own.toDF("a", "size_a", "fine_a"), "a").join(own.toDF("b", "size_b", "fine_b"), "b")
        return checkpoint(both.select("a", "b", "size_a", "fine_a", "size_b", "fine_b").mapInArrow(run, "a long, b long"))

    def checked(edges: DataFrame) -> DataFrame:
        """Edges (a, b) that hold on the shingles."""
        edges = possible(checkpoint(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
        named = checkpoint(facts.select("node", "key", "more").join(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"))
        some = F.broadcast(named) if named.count() <= SMALL_NEEDED else named
        texts = rows.select("key", "more", "text").join(some, ["key", "more"]).groupBy("node").agg(F.first("text").alias("text"))
        pairs = edges.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
        return checkpoint(similar(pairs, words, similarity))

    def sizes_fit(a: str, b: str) -> Column:
        return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity) - 1e-6

    # Rows of one fingerprint, and of fingerprints that the ring links.
    leads = checkpoint(facts.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("lead")).select("fp", F.col("lead.node").alias("lead"), F.col("lead.size").alias("lead_size")))
    alike = facts.join(leads, "fp").filter(F.col("node") != F.col("lead")).filter(sizes_fit("size", "lead_size")).select(F.col("lead").alias("a"), F.col("node").alias("b"))
    ring_links = close_pairs(leads.select("fp"), 2).filter("a <> b").toDF("fp_a", "fp_b")
    ring_links = ring_links.join(leads.toDF("fp_a", "a", "size_a"), "fp_a").join(leads.toDF("fp_b", "b", "size_b"), "fp_b").filter(sizes_fit("size_a", "size_b")).select("a", "b")
    true = checked(alike.unionByName(ring_links))

    # Only shingles that are first ones of two rows can be the common one.
    firsts = classes.select("node", F.explode("first").alias("shingle"))
    often = firsts.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("shingle")
    shared = written(firsts.join(often, "shingle"))
    # Shingles of the very same rows say the same: one of them is enough. 128 bits and a count tell sets of rows apart.
    rows_of = shared.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("two"))
    shared = written(shared.join(rows_of.groupBy("n", "one", "two").agg(F.min("shingle").alias("shingle")).select("shingle"), "shingle", "left_semi"))

    def match(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        (x, a, r), (y, b, q) = left, right
        near = (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6) & (r != q)
        out = np.zeros(near.shape, np.int32)
        at = np.nonzero(near)
        if len(at[0]):
            ia, ib = (at[0], at[1]) if len(at) == 2 else (at[0], at[0])
            a, b = (c.reshape(-1, CELLS // 8).view(np.uint64) for c in (a, b))
            x, y = (c.ravel()[i] for c, i in ((x, ia), (y, ib)))
            for first in range(0, len(ia), 1 << 15):
                part = slice(first, first + (1 << 15))
                apart = np.bitwise_count(a[ia[part]] ^ b[ib[part]]).sum(1, dtype=np.int64)
                out[tuple(i[part] for i in at)] = np.where(apart <= most * (x[part] + y[part]) + 1e-6, CELLS + 1 - apart, 0)
        return out

    def found(roots: DataFrame, every: bool) -> DataFrame:
        """Pairs of rows of different roots: a forest that spans the roots of each block, or every pair."""
        rooted = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
        rooted = rooted.join(mixed.select("shingle"), "shingle", "left_semi").join(facts.select("node", "size", "odd"), "node")
        return graph.links(graph.blocks(rooted, ["shingle"], "node", SLOT), ["shingle"], "node", ["size", "odd", "root"], match, star=False, every=every, one="root")

    # A forest joins most groups by few checks. As some of its pairs fail, each pair between what it joined is checked too.
    true = checkpoint(true.unionByName(checked(found(graph.components(true), False))))
    comps = graph.components(true)
    last = checked(found(comps, True))
    if not last.isEmpty():
        comps = graph.components(true.unionByName(last))
    named = marked.select("node", "key", "more", "id", "set").join(stands.withColumnRenamed("node", "stand"), "set").join(comps.select(F.col("node").alias("stand"), "root"), "stand", "left")
    named = checkpoint(named.select("node", "key", "more", "id", F.coalesce("root", "stand").alias("root")))
    order = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), "node")
    first = named.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return named.join(first, "root").select("node", "key", "more", "id", (F.col("node") == F.col("first.node")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are near copies of one that stays. Of rows that repeat id and text, one stays."""
    found = checkpoint(near_duplicates(docs, words, similarity, id_col, text_col).groupBy("key", "more").agg(F.max("keep").alias("keep"), F.count(F.lit(1)).alias("n")))
    key, more = fresh(docs.columns, "near_key", "near_more")
    gone = found.filter("not keep").select(F.col("key").alias(key), F.col("more").alias(more))
    marked = docs.withColumns(dict(zip((key, more), row_key(docs, id_col, text_col))))
    out = marked.join(gone, [key, more], "left_anti")
    if not found.filter("keep and n > 1").isEmpty():
        out = out.dropDuplicates([key, more])
    return out.select(*docs.columns)
