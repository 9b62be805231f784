"""Pairs within blocks of bounded size, and connected components of the links found.

Blocks: a group of n rows is dealt to ceil(n / BLOCK) slots, and each pair of slots meets in a task of its own, so no
task holds more than two slots of a group, however large. A task emits a star per group of linked rows, not pairs.

Components: alternating large and small stars (Kiveris et al., 2014), with a reliable checkpoint per round. Nothing is
collected but one count and one checksum a round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Rows of a group that one slot holds.
BLOCK = 2048
#: Rows of small groups that are looked at together.
CHUNK = 1 << 14
#: Pairs of a large block that are matched together.
PAIRS = 1 << 18
#: Links that a task holds before it reduces them to a star or a forest, or emits them.
HELD = 1 << 17


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]  # roots: labels are flat here
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Indexes of a spanning forest of the edges, the heaviest first (Boruvka)."""
    label, at, taken = np.arange(n), np.arange(len(a)), []
    at = at[np.argsort(-weight.astype(np.int64), kind="stable")]
    while len(at := at[label[a[at]] != label[b[at]]]):
        x, y = label[a[at]], label[b[at]]
        _, first = np.unique(np.stack([x, y], axis=1).ravel(), return_index=True)
        best = np.unique(first // 2)
        taken.append(at[best])
        label = stars(x[best], y[best], n)[label]
    return np.unique(np.concatenate(taken)) if taken else np.zeros(0, np.int64)


def blocks(rows: DataFrame, group: list[str], key: str, block: int = BLOCK) -> DataFrame:
    """Rows of groups with at least two rows, with slots: slot_a <= slot_b is the task's pair of slots, slot the row's."""
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    out = rows.join(sizes, group)
    slots = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    out = out.withColumn("_slots", slots).withColumn("slot", F.pmod(F.xxhash64(F.lit(7), key), F.col("_slots")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_slots") - 1)))
    out = out.withColumn("slot_a", F.least("slot", "_other")).withColumn("slot_b", F.greatest("slot", "_other"))
    keys = [*group, "slot_a", "slot_b"]
    return out.drop("_n", "_slots", "_other").repartition(*keys).sortWithinPartitions(*keys, "slot", key)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a sorted stream into tables that hold whole groups: one large group, or about CHUNK rows of small ones."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cuts(t: pa.Table) -> np.ndarray:
        change = np.zeros(len(t), bool)
        change[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size >= CHUNK:
            t = pa.Table.from_batches(held).combine_chunks()
            last = int(cuts(t)[-1])
            if last:
                yield t.slice(0, last)
            t = t.slice(last)
            held, size = t.combine_chunks().to_batches(), len(t)
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def links(blocked: DataFrame, group: list[str], node: str, columns: list[str], match: Callable[..., np.ndarray], star: bool = True, every: bool = False, one: str | None = None) -> DataFrame:
    """(a, b): a star over the linked nodes of each block; without star, a spanning forest of real links, heaviest first,
    or every link.

    match(columns of left, columns of right) -> weight of each link, 0 for none.

    one: a column of numbers; for the forest, rows with equal ones are one node, in all groups that a task looks at together.

    columns: of the row, given to match as arrays; those of the left side have shape (n, 1) in blocks of over 64 rows.
    """
    keys = [*group, "slot_a", "slot_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, keys):
            n = len(t)
            change = np.zeros(n, bool)
            change[0] = True
            for k in keys:
                v = t.column(k).to_numpy()
                change[1:] |= v[1:] != v[:-1]
            start = np.flatnonzero(change)
            sizes = np.diff([*start, n])
            gid = np.repeat(np.arange(len(start)), sizes)
            cols = [as_array(t.column(c)) for c in columns]
            slot, diagonal = t.column("slot").to_numpy(), (t.column("slot_a").to_numpy() == t.column("slot_b").to_numpy())
            ids = t.column(node).to_numpy()
            roots = np.unique(t.column(one).to_numpy(), return_inverse=True)[1] if one else np.arange(n)
            left, right, weights = [], [], []

            def reduced() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """What is needed of the links held: reducing them once more with others gives what all would give."""
                a, b, w = (np.concatenate(x) for x in (left, right, weights))
                keep = a != b
                a, b, w = a[keep], b[keep], w[keep]
                if star:
                    label = stars(a, b, n)
                    b = np.flatnonzero(label != np.arange(n))
                    return label[b], b, np.ones(len(b), np.int8)
                if every:
                    return a, b, w
                some = forest(roots[a], roots[b], w, n)
                return a[some], b[some], w[some]

            def put(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
                for x, y in zip((left, right, weights), (a, b, w)):
                    x.append(y)
                if sum(map(len, left)) >= HELD:
                    got = reduced()
                    left[:], right[:], weights[:] = [], [], []
                    if every:
                        yield named(*got[:2])
                    else:
                        for x, y in zip((left, right, weights), got):
                            x.append(y)

            def named(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], names=["a", "b"])

            small = np.flatnonzero(sizes[gid] <= 64)
            sub, sub_cols = gid[small], [c[small] for c in cols]
            for lag in range(1, int(sizes[sizes <= 64].max(initial=1))):
                same = np.flatnonzero(sub[lag:] == sub[:-lag])
                same = same[diagonal[small[same]] | (slot[small[same]] != slot[small[same + lag]])]
                if len(same):
                    weight = match([c[same] for c in sub_cols], [c[same + lag] for c in sub_cols])
                    hit = same[weight > 0]
                    yield from put(small[hit], small[hit + lag], weight[weight > 0])
            for at in np.flatnonzero(sizes > 64):
                lo, hi = int(start[at]), int(start[at] + sizes[at])
                mid = lo if diagonal[lo] else lo + int(np.searchsorted(slot[lo:hi], t.column("slot_b")[lo].as_py()))
                stop = hi if diagonal[lo] else mid
                wide = max(1, PAIRS // max(1, sizes[at]))
                for i in range(lo, stop, wide):
                    j = i if diagonal[lo] else mid
                    k = min(i + wide, stop)
                    hit = match([c[i:k, None] for c in cols], [c[None, j:hi] for c in cols])
                    x, y = np.nonzero(hit)
                    yield from put(x + i, y + j, hit[x, y])
            if left:
                yield named(*reduced()[:2])

    return blocked.select(*dict.fromkeys([*keys, "slot", node, *columns])).mapInArrow(run, "a long, b long")


def as_array(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers as they are; binary values of one length as rows of bytes."""
    if pa.types.is_binary(column.type):
        rows = column.to_pylist()
        return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return column.to_numpy()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node of its component."""
    flat = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        flat = checkpoint(small)
        now = tuple(flat.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return flat.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(flat.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
