"""Near-duplicate vectors by PCA-ordered tiled comparison.

The principal axes of all vectors are found from one grouped sum (the leading ones of very long vectors from three
smaller ones). Tiles of vectors rotated onto these axes are compared from the leading axes on; the norms of what is
left bound the rest of each product (Cauchy-Schwarz), and a pair is dropped as soon as its cosine cannot reach the
threshold. What remains is decided on the unit vectors as given, in double precision.

Equal unit vectors first collapse to one class with a count, so copies never pair up. Each pair of classes meets in
one block; a block gives link counts and a star over linked classes, never pairs. The comparison is exact over all
pairs, so its products grow with the square of the distinct vectors; no task does.

Defined results: a vector that is null, empty, zero, or has a null or non-finite component links with nothing, nor do
vectors of different lengths. Such a row is its own component. Null ids are not the smallest of a component unless
all are. Repeated rows count as other vectors. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import checkpoint, small_batches

#: Vectors that one slot holds.
SLOT = 8192
#: Axes accumulated before each check.
STEPS = (8, 16, 32)
#: Rounding that a bound may be off by.
EPS = 1e-9
#: Longest vectors whose products of all components are summed. Of longer ones the leading axes are found, so many, by
#: sums of products with a few directions, which each round turns towards the axes.
MOST_DIM, LEADING, ROUNDS = 512, 64, 3


def unit(vector: list | None) -> np.ndarray | None:
    if vector is None or not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0 or not np.isfinite(v).all():
        return None
    v = v / top
    return v / np.sqrt(v @ v) + 0.0


def units(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, unit binary, dim) of each row; unit is null for a vector that links with nothing."""
    small_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [unit(v) for v in batch.column(1).to_pylist()]
            cols = [batch.column(0), pa.array([None if u is None else u.tobytes() for u in got], pa.binary()), pa.array([0 if u is None else len(u) for u in got], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "unit", "dim"])

    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id long, unit binary, dim int")


def _summed(classes: DataFrame, right: dict[int, np.ndarray] | None) -> dict[int, np.ndarray]:
    """By vector length, the sum over all vectors x of x times (x times the columns of right); without right, of x times x."""
    shared = classes.sparkSession.sparkContext.broadcast(right)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim in set(batch.column(1).to_pylist()):
                rows = batch.filter(pa.compute.equal(batch.column(1), dim)).column(0).to_pylist()
                m = np.frombuffer(b"".join(rows), np.float64).reshape(-1, dim)
                sums[dim] = sums.get(dim, 0) + m.T @ (m if shared.value is None else m @ shared.value[dim])
        for dim, total in sums.items():
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), dim, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["dim", "cell", "x"])

    some = classes.filter(F.col("dim") <= MOST_DIM) if right is None else classes.filter(F.col("dim").isin(list(right)))
    cells = some.select("unit", "dim").mapInArrow(partial, "dim int, cell int, x double").groupBy("dim", "cell").agg(F.sum("x").alias("x"))
    total: dict[int, dict[int, float]] = {}
    for r in cells.toLocalIterator():
        total.setdefault(r.dim, {})[r.cell] = r.x
    return {d: np.array([c[i] for i in range(len(c))]).reshape(d, -1) for d, c in total.items()}


def axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes of each vector length, in their order: at most a square of numbers a length, whatever the rows.

    Of vectors over MOST_DIM long, the LEADING first ones; any directions at right angles to these follow.
    """
    out = {d: np.linalg.eigh(t)[1][:, ::-1].copy() for d, t in _summed(classes, None).items()}
    long = [r.dim for r in classes.filter(F.col("dim") > MOST_DIM).select("dim").distinct().collect()]
    found = {d: np.linalg.qr(np.random.default_rng(d).normal(size=(d, LEADING)))[0] for d in long}
    for _ in range(ROUNDS if long else 0):
        sums = _summed(classes, found)
        turned = {d: np.linalg.eigh(found[d].T @ t)[1][:, ::-1] for d, t in sums.items()}  # directions in the order of their share
        found = {d: np.linalg.qr(t @ turned[d])[0] for d, t in sums.items()}
    return out | {d: np.linalg.qr(q, mode="complete")[0] for d, q in found.items()}


def close(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs whose cosine reaches the threshold. ra, rb: the rotated vectors."""
    dim = a.shape[1]
    tail = lambda r, k: np.sqrt(np.maximum(0, 1 - (r[:, :k] ** 2).sum(1)))
    dots, x, y, sums, done = np.zeros((len(a), len(b))), None, None, None, 0
    for k in [*(s for s in STEPS if s < dim), dim]:
        if x is None:  # the whole tile, until few pairs are left
            dots += ra[:, done:k] @ rb[:, done:k].T
            left = dots >= threshold - EPS - np.outer(tail(ra, k), tail(rb, k))
            if k == dim or 20 * np.count_nonzero(left) <= left.size:
                x, y = np.nonzero(left)
                sums = dots[x, y]
        else:
            sums = sums + np.einsum("ij,ij->i", ra[x, done:k], rb[y, done:k])
            left = sums >= threshold - EPS - tail(ra, k)[x] * tail(rb, k)[y]
            x, y, sums = x[left], y[left], sums[left]
        done = k
    ok = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
    return x[ok], y[ok]


def group(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", slot: int = SLOT) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = checkpoint(units(vectors, id_col, vector_col).withColumn("node", F.xxhash64("unit", "dim")))
    classes = rows.filter("unit is not null").groupBy("node").agg(F.min("unit").alias("unit"), F.max("unit").alias("other"), F.first("dim").alias("dim"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    same = F.when(F.col("unit") == F.col("other"), F.col("unit")).otherwise(F.raise_error(F.lit("two vectors share a hash")).cast("binary"))
    classes = checkpoint(classes.select("node", same.alias("unit"), "dim", "least", "n"))
    turn = spark.sparkContext.broadcast(axes(classes))
    keys = ["dim", "slot_a", "slot_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in graph.groups(batches, keys):
            cells = np.stack([t.column(k).to_numpy() for k in keys], axis=1)
            start = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]).any(1)]))
            for lo, hi in zip(start, [*start[1:], len(t)]):
                dim, slot_a, slot_b = cells[lo].tolist()
                part = t.slice(lo, hi - lo)
                u = np.frombuffer(b"".join(part.column("unit").to_pylist()), np.float64).reshape(-1, dim)
                r = u @ turn.value[dim] if dim in turn.value else u
                n, ids, slots = part.column("n").to_numpy(), part.column("node").to_numpy(), part.column("slot").to_numpy()
                mid = 0 if slot_a == slot_b else int(np.searchsorted(slots, slot_b))
                links, left, right = np.zeros(len(ids), np.int64), [], []
                for i in range(0, len(ids) if slot_a == slot_b else mid, 512):
                    k = min(i + 512, len(ids) if slot_a == slot_b else mid)
                    j = i if slot_a == slot_b else mid
                    x, y = close(u[i:k], u[j:], r[i:k], r[j:], threshold)
                    x, y = x + i, y + j
                    once = x < y
                    x, y = x[once], y[once]
                    np.add.at(links, x, n[y])
                    np.add.at(links, y, n[x])
                    label = graph.stars(x, y, len(ids)) if len(x) > len(ids) else None
                    if label is not None:
                        y = np.flatnonzero(label != np.arange(len(ids)))
                        x = label[y]
                    left.append(x)
                    right.append(y)
                a, b = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (left, right))
                label = graph.stars(a, b, len(ids))
                far, some = np.flatnonzero(label != np.arange(len(ids))), np.flatnonzero(links)
                cols = [np.concatenate([ids[label[far]], ids[some]]), np.concatenate([ids[far], np.zeros(len(some), np.int64)]), np.concatenate([np.zeros(len(far), np.int64), links[some]])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "n"])

    blocked = graph.blocks(classes.select("node", "unit", "dim", "n"), ["dim"], "node", slot)
    # blocks() uses the name _n only; n stays the class's count.
    found = checkpoint(blocked.select(*keys, "slot", "node", "unit", "n").mapInArrow(run, "a long, b long, n long"))
    counts = found.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    comps = graph.components(found.filter("n = 0").select("a", "b"))
    linked = checkpoint(comps.join(classes.select("node", "least"), "node"))
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    facts = classes.select("node", "n", "least").join(counts, "node", "left").join(named, "node", "left")
    facts = facts.select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.withColumn("node", F.when(F.col("unit").isNotNull(), F.col("node"))).select("id", "node").join(facts, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
