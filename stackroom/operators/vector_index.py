"""A vector index of inverted lists (IVF): cosine search that reads only the lists near a query.

`build` fits centroids on a bounded sample, assigns every vector to its nearest one in one pass, and writes the vectors
as a table partitioned by list. `VectorIndex.search` finds the nprobe lists of each query from the centroids alone; the
lists that any query of a block needs become a filter on the partition column, so Spark reads no other folder. Vectors
don't move: each task compares what it scans with the queries that probe its list, in matrix products, and gives k
hits a query at most; a window ranks these. `exact` reads all lists for all queries, by the same path.

A vector that is null, zero or not finite has no cosine: it is kept in list -1, which no query reads. Scores are rounded
to six digits; ties go by key.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from stackroom.session import ship
from stackroom.sources.store import exists

#: Numbers of the sample that centroids are fitted on, and of the queries that are sent to the tasks at once.
SAMPLE_VALUES = QUERY_VALUES = 1 << 23
#: Lists at most: their centroids are broadcast.
MOST_LISTS = 4096
#: Rounds of the fit, and the recall on the sample that nprobe is chosen for.
ROUNDS, RECALL = 8, 0.97
#: Rows compared at once.
ROWS = 2048


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows without a direction become zero."""
    m = np.where(np.isfinite(m).all(1)[:, None], m, 0.0)
    top = np.abs(m).max(1, keepdims=True)
    m = m / np.where(top > 0, top, 1.0)
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n > 0, n, 1.0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as unit rows; those of another length, or with nulls, become zero."""
    out = np.zeros((len(column), dim))
    sizes = np.diff(column.offsets.to_numpy())
    good = np.flatnonzero((sizes == dim) & np.asarray(column.is_valid()))
    if len(good):
        flat = column.take(pa.array(good)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
        out[good] = flat.reshape(len(good), dim)
    return _unit(out)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Spherical k-means; a list that loses all its vectors takes the vector farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = sample @ centroids.T
        own, best = near.argmax(1), near.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = sample[np.argsort(best)[: len(empty)]]
        centroids = _unit(sums)
    return centroids


def calibrated(sample: np.ndarray, centroids: np.ndarray, k: int = 10, want: float = RECALL, queries: int = 256) -> int:
    """The fewest lists a query must read so that, within the sample, this share of its k nearest is found."""
    near = sample @ centroids.T
    own = near.argmax(1)
    some = np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int)
    top = np.argsort(-(sample[some] @ sample.T), axis=1)[:, :k]
    order = np.argsort(-near[some], axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, own[top], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(want * len(needed)) - 1)]) + 1


@dataclass(frozen=True)
class VectorIndex:
    path: str
    key: str
    vector: str
    dim: int
    nprobe: int
    centroids: np.ndarray
    #: Columns of the lists, as JSON: a table without rows has no file that could tell.
    schema: str

    @staticmethod
    def build(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, keep: tuple[str, ...] = ()) -> VectorIndex:
        """Index every row of vectors; keep names further columns that searches may filter on or return."""
        spark = vectors.sparkSession
        ship(spark)
        usable = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0))
        total = usable.agg(F.count(F.lit(1)), F.max(F.size(vector))).head()
        n, dim = int(total[0]), int(total[1] or 1)
        want = max(1, SAMPLE_VALUES // dim)
        share = min(1.0, 1.2 * want / max(1, n))
        chosen = usable.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) < int(math.ceil(share * (1 << 20)))).select(vector).limit(want).toArrow()
        sample = _matrix(chosen.column(0).combine_chunks(), dim) if n else np.zeros((0, dim))
        sample = sample[np.abs(sample).sum(1) > 0]
        if len(sample):
            centroids = fit_centroids(sample, max(1, min(lists or round(math.sqrt(n)), MOST_LISTS, len(sample))))
        else:
            centroids = np.zeros((1, dim))
        rows = vectors.select(key, vector, *keep)
        index = VectorIndex(path, key, vector, dim, calibrated(sample, centroids) if len(sample) else 1, centroids, StructType([*rows.schema, StructField("list", IntegerType())]).json())
        spark.createDataFrame([(i, c.tolist(), index.nprobe, key, vector, index.schema) for i, c in enumerate(centroids)], "list int, centroid array<double>, nprobe int, key string, vector string, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        index._put(rows, "overwrite")
        return index

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        ship(spark)
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # MOST_LISTS at most
        return VectorIndex(path, rows[0].key, rows[0].vector, len(rows[0].centroid), rows[0].nprobe, np.array([r.centroid for r in rows]), rows[0].schema)

    @staticmethod
    def ensure(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), recreate: bool = False) -> VectorIndex:
        """The index at path, built from vectors if there is none. One that lacks columns is an error, unless it may be
        built anew: an index isn't thrown away by accident."""
        spark = vectors.sparkSession
        if not exists(spark, f"{path}/lists/_SUCCESS"):
            return VectorIndex.build(vectors, path, key, vector, keep=keep)
        there = VectorIndex.open(spark, path)
        missing = sorted({key, vector, *keep} - set(StructType.fromJson(json.loads(there.schema)).names))
        if missing and not recreate:
            raise RuntimeError(f"the index at {path} lacks {missing}: pass recreate to build it anew")
        return VectorIndex.build(vectors, path, key, vector, keep=keep) if missing else there

    def add(self, vectors: DataFrame) -> None:
        """Append vectors with the columns of those that are there; centroids stay."""
        self._put(vectors, "append")

    def _put(self, vectors: DataFrame, mode: str) -> None:
        shared, dim, vector = vectors.sparkSession.sparkContext.broadcast(self.centroids), self.dim, self.vector

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = _matrix(batch.column(batch.schema.names.index(vector)), dim)
                own = np.where(np.abs(m).sum(1) > 0, (m @ shared.value.T).argmax(1), -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=[*batch.schema.names, "list"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
        assigned = vectors.mapInArrow(run, f"{schema}, list int")
        assigned.hint("rebalance", "list").write.mode(mode).partitionBy("list").parquet(f"{self.path}/lists")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(StructType.fromJson(json.loads(self.schema))).parquet(f"{self.path}/lists")

    def _blocks(self, queries: DataFrame) -> Iterator[pa.Table]:
        """Queries in parts of about QUERY_VALUES numbers."""
        n = max(1, math.ceil(queries.count() * self.dim / QUERY_VALUES))
        for i in range(n):
            yield queries.filter(F.pmod(F.xxhash64("query"), F.lit(n)) == i).toArrow()

    def probes(self, vectors: np.ndarray, nprobe: int) -> np.ndarray:
        """The nearest lists of each query, as a table of flags."""
        near = vectors @ self.centroids.T
        flags = np.zeros(near.shape, bool)
        nprobe = min(nprobe, near.shape[1])
        np.put_along_axis(flags, np.argpartition(-near, nprobe - 1, axis=1)[:, :nprobe], True, axis=1)
        return flags & (np.abs(vectors).sum(1) > 0)[:, None]

    def search(self, queries: DataFrame, k: int = 10, nprobe: int | None = None, where: Column | None = None, exact: bool = False) -> DataFrame:
        """(query, rank, key, score): the k nearest indexed vectors of each row (query, vector) of queries."""
        spark = queries.sparkSession
        asked = queries.select(F.col("query"), F.col("vector").cast("array<double>").alias("vector"))
        kind, key = asked.schema["query"].dataType.simpleString(), self.rows(spark).schema[self.key].dataType.simpleString()
        parts = [self._part(spark, block, k, len(self.centroids) if exact else nprobe or self.nprobe, where, kind, key) for block in self._blocks(asked)]
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), self.key)
        ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best))
        return ranked.filter(F.col("rank") <= k).select("query", "rank", self.key, "score")

    def _part(self, spark: SparkSession, block: pa.Table, k: int, nprobe: int, where: Column | None, kind: str, key: str) -> DataFrame:
        m = _matrix(block.column("vector").combine_chunks(), self.dim) if block.num_rows else np.zeros((0, self.dim))
        flags = self.probes(m, nprobe)
        lists = [int(x) for x in np.flatnonzero(flags.any(0))]
        rows = self.rows(spark).filter(F.col("list").isin(lists) if lists else F.lit(False))
        shared = spark.sparkContext.broadcast((m, flags, block.column("query").combine_chunks()))
        dim, key_name = self.dim, self.key

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, flags, names = shared.value
            held: list[list[tuple[float, object]]] = [[] for _ in range(len(m))]
            least = np.full(len(m), -2.0)
            for batch in batches:
                vectors, own, keys = _matrix(batch.column(2), dim), batch.column(0).to_numpy(), batch.column(1).to_pylist()
                for at in np.unique(own).tolist():
                    asks, here = np.flatnonzero(flags[:, at]), np.flatnonzero(own == at)
                    for a in range(0, len(asks), ROWS):
                        some = asks[a : a + ROWS]
                        near = np.round(m[some] @ vectors[here].T, 6)
                        for i in np.flatnonzero(near.max(1) >= least[some]).tolist():
                            q = int(some[i])
                            good = np.flatnonzero(near[i] >= least[q])
                            merged = sorted(held[q] + [(-float(near[i, j]), keys[here[j]]) for j in good.tolist()])[:k]
                            held[q] = merged
                            if len(merged) == k:
                                least[q] = -merged[-1][0]
            found = [(q, key, -score) for q, hits in enumerate(held) for score, key in hits]
            columns = [names.take(pa.array([x[0] for x in found], pa.int64())), pa.array([x[1] for x in found], kinds[0]), pa.array([x[2] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["query", key_name, "score"])

        kept = rows if where is None else rows.filter(where)
        kinds = [pa.int64() if key in ("bigint", "int") else pa.string()]
        return kept.select("list", F.col(self.key).cast("long" if key in ("bigint", "int") else "string").alias(self.key), self.vector).mapInArrow(run, f"query {kind}, `{self.key}` {'long' if key in ('bigint', 'int') else 'string'}, score double")


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row: queries, and the share of the exact hits that were found."""
    pairs = exact.select("query", key).join(found.select("query", key).withColumn("hit", F.lit(1)), ["query", key], "left")
    return pairs.agg(F.countDistinct("query").alias("queries"), F.count(F.lit(1)).alias("wanted"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
