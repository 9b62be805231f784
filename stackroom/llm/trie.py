"""Prefix trie of conversations by distributed MSD radix partitioning over dictionary-encoded turn ids.

1. Turns (role, text) become ids of a dictionary, the distinct SHA-256 digests; texts move no further. Digests that hold
   over a thousandth of all turns (so at most a thousand) are looked up by broadcast, the others by a join.
2. A conversation is its array of ids. Equal conversations collapse to one row with their number, their smallest id and
   the digest of their ids, which one sorted stream makes: a SHA-256 can't be split, but a member is two numbers there.
3. Radix rounds: all rows start in the root's bucket. A round takes the next digits of each large bucket's rows (one
   turn, then 2, 4 and up to MOST_LEVELS a round) and groups rows by prefix, with partial sums before the shuffle; each
   prefix is a node. Prefixes that still hold more than a local share of turns are buckets of the next round.
4. Other buckets are local: a task reads them one after the other and finishes each by multikey quicksort, in which
   every run of equal turns is a node. A single conversation of any length is local.
5. Sums over subtrees go from local buckets up through the rounds, each node's to its few ancestors in its round.

Prefixes are named by chained 160-bit digests of turn ids. Python holds one local bucket, or one conversation's ids.

Defined results: null roles and texts are empty. Rows with a null conv_id belong to no conversation and are left out.
Turns are ordered by turn (null first), equal ones by the digest of role and text; repeated rows are turns. A
conversation without turns left after rebuilding is a member of the root alone. Other columns don't matter. An empty
table gives an empty table, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quiet_gc, small_batches, written

#: Turns of a bucket that one task finishes: least, and most however many there are in all.
LOCAL_TURNS, MOST_LOCAL = 1 << 14, 1 << 22
#: Large buckets that are aimed at, in all; and keys of buckets that are broadcast at most.
BUCKETS, MOST_SENT = 10_000, 100_000
#: Turns that a round looks at, at most.
MOST_LEVELS = 16
#: A digest with more than this share of all turns is looked up by broadcast.
HOT_SHARE = 1000
#: Words of a text. Fixed value.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digest of no bytes.
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = b""

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, ids, words: each conversation's turn ids in order, and the words of their texts."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.filter(turns["conv_id"].isNotNull()).select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), F.unhex(digest).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("int").alias("words"))
    rows = written(rows)
    known = written(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).withColumn("id", F.monotonically_increasing_id()))
    limit = max(1, rows.count() // HOT_SHARE)
    hot = known.filter(F.col("times") > limit).select("digest", F.col("id").alias("hot_id"))  # at most HOT_SHARE rows
    tried = rows.join(F.broadcast(hot), "digest", "left")
    rest = tried.filter("hot_id is null").join(known.filter(F.col("times") <= limit).select("digest", "id"), "digest")
    coded = tried.filter("hot_id is not null").withColumn("id", F.col("hot_id")).select(*rest.columns).unionByName(rest)
    place = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    turn = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"), place.alias("c"), "id", "words")
    ordered = coded.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda x: x["id"]).alias("ids"), F.transform("t", lambda x: x["words"]).alias("words"))


def rebuilt(seqs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation with its first crc32(conv_id) % most turns taken from the last conv_id that every divides."""
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    heads = seqs.filter(c % every == 0).select(F.col("conv_id").alias("base"), *(F.slice(x, 1, most - 1).alias(f"head_{x}") for x in ("ids", "words")))
    both = seqs.withColumns({"base": c - c % every, "h": h}).join(heads, "base", "left")

    def joined(x: str) -> Column:
        own = F.slice(F.col(x), F.col("h") + 1, F.greatest(F.size(x) - F.col("h"), F.lit(0)))
        head = F.coalesce(F.col(f"head_{x}"), F.array().cast(seqs.schema[x].dataType))
        return F.concat(F.slice(head, F.lit(1), F.col("h")), own)

    return both.select("conv_id", joined("ids").alias("ids"), joined("words").alias("words"))


def collapsed(seqs: DataFrame) -> DataFrame:
    """conv_id, n, ends, ids, words: one row of equal sequences; ends is the digest of their members' ids."""
    named = written(seqs.withColumn("same", F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256))))
    members = named.select("same", "conv_id").repartition("same").sortWithinPartitions("same", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, first, n, digest = None, 0, 0, hashlib.sha256()
        for batch in batches:
            out = []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != same:
                    if same is not None:
                        out.append((first, n, digest.hexdigest()))
                    same, first, n, digest = key, conv, 0, hashlib.sha256()
                digest.update(b",%d" % conv if n else b"%d" % conv)
                n += 1
            yield _batch(out)
        if same is not None:
            yield _batch([(first, n, digest.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "n", "ends"])

    return members.mapInArrow(run, "conv_id long, n long, ends string").join(named.drop("same"), "conv_id")


def extended(key: bytes, turn: int) -> bytes:
    """Name of the prefix one turn longer."""
    return hashlib.blake2b(key + turn.to_bytes(8, "little"), digest_size=20).digest()


def _digits(rows: DataFrame, depth: int, levels: int) -> DataFrame:
    """A row for each of the next levels of each sequence; that of the last level carries the sequence on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            at, flat, flat_words = column["ids"].offsets.to_numpy(), column["ids"].values.to_numpy(), column["words"].values.to_numpy()
            words_at = column["words"].offsets.to_numpy()
            keys, paths, parents, words, ends, more, level, source, carry = ([] for _ in range(9))
            for i, (key, end) in enumerate(zip(column["key"].to_pylist(), column["ends"].to_pylist())):
                size = int(at[i + 1] - at[i])
                path = [key]
                for j, turn in enumerate(flat[at[i] + depth : at[i] + min(size, depth + levels)].tolist(), 1):
                    parents.append(path[-1])
                    paths.append(list(path))
                    path.append(extended(path[-1], turn))
                    keys.append(path[-1])
                    words.append(int(flat_words[words_at[i] + depth + j - 1]))
                    ends.append(end if size == depth + j else None)
                    more.append(size - depth - j)
                    level.append(j)
                    source.append(i)
                    carry.append(i if j == levels else None)
            source, carry = pa.array(source, pa.int64()), pa.array(carry, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), pa.array(paths, pa.list_(pa.binary())), column["conv_id"].take(source), column["n"].take(source), pa.array(words, pa.int64()), pa.array(ends, pa.string()), pa.array(more, pa.int64()), pa.array(level, pa.int32()), *(column[c].take(carry) for c in ("ids", "words", "ends"))],
                names=["key", "parent", "path", "conv_id", "n", "last_words", "node_ends", "more", "level", "ids", "words", "ends"],
            )

    schema = "key binary, parent binary, path array<binary>, conv_id long, n long, last_words long, node_ends string, more long, level int, ids array<long>, words array<int>, ends string"
    return rows.select("key", "conv_id", "n", "ends", "ids", "words").mapInArrow(run, schema)


class Bucket:
    """The nodes of one local bucket, by multikey quicksort of its sequences from a depth on."""

    def __init__(self, depth: int, rows: list[tuple[int, int, str, np.ndarray, np.ndarray]]):
        self.rows = rows
        self.conv: list[int] = []
        self.depth: list[int] = []
        self.parent: list[int] = []
        self.n: list[int] = []
        self.ends: list[str] = []
        self.saved: list[int] = []
        every = list(range(len(rows)))
        root = self.node(every, depth, -1)
        self.sort(self.beyond(every, depth), depth, root)
        size = len(self.conv)
        self.children, self.leaves = [0] * size, [0] * size
        for i in range(size - 1, -1, -1):  # a node comes before those below it
            self.leaves[i] = self.leaves[i] or 1
            if i:
                up = self.parent[i]
                self.children[up] += 1
                self.leaves[up] += self.leaves[i]
                self.saved[up] += self.saved[i]

    def beyond(self, members: list[int], depth: int) -> list[int]:
        return [m for m in members if len(self.rows[m][3]) > depth]

    def node(self, members: list[int], depth: int, parent: int) -> int:
        """A node at a depth; sequences are distinct, so one at most ends there."""
        rows = self.rows
        n = sum(rows[m][1] for m in members)
        self.conv.append(min(rows[m][0] for m in members))
        self.depth.append(depth)
        self.parent.append(parent)
        self.n.append(n)
        self.ends.append(next((rows[m][2] for m in members if len(rows[m][3]) == depth), NO_ENDS))
        self.saved.append((n - 1) * int(rows[members[0]][4][depth - 1]) if depth else 0)
        return len(self.conv) - 1

    def sort(self, members: list[int], depth: int, parent: int) -> None:
        """Split by the turn at depth into smaller, equal and larger ids; equal ones are a node and go one turn on."""
        stack = [(members, depth, parent)] if members else []
        while stack:
            some, d, up = stack.pop()
            if len(some) == 1:  # a chain
                for e in range(d + 1, len(self.rows[some[0]][3]) + 1):
                    up = self.node(some, e, up)
                continue
            digits = [self.rows[m][3][d] for m in some]
            pivot = sorted((digits[0], digits[len(digits) // 2], digits[-1]))[1]
            less, same, greater = [], [], []
            for m, x in zip(some, digits):
                (less if x < pivot else same if x == pivot else greater).append(m)
            for part in (less, greater):
                if part:
                    stack.append((part, d, up))
            own = self.node(same, d + 1, up)
            if rest := self.beyond(same, d + 1):
                stack.append((rest, d + 1, own))

    def batch(self, key: bytes) -> pa.RecordBatch:
        up = [self.conv[p] if p >= 0 else None for p in self.parent]
        numbers = [self.conv, self.depth, up, self.n, self.children, self.leaves, self.saved]
        return pa.RecordBatch.from_arrays([pa.array([key] + [None] * (len(self.conv) - 1), pa.binary()), *(pa.array(x, pa.int64()) for x in numbers), pa.array(self.ends)], names=["key", *(c.split()[0] for c in _NODE.split(", "))])


def _local(rows: DataFrame) -> DataFrame:
    """Nodes of all local buckets; the top node of each has the bucket's key and no parent yet."""
    dealt = rows.select("key", "depth", "conv_id", "n", "ends", "ids", "words").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with quiet_gc():
            now, depth, held = None, 0, []
            for batch in batches:
                column = dict(zip(batch.schema.names, batch.columns))
                arrays = [(x.offsets.to_numpy(), x.values.to_numpy()) for x in (column["ids"], column["words"])]
                for i, (key, d, conv, n, ends) in enumerate(zip(*(column[c].to_pylist() for c in ("key", "depth", "conv_id", "n", "ends")))):
                    if key != now:
                        if held:
                            yield Bucket(depth, held).batch(now)
                        now, depth, held = key, d, []
                    held.append((conv, n, ends, *(flat[at[i] : at[i + 1]] for at, flat in arrays)))
            if held:
                yield Bucket(depth, held).batch(now)

    return dealt.mapInArrow(run, f"key binary, {_NODE}")


def nodes(seqs: DataFrame) -> DataFrame:
    """The trie of sequences (conv_id, ids, words): one row for each node, named by its smallest member and depth."""
    small_batches(seqs.sparkSession)
    whole = written(collapsed(seqs).withColumn("key", F.lit(ROOT)))
    turns, convs, first = whole.agg(F.sum(F.size("ids").cast("long")), F.sum("n"), F.min("conv_id")).head()
    if not convs:
        return seqs.sparkSession.createDataFrame([], _NODE)
    share = min(max(LOCAL_TURNS, turns // BUCKETS), MOST_LOCAL)
    active, depth, levels, rounds, local = whole, 0, 1, [], []
    while active is not None:
        digits = written(_digits(active, depth, levels))
        grouped = digits.groupBy("key").agg(F.any_value("parent").alias("parent"), F.any_value("path").alias("path"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.max("last_words").alias("last_words"), F.max("node_ends").alias("node_ends"), F.sum("more").alias("more"), F.any_value("level").alias("level"), F.count(F.lit(1)).alias("rows"))
        depth_now = F.lit(depth).cast("long") + F.col("level")
        last = F.col("level") == levels
        large = last & (F.col("more") > share) & (F.col("rows") > 1)
        state = F.when(large, "large").when(last & (F.col("more") > 0), "local").otherwise("done")
        found = written(grouped.withColumns({"depth": depth_now, "state": state}))
        depth, sent = depth + levels, found.filter("state = 'large'").select("key")
        n_large = sent.count()
        sent = F.broadcast(sent) if n_large <= MOST_SENT else sent
        carried = digits.filter((F.col("level") == levels) & (F.col("more") >= 0)).select("key", "conv_id", "n", "ends", "ids", "words")
        local.append(carried.join(sent, "key", "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        rounds.append(found)
        active = carried.join(sent, "key", "left_semi") if n_large else None
        levels = min(2 * levels, MOST_LEVELS)
    finished = written(_local(reduce(DataFrame.unionByName, local)))
    tops = finished.filter("key is not null").select("key", F.col("n_children").alias("top_children"), F.col("n_leaves").alias("top_leaves"), F.col("saved_tokens").alias("top_saved"), F.lit(True).alias("top"))
    upper, below = [], None
    for found in reversed(rounds):
        rows = found.join(tops, "key", "left")
        if below is not None:
            rows = rows.join(below, "key", "left")
        else:
            rows = rows.withColumns({c: F.lit(None).cast("long") for c in ("below_children", "below_leaves", "below_saved")})
        own = (F.col("n") - 1) * F.col("last_words")
        leaves = F.when(F.col("top"), F.col("top_leaves")).when(F.col("state") == "large", F.col("below_leaves")).otherwise((F.col("more") == 0).cast("long"))
        saved = F.when(F.col("top"), F.col("top_saved")).otherwise(own + F.coalesce("below_saved", F.lit(0)))
        rows = written(rows.withColumns({"leaves": leaves, "saved": saved}))
        places = F.posexplode(F.concat("path", F.array("key"))).alias("at", "above")
        sums = rows.select(places, "leaves", "saved").groupBy("above").agg(F.min("at").alias("at"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        children = rows.groupBy("parent").agg(F.count(F.lit(1)).alias("children"))
        totals = written(sums.join(children, sums["above"] == children["parent"], "left").select(F.col("above").alias("key"), "at", "leaves", "saved", F.coalesce("children", F.lit(0)).alias("children")))
        within = totals.filter("at > 0").select("key", F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"), "children")
        kept = rows.filter("top is null").join(within, "key")
        upper.append(kept.select("key", "parent", "conv_id", "depth", "n", F.coalesce("below_children", "children").alias("n_children"), F.col("all_leaves").alias("n_leaves"), F.col("all_saved").alias("saved_tokens"), "node_ends"))
        below = totals.filter("at = 0").select("key", F.col("children").alias("below_children"), F.col("leaves").alias("below_leaves"), F.col("saved").alias("below_saved"))
    spark = seqs.sparkSession
    root = spark.createDataFrame([(bytes(ROOT), int(first), int(convs))], "key binary, conv_id long, n long").join(F.broadcast(below.filter(F.col("key") == F.lit(ROOT))) if below is not None else tops, "key", "left")
    ended = F.broadcast(whole.filter(F.size("ids") == 0).select("key", F.col("ends").alias("node_ends")))  # one row at most
    root = root.join(ended, "key", "left").select("key", F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n", F.coalesce("below_children", F.lit(0)).alias("n_children"), F.coalesce("below_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("below_saved", F.lit(0)).alias("saved_tokens"), "node_ends")
    up = reduce(DataFrame.unionByName, [x.select("key", "conv_id", "parent") for x in rounds])
    names = up.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")).unionByName(spark.createDataFrame([(bytes(ROOT), int(first))], "parent binary, parent_conv_id long"))
    above = up.join(names, "parent").select("key", "parent_conv_id")
    high = reduce(DataFrame.unionByName, [root, *upper]).join(above, "key", "left").select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("node_ends", F.lit(NO_ENDS)).alias("ends_sha256"))
    top_rows = finished.filter("key is not null").drop("parent_conv_id").join(above, "key").select(*high.columns)
    return high.unionByName(top_rows).unionByName(finished.filter("key is null").select(*high.columns))


def of_conversations(turns: DataFrame) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text) as they are."""
    small_batches(turns.sparkSession)
    return nodes(sequences(turns))
