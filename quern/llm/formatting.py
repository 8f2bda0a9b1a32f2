"""Duplicates hidden by formatting: one record per content, with its number of copies.

The content of a record is its fields, each without every character that isn't a letter or digit and lower-cased, in
sorted order, as bytes. Counting them takes three passes:

1. Within each input task, a trie with terminal counters collapses copies into partials (content, count, smallest id,
   other ids). It is emptied at `partial_rows` rows or `partial_bytes` bytes, so a hot group leaves partials of bounded size.
2. Recursive radix partitioning of the partials: buckets by the first bytes; a bucket of more than `bucket_rows`
   partials is split by the bytes behind what all its contents have in common, until each fits. A level's splits are a
   table, broadcast up to MAX_BROADCAST of them and joined by shuffle beyond; only the partials of oversized buckets go on
   to the next level, which is written. A bucket of one content only can't be split; it is merged by an aggregate with
   partial sums instead.
3. Each bucket's partials meet in one trie, whose terminal counters give the group's smallest id and size to each
   partial. Ids of copies never gather in one place: they stay in their partials and are joined by partial number.

Defined cases: null fields count as empty, so records without any letter or digit are copies of one another; rows with
a null id are left out; a repeated id counts as a copy each time but isn't listed as a copy of itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quern import runtime

_STEP = 8  # bytes an edge of the trie
#: Splits of a level up to which they are broadcast (a prefix and two numbers each).
MAX_BROADCAST = 20_000


class CountTrie:
    """Terminals by bytes. Edges hold eight bytes; a leaf keeps its whole key and moves down when another key joins it."""

    def __init__(self) -> None:
        self.root: dict = {}

    def terminal(self, key: bytes) -> list:
        """The terminal [key, ...] of a key; of length 1 when it is new."""
        node, at = self.root, 0
        while True:
            edge = key[at : at + _STEP]
            below = node.get(edge)
            at += _STEP
            if below is None:
                node[edge] = leaf = [key]
                return leaf
            if type(below) is list:
                if below[0] == key:
                    return below
                node[edge] = node = {below[0][at : at + _STEP]: below}
            else:
                node = below

    def terminals(self) -> Iterator[list]:
        stack = [self.root]
        while stack:
            for below in stack.pop().values():
                if type(below) is list:
                    yield below
                else:
                    stack.append(below)


def canonical(fields: list[str]):
    """The content of a record, as binary."""
    bare = [F.lower(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[^\p{L}\p{N}]+", "")) for c in fields]
    return F.array_join(F.sort_array(F.array(*bare)), "\n").cast("binary")


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


class Copies:
    """The stages of the operator. result: (uid, keep_id, n_copies) of each partial."""

    def __init__(self, df: DataFrame, id_col: str, fields: list[str], bucket_rows: int = 16_384, partial_rows: int = 200_000, partial_bytes: int = 64 << 20, step: int = 4) -> None:
        runtime.ship(df.sparkSession)
        self.id_col, self.spark = id_col, df.sparkSession
        self.bucket_rows, self.step = bucket_rows, step
        rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), canonical(fields).alias("content"))

        def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, number = TaskContext.get().partitionId(), 0

            def out(trie: CountTrie) -> Iterator[pa.RecordBatch]:
                nonlocal number
                held: list[list] = []
                size = 0
                for t in trie.terminals():
                    held.append(t)
                    size += len(t[0]) + 8 * len(t[2])
                    if size > 16 << 20:
                        yield rows_of(held)
                        held, size = [], 0
                if held:
                    yield rows_of(held)

            def rows_of(held: list[list]) -> pa.RecordBatch:
                nonlocal number
                uid = [part << 36 | number + i for i in range(len(held))]
                number += len(held)
                columns = [pa.array(uid, pa.int64()), pa.array([t[1] for t in held], pa.int64()), pa.array([len(t[2]) + 1 for t in held], pa.int64()), pa.array([t[2] for t in held], pa.list_(pa.int64())), pa.array([t[0] for t in held], pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=["uid", "keep", "n", "others", "content"])

            trie, count, size = CountTrie(), 0, 0
            for b in batches:
                for i, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    t = trie.terminal(key)
                    count += 1
                    if len(t) == 1:
                        t += [i, []]
                        size += len(key)
                    elif i < t[1]:
                        t[2].append(t[1])
                        t[1] = i
                    else:
                        t[2].append(i)
                if count > partial_rows or size > partial_bytes:
                    yield from out(trie)
                    trie, count, size = CountTrie(), 0, 0
            yield from out(trie)

        self.partials = runtime.cut(rows.mapInArrow(collapse, "uid long, keep long, n long, others array<long>, content binary"))
        self.result = runtime.cut(self._merge())

    def _level(self, cur: DataFrame) -> DataFrame:
        """The oversized buckets of a level: (prefix, next), next being the bytes of the next prefix, or null for one content."""
        buckets = cur.groupBy("prefix").agg(F.count("*").alias("c"), F.min("content").alias("low"), F.max("content").alias("high"))
        step = self.step

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                longer = [None if x == y else _shared(x, y) + step for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(longer, pa.int32())], names=["prefix", "next"])

        return runtime.cut(buckets.where(F.col("c") > self.bucket_rows).select("prefix", "low", "high").mapInArrow(split, "prefix binary, next int"))

    def plan(self) -> tuple[DataFrame, DataFrame | None, int]:
        """Partials with the bucket that fits them, those of contents that alone fill a bucket, and the levels of splits."""
        cur = self.partials.select("uid", "keep", "n", "content", F.substring("content", F.lit(1), F.lit(self.step)).alias("prefix"))
        fitting, alone, levels = [], [], 0
        while True:
            over = self._level(cur)
            n = over.count()
            if not n:
                fitting.append(cur)
                return reduce(DataFrame.unionByName, fitting), reduce(DataFrame.unionByName, alone) if alone else None, levels
            over = F.broadcast(over) if n <= MAX_BROADCAST else over
            fitting.append(cur.join(over.select("prefix"), "prefix", "left_anti"))
            alone.append(cur.join(over.where("next is null").select("prefix"), "prefix").select("uid", "keep", "n", "content"))
            cur = runtime.cut(cur.join(over.where("next is not null"), "prefix").select("uid", "keep", "n", "content", F.substring("content", F.lit(1), F.col("next")).alias("prefix")))
            levels += 1

    def _merge(self) -> DataFrame:
        fitting, alone, self.levels = self.plan()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(held: list[tuple[int, list]]) -> pa.RecordBatch:
                columns = [[u for u, _ in held], [t[1] for _, t in held], [t[2] for _, t in held]]
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["uid", "keep_id", "n_copies"])

            trie, now, held = CountTrie(), None, []
            for b in batches:
                uid, keep, n, content, bucket = (b.column(i).to_pylist() for i in range(5))
                for u, k, m, key, at in zip(uid, keep, n, content, bucket):
                    if at != now:
                        if len(held) > 20_000:
                            yield out(held)
                            held = []
                        trie, now = CountTrie(), at
                    t = trie.terminal(key)
                    if len(t) == 1:
                        t += [k, m]
                    else:
                        t[1], t[2] = min(t[1], k), t[2] + m
                    held.append((u, t))
            if held:
                yield out(held)

        parts = max(runtime.slices(self.spark), 12)
        bucketed = fitting.select("uid", "keep", "n", "content", F.col("prefix").alias("bucket")).repartition(parts, "bucket").sortWithinPartitions("bucket")
        result = bucketed.mapInArrow(count, "uid long, keep_id long, n_copies long")
        if alone is not None:
            alone = runtime.cut(alone)
            whole = runtime.cut(alone.groupBy("content").agg(F.min("keep").alias("keep_id"), F.sum("n").alias("n_copies")))
            whole = F.broadcast(whole) if whole.count() <= MAX_BROADCAST else whole  # at most partials / bucket_rows
            result = result.unionByName(alone.join(whole, "content").select("uid", "keep_id", "n_copies"))
        return result

    def found(self) -> DataFrame:
        """(keep_id, id) of each copy but the one that is kept."""
        joined = self.result.where("n_copies > 1").join(self.partials.select("uid", "keep", "others"), "uid")
        copies = joined.select("keep_id", F.explode(F.concat("others", F.array("keep"))).alias(self.id_col))
        return copies.where(F.col("keep_id") != F.col(self.id_col))

    def contents(self) -> DataFrame:
        """(keep_id, n_copies) of each content."""
        return self.result.join(self.partials.select("uid", "keep"), "uid").where("keep = keep_id").groupBy("keep_id").agg(F.max("n_copies").alias("n_copies"))
