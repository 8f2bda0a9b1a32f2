"""Near-duplicate records: groups of records whose word sets overlap by a threshold of Jaccard similarity.

1. Records with the same word set form a class; one representative each goes on (copies are never compared).
2. A representative gets a sketch of 112 bits: each word flips one bit. The Hamming distance of two sketches never
   exceeds the number of words in which the sets differ, so a similarity of t bounds it by (1-t)/(1+t) * (|A|+|B|).
3. Representatives are dealt into shards by bands of MinHashes. A band has `rows` MinHashes, five up to four million
   classes and one more for each tenfold, so that what unrelated records share by chance stays a few; there are as many bands
   as let a pair at the threshold share none with a probability of `miss` at most, whatever the size.
   A band that more than `shard_rows` representatives share is crowded: its members are dealt on by a second set of
   bands among themselves. What is still crowded then is split into parts, and the tree of each part meets the queries
   of each part.
4. Each shard's sketches become a BK-tree: children are keyed by their integer Hamming distance to the parent, and a
   search follows only edges within the radius (triangle inequality), so within a shard no pair is lost. An edge with few
   descendants keeps them as a list instead of a subtree. The trees of all shards of a task are built and searched
   together, level by level, on arrays.
5. Pairs found are verified on the word sets themselves.

No cap on candidates. Which bands are crowded is told from every 16th representative; it decides only how work is dealt.

Defined cases: null fields count as empty; records without any word are in no pair and in groups of their own; rows
with a null id are left out; a repeated id stands for each of its rows, and is never paired with itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern import runtime
from quern.operators.cluster import components

_BITS, _N_SHIFT = 112, 48  # a sketch fills two numbers but for 16 bits, which hold the size of the set
#: Crowded bands up to which they are broadcast (8 bytes each); beyond, they are split without a second set of bands.
MAX_BROADCAST = 2_000_000
#: Rows of a class from which its number is broadcast to them, and rows of a class that meet in a task.
_HEAVY, _TOGETHER = 100_000, 2048
_U = np.uint64


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x ^ _U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values as unsigned) of a list column without nulls."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy()[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.int64)
    return offsets - offsets[0], values.view(np.uint64)


def word_sets(df: DataFrame, fields: list[str]) -> "F.Column":
    """The sorted hashes of the distinct words (runs of letters and digits, lower-cased) of the fields together."""
    text = F.lower(F.concat_ws(" ", *fields))
    words = F.array_distinct(F.split(text, r"[^\p{L}\p{N}]+"))
    return F.sort_array(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def sketches(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """112 bits a record, as two 64-bit numbers; the highest 16 of the second are 0."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    bit = ((_mix(values, 1) >> _U(32)) * _U(_BITS) >> _U(32)).astype(np.int64)
    bits = np.bincount(row * 128 + bit, minlength=n * 128).astype(np.uint8) & 1
    return np.packbits(bits.reshape(n, 128), axis=1).view(np.uint64).reshape(n, 2)


def minhash_keys(offsets: np.ndarray, values: np.ndarray, bands: int, rows: int, seed: int = 20) -> np.ndarray:
    """One key a record and band; records must not be empty."""
    n, rng = len(offsets) - 1, np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, size=(bands, rows), dtype=np.uint64) * _U(2) + _U(1)
    shifts = rng.integers(0, 1 << 63, size=(bands, rows), dtype=np.uint64)
    base, keys, starts = _mix(values, 2), np.zeros((n, bands), np.uint64), offsets[:-1]
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(n, b, np.uint64)
            for r in range(rows):
                key = _mix(key ^ np.minimum.reduceat((base ^ shifts[b, r]) * factors[b, r], starts), 3)
            keys[:, b] = key
    return keys


def banding(classes: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bands, MinHashes a band) for a number of classes; a pair at the threshold shares no band with at most `miss`."""
    rows = 5 + max(0, math.ceil(math.log10(max(classes, 1) / 4e6)))
    return (1 if threshold == 1 else math.ceil(math.log(miss) / math.log(1 - threshold**rows))), rows


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, 0] ^ b[:, 0]).astype(np.int64) + np.bitwise_count(a[:, 1] ^ b[:, 1])


class Forest:
    """BK-trees of several shards. sketch: (n, 2); shard: ascending shard numbers from 0 of the rows. An edge below which
    there are at most `leaf` rows holds them as a list; the lists of a node's edges lie side by side."""

    def __init__(self, sketch: np.ndarray, shard: np.ndarray, shards: int, leaf: int = 32) -> None:
        self.sketch = sketch
        n = len(sketch)
        first = np.searchsorted(shard, np.arange(shards))
        there = (first < n) & (shard[np.minimum(first, max(n - 1, 0))] == np.arange(shards)) if n else np.zeros(shards, bool)
        self.root = np.where(there, first, -1)
        rest = np.ones(n, bool)
        rest[first[there]] = False
        pending, at = np.flatnonzero(rest), self.root[shard[rest]]
        nodes, listed = ([], []), ([], [])  # (parent * 256 + edge, row)
        while len(pending):
            link = at * 256 + _distance(sketch[pending], sketch[at])
            order = np.argsort(link, kind="stable")
            pending, link = pending[order], link[order]
            begins = np.flatnonzero(np.concatenate(([True], link[1:] != link[:-1])))
            width = np.diff(np.append(begins, len(link)))
            many = np.repeat(width > leaf, width)
            listed[0].append(link[~many])
            listed[1].append(pending[~many])
            heads = begins[width > leaf]
            nodes[0].append(link[heads])
            nodes[1].append(pending[heads])
            below = many.copy()
            below[heads] = False
            at = np.repeat(pending[heads], width[width > leaf] - 1)
            pending = pending[below]
        self.links, self.children = self._ordered(*nodes)
        self.edges, self.rows = self._ordered(*listed)
        self.listed = sketch[self.rows]

    @staticmethod
    def _ordered(links: list[np.ndarray], rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        links, rows = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (links, rows))
        order = np.argsort(links, kind="stable")
        return links[order], rows[order]

    @staticmethod
    def _spans(low: np.ndarray, high: np.ndarray, block: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """The numbers low..high-1 of each range, in pieces of about `block`: (first range, end, widths, numbers)."""
        width = high - low
        total = np.concatenate(([0], np.cumsum(width)))
        begin = 0
        while begin < len(low):
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + block, "right")) - 1)
            if total[end] > total[begin]:
                w = width[begin:end]
                yield begin, end, w, np.repeat(low[begin:end] - (total[begin:end] - total[begin]), w) + np.arange(total[end] - total[begin])
            begin = end

    def search(self, query: np.ndarray, shard: np.ndarray, radius: np.ndarray, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query number, row, distance) of all rows of the query's shard within its radius."""
        root = self.root[shard]
        number = np.flatnonzero(root >= 0)
        stack = [(number[i : i + block], root[number][i : i + block]) for i in range(0, len(number), block)]
        while stack:
            q, at = stack.pop()
            d = _distance(query[q], self.sketch[at])
            near = d <= radius[q]
            if near.any():
                yield q[near], at[near], d[near]
            least, most = at * 256 + np.maximum(d - radius[q], 0), at * 256 + np.minimum(d + radius[q], 255)
            for begin, end, w, found in self._spans(np.searchsorted(self.edges, least), np.searchsorted(self.edges, most, "right"), block):
                asks = np.repeat(q[begin:end], w)
                d = _distance(query[asks], self.listed[found])
                near = np.flatnonzero(d <= radius[asks])
                if len(near):
                    yield asks[near], self.rows[found[near]], d[near]
            for begin, end, w, found in self._spans(np.searchsorted(self.links, least), np.searchsorted(self.links, most, "right"), block):
                stack.append((np.repeat(q[begin:end], w), self.children[found]))


def near_pairs(key: np.ndarray, side: np.ndarray, uid: np.ndarray, size: np.ndarray, sketch: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
    """Pairs of uids, smaller first, that share a key (ascending) and whose sketches allow the threshold. side: 0 where
    a row is in the tree and asks too, 1 where it is only in the tree, 2 where it only asks."""
    shard = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
    in_tree, asks = side != 2, side != 1
    tree, ask = np.flatnonzero(in_tree), np.flatnonzero(asks)
    if not len(tree) or not len(ask):
        return
    slack = (1 - threshold) / (1 + threshold)
    forest = Forest(sketch[tree], shard[tree], int(shard[-1]) + 1)
    radius = np.floor(slack * (size[ask] + np.minimum(size[ask] / threshold, size.max())) + 1e-9).astype(np.int64)
    for q, at, d in forest.search(sketch[ask], shard[ask], radius):
        q, at = ask[q], tree[at]
        good = (d <= slack * (size[q] + size[at]) + 1e-9) & ((side[q] != 0) & (uid[q] != uid[at]) | (uid[q] < uid[at]))
        if good.any():
            a, b = uid[q[good]], uid[at[good]]
            yield np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)


class NearDuplicates:
    """The stages of the operator; members: (id, cid, n) of each row's class, sets: (uid, words, n) of each class, links:
    pairs of classes."""

    def __init__(self, df: DataFrame, id_col: str, fields: list[str], threshold: float = 0.8, miss: float = 5e-4, shard_rows: int = 4096) -> None:
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be in (0, 1]")
        runtime.ship(df.sparkSession)
        self.spark, self.id_col, self.threshold, self.shard_rows = df.sparkSession, id_col, threshold, shard_rows
        base = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), word_sets(df, fields).alias("words"))
        base = base.select(F.monotonically_increasing_id().alias("uid"), "id", "words", F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), F.reverse("words")).alias("k2"))
        base = runtime.cut(base)
        classes = runtime.cut(base.groupBy("k1", "k2").agg(F.min("uid").alias("cid"), F.count("*").alias("n")))
        keyed = base.select("id", "k1", "k2")
        # the rows of a much repeated text stay where they are: at most rows / _HEAVY classes are broadcast to them
        heavy, light = classes.where(F.col("n") >= _HEAVY), classes.where(F.col("n") < _HEAVY)
        members = keyed.join(light, ["k1", "k2"])
        if heavy.limit(1).count():
            members = keyed.join(F.broadcast(heavy.select("k1", "k2")), ["k1", "k2"], "left_anti").join(light, ["k1", "k2"]).unionByName(keyed.join(F.broadcast(heavy), ["k1", "k2"]))
        self.members = runtime.cut(members.select("id", "cid", "n"))
        self.sets = runtime.cut(base.where(F.size("words") > 0).select("uid", "words").join(classes.select(F.col("cid").alias("uid"), "n"), "uid"))
        self.bands, self.rows = banding(self.sets.count(), threshold, miss)
        self.links = runtime.cut(self._links())

    def _keyed(self, sets: DataFrame, crowded: np.ndarray) -> DataFrame:
        """(key, uid, s0, s1) of each representative and band; in crowded bands, of each of the second set of bands."""
        bands, rows = self.bands, self.rows
        crowded = self.spark.sparkContext.broadcast(crowded)

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            split = crowded.value
            for whole in batches:
                for b in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                    offsets, values = _lists(b.column(1))
                    uid, sketch = b.column(0).to_numpy(), sketches(offsets, values)
                    sketch[:, 1] |= np.minimum(np.diff(offsets), 65535).astype(np.uint64) << _U(_N_SHIFT)
                    key = minhash_keys(offsets, values, bands, rows).ravel()
                    at = np.repeat(np.arange(len(uid)), bands)
                    if len(split) and (hot := np.isin(key, split)).any():
                        some, of = np.unique(at[hot], return_inverse=True)
                        more = minhash_keys(offsets, values, bands, rows, 21)[some]
                        key = np.concatenate((key[~hot], _mix(key[hot][:, None] ^ _mix(more[of], 5), 6).ravel()))
                        at = np.concatenate((at[~hot], np.repeat(at[hot], bands)))
                    parts = [key.view(np.int64), uid[at], sketch[at, 0].view(np.int64), sketch[at, 1].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["key", "uid", "s0", "s1"])

        return sets.select("uid", "words").mapInArrow(keys, "key long, uid long, s0 long, s1 long")

    def _crowded(self, crowded: np.ndarray) -> DataFrame:
        """(key, parts) of the bands with more than about shard_rows representatives."""
        every = max(1, min(16, self.shard_rows // 256))
        some = self.sets if every == 1 else self.sets.where(F.pmod(F.xxhash64("uid"), F.lit(every)) == 0)
        counts = self._keyed(some, crowded).groupBy("key").agg(F.count("*").alias("c"))
        return runtime.cut(counts.where(F.col("c") * every > self.shard_rows).select("key", F.ceil(F.col("c") * every / self.shard_rows).cast("int").alias("parts")))

    def _links(self) -> DataFrame:
        threshold = self.threshold
        hot, split = self._crowded(np.zeros(0, np.uint64)), np.zeros(0, np.uint64)
        n_hot = hot.count()
        if 0 < n_hot <= MAX_BROADCAST:
            split = np.sort(np.array([r["key"] for r in hot.select("key").collect()], np.int64).view(np.uint64))
            hot = self._crowded(split)
            n_hot = hot.count()
        sharded = self._keyed(self.sets, split)
        rest = sharded.withColumn("side", F.lit(0).cast("byte"))
        if n_hot:
            hot = F.broadcast(hot) if n_hot <= MAX_BROADCAST // 4 else hot
            part = F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")
            hot_rows = sharded.join(hot, "key").withColumn("own", part)
            # part i meets part j for i <= j: its rows are in the tree of (i, j) for j > i, ask in (j, i) for j < i, and do both in (i, i)
            hot_rows = hot_rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            hot_rows = hot_rows.select(
                F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "uid", "s0", "s1",
                F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte").alias("side"),
            )
            rest = rest.join(hot, "key", "left_anti").unionByName(hot_rows)
        shards = max(runtime.slices(self.spark), 12)

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low = _U((1 << _N_SHIFT) - 1)

            def run(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
                key, uid, s0, s1, side = rows
                keep = np.ones(len(key), bool)
                if len(key) > 1:
                    same = key[1:] == key[:-1]
                    keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
                if not keep.any():
                    return
                second = s1[keep].view(np.uint64)
                sketch = np.stack((s0[keep].view(np.uint64), second & low), axis=1)
                for found in near_pairs(key[keep], side[keep], uid[keep], (second >> _U(_N_SHIFT)).astype(np.int64), sketch, threshold):
                    for i in range(0, len(found), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(found[i : i + 50_000, k]) for k in (0, 1)], names=["a", "b"])

            held: list[np.ndarray] | None = None
            for b in batches:
                new = [b.column(i).to_numpy() for i in range(5)]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
                if len(held[0]) < 60_000:
                    continue
                end = int(np.searchsorted(held[0], held[0][-1]))  # the last shard may go on
                yield from run([x[:end] for x in held])
                held = [x[end:] for x in held]
            if held is not None:
                yield from run(held)

        found = runtime.cut(rest.repartition(shards, "key").sortWithinPartitions("key").mapInArrow(pairs, "a long, b long").distinct())
        # only the sets of pairs that are left go to them
        ids = found.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
        sets = runtime.cut(self.sets.join(ids, "uid", "left_semi"))
        side = lambda k: sets.select(F.col("uid").alias(k), F.col("words").alias(f"w{k}"), F.col("n").alias(f"n{k}"))
        checked = found.join(side("a"), "a").join(side("b"), "b").withColumn("both", F.size(F.array_intersect("wa", "wb"))).withColumn("either", F.size("wa") + F.size("wb") - F.col("both"))
        # in whole numbers, so that a pair exactly at the threshold is in
        least = Fraction(str(threshold)).limit_denominator(10**6)
        return checked.where(F.col("both").cast("long") * least.denominator >= F.col("either").cast("long") * least.numerator).select("a", "b", "na", "nb", "both", "either")

    def pairs(self) -> DataFrame:
        """All pairs of rows (row_id_a, row_id_b), smaller first; copies are expanded, as each pair is a case. The rows of a
        large class meet in parts of _TOGETHER."""
        parts = lambda n: F.ceil(F.col(n) / _TOGETHER).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
        dealt = self.members.select("id", "cid", "n", F.pmod(F.xxhash64("id"), parts("n")).cast("int").alias("s"))
        filled = dealt.where("n > 1").join(self.sets.where("n > 1").select(F.col("uid").alias("cid")), "cid", "left_semi")
        left = filled.select("cid", F.col("id").alias("ia"), every("n").alias("s"))
        within = left.join(filled.select("cid", "s", F.col("id").alias("ib")), ["cid", "s"]).where("ia < ib").select("ia", "ib")
        side = lambda k: dealt.select(F.col("cid").alias(k), F.col("s").alias(f"s{k}"), F.col("id").alias(f"i{k}"))
        links = self.links.select("a", "b", "nb", every("na").alias("sa")).join(side("a"), ["a", "sa"]).select("b", "ia", every("nb").alias("sb"))
        across = links.join(side("b"), ["b", "sb"]).where("ia != ib").select(F.least("ia", "ib").alias("ia"), F.greatest("ia", "ib").alias("ib"))
        return within.unionByName(across).select(F.col("ia").alias(f"{self.id_col}_a"), F.col("ib").alias(f"{self.id_col}_b"))

    def groups(self) -> DataFrame:
        """(id, class_id, group_id, n_links) of each row: the smallest ids of its class of equal texts and of its group of
        linked classes, and the number of other texts its own is linked with."""
        group = components(self.links.select("a", "b"))
        degree = self.links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links"))
        classes = self.members.groupBy("cid").agg(F.min("id").alias("class_id"), F.max("n").alias("n"))
        named = classes.join(group.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")).join(degree, "cid", "left")
        roots = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
        named = runtime.cut(named.join(roots, "root").select("cid", "n", "class_id", "group_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
        heavy = F.broadcast(named.where(F.col("n") >= _HEAVY).drop("n"))  # at most rows / _HEAVY
        light = self.members.where(F.col("n") < _HEAVY).select("id", "cid").join(named.where(F.col("n") < _HEAVY).drop("n"), "cid")
        whole = light.unionByName(self.members.where(F.col("n") >= _HEAVY).select("id", "cid").join(heavy, "cid"))
        return whole.select(F.col("id").alias(self.id_col), "class_id", "group_id", "n_links")
