"""Complete-linkage clusters of candidates within each article, one canonical row per cluster, and connected components."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.operators.metrics import cumulative
from quern.operators.similarity import block_similarity, least_similarities, similar_pairs
from quern.runtime import cut, ship

#: Nodes up to which a component is clustered on a dense matrix (8 bytes a pair); beyond, on its edges alone.
DENSE = 6000
#: Rows beyond which a group is clustered in steps, pairs that a step is to have, and rows of a part that is shuffled.
LARGE, STEP_PAIRS, PART = 2048, 1_000_000, 4096


def complete_linkage(i: np.ndarray, j: np.ndarray, sim: np.ndarray, dense: int = DENSE) -> dict[int, int]:
    """Cluster (its smallest member) of each node of the edges (i, j, sim), which are the similar pairs; pairs that are no
    edge must stay apart. The most similar two clusters merge first, ties by the smallest members."""
    if not len(i):
        return {}
    nodes, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    of = _dense_linkage(len(nodes), a, b, sim) if len(nodes) <= dense else _sparse_linkage(len(nodes), a, b, sim)
    return dict(zip(nodes.tolist(), nodes[of].tolist()))


def _dense_linkage(n: int, a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """Each row's best partner is kept; after a merger only rows that lost theirs are looked through again."""
    s = np.full((n, n), -np.inf)
    s[a, b] = s[b, a] = sim
    of, partner = np.arange(n), s.argmax(axis=1)
    best = s[of, partner]
    while True:
        i = int(best.argmax())
        if best[i] == -np.inf:
            break
        j = int(partner[i])  # i < j: the smallest row of the best, and its smallest partner
        of[of == j] = i
        s[i] = np.minimum(s[i], s[j])
        s[i, i] = -np.inf
        s[:, i] = s[i]
        s[j] = s[:, j] = -np.inf
        rows = np.flatnonzero((partner == i) | (partner == j) | (np.arange(n) == i) | (np.arange(n) == j))
        partner[rows] = s[rows].argmax(axis=1)
        best[rows] = s[rows, partner[rows]]
    return of


def _sparse_linkage(n: int, a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> np.ndarray:
    near: list[dict[int, float] | None] = [{} for _ in range(n)]
    for x, y, v in zip(a.tolist(), b.tolist(), sim.tolist()):
        near[x][y] = near[y][x] = v
    heap = [(-v, min(x, y), max(x, y)) for x, y, v in zip(a.tolist(), b.tolist(), sim.tolist())]
    heapq.heapify(heap)
    into = np.arange(n)
    while heap:
        v, x, y = heapq.heappop(heap)
        if near[x] is None or near[y] is None or near[x].get(y) != -v:
            continue  # merged away, or no longer their similarity
        left, right = near[x], near[y]
        for k in (left.keys() | right.keys()) - {x, y}:
            near[k].pop(x, None)
            near[k].pop(y, None)
        near[x] = {k: min(left[k], right[k]) for k in left.keys() & right.keys()}
        near[y], into[y] = None, x
        for k, w in near[x].items():
            near[k][x] = w
            heapq.heappush(heap, (-w, min(x, k), max(x, k)))
    for y in range(n):  # a node merges into a smaller one
        into[y] = into[into[y]]
    return into


def clusters(pool: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, i, cluster) of each row of pool (g, i); edges (g, i, j, sim) are the pairs above the threshold, a written table.

    Clusters never reach beyond a connected component of the edges, since all pairs of a cluster are edges. So components
    are found first, distributed, and only the edges of one component meet in a task, not an article's whole pool. Nodes
    go by a hash of group and row; two that share one would only meet in a task, and are told apart there."""
    ship(pool.sparkSession)
    node = lambda c: F.xxhash64("g", c)
    linked = edges.select("g", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "sim", node("i").alias("node"))
    roots = components(edges.select(node("i").alias("a"), node("j").alias("b")))

    def link(key: tuple, table: pa.Table) -> pa.Table:
        names = table["g"].combine_chunks().dictionary_encode()
        group, i, j, sim = names.indices.fill_null(-1).to_numpy(zero_copy_only=False), *(table[c].to_numpy() for c in ("i", "j", "sim"))
        rows: list[tuple] = []
        for g in np.unique(group):
            at = group == g
            name = None if g < 0 else names.dictionary[int(g)].as_py()
            rows += [(name, k, c) for k, c in complete_linkage(i[at], j[at], sim[at]).items()]
        columns = list(zip(*rows))
        kinds = [table.schema.field("g").type, pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["g", "i", "cluster"])

    found = linked.join(roots, "node").select("root", "g", "i", "j", "sim").groupBy("root").applyInArrow(link, f"g {dict(pool.dtypes)['g']}, i long, cluster long")
    whole = pool.select("g", F.col("i").cast("long").alias("i")).alias("p").join(found.alias("f"), F.expr("p.g <=> f.g and p.i = f.i"), "left")
    return whole.select("p.g", "p.i", F.coalesce("f.cluster", "p.i").alias("cluster"))


def clustered(grammed: DataFrame, model: str, theta: float, large: int = LARGE, step_pairs: int = STEP_PAIRS, part: int = PART) -> DataFrame:
    """(g, i, cluster, degree) of the rows of similarity.grams: complete linkage of the pairs above theta within each group,
    and the sum of similarities to the other members. Groups of more than `large` rows are clustered in steps."""
    grammed = cut(grammed.select("g", "i", model, "t"))
    sizes = cut(grammed.where("g is not null").groupBy("g").agg(F.count("*").alias("rows")).where(F.col("rows") > large))
    small = grammed.join(sizes, "g", "left_anti")
    edges = cut(similar_pairs(small, model, theta))
    out = weighted_degrees(cut(clusters(small.select("g", "i"), edges)), edges)
    if sizes.count():
        out = out.unionByName(_clustered_in_steps(grammed.join(sizes, "g"), model, theta, step_pairs, part))
    return out


def _clustered_in_steps(rows: DataFrame, model: str, theta: float, step_pairs: int, part: int) -> DataFrame:
    """clustered for large groups, without a table of their pairs. As the most similar clusters merge first, the mergers above
    a threshold depend on no pair below it. So a step takes the pairs of clusters above a threshold, merges them, and the
    next one has a lower threshold and fewer clusters, of which it needs the least similarities only; the last threshold is
    theta. Similarities are worked out anew in each step. Thresholds come from the pairs within blocks and decide only how
    many pairs a step has, not the clusters."""
    ship(rows.sparkSession)
    groups = cut(rows.select("g", "rows").distinct().coalesce(1).withColumn("n", F.monotonically_increasing_id().cast("int")))
    size = {r.n: r.rows for r in groups.select("n", "rows").collect()}
    # at least 28 tiles, where there are the rows
    parts = F.greatest(F.ceil(F.col("rows") / part), F.least(F.ceil(F.col("rows") / 512), F.lit(7))).cast("int")
    now = cut(rows.drop("rows").join(groups, "g").select("n", "g", "i", F.col(model).alias("model"), "t", parts.alias("parts"), F.col("i").alias("cluster")))
    last = dict.fromkeys(size, np.inf)
    dealt = lambda t: t.withColumn("own", F.pmod(F.xxhash64("cluster"), F.col("parts")).cast("int"))

    def spread(key: tuple, table: pa.Table) -> pa.Table:
        counts = np.zeros(101, np.int64)
        for _, x, y, sim, same in block_similarity(table, key[1].as_py(), key[1].as_py(), True):
            low = least_similarities(x, y, sim, same)[2]
            counts += np.bincount(np.clip(low[low > theta] * 100, 0, 100).astype(int), minlength=101)
            counts[0] += (low > -np.inf).sum() - (low > theta).sum()
        k = np.flatnonzero(counts)
        return pa.Table.from_arrays([pa.array(np.full(len(k), key[0].as_py(), np.int32)), pa.array(k.astype(np.int32)), pa.array(counts[k])], names=["n", "k", "c"])

    while left := [n for n, t in last.items() if t > theta]:
        open_ = now.where(F.col("n").isin(left))
        seen = {n: np.zeros(101) for n in left}
        for r in dealt(open_).groupBy("n", "own").applyInArrow(spread, "n int, k int, c long").groupBy("n", "k").agg(F.sum("c").alias("c")).collect():
            seen[r.n][r.k] = r.c
        number = {r.n: r.c for r in open_.groupBy("n").agg(F.count_distinct("cluster").alias("c")).collect()}
        for n in left:
            above = np.cumsum(seen[n][::-1])[::-1] * (number[n] * (number[n] - 1) / 2 / max(1, seen[n].sum()))
            k = int(np.flatnonzero(np.append(above, 0) <= step_pairs)[0])
            last[n] = max(theta, min(k / 100, last[n] * 0.8))
            if k / 100 <= theta or above[int(theta * 100)] <= step_pairs:
                last[n] = theta
        limit = dict(last)

        def pairs(key: tuple, table: pa.Table) -> pa.Table:
            n, a, b = (x.as_py() for x in key)
            found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for _, x, y, sim, same in block_similarity(table, a, b):
                x, y, low = least_similarities(x, y, sim, same)
                r, c = np.nonzero(low > limit[n])
                found.append((np.minimum(x[r], y[c]), np.maximum(x[r], y[c]), low[r, c]))
            i, j, sim = (np.concatenate(c) for c in zip(*found))
            return pa.Table.from_arrays([pa.array(np.full(len(i), n, np.int32)), pa.array(i), pa.array(j), pa.array(sim)], names=["n", "i", "j", "sim"])

        def link(key: tuple, table: pa.Table) -> pa.Table:
            into = complete_linkage(*(table[c].to_numpy() for c in ("i", "j", "sim")))
            columns = [np.full(len(into), key[0].as_py(), np.int32), np.fromiter(into.keys(), np.int64, len(into)), np.fromiter(into.values(), np.int64, len(into))]
            return pa.Table.from_arrays([pa.array(c) for c in columns], names=["n", "cluster", "into"])

        tiles = dealt(open_).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        tiles = tiles.select("n", "i", "model", "t", "cluster", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
        near = cut(tiles.groupBy("n", "a", "b").applyInArrow(pairs, "n int, i long, j long, sim double"))
        merged = near.groupBy("n").applyInArrow(link, "n int, cluster long, into long")
        now = cut(now.join(merged, ["n", "cluster"], "left").withColumn("cluster", F.coalesce("into", "cluster")).select(*now.columns))

    def degrees(key: tuple, table: pa.Table) -> pa.Table:
        found: list[tuple] = []
        for i, x, y, sim, _ in block_similarity(table, key[1].as_py(), key[1].as_py(), True):
            np.fill_diagonal(sim, 0.0)
            found.append((i, x, np.where(x[:, None] == y, sim, 0.0).sum(axis=1)))
        i, cluster, degree = (np.concatenate(c) for c in zip(*found))
        return pa.Table.from_arrays([pa.array(np.full(len(i), key[0].as_py(), np.int32)), pa.array(i), pa.array(cluster), pa.array(degree)], names=["n", "i", "cluster", "degree"])

    found = dealt(now).groupBy("n", "own").applyInArrow(degrees, "n int, i long, cluster long, degree double")
    return found.join(groups, "n").select("g", "i", "cluster", F.round("degree", 4).alias("degree"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, root) for each node of the edges; root is the smallest node of its component. Large star and small star in
    turn, each round written to the shared folder, until the edges stay the same."""
    state = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).collect()[0]
    now = cut(edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x != y").distinct())
    before = state(now)
    for _ in range(rounds if before[0] else 0):
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("m", "x"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        kept = large.join(low, "x")
        small = kept.select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(kept.select("x", F.col("m").alias("y"))).where("x != y").distinct()
        now, last = cut(small), before
        before = state(now)
        if before == last:
            break
    else:
        if before[0]:
            raise RuntimeError("components didn't settle")
    roots = now.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return roots.unionByName(now.select(F.col("y").alias("node"), F.col("y").alias("root"))).distinct()


def weighted_degrees(clustered: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds to (g, i, cluster) the sum of similarities to the other members, rounded to four places."""
    # alone rows have no edge within their cluster
    joint = clustered.where("cluster != i").select("g", "cluster").distinct()
    several = cut(clustered.join(joint, ["g", "cluster"], "left_semi").select("g", "i", "cluster"))
    a = pairs.join(several, ["g", "i"]).join(several.select("g", F.col("i").alias("j"), F.col("cluster").alias("other")), ["g", "j"]).where("cluster = other")
    ends = a.select("g", F.explode(F.array("i", "j")).alias("i"), "sim").groupBy("g", "i").agg(F.round(F.sum("sim"), 4).alias("degree"))
    return clustered.join(ends, ["g", "i"], "left").fillna(0.0, ["degree"])


def reconcile(members: DataFrame, models: int = 5, min_support: int = 1) -> DataFrame:
    """One row per cluster. members: g, i, cluster, degree, model_key, text, impact, evidence, confidence. The centroid is
    the member of the highest degree, the first of equals; clusters are numbered by their first member."""
    text = F.struct(F.col("text").alias("actionable"), "impact", "evidence", F.col("confidence").alias("centroid_confidence"))
    whole = members.groupBy("g", "cluster").agg(
        F.max_by(text, F.struct("degree", -F.col("i"))).alias("c"),
        F.count_distinct("model_key").alias("support"), F.array_join(F.array_sort(F.collect_set("model_key")), "|").alias("models_present"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.count("*").alias("n_members")
    )
    # clusters are numbered before any is left out, and not in one task an article
    placed = cumulative(cut(whole), [F.col("g"), F.col("cluster")], {"cluster_id": F.lit(1)}, ["g"])
    return placed.where(F.col("support") >= min_support).select(
        F.col("g").alias("article"), F.col("cluster_id").cast("int").alias("cluster_id"), "support", F.concat(F.col("support").cast("string"), F.lit(f"/{models}")).alias("support_fraction"), "models_present", "c.actionable", "c.impact", "c.evidence", "avg_confidence", "c.centroid_confidence", "n_members"
    )


def ranked(reconciled: DataFrame, by: str = "article", last: tuple[str, ...] = ("cluster_id",), name: str = "place") -> DataFrame:
    """Adds each row's place within its article by support, then confidence, highest first, then `last`, which must tell rows
    apart."""
    order = [F.col(by), F.desc("support"), F.desc_nulls_last("avg_confidence"), *map(F.col, last)]
    return cumulative(reconciled, order, {name: F.lit(1)}, [by])
