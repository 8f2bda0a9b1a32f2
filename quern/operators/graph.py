"""The bipartite graph of categories and actionables, and search over it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions import text as X
from quern.functions.udfs import encode_vector
from quern.operators.metrics import cumulative, numbered
from quern.runtime import cut, ship
from quern.schema import CATEGORIES


def labelled(final_set: DataFrame) -> DataFrame:
    """(row_id, actionable, impact, evidence, ..., category, pos) of each canonical category of rows with an actionable."""
    rows = final_set.withColumn("actionable", X.collapse(F.col("actionable"))).where("actionable is not null and actionable != ''")
    more = [c for c in ("article_title", "avg_confidence", "support") if c in rows.columns]
    return rows.select("row_id", "actionable", "impact", "evidence", "sound", "precise", *more, F.posexplode(X.canonical_categories(F.col("category"))).alias("pos", "category"))


def merged_actionables(final_set: DataFrame) -> DataFrame:
    """One row per actionable text: its first row's fields, and all its categories in first-seen order."""
    rows = labelled(final_set)
    kept = [c for c in ("impact", "evidence", "sound", "precise", "article_title", "avg_confidence", "support") if c in rows.columns]
    first = rows.groupBy("actionable").agg(F.min("row_id").alias("first_row"), F.min_by(F.struct(*kept), "row_id").alias("m"))
    seen = rows.groupBy("actionable", "category").agg(F.min(F.struct("row_id", "pos")).alias("at"))
    lists = seen.groupBy("actionable").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "category"))), lambda x: x["category"]).alias("categories"))
    return first.join(lists, "actionable").select("actionable", "first_row", "categories", "m.*")


def edges(final_set: DataFrame) -> DataFrame:
    """Distinct (category, actionable) with the first row and place."""
    return labelled(final_set).groupBy("category", "actionable").agg(F.min("row_id").alias("first_row"), F.min(F.struct("row_id", "pos")).alias("_at")).select("category", "actionable", "first_row", F.col("_at.pos").alias("first_pos"))


def category_ids(e: DataFrame) -> DataFrame:
    """C_k by first appearance; there are at most as many as canonical categories."""
    first = e.groupBy("category").agg(F.min(F.struct("first_row", "first_pos")).alias("at"))
    return first.select("category", F.concat(F.lit("C_"), F.row_number().over(Window.orderBy("at"))).alias("id"))


def degrees(e: DataFrame) -> DataFrame:
    return e.groupBy("category").agg(F.count_distinct("actionable").alias("degree"))


def default_category(e: DataFrame, wanted: str) -> str | None:
    """The wanted category if there is an edge to it, else the first by name; there are at most as many as canonical ones."""
    names = sorted(r[0] for r in e.select("category").distinct().limit(len(CATEGORIES)).collect())
    return wanted if wanted in names else names[0] if names else None


def payload(final_set: DataFrame, vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """The graph as frames, with ids in first-seen order and no global sort:
    - categories (id C_k, label, category, size of the label cut to 22 characters);
    - actionables (id A_k, label, their first row's fields, all their categories, the text to search), with the base64
      of their vector if `vectors` (actionable, vector) are given;
    - edges (id E_k, category, actionable, from, to);
    - stats (row_count, actionable_count, category_count, edge_count)."""
    rows, e = labelled(final_set), cut(edges(final_set))
    hubs = category_ids(e).withColumn("label", F.when(F.length("category") <= 22, F.col("category")).otherwise(F.concat(F.substring("category", 1, 20), F.lit("…")))).select("id", "label", "category")
    hubs = cut(hubs)
    placed = numbered(cut(merged_actionables(final_set)), "first_row", "_k")
    nodes = placed.select(F.concat(F.lit("A_"), F.col("_k")).alias("id"), F.concat(F.lit("a"), F.col("_k")).alias("label"), *[c for c in placed.columns if c != "_k"], F.lower(F.coalesce("impact", F.lit(""))).alias("search_blob"))
    if vectors is not None:
        nodes = nodes.join(vectors.select("actionable", encode_vector("vector").alias("embedding")), "actionable", "left")
    nodes = cut(nodes)
    order = [F.col("first_row"), F.col("first_pos")]
    links = cumulative(e, order, {"_k": F.lit(1)}).join(F.broadcast(hubs.select("category", F.col("id").alias("from"))), "category").join(nodes.select("actionable", F.col("id").alias("to")), "actionable")
    links = links.select(F.concat(F.lit("E_"), F.col("_k")).alias("id"), "category", "actionable", "from", "to")
    stats = rows.agg(F.count_distinct("row_id").alias("row_count")).join(nodes.agg(F.count("*").alias("actionable_count"))).join(hubs.agg(F.count("*").alias("category_count"))).join(e.agg(F.count("*").alias("edge_count")))
    return {"categories": hubs, "actionables": nodes, "edges": links, "stats": stats}


def chunks(e: DataFrame, default: str) -> DataFrame:
    """(chunk, actionable): main has the default category's actionables; each other category's chunk has its own that main
    lacks. With chunk_edges a chunk is complete, as it keeps all edges of its category."""
    main = e.where(F.col("category") == default).select("actionable").distinct()
    rest = e.where(F.col("category") != default).select(F.col("category").alias("chunk"), "actionable").distinct().join(main, "actionable", "left_anti")
    return main.select(F.lit("main").alias("chunk"), "actionable").unionByName(rest.select("chunk", "actionable"))


def chunk_edges(e: DataFrame, default: str) -> DataFrame:
    """All edges, each in the chunk of its category."""
    return e.withColumn("chunk", F.when(F.col("category") == default, "main").otherwise(F.col("category")))


def upsert(have: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The rows of `have`, and those of `new` whose key it lacks, once each."""
    return have.unionByName(new.dropDuplicates([key]).join(have.select(key), key, "left_anti").select(*have.columns))


@dataclass
class Query:
    groups: list[list[str]] = field(default_factory=lambda: [[]])
    excludes: list[str] = field(default_factory=list)


def parse_query(raw: str) -> Query:
    """Words, "phrases", OR between groups, -word to exclude, word* (a plain substring)."""
    q = Query()
    for phrase, word in re.findall(r'"([^"]+)"|([^\s"]+)', raw.lower()):
        if phrase:
            q.groups[-1].append(phrase.strip())
        elif word == "or":
            q.groups.append([])
        elif word.startswith("-") and len(word) > 1:
            q.excludes.append(word[1:])
        else:
            q.groups[-1].append(word[:-1] if word.endswith("*") else word)
    return q


def keyword_score(text: Column, q: Query) -> Column:
    """The best group's share of terms that occur in the text; 0 if an excluded one does."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [reduce(lambda a, b: a + b, [low.contains(t).cast("int") for t in g]) / len(g) for g in q.groups if g]
    best = F.greatest(*hits) if len(hits) > 1 else hits[0] if hits else F.lit(0.0)
    return F.when(reduce(lambda a, b: a | b, [low.contains(x) for x in q.excludes], F.lit(False)), 0.0).otherwise(best.cast("double"))


def keyword_search(df: DataFrame, text: str, raw: str) -> DataFrame:
    """Rows with a score above 0."""
    return df.withColumn("score", keyword_score(F.col(text), parse_query(raw))).where("score > 0")


def semantic_search(nodes: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int = 10, least: float = 0.30, block: int = 1000) -> DataFrame:
    """The k nodes most similar to each query (query_id, query_vector) at `least` similarity or more, ties by id. Queries
    come in blocks of about `block`, which are broadcast one at a time as a matrix at length 1; nodes are multiplied with it
    batch by batch, and a task hands on only the k best it has seen of each query. With several blocks each result is
    written, so memory doesn't grow with them. Null vectors, and those without length, are similar to nothing."""
    ship(nodes.sparkSession)
    kind = nodes.schema[id_col].dataType
    source = nodes.where(F.col(vector).isNotNull()).select(id_col, F.col(vector).cast("array<double>").alias("v"))
    schema = T.StructType([queries.schema["query_id"], T.StructField(id_col, kind), T.StructField("similarity", T.DoubleType())])

    def found(some: DataFrame) -> DataFrame:
        rows = some.where("query_vector is not null").select("query_id", F.col("query_vector").cast("array<double>").alias("v")).collect()  # about `block`
        asked = nodes.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], _units([r["v"] for r in rows])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = asked.value
            best_s, best_i = np.zeros((len(names), 0)), np.zeros((len(names), 0), object)
            for whole in batches:
                for b in (whole.slice(x, 4096) for x in range(0, whole.num_rows, 4096)):
                    if not b.num_rows or not len(names):
                        continue
                    ids = np.array(b.column(0).to_pylist(), object)
                    s = np.round(np.maximum(0.0, matrix @ _units(b.column(1).to_pylist(), matrix.shape[1]).T), 6)
                    # candidates of this batch: the k best of each query, and all that tie with the last
                    if s.shape[1] > k:
                        edge = np.partition(s, -k, axis=1)[:, -k][:, None]
                        keep = (s >= np.maximum(edge, least)).any(axis=0)
                        s, ids = s[:, keep], ids[keep]
                    best_s = np.concatenate((best_s, s), axis=1)
                    best_i = np.concatenate((best_i, np.broadcast_to(ids, s.shape)), axis=1)
                    if best_s.shape[1] > 8 * k + 4096:
                        best_s, best_i = _best(best_s, best_i, k)
            best_s, best_i = _best(best_s, best_i, k)
            q, at = np.nonzero(best_s >= least)
            for x in range(0, len(q), 50_000):
                y = slice(x, x + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([names[n] for n in q[y]], to_arrow_type(schema[0].dataType)), pa.array(best_i[q[y], at[y]].tolist(), to_arrow_type(kind)), pa.array(best_s[q[y], at[y]])], names=schema.names)

        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col))
        return source.mapInArrow(run, schema).withColumn("rank", rank).where(F.col("rank") <= k)

    blocks = -(-queries.count() // block)
    if blocks <= 1:
        return found(queries)
    dealt = cut(queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))))
    return reduce(DataFrame.unionByName, [cut(found(dealt.where(F.col("_block") == i).drop("_block"))) for i in range(blocks)])


def _units(vectors: list, wide: int | None = None) -> np.ndarray:
    """Vectors at length 1; those of another length, with nulls or without length are 0."""
    wide = max(map(len, vectors), default=0) if wide is None else wide
    m = np.array([v if len(v) == wide and None not in v else [0.0] * wide for v in vectors], float).reshape(len(vectors), wide)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _best(s: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties by id."""
    if s.shape[1] <= k:
        return s, i
    order = np.argsort(i, axis=1, kind="stable")
    s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def best_by_category(e: DataFrame, scores: DataFrame, passing: DataFrame | None = None) -> DataFrame:
    """The best score of each category's actionables, 0 without one; only actionables of `passing` count, if given."""
    kept = scores.join(passing, "actionable", "left_semi") if passing is not None else scores
    return e.select("category", "actionable").join(kept, "actionable", "left").groupBy("category").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("best_score"))


def visible_actionables(e: DataFrame, passing: DataFrame | None = None, matched: DataFrame | None = None, selected: list[str] | None = None) -> DataFrame:
    """(actionable, visible, direct) of each actionable of the edges: visible if it passes the quality filter, matches the search
    and has a selected category, as far as each is asked for; direct if there is a search that it matches, and it passes."""
    some = e.groupBy("actionable").agg(F.bool_or(F.col("category").isin(selected)).alias("chosen") if selected else F.first(F.lit(True)).alias("chosen"))
    for name, frame in (("passes", passing), ("found", matched)):
        if frame is None:
            some = some.withColumn(name, F.lit(True))
        else:
            some = some.join(frame.select("actionable").distinct().withColumn(name, F.lit(True)), "actionable", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    direct = F.col("passes") & F.col("found") if matched is not None else F.lit(False)
    return some.select("actionable", (F.col("chosen") & F.col("passes") & F.col("found")).alias("visible"), direct.alias("direct"))


def visible_categories(e: DataFrame, nodes: DataFrame, searching: bool, selected: list[str] | None = None, loaded: list[str] | None = None) -> DataFrame:
    """(category, visible): a category is visible with any of its actionables; one that isn't loaded is visible unless there is a
    search, or a selection without it."""
    some = e.join(nodes, "actionable").groupBy("category").agg(F.bool_or("visible").alias("any"))
    free = F.lit(not searching) & (F.col("category").isin(selected) if selected else F.lit(True))
    return some.select("category", F.when(F.col("category").isin(loaded) if loaded is not None else F.lit(True), F.col("any")).otherwise(free).alias("visible"))


def visibility(e: DataFrame, passing: DataFrame | None = None, matched: DataFrame | None = None, selected: list[str] | None = None, loaded: list[str] | None = None) -> DataFrame:
    """(category, actionable, visible, direct) of each edge: visible if both its ends are, direct if its actionable is."""
    nodes = cut(visible_actionables(e, passing, matched, selected))
    hubs = visible_categories(e, nodes, matched is not None, selected, loaded).withColumnRenamed("visible", "_hub")
    joined = e.select("category", "actionable").join(nodes, "actionable").join(F.broadcast(hubs), "category")  # at most one row a canonical category
    return joined.select("category", "actionable", (F.col("visible") & F.col("_hub")).alias("visible"), "direct")


def category_frame(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CATEGORIES, 1)), "number int, category string")
