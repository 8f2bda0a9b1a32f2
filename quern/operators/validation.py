"""Human validation: samples, blinded exports, disagreement and its resolution, repair of metadata."""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quern.functions import text as X
from quern.schema import BAD_TITLE_PATTERN, DOI_PATTERN, NAME_LINE_PATTERN, TASKS


def hash_order(seed: int, key: Column) -> Column:
    """A fixed pseudo-random order of keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified_sample(df: DataFrame, stratum: str, key: str, per_stratum: int, seed: int = 42, strict: bool = False) -> DataFrame:
    """per_stratum rows of each stratum by hash order, numbered H001... in hash order. strict refuses short strata. The rank
    within a stratum is limited in each partition before the shuffle; the numbering sorts the sample only."""
    rows = df.where(F.col(stratum).isNotNull()).withColumn("_h", hash_order(seed, F.col(key)))
    if strict:
        short = rows.groupBy(stratum).count().where(F.col("count") < per_stratum).collect()
        if short:
            raise ValueError(f"too few rows in {sorted(r[0] for r in short)}")
    kept = rows.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key))).where(F.col("_r") <= per_stratum)
    n = F.row_number().over(Window.orderBy("_h", key))
    return kept.withColumn("item_id", F.concat(F.lit("H"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")))).drop("_h", "_r")


def stratum_report(df: DataFrame, strata: DataFrame, stratum: str) -> DataFrame:
    """Rows of each listed stratum, zero included."""
    return strata.select(stratum).join(df.groupBy(stratum).agg(F.count("*").alias("n")), stratum, "left").fillna(0, ["n"])


def blinded(df: DataFrame, shown: list[str], asked: list[str], annotators: list[str]) -> DataFrame:
    """The shown columns and empty answers, once for each annotator."""
    people = F.explode(F.array(*[F.lit(a) for a in annotators])).alias("annotator_id")
    return df.select(*shown, *[F.lit("").alias(c) for c in asked], people)


def latest_answers(df: DataFrame, fields: list[str], item: str = "item_id", annotator: str = "annotator_id", time: str = "submitted_at") -> DataFrame:
    """Each annotator's latest submission for an item, with labels in one spelling."""
    last = df.groupBy(item, annotator).agg(F.max(F.struct(F.col(time), *[X.label(F.col(f)).alias(f) for f in fields])).alias("x"))
    return last.select(item, annotator, *[F.col(f"x.{f}").alias(f) for f in fields])


def two_annotators(answers: DataFrame, fields: list[str], item: str = "item_id", annotator: str = "annotator_id") -> DataFrame:
    """(item, field, a, b) of the first two annotators by name of items that have two."""
    rank = F.row_number().over(Window.partitionBy(item).orderBy(annotator))
    ranked = answers.withColumn("_r", rank).where("_r <= 2")
    long = ranked.select(item, "_r", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])).alias("x")).select(item, "_r", "x.*")
    both = long.groupBy(item, "field").agg(F.max(F.when(F.col("_r") == 1, F.col("v"))).alias("a"), F.max(F.when(F.col("_r") == 2, F.col("v"))).alias("b"))
    return both.where("b is not null")


def annotator_pairs(answers: DataFrame, fields: list[str], item: str = "item_id", annotator: str = "annotator_id") -> DataFrame:
    """(item, r, s, field, a, b) of every two annotators of an item, a before b by name; r and s are their places among the
    item's. Neither side is broadcast: both have a row per answer and field."""
    ranked = answers.withColumn("r", F.row_number().over(Window.partitionBy(item).orderBy(annotator)))
    long = ranked.select(item, "r", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])).alias("x")).select(item, "r", "x.*")
    other = long.select(item, "field", F.col("r").alias("s"), F.col("v").alias("b"))
    return long.join(other.hint("merge"), [item, "field"]).where("r < s").select(item, "r", "s", "field", F.col("v").alias("a"), "b")


def pair_counts(answers: DataFrame, fields: list[str], labels: tuple[str, ...] = ("YES", "NO"), item: str = "item_id", annotator: str = "annotator_id") -> DataFrame:
    """(field, a, b, c): how many pairs of annotator_pairs have labels a and b. No pair is made: an answer counts the item's
    answers of each label before it by name, a missing name last."""
    before = Window.partitionBy(item).orderBy(F.asc_nulls_last(annotator)).rowsBetween(Window.unboundedPreceding, -1)
    cells = [(k, f, a, b) for k, f in enumerate(fields) for a in labels for b in labels]
    seen = answers.where(F.col(item).isNotNull()).select(*fields, *[F.count_if(F.col(f) == a).over(before).alias(f"_{k}_{a}") for k, f in enumerate(fields) for a in labels])
    sums = seen.agg(*[F.sum(F.when(F.col(f) == b, F.col(f"_{k}_{a}"))).alias(f"_{k}_{a}_{b}") for k, f, a, b in cells])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{k}_{a}_{b}").alias("c")) for k, f, a, b in cells]))
    return sums.select(rows.alias("x")).select("x.*").where("c > 0")


def combined(pairs: DataFrame, item: str = "item_id", by: tuple[str, ...] = ("task",)) -> DataFrame:
    """(item, task, field, a, b) from the worklist: a is the first annotator's value, b is NO if anyone says NO, else a's."""
    no = F.bool_or((F.col("a") == "NO") | (F.col("b") == "NO"))
    one = pairs.groupBy(item, *by, "field").agg(F.min_by("a", "r").alias("a"), no.alias("_no"))
    return one.select(item, *by, "field", "a", F.when(F.col("_no"), "NO").otherwise(F.col("a")).alias("b"))


def disagreements(pairs: DataFrame, lead: str, item: str = "item_id") -> DataFrame:
    """All fields of the items in which any field differs and annotator a answered the lead field."""
    worth = pairs.groupBy(item).agg(F.bool_or(F.col("a") != F.col("b")).alias("differ"), F.bool_or((F.col("field") == lead) & (F.col("a") != "")).alias("answered")).where("differ and answered")
    return pairs.join(worth.select(item), item, "left_semi").withColumn("final", F.lit(""))


def worklist(pairs: DataFrame, tasks: dict[str, tuple[str, list[str]]] = TASKS, item: str = "item_id") -> DataFrame:
    """The disagreements of each task among its own fields, by its own lead, with the task's name."""
    parts = [disagreements(pairs.where(F.col("field").isin(fields)), lead, item).withColumn("task", F.lit(task)) for task, (lead, fields) in tasks.items()]
    return reduce(DataFrame.unionByName, parts)


def sheet(work: DataFrame, fields: list[str], item: str = "item_id") -> DataFrame:
    """One row per item and two annotators, with A_, B_ and final_ columns for each field."""
    keys = [c for c in (item, "r", "s") if c in work.columns]
    cells = [F.max(F.when(F.col("field") == f, F.col(c))).alias(f"{n}_{f}") for f in fields for n, c in (("A", "a"), ("B", "b"), ("final", "final"))]
    return work.where(F.col("field").isin(fields)).groupBy(*keys).agg(*cells)


def unresolved(resolved: DataFrame, item: str = "item_id") -> DataFrame:
    """(task, n_items, n_unresolved): items in dispute, and those for which any field fell back."""
    items = resolved.groupBy("task", item).agg(F.bool_or("flagged").alias("f"))
    return items.groupBy("task").agg(F.count("*").alias("n_items"), F.count_if("f").alias("n_unresolved"))


def resolve(sheet: DataFrame) -> DataFrame:
    """final where it is given; else NO if either says NO, else a's value, else NO; flagged where it wasn't given."""
    blank = F.coalesce(F.trim("final"), F.lit("")) == ""
    fallback = F.when((F.col("a") == "NO") | (F.col("b") == "NO"), "NO").otherwise(F.coalesce(F.nullif(F.col("a"), F.lit("")), F.lit("NO")))
    return sheet.withColumn("resolved", F.when(blank, fallback).otherwise(F.trim("final"))).withColumn("flagged", blank)


def override(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `first`, with all that `second` has of the same key in place of their own, nulls and blanks too; columns that
    only `second` has are added, null where it lacks the key."""
    values = [c for c in second.columns if c not in key]
    joined = first.join(second.select(*key, F.struct(*values).alias("_new")), key, "left")
    kept = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in first.columns if c not in key]
    return joined.select(*key, *kept, *[F.col(f"_new.{c}").alias(c) for c in values if c not in first.columns])


def checked_lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join that refuses keys of `left` without a row in `right`."""
    missing = left.join(right, key, "left_anti").limit(1).count()
    if missing:
        raise ValueError(f"a {key} has no counterpart")
    return left.join(right, key)


def positional(left: DataFrame, right: DataFrame, key: str, extra: list[str]) -> DataFrame:
    """left with right's extra columns, matched by row id; refuses different row sets."""
    n = [left.count(), right.count()]
    out = left.join(right.select(key, *extra), key)
    if n[0] != n[1] or left.join(right, key, "left_anti").limit(1).count():
        raise ValueError(f"the inputs have {n[0]} and {n[1]} rows, or other ids")
    return out


def title_candidates(df: DataFrame, key: str, text: str, title: str, document_title: str | None = None, most: int = 5) -> DataFrame:
    """(key, line, query, title): what to look up, and the title to compare hits with. The given title (line -2) and the
    document's (-1) unless they are bad, up to `most` of the page's first lines of more than 15 characters that are no bad
    title, and each such line once more with the first name that one of the next two lines, blank ones included, holds."""
    given = [(-2, title)] + ([(-1, document_title)] if document_title else [])
    own = [df.where(~X.bad_title(F.col(c))).select(key, F.lit(n).alias("line"), X.clean_title(F.col(c)).alias("query"), X.clean_title(F.col(c)).alias("title")) for n, c in given]
    lines = df.select(key, F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), X.strip).alias("ls"))
    # numbered within each page, before any shuffle
    kept = F.slice(F.filter(F.transform("ls", lambda s, i: F.struct(i.alias("line"), s.alias("s"))), lambda x: (F.length(x["s"]) > 15) & ~X.bad_title(x["s"])), 1, most)
    each = lines.select(key, "ls", F.explode(kept).alias("x")).select(key, "ls", "x.line", "x.s")
    near = F.filter(F.slice("ls", F.col("line") + 2, 2), lambda x: x.rlike(NAME_LINE_PATTERN))
    asked = F.array_compact(F.array(F.col("s"), F.when(F.size(near) > 0, F.concat_ws(" ", "s", F.get(near, F.lit(0))))))
    return reduce(DataFrame.unionByName, [*own, each.select(key, "line", F.explode(asked).alias("query"), F.col("s").alias("title"))])


def best_hit(hits: DataFrame, key: str, least: float = 0.55, sure: float = 0.85) -> DataFrame:
    """The hit (key, title, similarity, author_match, ...) of the highest similarity + 0.2 for an author's match, among those
    with a match or of `sure` similarity; kept from `least` similarity on."""
    open_ = hits.where((F.col("author_match") | (F.col("similarity") >= sure)) & (F.col("similarity") >= least))
    score = F.col("similarity") + F.when(F.col("author_match"), 0.2).otherwise(0.0)
    best = open_.groupBy(key).agg(F.max_by(F.struct(*[c for c in hits.columns if c != key]), F.struct(score, "title")).alias("h"))
    return best.select(key, "h.*")


class Library(Protocol):
    """What repair asks of the outside: a file's first pages and document title, a registry by identifier and by search."""

    def page(self, path: str) -> str: ...

    def document_title(self, path: str) -> str: ...

    def by_doi(self, doi: str) -> tuple[str, str] | None: ...

    def search(self, query: str) -> list[dict]: ...


_REPAIRED = [("resolved_title", T.StringType()), ("resolved_id", T.StringType()), ("method", T.StringType()), ("confidence", T.StringType()), ("match_score", T.DoubleType()), ("author_corroborated", T.BooleanType())]


def _bad(title: str) -> bool:
    return len(title) < 6 or bool(re.search(BAD_TITLE_PATTERN, title)) or title.replace(".", "").isdigit()


def repaired(library: Library, path: str, title: str | None, least: float = 0.55, sure: float = 0.85, high: float = 0.9) -> tuple:
    """Title and identifier of one file: by the identifier on its pages if the registry knows it, else by the best hit of a
    search with its candidate titles, else unresolved. A hit counts if one of its authors is named in the first twelve
    lines, which adds 0.2 to its similarity, or if it is alike enough on its own (`sure`)."""
    page = library.page(path) or ""
    found = re.search(DOI_PATTERN, page)
    known = library.by_doi(found[0].rstrip(".,;)")) if found else None
    if known:
        return known[0], known[1], "page", "high", None, None
    old, info = re.sub(r"^\*+|\*+$", "", (title or "").strip()).strip(), (library.document_title(path) or "").strip()
    lines = [x.strip() for x in page.splitlines()]
    asked = [(t, t) for t in (old, info) if not _bad(t)]
    chosen = [(k, x) for k, x in enumerate(lines) if len(x) > 15 and not _bad(x)][:5]
    asked += [(x, x) for _, x in chosen]
    for k, x in chosen:
        asked += [(f"{x} {y}", x) for y in [y for y in lines[k + 1 : k + 3] if re.match(NAME_LINE_PATTERN, y)][:1]]
    byline, best = "\n".join(page.splitlines()[:12]).lower(), None
    for query, t in asked:
        for hit in library.search(query)[:3]:
            if not hit.get("title") or not hit.get("id"):
                continue
            alike = SequenceMatcher(None, t.lower(), hit["title"].lower()).ratio()
            named = any(len(f.strip()) > 2 and f.strip().lower() in byline for f in hit.get("families") or [])
            if (named or alike >= sure) and (best is None or alike + 0.2 * named > best[0]):
                best = (alike + 0.2 * named, alike, named, hit["title"], hit["id"])
    if best and best[1] >= least:
        return best[3], best[4], "search", "high" if best[2] or best[1] >= high else "medium", round(best[1], 3), best[2]
    return old or info or None, "", "unresolved", "low", None, None


def repair_metadata(df: DataFrame, path: str, title: str, library: Callable[[], Library]) -> DataFrame:
    """Adds (resolved_title, resolved_id, method, confidence, match_score, author_corroborated). Each distinct path is looked up
    once, with the smallest of its titles; library makes the outside in each task, and a file that fails is unresolved."""

    def run(batches):
        outside = library()
        for b in batches:
            rows = []
            for p, t in zip(b[path], b[title]):
                try:
                    rows.append((p, *repaired(outside, p, t)))
                except Exception:  # noqa: BLE001
                    rows.append((p, t, "", "unresolved", "low", None, None))
            yield pd.DataFrame(rows, columns=[path, *[n for n, _ in _REPAIRED]])

    schema = T.StructType([df.schema[path], *[T.StructField(n, k) for n, k in _REPAIRED]])
    once = df.where(F.col(path).isNotNull()).groupBy(path).agg(F.min(title).alias(title))
    return df.join(once.mapInPandas(run, schema), path, "left")
