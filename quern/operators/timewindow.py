"""Trailing windows of project features, and the recommendations they call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.runtime import cut


def low_features(features: DataFrame, project: str, month: str, names: list[str], trailing: int = 2, months: DataFrame | None = None) -> DataFrame:
    """(project, month, feature) where the sum over month - trailing .. month is at most the project's mean of all months.

    Months asked for are those present unless `months` (project, month) is given; a month without rows in its frame has
    sum 0. Values are summed as given: pass whole numbers (cents) where equality matters."""
    long = features.select(F.col(project).alias("project"), F.col(month).cast("int").alias("month"), F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in names])).alias("x")).select("project", "month", "x.*")
    monthly = long.groupBy("project", "feature", "month").agg(F.sum("v").alias("v"), F.count("v").alias("c"))
    mean = monthly.groupBy("project", "feature").agg(F.sum("v").alias("total"), F.sum("c").alias("n"))
    if months is None:
        frame = Window.partitionBy("project", "feature").orderBy("month").rangeBetween(-trailing, 0)
        framed = monthly.withColumn("recent", F.sum("v").over(frame)).select("project", "feature", "month", "recent")
    else:
        asked = months.select(F.col(project).alias("project"), F.col(month).cast("int").alias("asked")).distinct()
        # each month feeds the frames of the next ones: an equi-join instead of a range join
        fed = monthly.withColumn("asked", F.explode(F.sequence(F.col("month"), F.col("month") + trailing))).groupBy("project", "feature", "asked").agg(F.sum("v").alias("recent"))
        framed = asked.join(mean.select("project", "feature"), "project").join(fed, ["project", "feature", "asked"], "left").fillna(0, ["recent"]).withColumnRenamed("asked", "month")
    return framed.join(mean, ["project", "feature"]).where(F.col("recent") * F.col("n") <= F.col("total")).select("project", "month", "feature", "recent", (F.col("total") / F.col("n")).alias("mean"))


def importance(features: Column) -> Column:
    """The number of blank-separated words."""
    return F.size(F.filter(F.split(F.coalesce(features, F.lit("")), r"\s+"), lambda x: x != "")).cast("long")


def feature_list(features: Column) -> Column:
    """The parts between commas."""
    return F.filter(F.transform(F.split(F.coalesce(features, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def _matched(low: DataFrame, actionables: DataFrame, id_col: str, features: str) -> tuple[DataFrame, DataFrame]:
    """(project, month, set of low features), and the actionables (set, id, importance) that share a feature with each distinct
    set: there are few sets, so actionables meet them instead of every project and month."""
    sets = cut(low.groupBy("project", "month").agg(F.array_join(F.sort_array(F.collect_set("feature")), "\n").alias("lacks")))
    items = actionables.select(F.col(id_col).alias("id"), importance(F.col(features)).alias("importance"), F.explode(F.array_distinct(feature_list(F.col(features)))).alias("feature"))
    kinds = sets.select("lacks").distinct().select("lacks", F.explode(F.split("lacks", "\n")).alias("feature"))
    return sets, kinds.join(items, "feature").select("lacks", "id", "importance").distinct()


def recommend(low: DataFrame, actionables: DataFrame, id_col: str, features: str) -> DataFrame:
    """(project, month, id, importance) of each actionable that shares a feature with a project's low ones."""
    sets, matched = _matched(low, actionables, id_col, features)
    return sets.join(matched, "lacks").select("project", "month", "id", "importance")


def recommended_totals(low: DataFrame, actionables: DataFrame, id_col: str, features: str) -> DataFrame:
    """(project, month, n, importance): how many actionables `recommend` gives, and their importance, without listing them."""
    sets, matched = _matched(low, actionables, id_col, features)
    return sets.join(matched.groupBy("lacks").agg(F.count("*").alias("n"), F.sum("importance").alias("importance")), "lacks").select("project", "month", "n", "importance")


def nested(recommended: DataFrame) -> DataFrame:
    """One JSON text per project and month: ids by importance, highest first, then id."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("o"), "id", "importance")))
    out = recommended.groupBy("project", "month").agg(F.transform(order, lambda x: F.struct(x["id"].alias("id"), x["importance"].alias("importance"))).alias("items"))
    return out.select("project", "month", F.to_json(F.create_map(F.col("project").cast("string"), F.create_map(F.col("month").cast("string"), F.col("items")))).alias("json"))


def record_json(c: dict[str, Column]) -> Column:
    """A record of one actionable as nested JSON."""
    article = F.struct(c["title"].alias("title"), c["link"].alias("link"), c["venue"].alias("venue"))
    return F.to_json(F.struct(article.alias("article"), *[c[k].alias(k) for k in ("recommendation", "positive_impact", "evidence", "confidence_score", "category", "features")], importance(c["features"]).alias("importance")))
