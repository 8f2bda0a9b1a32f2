"""Majority votes of models, summaries of scored and categorised records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions import text as X
from quern.schema import CATEGORIES, MAJORITY, MODELS


def yes_votes(dim: str, models: list[str] = MODELS) -> Column:
    """How many of the columns dim_model say YES; UNCLEAR and null never count."""
    return reduce(lambda a, b: a + b, [F.when(F.upper(F.trim(F.col(f"{dim}_{m}"))) == "YES", 1).otherwise(0) for m in models]).cast("long")


def verdicts(scored: DataFrame, dims: list[str], least: int = MAJORITY) -> DataFrame:
    for d in dims:
        scored = scored.withColumn(f"{d}_yes_count", yes_votes(d)).withColumn(f"{d}_verdict", F.when(F.col(f"{d}_yes_count") >= least, "YES").otherwise("NO"))
    return scored


def long_votes(scored: DataFrame, id_col: str, dims: list[str], models: list[str] = MODELS) -> DataFrame:
    """(id, dim, model, vote), one narrow pass."""
    return scored.select(id_col, F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(m).alias("model"), F.col(f"{d}_{m}").alias("vote")) for d in dims for m in models])).alias("v")).select(id_col, "v.*")


def rates(votes: DataFrame) -> DataFrame:
    """Share of YES by dimension and model; a null vote is not YES."""
    return votes.groupBy("dim", "model").agg(F.avg(F.coalesce((F.upper(F.trim("vote")) == "YES").cast("double"), F.lit(0.0))).alias("yes_rate"), F.count("*").alias("n"))


def category_vote(votes: DataFrame, id_col: str = "row_id", reply: str = "reply", least: int = MAJORITY) -> DataFrame:
    """From (id, model, reply with category numbers): counts by category, and the assigned list in canonical order."""
    numbers = X.category_numbers(F.col(reply))
    counts = [F.count_if(F.array_contains(numbers, str(k))).alias(f"yes_{k}") for k in range(1, len(CATEGORIES) + 1)]
    out = votes.groupBy(id_col).agg(*counts)
    assigned = F.filter(F.array(*[F.when(F.col(f"yes_{k}") >= least, F.lit(c)) for k, c in enumerate(CATEGORIES, 1)]), lambda x: x.isNotNull())
    return out.withColumn("_a", assigned).select(id_col, *[f"yes_{k}" for k in range(1, len(CATEGORIES) + 1)], F.when(F.size("_a") == 0, "NONE").otherwise(F.array_join("_a", " | ")).alias("assigned_categories"), F.size("_a").cast("long").alias("num_categories"))


def spread_verdicts(df: DataFrame, key: Column, order: str, columns: list[str], legacy: bool = False) -> DataFrame:
    """Verdicts of the first row of a content for all its rows; legacy leaves them null for the others."""
    first = df.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*columns), order).alias("_first"), F.min(order).alias("_row"))
    joined = df.drop(*columns).withColumn("_key", key).join(first, "_key")
    value = lambda c: F.when((F.col(order) == F.col("_row")) | F.lit(not legacy), F.col(f"_first.{c}"))
    return joined.select(*[c for c in df.columns if c not in columns], *[value(c).alias(c) for c in columns])


def summary(df: DataFrame, by: list[str], confidence: str = "avg_confidence") -> DataFrame:
    """n, how many are sound, precise, with impact, with evidence, with all four; mean confidence. df: flags of these names."""
    flag = lambda c: F.count_if(F.col(c))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), flag("sound").alias("n_sound"), flag("precise").alias("n_precise"), flag("has_impact").alias("n_impact"), flag("has_evidence").alias("n_evidence"),
        F.count_if(F.col("sound") & F.col("precise") & F.col("has_impact") & F.col("has_evidence")).alias("n_complete"), F.round(F.avg(confidence), 6).alias("mean_confidence"), F.count_distinct("article_title").alias("n_articles"),
    )


def flags(final_set: DataFrame) -> DataFrame:
    c = F.col
    return final_set.select(
        "row_id", "article_title", "avg_confidence", "models_present", "category", X.truthy(c("sound")).alias("sound"), X.truthy(c("precise")).alias("precise"), X.text_exists(c("impact")).alias("has_impact"), X.text_exists(c("evidence")).alias("has_evidence")
    )
