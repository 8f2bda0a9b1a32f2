"""Problem 3: several values packed in one field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.operators.unpack import unpack_field
from quern.runtime import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack_field(table(spark, sf_dir, "final_set"), "row_id", "category")


def p3_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and rows of each label, letter case aside."""
    return p3_found(spark, sf_dir).groupBy(F.lower("val").alias("label")).agg(F.count("*").alias("n_values"), F.count_distinct("row_id").alias("n_rows"))


QUERIES = {"p3_found": p3_found, "p3_label_counts": p3_label_counts}
ORACLES: dict[str, str] = {}
