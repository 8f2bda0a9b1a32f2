"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.consensus import Consensus
from quern.llm.encode import encode_texts
from quern.llm.formatting import Copies
from quern.llm.mix import mix
from quern.llm.neardup import NearDuplicates
from quern.llm.pairs import broken_pairs
from quern.llm.split import oversized, split_texts
from quern.runtime import table

TEXTS = ["actionable", "impact", "evidence"]
JUDGED = ["actionable_valid", "sound_valid", "precise_valid", "cat_onboarding"]


def _copies(spark: SparkSession, sf_dir: str) -> Copies:
    return Copies(table(spark, sf_dir, "scored"), "row_id", TEXTS)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).found()


def p1_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).contents()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(table(spark, sf_dir, "responses"))


def p2_defect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects by type and model spelling."""
    defects = p2_found(spark, sf_dir)
    return table(spark, sf_dir, "responses").select("response_id", "model_name").join(defects, "response_id").groupBy("model_name", "defect").agg(F.count("*").alias("n"))


def _near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return NearDuplicates(table(spark, sf_dir, "reconciled_actionables"), "row_id", TEXTS, threshold=0.7)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).pairs()


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).groups()


def _consensus(spark: SparkSession, sf_dir: str) -> Consensus:
    return Consensus(table(spark, sf_dir, "react_validation"), "item_id", "annotator_id", "submitted_at", JUDGED)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).labels().select("item_id", "field_name", "label")


def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).labels()


def p5_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).reliability()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1].withColumn("actual_share", F.round("actual_share", 6))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_contents, p2_found, p2_defect_counts, p4_found, p4_groups, p5_found, p5_agreement, p5_reliability, p6_ids, p7_mixture, p7_shares, p8_found, p8_pieces)
}

_CONTENTS = r"""
WITH c AS (
  SELECT row_id, list_sort([lower(regexp_replace(coalesce(actionable, ''), '[^\p{L}\p{N}]', '', 'g')),
                            lower(regexp_replace(coalesce(impact, ''), '[^\p{L}\p{N}]', '', 'g')),
                            lower(regexp_replace(coalesce(evidence, ''), '[^\p{L}\p{N}]', '', 'g'))]) AS k
  FROM scored),
g AS (SELECT k, min(row_id) AS keep_id, count(*) AS n_copies FROM c GROUP BY k)
"""
_WORDS = r"""
WITH w AS (
  SELECT row_id, list_distinct(regexp_extract_all(lower(concat_ws(' ', actionable, impact, evidence)), '[\p{L}\p{N}]+')) AS s
  FROM reconciled_actionables),
p AS (SELECT row_id, len(s) AS n, unnest(s) AS word FROM w),
met AS (
  SELECT a.row_id AS row_id_a, b.row_id AS row_id_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM p a JOIN p b ON a.word = b.word AND a.row_id < b.row_id GROUP BY 1, 2)
SELECT row_id_a, row_id_b FROM met WHERE shared * 10 >= 7 * (na + nb - shared)
"""
_GROUPS = r"""
WITH RECURSIVE w AS (
  SELECT row_id, list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', actionable, impact, evidence)), '[\p{L}\p{N}]+'))) AS s
  FROM reconciled_actionables),
k AS (SELECT row_id, s, min(row_id) OVER (PARTITION BY s) AS class_id FROM w),
p AS (SELECT class_id, len(s) AS n, unnest(s) AS word FROM (SELECT DISTINCT class_id, s FROM k)),
met AS (SELECT a.class_id AS a, b.class_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM p a JOIN p b ON a.word = b.word AND a.class_id <> b.class_id GROUP BY 1, 2),
e AS (SELECT a, b FROM met WHERE shared * 10 >= 7 * (na + nb - shared)),
r(x, y) AS (SELECT class_id, class_id FROM k UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
g AS (SELECT x, min(y) AS group_id FROM r GROUP BY x),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT row_id, class_id, group_id, coalesce(n_links, 0) AS n_links FROM k JOIN g ON class_id = x LEFT JOIN n ON class_id = a
"""
ORACLES: dict[str, str] = {
    "p1_found": _CONTENTS + "SELECT keep_id, row_id FROM c JOIN g USING (k) WHERE row_id <> keep_id",
    "p1_contents": _CONTENTS + "SELECT keep_id, n_copies FROM g",
    "p4_found": _WORDS,
    "p4_groups": _GROUPS,
}
