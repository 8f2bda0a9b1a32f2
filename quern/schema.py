"""Names, fixed values and column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: The canonical categories, in canonical order.
CATEGORIES = [
    "New Contributor Onboarding and Involvement",
    "Code Standards and Maintainability",
    "Automated Testing and Quality Assurance",
    "Community Collaboration and Engagement",
    "Documentation Practices",
    "Project Management and Governance",
    "Security Best Practices and Legal Compliance",
    "CI/CD and DevOps Automation",
]
#: The five models whose votes are counted.
MODELS = ["qwen", "gemma4", "mixtral", "gpt", "deepseek"]
#: Words left out of the similarity.
STOPWORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might "
    "that this these those it its as not no nor so yet both either each few more most other some such than then there when where which who whom why how "
    "all any can into if up out about what per i we you he she they them us our your"
).split()
#: Families of model names, first match wins.
FAMILIES = ["deepseek", "llama", "gpt", "qwen", "gemma", "mixtral"]
#: Weights and thresholds of the similarity.
SAME_MODEL_WEIGHT, LEXICAL_WEIGHT, SEMANTIC_WEIGHT, DEFAULT_THETA, MAJORITY = 0.15, 0.40, 0.60, 0.08, 3
#: Texts that stand for a missing value.
MISSING = ["", "none", "nan", "null", "n/a"]
#: Features of a project whose fall calls for advice.
PROJECT_FEATURES = ["s_avg_clustering_coef", "t_num_dev_nodes", "t_num_dev_per_file", "t_graph_density", "st_num_dev", "t_net_overlap"]

#: The fields of the two validation tasks, and the field whose answer makes an item count in each.
TASKS = {
    "task1": ("actionable_valid", ["actionable_valid", "evidence_valid", "impact_valid"]),
    "task2": ("sound_valid", ["sound_valid", "precise_valid", "cat_onboarding", "cat_code_standards", "cat_testing_qa", "cat_community", "cat_documentation", "cat_governance", "cat_security", "cat_cicd"]),
}
#: Patterns of identifiers, of titles that are none, and of lines that hold names.
DOI_PATTERN = r"(?i)10\.\d{4,9}/[^\s\"<>\]\)]+"
BAD_TITLE_PATTERN = r"(?i)^(microsoft word|untitled|document\d*|\d+)\b"
NAME_LINE_PATTERN = r"^[A-ZÀ-Ý][\w.À-ü'-]+(\s+(and|,)?\s*[A-ZÀ-Ý][\w.À-ü'-]+){1,4}$"

RECOMMENDATION = T.StructType([T.StructField(c, T.StringType()) for c in ("recommendation", "positive_impact", "evidence")] + [T.StructField("confidence", T.DoubleType())])


def with_defaults(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the schema, in its order and types; missing ones are null."""
    have = set(df.columns)
    return df.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def find_column(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate that is a column, letter case aside."""
    by = {c.lower(): c for c in reversed(columns)}
    return next((by[c.lower()] for c in candidates if c.lower() in by), None)


def text_of(column: str) -> Column:
    """The column as a string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
