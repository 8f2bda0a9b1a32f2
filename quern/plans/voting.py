"""Votes, summaries and distributions of scored and categorised records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions import text as X
from quern.operators import cluster, metrics, votes
from quern.runtime import table
from quern.schema import CATEGORIES, MODELS

_DIMS = ["sound", "precise"]


def majority_vote_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.verdicts(table(spark, sf_dir, "scored").drop("sound_yes_count", "sound_verdict", "precise_yes_count", "precise_verdict"), _DIMS).select("row_id", *[f"{d}_{x}" for d in _DIMS for x in ("yes_count", "verdict")])


def vote_rates_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = votes.rates(votes.long_votes(table(spark, sf_dir, "scored"), "row_id", _DIMS))
    return r.withColumn("yes_rate", F.round("yes_rate", 6))


def vote_agreement_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = majority_vote_verdicts(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"{d}_yes_count").alias("yes_count")) for d in _DIMS])).alias("x")).select("x.*")
    return v.groupBy("dim", "yes_count").agg(F.count("*").alias("n"))


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts as stored, where they are: YES and not YES."""
    s = table(spark, sf_dir, "scored").select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"{d}_verdict").alias("v")) for d in _DIMS])).alias("x")).select("x.*")
    return s.groupBy("dim").agg(F.count_if(F.col("v") == "YES").alias("n_yes"), F.count_if(F.coalesce(F.col("v") != "YES", F.lit(True))).alias("n_not_yes"))


def vote_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = votes.long_votes(table(spark, sf_dir, "scored"), "row_id", _DIMS)
    return v.select("row_id", "dim", "model", F.coalesce((F.upper(F.trim("vote")) == "YES").cast("long"), F.lit(0).cast("long")).alias("yes"))


def scoring_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = majority_vote_verdicts(spark, sf_dir)
    return v.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"{d}_verdict") == "YES").alias(f"n_{d}") for d in _DIMS], F.round(F.avg((F.col("sound_verdict") == "YES").cast("double")) * 100, 4).alias("pct_sound"))


def multi_label_category_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made from the stored categories: each model names those whose number, plus its own, isn't divisible by its rank."""
    listed = F.transform(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c.lower()).alias("c")) for k, c in enumerate(CATEGORIES, 1)]), lambda x: x)
    rows = table(spark, sf_dir, "final_set").select("row_id", F.lower(F.coalesce("category", F.lit(""))).alias("c"), F.explode(F.array(*[F.lit(i) for i in range(2, len(MODELS) + 2)])).alias("m"))
    named = F.filter(listed, lambda x: F.col("c").contains(x["c"]) & ((x["k"] + F.col("row_id")) % F.col("m") != 0))
    replies = rows.select("row_id", F.array_join(F.transform(named, lambda x: x["k"].cast("string")), ", ").alias("reply"))
    return votes.category_vote(replies)


def venue_group_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.shares(table(spark, sf_dir, "reconciled_actionables"), X.venue_group(F.col("venue")), "venue_group")
    return s.withColumn("share", F.round("share", 6))


def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "reconciled_actionables").withColumn("fraction", X.fraction(F.col("support_fraction")))
    return metrics.describe(r, ["support", "fraction", "avg_confidence", "centroid_confidence"])


def histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "reconciled_actionables")
    a = metrics.histogram(r, F.col("avg_confidence"), 0.0, 1.0, 20).withColumn("variable", F.lit("avg_confidence"))
    return a.unionByName(metrics.histogram(r, F.col("support"), -0.5, 5.5, 6).withColumn("variable", F.lit("support")))


def boxplot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = metrics.boxplot(table(spark, sf_dir, "reconciled_actionables"), [X.venue_group(F.col("venue"))], "avg_confidence").withColumnRenamed("k0", "venue_group")
    return b.select("venue_group", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")])


def confidence_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("dataset"), "row_id", "avg_confidence") for t in ("reconciled_actionables", "scored", "final_set")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("avg_confidence is not null")


def bubble_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "final_set")
    return f.select("row_id", F.coalesce("avg_confidence", F.lit(0.5)).alias("confidence"), (F.coalesce(X.fraction(F.col("support_fraction")), F.lit(0.5)) * 400).alias("size"), F.size(X.canonical_categories(F.col("category"))).cast("long").alias("n_categories"))


def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries by category, rows expanded to all categories that a part of the field holds or is held by."""
    f = votes.flags(table(spark, sf_dir, "final_set")).withColumn("cat", F.explode(X.fuzzy_categories(F.col("category"))))
    return votes.summary(f, ["cat"])


def edged_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence between twelve edges, and support around whole numbers, empty bins included."""
    r = table(spark, sf_dir, "reconciled_actionables")
    a = metrics.edged_histogram(r, F.col("avg_confidence"), [round(k / 11, 6) for k in range(12)]).withColumn("variable", F.lit("avg_confidence"))
    return a.unionByName(metrics.edged_histogram(r, F.col("support"), [k - 0.5 for k in range(7)]).withColumn("variable", F.lit("support"))).select("variable", "bin", "n")


def category_verdict_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 where a row has the category and the verdict of its soundness is YES, for each row and category."""
    s = table(spark, sf_dir, "scored").select("row_id", "sound_verdict")
    f = table(spark, sf_dir, "final_set").select("row_id", X.canonical_categories(F.col("category")).alias("cs")).join(s, "row_id", "left")
    return f.select("row_id", *[(F.array_contains("cs", c) & F.coalesce(F.col("sound_verdict") == "YES", F.lit(False))).cast("long").alias(f"c{k}") for k, c in enumerate(CATEGORIES, 1)])


def final_set_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, shares of YES in percent, and the mean number of categories, with and without rows that have none."""
    f = table(spark, sf_dir, "final_set").select("*", F.size(X.canonical_categories(F.col("category"))).alias("k"))
    share = lambda c: F.round(F.avg(X.truthy(F.col(c)).cast("double")) * 100, 4)
    return f.agg(F.count("*").alias("n"), *[F.count_if(X.truthy(F.col(c))).alias(f"n_{c}") for c in _DIMS], *[share(c).alias(f"pct_{c}") for c in _DIMS], F.count_if(F.col("k") > 0).alias("n_categorised"), F.round(F.avg("k"), 6).alias("mean_categories"), F.round(F.avg(F.when(F.col("k") > 0, F.col("k"))), 6).alias("mean_of_categorised"))


def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = F.filter(F.array(*[F.when(X.model_present(F.col("models_present"), m), F.lit(m)) for m in MODELS]), lambda x: x.isNotNull())
    return votes.summary(votes.flags(table(spark, sf_dir, "final_set")).withColumn("model", F.explode(present)), ["model"])


def category_expand_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "final_set").select("row_id", F.explode(X.fuzzy_categories(F.col("category"))).alias("cat"))


def category_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_expand_fuzzy(spark, sf_dir).groupBy("cat").agg(F.count("*").alias("n"))


def top5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "final_set").select(F.explode(X.fuzzy_categories(F.col("category"))).alias("cat"), X.truthy(F.col("sound")).cast("double").alias("s"))
    return f.groupBy("cat").agg(F.round(F.avg("s"), 6).alias("sound_rate")).orderBy(F.desc("sound_rate"), "cat").limit(5)


def categories_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "final_set").select(F.size(X.fuzzy_categories(F.col("category"))).cast("long").alias("n_categories"))
    return f.groupBy("n_categories").agg(F.count("*").alias("n"))


def category_model_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound votes by category and model."""
    long = votes.long_votes(table(spark, sf_dir, "scored"), "row_id", ["sound"]).where("upper(trim(vote)) = 'YES'")
    m = category_expand_fuzzy(spark, sf_dir).join(long, "row_id").groupBy("cat").pivot("model", MODELS).agg(F.count(F.lit(1)))
    return m.fillna(0, MODELS)


def content_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "scored")
    key = X.content_key(F.col("actionable"), F.col("impact"), F.col("evidence"))
    return s.groupBy(key.alias("k")).agg(F.min("row_id").alias("row_id"), F.count("*").alias("n_rows")).select("row_id", "n_rows")


def spread_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "scored").select("row_id", "actionable", "impact", "evidence", "sound_verdict", "precise_verdict")
    key = X.content_key(F.col("actionable"), F.col("impact"), F.col("evidence"))
    return votes.spread_verdicts(s, key, "row_id", ["sound_verdict", "precise_verdict"]).select("row_id", "sound_verdict", "precise_verdict")


def reconciled_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of each article's rows by support, then confidence, of support 2 or more."""
    r = table(spark, sf_dir, "reconciled_actionables").where("support >= 2").select("row_id", "venue", "support", "avg_confidence", "cluster_id")
    return cluster.ranked(r, "venue", ("cluster_id", "row_id")).select("row_id", "venue", "support", "place")


_F = [edged_histogram, category_verdict_matrix, final_set_summary, majority_vote_verdicts, vote_rates_by_model, vote_agreement_depth, verdict_counts, vote_matrix, scoring_summary, multi_label_category_vote, venue_group_share, describe_numeric, histogram_bins, boxplot_stats, confidence_overlay, bubble_frame, category_summary, model_summary, category_expand_fuzzy, category_frequency, top5_rates, categories_per_row, category_model_matrix, content_dedup_first, spread_verdicts, reconciled_ranking]
QUERIES = {f.__name__: f for f in _F}

_COUNT = lambda d: "CAST(" + " + ".join(f"(CASE WHEN upper(trim({d}_{m})) = 'YES' THEN 1 ELSE 0 END)" for m in MODELS) + " AS BIGINT)"
_VERDICTS = f"SELECT row_id, {_COUNT('sound')} AS sound_yes_count, CASE WHEN {_COUNT('sound')} >= 3 THEN 'YES' ELSE 'NO' END AS sound_verdict, {_COUNT('precise')} AS precise_yes_count, CASE WHEN {_COUNT('precise')} >= 3 THEN 'YES' ELSE 'NO' END AS precise_verdict FROM scored"
_LONG = " UNION ALL ".join(f"SELECT row_id, '{d}' AS dim, '{m}' AS model, {d}_{m} AS vote FROM scored" for d in _DIMS for m in MODELS)
_CATS = "(VALUES " + ", ".join(f"({k}, '{c}')" for k, c in enumerate(CATEGORIES, 1)) + ") AS c(k, cat)"
_VENUE = "CASE WHEN upper(coalesce(venue, '')) LIKE '%ICSE%' THEN 'ICSE' WHEN upper(coalesce(venue, '')) LIKE '%FSE%' THEN 'FSE' ELSE 'Other' END"
_FRACTION = "CASE WHEN len(string_split(support_fraction, '/')) = 2 THEN TRY_CAST(trim(string_split(support_fraction, '/')[1]) AS DOUBLE) / nullif(TRY_CAST(trim(string_split(support_fraction, '/')[2]) AS DOUBLE), 0) ELSE TRY_CAST(trim(support_fraction) AS DOUBLE) END"
_STRIP = lambda c: f"regexp_replace({c}, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')"
_EXISTS = lambda c: f"coalesce(lower({_STRIP(c)}) NOT IN ('', 'none', 'nan', 'null', 'n/a'), false)"
_TRUE = lambda c: f"coalesce(lower({_STRIP(c)}) IN ('1', 'true', 'yes', 'y', 't'), false)"
_FLAGS = f"SELECT row_id, article_title, avg_confidence, models_present, category, {_TRUE('sound')} AS sound, {_TRUE('precise')} AS precise, {_EXISTS('impact')} AS has_impact, {_EXISTS('evidence')} AS has_evidence FROM final_set"
_SUMMARY = "count(*) AS n, count(*) FILTER (sound) AS n_sound, count(*) FILTER (precise) AS n_precise, count(*) FILTER (has_impact) AS n_impact, count(*) FILTER (has_evidence) AS n_evidence, count(*) FILTER (sound AND precise AND has_impact AND has_evidence) AS n_complete, round(avg(avg_confidence), 6) AS mean_confidence, count(DISTINCT article_title) AS n_articles"
_CANON = f"(SELECT DISTINCT row_id, cat FROM (SELECT row_id, {_STRIP('unnest(string_split(category, chr(124)))')} AS part FROM final_set) JOIN {_CATS} ON part = cat)"
_FUZZY = f"SELECT DISTINCT row_id, cat FROM (SELECT row_id, lower({_STRIP('unnest(regexp_split_to_array(category, ' + chr(39) + '[;,|]' + chr(39) + '))')}) AS part FROM final_set) JOIN {_CATS} ON part <> '' AND (contains(lower(cat), part) OR contains(part, lower(cat)))"
_CONTENT = "concat_ws('||', " + ", ".join(f"lower({_STRIP(f'coalesce({c}, chr(39)[2:])')})" for c in ("actionable", "impact", "evidence")) + ")"
_DESCRIBE = " UNION ALL ".join(
    f"SELECT '{n}' AS variable, count({e}) AS n, round(avg({e}), 3) AS mean, round(stddev_samp({e}), 3) AS std, round(min({e}), 3) AS low, round(quantile_cont({e}, 0.25), 3) AS q1, round(quantile_cont({e}, 0.5), 3) AS median, round(quantile_cont({e}, 0.75), 3) AS q3, round(max({e}), 3) AS high FROM reconciled_actionables"
    for n, e in (("support", "CAST(support AS DOUBLE)"), ("fraction", f"({_FRACTION})"), ("avg_confidence", "avg_confidence"), ("centroid_confidence", "centroid_confidence"))
)
ORACLES = {
    "majority_vote_verdicts": _VERDICTS,
    "vote_rates_by_model": f"SELECT dim, model, round(avg(CASE WHEN upper(trim(vote)) = 'YES' THEN 1.0 ELSE 0.0 END), 6) AS yes_rate, count(*) AS n FROM ({_LONG}) GROUP BY ALL",
    "vote_agreement_depth": f"WITH v AS ({_VERDICTS}) SELECT dim, yes_count, count(*) AS n FROM (SELECT 'sound' AS dim, sound_yes_count AS yes_count FROM v UNION ALL SELECT 'precise', precise_yes_count FROM v) GROUP BY ALL",
    "verdict_counts": "SELECT dim, count(*) FILTER (v = 'YES') AS n_yes, count(*) FILTER (v IS NULL OR v <> 'YES') AS n_not_yes FROM (SELECT 'sound' AS dim, sound_verdict AS v FROM scored UNION ALL SELECT 'precise', precise_verdict FROM scored) GROUP BY ALL",
    "vote_matrix": f"SELECT row_id, dim, model, CAST(CASE WHEN upper(trim(vote)) = 'YES' THEN 1 ELSE 0 END AS BIGINT) AS yes FROM ({_LONG})",
    "scoring_summary": f"WITH v AS ({_VERDICTS}) SELECT count(*) AS n, count(*) FILTER (sound_verdict = 'YES') AS n_sound, count(*) FILTER (precise_verdict = 'YES') AS n_precise, round(avg(CASE WHEN sound_verdict = 'YES' THEN 1.0 ELSE 0.0 END) * 100, 4) AS pct_sound FROM v",
    "multi_label_category_vote": f"WITH r AS (SELECT row_id, k, cat, count(*) FILTER (contains(lower(coalesce(category, '')), lower(cat)) AND (k + row_id) % m <> 0) AS yes FROM final_set, {_CATS}, (SELECT unnest([2, 3, 4, 5, 6]) AS m) GROUP BY ALL) SELECT row_id, "
    + ", ".join(f"CAST(sum(yes) FILTER (k = {k}) AS BIGINT) AS yes_{k}" for k in range(1, 9))
    + ", coalesce(string_agg(cat, ' | ' ORDER BY k) FILTER (yes >= 3), 'NONE') AS assigned_categories, count(*) FILTER (yes >= 3) AS num_categories FROM r GROUP BY row_id",
    "venue_group_share": f"SELECT {_VENUE} AS venue_group, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM reconciled_actionables GROUP BY 1",
    "describe_numeric": _DESCRIBE,
    "histogram_bins": "SELECT CAST(least(floor(avg_confidence / (CAST(1.0 AS DOUBLE) / 20)), 19) AS BIGINT) AS bin, count(*) AS n, 'avg_confidence' AS variable FROM reconciled_actionables WHERE avg_confidence BETWEEN 0 AND 1 GROUP BY 1 UNION ALL SELECT CAST(least(floor(support + 0.5), 5) AS BIGINT), count(*), 'support' FROM reconciled_actionables WHERE support BETWEEN -0.5 AND 5.5 GROUP BY 1",
    "boxplot_stats": f"WITH b AS (SELECT {_VENUE} AS venue_group, avg_confidence AS v FROM reconciled_actionables WHERE avg_confidence IS NOT NULL), q AS (SELECT venue_group, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM b GROUP BY 1) SELECT venue_group, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(min(v), 6) AS whisker_low, round(max(v), 6) AS whisker_high FROM b JOIN q USING (venue_group) WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1",
    "confidence_overlay": " UNION ALL ".join(f"SELECT '{t}' AS dataset, row_id, avg_confidence FROM {t} WHERE avg_confidence IS NOT NULL" for t in ("reconciled_actionables", "scored", "final_set")),
    "bubble_frame": f"SELECT row_id, coalesce(avg_confidence, 0.5) AS confidence, coalesce({_FRACTION}, 0.5) * 400 AS size, (SELECT count(*) FROM (SELECT {_STRIP('unnest(string_split(category, chr(124)))')} AS part) WHERE part IN ({', '.join(repr(c) for c in CATEGORIES)})) AS n_categories FROM final_set",
    "category_summary": f"SELECT cat, {_SUMMARY} FROM ({_FLAGS}) JOIN ({_FUZZY}) USING (row_id) GROUP BY cat",
    "edged_histogram": "WITH v AS (SELECT 'avg_confidence' AS variable, avg_confidence AS v FROM reconciled_actionables UNION ALL SELECT 'support', support FROM reconciled_actionables), b AS (SELECT 'avg_confidence' AS variable, k AS bin, round(CAST(k AS DOUBLE) / 11, 6) AS low, round(CAST(k + 1 AS DOUBLE) / 11, 6) AS high, k = 10 AS last FROM range(11) r(k) UNION ALL SELECT 'support', k, k - 0.5, k + 0.5, k = 5 FROM range(6) r(k)) SELECT b.variable, bin, count(v.v) AS n FROM b LEFT JOIN v ON v.variable = b.variable AND v.v >= low AND (v.v < high OR last AND v.v = high) GROUP BY ALL",
    "category_verdict_matrix": "WITH p AS (SELECT row_id, CASE WHEN category IS NULL THEN [] ELSE list_transform(string_split(category, '|'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) END AS parts FROM final_set) SELECT p.row_id, " + ", ".join(f"CAST(list_contains(parts, '{c}') AND coalesce(sound_verdict = 'YES', false) AS BIGINT) AS c{k}" for k, c in enumerate(CATEGORIES, 1)) + " FROM p LEFT JOIN scored USING (row_id)",
    "final_set_summary": f"WITH k AS (SELECT row_id, (SELECT count(*) FROM (SELECT {_STRIP('unnest(string_split(category, chr(124)))')} AS part) WHERE part IN ({', '.join(repr(c) for c in CATEGORIES)})) AS k, {_TRUE('sound')} AS s, {_TRUE('precise')} AS p FROM final_set) SELECT count(*) AS n, count(*) FILTER (s) AS n_sound, count(*) FILTER (p) AS n_precise, round(avg(CASE WHEN s THEN 1.0 ELSE 0.0 END) * 100, 4) AS pct_sound, round(avg(CASE WHEN p THEN 1.0 ELSE 0.0 END) * 100, 4) AS pct_precise, count(*) FILTER (k > 0) AS n_categorised, round(avg(k), 6) AS mean_categories, round(avg(k) FILTER (k > 0), 6) AS mean_of_categorised FROM k",
    "model_summary": f"SELECT model, {_SUMMARY} FROM ({_FLAGS}) JOIN (SELECT unnest({MODELS!r}) AS model) ON list_bool_or(list_transform(regexp_split_to_array(lower(coalesce(models_present, '')), '[|,\\s''\\[\\]\"]+'), lambda t: contains(t, model))) GROUP BY model",
    "category_expand_fuzzy": _FUZZY,
    "category_frequency": f"SELECT cat, count(*) AS n FROM ({_FUZZY}) GROUP BY cat",
    "top5_rates": f"SELECT cat, round(avg(CASE WHEN {_TRUE('sound')} THEN 1.0 ELSE 0.0 END), 6) AS sound_rate FROM ({_FUZZY}) JOIN final_set USING (row_id) GROUP BY cat ORDER BY sound_rate DESC, cat LIMIT 5",
    "categories_per_row": f"SELECT coalesce(k, 0) AS n_categories, count(*) AS n FROM final_set LEFT JOIN (SELECT row_id, count(*) AS k FROM ({_FUZZY}) GROUP BY row_id) USING (row_id) GROUP BY 1",
    "category_model_matrix": f"SELECT cat, {', '.join(f'count(*) FILTER (model = {m!r}) AS {m}' for m in MODELS)} FROM ({_FUZZY}) JOIN ({_LONG}) USING (row_id) WHERE dim = 'sound' AND upper(trim(vote)) = 'YES' GROUP BY cat",
    "content_dedup_first": f"SELECT min(row_id) AS row_id, count(*) AS n_rows FROM scored GROUP BY {_CONTENT}",
    "spread_verdicts": f"WITH k AS (SELECT row_id, sound_verdict, precise_verdict, {_CONTENT} AS key FROM scored), f AS (SELECT key, min(row_id) AS row FROM k GROUP BY key) SELECT k.row_id, x.sound_verdict, x.precise_verdict FROM k JOIN f USING (key) JOIN scored x ON x.row_id = f.row",
    "reconciled_ranking": "SELECT row_id, venue, support, row_number() OVER (PARTITION BY venue ORDER BY support DESC, avg_confidence DESC NULLS LAST, cluster_id, row_id) AS place FROM reconciled_actionables WHERE support >= 2",
}
ORACLES = {k: v.replace("chr(39)[2:]", "''") for k, v in ORACLES.items()}
