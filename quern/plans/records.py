"""Similarity, calibration, clustering, metrics, graph, search, time windows and validation over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quern.functions import text as X
from quern.operators import cluster, graph, metrics, responses, similarity, timewindow, validation
from quern.plans.pairs import BUILT_IN_PAIRS
from quern.runtime import cut, table
from quern.schema import CATEGORIES, DEFAULT_THETA, TASKS


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "reconciled_actionables")
    return r.select("venue", "row_id", F.coalesce(F.element_at(F.filter(F.split(F.lower("models_present"), r"[|,\s'\[\]\"]+"), lambda x: x != ""), 1), F.lit("none")).alias("model"), F.coalesce("actionable", F.lit("")).alias("text"))


def similar_pairs_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a venue's rows by the lexical similarity of their actionables, same-model pairs weighted down, above 0.3."""
    g = similarity.grams(_pool(spark, sf_dir), "venue", "row_id", "text", ["model"])
    return similarity.similar_pairs(g, "model", 0.3).select(F.col("g").alias("venue"), "i", "j", F.round("sim", 6).alias("sim"))


def similar_pairs_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows with an embedding (of the same number) by the weighted mean of words and vectors, within venues, above 0.3."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    g = similarity.grams(_pool(spark, sf_dir).join(e, "row_id"), "venue", "row_id", "text", ["model", "embedding"])
    return similarity.similar_pairs(g, "model", 0.3, "embedding").select(F.col("g").alias("venue"), "i", "j", F.round("sim", 5).alias("sim"))


def cluster_reconcile(spark: SparkSession, sf_dir: str, theta: float = 0.3) -> DataFrame:
    """Candidates of all logged answers, clustered within their article and reconciled to one row per cluster."""
    pool = cut(responses.candidates(responses.first_lines(table(spark, sf_dir, "responses"))))
    g = similarity.grams(pool, "article", "idx", "merged_text", ["model_key"])
    base = pool.select(F.col("article").alias("g"), F.col("idx").alias("i"), "model_key", "text", "impact", "evidence", "confidence")
    return cluster.reconcile(base.join(cut(cluster.clustered(g, "model_key", theta)), ["g", "i"]))


def reconcile_default_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_reconcile(spark, sf_dir, DEFAULT_THETA)


def cluster_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of given clusters (a venue's rows of one model): the row most similar to the others."""
    pool = _pool(spark, sf_dir).withColumn("k", F.concat_ws("|", "venue", "model"))
    sums = similarity.similarity_sums(similarity.grams(pool, "k", "row_id", "text"))
    several = sums.join(pool.groupBy(F.col("k").alias("g")).count().where("count > 1"), "g", "left_semi").select("g", F.col("i").alias("row_id"), F.round("total", 4).alias("degree"))
    best = several.groupBy("g").agg(F.max_by(F.struct("row_id", "degree"), F.struct("degree", -F.col("row_id"))).alias("b"))
    return best.select(F.col("g").alias("k"), "b.row_id", "b.degree")


def builtin_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k, a, b, s) for k, (a, b, s) in enumerate(BUILT_IN_PAIRS)], "pair long, a string, b string, score double")
    return rows.select("pair", F.round(X.lexical(X.tokenise(F.col("a")), X.tokenise(F.col("b"))), 6).alias("sim"), "score")


def builtin_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse and fine theta on the built-in pairs, taken as two benchmarks of different thresholds."""
    s = builtin_pair_scores(spark, sf_dir)
    parts = [similarity.unambiguous(s, "score", 4.0, low).select(F.lit(n).alias("benchmark"), "sim", "same") for n, low in (("a", 2.0), ("b", 2.5))]
    coarse, fine, f1 = similarity.calibrate(cut(parts[0].unionByName(parts[1])))
    return spark.createDataFrame([(coarse, fine, round(f1, 6))], "coarse double, fine double, average_f1 double")


def _vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the coarse grid over all pairs of vectors, vec_id_a < vec_id_b; the parity of vec_id_a is the benchmark."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), "label", F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("benchmark"), F.col("embedding").alias("vector"))
    grid = similarity.coarse_grid()
    return similarity.theta_scores_of_counts(cut(similarity.vector_pair_counts(rows, grid)), grid)


def theta_calibration_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _vector_scores(spark, sf_dir)
    return s.select("benchmark", "theta", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def theta_calibration_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.best_theta(_vector_scores(spark, sf_dir)).select("theta", F.round("average_f1", 6).alias("average_f1"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "scored")
    return s.where("avg_confidence is not null and sound_verdict is not null").select(F.col("avg_confidence").alias("score"), (F.col("sound_verdict") == "YES").alias("truth"))


def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc(_judged(spark, sf_dir), F.col("truth"), F.col("score")).select("threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(_judged(spark, sf_dir), F.col("truth"), F.col("score")).select(F.round("auc", 6).alias("auc"))


_FIELDS = [f for _, fields in TASKS.values() for f in fields]


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.latest_answers(table(spark, sf_dir, "react_validation"), _FIELDS)


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.two_annotators(_answers(spark, sf_dir), _FIELDS)


def _every_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.annotator_pairs(_answers(spark, sf_dir), _FIELDS)


def kappa_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's kappa over every two annotators of an item, a before b by name."""
    k = metrics.kappa_of_counts(validation.pair_counts(_answers(spark, sf_dir), _FIELDS), ["field"], "a", "b")
    k = k.select("field", "n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))
    return k.withColumn("reading", X.interpret_kappa(F.col("kappa")))


def disagreement_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of a task for the items in dispute in it, for every two annotators of an item."""
    return validation.worklist(_every_two(spark, sf_dir)).drop("r", "s", "task")


def disagreement_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first task's items in dispute, with columns A_, B_ and final_ for each field."""
    work = validation.worklist(_every_two(spark, sf_dir)).where("task = 'task1'")
    return validation.sheet(work, TASKS["task1"][1]).withColumns({c: F.col(c).cast("long") for c in ("r", "s")})


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.resolve(validation.combined(validation.worklist(_every_two(spark, sf_dir))).withColumn("final", F.lit("")))


def conservative_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value for each item and field in dispute: NO if any annotator says NO, else the first's by name."""
    return _resolved(spark, sf_dir).select("item_id", "field", "resolved", F.col("flagged").cast("long").alias("flagged"))


def unresolved_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.unresolved(_resolved(spark, sf_dir))


def composite_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir).withColumn("composite", X.composite_valid(F.col("actionable_valid"), F.col("evidence_valid"), F.col("impact_valid")))
    return a.groupBy("annotator_id").agg(F.count("*").alias("n"), *[F.round(F.avg((F.col(c) == "YES").cast("double")) * 100, 4).alias(f"pct_{c}") for c in ("composite", "actionable_valid", "evidence_valid", "impact_valid")])


def _model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = table(spark, sf_dir, "validation_sample").select("item_id", "model_sound_label", "model_precise_label")
    a = _answers(spark, sf_dir).join(key, "item_id")
    rows = a.select("item_id", "annotator_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_valid").alias("h"), F.col(f"model_{f}_label").alias("m")) for f in ("sound", "precise")])).alias("x")).select("item_id", "annotator_id", "x.*")
    return rows.where("h in ('YES', 'NO') and m in ('YES', 'NO')")


def confusion_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = metrics.confusion(_model_pairs(spark, sf_dir), ["field"], F.col("h") == "YES", F.col("m") == "YES")
    return c.select("field", "tp", "tn", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_pairs(spark, sf_dir).where("field = 'sound'").select(F.concat_ws("/", "item_id", "annotator_id").alias("k"), (F.col("h") == "YES").cast("int").alias("truth"), F.when(F.col("annotator_id") == "A09", 404).otherwise((F.col("m") == "YES").cast("int")).alias("pred"))


def plain_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rounded_metrics(_bits(spark, sf_dir), "truth", "pred")


def weighted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = metrics.weighted_metrics(_bits(spark, sf_dir), "truth", "pred")
    return w.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "specificity")], "n")


def crosswalk_error_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = metrics.errors_by_position(_bits(spark, sf_dir).where("pred != 404"), "k", "truth", "pred")
    return e.withColumn("question", F.col("question").cast("long"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "final_set").select("row_id", X.primary_category(F.col("category")).alias("primary_category")).where(F.col("primary_category").isin(CATEGORIES))
    return validation.stratified_sample(f, "primary_category", "row_id", 25)


def stratum_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "validation_sample")
    return validation.stratum_report(f, graph.category_frame(spark).withColumnRenamed("category", "primary_category"), "primary_category")


def blinded_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.blinded(table(spark, sf_dir, "validation_sample"), ["item_id", "actionable", "impact", "evidence"], ["sound_valid", "precise_valid"], ["one", "two"])


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first annotator's answers, replaced by the resolved ones of items in dispute between any two annotators."""
    first = _two(spark, sf_dir).select("item_id", "field", F.col("a").alias("value"))
    second = conservative_resolution(spark, sf_dir).select("item_id", "field", F.col("resolved").alias("value"))
    return validation.override(first, second, ["item_id", "field"])


def positional_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.positional(table(spark, sf_dir, "scored").select("row_id", "sound_verdict"), table(spark, sf_dir, "final_set"), "row_id", ["category"])


def sample_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.checked_lookup(table(spark, sf_dir, "validation_sample").select("row_id", "item_id"), table(spark, sf_dir, "final_set").select("row_id", "sound", "precise"), "row_id")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(table(spark, sf_dir, "final_set"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("category", "actionable", "first_row")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = graph.merged_actionables(table(spark, sf_dir, "final_set"))
    return m.select("actionable", "first_row", F.array_join("categories", " | ").alias("categories"), "sound")


def graph_category_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.category_ids(_edges(spark, sf_dir))


def category_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf_dir))


def category_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many actionables and edges each chunk has, when the first category by name is the default."""
    e = cut(_edges(spark, sf_dir))
    default = graph.default_category(e, "none of them")
    nodes = graph.chunks(e, default).groupBy("chunk").agg(F.count("*").alias("n_actionables"))
    return graph.chunk_edges(e, default).groupBy("chunk").agg(F.count("*").alias("n_edges")).join(nodes, "chunk", "left").fillna(0, ["n_actionables"])


def graph_payload_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = graph.payload(table(spark, sf_dir, "final_set"))["actionables"]
    return p.select("id", "label", "actionable", F.array_join("categories", " | ").alias("categories"), "article_title", "impact", "evidence", "avg_confidence", "support", "search_blob")


def graph_payload_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.payload(table(spark, sf_dir, "final_set"))["edges"].select("id", "from", "to")


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.payload(table(spark, sf_dir, "final_set"))["stats"]


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = graph.merged_actionables(table(spark, sf_dir, "final_set"))
    return graph.keyword_search(m, "impact", '"bus factor" newcomers or repair* time -forks')


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("actionable", F.round("score", 6).alias("score"))


def category_best_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best scores among actionables that are sound, by category, best first."""
    h = _hits(spark, sf_dir)
    best = graph.best_by_category(_edges(spark, sf_dir), h.select("actionable", "score"), h.where(X.quality(F.col("sound"), "yes")))
    return best.select("category", F.round("best_score", 6).alias("best_score")).orderBy(F.desc("best_score"), "category")


def graph_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by category: all, those whose sound actionable matches, and those that are visible with three categories selected."""
    m = graph.merged_actionables(table(spark, sf_dir, "final_set")).where(X.quality(F.col("sound"), "yes"))
    v = graph.visibility(cut(_edges(spark, sf_dir)), m, _hits(spark, sf_dir), CATEGORIES[2:5])
    return v.groupBy("category").agg(F.count("*").alias("n"), F.count_if("direct").alias("n_matches"), F.count_if("visible").alias("n_visible"))


def semantic_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return graph.semantic_search(e, q, "vec_id", "embedding", 10, 0.1).withColumn("rank", F.col("rank").cast("long"))


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["view", "signup", "purchase", "error", "click"]
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.datediff(F.to_date("ts"), F.to_date(F.lit("1970-01-01"))).alias("month"), "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return e.groupBy("project", "month").agg(*[F.sum(F.when(F.col("event_type") == k, F.col("cents")).otherwise(0)).alias(k) for k in kinds])


def low_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = timewindow.low_features(_activity(spark, sf_dir), "project", "month", ["view", "signup", "purchase", "error", "click"])
    return low.select("project", F.col("month").cast("long").alias("month"), "feature", "recent", F.round("mean", 6).alias("mean"))


def feature_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actionables whose features (made from the row number) a project lacks, counted by project and month."""
    low = timewindow.low_features(_activity(spark, sf_dir), "project", "month", ["view", "signup", "purchase", "error", "click"])
    items = table(spark, sf_dir, "validation_sample").select("item_id", F.concat_ws(", ", F.when(F.col("row_id") % 2 == 0, "view"), F.when(F.col("row_id") % 3 == 0, "error"), F.when(F.col("row_id") % 5 == 0, "click")).alias("features"))
    return timewindow.recommended_totals(low, items, "item_id", "features").withColumn("month", F.col("month").cast("long"))


_F = [similar_pairs_lexical, similar_pairs_ensemble, disagreement_sheet, unresolved_counts, graph_payload_nodes, graph_payload_edges, graph_stats, cluster_reconcile, reconcile_default_theta, cluster_centroid, builtin_pair_scores, builtin_calibration, theta_calibration_coarse, theta_calibration_best, roc_points, roc_auc, kappa_by_field, disagreement_worklist, conservative_resolution, composite_validity, confusion_prf, plain_metrics, weighted_metrics, crosswalk_error_positions, stratified_sample, stratum_report, blinded_export, ground_truth, positional_merge, sample_lookup, graph_edges, graph_nodes, graph_category_ids, category_degree, category_chunks, keyword_search, category_best_score, graph_visibility, semantic_search_topk, low_features, feature_recommendations]
QUERIES = {f.__name__: f for f in _F}

from quern.plans.records_sql import ORACLES  # noqa: E402,F401
