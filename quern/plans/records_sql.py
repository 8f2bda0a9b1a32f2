"""SQL of the queries in records."""

from __future__ import annotations

from quern.plans.pairs import BUILT_IN_PAIRS
from quern.plans.texts import _GRAM, _JACCARD, _STRIP, _TOK
from quern.schema import CATEGORIES, TASKS

_FIELDS = [f for _, fields in TASKS.values() for f in fields]
_TASK_OF = {f: t for t, (_, fields) in TASKS.items() for f in fields}
_IN = "(" + ", ".join(f"'{c}'" for c in CATEGORIES) + ")"

_MODEL = r"coalesce(list_filter(regexp_split_to_array(lower(models_present), '[|,\s''\[\]" + '"' + r"]+'), lambda x: x <> '')[1], 'none')"
_LEX = (
    lambda key, model: f"""WITH t AS (SELECT row_id, {key} AS g, {_MODEL} AS m, {_TOK('actionable')} AS t FROM reconciled_actionables),
s AS (SELECT g, row_id AS i, m, list_distinct(t) AS g1, {_GRAM('t', 2)} AS g2, {_GRAM('t', 3)} AS g3 FROM t),
p AS (SELECT a.g, a.i, b.i AS j, a.m = b.m AS same, {', '.join(f'len(a.g{n}) AS a{n}, len(b.g{n}) AS b{n}, len(list_intersect(a.g{n}, b.g{n})) AS c{n}' for n in (1, 2, 3))} FROM s a JOIN s b ON a.g = b.g AND a.i < b.i),
sim AS (SELECT g, i, j, (({' + '.join(f'CASE WHEN a{n} + b{n} - c{n} = 0 THEN CAST(1.0 AS DOUBLE) ELSE c{n} / (a{n} + b{n} - c{n}) END' for n in (1, 2, 3))}) / 3 + CASE WHEN least(a1, b1) = 0 THEN CAST(0.0 AS DOUBLE) ELSE c1 / least(a1, b1) END) / 2 * {"CASE WHEN same THEN CAST(0.15 AS DOUBLE) ELSE 1 END" if model else "1"} AS sim FROM p)
"""
)
_COSINE = "greatest(0, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))))"
_THETA = f"""WITH p AS (SELECT CASE WHEN a.vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS benchmark, round({_COSINE}, 6) AS sim, a.label = b.label AS same
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id),
grid AS (SELECT round(CAST(0.01 AS DOUBLE) + CAST(0.02 AS DOUBLE) * k, 3) AS theta FROM range(48) r(k)),
h AS (SELECT benchmark, sim, count(*) FILTER (same) AS s, count(*) FILTER (NOT same) AS d FROM p GROUP BY ALL),
c AS (SELECT benchmark, theta, coalesce(sum(s) FILTER (sim >= theta), 0) AS tp, coalesce(sum(d) FILTER (sim >= theta), 0) AS fp, sum(s) AS pos FROM h, grid GROUP BY ALL),
r AS (SELECT benchmark, theta, CASE WHEN tp + fp = 0 THEN CAST(1.0 AS DOUBLE) ELSE tp / (tp + fp) END AS precision, CASE WHEN pos = 0 THEN CAST(0.0 AS DOUBLE) ELSE tp / pos END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN CAST(0.0 AS DOUBLE) ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r)
"""
_ROC = """WITH j AS (SELECT avg_confidence AS s, sound_verdict = 'YES' AS t FROM scored WHERE avg_confidence IS NOT NULL AND sound_verdict IS NOT NULL),
a AS (SELECT s, count(*) FILTER (t) AS pos, count(*) FILTER (NOT t) AS neg FROM j GROUP BY s),
r AS (SELECT s AS threshold, sum(pos) OVER (ORDER BY s DESC) / sum(pos) OVER () AS tpr, sum(neg) OVER (ORDER BY s DESC) / sum(neg) OVER () AS fpr FROM a)
"""
_LABEL = lambda c: f"CASE WHEN upper({_STRIP(c)}) IN ('YES', 'Y') THEN 'YES' WHEN upper({_STRIP(c)}) IN ('NO', 'N') THEN 'NO' WHEN upper({_STRIP(c)}) = 'N/A' THEN 'N/A' ELSE '' END"
_ORDER = ", ".join(["submitted_at DESC NULLS LAST", *[f"{f} DESC" for f in _FIELDS]])
_ANSWERS = f"""WITH l AS (SELECT item_id, annotator_id, submitted_at, {', '.join(f'{_LABEL(f)} AS {f}' for f in _FIELDS)} FROM react_validation),
ans AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, annotator_id ORDER BY {_ORDER}) AS rn FROM l) WHERE rn = 1)
"""
_R = _ANSWERS + ", r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY annotator_id) AS k FROM ans)"
_TWO = _R + ", two AS (" + " UNION ALL ".join(f"SELECT a.item_id, '{f}' AS field, a.{f} AS a, b.{f} AS b FROM r a JOIN r b ON a.item_id = b.item_id AND a.k = 1 AND b.k = 2" for f in _FIELDS) + ")"
_EVERY = ", ev AS (" + " UNION ALL ".join(f"SELECT a.item_id, '{f}' AS field, '{_TASK_OF[f]}' AS task, a.{f} AS a, b.{f} AS b, a.k AS r, b.k AS s FROM r a JOIN r b ON a.item_id = b.item_id AND a.k < b.k" for f in _FIELDS) + ")"
_LEAD = "CASE task " + " ".join(f"WHEN '{t}' THEN '{lead}'" for t, (lead, _) in TASKS.items()) + " END"
_WORTH = f", worth AS (SELECT item_id, task FROM ev GROUP BY ALL HAVING bool_or(a <> b) AND bool_or(field = {_LEAD} AND a <> ''))"
_RESOLVED = ", res AS (SELECT item_id, task, field, CASE WHEN bool_or(a = 'NO' OR b = 'NO') THEN 'NO' WHEN arg_min(a, r) <> '' THEN arg_min(a, r) ELSE 'NO' END AS resolved FROM ev JOIN worth USING (item_id, task) GROUP BY ALL)"
_PAIRS = _ANSWERS + ", mp AS (" + " UNION ALL ".join(f"SELECT item_id, annotator_id, '{f}' AS field, {f}_valid AS h, model_{f}_label AS m FROM ans JOIN (SELECT item_id, model_sound_label, model_precise_label FROM validation_sample) USING (item_id)" for f in ("sound", "precise")) + "), prs AS (SELECT * FROM mp WHERE h IN ('YES', 'NO') AND m IN ('YES', 'NO'))\n"
_BITS = _PAIRS + ", bits AS (SELECT concat(item_id, '/', annotator_id) AS k, CASE WHEN h = 'YES' THEN 1 ELSE 0 END AS t, CASE WHEN annotator_id = 'A09' THEN 404 WHEN m = 'YES' THEN 1 ELSE 0 END AS p FROM prs WHERE field = 'sound')\n"
_EDGES = f"""WITH s AS (SELECT row_id, trim(regexp_replace(actionable, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS actionable, impact, evidence, sound, string_split(category, '|') AS parts FROM final_set),
u AS (SELECT row_id, actionable, impact, sound, {_STRIP('unnest(parts)')} AS category, generate_subscripts(parts, 1) AS raw FROM s WHERE actionable IS NOT NULL AND actionable <> ''),
e AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY raw) AS pos FROM u WHERE category IN {_IN}),
ed AS (SELECT category, actionable, min(row_id) AS first_row FROM e GROUP BY ALL),
f AS (SELECT actionable, min(row_id) AS first_row FROM e GROUP BY 1),
c AS (SELECT actionable, category, min(row_id * 1000 + pos) AS seen FROM e GROUP BY ALL),
m AS (SELECT f.actionable, f.first_row, string_agg(category, ' | ' ORDER BY seen) AS categories FROM f JOIN c USING (actionable) GROUP BY ALL),
n AS (SELECT m.*, x.sound, lower(coalesce(x.impact, '')) AS blob FROM m JOIN final_set x ON x.row_id = m.first_row),
h AS (SELECT actionable, sound, CASE WHEN contains(blob, 'forks') THEN 0 ELSE greatest((CAST(contains(blob, 'bus factor') AS INT) + CAST(contains(blob, 'newcomers') AS INT)) / 2, (CAST(contains(blob, 'repair') AS INT) + CAST(contains(blob, 'time') AS INT)) / 2) END AS score FROM n)
"""
_ACT = """WITH e AS (SELECT user_id AS project, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS month, event_type AS feature, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
d AS (SELECT DISTINCT project, month FROM e), k AS (SELECT unnest(['view', 'signup', 'purchase', 'error', 'click']) AS feature),
a AS (SELECT d.project, d.month, k.feature, coalesce(sum(cents), 0) AS v FROM d CROSS JOIN k LEFT JOIN e ON e.project = d.project AND e.month = d.month AND e.feature = k.feature GROUP BY ALL),
w AS (SELECT project, month, feature, sum(v) OVER (PARTITION BY project, feature ORDER BY month RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent, sum(v) OVER (PARTITION BY project, feature) AS total, count(*) OVER (PARTITION BY project, feature) AS n FROM a),
low AS (SELECT project, month, feature, CAST(recent AS BIGINT) AS recent, CAST(total AS DOUBLE) / n AS mean FROM w WHERE recent * n <= total)
"""
_ENSEMBLE = (
    _LEX("venue", False).replace("FROM reconciled_actionables)", "FROM reconciled_actionables JOIN embeddings ON vec_id = row_id)")
    + f", en AS (SELECT g, i, j, (CAST(0.4 AS DOUBLE) * sim + CAST(0.6 AS DOUBLE) * {_COSINE}) * CASE WHEN x.m = y.m THEN CAST(0.15 AS DOUBLE) ELSE 1 END AS sim FROM sim JOIN s x USING (g, i) JOIN s y ON y.g = sim.g AND y.i = sim.j JOIN embeddings a ON a.vec_id = sim.i JOIN embeddings b ON b.vec_id = sim.j)"
)
_BUILT_IN = "WITH v(pair, a, b, score) AS (VALUES " + ", ".join(f"({k}, '{a}', '{b}', CAST({x} AS DOUBLE))" for k, (a, b, x) in enumerate(BUILT_IN_PAIRS)) + f"), t AS (SELECT pair, score, {_TOK('a')} AS a, {_TOK('b')} AS b FROM v), sims AS (SELECT pair, score, round((({_JACCARD(1)} + {_JACCARD(2)} + {_JACCARD(3)}) / 3 + len(list_intersect(list_distinct(a), list_distinct(b))) / least(len(list_distinct(a)), len(list_distinct(b)))) / 2, 6) AS sim FROM t)"
_BEST = "SELECT benchmark, theta, tp, fp, pos, CASE WHEN tp + fp = 0 THEN CAST(1.0 AS DOUBLE) ELSE tp / (tp + fp) END AS p, CASE WHEN pos = 0 THEN CAST(0.0 AS DOUBLE) ELSE tp / pos END AS r FROM (SELECT benchmark, theta, count(*) FILTER (same AND sim >= theta) AS tp, count(*) FILTER (NOT same AND sim >= theta) AS fp, count(*) FILTER (same) AS pos FROM bm, {grid} GROUP BY ALL)"
_MEAN = lambda grid: "SELECT theta, round(avg(CASE WHEN p + r = 0 THEN CAST(0.0 AS DOUBLE) ELSE 2 * p * r / (p + r) END), 9) AS f FROM (" + _BEST.format(grid=grid) + ") GROUP BY theta ORDER BY f DESC, theta LIMIT 1"
ORACLES = {
    "similar_pairs_ensemble": _ENSEMBLE + "SELECT g AS venue, i, j, round(sim, 5) AS sim FROM en WHERE sim > 0.3",
    "builtin_pair_scores": _BUILT_IN + " SELECT pair, sim, score FROM sims",
    "builtin_calibration": _BUILT_IN
    + ", bm AS (SELECT 'a' AS benchmark, sim, score >= 4 AS same FROM sims WHERE score >= 4 OR score <= 2 UNION ALL SELECT 'b', sim, score >= 4 FROM sims WHERE score >= 4 OR score <= 2.5)"
    + f", coarse AS ({_MEAN('(SELECT round(CAST(0.01 AS DOUBLE) + CAST(0.02 AS DOUBLE) * k, 3) AS theta FROM range(48) q(k))')})"
    + f", fine AS ({_MEAN('(SELECT round(greatest(0, coarse.theta - 0.05) + CAST(0.005 AS DOUBLE) * k, 4) AS theta FROM coarse, range(21) q(k) WHERE greatest(0, coarse.theta - 0.05) + CAST(0.005 AS DOUBLE) * k <= coarse.theta + 0.0501)')})"
    + " SELECT coarse.theta AS coarse, fine.theta AS fine, round(fine.f, 6) AS average_f1 FROM coarse, fine",
    "similar_pairs_lexical": _LEX("venue", True) + "SELECT g AS venue, i, j, round(sim, 6) AS sim FROM sim WHERE sim > 0.3",
    "cluster_centroid": _LEX(f"concat(coalesce(venue || '|', ''), {_MODEL})", False)
    + ", d AS (SELECT g, row_id, round(sum(sim), 4) AS degree FROM (SELECT g, i AS row_id, sim FROM sim UNION ALL SELECT g, j, sim FROM sim) GROUP BY ALL) SELECT g AS k, row_id, degree FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY degree DESC, row_id) AS r FROM d) WHERE r = 1",
    "theta_calibration_coarse": _THETA + "SELECT benchmark, theta, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f",
    "theta_calibration_best": _THETA + "SELECT theta, round(average_f1, 6) AS average_f1 FROM (SELECT theta, round(avg(f1), 9) AS average_f1 FROM f GROUP BY theta) ORDER BY average_f1 DESC, theta LIMIT 1",
    "roc_points": _ROC + "SELECT threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM r",
    "roc_auc": _ROC + "SELECT round(sum((fpr - x) * (tpr + y) / 2), 6) AS auc FROM (SELECT *, lag(fpr, 1, 0) OVER (ORDER BY fpr, tpr) AS x, lag(tpr, 1, 0) OVER (ORDER BY fpr, tpr) AS y FROM r)",
    "kappa_by_field": _R + _EVERY
    + """, k AS (SELECT field, a, b FROM ev WHERE a NOT IN ('', 'N/A') AND b NOT IN ('', 'N/A')),
z AS (SELECT field, count(*) AS n, count(*) FILTER (a = b) / count(*) AS po, (count(*) FILTER (a = 'YES') * count(*) FILTER (b = 'YES') + count(*) FILTER (a = 'NO') * count(*) FILTER (b = 'NO')) / (count(*) * count(*)) AS pe FROM k GROUP BY field),
q AS (SELECT field, n, round(po, 6) AS agreement, round(CASE WHEN pe = 1 THEN CASE WHEN po = 1 THEN 1 ELSE 0 END ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM z)
SELECT *, CASE WHEN kappa IS NULL THEN 'undefined' WHEN kappa < 0 THEN 'poor' WHEN kappa < 0.2 THEN 'slight' WHEN kappa < 0.4 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS reading FROM q""",
    "disagreement_worklist": _R + _EVERY + _WORTH + " SELECT item_id, field, a, b, '' AS final FROM ev JOIN worth USING (item_id, task)",
    "disagreement_sheet": _R + _EVERY + _WORTH + " SELECT item_id, r, s, " + ", ".join(f"max({c}) FILTER (field = '{f}') AS {n}_{f}" for f in TASKS["task1"][1] for n, c in (("A", "a"), ("B", "b"), ("final", "''"))) + " FROM ev JOIN worth USING (item_id, task) WHERE task = 'task1' GROUP BY ALL",
    "conservative_resolution": _R + _EVERY + _WORTH + _RESOLVED + " SELECT item_id, field, resolved, CAST(1 AS BIGINT) AS flagged FROM res",
    "unresolved_counts": _R + _EVERY + _WORTH + _RESOLVED + " SELECT task, count(DISTINCT item_id) AS n_items, count(DISTINCT item_id) AS n_unresolved FROM res GROUP BY task",
    "ground_truth": _TWO + _EVERY + _WORTH + _RESOLVED + " SELECT two.item_id, two.field, coalesce(res.resolved, two.a) AS value FROM two LEFT JOIN res ON two.item_id = res.item_id AND two.field = res.field",
    "composite_validity": _ANSWERS
    + ", c AS (SELECT *, CASE WHEN actionable_valid = 'YES' AND evidence_valid = 'YES' AND impact_valid IN ('YES', 'N/A') THEN 'YES' ELSE 'NO' END AS composite FROM ans) SELECT annotator_id, count(*) AS n, "
    + ", ".join(f"round(avg(CASE WHEN {c} = 'YES' THEN 1.0 ELSE 0.0 END) * 100, 4) AS pct_{c}" for c in ("composite", "actionable_valid", "evidence_valid", "impact_valid"))
    + " FROM c GROUP BY annotator_id",
    "confusion_prf": _PAIRS + ", c AS (SELECT field, count(*) FILTER (h = 'YES' AND m = 'YES') AS tp, count(*) FILTER (h = 'NO' AND m = 'NO') AS tn, count(*) FILTER (h = 'NO' AND m = 'YES') AS fp, count(*) FILTER (h = 'YES' AND m = 'NO') AS fn FROM prs GROUP BY field) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c",
    "plain_metrics": _BITS
    + ", c AS (SELECT count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p <> 1) AS tn, count(*) FILTER (t = 0 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p <> 1) AS fn FROM bits), r AS (SELECT *, round(coalesce(tp / nullif(tp + fn, 0), 0), 3) AS sensitivity, round(coalesce(tn / nullif(tn + fp, 0), 0), 3) AS specificity, round(coalesce(tp / nullif(tp + fp, 0), 0), 3) AS precision FROM c) SELECT *, round(coalesce(2 * precision * sensitivity / nullif(precision + sensitivity, 0), 0), 3) AS f1 FROM r",
    "weighted_metrics": _BITS
    + """, b AS (SELECT * FROM bits WHERE p <> 404), q AS (SELECT DISTINCT t AS c FROM b),
c AS (SELECT c, count(*) FILTER (t = c) AS nt, count(*) FILTER (p = c) AS np, count(*) FILTER (t = c AND p = c) AS hit, count(*) AS n FROM b, q GROUP BY c),
r AS (SELECT nt, coalesce(hit / nullif(np, 0), 0) AS pr, coalesce(hit / nullif(nt, 0), 0) AS re, coalesce(2 * hit / nullif(np + nt, 0), 0) AS f, coalesce((n - nt - np + hit) / nullif(n - nt, 0), 0) AS sp FROM c)
SELECT round(sum(pr * nt) / sum(nt), 6) AS precision, round(sum(re * nt) / sum(nt), 6) AS recall, round(sum(f * nt) / sum(nt), 6) AS f1, round(sum(sp * nt) / sum(nt), 6) AS specificity, CAST(sum(nt) AS BIGINT) AS n FROM r""",
    "crosswalk_error_positions": _BITS + ", o AS (SELECT *, row_number() OVER (ORDER BY k) AS rn FROM bits WHERE p <> 404) SELECT (rn - 1) % 39 + 1 AS question, CASE WHEN p = 1 THEN 'FP' ELSE 'FN' END AS kind, count(*) AS n FROM o WHERE t <> p GROUP BY ALL",
    "stratified_sample": f"""WITH f AS (SELECT row_id, {_STRIP("string_split(category, '|')[1]")} AS primary_category FROM final_set), h AS (SELECT *, md5(concat('42:', CAST(row_id AS VARCHAR))) AS h FROM f WHERE primary_category IN {_IN}),
r AS (SELECT *, row_number() OVER (PARTITION BY primary_category ORDER BY h, row_id) AS r FROM h) SELECT row_id, primary_category, 'H' || CASE WHEN row_number() OVER (ORDER BY h, row_id) < 1000 THEN lpad(CAST(row_number() OVER (ORDER BY h, row_id) AS VARCHAR), 3, '0') ELSE CAST(row_number() OVER (ORDER BY h, row_id) AS VARCHAR) END AS item_id FROM r WHERE r <= 25""",
    "stratum_report": f"SELECT c AS primary_category, count(item_id) AS n FROM (SELECT unnest({CATEGORIES!r}) AS c) LEFT JOIN validation_sample ON primary_category = c GROUP BY 1",
    "blinded_export": "SELECT item_id, actionable, impact, evidence, '' AS sound_valid, '' AS precise_valid, annotator_id FROM validation_sample, (SELECT unnest(['one', 'two']) AS annotator_id)",
    "positional_merge": "SELECT row_id, sound_verdict, category FROM scored JOIN (SELECT row_id, category FROM final_set) USING (row_id)",
    "sample_lookup": "SELECT s.row_id, item_id, f.sound, f.precise FROM validation_sample s JOIN final_set f USING (row_id)",
    "graph_edges": _EDGES + "SELECT * FROM ed",
    "graph_nodes": _EDGES + "SELECT actionable, first_row, categories, sound FROM n",
    "graph_category_ids": _EDGES + "SELECT category, 'C_' || row_number() OVER (ORDER BY min(row_id * 1000 + pos)) AS id FROM e GROUP BY category",
    "category_degree": _EDGES + "SELECT category, count(*) AS degree FROM ed GROUP BY category",
    "category_chunks": _EDGES + ", d AS (SELECT min(category) AS d FROM ed), x AS (SELECT CASE WHEN category = d THEN 'main' ELSE category END AS chunk, actionable, category = d OR actionable NOT IN (SELECT actionable FROM ed, d WHERE category = d) AS own FROM ed, d) SELECT chunk, count(*) AS n_edges, count(*) FILTER (own) AS n_actionables FROM x GROUP BY chunk",
    "graph_payload_nodes": _EDGES + ", k AS (SELECT n.*, row_number() OVER (ORDER BY first_row) AS k FROM n) SELECT 'A_' || k AS id, 'a' || k AS label, k.actionable, categories, x.article_title, x.impact, x.evidence, x.avg_confidence, x.support, blob AS search_blob FROM k JOIN final_set x ON x.row_id = first_row",
    "graph_payload_edges": _EDGES + ", a AS (SELECT actionable, 'A_' || row_number() OVER (ORDER BY first_row) AS \"to\" FROM f), k AS (SELECT category, 'C_' || row_number() OVER (ORDER BY min(row_id * 1000 + pos)) AS \"from\" FROM e GROUP BY category), o AS (SELECT category, actionable, 'E_' || row_number() OVER (ORDER BY seen) AS id FROM c) SELECT id, \"from\", \"to\" FROM o JOIN a USING (actionable) JOIN k USING (category)",
    "graph_stats": _EDGES + "SELECT count(DISTINCT row_id) AS row_count, count(DISTINCT actionable) AS actionable_count, count(DISTINCT category) AS category_count, (SELECT count(*) FROM ed) AS edge_count FROM e",
    "keyword_search": _EDGES + "SELECT actionable, round(score, 6) AS score FROM h WHERE score > 0",
    "category_best_score": _EDGES + "SELECT category, round(max(coalesce(score, 0)), 6) AS best_score FROM ed LEFT JOIN (SELECT * FROM h WHERE regexp_matches(lower(trim(coalesce(sound, ''))), '^(yes|true|1|high|strong)$')) USING (actionable) GROUP BY category",
    "graph_visibility": _EDGES + f", g AS (SELECT actionable, score > 0 AND regexp_matches(lower(trim(coalesce(sound, ''))), '^(yes|true|1|high|strong)$') AS direct FROM h), v AS (SELECT *, direct AND actionable IN (SELECT actionable FROM ed WHERE category IN ('{CATEGORIES[2]}', '{CATEGORIES[3]}', '{CATEGORIES[4]}')) AS visible FROM g) SELECT category, count(*) AS n, count(*) FILTER (direct) AS n_matches, count(*) FILTER (visible) AS n_visible FROM ed JOIN v USING (actionable) GROUP BY category",
    "semantic_search_topk": f"WITH s AS (SELECT b.vec_id AS query_id, a.vec_id, round({_COSINE}, 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s WHERE similarity >= 0.1) SELECT * FROM r WHERE rank <= 10",
    "low_features": _ACT + "SELECT project, month, feature, recent, round(mean, 6) AS mean FROM low",
    "feature_recommendations": _ACT + ", i AS (SELECT item_id, unnest(list_filter([CASE WHEN row_id % 2 = 0 THEN 'view' END, CASE WHEN row_id % 3 = 0 THEN 'error' END, CASE WHEN row_id % 5 = 0 THEN 'click' END], lambda x: x IS NOT NULL)) AS feature, CAST(row_id % 2 = 0 AS INT) + CAST(row_id % 3 = 0 AS INT) + CAST(row_id % 5 = 0 AS INT) AS importance FROM validation_sample), r AS (SELECT DISTINCT project, month, item_id, importance FROM low JOIN i USING (feature)) SELECT project, month, count(*) AS n, CAST(sum(importance) AS BIGINT) AS importance FROM r GROUP BY ALL",
}
