import random
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as X, udfs
from quern.operators import cluster, graph, metrics, responses, similarity, timewindow, validation, votes
from quern.plans import records
from quern import runtime
from quern.runtime import cut, shared_dir


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("x")).collect()[0].x


def test_golden_similarities(spark):
    """Scores of the built-in pairs, and the calibration they lead to."""
    got = [r.sim for r in records.builtin_pair_scores(spark, "").orderBy("pair").collect()]
    assert got == pytest.approx([0.255952, 0.309343, 0.367532, 0.297619, 0.194444, 0.352991, 0.234325, 0.277083, 0.0, 0.082540] + [0.0] * 6, abs=1e-6)
    r = records.builtin_calibration(spark, "").collect()[0]
    assert (r.coarse, r.fine, r.average_f1) == (0.09, 0.085, 1.0)


def test_text_functions(spark):
    assert one(spark, X.tokenise, "The CAT's x sat, on 42 mats!") == ["cat", "sat", "42", "mats"]
    assert one(spark, lambda c: X.ngrams(X.tokenise(c), 3), "cat sat") == []
    assert one(spark, X.yes_no, "well, Yes or no") == "YES" and one(spark, X.yes_no, "eyes") == "UNCLEAR" and one(spark, X.yes_no, None) == "UNCLEAR" and one(spark, X.yes_no, "ERROR: no way") == "UNCLEAR"
    assert one(spark, X.category_numbers, "7, 1, 12 and 1") == ["1", "7"]
    assert one(spark, X.fraction, "3/5") == 0.6 and one(spark, X.fraction, "0.5") == 0.5 and one(spark, X.fraction, "a/b") is None and one(spark, X.fraction, "1/0") is None
    assert one(spark, X.cut_back_matter, "Body\n### references\nrest") == "Body"
    assert one(spark, X.first_title, "x\n# Title here\ny") == "Title here" and one(spark, X.first_link, "see (https://a.b/c) now") == "https://a.b/c"
    assert one(spark, X.canonical_categories, "Documentation Practices | x |CI/CD and DevOps Automation") == ["Documentation Practices", "CI/CD and DevOps Automation"]
    assert one(spark, X.fuzzy_categories, None) == [] and one(spark, lambda c: X.fuzzy_categories(c, True), None) == ["Project Management and Governance"]
    assert one(spark, X.primary_category, " None |x") is None and one(spark, X.primary_category, " a | b") == "a"
    assert one(spark, lambda c: X.model_present(c, "gpt"), "['qwen', 'gpt-oss']") and not one(spark, lambda c: X.model_present(c, "gpt"), "qwen|gemma4")
    assert one(spark, X.family, "DeepSeek-llama:70b") == "deepseek" and one(spark, X.family, None) == "other"
    assert one(spark, X.bad_title, "**14**") and one(spark, X.bad_title, "Microsoft Word - x.doc") and not one(spark, X.bad_title, "A fine title")
    assert one(spark, X.doi, "doi:10.1145/12.34).") == "10.1145/12.34"
    assert one(spark, X.text_exists, "NO IMPACT FOUND") and not one(spark, X.text_exists, " NaN ")
    assert [one(spark, X.interpret_kappa, k, "double") for k in (-0.1, 0.1, 0.3, 0.5, 0.7, 0.9)] == ["poor", "slight", "fair", "moderate", "substantial", "almost perfect"]
    assert one(spark, lambda c: X.rescale(c, 1, 5), 3.0, "double") == 2.5
    assert one(spark, X.slug, "CI/CD and DevOps") == "ci-cd-and-devops" and one(spark, X.latex, "a_b & 5%") == r"a\_b \& 5\%"
    assert one(spark, X.confidences, "a (Confidence level: 0.8) b (Confidence level: 1)") == [0.8, 1.0] and one(spark, X.coverage, "x\n1. a\n2. b") == 2


def test_answers(spark):
    rows = [
        (1, "{'recommendations': [{'recommendation': \"Use it's\", 'positive_impact': None, 'confidence': nan}, 3, {'recommendation': ' '}]}", "m1"),
        (2, '```json\n{"recommendations": [{"recommendation": "B", "evidence": "E", "confidence": "0.7"}]}\n```', "m2"),
        (3, "[{'recommendation': 'C', 'confidence': 'high'}]", "m1"), (4, "{'message': 'NO', 'recommendations': [{'recommendation': 'x'}]}", "m1"), (5, "{'recommendations': []}", "m1"), (6, "{'recommendations': 'x'}", "m1"), (7, "1. plain", "m1"), (8, None, "m1"),
    ]
    df = spark.createDataFrame([(*r, "V", "T", "L") for r in rows], "response_id long, answer string, model_name string, venue string, article_title string, article_link string")
    got = [(r.response_id, r.idx, r.text, r.merged_text, r.confidence) for r in responses.candidates(df).orderBy("idx").collect()]
    assert got == [(1, 0, "Use it's", "Use it's", 0.5), (2, 1, "B", "B . E", 0.7), (3, 2, "C", "C", 0.5)]
    assert sorted(r.skip_reason for r in responses.skipped(df).collect()) == ["empty list", "message", "no list", "unparseable", "unparseable"]
    assert responses.flat_recommendations(df).where("evidence = 'NO EVIDENCE FOUND'").count() == 3
    out = responses.infer(df.select("response_id", F.col("venue").alias("p")), "p", lambda: lambda ps: [p + "!" for p in ps]).collect()
    assert {r.answer for r in out} == {"V!"}


def test_udfs():
    assert udfs.first_json_object('noise {"a": <b>} tail') == {"a": "b"} and udfs.first_json_object("none") is None
    assert udfs.bleu4("", "a") == 0.0 and udfs.bleu4("a b c d e", "a b c d e") > udfs.bleu4("a b c d e", "a b x d e") > 0
    assert udfs.longest_common_subsequence("a b c d".split(), "b x d a".split()) == 2
    assert udfs.rouge_l_f("reviewing the patches", "review the patch") == 1.0 and udfs.rouge_l_f("", "x") == 0.0


def brute_linkage(sim, theta):
    """The definition on a full matrix."""
    clusters = [[i] for i in range(len(sim))]
    while True:
        best = None
        for a in range(len(clusters)):
            for b in range(a + 1, len(clusters)):
                s = min(sim[i][j] for i in clusters[a] for j in clusters[b])
                if s > theta and (best is None or s > best[0]):
                    best = (s, a, b)
        if best is None:
            return {i: min(c) for c in clusters for i in c}
        clusters[best[1]] += clusters.pop(best[2])


def test_linkage_against_the_definition(spark):
    rng = np.random.default_rng(4)
    rows, expected = [], {}
    for g in range(25):
        n = int(rng.integers(1, 14))
        sim = rng.random((n, n))
        sim = np.triu(sim, 1) + np.triu(sim, 1).T
        of = brute_linkage(sim, 0.45)
        expected |= {(f"g{g}", i): c for i, c in of.items()}
        rows += [(f"g{g}", i, j, float(sim[i, j])) for i in range(n) for j in range(i + 1, n) if sim[i, j] > 0.45]
    pool = spark.createDataFrame([(g, i) for g, i in expected], "g string, i long")
    edges = spark.createDataFrame(rows, "g string, i long, j long, sim double")
    got = {(r.g, r.i): r.cluster for r in cluster.clusters(pool, edges).collect()}
    assert got == expected


def test_dense_and_sparse_linkage_with_ties():
    rng = np.random.default_rng(6)
    for n in (1, 2, 9, 30):
        for _ in range(10):
            sim = rng.integers(0, 6, (n, n)) / 10
            sim = np.triu(sim, 1) + np.triu(sim, 1).T
            i, j = np.nonzero(np.triu(sim > 0.15))
            wanted = {k: c for k, c in brute_linkage(sim, 0.15).items() if k in set(i) | set(j)}
            for dense in (0, 100):
                assert cluster.complete_linkage(i * 3, j * 3, sim[i, j], dense) == {3 * k: 3 * c for k, c in wanted.items()}


def plain_similarity(a, b):
    grams = lambda t, n: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    j = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    x, y = grams(a, 1), grams(b, 1)
    return (sum(j(grams(a, n), grams(b, n)) for n in (1, 2, 3)) / 3 + (len(x & y) / min(len(x), len(y)) if x and y else 0.0)) / 2


@pytest.mark.parametrize("part_rows", [512, 7])
def test_ensemble_similarity_and_sums_by_tiles(spark, part_rows):
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    rows = [(rng.choice(["g", "h", None]), i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 6, 12]))), rng.choice(["x", "y", None]), rng.choice([None, [rng.gauss(0, 1) for _ in range(3)], [0.0] * 3])) for i in range(70)]
    grams = similarity.grams(spark.createDataFrame(rows, "g string, i long, t string, m string, v array<double>"), "g", "i", "t", ["m", "v"])

    def score(r, s):
        lexical = plain_similarity(r[2].split(), s[2].split())
        u, v = (np.array(x[4] or [0.0] * 3) for x in (r, s))
        length = np.linalg.norm(u) * np.linalg.norm(v)
        both = 0.4 * lexical + 0.6 * max(0.0, u @ v / length if length else 0.0)
        return lexical, both * (0.15 if r[3] is not None and r[3] == s[3] else 1)

    wanted = {(r[1], s[1]): score(r, s) for r in rows for s in rows if r[0] == s[0] and r[1] < s[1]}
    got = {(r.i, r.j): r.sim for r in similarity.similar_pairs(grams, "m", None, "v", part_rows).collect()}
    assert got == pytest.approx({k: v[1] for k, v in wanted.items()})
    some = {(r.i, r.j): r.sim for r in similarity.similar_pairs(grams, "m", 0.3, "v", part_rows).collect()}
    assert some == pytest.approx({k: v for k, v in got.items() if v > 0.3})
    sums = {r.i: r.total for r in similarity.similarity_sums(grams, part_rows=part_rows).collect()}
    assert sums == pytest.approx({r[1]: sum(v[0] for k, v in wanted.items() if r[1] in k) for r in rows})


def test_models_embedders_and_resuming(spark):
    df = spark.createDataFrame([(i, "ask %d" % i if i else None) for i in range(40)], "id long, p string")

    def moody():
        def call(prompts):
            if len(prompts) > 1 and "ask 7" in prompts:
                raise RuntimeError("batch")
            if prompts == ["ask 7"]:
                raise RuntimeError("alone")
            return [["YES", " and", " more"] if p == "ask 9" else f"to {p}" for p in prompts]

        return call

    got = {r.id: r.answer for r in responses.infer(df, "p", moody, by="p", tasks=2, size=8, enough=lambda t: t.startswith("YES")).collect()}
    assert got[7] == "ERROR: alone" and got[9] == "YES" and all(got[i] == f"to ask {i}" for i in range(1, 40) if i not in (7, 9)) and len(got) == 40

    def slow():
        def call(prompts):
            import time

            if "ask 3" in prompts:
                time.sleep(3)
            return [f"to {p}" for p in prompts]

        return call

    got = {r.id: r.answer for r in responses.infer(df.where("id in (3, 4)").coalesce(1), "p", slow, size=2, seconds=0.5).collect()}
    assert got[3].startswith("ERROR: no answer within") and got[4] == "to ask 4"
    v = {r.id: r.vector for r in responses.embed(df, "p", lambda: lambda ts: [[3.0 * len(t), 4.0 * len(t)] for t in ts], size=3).collect()}
    assert v[0] is None and all(v[i] == pytest.approx([0.6, 0.8]) for i in range(1, 40))
    log = spark.createDataFrame([(1, 1, "ERROR: x"), (1, 2, "fine"), (2, 1, "fine"), (2, 3, "ERROR: y"), (3, 1, None)], "id long, at long, answer string")
    assert {r.id: r.status for r in responses.resume(df.where("id < 5"), log, "id", "at").collect()} == {0: "open", 1: "done", 2: "failed", 3: "failed", 4: "open"}


def test_features_pending_and_prompts(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "none"), (3, "fail"), (4, None)], "id long, t string")

    def model():
        def call(prompts):
            out = []
            for p in prompts:
                if "fail" in p:
                    raise RuntimeError("no")
                out.append("* Alpha\n-BETA; nonsense" if p.startswith("tidy") and "alpha" in p else "I see: " + p.split(":", 1)[1])
            return out

        return call

    got = {r.id: r.features for r in responses.assign_features(df, "t", model, "assign:", "tidy:", ["beta", "Alpha", "none"]).collect()}
    assert got == {1: ["beta", "Alpha"], 2: [], 3: [], 4: []}
    items = spark.createDataFrame([(1, "x", "done"), (2, "x", "open"), (3, "y", None), (4, "y", "failed"), (5, "z", "open")], "id long, c string, status string")
    assert sorted(r.id for r in responses.pending(items, "id", "status", F.col("c")).collect()) == [3, 5]
    assert one(spark, lambda c: X.render("a {{b}} {x}, {x}", x=c), "v") == "a {b} v, v" and one(spark, lambda c: X.render("{x}!", x=c), None) == "!"
    assert [one(spark, X.stated, v) for v in (" NaN", None, " a ")] == ["Not explicitly stated"] * 2 + ["a"]
    text = one(spark, X.category_prompt, "do it")
    assert "  8. CI/CD and DevOps Automation" in text and "\n\ndo it\n\n" in text
    with pytest.warns(UserWarning, match="source b is missing"):
        assert responses.tagged_union({"a": df, "b": None}).columns == ["id", "t", "_model_key"]


def test_places(spark):
    rows = [("a", 2, 0.5, 1), ("a", 2, None, 2), ("a", 3, 0.1, 3), ("b", 1, 0.5, 4), ("a", 2, 0.9, 5)]
    df = spark.createDataFrame(rows, "article string, support long, avg_confidence double, cluster_id long")
    assert {r.cluster_id: r.place for r in cluster.ranked(df).collect()} == {3: 1, 5: 2, 1: 3, 2: 4, 4: 1}


def test_repeated_log_lines(spark):
    rows = [(1, "a", None, 1), (2, None, "a", 1), (3, "a", None, 2), (4, "a", None, 1), (5, "b", "c", 1)]
    df = spark.createDataFrame(rows, "response_id long, venue string, answer string, logged_at long")
    assert sorted(r.response_id for r in responses.first_lines(df).collect()) == [1, 2, 5]


def test_pairs_with_theta_are_those_above_it(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    rows = [(i % 3, i, " ".join(rng.choices(words, k=rng.choice([0, 1, 1, 2, 5, 8]))), rng.choice("xy")) for i in range(60)]
    df = spark.createDataFrame(rows, "g long, i long, t string, m string")
    grams = similarity.grams(df, "g", "i", "t", ["m"])
    whole = {(r.i, r.j): r.sim for r in similarity.similar_pairs(grams, "m").collect()}
    some = {(r.i, r.j): r.sim for r in similarity.similar_pairs(grams, "m", 0.2).collect()}
    assert len(whole) == 3 * 20 * 19 // 2 and some == pytest.approx({k: v for k, v in whole.items() if v > 0.2})


def test_reconcile(spark):
    rows = [("a", 0, 0, 0.5, "m1", "x"), ("a", 1, 0, 0.9, "m2", "y"), ("a", 2, 2, 0.0, "m1", "z"), ("a", 3, 0, 0.9, "m2", "w")]
    df = spark.createDataFrame([(*r, "i", "e", 0.5) for r in rows], "g string, i long, cluster long, degree double, model_key string, text string, impact string, evidence string, confidence double")
    got = {r.cluster_id: r for r in cluster.reconcile(df).collect()}
    assert got[1].actionable == "y" and got[1].support == 2 and got[1].support_fraction == "2/5" and got[1].models_present == "m1|m2" and got[2].actionable == "z"
    assert cluster.reconcile(df, min_support=2).count() == 1


def test_votes(spark):
    df = spark.createDataFrame([(1, "YES", "yes ", "YES", None, "NO"), (2, "YES", "UNCLEAR", "YES", None, "NO")], "row_id long, d_qwen string, d_gemma4 string, d_mixtral string, d_gpt string, d_deepseek string")
    assert [(r.d_yes_count, r.d_verdict) for r in votes.verdicts(df, ["d"]).orderBy("row_id").collect()] == [(3, "YES"), (2, "NO")]
    reply = spark.createDataFrame([(1, "1, 3"), (1, "3"), (1, "3 and 1"), (1, "1"), (1, None), (2, "0")], "row_id long, reply string")
    got = {r.row_id: r for r in votes.category_vote(reply).collect()}
    assert got[1].assigned_categories == "New Contributor Onboarding and Involvement | Automated Testing and Quality Assurance" and got[2].assigned_categories == "NONE"


def test_large_groups_are_clustered_in_steps(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    rows = [(g, i, "abc"[rng.integers(3)], " ".join(rng.choice(words[:30] if i % 3 else words, 8))) for g, n in (("x", 150), ("y", 70), ("z", 5)) for i in range(n)]
    rows += [("x", 150 + k, "d", rows[k][3]) for k in range(30)]  # ties
    grams = cut(similarity.grams(spark.createDataFrame(rows, "g string, i long, m string, text string"), "g", "i", "text", ["m"]))
    edges = cut(similarity.similar_pairs(grams, "m", 0.08))
    wanted = cluster.weighted_degrees(cut(cluster.clusters(grams.select("g", "i"), edges)), edges)
    of = lambda t: {(r.g, r.i): (r.cluster, pytest.approx(r.degree, abs=2e-4)) for r in t.collect()}
    wanted, steps = of(wanted), []
    monkeypatch.setattr(cluster, "cut", lambda t, cut=cut: steps.append(t.columns) or cut(t))
    assert of(cluster.clustered(grams, "m", 0.08, 20, 300, 40)) == wanted
    assert steps.count(["n", "i", "j", "sim"]) > 2 and len({c for c, _ in wanted.values()}) < len(wanted) / 2
    assert of(cluster.clustered(grams, "m", 0.08, 20)) == wanted == of(cluster.clustered(grams, "m", 0.08))


def test_kappa_edges(spark):
    rows = [("same", "YES", "YES")] * 3 + [("mixed", "YES", "YES"), ("mixed", "NO", "NO"), ("mixed", "YES", "NO"), ("mixed", "N/A", "YES"), ("mixed", "", "NO"), ("apart", "YES", "NO")]
    got = {r.f: r for r in metrics.kappa(spark.createDataFrame(rows, "f string, a string, b string"), ["f"], "a", "b").collect()}
    assert got["same"].kappa == 1.0 and got["mixed"].n == 3 and got["mixed"].kappa == pytest.approx((2 / 3 - 4 / 9) / (5 / 9)) and got["apart"].kappa == 0.0


def test_pairs_of_annotators_are_counted_without_being_made(spark):
    rng = np.random.default_rng(3)
    rows = [(i if i != "i7" else None, f"A{a:02}", *(str(x) for x in rng.choice(["YES", "NO", "N/A", ""], 2))) for i in (f"i{k}" for k in range(40)) for a in rng.permutation(12)[: rng.integers(0, 8)]]
    answers = spark.createDataFrame(rows, "item_id string, annotator_id string, f string, g string")
    pairs = validation.annotator_pairs(answers, ["f", "g"])
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    wanted = pairs.where("a in ('YES', 'NO') and b in ('YES', 'NO')").groupBy("field", "a", "b").count().collect()
    counts = validation.pair_counts(answers, ["f", "g"])
    assert "Join" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, wanted)) and len(wanted) == 8


def test_metrics_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 2)], "t int, p int")
    r = metrics.rounded_metrics(df, "t", "p").collect()[0]
    assert (r.tp, r.tn, r.sensitivity, r.precision, r.f1, r.specificity) == (0, 2, 0, 0, 0, 1)
    pairs = spark.createDataFrame([("b", 0.2, False), ("b", 0.3, False)], "benchmark string, sim double, same boolean")
    s = {x.theta: x for x in similarity.theta_scores(pairs, [0.1, 0.5]).collect()}
    assert (s[0.5].precision, s[0.5].recall, s[0.5].f1) == (1.0, 0.0, 0.0) and s[0.1].precision == 0.0
    a = spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True), (0.1, False)], "s double, t boolean")
    assert metrics.auc(a, F.col("t"), F.col("s")).collect()[0].auc == pytest.approx(0.75)
    assert [(r.threshold, r.tpr, r.fpr) for r in metrics.roc(a, F.col("t"), F.col("s")).orderBy("fpr", "tpr").collect()] == [(0.9, 0.5, 0.0), (0.8, 0.5, 0.5), (0.7, 1.0, 0.5), (0.1, 1.0, 1.0)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_row_numbers_of_a_large_table(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 3_000_000
        df = spark.range(0, n, 1, 9).select((F.col("id") * 7919 % n).alias("v"), F.md5(F.col("id").cast("string")).alias("load"), (F.col("id") % 5).alias("k"))
        r = metrics.numbered(df, "v").agg(F.count("*").alias("n"), F.count_if(F.col("_n") != F.col("v") + 1).alias("wrong"), F.count_if(F.length("load") == 32).alias("load")).collect()[0]
        assert (r.n, r.wrong, r.load) == (n, 0, n)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_running_sums_and_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [(str(g) if g else None, int(v)) for g, size in ((0, 3000), (1, 40), (2, 1), (3, 2)) for v in rng.integers(0, 500, size)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(5)
    counts = df.groupBy("g", "v").agg(F.count("*").alias("c"))
    got = {(r.g, r.v): r.s for r in metrics.cumulative(counts, [F.col("g"), F.col("v")], {"s": F.col("c")}, ["g"]).collect()}
    assert all(s == sum(x == g and y <= v for x, y in rows) for (g, v), s in list(got.items())[::17])
    q = {r.g: r.q for r in metrics.quantiles(df, ["g"], "v", [0.1, 0.5, 0.75]).collect()}
    for g in {x for x, _ in rows}:
        assert q[g] == pytest.approx(np.quantile([v for x, v in rows if x == g], [0.1, 0.5, 0.75]).tolist())
    h = metrics.edged_histogram(df, F.col("v"), [0, 10, 10.5, 100, 499]).orderBy("bin").collect()
    assert [r.n for r in h] == [sum(a <= v < b or (b == 499 == v) for _, v in rows) for a, b in ((0, 10), (10, 10.5), (10.5, 100), (100, 499))]


def test_time_window(spark):
    rows = [("p", 0, 10, 5), ("p", 1, 0, 5), ("p", 5, 2, 5)]
    df = spark.createDataFrame(rows, "proj string, month int, a long, b long")
    got = {(r.month, r.feature) for r in timewindow.low_features(df, "proj", "month", ["a", "b"]).collect()}
    assert got == {(0, "b"), (5, "a"), (5, "b")}
    asked = spark.createDataFrame([("p", 2), ("p", 9)], "proj string, month int")
    assert {(r.month, r.feature) for r in timewindow.low_features(df, "proj", "month", ["a", "b"], months=asked).collect()} == {(9, "a"), (9, "b")}
    items = spark.createDataFrame([("i1", "a, b"), ("i2", "c"), ("i3", None), ("i4", "b")], "id string, f string")
    low = timewindow.low_features(df, "proj", "month", ["a", "b"])
    rec = timewindow.recommend(low, items, "id", "f")
    assert {(r.month, r.id, r.importance) for r in rec.collect()} == {(0, "i1", 2), (0, "i4", 1), (5, "i1", 2), (5, "i4", 1)}
    totals = timewindow.recommended_totals(low, items, "id", "f")
    assert {(r.month, r.n, r.importance) for r in totals.collect()} == {(0, 2, 3), (5, 2, 3)}
    assert {r.json for r in timewindow.nested(rec).where("month = 0").collect()} == {'{"p":{"0":[{"id":"i1","importance":2},{"id":"i4","importance":1}]}}'}


def test_search(spark):
    q = graph.parse_query('"Bus Factor" fast or repair* -Fork')
    assert q.groups == [["bus factor", "fast"], ["repair"]] and q.excludes == ["fork"]
    df = spark.createDataFrame([("the bus factor",), ("repairs",), ("repair forks",), (None,)], "t string")
    assert [(r.t, r.score) for r in graph.keyword_search(df, "t", '"Bus Factor" fast or repair* -Fork').collect()] == [("the bus factor", 0.5), ("repairs", 1.0)]
    assert graph.keyword_search(df, "t", "or").count() == 0
    new = graph.upsert(spark.createDataFrame([(1, "a")], "id long, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "id long, v string"))
    assert sorted((r.id, r.v) for r in new.collect()) == [(1, "a"), (2, "c")]


def test_validation(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(30)], "k long, s string")
    a = validation.stratified_sample(df, "s", "k", 4).collect()
    assert sorted(r.item_id for r in a) == [f"H{i:03d}" for i in range(1, 13)] and {r.k for r in a} == {r.k for r in validation.stratified_sample(df.repartition(5), "s", "k", 4).collect()}
    with pytest.raises(ValueError):
        validation.stratified_sample(df, "s", "k", 11, strict=True)
    t = datetime(2025, 1, 1)
    raw = spark.createDataFrame([("i", "A", t, "yes", "no"), ("i", "A", datetime(2025, 2, 1), "NO", " y"), ("i", "B", t, "no", ""), ("j", "A", t, "n/a", "yes")], "item_id string, annotator_id string, submitted_at timestamp, f string, g string")
    two = validation.two_annotators(validation.latest_answers(raw, ["f", "g"]), ["f", "g"])
    assert {(r.item_id, r.field, r.a, r.b) for r in two.collect()} == {("i", "f", "NO", "NO"), ("i", "g", "YES", "")}
    resolved = validation.resolve(validation.disagreements(two, "f")).collect()
    assert {(r.field, r.resolved) for r in resolved} == {("f", "NO"), ("g", "YES")}
    with pytest.raises(ValueError):
        validation.checked_lookup(df, df.where("k < 5").select("k"), "k")
    with pytest.raises(ValueError):
        validation.positional(df, df.where("k < 5"), "k", ["s"])
    pages = spark.createDataFrame([("a", "14", "Short\nA title that is long enough\nJane Doe and Max Roe\nAnother long line of text here")], "k string, t string, page string")
    got = [(r.line, r.query, r.title) for r in validation.title_candidates(pages.select("k", "page", "t"), "k", "page", "t").orderBy("line", F.length("query")).collect()]
    long = "A title that is long enough"
    assert got == [(1, long, long), (1, long + " Jane Doe and Max Roe", long), (2, "Jane Doe and Max Roe", "Jane Doe and Max Roe"), (3, "Another long line of text here", "Another long line of text here")]
    # a blank line counts for the two that may hold a name, and a bad title is no candidate
    pages = spark.createDataFrame([("a", "A given title", "Document12 of the file system\nThe work of open teams\n\nJane Doe\nThe rest of the whole page\n\n\nMax Roe", "Info title")], "k string, t string, page string, i string")
    got = [(r.line, r.query) for r in validation.title_candidates(pages, "k", "page", "t", "i").orderBy("line", F.length("query")).collect()]
    assert got == [(-2, "A given title"), (-1, "Info title"), (1, "The work of open teams"), (1, "The work of open teams Jane Doe"), (4, "The rest of the whole page")]
    hits = spark.createDataFrame([("a", "x", 0.7, True), ("a", "y", 0.86, False), ("b", "z", 0.8, False)], "k string, title string, similarity double, author_match boolean")
    assert [(r.k, r.title) for r in validation.best_hit(hits, "k").collect()] == [("a", "x")]


class _Shelf:
    """A library in memory."""

    asked: list[str] = []

    def page(self, path):
        if path == "broken":
            raise OSError
        return {"doi": "See 10.1145/99.1).", "gone": "See 10.1145/404.\nPlanning of releases in teams\nAnn Byline", "search": "Planning of releases in teams\nAnn Byline", "none": "x"}.get(path, "")

    def document_title(self, path):
        return "Planning of releases in a team" if path == "info" else "untitled"

    def by_doi(self, doi):
        return ("By identifier", doi) if doi == "10.1145/99.1" else None

    def search(self, query):
        return [{"title": "Planning of releases in teams", "id": "10.1/1", "families": ["Other"]}, {"title": "Planning releases", "id": "10.1/2", "families": ["Byline"]}, {"title": "", "id": "10.1/3"}]


def test_metadata_repair(spark):
    rows = [("doi", "t"), ("gone", None), ("search", "**A wrong title**"), ("none", "12"), ("info", None), ("broken", "kept"), (None, "x"), ("doi", "t")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "path string, title string, method_count int")
    got = {(r.path, r.resolved_title, r.resolved_id, r.method, r.confidence) for r in validation.repair_metadata(df, "path", "title", _Shelf).collect()}
    whole = "Planning of releases in teams"
    assert got == {
        ("doi", "By identifier", "10.1145/99.1", "page", "high"), ("gone", whole, "10.1/1", "search", "high"), ("search", whole, "10.1/1", "search", "high"),
        ("none", "12", "", "unresolved", "low"), ("info", whole, "10.1/1", "search", "high"), ("broken", "kept", "", "unresolved", "low"), (None, None, None, None, None),
    }
    byline = spark.createDataFrame([(["Li", "Roe"], "by roe\n"), (["Li"], "li"), (["Roe"], "\n" * 12 + "roe"), (None, None)], "f array<string>, p string")
    assert [r[0] for r in byline.select(X.author_in_byline(F.col("f"), F.col("p"))).collect()] == [True, False, False, False]


def test_right_side_wins(spark):
    first = spark.createDataFrame([(1, "a", "b"), (2, "a", "b")], "k long, x string, y string")
    second = spark.createDataFrame([(1, None, "new")], "k long, x string, z string")
    assert sorted(tuple(r) for r in validation.override(first, second, ["k"]).select("k", "x", "y", "z").collect()) == [(1, None, "b", "new"), (2, "a", "b", None)]


def test_visibility_rules(spark):
    e = spark.createDataFrame([("A", "x"), ("B", "x"), ("B", "y"), ("C", "z")], "category string, actionable string")
    only = lambda *names: spark.createDataFrame([(n,) for n in names], "actionable string")
    see = lambda **k: {(r.category, r.actionable) for r in graph.visibility(e, **k).where("visible").collect()}
    assert see() == {("A", "x"), ("B", "x"), ("B", "y"), ("C", "z")}
    # an edge shows if both its ends do, also to a category that isn't selected
    assert see(selected=["A"]) == {("A", "x"), ("B", "x")}
    assert see(passing=only("y", "z"), matched=only("x", "y"), selected=["B", "C"]) == {("B", "y")}
    assert {(r.actionable, r.direct) for r in graph.visible_actionables(e, only("y"), only("x", "y")).collect()} == {("x", False), ("y", True), ("z", False)}
    nodes = graph.visible_actionables(e.where("category = 'A'"))
    hubs = lambda **k: {r.category for r in graph.visible_categories(e, graph.visible_actionables(e), loaded=["A"], **k).where("visible").collect()}
    assert nodes.count() == 1 and hubs(searching=False) == {"A", "B", "C"} and hubs(searching=True) == {"A"} and hubs(searching=False, selected=["B"]) == {"A", "B"}
    assert graph.default_category(e, "B") == "B" and graph.default_category(e, "none") == "A" and graph.default_category(e.limit(0), "A") is None


def test_stems_and_scorers(spark):
    words = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption communism activate angulariti homologous effective bowdlerize probate rate cease controll roll"
    stems = "caress poni ti caress cat feed agre plaster bled motor sing conflat troubl size hop tan fall hiss fizz fail file happi sky relat condit ration vietnam predic oper feudal decis hope callous formal sensit sensibl triplic form formal electr electr hope good reviv allow infer airlin adjust defens irrit replac adjust depend adopt commun activ angular homolog effect bowdler probat rate ceas control roll"
    assert [udfs.stem(w) for w in words.split()] == stems.split()
    df = spark.createDataFrame([("ab", "abc"), (None, "x")], "a string, b string")
    length = udfs.scorer(lambda: lambda a, b: [len(x) / len(y) for x, y in zip(a, b)])
    assert [round(r[0], 3) for r in df.select(length("a", "b")).collect()] == [0.667, 0.0]
    assert [one(spark, X.fixed, v, "double") for v in (0.12345, None)] == ["0.123", r"\textcolor{red}{[PENDING]}"] and one(spark, lambda c: X.fixed(c, as_percent=True), 12.34, "double") == r"12.3\%"


class _Session:
    """A session of one setting."""

    def __init__(self, value, master="local[2]"):
        self.conf = {"spark.master": master} | ({"spark.checkpoint.dir": value} if value else {})


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_dir(_Session("file:///shared/x/")) == "file:///shared/x"
    own = shared_dir(_Session(None))
    assert own and own == shared_dir(_Session(None))
    with pytest.raises(RuntimeError, match="share"):
        shared_dir(_Session(None, "spark://somewhere:7077"))
    assert shared_dir(_Session("file:///shared/x", "spark://somewhere:7077")) == "file:///shared/x"
    written = cut(spark.range(5))
    assert written.count() == 5
    folder = Path(written.inputFiles()[0].removeprefix("file://")).parent
    runtime.clear()
    assert not folder.exists()
