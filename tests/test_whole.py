"""The whole job of queries, against brute force on small tables."""

import random
from datetime import datetime

import pytest

from quern.operators import graph, similarity
from quern.plans import records


def test_calibration_counts_all_pairs_of_vectors(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.randrange(4), [rng.gauss(0, 1) for _ in range(6)]) for i in range(70)] + [(70, None, [1.0] * 6), (71, 1, None), (72, 1, [0.0] * 6)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]

    def cosine(u, v):
        if not u or not v or not any(u) or not any(v):
            return 0.0
        dot = lambda x, y: sum(a * b for a, b in zip(x, y))
        return round(max(0.0, dot(u, v) / (dot(u, u) * dot(v, v)) ** 0.5), 6)

    pairs = [("even" if i % 2 == 0 else "odd", cosine(u, v), None if l is None or m is None else l == m) for i, l, u in stored for j, m, v in stored if i < j]
    expected = {}
    for b in ("even", "odd"):
        own = [(s, same) for x, s, same in pairs if x == b]
        for t in similarity.coarse_grid():
            tp, fp, pos = sum(s >= t and same is True for s, same in own), sum(s >= t and same is False for s, same in own), sum(same is True for _, same in own)
            expected[b, t] = (tp / (tp + fp) if tp + fp else 1.0, tp / pos)
    got = {(r.benchmark, r.theta): (r.precision, r.recall) for r in records.theta_calibration_coarse(spark, str(tmp_path)).collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k], abs=2e-6) for k in got)
    best = records.theta_calibration_best(spark, str(tmp_path)).collect()[0]
    f1 = lambda p, r: 2 * p * r / (p + r) if p + r else 0.0
    average = {t: sum(f1(*expected[b, t]) for b in ("even", "odd")) / 2 for t in similarity.coarse_grid()}
    assert best.average_f1 == pytest.approx(max(average.values()), abs=2e-6)
    rows = spark.createDataFrame([(i, l, "x", v) for i, l, v in stored], "id long, label int, benchmark string, vector array<float>")
    counts = [{(r.k, r.pos, r.neg) for r in similarity.vector_pair_counts(rows, [0.2, 0.5], block=b).groupBy("k").agg({"pos": "sum", "neg": "sum"}).toDF("k", *c).select("k", "pos", "neg").collect()} for b, c in ((4096, ("pos", "neg")), (7, ("pos", "neg")))]
    assert counts[0] == counts[1]


def test_third_annotators_count(spark, tmp_path):
    fields = records._FIELDS
    say = lambda item, who, **x: (item, who, datetime(2025, 1, 1), *[x.get(f, "YES") for f in fields])
    rows = [say("i", "A"), say("i", "B"), say("i", "C", sound_valid="NO"), say("j", "A"), say("j", "B"), say("j", "C"), say("k", "A"), say("l", "A", precise_valid="N/A"), say("l", "B", precise_valid="")]
    spark.createDataFrame(rows, "item_id string, annotator_id string, submitted_at timestamp, " + ", ".join(f"{f} string" for f in fields)).write.parquet(f"{tmp_path}/react_validation.parquet")
    work = records.disagreement_worklist(spark, str(tmp_path))
    assert work.columns == ["item_id", "field", "a", "b", "final"]
    assert sorted((r.item_id, r.a, r.b) for r in work.where("field = 'sound_valid'").collect()) == [("i", "YES", "NO"), ("i", "YES", "NO"), ("i", "YES", "YES"), ("l", "YES", "YES")]
    # the first task's fields are not in dispute, and are judged apart
    assert work.where("field = 'impact_valid'").count() == 0 and records.disagreement_sheet(spark, str(tmp_path)).count() == 0
    assert [tuple(r) for r in records.unresolved_counts(spark, str(tmp_path)).collect()] == [("task2", 2, 2)]
    resolved = {(r.item_id, r.field): r.resolved for r in records.conservative_resolution(spark, str(tmp_path)).collect()}
    assert len(resolved) == 2 * 10 and resolved["i", "sound_valid"] == "NO" and resolved["i", "precise_valid"] == "YES" and resolved["l", "precise_valid"] == "N/A"
    truth = {(r.item_id, r.field): r.value for r in records.ground_truth(spark, str(tmp_path)).collect()}
    assert len(truth) == 3 * len(fields) and truth["i", "sound_valid"] == "NO" and truth["j", "sound_valid"] == "YES"


def test_rows_without_model_are_paired(spark):
    rows = [("g", 0, "split the large modules", None), ("g", 1, "split the large modules now", None), ("g", 2, "split the large modules", "m"), ("g", 3, "split the large modules", "m")]
    grams = similarity.grams(spark.createDataFrame(rows, "g string, i long, t string, m string"), "g", "i", "t", ["m"])
    whole = {(r.i, r.j): r.sim for r in similarity.similar_pairs(grams, "m").collect()}
    some = {(r.i, r.j): r.sim for r in similarity.similar_pairs(grams, "m", 0.3).collect()}
    assert some == pytest.approx({k: v for k, v in whole.items() if v > 0.3}) and (0, 1) in some and (2, 3) not in some


def test_search_takes_any_number_of_queries(spark):
    rng = random.Random(3)
    nodes = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)], "id long, v array<double>")
    queries = nodes.where("id < 10").selectExpr("id as query_id", "v as query_vector")
    whole, parts = ({tuple(r) for r in graph.semantic_search(nodes, queries, "id", "v", 3, 0.1, block=b).collect()} for b in (1000, 3))
    assert whole == parts and {q for q, *_ in parts} == set(range(10))
    many = spark.range(1001).selectExpr("id as query_id", "array(1D, cast(id as double)) as query_vector")
    assert graph.semantic_search(nodes.limit(0).selectExpr("id", "v").union(spark.sql("select 1L, array(1D, 1D)")), many, "id", "v", 1, 0.1).count() == 1001
