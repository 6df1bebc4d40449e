from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest

from occura.operators import evaluation as E
from occura.operators import lineage as L
from occura.operators import telemetry as T


def test_classification(spark):
    pairs = spark.createDataFrame(list(zip(["SAME", "DIFFERENT", "SAME"], ["SAME", "SAME", "DIFFERENT"], strict=True)), "gold string, predicted string")
    got = {r.label: r for r in E.per_class(pairs).collect()}
    assert (got["SAME"].precision, got["SAME"].recall) == (0.5, 0.5)
    assert got["DIFFERENT"].f1 == 0.0
    assert {(r.gold, r.predicted): r.samples for r in E.confusion(pairs).collect()}[("SAME", "DIFFERENT")] == 1
    empty = E.macro(pairs.limit(0)).first()
    assert empty.accuracy is None and empty.macro_f1 is None and empty.samples == 0


def test_retrieval_metrics(spark):
    rank = spark.createDataFrame([("1", "b", 1), ("1", "x", 2), ("1", "a", 3), ("3", "n", 1), ("4", "d", 1), ("4", "d", 2)], "query_id string, doc_id string, rank long")
    gold = spark.createDataFrame([("1", "a", 2), ("1", "b", 1), ("2", "c", 2), ("4", "d", 1)], "query_id string, doc_id string, grade int")
    queries = spark.createDataFrame([("1", False), ("2", True), ("3", False), ("4", False), ("5", False)], "query_id string, failed boolean")
    got = {r.query_id: r for r in E.retrieval(rank, gold, queries).collect()}
    ideal = 3 / math.log2(2) + 1 / math.log2(3)
    assert got["1"].ndcg_10 == pytest.approx((1 / math.log2(2) + 3 / math.log2(4)) / ideal, abs=1e-6)
    assert (got["1"].recall_10, got["1"].mrr, got["1"].precision_10) == (1.0, 1.0, 0.2)
    assert (got["2"].recall_10, got["2"].mrr, got["2"].failed) == (0.0, 0.0, True)
    assert (got["3"].negative, got["3"].negative_correct, got["5"].negative_correct) == (True, 0, 1)
    assert (got["4"].failed, got["4"].mrr) == (True, 0.0)


def test_gates(spark):
    metrics = spark.createDataFrame([("p", 0.9), ("e", 2.0)], "metric string, value double")
    limits = spark.createDataFrame([("p", 0.9, "min"), ("e", 1.0, "max"), ("r", 0.5, "min")], "metric string, threshold double, direction string")
    checked = E.gates(metrics, limits)
    assert {r.metric: r.status for r in checked.collect()} == {"p": "PASSED", "e": "BELOW_GATE", "r": "NOT_RUN"}
    assert E.gate_status(checked).first().status == "NOT_RUN"
    assert E.gate_status(checked.where("metric <> 'r'")).first().status == "BELOW_GATE"
    assert E.gate_status(checked.limit(0)).first().status == "NOT_RUN"


def test_operating_points(spark):
    scored = spark.createDataFrame([(0.95, True), (0.8, False), (0.6, True), (None, True)], "confidence double, correct boolean")
    got = [(r.threshold, r.accepted, r.errors, r.precision) for r in E.operating_points(scored, [0.9, 0.5, 0.99]).orderBy("threshold").collect()]
    assert got == [(0.5, 3, 1, 0.666667), (0.9, 1, 0, 1.0), (0.99, 0, 0, None)]


def test_alignment_only_unique_matches(spark):
    s = "id string, doc_id string, start int, end int, text string"
    gold = spark.createDataFrame([("g1", "d", 0, 5, "a"), ("g2", "d", 10, 15, "b"), ("g3", "d", 20, 25, "c")], s)
    pred = spark.createDataFrame([("p1", "d", 4, 8, "a"), ("p2", "d", 15, 18, "b"), ("p3", "d", 20, 22, "c"), ("p4", "d", 23, 25, "c")], s)
    assert [tuple(r) for r in E.aligned(gold, pred).collect()] == [("g1", "p1")]


def test_comparison_judgements_regrouping(spark):
    kv = "key string, value double"
    got = {r.key: r.change for r in E.compare_runs(spark.createDataFrame([("a", 1.0), ("b", 1.0)], kv), spark.createDataFrame([("b", 2.0), ("c", 1.0)], kv)).collect()}
    assert got == {"a": "REMOVED", "b": "UP", "c": "ADDED"}
    j = "query_id int, doc_id int, grade int"
    assert sorted(tuple(r) for r in E.merged_judgements(spark.createDataFrame([(1, 1, 2)], j), spark.createDataFrame([(1, 1, 0), (1, 2, 1)], j)).collect()) == [(1, 1, 2), (1, 2, 1)]
    o = spark.createDataFrame([("f", "A", 0.3), ("f", "B", 0.4), ("f", "A", 0.3)], "field string, value string, probability double")
    assert tuple(E.regrouped(o).first()) == ("f", "A", 0.6)


def test_majority_and_redirects_and_asof(spark):
    occ = spark.createDataFrame([("c", "t1", "A"), ("c", "t2", "B"), ("d", "t1", "A"), ("d", "t1", "A"), ("d", "t2", "B")], "canonical_question_id string, topic_id string, question_type string")
    now = spark.createDataFrame([("c", "t2", "B"), ("d", "t2", "B")], "id string, primary_topic_id string, question_type string")
    assert {r.canonical_question_id: r.topic_id for r in L.majority_label(occ, now).collect()} == {"c": "t2", "d": "t1"}
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None)], "id string, redirect_to_id string")
    assert sorted(tuple(r) for r in L.redirects(chain).collect()) == [("a", "c", 2), ("b", "c", 1)]
    long = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(21)] + [("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), ("q", None)], "id string, redirect_to_id string")
    got = {r.id: (r.target_id, r.hops) for r in L.redirects(long).collect()}
    assert all(got[f"n{i:02}"] == ("n21", 21 - i) for i in range(21))
    assert [got[k] for k in "xyzs"] == [(None, None)] * 4 and "q" not in got
    assert L.redirects(long.limit(0)).count() == 0
    spans = spark.createDataFrame([(1, 1, 5), (2, 5, None)], "id int, valid_from int, valid_to int")
    assert [[r.id for r in L.assignment_asof(spans, k).collect()] for k in (0, 4, 5)] == [[], [1], [2]]


def test_resolution_and_guard(spark):
    judged = spark.createDataFrame([(1, 10, "SAME"), (1, 11, "RELATED"), (2, 10, "SAME"), (2, 11, "SAME"), (3, 10, "DIFFERENT")], "incoming_id int, candidate_id int, judgement string")
    assert {r.incoming_id: (r.decision, r.canonical_question_id, r.related) for r in L.resolve(judged).collect()} == {1: ("MERGE", 10, 1), 2: ("REVIEW", None, 0), 3: ("NEW", None, 0)}
    g = spark.createDataFrame([("SAME", 0.9, True, None), ("SAME", 0.9, True, True), ("DIFFERENT", 0.2, False, False)], "judgement string, confidence double, a boolean, b boolean")
    assert [(r.judgement, r.confidence) for r in L.guarded(g, ["a", "b"]).collect()] == [("RELATED", 0.5), ("SAME", 0.9), ("DIFFERENT", 0.2)]


def test_bins_are_filled(spark):
    at = datetime(2026, 1, 1, 0, 0, 30)
    r = spark.createDataFrame([(1, "v", "ip", 200, at), (2, "v", "ip", 500, at + timedelta(seconds=190))], "event_id long, visitor_id string, ip string, status int, created_at timestamp")
    bins = [(b.requests, b.errors, b.qps) for b in T.filled_bins(r, 60).orderBy("bin").collect()]
    assert bins == [(1, 0, round(1 / 30, 6)), (0, 0, 0.0), (0, 0, 0.0), (1, 1, round(1 / 40, 6))]
    assert T.filled_bins(r.limit(0), 60).count() == 0
    assert T.peak_per_second(r.limit(0)).first().peak_qps == 0


def test_fold_and_receipts(spark):
    t = datetime(2026, 1, 1)
    e = spark.createDataFrame([(1, 1, 0, "WEAK", 5, t), (2, 1, 0, "UNSEEN", None, t + timedelta(1)), (3, 1, 0, "MASTERED", None, t - timedelta(1))], "event_id long, user_id long, item long, status string, score long, ts timestamp")
    got = T.folded_state(e).first()
    assert (got.status, got.review_count, got.version, got.last_score, got.last_reviewed_at) == ("UNSEEN", 2, 3, 5, t)
    d = spark.createDataFrame([(1, "k", "h"), (2, "k", "h"), (3, "k", "x")], "event_id long, key string, payload_hash string")
    assert {r.outcome: r.deliveries for r in T.receipts(d).collect()} == {"ACCEPTED": 1, "REPLAY": 1, "CONFLICT": 1}
