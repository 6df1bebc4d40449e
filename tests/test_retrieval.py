from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from occura.functions import vector as V
from occura.operators import retrieval as R


def ranking(spark, ids, query="q"):
    return spark.createDataFrame([(query, x, i) for i, x in enumerate(ids, 1)], "query_id string, doc_id string, rank long")


def test_fusion(spark):
    got = R.top_k(R.fuse([(ranking(spark, ["b", "a"]), 1.0), (ranking(spark, ["a", "c"]), 1.0)]), 10).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["a", "b", "c"]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    for bad in ([], [0.0], [-1.0], [math.nan]):
        with pytest.raises(ValueError, match="weights"):
            R.fuse([(ranking(spark, ["a"]), w) for w in bad])


def test_bm25_against_the_formula(spark):
    docs = {"d1": ["redis", "fast", "fast"], "d2": ["redis"], "d3": ["kafka", "log"]}
    index = R.postings(spark.createDataFrame(list(docs.items()), "id string, ts array<string>"), "id", F.col("ts"))
    queries = spark.createDataFrame([("q", "redis"), ("q", "fast"), ("q", "nothing")], "query_id string, term string")
    got = {r.doc_id: r.score for r in R.bm25(queries, index).collect()}
    mean = sum(map(len, docs.values())) / 3

    def score(d):
        total = 0
        for t in ("redis", "fast"):
            df, tf = sum(t in w for w in docs.values()), docs[d].count(t)
            if tf:
                total += math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
        return round(total, 6)

    assert got == {"d1": score("d1"), "d2": score("d2")}


def test_bm25_in_blocks_equals_the_join(spark, monkeypatch):
    for name, value in (("QUERY_BLOCK", 3), ("DOCUMENT_BLOCK", 16), ("EXPANDED", 20)):
        monkeypatch.setattr(R, name, value)
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(f"d{i:03}", [f"t{x}" for x in rng.integers(0, 30, rng.integers(0, 12))]) for i in range(90)], "id string, ts array<string>")
    other = spark.createDataFrame([(f"d{i:03}", [f"t{x}" for x in rng.integers(0, 30, 5)]) for i in range(0, 90, 2)], "id string, ts array<string>")
    a, b = R.postings(docs, "id", F.col("ts")), R.postings(other, "id", F.col("ts"))
    queries = spark.createDataFrame([(f"q{q}", f"t{t}") for q in range(7) for t in range(q, 30, 5)] + [("q9", "unseen")], "query_id string, term string")
    rows = lambda df: {tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect()}
    assert rows(R.bm25_top_k(queries, [(a, 1.0)], 4)) == rows(R.top_k(R.bm25(queries, a), 4))
    both = R.bm25(queries, a).withColumn("score", 2 * F.col("score")).unionByName(R.bm25(queries, b)).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    assert rows(R.bm25_top_k(queries, [(a, 2.0), (b, 1.0)], 4)) == rows(R.top_k(both, 4))
    assert R.bm25_top_k(queries.limit(0), [(a, 1.0)], 4).count() == 0
    assert R.bm25_top_k(queries, [(a.limit(0), 1.0)], 4).count() == 0


def test_cosine_top_k(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [math.nan, 1.0]), (6, None), (7, [1.0])], "id long, v array<float>")
    got = R.cosine_top_k(rows.where("id = 0"), rows, "id", "v", 2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(1, 1.0), (2, 1.0)]
    assert R.cosine_top_k(rows.where("id = 99"), rows, "id", "v", 2).count() == 0
    valid = {r.id: r.ok for r in rows.select("id", V.valid(F.col("v"), 2).alias("ok")).collect()}
    assert [i for i, ok in valid.items() if ok] == [0, 1, 2, 3]


def test_cosine_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 16)
    rng = np.random.default_rng(3)
    data = rng.normal(size=(150, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, v array<float>")
    got = {}
    for r in R.cosine_top_k(rows.where("id % 20 = 0"), rows.repartition(3), "id", "v", 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1)[:, None]
    for q in range(0, 150, 20):
        s = np.round(unit @ unit[q], 6)
        want = sorted((x for x in range(150) if x != q), key=lambda x: (-s[x], x))[:5]
        assert got[q] == want


def test_facet_pool_order():
    main = [f"m{i}" for i in range(40)]
    facets = [["m3", "a1", "a2", *[f"a{i}" for i in range(3, 30)]], ["b1", "a1", "b2"]]
    got = R.facet_pool(main, facets)
    ids = [x for x, _ in got]
    assert len(ids) == 50 == len(set(ids))
    assert ids[:20] == main[:20]
    assert ids[20:26] == ["a1", "b1", "a2", "b2", "a3", "a4"]
    assert sum(s == "facet" for _, s in got) == 12  # ten of the first, two of the second
    assert [x for x, s in got if s == "main_rest"] == main[20:38]


def test_preferred_pool_order():
    main, liked = [f"m{i}" for i in range(30)], [*[f"m{i}" for i in range(5)], *[f"p{i}" for i in range(40)]]
    plain = R.preferred_pool(main, liked, [])
    assert [s for _, s in plain] == ["broad_reserved"] * 20 + ["preferred"] * 30
    mixed = R.preferred_pool(main, liked[:12], [["f1", "m0", "f2"], []])
    assert [x for x, s in mixed if s == "facet"] == ["f1", "f2"]
    assert [x for x, s in mixed if s == "broad_fill"] == main[10:]


def selected(spark, rows, facets, top):
    df = spark.createDataFrame([("q", *r) for r in rows], "query_id string, doc_id string, grade int, place int, f1 int, f2 int")
    return [r.doc_id for r in R.graded_selection(df, facets, top).orderBy("rank").collect()]


def test_graded_selection_gives_each_facet_one_place(spark):
    rows = [[f"r{i:02}", 3 if i < 6 else 1, i, None, None] for i in range(12)]
    rows[10][3], rows[11][3] = 2, 1
    assert selected(spark, rows, ["f1", "f2"], 8) == ["r00", "r01", "r02", "r03", "r04", "r11", "r05", "r06"]
    assert selected(spark, rows, [], 3) == ["r00", "r01", "r02"]
    assert selected(spark, rows, ["f1"], 5) == ["r00", "r01", "r02", "r03", "r04"]  # no room left
    assert selected(spark, [], ["f1", "f2"], 5) == []
    rows[2][4], rows[7][3], rows[7][4] = 10, 1, 11  # the second facet is met by a leader; equal ranks go by grade
    assert selected(spark, rows, ["f1", "f2"], 7) == ["r00", "r01", "r02", "r03", "r04", "r07", "r05"]
    assert selected(spark, [["a", None, None, None, None], ["b", 1, 3, None, None]], ["f1"], 5) == ["b", "a"]


def test_acceptance_needs_both_quotes(spark):
    judged = spark.createDataFrame(
        [(1, 3, "Redis为什么快", "Redis", "快"), (2, 3, "Redis为什么快", "Redis", " "), (3, 1, "Redis为什么快", "Redis", "快"), (4, 2, "Redis为什么快", "Kafka", "快"), (5, 3, None, "a", "b"), (6, 3, "x", None, "x")],
        "id int, grade int, text string, object_quote string, focus_quote string",
    )
    assert [r.id for r in R.accepted(judged).collect()] == [1]


def test_pool_by_query(spark):
    staged = ranking(spark, ["a", "b"]).withColumn("stage", F.lit("main")).unionByName(ranking(spark, ["b", "c"]).withColumn("stage", F.lit("facet_1")))
    got = R.pooled(staged, R.facet_pool, ["main"]).orderBy("place").collect()
    assert [(r.doc_id, r.source) for r in got] == [("a", "main"), ("b", "main"), ("c", "facet")]
