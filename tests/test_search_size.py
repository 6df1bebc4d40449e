"""Searches over inputs whose pairs, ties or repeats must not be handed on one by one."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from occura import catalogue
from occura.operators import evaluation as E
from occura.operators import retrieval as R
from occura.queries import retrieval as Q
from tests.test_whole_job import ranked_far_down


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *columns) -> set:
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert len(got) == len(set(got))
    return set(got)


RANKED = ("query_id", "doc_id", "score", "rank")


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("QUERY_BLOCK", 3), ("DOCUMENT_BLOCK", 16), ("DOCUMENTS_A_TASK", 32), ("EXPANDED", 20)):
        monkeypatch.setattr(R, name, value)


def random_index(spark, n=90):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(f"d{i:03}", [f"t{x}" for x in rng.integers(0, 30, rng.integers(1, 12))]) for i in range(n)], "id string, ts array<string>")
    queries = spark.createDataFrame([(f"d{q:03}", f"t{t}") for q in range(7) for t in range(q, 30, 5)], "query_id string, term string")
    return R.postings(docs, "id", F.col("ts")), queries


def test_bm25_over_several_tasks_of_documents_equals_the_join(spark, small_blocks):
    index, queries = random_index(spark)
    assert rows(R.bm25_top_k(queries, [(index, 1.0)], 4), *RANKED) == rows(R.top_k(R.bm25(queries, index), 4), *RANKED)


def test_bm25_topk_sends_no_documents_to_the_driver(spark, tmp_path):
    d, _ = ranked_far_down(spark, str(tmp_path))
    for name in ("bm25_topk", "bm25_two_field_max"):
        assert "BroadcastNestedLoopJoin" not in plan(catalogue.queries()[name](spark, d)), name


def test_equal_scores_are_cut_by_id_in_every_block(spark, small_blocks):
    docs = spark.createDataFrame([(f"d{i:03}", ["a", "b"]) for i in range(99, -1, -1)], "id string, ts array<string>")
    queries = spark.createDataFrame([("q", "a")], "query_id string, term string")
    got = R.bm25_top_k(queries, [(R.postings(docs, "id", F.col("ts")), 1.0)], 5).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [f"d{i:03}" for i in range(5)]
    best = R._Best(5)
    for base in (0, 100):
        best.add(np.ones(100), None, base, lambda i: f"{99 - i % 100:03}{i}")
        assert len(best.scores) == 5


def test_one_search_gives_every_list(spark, small_blocks):
    index, queries = random_index(spark)
    kinds = spark.createDataFrame([(f"d{i:03}", f"k{i % 3}") for i in range(90)], "id string, kind string")
    asked = queries.groupBy("query_id").agg(F.collect_list(F.xxhash64("term")).alias("ts"))
    got = R.search(asked, R.profiles_of(index), [("all", 4, None, False), ("own", 3, None, True), ("even", 2, 0, False), ("odd", 2, 1, False)], kinds)
    of = lambda stage: rows(got.where(F.col("stage") == stage), *RANKED)
    half = queries.where(F.pmod(F.xxhash64("term"), F.lit(2)) == 0)
    assert of("all") == rows(R.top_k(R.bm25(queries, index), 4), *RANKED)
    assert of("own") == rows(R.bm25_top_k(queries, [(index, 1.0)], 3, kinds), *RANKED)
    assert of("even") == rows(R.top_k(R.bm25(half, index), 2), *RANKED)
    assert of("odd") == rows(R.top_k(R.bm25(queries.join(half, ["query_id", "term"], "left_anti"), index), 2), *RANKED)


def test_pools_search_each_index_once(spark, tmp_path):
    d, _ = ranked_far_down(spark, str(tmp_path))
    for name in ("preferred_pool", "lexical_facet_pool"):
        assert plan(catalogue.queries()[name](spark, d)).count("CartesianProduct") == 2, name
    assert "preferred" not in {r.stage for r in Q._staged(spark, d, liked=False).select("stage").distinct().collect()}


def test_wordings_are_counted_across_batches(spark):
    words = [(f"d{i}", [f"t{(i * j) % 7}" for j in range(1 + i % 4)]) for i in range(6) for _ in range(1 + 3 * (i % 2))]
    df = spark.createDataFrame(words, "id string, ts array<string>").withColumn("ts", F.array_distinct("ts"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {r.doc_id: (r.length, dict(zip(r.ts, r.tfs, strict=True))) for r in R.counted_profiles(df, "id", F.col("ts")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want: dict = {}
    for r in df.select("id", F.transform("ts", lambda t: F.xxhash64(t)).alias("h")).collect():
        length, counts = want.setdefault(r.id, [0, {}])
        want[r.id][0] = length + len(r.h)
        for h in r.h:
            counts[h] = counts.get(h, 0) + 1
    assert got == {i: tuple(v) for i, v in want.items()}


def test_an_id_with_several_texts_scores_as_the_join(spark, tmp_path):
    c = [("00000014-a", "alpha beta gamma"), ("00000014-a", "alpha delta"), ("00000001-b", "alpha beta"), ("00000002-c", "delta gamma alpha zeta")]
    spark.createDataFrame(c, "id string, canonical_text string").write.parquet(f"{tmp_path}/canonical.parquet")
    index = R.postings(spark.read.parquet(f"{tmp_path}/canonical.parquet"), "id", Q.terms(F.col("canonical_text")))
    queries = index.where("doc_id = '00000014-a'").select(F.col("doc_id").alias("query_id"), "term")
    assert rows(catalogue.queries()["bm25_topk"](spark, str(tmp_path)), *RANKED) == rows(R.top_k(R.bm25(queries, index), 100), *RANKED)


def test_fused_ranks_need_one_shuffle(spark, tmp_path):
    d, _ = ranked_far_down(spark, str(tmp_path))
    for name in ("rrf_two_way", "rrf_weighted", "hybrid_rrf_pool50"):
        text = plan(catalogue.queries()[name](spark, d))
        above = text[: text.index("Union")]
        assert above.count("Exchange") <= 1, name


def test_hits_are_searched_once(spark, tmp_path):
    d, _ = ranked_far_down(spark, str(tmp_path))
    o = spark.read.parquet(f"{d}/occurrence.parquet").withColumn("interview_id", F.lit("i"))
    o.write.parquet(f"{tmp_path}/more/occurrence.parquet")
    spark.read.parquet(f"{d}/canonical.parquet").write.parquet(f"{tmp_path}/more/canonical.parquet")
    empty = {"document_build": "id string, source_revision_id string, decision string", "source_document": "id string, active_build_id string, source_type string", "source_revision": "id string, source_document_id string", "interview": "id string, build_id string, company_normalized string, analytics_eligible boolean"}
    for name, schema in empty.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/more/{name}.parquet")
    got = catalogue.queries()["result_assembly"](spark, f"{tmp_path}/more")
    assert got.count() == 3
    assert "MapInArrow" not in plan(got)


def judged(spark):
    rng = np.random.default_rng(11)
    members = [(f"d{i:02}", f"g{rng.integers(4)}", None if i % 9 == 0 else f"k{rng.integers(2)}") for i in range(60)] + [("d60", "alone", "k0"), ("d01", "g9", "k0"), ("d07", "g9", "k1")]
    m = spark.createDataFrame(members, "id string, topic string, kind string")
    ranking = [(f"d{q:02}", f"d{x:02}", r) for q in (*range(0, 20), 60) for r, x in enumerate(rng.choice(60, 55, replace=False), 1) if q != 3] + [("d05", "d05", 60), ("d05", "d05", 61)]
    queries = spark.createDataFrame([(f"d{q:02}", q == 4) for q in (*range(0, 20), 60)], "query_id string, failed boolean")
    return m, spark.createDataFrame(ranking, "query_id string, doc_id string, rank long"), queries


def test_metrics_of_groups_equal_those_of_pairs(spark):
    m, ranking, queries = judged(spark)
    a, b = m.toDF("query_id", "topic", "own"), m.toDF("doc_id", "topic", "kind")
    gold = queries.select("query_id").join(a, "query_id").join(b, "topic").where("query_id <> doc_id").select("query_id", "doc_id", F.when(F.col("own") == F.col("kind"), 2).otherwise(1).alias("grade"))
    want, got = E.retrieval(ranking, gold, queries), E.retrieval_of_groups(ranking, m, "topic", queries)
    assert want.columns == got.columns
    assert rows(got, *want.columns) == rows(want, *want.columns)


def test_recall_of_groups_equals_that_of_pairs(spark):
    m, ranking, queries = judged(spark)
    m, ranking = m.select("id", "topic"), ranking.where("rank <= 50")
    gold = queries.join(m.toDF("query_id", "topic"), "query_id").join(m.toDF("doc_id", "topic"), "topic").where("query_id <> doc_id")
    got = ranking.withColumn("hit", F.lit(1))
    want = gold.join(got, ["query_id", "doc_id"], "left").groupBy("topic").agg(F.count("*").alias("relevant"), F.count("hit").alias("found"))
    assert rows(E.recall_of_groups(ranking, m, "topic", queries), "topic", "relevant", "found") == rows(want, "topic", "relevant", "found")


def test_shared_vectors_are_compared_once(spark):
    rng = np.random.default_rng(2)
    data = [(v, [float(x) for x in rng.integers(-1, 2, 3)]) for v in range(12)] + [(12, [math.nan, 1.0, 0.0])]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    r = spark.createDataFrame([(f"d{i:03}", int(rng.integers(13))) for i in range(120)], "id string, vec_id long")
    q = r.where("id < 'd010'")
    own = r.join(vectors, "vec_id").select("id", "embedding")
    want = R.cosine_top_k(own.where("id < 'd010'"), own, "id", "embedding", 7)
    got = R.cosine_top_k_shared(q, r, vectors, 7)
    assert rows(got, "query_id", "id", "score", "rank") == rows(want, "query_id", "id", "score", "rank")


def ranked_lists(spark):
    index, queries = random_index(spark)
    asked = queries.groupBy("query_id").agg(F.collect_list(F.xxhash64("term")).alias("ts"))
    return index, queries, [R.find(asked, R.profiles_of(index), [("main", k, None, False)]) for k in (6, 9)]


def fused_columns(fields):
    ids, scores = R.fused(fields, "main", (1.0, 2.0), 5)
    return ids, scores.tolist(), range(1, len(ids) + 1)


def test_lists_of_several_tasks_and_fields_are_fused_as_rows(spark, small_blocks):
    index, queries, found = ranked_lists(spark)
    assert not found[0].whole
    got = R.gathered(found, fused_columns, "query_id string, doc_id string, score double, rank long")
    scores = R.bm25(queries, index)
    want = R.top_k(R.fuse([(R.top_k(scores, 6), 1.0), (R.top_k(scores, 9), 2.0)]), 5)
    assert rows(got, *RANKED) == rows(want, *RANKED)


def test_packed_lists_are_read_as_they_were():
    lists = [(["b", None, "", "字"], np.array([3.5, 2.000001, 2.0, 1e-06])), ([], np.zeros(0)), (["x"], np.array([123456.654321]))]
    got = R._unpacked_lists(R._packed_lists(lists))
    assert [(i, s.tolist()) for i, s in got] == [(i, s.tolist()) for i, s in lists]


def test_rerank_select_reads_places_and_facets_from_one_row_a_query(spark, tmp_path):
    d, _ = ranked_far_down(spark, str(tmp_path))
    text = plan(catalogue.queries()["rerank_select"](spark, d))
    assert "Join" not in text and "FlatMapGroupsInPandas" not in text


def test_rankings_that_name_documents_once_are_not_grouped_by_document(spark):
    m, ranking, queries = judged(spark)
    ranking = spark.createDataFrame(ranking.dropDuplicates(["query_id", "doc_id"]).collect(), ranking.schema)
    want, got = E.retrieval_of_groups(ranking, m, "topic", queries), E.retrieval_of_groups(ranking.where("rank <= 50"), m, "topic", queries, once=True)
    assert rows(got, *want.columns) == rows(want, *want.columns)
    keys = r"keys=\[query_id#\d+, doc_id#\d+\]"
    assert re.search(keys, plan(want)) and not re.search(keys, plan(got))


def above_union(query: str, spark, d: str) -> str:
    text = plan(catalogue.queries()[query](spark, d))
    return text[: text.index("Union")]


def test_best_of_two_fields_needs_one_shuffle_of_lists(spark, tmp_path):
    d, _ = ranked_far_down(spark, str(tmp_path))
    above = above_union("bm25_two_field_max", spark, d)
    assert above.count("Exchange") == 1 and "Window" not in above


def test_pools_are_made_where_the_lists_meet(spark, tmp_path):
    d, _ = ranked_far_down(spark, str(tmp_path))
    for name in ("lexical_facet_pool", "preferred_pool"):
        above = above_union(name, spark, d)
        assert above.count("Exchange") == 1 and "Window" not in above and "FlatMapGroupsInPandas" not in above, name


def test_fused_lists_are_ranked_where_they_meet(spark, tmp_path):
    d, _ = ranked_far_down(spark, str(tmp_path))
    for name in ("rrf_two_way", "rrf_weighted", "hybrid_rrf_pool50"):
        assert "Window" not in above_union(name, spark, d), name
