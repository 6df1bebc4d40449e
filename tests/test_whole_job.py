"""Queries against inputs on which an earlier, shortened form gave less."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from occura import catalogue
from occura.operators import retrieval as R
from occura.queries import retrieval as queries
from tests.corpora import seed_tables, write


def test_candidate_payload_clips_the_canonical_text_at_500(spark, tmp_path):
    t = seed_tables()
    long = "".join(chr(0x4E00 + i) for i in range(600))
    t["canonical"] = [("fast", long, "redis.performance", "PRINCIPLE"), ("persistence", long[:450], "redis.persistence", "PRINCIPLE")]
    d = write(spark, str(tmp_path / "seed"), t)
    spark.read.parquet(f"{d}/occurrence.parquet").withColumn("raw_question", F.lit("asked")).write.parquet(f"{d}/worded.parquet")
    spark.read.parquet(f"{d}/worded.parquet").write.mode("overwrite").parquet(f"{d}/occurrence.parquet")
    got = {(r.canonical_question_id, r.alias, r.clipped) for r in catalogue.queries()["candidate_payload"](spark, d).collect()}
    assert got == {("fast", "c0", long[:500]), ("persistence", "c0", long[:450])}


def test_evidence_clip_shares_500_bytes(spark, tmp_path):
    text = "".join(chr(0x21 + i % 90) for i in range(600))
    rows = [("a", "one", text), ("b", "two", text), ("c", "two", text), *[(f"d{i}", "many", text) for i in range(3)], ("e", None, text)]
    spark.createDataFrame(rows, "id string, canonical_question_id string, raw_question string").write.parquet(f"{tmp_path}/occurrence.parquet")
    got = {r.id: (r.head, r.tail) for r in catalogue.queries()["evidence_clip"](spark, str(tmp_path)).collect()}
    whole, half = (text[:200], text[-250:]), (text[:100], text[-125:])
    assert got == {"a": whole, "b": half, "c": half, "d0": half, "d1": half, "d2": half, "e": whole}


def test_bm25_of_one_kind_is_chosen_before_the_cut(spark, monkeypatch):
    for name, value in (("QUERY_BLOCK", 3), ("DOCUMENT_BLOCK", 16), ("EXPANDED", 20)):
        monkeypatch.setattr(R, name, value)
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(f"d{i:03}", [f"t{x}" for x in rng.integers(0, 30, rng.integers(1, 12))]) for i in range(90)], "id string, ts array<string>")
    index = R.postings(docs, "id", F.col("ts"))
    queries = spark.createDataFrame([(f"d{q:03}", f"t{t}") for q in range(7) for t in range(q, 30, 5)], "query_id string, term string")
    kinds = spark.createDataFrame([(f"d{i:03}", None if i % 10 == 9 else f"k{i % 3}") for i in range(90) if i != 50], "id string, kind string")
    same = R.bm25(queries, index).join(kinds.toDF("query_id", "a"), "query_id").join(kinds.toDF("doc_id", "b"), "doc_id").where("a = b")
    rows = lambda df: {tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect()}
    assert rows(R.bm25_top_k(queries, [(index, 1.0)], 4, kinds)) == rows(R.top_k(same, 4))


def ranked_far_down(spark, path: str) -> tuple[str, list[str]]:
    """150 questions that share every word with the one query, and ten of the query's type that share one word."""
    ident = lambda n: f"{n:08x}-0000"
    far = [ident(20 * i + 7) for i in range(10)]
    rows = [(ident(20), "alpha beta gamma", "PRINCIPLE"), *[(ident(20 * i + 1), "alpha beta gamma", "CODING") for i in range(150)], *[(i, "alpha delta epsilon zeta", "PRINCIPLE") for i in far]]
    c = spark.createDataFrame(rows, "id string, canonical_text string, question_type string")
    c.write.parquet(f"{path}/canonical.parquet")
    c.select(F.concat(F.lit("o"), "id").alias("id"), F.col("id").alias("canonical_question_id"), F.col("canonical_text").alias("normalized_question")).write.parquet(f"{path}/occurrence.parquet")
    return path, far


def test_preferred_pool_searches_the_type_before_the_cut(spark, tmp_path):
    d, far = ranked_far_down(spark, str(tmp_path))
    got = catalogue.queries()["preferred_pool"](spark, d).where("source = 'preferred'").collect()
    assert {r.doc_id for r in got} == set(far)


def test_branches_rank_100_and_facets_50(spark, tmp_path):
    d, _ = ranked_far_down(spark, str(tmp_path))
    for name in ("bm25_topk", "bm25_variants_topk", "bm25_two_field_max"):
        assert catalogue.queries()[name](spark, d).count() == 100, name
    stages = {r.stage: r["count"] for r in queries._staged(spark, d).groupBy("stage").count().collect()}
    assert stages["main"] == 100
    assert max(n for s, n in stages.items() if s.startswith("facet")) == 50


def test_every_span_is_grounded_scored_and_aligned(spark, tmp_path):
    span = lambda start, quote: ("r", start, start + 10, quote)
    rows = [("a", "one two", "text", [span(0, "one"), span(100, "three")]), ("b", "one two", "other", [span(200, "two"), span(200, "two")]), ("c", "x", "none", [])]
    schema = "id string, raw_question string, normalized_question string, source_spans array<struct<revision_id string, start_char int, end_char int, quote string>>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/occurrence.parquet")
    run = lambda name: sorted(tuple(r) for r in catalogue.queries()[name](spark, str(tmp_path)).collect())
    assert run("quote_grounding") == [("a", "FOUND", 0), ("a", "MISSING", None), ("b", "FOUND", 4)]
    assert run("span_alignment") == [("a", "a"), ("a", "a"), ("b", "b")]
    side = {i: hashlib.md5(i.encode()).hexdigest()[10] for i in ("a", "b")}  # noqa: S324
    n = {"a": 2, "b": 1}
    gold, found = (sum(n[i] for i in n if ok(side[i])) for ok in (lambda x: x < "e", lambda x: x >= "3"))
    both = sum(n[i] for i in n if "3" <= side[i] < "e")
    assert [r[:3] for r in run("extraction_scoring")] == [(both, found - both, gold - both)]


def test_a_bad_vector_at_the_head_of_a_block_costs_no_neighbour(spark):
    for bad in (None, [], [1.0], [0.0, 0.0]):
        rows = spark.createDataFrame([(0, bad), (1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [1.0])], "id long, v array<float>").coalesce(1)
        got = R.cosine_top_k(rows.where("id < 2"), rows, "id", "v", 3).where("query_id = 1").collect()
        assert [r.id for r in got] == [2], bad


def test_files_are_the_same_however_the_hash_is_spelled(spark, tmp_path):
    a, b = "ab" * 32, "cd" * 32
    rows = [("r1", "s1", a), ("r2", "s2", f"SHA256: {a.upper()}"), ("r3", "s3", f"0x{b}"), ("r4", "s3", b), ("r5", "s4", "Lost"), ("r6", "s5", "lost"), ("r7", "s6", None)]
    spark.createDataFrame(rows, "id string, source_document_id string, raw_file_hash string").write.parquet(f"{tmp_path}/source_revision.parquet")
    got = {tuple(r) for r in catalogue.queries()["files_under_several_documents"](spark, str(tmp_path)).collect()}
    assert got == {(a, 2, "r1"), ("lost", 2, "r5")}
