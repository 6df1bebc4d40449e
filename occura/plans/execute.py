"""Running a plan: the dispatch from a validated plan to the operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occura import corpus
from occura.functions.text import terms
from occura.operators import analytics, retrieval
from occura.operators.filters import FilterSpec, apply
from occura.plans.plan import Plan, problems, softened, with_label_policy


def run(spark: SparkSession, d: str, plan: Plan, as_of: date, after: tuple[float, str] | None = None) -> DataFrame:
    """The result of ``plan`` over a data directory; a plan with problems raises ValueError."""
    found = problems(plan)
    if found:
        raise ValueError("; ".join(found))
    if plan.action == "NEXT" and after is None:
        raise ValueError("the next page needs the last row of the one before")
    plan, preferred = softened(with_label_policy(plan))
    labels = corpus.annotations(spark, d) if plan.filters.response_form or plan.filters.coding_focus or plan.filters.annotation_status else None
    scope = apply(corpus.active_occurrences(spark, d), plan.filters, labels)
    if plan.action == "COUNT":
        scope = analytics.review_scope(scope, corpus.user_states(spark, d), list(plan.review_statuses)) if plan.review_statuses else scope
        return analytics.count_scope(scope)
    if plan.action == "STATS":
        return analytics.grouped(scope, plan.group_by, as_of, plan.filters.date_basis)
    if plan.action == "DETAILS":
        return analytics.distribution(scope.where(F.col("canonical_question_id").isin(list(plan.ids))), "company")
    if plan.action == "REVIEW_STATE":
        asked = scope.where(F.col("canonical_question_id").isin(list(plan.ids))).select("canonical_question_id").distinct()
        return asked.join(corpus.user_states(spark, d), "canonical_question_id", "left").select("canonical_question_id", F.coalesce("user_status", F.lit("UNSEEN")).alias("user_status"))
    if plan.action == "SEARCH":
        return _search(spark, d, plan, scope, preferred)
    by = plan.group_by or "question"
    groups = analytics.scored_scope(scope, by, as_of, plan.filters.date_basis)
    score = {"frequency": "occurrence_count", "importance": "importance_score", "gap": "gap_score"}[plan.sort]
    if by == "question":
        groups = analytics.with_gap(groups, corpus.user_states(spark, d))
        if plan.review_statuses:
            groups = groups.where(F.col("user_status").isin(list(plan.review_statuses)))
    if plan.top_n:
        groups = analytics.top_ranked(groups, score, plan.top_n)
    if after:
        return analytics.page_after(groups, score, after[0], after[1], plan.page)
    return groups.orderBy(F.col(score).desc(), "key").limit(plan.page)


def _search(spark: SparkSession, d: str, plan: Plan, scope: DataFrame, preferred: dict) -> DataFrame:
    """Eligible questions come first; text and preferred rankings over them are fused."""
    eligible = scope.select(F.col("canonical_question_id").alias("id")).distinct()
    texts = corpus.records(spark, d, "canonical", "id", "canonical_text", "question_type")
    index = retrieval.postings(texts, "id", terms(F.col("canonical_text")))
    query = spark.createDataFrame([("q", plan.query)], "query_id string, text string").select("query_id", F.explode(terms(F.col("text"))).alias("term"))
    hits = retrieval.bm25(query, index).join(eligible.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    rankings = [(retrieval.top_k(hits, 100), 1.0)]
    if preferred:  # conditions nobody named explicitly: what meets them is ranked once more by itself
        wish = FilterSpec(**preferred)
        liked = apply(scope, wish, corpus.annotations(spark, d) if wish.coding_focus else None).select(F.col("canonical_question_id").alias("doc_id")).distinct()
        rankings.append((retrieval.top_k(hits.join(liked, "doc_id", "left_semi"), 100), 1.0))
    return retrieval.top_k(retrieval.fuse(rankings), plan.page)
