"""Exact occurrence analytics: grouped statistics, importance and gap scores, ranking, pages, distributions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from occura import shared
from occura.operators.filters import BEST_AVAILABLE, FilterSpec, effective_date

# Score weights, band limits, gap weights by study status.
WEIGHTS = {"frequency": 0.5, "coverage": 0.3, "recent": 0.2}
CORE, COMMON = 0.7, 0.3
GAP_WEIGHT = {"WEAK": 1.0, "UNSEEN": 0.8, "REVIEWED": 0.4, "MASTERED": 0.0}
RECENT_MONTHS = 3
DIGITS = 9


# Attributes that grouping and counting read.
MEASURED = ("company_normalized", "interview_date", "publish_date")
GROUPED = {"question": (), "company": ("company_normalized",), "round": ("round",), "topic_l1": ("topic_id",), "topic_l2": ("topic_id",)}


def group_key(by: str) -> F.Column:
    """The grouping expression; missing companies and rounds form a group of their own."""
    if by == "question":
        return F.col("canonical_question_id")
    if by == "company":
        return F.coalesce("company_normalized", F.lit("UNKNOWN"))
    if by == "round":
        return F.coalesce("round", F.lit("UNKNOWN"))
    if by == "topic_l2":
        return F.col("topic_id")
    if by == "topic_l1":
        return F.coalesce(F.split("topic_id", r"\.")[0], F.lit("其他"))
    raise ValueError(f"cannot group by {by!r}")


def grouped(scope: DataFrame, by: str, as_of: date, basis: str = BEST_AVAILABLE) -> DataFrame:
    """Counts per group, and the smallest occurrence id as its witness.

    The counts of distinct interviews, sources and companies come from one pre-aggregation on (group, interview):
    an interview has one source and one company, so what the distinct counts shuffle is pairs, not occurrences.
    """
    when, today = effective_date(basis), F.lit(as_of)
    recent = (when >= F.add_months(today, -RECENT_MONTHS)) & (when < F.date_add(today, 1))
    return _groups(_per_interview(scope, group_key(by), recent))


def _per_interview(scope: DataFrame, key: F.Column, recent: F.Column) -> DataFrame:
    return scope.groupBy(key.alias("key"), "interview_id", "source_id", "company_normalized").agg(
        F.count("*").alias("n"), F.sum(F.when(recent, 1).otherwise(0)).alias("r"), F.min("occurrence_id").alias("w")
    )


def _groups(per_interview: DataFrame) -> DataFrame:
    return per_interview.groupBy("key").agg(
        F.sum("n").alias("occurrence_count"), F.count("*").alias("interview_count"), F.countDistinct("source_id").alias("source_document_count"),
        F.countDistinct("company_normalized").alias("company_count"), F.sum("r").cast("long").alias("recent_count"), F.min("w").alias("witness_id"),
    )


def scored_scope(scope: DataFrame, by: str, as_of: date, basis: str = BEST_AVAILABLE) -> DataFrame:
    """``scored`` groups of a scope, whose joins are run once: the pre-aggregated pairs are written to a table, from
    which groups, largest counts and known companies are taken, and the groups to another that every reader scans."""
    when, today = effective_date(basis), F.lit(as_of)
    recent = (when >= F.add_months(today, -RECENT_MONTHS)) & (when < F.date_add(today, 1))
    pairs = shared.written(_per_interview(scope, group_key(by), recent), "pairs")
    groups = shared.written(_groups(pairs), "groups")
    return scored(groups, pairs.agg(F.countDistinct("company_normalized").alias("known_companies")))


def totals(scope: DataFrame) -> DataFrame:
    """One row: occurrences, interviews, source documents and known companies of the scope."""
    return scope.agg(
        F.count("*").alias("occurrences"), F.countDistinct("interview_id").alias("interviews"), F.countDistinct("source_id").alias("source_documents"), F.countDistinct("company_normalized").alias("known_companies")
    )


def date_coverage(active: DataFrame, spec: FilterSpec, apply) -> DataFrame:
    """One row: occurrences without a date (whatever the window) and those dated by publication only."""
    when = effective_date(spec.date_basis)
    unknown = apply(active, spec.without_window()).agg(F.count(F.when(when.isNull(), 1)).alias("unknown_date_count"))
    fallback = F.col("interview_date").isNull() & F.col("publish_date").isNotNull() & F.lit(spec.date_basis == BEST_AVAILABLE)
    dated = apply(active, spec).agg(F.count(F.when(fallback, 1)).alias("publish_fallback_count"))
    return unknown.crossJoin(dated)


def time_buckets(scope: DataFrame, by: str, bucket: str, basis: str = BEST_AVAILABLE) -> DataFrame:
    """(key, bucket, occurrences) per calendar month, or per week named by its Monday; only dated rows, no filling."""
    when = effective_date(basis)
    name = F.date_format(when, "yyyy-MM") if bucket == "month" else F.date_format(F.trunc(when, "week"), "yyyy-MM-dd")
    return scope.where(when.isNotNull()).groupBy(group_key(by).alias("key"), name.alias("bucket")).agg(F.count("*").alias("occurrences"))


def scored(groups: DataFrame, known_companies: DataFrame) -> DataFrame:
    """Adds the importance score and its band.

    Largest counts come from a one-row aggregate that is joined to all groups: a window over everything would
    bring all groups into one task. Scores are rounded so that order and page limits agree everywhere.
    """
    limits = groups.agg(F.max("occurrence_count").alias("f_max"), F.max("recent_count").alias("r_max"))
    one = limits.crossJoin(known_companies.select("known_companies"))
    part = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    frequency = part(F.log1p("occurrence_count"), F.log1p("f_max"))
    coverage = part(F.col("company_count").cast("double"), F.col("known_companies").cast("double"))
    recent = part(F.col("recent_count").cast("double"), F.col("r_max").cast("double"))
    score = F.round(WEIGHTS["frequency"] * frequency + WEIGHTS["coverage"] * coverage + WEIGHTS["recent"] * recent, DIGITS)
    with_score = groups.join(F.broadcast(one)).withColumn("importance_score", score).drop("f_max", "r_max", "known_companies")
    band = F.when(F.col("importance_score") >= CORE, "CORE").when(F.col("importance_score") >= COMMON, "COMMON").otherwise("LONG_TAIL")
    return with_score.withColumn("importance_band", band)


def with_gap(scored_groups: DataFrame, states: DataFrame) -> DataFrame:
    """Adds the user's status (UNSEEN where none is stored) and the gap score; unknown statuses weigh nothing."""
    joined = scored_groups.join(states.withColumnRenamed("canonical_question_id", "key"), "key", "left").withColumn("user_status", F.coalesce("user_status", F.lit("UNSEEN")))
    weight = F.lit(0.0)
    for status, w in GAP_WEIGHT.items():
        weight = F.when(F.col("user_status") == status, w).otherwise(weight)
    return joined.withColumn("gap_score", F.round(F.col("importance_score") * weight, DIGITS))


def top_ranked(groups: DataFrame, score: str, n: int) -> DataFrame:
    """The n best groups with their rank: sorted and cut in parallel first, ranked on what is left."""
    best = groups.orderBy(F.col(score).desc(), "key").limit(n)
    w = Window.partitionBy(F.lit(0)).orderBy(F.col(score).desc(), "key")
    return best.withColumn("rank", F.row_number().over(w).cast("long"))


def page_after(groups: DataFrame, score: str, last_score: float, last_key: str, size: int) -> DataFrame:
    """The next page in (score descending, key) order after the given row."""
    s = F.col(score)
    return groups.where((s < last_score) | ((s == last_score) & (F.col("key") > last_key))).orderBy(s.desc(), "key").limit(size)


def count_scope(scope: DataFrame) -> DataFrame:
    """One row of exact distinct counts."""
    return scope.agg(
        F.countDistinct("canonical_question_id").alias("canonical_questions"), F.count("*").alias("occurrences"), F.countDistinct("interview_id").alias("interviews"),
        F.countDistinct("source_id").alias("source_documents"), F.countDistinct("company_normalized").alias("known_companies"),
    )


def review_scope(scope: DataFrame, states: DataFrame, statuses: list[str]) -> DataFrame:
    """Occurrences whose question has one of ``statuses`` (duplicates in the list change nothing)."""
    status = F.coalesce("user_status", F.lit("UNSEEN"))
    return scope.join(states, "canonical_question_id", "left").where(status.isin(sorted(set(statuses))))


def task_coverage(scope: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of label coverage over a scope without task conditions, from a single left join."""
    joined = scope.select("occurrence_id").join(labels, "occurrence_id", "left")
    known = (F.col("response_form") != "UNKNOWN") & (F.col("coding_focus") != "UNKNOWN")
    n = lambda c: F.count(F.when(c, 1))
    sums = joined.agg(F.count("*").alias("occurrences"), n(F.col("status").isNotNull()).alias("annotated"), n(known).alias("classified"), n(F.col("status") == "VERIFIED").alias("verified"))
    return sums.select(
        "occurrences", "classified", (F.col("occurrences") - F.col("classified")).alias("unknown"), (F.col("occurrences") - F.col("annotated")).alias("pending"),
        (F.col("annotated") - F.col("classified")).alias("uncertain"), "verified", (F.col("annotated") - F.col("verified")).alias("needs_review"),
    )


def distribution(scope: DataFrame, of: str) -> DataFrame:
    """(key, value, occurrences): histogram of company or round per question, with an UNKNOWN value."""
    return scope.groupBy(F.col("canonical_question_id").alias("key"), group_key(of).alias("value")).agg(F.count("*").alias("occurrences"))


def followups(occurrences: DataFrame) -> DataFrame:
    """Follow-up edges between neighbouring questions of an interview, per pair of canonical questions.

    (source_id, target_id, edges, interviews); questions without identity, and repeats of the same one, give no edge.
    """
    w = Window.partitionBy("interview_id").orderBy("question_order", "occurrence_id")
    following = occurrences.withColumn("target_id", F.lead("canonical_question_id").over(w))
    edges = following.where("canonical_question_id IS NOT NULL AND target_id IS NOT NULL AND canonical_question_id <> target_id")
    return edges.groupBy(F.col("canonical_question_id").alias("source_id"), "target_id").agg(F.count("*").alias("edges"), F.countDistinct("interview_id").alias("interviews"))


def next_page(groups: DataFrame, score: str, size: int) -> DataFrame:
    """The page that follows the first ``size`` groups, found from the last of these rather than by an offset."""
    first = groups.orderBy(F.col(score).desc(), "key").limit(size)
    last = first.groupBy().agg(F.max(F.struct((-F.col(score)).alias("col1"), F.col("key"))).alias("last"), F.count("*").alias("n"))
    after = groups.join(F.broadcast(last)).where((F.col("n") == size) & ((-F.col(score) > F.col("last.col1")) | ((-F.col(score) == F.col("last.col1")) & (F.col("key") > F.col("last.key")))))
    return after.orderBy(F.col(score).desc(), "key").limit(size).drop("last", "n")
