"""Registered queries: filters, statistics, ranking, pages, coverage, details."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from occura import corpus
from occura.corpus import ACTIVE_SQL, ANNOTATION_SQL, STATE_SQL
from occura.operators import analytics as A
from occura.operators.filters import INTERVIEW, PUBLISH, FilterSpec, apply, reads
from occura.registry import Registry

register = Registry()
AS_OF = date(2026, 6, 30)
WINDOW = FilterSpec(start=date(2025, 7, 1), end=date(2026, 1, 1))
STATUSES = ["UNSEEN", "WEAK"]
_WHEN = "coalesce(interview_date, publish_date)"
_WITH = f"WITH {ACTIVE_SQL}"
_ROW = "occurrence_id, canonical_question_id, interview_id, source_id"


def _active(spark: SparkSession, d: str, *need: str) -> DataFrame:
    return corpus.active_occurrences(spark, d, need=need)


def _filtered(name: str, spec: FilterSpec, where: str, *, labels: bool = False) -> None:
    """Registers a filter query and its counterpart."""
    sql = f"{_WITH}{', ' + ANNOTATION_SQL if labels else ''} SELECT {_ROW} FROM active WHERE {where}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        return apply(_active(spark, d, *reads(spec)), spec, corpus.annotations(spark, d) if labels else None).select(*_ROW.split(", "))

    register(name, sql)(run)


register("active_scan_join", f"{_WITH} SELECT {_ROW}, revision_id, build_id, source_type FROM active")(lambda spark, d: _active(spark, d).select(*_ROW.split(", "), "revision_id", "build_id", "source_type"))
register("active_scan_unidentified", f"{_WITH} SELECT occurrence_id, interview_id FROM active_any WHERE canonical_question_id IS NULL")(
    lambda spark, d: corpus.active_occurrences(spark, d, with_canonical=False).where("canonical_question_id IS NULL").select("occurrence_id", "interview_id")
)
_filtered("filter_same_occurrence", FilterSpec(round="SECOND", question_type="SYSTEM_DESIGN"), "round = 'SECOND' AND question_type = 'SYSTEM_DESIGN'")
_filtered("filter_position_rewrite", FilterSpec(position="Java后端开发"), "job_family = 'BACKEND' AND list_contains(list_transform(language_tags, lambda t: upper(t)), 'JAVA')")
_filtered("filter_position_exact", FilterSpec(position="产品经理"), "position_normalized = '产品经理'")
_filtered("filter_job_family", FilterSpec(job_family="ALGORITHM"), "job_family = 'ALGORITHM'")
_filtered("filter_language", FilterSpec(language="java"), "list_contains(list_transform(language_tags, lambda t: upper(t)), 'JAVA')")
_filtered("filter_topic_l1", FilterSpec(topic_l1="store"), "split_part(topic_id, '.', 1) = 'store'")
_filtered("filter_topic_l2", FilterSpec(topic_l2="paging"), "split_part(topic_id, '.', 2) = 'paging'")
_filtered("filter_topic_l1_l2", FilterSpec(topic_l1="dist", topic_l2="election"), "topic_id = 'dist.election'")
_filtered("filter_question_type", FilterSpec(question_type="CODING"), "question_type = 'CODING'")
_filtered("filter_semi_annotation", FilterSpec(response_form="CODE"), "occurrence_id IN (SELECT occurrence_id FROM annotation WHERE response_form = 'CODE')", labels=True)
_filtered("filter_focus_mixed", FilterSpec(coding_focus="ALGORITHM"), "EXISTS (SELECT 1 FROM annotation n WHERE n.occurrence_id = active.occurrence_id AND coding_focus IN ('ALGORITHM', 'MIXED'))", labels=True)
_filtered("filter_annotation_known", FilterSpec(annotation_status="KNOWN"), "EXISTS (SELECT 1 FROM annotation n WHERE n.occurrence_id = active.occurrence_id AND response_form <> 'UNKNOWN' AND coding_focus <> 'UNKNOWN')", labels=True)
_filtered("filter_annotation_unknown", FilterSpec(annotation_status="UNKNOWN"), "NOT EXISTS (SELECT 1 FROM annotation n WHERE n.occurrence_id = active.occurrence_id AND response_form <> 'UNKNOWN' AND coding_focus <> 'UNKNOWN')", labels=True)
_filtered("filter_annotation_status", FilterSpec(annotation_status="VERIFIED", response_form="VERBAL"), "occurrence_id IN (SELECT occurrence_id FROM annotation WHERE status = 'VERIFIED' AND response_form = 'VERBAL')", labels=True)
_filtered("filter_effective_date_interview", FilterSpec(date_basis=INTERVIEW, start=WINDOW.start, end=WINDOW.end), "interview_date >= DATE '2025-07-01' AND interview_date < DATE '2026-01-01'")
_filtered("filter_effective_date_publish", FilterSpec(date_basis=PUBLISH, start=WINDOW.start), "publish_date >= DATE '2025-07-01'")
_filtered("filter_best_available_window", WINDOW, f"{_WHEN} >= DATE '2025-07-01' AND {_WHEN} < DATE '2026-01-01'")


@register("filter_anti_unannotated", f"{_WITH}, {ANNOTATION_SQL} SELECT {_ROW} FROM active WHERE NOT EXISTS (SELECT 1 FROM annotation n WHERE n.occurrence_id = active.occurrence_id)")
def filter_anti_unannotated(spark: SparkSession, d: str) -> DataFrame:
    return _active(spark, d).join(corpus.annotations(spark, d).select("occurrence_id"), "occurrence_id", "left_anti").select(*_ROW.split(", "))


@register("filter_company_of_list", f"{_WITH} SELECT {_ROW} FROM active WHERE company_normalized = (SELECT company_name FROM company_ref WHERE ref_id = 1)")
def filter_company_of_list(spark: SparkSession, d: str) -> DataFrame:
    company = corpus.scan(spark, d, "company_ref", "ref_id", "company_name").where("ref_id = 1").first().company_name
    return apply(_active(spark, d, "company_normalized"), FilterSpec(company=company)).select(*_ROW.split(", "))


@register("visitor_search", "SELECT DISTINCT id, source_identity FROM source_document WHERE contains(lower(source_identity), 'code') OR contains(lower(coalesce(source_url, '')), 'code') OR contains(lower(original_relative_path), 'code')")
def visitor_search(spark: SparkSession, d: str) -> DataFrame:
    """Case-insensitive search over three columns; plain containment, so nothing needs escaping."""
    source = corpus.records(spark, d, "source_document", "id", "source_identity", "source_url", "original_relative_path")
    hit = None
    for c in ("source_identity", "source_url", "original_relative_path"):
        one = F.coalesce(F.lower(c).contains("code"), F.lit(False))
        hit = one if hit is None else hit | one
    return source.where(hit).select("id", "source_identity")


# ---------------------------------------------------------------- grouped statistics


def _group_sql(key: str, scope: str = "active") -> str:
    return f"""SELECT {key} AS key, count(*) AS occurrence_count, count(DISTINCT interview_id) AS interview_count, count(DISTINCT source_id) AS source_document_count,
      count(DISTINCT company_normalized) AS company_count,
      CAST(sum(CASE WHEN {_WHEN} >= DATE '2026-03-30' AND {_WHEN} < DATE '2026-07-01' THEN 1 ELSE 0 END) AS BIGINT) AS recent_count, min(occurrence_id) AS witness_id
    FROM {scope} GROUP BY 1"""


_KEYS = {
    "question": "canonical_question_id",
    "company": "coalesce(company_normalized, 'UNKNOWN')",
    "round": "coalesce(round, 'UNKNOWN')",
    "topic_l1": "coalesce(split_part(topic_id, '.', 1), '其他')",
    "topic_l2": "topic_id",
}


def _stats(by: str) -> None:
    register(f"stats_by_{by}", f"{_WITH} {_group_sql(_KEYS[by])}")(lambda spark, d: A.grouped(_active(spark, d, *A.MEASURED, *A.GROUPED[by]), by, AS_OF))


for _by in _KEYS:
    _stats(_by)

register("stats_totals", f"{_WITH} SELECT count(*) AS occurrences, count(DISTINCT interview_id) AS interviews, count(DISTINCT source_id) AS source_documents, count(DISTINCT company_normalized) AS known_companies FROM active")(lambda spark, d: A.totals(_active(spark, d, "company_normalized")))
register("stats_time_month", f"{_WITH} SELECT coalesce(split_part(topic_id, '.', 1), '其他') AS key, strftime({_WHEN}, '%Y-%m') AS bucket, count(*) AS occurrences FROM active WHERE {_WHEN} IS NOT NULL GROUP BY ALL")(
    lambda spark, d: A.time_buckets(_active(spark, d, "topic_id", "interview_date", "publish_date"), "topic_l1", "month")
)
register("stats_time_week", f"{_WITH} SELECT coalesce(round, 'UNKNOWN') AS key, strftime(date_trunc('week', {_WHEN}), '%Y-%m-%d') AS bucket, count(*) AS occurrences FROM active WHERE {_WHEN} IS NOT NULL GROUP BY ALL")(
    lambda spark, d: A.time_buckets(_active(spark, d, "round", "interview_date", "publish_date"), "round", "week")
)
register(
    "stats_date_coverage",
    f"""{_WITH} SELECT (SELECT count(*) FROM active WHERE {_WHEN} IS NULL) AS unknown_date_count,
    (SELECT count(*) FROM active WHERE {_WHEN} >= DATE '2025-07-01' AND {_WHEN} < DATE '2026-01-01' AND interview_date IS NULL AND publish_date IS NOT NULL) AS publish_fallback_count""",
)(lambda spark, d: A.date_coverage(_active(spark, d, "interview_date", "publish_date"), WINDOW, apply))


# ---------------------------------------------------------------- scores, ranks, pages

_SCORED = f"""{_WITH}, {STATE_SQL}, g AS ({_group_sql(_KEYS["question"])}),
one AS (SELECT max(occurrence_count) AS f_max, max(recent_count) AS r_max, (SELECT count(DISTINCT company_normalized) FROM active) AS c_all FROM g),
scored AS (SELECT g.*, round(CAST(0.5 AS DOUBLE) * coalesce(ln(1 + CAST(occurrence_count AS DOUBLE)) / nullif(ln(1 + CAST(f_max AS DOUBLE)), 0), 0)
    + CAST(0.3 AS DOUBLE) * coalesce(CAST(company_count AS DOUBLE) / nullif(c_all, 0), 0) + CAST(0.2 AS DOUBLE) * coalesce(CAST(recent_count AS DOUBLE) / nullif(r_max, 0), 0), 9) AS importance_score FROM g, one),
banded AS (SELECT *, CASE WHEN importance_score >= 0.7 THEN 'CORE' WHEN importance_score >= 0.3 THEN 'COMMON' ELSE 'LONG_TAIL' END AS importance_band FROM scored),
gapped AS (SELECT b.*, coalesce(u.user_status, 'UNSEEN') AS user_status,
    round(importance_score * CASE coalesce(u.user_status, 'UNSEEN') WHEN 'WEAK' THEN CAST(1 AS DOUBLE) WHEN 'UNSEEN' THEN CAST(0.8 AS DOUBLE) WHEN 'REVIEWED' THEN CAST(0.4 AS DOUBLE) ELSE 0 END, 9) AS gap_score
  FROM banded b LEFT JOIN user_state u ON u.canonical_question_id = b.key)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return A.scored_scope(_active(spark, d, *A.MEASURED), "question", AS_OF)


def _gapped(spark: SparkSession, d: str) -> DataFrame:
    return A.with_gap(_scored(spark, d), corpus.user_states(spark, d))


_RANKED = "key, occurrence_count, importance_score, importance_band, rank"


@register("importance_rank", f"{_SCORED} SELECT {_RANKED} FROM (SELECT *, row_number() OVER (ORDER BY importance_score DESC, key) AS rank FROM banded) WHERE rank <= 1000")
def importance_rank(spark: SparkSession, d: str) -> DataFrame:
    return A.top_ranked(_scored(spark, d), "importance_score", 1000).select(*_RANKED.split(", "))


register("importance_bands", f"{_SCORED} SELECT importance_band, count(*) AS questions, CAST(sum(occurrence_count) AS BIGINT) AS occurrences FROM banded GROUP BY 1")(
    lambda spark, d: _scored(spark, d).groupBy("importance_band").agg(F.count("*").alias("questions"), F.sum("occurrence_count").alias("occurrences"))
)
_GAP = "key, user_status, importance_score, gap_score, rank"
register("gap_rank", f"{_SCORED} SELECT {_GAP} FROM (SELECT *, row_number() OVER (ORDER BY gap_score DESC, key) AS rank FROM gapped) WHERE rank <= 1000")(
    lambda spark, d: A.top_ranked(_gapped(spark, d), "gap_score", 1000).select(*_GAP.split(", "))
)
_TOP = "key, user_status, occurrence_count, rank"
register("topn_review_before", f"{_SCORED} SELECT {_TOP} FROM (SELECT *, row_number() OVER (ORDER BY occurrence_count DESC, key) AS rank FROM gapped WHERE user_status IN ('UNSEEN', 'WEAK')) WHERE rank <= 40")(
    lambda spark, d: A.top_ranked(_gapped(spark, d).where(F.col("user_status").isin(STATUSES)), "occurrence_count", 40).select(*_TOP.split(", "))
)
register("topn_review_after", f"{_SCORED} SELECT {_TOP} FROM (SELECT *, row_number() OVER (ORDER BY occurrence_count DESC, key) AS rank FROM gapped) WHERE rank <= 40 AND user_status IN ('UNSEEN', 'WEAK')")(
    lambda spark, d: A.top_ranked(_gapped(spark, d), "occurrence_count", 40).where(F.col("user_status").isin(STATUSES)).select(*_TOP.split(", "))
)


@register("keyset_page2", f"{_SCORED} SELECT key, importance_score FROM banded ORDER BY importance_score DESC, key LIMIT 20 OFFSET 20")
def keyset_page2(spark: SparkSession, d: str) -> DataFrame:
    """The second page, found from the last row of the first one rather than by an offset."""
    return A.next_page(_scored(spark, d).select("key", "importance_score"), "importance_score", 20)


register("offset_page", f"{_WITH} SELECT occurrence_id, canonical_question_id FROM active ORDER BY occurrence_id LIMIT 25 OFFSET 50")(
    lambda spark, d: _active(spark, d).select("occurrence_id", "canonical_question_id").orderBy("occurrence_id").offset(50).limit(25)
)
register("witness_rows", f"{_WITH} SELECT canonical_question_id AS key, min(occurrence_id) AS occurrence_id, arg_min(interview_id, occurrence_id) AS interview_id, arg_min(company_normalized, occurrence_id) AS company FROM (SELECT *, 1 AS x FROM active) GROUP BY 1")(
    lambda spark, d: _active(spark, d, "company_normalized").groupBy(F.col("canonical_question_id").alias("key")).agg(F.min(F.struct("occurrence_id", "interview_id", "company_normalized")).alias("w"))
    .select("key", "w.occurrence_id", "w.interview_id", F.col("w.company_normalized").alias("company"))
)
register.oracles["witness_rows"] = f"{_WITH}, w AS (SELECT canonical_question_id AS key, min(occurrence_id) AS occurrence_id FROM active GROUP BY 1) SELECT key, w.occurrence_id, a.interview_id, a.company_normalized AS company FROM w JOIN active a ON a.occurrence_id = w.occurrence_id"

_COUNT = "count(DISTINCT canonical_question_id) AS canonical_questions, count(*) AS occurrences, count(DISTINCT interview_id) AS interviews, count(DISTINCT source_id) AS source_documents, count(DISTINCT company_normalized) AS known_companies"
register("count_scope", f"{_WITH} SELECT {_COUNT} FROM active")(lambda spark, d: A.count_scope(_active(spark, d, "company_normalized")))
register("count_review_scope", f"{_WITH}, {STATE_SQL} SELECT {_COUNT} FROM (SELECT a.* FROM active a LEFT JOIN user_state u ON a.canonical_question_id = u.canonical_question_id WHERE coalesce(user_status, 'UNSEEN') IN ('UNSEEN', 'WEAK'))")(
    lambda spark, d: A.count_scope(A.review_scope(_active(spark, d, "company_normalized"), corpus.user_states(spark, d), STATUSES))
)
register(
    "task_coverage",
    f"""{_WITH}, {ANNOTATION_SQL}, x AS (SELECT count(*) AS occurrences, count(status) AS annotated, count(*) FILTER (response_form <> 'UNKNOWN' AND coding_focus <> 'UNKNOWN') AS classified,
      count(*) FILTER (status = 'VERIFIED') AS verified FROM active a LEFT JOIN annotation n ON a.occurrence_id = n.occurrence_id)
    SELECT occurrences, classified, occurrences - classified AS unknown, occurrences - annotated AS pending, annotated - classified AS uncertain, verified, annotated - verified AS needs_review FROM x""",
)(lambda spark, d: A.task_coverage(_active(spark, d), corpus.annotations(spark, d)))

# ---------------------------------------------------------------- details

register("detail_distribution", f"{_WITH} SELECT canonical_question_id AS key, coalesce(company_normalized, 'UNKNOWN') AS value, count(*) AS occurrences FROM active GROUP BY ALL")(lambda spark, d: A.distribution(_active(spark, d, "company_normalized"), "company"))
register("detail_round_distribution", f"{_WITH} SELECT canonical_question_id AS key, coalesce(round, 'UNKNOWN') AS value, count(*) AS occurrences FROM active GROUP BY ALL")(lambda spark, d: A.distribution(_active(spark, d, "round"), "round"))
register("detail_variants", "SELECT canonical_question_id AS key, count(DISTINCT normalized_question) AS variants, min(normalized_question) AS first_variant FROM occurrence WHERE canonical_question_id IS NOT NULL GROUP BY 1")(
    lambda spark, d: corpus.scan(spark, d, "occurrence", "canonical_question_id", "normalized_question").where("canonical_question_id IS NOT NULL")
    .groupBy(F.col("canonical_question_id").alias("key")).agg(F.countDistinct("normalized_question").alias("variants"), F.min("normalized_question").alias("first_variant"))
)


@register(
    "followup_support",
    """WITH o AS (SELECT DISTINCT id, interview_id, canonical_question_id, question_order FROM occurrence),
    n AS (SELECT interview_id, canonical_question_id AS source_id, lead(canonical_question_id) OVER (PARTITION BY interview_id ORDER BY question_order, id) AS target_id FROM o)
    SELECT source_id, target_id, count(*) AS edges, count(DISTINCT interview_id) AS interviews FROM n WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id GROUP BY ALL""",
)
def followup_support(spark: SparkSession, d: str) -> DataFrame:
    occurrence = corpus.records(spark, d, "occurrence", "id", "interview_id", "canonical_question_id", "question_order").withColumnRenamed("id", "occurrence_id")
    return A.followups(occurrence)


@register(
    "occurrence_sources",
    """SELECT id AS occurrence_id, s.revision_id, coalesce(s.start_line, 1) AS start_line, coalesce(s.end_line, s.start_line, 1) AS end_line, count(*) AS spans
    FROM (SELECT DISTINCT id, source_spans FROM occurrence), unnest(source_spans) AS t(s) GROUP BY ALL""",
)
def occurrence_sources(spark: SparkSession, d: str) -> DataFrame:
    spans = corpus.records(spark, d, "occurrence", "id", "source_spans").select(F.col("id").alias("occurrence_id"), F.explode("source_spans").alias("s"))
    one = F.lit(1)
    return spans.groupBy("occurrence_id", "s.revision_id", F.coalesce("s.start_line", one).alias("start_line"), F.coalesce("s.end_line", "s.start_line", one).alias("end_line")).agg(F.count("*").alias("spans"))


@register(
    "context_occurrences",
    f"{_WITH} SELECT canonical_question_id, occurrence_id, place FROM (SELECT canonical_question_id, occurrence_id, row_number() OVER (PARTITION BY canonical_question_id ORDER BY occurrence_id) AS place FROM active) WHERE place <= 2",
)
def context_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """At most two occurrences of each question, by id (a group limit runs before the shuffle)."""
    w = Window.partitionBy("canonical_question_id").orderBy("occurrence_id")
    ranked = _active(spark, d).select("canonical_question_id", "occurrence_id").withColumn("place", F.row_number().over(w))
    return ranked.where("place <= 2").withColumn("place", F.col("place").cast("long"))
