"""The tables of a data directory and the active corpus built from them.

Tables may deliver whole rows twice; every read names its columns and removes repeats on exactly those (a hash
aggregation with partial aggregation before the shuffle), so counts are counts of records.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """A table as delivered, narrowed to ``columns``."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


def records(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """A table's records: ``columns`` must include the id, so that only repeats collapse."""
    return scan(spark, d, name, *columns).distinct()


def lineage(spark: SparkSession, d: str) -> DataFrame:
    """Active, included builds with their source: (build_id, revision_id, source_id, source_type)."""
    build = records(spark, d, "document_build", "id", "source_revision_id", "decision").where("decision = 'INCLUDED'")
    source = records(spark, d, "source_document", "id", "active_build_id", "source_type").where("active_build_id IS NOT NULL")
    revision = records(spark, d, "source_revision", "id", "source_document_id")
    return (
        build.alias("b").join(source.alias("s"), F.col("s.active_build_id") == F.col("b.id"))
        .join(revision.alias("r"), (F.col("r.id") == F.col("b.source_revision_id")) & (F.col("r.source_document_id") == F.col("s.id")))
        .select(F.col("b.id").alias("build_id"), F.col("r.id").alias("revision_id"), F.col("s.id").alias("source_id"), "s.source_type")
    )


INTERVIEW_ATTRIBUTES = ("company_normalized", "position_normalized", "job_family", "language_tags", "round", "interview_date", "publish_date")
OCCURRENCE_ATTRIBUTES = ("question_type", "topic_id")


def active_interviews(spark: SparkSession, d: str, need: Collection[str] = INTERVIEW_ATTRIBUTES) -> DataFrame:
    """Eligible interviews of active builds with the attributes in ``need``.

    Removing repeats groups by every column that is read, so what nobody needs must not be named: the optimizer
    cannot prune a grouping column.
    """
    columns = [c for c in INTERVIEW_ATTRIBUTES if c in need]
    interview = records(spark, d, "interview", "id", "build_id", *columns, "analytics_eligible").where("analytics_eligible")
    return interview.withColumnRenamed("id", "interview_id").drop("analytics_eligible").join(lineage(spark, d), "build_id")


def active_occurrences(spark: SparkSession, d: str, *, with_canonical: bool = True, need: Collection[str] = (*INTERVIEW_ATTRIBUTES, *OCCURRENCE_ATTRIBUTES)) -> DataFrame:
    """One row per asked question of the active corpus, with its ids and the attributes in ``need``; without
    ``with_canonical`` also those not yet identified."""
    columns = ["id", "interview_id", "canonical_question_id", *[c for c in OCCURRENCE_ATTRIBUTES if c in need]]
    occurrence = records(spark, d, "occurrence", *columns).withColumnRenamed("id", "occurrence_id")
    active = occurrence.join(active_interviews(spark, d, need), "interview_id")
    if not with_canonical:
        return active
    canonical = records(spark, d, "canonical", "id").withColumnRenamed("id", "canonical_question_id")
    return active.join(canonical, "canonical_question_id")


def topics(spark: SparkSession, d: str) -> DataFrame:
    """The two-level topic dimension of the ids in use: (topic_id, topic_l1, topic_l2)."""
    part = F.split("topic_id", r"\.")
    return scan(spark, d, "occurrence", "topic_id").where("topic_id IS NOT NULL").distinct().select("topic_id", part[0].alias("topic_l1"), part[1].alias("topic_l2"))


# ------------------------------------------------------------------ derived inputs
# Judgements and user states are inputs of the engine. Where a data directory has none, these derive them by rule
# from a digest of the id, the same way in both engines.


def nibble(column: str, at: int) -> F.Column:
    return F.substring(F.md5(F.col(column).cast("binary")), at, 1)


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """Task labels: (occurrence_id, response_form, coding_focus, status); one in sixteen occurrences has none."""
    base = records(spark, d, "occurrence", "id").where(nibble("id", 1) != "f")
    form, focus, status = (nibble("id", i) for i in (2, 3, 4))
    return base.select(
        F.col("id").alias("occurrence_id"),
        F.when(form < "8", "VERBAL").when(form < "d", "CODE").otherwise("UNKNOWN").alias("response_form"),
        F.when(focus < "4", "ALGORITHM").when(focus < "7", "ENGINEERING").when(focus < "9", "MIXED").when(focus < "e", "NONE").otherwise("UNKNOWN").alias("coding_focus"),
        F.when(status < "a", "VERIFIED").when(status < "e", "AUTO").otherwise("NEEDS_REVIEW").alias("status"),
    )


def user_states(spark: SparkSession, d: str) -> DataFrame:
    """Study status per canonical question: (canonical_question_id, user_status); a quarter has no row."""
    n = nibble("id", 1)
    base = records(spark, d, "canonical", "id").where(n >= "4")
    return base.select(F.col("id").alias("canonical_question_id"), F.when(n < "8", "WEAK").when(n < "c", "REVIEWED").otherwise("MASTERED").alias("user_status"))


# The same relations in SQL, as common table expressions.
ACTIVE_SQL = """
lineage AS (
  SELECT DISTINCT b.id AS build_id, r.id AS revision_id, s.id AS source_id, s.source_type
  FROM document_build b JOIN source_document s ON s.active_build_id = b.id
  JOIN source_revision r ON r.id = b.source_revision_id AND r.source_document_id = s.id
  WHERE b.decision = 'INCLUDED'),
active_interview AS (
  SELECT DISTINCT i.id AS interview_id, i.build_id, i.company_normalized, i.position_normalized, i.job_family, i.language_tags,
         i.round, i.interview_date, i.publish_date, l.revision_id, l.source_id, l.source_type
  FROM interview i JOIN lineage l ON i.build_id = l.build_id WHERE i.analytics_eligible),
active_any AS (
  SELECT o.*, a.* EXCLUDE (interview_id) FROM (SELECT DISTINCT id AS occurrence_id, interview_id, canonical_question_id, question_type, topic_id FROM occurrence) o
  JOIN active_interview a ON o.interview_id = a.interview_id),
active AS (SELECT a.* FROM active_any a JOIN (SELECT DISTINCT id FROM canonical) c ON a.canonical_question_id = c.id)
"""
ANNOTATION_SQL = """
annotation AS (
  SELECT occurrence_id,
    CASE WHEN f < '8' THEN 'VERBAL' WHEN f < 'd' THEN 'CODE' ELSE 'UNKNOWN' END AS response_form,
    CASE WHEN c < '4' THEN 'ALGORITHM' WHEN c < '7' THEN 'ENGINEERING' WHEN c < '9' THEN 'MIXED' WHEN c < 'e' THEN 'NONE' ELSE 'UNKNOWN' END AS coding_focus,
    CASE WHEN s < 'a' THEN 'VERIFIED' WHEN s < 'e' THEN 'AUTO' ELSE 'NEEDS_REVIEW' END AS status
  FROM (SELECT id AS occurrence_id, substr(md5(id), 2, 1) AS f, substr(md5(id), 3, 1) AS c, substr(md5(id), 4, 1) AS s
        FROM (SELECT DISTINCT id FROM occurrence) WHERE substr(md5(id), 1, 1) <> 'f'))
"""
STATE_SQL = """
user_state AS (
  SELECT id AS canonical_question_id, CASE WHEN n < '8' THEN 'WEAK' WHEN n < 'c' THEN 'REVIEWED' ELSE 'MASTERED' END AS user_status
  FROM (SELECT DISTINCT id, substr(md5(id), 1, 1) AS n FROM canonical) WHERE n >= '4')
"""
