"""Conjunctive filters over one active occurrence.

All conditions of a specification hold for the same occurrence row. Labels of a task live in a side table; they
become semi joins, and "unknown or never labelled" becomes an anti join against the known ones.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Date bases, tags that are written in capitals, and words that name the back-end family.
INTERVIEW, PUBLISH, BEST_AVAILABLE = "INTERVIEW", "PUBLISH", "BEST_AVAILABLE"
KNOWN_TAGS = ("JAVA", "GO", "PYTHON", "C++", "JAVASCRIPT", "RUST")
BACKEND_WORDS = ("后端", "服务端", "后台")


@dataclass(frozen=True)
class FilterSpec:
    company: str | None = None
    position: str | None = None
    job_family: str | None = None
    language: str | None = None
    topic_l1: str | None = None
    topic_l2: str | None = None
    question_type: str | None = None
    response_form: str | None = None
    coding_focus: str | None = None
    annotation_status: str | None = None
    round: str | None = None
    date_basis: str = BEST_AVAILABLE
    start: date | None = None
    end: date | None = None

    def __post_init__(self) -> None:
        if self.start and self.end and self.start >= self.end:
            raise ValueError("the window is empty: start must lie before end")
        if self.date_basis not in (INTERVIEW, PUBLISH, BEST_AVAILABLE):
            raise ValueError(f"unknown date basis {self.date_basis!r}")

    def without_tasks(self) -> FilterSpec:
        return replace(self, response_form=None, coding_focus=None, annotation_status=None)

    def without_window(self) -> FilterSpec:
        return replace(self, start=None, end=None)

    def applied(self) -> dict:
        """The fields that are set, for reports."""
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}


# Columns of an active occurrence that each condition reads.
_READS = {
    "company": ("company_normalized",), "position": ("position_normalized", "job_family", "language_tags"), "job_family": ("job_family",), "language": ("language_tags",), "topic_l1": ("topic_id",),
    "topic_l2": ("topic_id",), "question_type": ("question_type",), "round": ("round",), "start": ("interview_date", "publish_date"), "end": ("interview_date", "publish_date"),
}


def reads(spec: FilterSpec) -> set[str]:
    """The attributes that the conditions of ``spec`` need."""
    return {c for name in spec.applied() for c in _READS.get(name, ())}


def canonical_tag(tag: str) -> str:
    """Known language tags in capitals; others as they are."""
    return tag.upper() if tag.upper() in KNOWN_TAGS else tag


def effective_date(basis: str) -> F.Column:
    if basis == INTERVIEW:
        return F.col("interview_date")
    return F.col("publish_date") if basis == PUBLISH else F.coalesce("interview_date", "publish_date")


def row_conditions(spec: FilterSpec) -> list[F.Column]:
    """Conditions on the occurrence row itself."""
    out: list[F.Column] = []
    for name, column in (("company", "company_normalized"), ("job_family", "job_family"), ("question_type", "question_type"), ("round", "round")):
        if getattr(spec, name) is not None:
            out.append(F.col(column) == getattr(spec, name))
    if spec.position is not None:
        if any(w in spec.position for w in BACKEND_WORDS):
            out.append(F.col("job_family") == "BACKEND")
            if "java" in spec.position.lower():
                out.append(_has_tag("JAVA"))
        else:
            out.append(F.col("position_normalized") == spec.position)
    if spec.language is not None:
        out.append(_has_tag(canonical_tag(spec.language)))
    if spec.topic_l1 is not None:
        out.append(F.split("topic_id", r"\.")[0] == spec.topic_l1)
    if spec.topic_l2 is not None:
        out.append(F.split("topic_id", r"\.")[1] == spec.topic_l2)
    when = effective_date(spec.date_basis)
    if spec.start is not None:
        out.append(when >= F.lit(spec.start))
    if spec.end is not None:
        out.append(when < F.lit(spec.end))
    return out


def _has_tag(tag: str) -> F.Column:
    return F.exists("language_tags", lambda t: F.upper(t) == tag.upper())


def label_condition(spec: FilterSpec) -> tuple[F.Column | None, bool]:
    """(condition on a label row, whether an occurrence without any label row passes too)."""
    parts: list[F.Column] = []
    unlabelled = False
    if spec.response_form is not None:
        parts.append(F.col("response_form") == spec.response_form)
    if spec.coding_focus is not None:
        wanted = [spec.coding_focus, "MIXED"] if spec.coding_focus in ("ENGINEERING", "ALGORITHM") else [spec.coding_focus]
        parts.append(F.col("coding_focus").isin(wanted))
    known = (F.col("response_form") != "UNKNOWN") & (F.col("coding_focus") != "UNKNOWN")
    if spec.annotation_status == "KNOWN":
        parts.append(known)
    elif spec.annotation_status == "UNKNOWN":
        parts.append(~known)
        unlabelled = len(parts) == 1
    elif spec.annotation_status is not None:
        parts.append(F.col("status") == spec.annotation_status)
    condition = None
    for p in parts:
        condition = p if condition is None else condition & p
    return condition, unlabelled


def apply(active: DataFrame, spec: FilterSpec, labels: DataFrame | None = None) -> DataFrame:
    """The rows of ``active`` that satisfy all of ``spec``. ``labels`` has at most one row an occurrence."""
    for c in row_conditions(spec):
        active = active.where(c)
    condition, unlabelled = label_condition(spec)
    if condition is None:
        return active
    if labels is None:
        raise ValueError("task conditions need the labels")
    if unlabelled:
        return active.join(labels.where(~condition).select("occurrence_id"), "occurrence_id", "left_anti")
    return active.join(labels.where(condition).select("occurrence_id"), "occurrence_id", "left_semi")
