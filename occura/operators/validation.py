"""Rules over tables: violations as rows, decisions by rule, and the second stage of a relevance check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Document kinds that are left out, and what each action of a plan may be asked of.
EXCLUDED_KINDS = ("COMPILATION", "TUTORIAL", "OTHER", "COLLECTION", "GUIDE")


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, id) of every broken rule and record; empty means valid. Each DataFrame has the ids that break its rule."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(rule).alias("rule"), "id").distinct() for rule, df in rules.items()])


def kind_decision(kind: Column) -> Column:
    """What becomes of a document of a kind; an unknown kind, or none, is for review."""
    return F.when(kind.isin(*EXCLUDED_KINDS), "EXCLUDED").when(kind.isNull() | (kind == "UNKNOWN"), "NEEDS_REVIEW").otherwise("INCLUDED")


def scope_verified(primary: DataFrame, verified: DataFrame) -> DataFrame:
    """(id, decision, relevance_grade, scope_status): the first ranking joined with a second check of its accepted rows.

    ``primary``: id, decision, relevance_grade. ``verified``: id, keep, valid. A row that was not checked keeps its
    decision; an invalid check excludes the row with grade 0; a row that is not kept is rejected for its scope.
    """
    joined = primary.join(verified.withColumn("checked", F.lit(True)), "id", "left")
    status = F.when(F.col("checked").isNull(), "NOT_REQUIRED").when(~F.coalesce("valid", F.lit(False)), "INVALID_SCHEMA").when(F.coalesce("keep", F.lit(False)), "CONFIRMED").otherwise("SCOPE_REJECTED")
    out = joined.withColumn("scope_status", status)
    decision = F.when(F.col("scope_status") == "NOT_REQUIRED", F.col("decision")).when(F.col("scope_status") == "CONFIRMED", "ACCEPTED").otherwise(F.col("scope_status"))
    grade = F.when(F.col("scope_status") == "INVALID_SCHEMA", 0).otherwise(F.col("relevance_grade"))
    return out.select("id", decision.alias("decision"), grade.alias("relevance_grade"), "scope_status")


def verification_status(rows: DataFrame, group: str) -> DataFrame:
    """(group, candidates, invalid, status): COMPLETE, or PARTIAL where some check was invalid."""
    invalid = F.count(F.when(F.col("scope_status") == "INVALID_SCHEMA", 1))
    return rows.groupBy(group).agg(F.count("*").alias("candidates"), invalid.alias("invalid")).withColumn("status", F.when(F.col("invalid") > 0, "PARTIAL").otherwise("COMPLETE"))


def page_audit(rows: DataFrame, group: str, order: list[Column], top: int) -> DataFrame:
    """Adds ``outcome``: an accepted row is RETURNED or falls behind the page (PAGE_CUTOFF); others keep their decision."""
    accepted = F.col("decision") == "ACCEPTED"
    w = Window.partitionBy(group, accepted).orderBy(*order)
    place = F.row_number().over(w)
    return rows.withColumn("outcome", F.when(~accepted, F.col("decision")).when(place <= top, "RETURNED").otherwise("PAGE_CUTOFF"))


def null_safe_equal(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, equal): whether both sides have the key with the same values in every column, nulls equal to nulls."""
    columns = [c for c in left.columns if c != key]
    both = left.withColumn("l", F.lit(True)).alias("a").join(right.withColumn("r", F.lit(True)).alias("b"), key, "full_outer")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns], F.col("l").isNotNull() & F.col("r").isNotNull())
    return both.groupBy(key).agg(F.bool_and(same).alias("equal"))


def disjoint_quotas(rows: DataFrame, ident: str, stratum: str, quotas: list[tuple[str, int]]) -> DataFrame:
    """(stratum, sample, id): samples of fixed sizes in every stratum that share no id, drawn in the order of an id's hash."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.col(ident).cast("binary")), ident))
    sample, upto = F.lit(None).cast("string"), 0
    for name, n in quotas:
        sample = F.when((F.col("place") > upto) & (F.col("place") <= upto + n), name).otherwise(sample)
        upto += n
    return rows.select(stratum, ident).distinct().withColumn("place", place).where(F.col("place") <= upto).select(stratum, sample.alias("sample"), F.col(ident).alias("id"))


def path_values(value: Column, steps: list[str | int]) -> Column:
    """What a path finds in nested arrays and structs: a name, a 0-based place, or '*' for every element of an array.

    A place beyond the end is missing (null); so is a '*' as soon as one element misses what follows it.
    """
    if not steps:
        return value
    head, *rest = steps
    if head == "*":
        each = F.transform(value, lambda x: path_values(x, rest))
        return F.when(~F.exists(each, lambda x: x.isNull()), each)
    return path_values(F.get(value, head) if isinstance(head, int) else value[head], rest)
