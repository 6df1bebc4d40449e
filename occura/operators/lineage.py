"""Sources, revisions, builds and identities: upserts, manifests, redirects, votes, publication, quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from occura import shared


def source_upsert(sources: DataFrame) -> DataFrame:
    """One row an identity: (source_identity, source_id, paths), paths being every distinct alias and path, sorted."""
    paths = sources.select("source_identity", "id", F.explode(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("original_relative_path"))).alias("path"))
    return paths.groupBy("source_identity").agg(F.min("id").alias("source_id"), F.array_join(F.array_sort(F.collect_set("path")), "|").alias("paths"))


def manifest(sources: DataFrame) -> DataFrame:
    """(source_identity, active_build_id) of everything published."""
    return sources.where("active_build_id IS NOT NULL").select("source_identity", "active_build_id").distinct()


def pending_builds(wanted: DataFrame, built: DataFrame) -> DataFrame:
    """Wanted (revision_id, fingerprint) pairs that no ready build has."""
    return wanted.join(built.where("processing_state = 'READY'").select("revision_id", "fingerprint").distinct(), ["revision_id", "fingerprint"], "left_anti")


def redirects(canonical: DataFrame) -> DataFrame:
    """(id, target_id, hops): where every redirect ends, however long its chain; both null where it never ends.

    Each round joins the redirects with themselves and so doubles the steps: a chain of n takes log n rounds. What still
    moves after as many steps as there are redirects runs in a circle. A row with several targets takes the smallest.
    """
    edge = canonical.where("id IS NOT NULL AND redirect_to_id IS NOT NULL").groupBy("id").agg(F.min("redirect_to_id").alias("target_id")).withColumn("hops", F.lit(1).cast("long"))
    out, steps = shared.written(edge, "redirects"), 1
    most = out.count()
    while True:
        on = out.select(F.col("id").alias("target_id"), F.col("target_id").alias("further"), F.col("hops").alias("more"))
        moved = out.join(on, "target_id", "left")
        if steps > most or not moved.where("further IS NOT NULL").limit(1).count():
            ends = F.col("further").isNull()
            return moved.select("id", F.when(ends, F.col("target_id")).alias("target_id"), F.when(ends, F.col("hops")).alias("hops"))
        out = shared.written(moved.select("id", F.coalesce("further", "target_id").alias("target_id"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "redirects")
        steps *= 2


def majority_label(occurrences: DataFrame, incumbent: DataFrame) -> DataFrame:
    """(canonical_question_id, topic_id, question_type, votes): the joint label most occurrences have.

    A tie goes to the label the question already has, then to the smallest label.
    """
    votes = occurrences.groupBy("canonical_question_id", "topic_id", "question_type").agg(F.count("*").alias("votes"))
    now = incumbent.select(F.col("id").alias("canonical_question_id"), F.col("primary_topic_id").alias("t"), F.col("question_type").alias("q"))
    held = votes.join(now, "canonical_question_id", "left").withColumn("held", F.coalesce((F.col("topic_id") == F.col("t")) & (F.col("question_type") == F.col("q")), F.lit(False)))
    w = Window.partitionBy("canonical_question_id").orderBy(F.desc("votes"), F.desc("held"), "topic_id", "question_type")
    return held.withColumn("place", F.row_number().over(w)).where("place = 1").select("canonical_question_id", "topic_id", "question_type", "votes")


def assignment_asof(assignments: DataFrame, revision: int) -> DataFrame:
    """Assignments valid at ``revision``: valid_from <= revision < valid_to, an open end being valid for ever."""
    return assignments.where((F.col("valid_from") <= revision) & (F.col("valid_to").isNull() | (F.col("valid_to") > revision)))


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one record has."""
    return df.groupBy(*key).agg(F.count("*").alias("records")).where("records > 1")


def search_documents(canonical: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(canonical_question_id, field, value): what the search index knows of each question, one row a value.

    Its own text, and every distinct wording, topic and type it was asked with. Values stay rows, as one question may
    have a tenth of all wordings; the index takes them in field by field.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in (("variant", "normalized_question"), ("topic", "topic_id"), ("type", "question_type"))])).alias("p")
    asked = occurrences.select("canonical_question_id", pairs).select("canonical_question_id", "p.*").where("value IS NOT NULL").distinct()
    own = canonical.select(F.col("id").alias("canonical_question_id"), F.lit("text").alias("field"), F.col("canonical_text").alias("value"))
    return own.unionByName(asked.join(canonical.select(F.col("id").alias("canonical_question_id")), "canonical_question_id", "left_semi"))


def table_digest(df: DataFrame, ident: str) -> DataFrame:
    """(rows, digest): an order-free fingerprint of a table's ids, computed with partial aggregation."""
    part = F.conv(F.substring(F.md5(F.col(ident).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.bit_xor(part).alias("digest"))


def head_and_delta(current: DataFrame, indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``current`` whose (id, text_hash) is indexed as it stands, and all others."""
    key = ["id", "text_hash"]
    return current.join(indexed.select(*key), key, "left_semi"), current.join(indexed.select(*key), key, "left_anti")


def resolve(judged: DataFrame) -> DataFrame:
    """(incoming_id, decision, canonical_question_id, related): merge into the only SAME candidate, else a new identity.

    Several SAME candidates need review and give a new identity too.
    """
    same = F.col("judgement") == "SAME"
    per = judged.groupBy("incoming_id").agg(F.count(F.when(same, 1)).alias("n"), F.min(F.when(same, F.col("candidate_id"))).alias("only"), F.count(F.when(F.col("judgement") == "RELATED", 1)).alias("related"))
    return per.select("incoming_id", F.when(F.col("n") == 1, "MERGE").when(F.col("n") > 1, "REVIEW").otherwise("NEW").alias("decision"), F.when(F.col("n") == 1, F.col("only")).alias("canonical_question_id"), "related")


def guarded(judged: DataFrame, checks: list[str]) -> DataFrame:
    """SAME stands only if every check holds; else it is RELATED with a confidence of at most one half."""
    ok = F.lit(True)
    for c in checks:
        ok = ok & F.coalesce(F.col(c), F.lit(False))
    fails = (F.col("judgement") == "SAME") & ~ok
    return judged.withColumn("confidence", F.when(fails, F.least(F.lit(0.5), "confidence")).otherwise(F.col("confidence"))).withColumn("judgement", F.when(fails, "RELATED").otherwise(F.col("judgement")))
