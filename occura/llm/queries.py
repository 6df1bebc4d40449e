"""The registered queries of this subpackage; each runs over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occura.llm import canonmap, history, langid, mixing, packing, plainform, tokens, topn, triejoin
from occura.llm.common import broadcast_small, materialize, read, scratch_path, write_table

#: Similarity of two questions that makes them near-duplicates.
QUESTION_SIMILARITY = 0.7


def _free_values(spark: SparkSession, d: str, field: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose raw value the stored normalised value does not settle, and the spellings of the list."""
    raw, normal = f"{field}_raw", f"{field}_normalized"
    name = f"{field}_name"
    ref = read(spark, d, f"{field}_ref")
    rows = read(spark, d, "interview", "id", raw, normal).where(f"{raw} IS NOT NULL").dropDuplicates(["id"])
    settled = broadcast_small(ref.select(F.col(name).alias(normal)).where(f"{normal} IS NOT NULL").distinct())
    names = ["company_name", "english_name"] if field == "company" else ["position_name"]
    return rows.join(settled, normal, "left_anti").select("id", F.col(raw).alias("raw_value")), canonmap.reference_names(ref, "ref_id", names, ["known_aliases"])


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for field, rules in (("company", canonmap.COMPANY), ("position", canonmap.POSITION)):
        rows, names = _free_values(spark, d, field)
        decided = broadcast_small(canonmap.map_values(rows, "raw_value", names, rules))
        one = rows.join(decided.withColumnRenamed("value", "raw_value"), "raw_value").select(F.col("id").alias("interview_id"), F.lit(field).alias("field_name"), "raw_value", "ref_id", "score")
        out = one if out is None else out.unionByName(one)
    return out


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("interview_id", "field_name", "ref_id")


def p1_unmatched_report(spark: SparkSession, d: str) -> DataFrame:
    """Values no entry is meant by, with the number of interviews that carry them."""
    return _mapped(spark, d).where(F.col("ref_id") == canonmap.UNMATCHED).groupBy("field_name", "raw_value").agg(F.count("*").alias("interviews"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "source_revision", "id", "batch_no", "raw_file_hash").select(F.lit("source_revision").alias("kind"), "id", "batch_no", history.normal_hash("raw_file_hash").alias("key"), F.lit(True).alias("exact"))
    texts = plainform.with_plain_form(read(spark, d, "canonical", "id", "batch_no", "canonical_text"), "canonical_text", key="key")
    texts = texts.select(F.lit("canonical").alias("kind"), "id", "batch_no", "key", F.lit(False).alias("exact"))
    found = history.repeats_by_batch(spark, files.unionByName(texts), scratch_path(spark, "history"), QUESTION_SIMILARITY)
    return found.select(F.col("kind").alias("table_name"), F.least("id", "match_id").alias("id_a"), F.greatest("id", "match_id").alias("id_b"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for table, column in (("interview", "company_raw"), ("canonical", "canonical_text")):
        one = plainform.changed_rows(read(spark, d, table, "id", column), "id", column).select(F.lit(table).alias("table_name"), "row_id")
        out = one if out is None else out.unionByName(one)
    return out


def p3_plain_values(spark: SparkSession, d: str) -> DataFrame:
    """The changed values beside their plain form."""
    return plainform.changed_rows(read(spark, d, "interview", "id", "company_raw"), "id", "company_raw").unionByName(plainform.changed_rows(read(spark, d, "canonical", "id", "canonical_text"), "id", "canonical_text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    # Rows delivered twice pass on: a heap counts an identifier once.
    asked = read(spark, d, "occurrence", "interview_id", "canonical_question_id").where("interview_id IS NOT NULL AND canonical_question_id IS NOT NULL")
    at = read(spark, d, "interview", "id", "company_normalized").where("company_normalized IS NOT NULL")
    pairs = asked.join(at, asked.interview_id == at.id).select("company_normalized", "canonical_question_id")
    score = read(spark, d, "canonical", "id", "occurrence_count").groupBy("id").agg(F.max("occurrence_count").alias("occurrence_count"))
    scored = pairs.join(score, pairs.canonical_question_id == score.id).select("company_normalized", "canonical_question_id", "occurrence_count")
    return topn.top_n_per_group(scored, "company_normalized", "occurrence_count", "canonical_question_id", 5).select("company_normalized", "rank_no", "canonical_question_id")


def _question_keys(spark: SparkSession, d: str) -> DataFrame:
    return plainform.with_plain_form(read(spark, d, "canonical", "id", "canonical_text"), "canonical_text", key="key")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return triejoin.similar_pairs(_question_keys(spark, d), "id", "key", QUESTION_SIMILARITY).select("id_a", "id_b")


def p5_question_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row a question: its class of equal texts and the number of similar other texts."""
    return triejoin.similarity_classes(_question_keys(spark, d), "id", "key", QUESTION_SIMILARITY)


def _counted(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Documents with their number of tokens, computed once."""
    return materialize(tokens.with_token_count(read(spark, d, "documents", *columns, "text"), "text", "n_tokens"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Where every piece of every document lies, for each capacity."""
    return packing.pack(_counted(spark, d, "doc_id"), "doc_id", "n_tokens", read(spark, d, "pack_capacity"))


def p6_fill_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers and the share of their room that is used, for each capacity."""
    capacities = read(spark, d, "pack_capacity")
    return packing.fill_report(packing.pack(_counted(spark, d, "doc_id"), "doc_id", "n_tokens", capacities), capacities)


def _mix_input(spark: SparkSession, d: str) -> DataFrame:
    """The tree's levels: whether a document came as a file or from a site, the language that its text has, its source."""
    documents = read(spark, d, "documents", "doc_id", "source", "source_document_id", "text", "lang")
    spoken = langid.document_languages(documents, "doc_id", "text", "lang", langid.fit(documents, "doc_id", "text", "lang")).select("doc_id", "lang")
    counted = tokens.with_token_count(documents.drop("lang"), "text", "n_tokens")
    kinds = read(spark, d, "source_document", "id", "source_type").groupBy(F.col("id").alias("source_document_id")).agg(F.when(F.max("source_type") == "file", "file").otherwise("site").alias("domain"))
    rows = counted.join(spoken, "doc_id", "left").join(kinds, "source_document_id", "left").select("doc_id", "domain", "lang", "source", "n_tokens")
    return write_table(rows, scratch_path(spark, "mix"))


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery of a document in the mix."""
    return mixing.mix(_mix_input(spark, d), read(spark, d, "mix_target"))


def p7_share_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    documents, targets = _mix_input(spark, d), read(spark, d, "mix_target")
    return mixing.share_report(mixing.mix(documents, targets), documents, targets)


def _languages(spark: SparkSession, d: str) -> DataFrame:
    documents = read(spark, d, "documents", "doc_id", "text", "lang")
    return langid.segment_languages(documents, "doc_id", "text", "lang", langid.fit(documents, "doc_id", "text", "lang"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).where("doubtful").select("doc_id", "para_no", "lang")


def p8_paragraph_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every paragraph's languages with confidence, and the document's main language."""
    return _languages(spark, d).select("doc_id", "para_no", "lang", F.round("confidence", 4).alias("confidence"), "main")


def p8_document_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document's main language with confidence."""
    documents = read(spark, d, "documents", "doc_id", "text", "lang")
    out = langid.document_languages(documents, "doc_id", "text", "lang", langid.fit(documents, "doc_id", "text", "lang"))
    return out.withColumn("confidence", F.round("confidence", 4))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_unmatched_report, p2_found, p3_found, p3_plain_values, p4_found, p5_found, p5_question_classes,
            p6_packed, p6_fill_report, p7_mixed, p7_share_report, p8_found, p8_paragraph_languages, p8_document_languages,
        )
    }
