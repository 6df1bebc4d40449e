"""Registered queries: lineage, identities, de-duplication, quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occura import corpus
from occura.corpus import ACTIVE_SQL
from occura.functions.text import normal_hash
from occura.operators import lineage as L
from occura.operators.retrieval import cosine_top_k
from occura.registry import Registry

register = Registry()
_WITH = f"WITH {ACTIVE_SQL}"

register(
    "source_upsert",
    """WITH s AS (SELECT DISTINCT id, source_identity, aliases, original_relative_path FROM source_document),
    p AS (SELECT source_identity, id, unnest(list_distinct(list_concat(coalesce(aliases, []), [original_relative_path]))) AS path FROM s)
    SELECT source_identity, min(id) AS source_id, array_to_string(list_sort(list_distinct(list(path))), '|') AS paths FROM p GROUP BY 1""",
)(lambda spark, d: L.source_upsert(corpus.records(spark, d, "source_document", "id", "source_identity", "aliases", "original_relative_path")))
register("manifest_at_revision", "SELECT DISTINCT source_identity, active_build_id FROM source_document WHERE active_build_id IS NOT NULL")(lambda spark, d: L.manifest(corpus.scan(spark, d, "source_document", "source_identity", "active_build_id")))
register(
    "pending_builds",
    """SELECT DISTINCT r.id AS revision_id, f.processing_fingerprint AS fingerprint FROM (SELECT DISTINCT id FROM source_revision) r, (SELECT max(processing_fingerprint) AS processing_fingerprint FROM document_build) f
    WHERE NOT EXISTS (SELECT 1 FROM document_build b WHERE b.source_revision_id = r.id AND b.processing_fingerprint = f.processing_fingerprint AND b.processing_state = 'READY')""",
)(
    lambda spark, d: L.pending_builds(
        corpus.records(spark, d, "source_revision", "id").select(F.col("id").alias("revision_id")).join(F.broadcast(corpus.scan(spark, d, "document_build", "processing_fingerprint").agg(F.max("processing_fingerprint").alias("fingerprint")))),
        corpus.scan(spark, d, "document_build", "source_revision_id", "processing_fingerprint", "processing_state").toDF("revision_id", "fingerprint", "processing_state"),
    )
)
register(
    "redirect_resolve",
    """WITH RECURSIVE e AS (SELECT DISTINCT id, redirect_to_id FROM canonical WHERE redirect_to_id IS NOT NULL),
    c(id, target_id, hops) AS (SELECT id, redirect_to_id, 1 FROM e UNION ALL SELECT c.id, e.redirect_to_id, hops + 1 FROM c JOIN e ON c.target_id = e.id)
    SELECT id, target_id, hops FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY hops DESC) = 1""",
)(lambda spark, d: L.redirects(corpus.scan(spark, d, "canonical", "id", "redirect_to_id")))
register(
    "canonical_majority_vote",
    f"""{_WITH}, v AS (SELECT canonical_question_id, topic_id, question_type, count(*) AS votes FROM active GROUP BY ALL),
    n AS (SELECT DISTINCT id, primary_topic_id, question_type FROM canonical)
    SELECT canonical_question_id, topic_id, v.question_type, votes FROM v LEFT JOIN n ON n.id = v.canonical_question_id
    QUALIFY row_number() OVER (PARTITION BY canonical_question_id ORDER BY votes DESC, coalesce(topic_id = primary_topic_id AND v.question_type = n.question_type, false) DESC, topic_id, v.question_type) = 1""",
)(lambda spark, d: L.majority_label(corpus.active_occurrences(spark, d, need=("topic_id", "question_type")), corpus.records(spark, d, "canonical", "id", "primary_topic_id", "question_type")))
_ASSIGNED = """WITH o AS (SELECT DISTINCT id, canonical_question_id, substr(md5(id), 5, 1) AS n FROM occurrence WHERE canonical_question_id IS NOT NULL),
a AS (SELECT id AS occurrence_id, canonical_question_id, 'AUTO' AS decision, 1 AS valid_from, CASE WHEN n < '8' THEN 5 END AS valid_to FROM o
  UNION ALL SELECT id, canonical_question_id, 'REVIEWED', 5, NULL FROM o WHERE n < '8')"""


def _assignments(spark: SparkSession, d: str) -> DataFrame:
    """Assignments with a validity interval: half were reviewed at revision 5."""
    o = corpus.records(spark, d, "occurrence", "id", "canonical_question_id").where("canonical_question_id IS NOT NULL").withColumnRenamed("id", "occurrence_id")
    early = corpus.nibble("occurrence_id", 5) < "8"
    first = o.withColumn("decision", F.lit("AUTO")).withColumn("valid_from", F.lit(1)).withColumn("valid_to", F.when(early, 5))
    return first.unionByName(o.where(early).withColumn("decision", F.lit("REVIEWED")).withColumn("valid_from", F.lit(5)).withColumn("valid_to", F.lit(None).cast("int")))


for _r in (4, 6):
    register(f"assignment_asof_{_r}", f"{_ASSIGNED} SELECT occurrence_id, canonical_question_id, decision FROM a WHERE valid_from <= {_r} AND (valid_to IS NULL OR valid_to > {_r})")(
        lambda spark, d, r=_r: L.assignment_asof(_assignments(spark, d), r).select("occurrence_id", "canonical_question_id", "decision")
    )
register("current_assignment_unique", f"{_ASSIGNED} SELECT count(*) AS current_rows, count(DISTINCT occurrence_id) AS occurrences FROM a WHERE valid_to IS NULL")(
    lambda spark, d: _assignments(spark, d).where("valid_to IS NULL").agg(F.count("*").alias("current_rows"), F.countDistinct("occurrence_id").alias("occurrences"))
)
register("search_documents", """WITH c AS (SELECT DISTINCT id, canonical_text FROM canonical), o AS (SELECT canonical_question_id AS id, normalized_question, topic_id, question_type FROM occurrence WHERE canonical_question_id IN (SELECT id FROM c))
    SELECT id AS canonical_question_id, 'text' AS field, canonical_text AS value FROM c UNION ALL SELECT DISTINCT id, 'variant', normalized_question FROM o WHERE normalized_question IS NOT NULL
    UNION ALL SELECT DISTINCT id, 'topic', topic_id FROM o WHERE topic_id IS NOT NULL UNION ALL SELECT DISTINCT id, 'type', question_type FROM o WHERE question_type IS NOT NULL""")(
    lambda spark, d: L.search_documents(
        corpus.records(spark, d, "canonical", "id", "canonical_text"),
        corpus.scan(spark, d, "occurrence", "canonical_question_id", "normalized_question", "topic_id", "question_type").where("canonical_question_id IS NOT NULL"),
    )
)
register("corpus_status", f"""{_WITH} SELECT (SELECT count(DISTINCT id) FROM source_document) AS sources, (SELECT count(DISTINCT id) FROM source_revision) AS revisions, (SELECT count(DISTINCT interview_id) FROM active) AS interviews,
    count(*) AS occurrences, count(DISTINCT canonical_question_id) AS canonical_questions, round(1 - CAST(count(DISTINCT canonical_question_id) AS DOUBLE) / nullif(count(*), 0), 6) AS dedup_ratio FROM active""")(lambda spark, d: _status(spark, d))


def _status(spark: SparkSession, d: str) -> DataFrame:
    n = lambda t: corpus.scan(spark, d, t, "id").agg(F.countDistinct("id").alias(t))
    active = corpus.active_occurrences(spark, d, need=()).agg(F.countDistinct("interview_id").alias("interviews"), F.count("*").alias("occurrences"), F.countDistinct("canonical_question_id").alias("canonical_questions"))
    ratio = F.round(1 - F.try_divide("canonical_questions", "occurrences"), 6).alias("dedup_ratio")
    return active.crossJoin(n("source_document")).crossJoin(n("source_revision")).select(F.col("source_document").alias("sources"), F.col("source_revision").alias("revisions"), "interviews", "occurrences", "canonical_questions", ratio)


_DIGESTED = ("source_document", "source_revision", "document_build", "interview", "canonical", "occurrence")
register("snapshot_digest", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows, bit_xor(CAST('0x' || substr(md5(id), 1, 15) AS BIGINT)) AS digest FROM (SELECT DISTINCT id FROM {t})" for t in _DIGESTED))(lambda spark, d: _digests(spark, d))


def _digests(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in _DIGESTED:
        one = L.table_digest(corpus.records(spark, d, t, "id"), "id").select(F.lit(t).alias("table_name"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


# The same 64 digits however spelled; what is no hash counts as written.
register("files_under_several_documents", """SELECT CASE WHEN regexp_full_match(h, '[0-9a-f]{64}') THEN h ELSE lower(raw_file_hash) END AS file_hash, count(DISTINCT source_document_id) AS documents, min(id) AS first_revision
    FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(raw_file_hash), '^\\s*(sha-?256|0x)[:=\\s-]*', ''), '[\\s:_-]+', '', 'g'), '^0x', '') AS h FROM source_revision WHERE raw_file_hash IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT source_document_id) > 1""")(
    lambda spark, d: corpus.scan(spark, d, "source_revision", "id", "source_document_id", "raw_file_hash").where("raw_file_hash IS NOT NULL")
    .groupBy(F.coalesce(normal_hash("raw_file_hash"), F.lower("raw_file_hash")).alias("file_hash")).agg(F.countDistinct("source_document_id").alias("documents"), F.min("id").alias("first_revision")).where("documents > 1")
)
register("quality_repeated_rows", " UNION ALL ".join(f"SELECT '{t}' AS table_name, id, count(*) AS records FROM {t} GROUP BY id HAVING count(*) > 1" for t in ("interview", "canonical", "occurrence", "source_revision")))(lambda spark, d: _repeated(spark, d))


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in ("interview", "canonical", "occurrence", "source_revision"):
        one = L.duplicate_keys(corpus.scan(spark, d, t, "id"), "id").select(F.lit(t).alias("table_name"), "id", "records")
        out = one if out is None else out.unionByName(one)
    return out


register("quality_confidence_range", "SELECT DISTINCT id FROM occurrence WHERE confidence < 0.5 OR confidence > 1")(lambda spark, d: corpus.records(spark, d, "occurrence", "id", "confidence").where("confidence < 0.5D OR confidence > 1D").select("id"))
register(
    "span_containment",
    """SELECT id, bool_and(contains(raw_question, s.quote)) AS grounded, bool_and(s.start_char < s.end_char AND s.start_line <= s.end_line) AS ordered, count(DISTINCT s.revision_id) AS revisions,
      min(s.start_char) AS first_char, max(s.end_char) AS last_char FROM (SELECT DISTINCT id, raw_question, source_spans FROM occurrence), unnest(source_spans) AS t(s) GROUP BY 1""",
)(
    lambda spark, d: corpus.records(spark, d, "occurrence", "id", "raw_question", "source_spans").where(F.size("source_spans") > 0).select(
        "id", F.forall("source_spans", lambda s: F.col("raw_question").contains(s.quote)).alias("grounded"), F.forall("source_spans", lambda s: (s.start_char < s.end_char) & (s.start_line <= s.end_line)).alias("ordered"),
        F.size(F.array_distinct(F.transform("source_spans", lambda s: s.revision_id))).cast("long").alias("revisions"),
        F.array_min(F.transform("source_spans", lambda s: s.start_char)).alias("first_char"), F.array_max(F.transform("source_spans", lambda s: s.end_char)).alias("last_char"),
    )
)
register("spans_joined_equal", "SELECT id, array_to_string(list_transform(source_spans, lambda s: s.quote), chr(10)) = raw_question AS equal FROM (SELECT DISTINCT id, raw_question, source_spans FROM occurrence)")(
    lambda spark, d: corpus.records(spark, d, "occurrence", "id", "raw_question", "source_spans").select("id", (F.array_join(F.transform("source_spans", lambda s: s.quote), "\n") == F.col("raw_question")).alias("equal"))
)
register("exact_hash_duplicates", "SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")(
    lambda spark, d: corpus.scan(spark, d, "documents", "doc_id", "text").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")
)
register(
    "head_delta_split",
    """WITH c AS (SELECT DISTINCT id, batch_no, sha256(CASE WHEN substr(md5(id), 6, 1) = '0' THEN canonical_text || '!' ELSE canonical_text END) AS now_hash, sha256(canonical_text) AS old_hash FROM canonical)
    SELECT id, CASE WHEN batch_no <= 4 AND now_hash = old_hash THEN 'HEAD' ELSE 'DELTA' END AS part FROM c""",
)(lambda spark, d: _head_delta(spark, d))


def _head_delta(spark: SparkSession, d: str) -> DataFrame:
    """The index knows batches 1 to 4; one question in sixteen was reworded since."""
    c = corpus.records(spark, d, "canonical", "id", "batch_no", "canonical_text")
    indexed = c.where("batch_no <= 4").select("id", F.sha2("canonical_text", 256).alias("text_hash"))
    now = c.select("id", F.sha2(F.when(corpus.nibble("id", 6) == "0", F.concat("canonical_text", F.lit("!"))).otherwise(F.col("canonical_text")), 256).alias("text_hash"))
    head, delta = L.head_and_delta(now, indexed)
    return head.select("id", F.lit("HEAD").alias("part")).unionByName(delta.select("id", F.lit("DELTA").alias("part")))


_TOP10 = """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""
register("dedup_candidates_top10", f"{_TOP10} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10")(lambda spark, d: _candidates(spark, d))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    vectors = corpus.scan(spark, d, "embeddings", "vec_id", "embedding")
    return cosine_top_k(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", 10)


_JUDGED = "CASE WHEN rank = 1 AND score > 0.2 OR rank = 2 AND score > 0.35 THEN 'SAME' WHEN score > 0.15 THEN 'RELATED' ELSE 'DIFFERENT' END"
register("dedup_resolve", f"""{_TOP10}, j AS (SELECT query_id, vec_id, {_JUDGED} AS judgement FROM r WHERE rank <= 10)
    SELECT query_id AS incoming_id, CASE count(*) FILTER (judgement = 'SAME') WHEN 1 THEN 'MERGE' WHEN 0 THEN 'NEW' ELSE 'REVIEW' END AS decision,
      CASE WHEN count(*) FILTER (judgement = 'SAME') = 1 THEN min(vec_id) FILTER (judgement = 'SAME') END AS canonical_question_id, count(*) FILTER (judgement = 'RELATED') AS related FROM j GROUP BY 1""")(
    lambda spark, d: L.resolve(_candidates(spark, d).select(F.col("query_id").alias("incoming_id"), F.col("vec_id").alias("candidate_id"), F.expr(_JUDGED).alias("judgement")))
)
register("equivalence_guard", f"""{_TOP10}, j AS (SELECT query_id, vec_id, score, {_JUDGED} AS judgement, query_id % 3 <> 0 AS a, vec_id % 5 <> 0 AS b FROM r WHERE rank <= 10)
    SELECT query_id, vec_id, CASE WHEN judgement = 'SAME' AND NOT (a AND b) THEN 'RELATED' ELSE judgement END AS judgement, CASE WHEN judgement = 'SAME' AND NOT (a AND b) THEN least(0.5, score) ELSE score END AS confidence FROM j""")(
    lambda spark, d: L.guarded(_candidates(spark, d).select("query_id", "vec_id", F.col("score").alias("confidence"), F.expr(_JUDGED).alias("judgement"), F.expr("query_id % 3 <> 0 AS a"), F.expr("vec_id % 5 <> 0 AS b")), ["a", "b"]).drop("a", "b")
)
