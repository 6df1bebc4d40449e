"""Registered queries: dataset rules, scoring of samples, result assembly, keyed lookups and batch regrouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from occura import corpus
from occura.corpus import ACTIVE_SQL, ANNOTATION_SQL, STATE_SQL
from occura.functions.text import digest
from occura.operators import evaluation as E
from occura.operators import retrieval as R
from occura.queries.retrieval import _RANKS, _rankings, _ranked_sql, _rrf_sql, _text_ranking
from occura.registry import Registry
from occura.shared import written

register = Registry()
_WITH = f"WITH {ACTIVE_SQL}"

# ---------------------------------------------------------------- dataset rules

_RULES = {
    "retired_or_redirected_with_count": ("canonical", "lifecycle <> 'ACTIVE' AND occurrence_count > 0"),
    "redirect_without_target": ("canonical", "lifecycle = 'REDIRECTED' AND redirect_to_id IS NULL"),
    "redirect_to_itself": ("canonical", "redirect_to_id = id"),
    "short_text": ("canonical", "length(canonical_text) < 20"),
    "dates_reversed": ("interview", "publish_date < interview_date"),
    "no_company": ("interview", "company_raw IS NULL AND company_normalized IS NULL"),
    "unidentified": ("occurrence", "canonical_question_id IS NULL"),
    "no_evidence": ("occurrence", None),
}


@register("dataset_violations", " UNION ALL ".join(f"SELECT DISTINCT '{rule}' AS rule, id FROM {t} WHERE {c or 'len(source_spans) = 0'}" for rule, (t, c) in _RULES.items()))
def dataset_violations(spark: SparkSession, d: str) -> DataFrame:
    """One row per broken rule and record; empty means valid."""
    out = None
    for rule, (table, condition) in _RULES.items():
        hit = corpus.scan(spark, d, table).where(condition or F.size("source_spans") == 0).select(F.lit(rule).alias("rule"), "id").distinct()
        out = hit if out is None else out.unionByName(hit)
    return out


@register("orphans", """SELECT 'occurrence' AS child, count(*) AS orphans FROM (SELECT DISTINCT id, interview_id FROM occurrence) o WHERE NOT EXISTS (SELECT 1 FROM interview i WHERE i.id = o.interview_id)
    UNION ALL SELECT 'interview', count(*) FROM (SELECT DISTINCT id, build_id FROM interview) i WHERE NOT EXISTS (SELECT 1 FROM document_build b WHERE b.id = i.build_id)
    UNION ALL SELECT 'document', count(*) FROM documents x WHERE source_document_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM source_document s WHERE s.id = x.source_document_id)""")  # fmt: skip
def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Children whose parent is missing, by anti joins."""
    out = None
    for child, ident, key, parent, name in (("occurrence", "id", "interview_id", "interview", "occurrence"), ("interview", "id", "build_id", "document_build", "interview"), ("documents", "doc_id", "source_document_id", "source_document", "document")):
        rows = corpus.records(spark, d, child, ident, key).where(F.col(key).isNotNull())
        lost = rows.join(corpus.scan(spark, d, parent, "id").select(F.col("id").alias(key)).distinct(), key, "left_anti")
        one = lost.agg(F.count("*").alias("orphans")).select(F.lit(name).alias("child"), "orphans")
        out = one if out is None else out.unionByName(one)
    return out


@register("two_way_cover", """SELECT (SELECT count(*) FROM (SELECT DISTINCT id FROM canonical) c WHERE NOT EXISTS (SELECT 1 FROM occurrence o WHERE o.canonical_question_id = c.id)) AS never_asked,
    (SELECT count(DISTINCT canonical_question_id) FROM occurrence o WHERE canonical_question_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM canonical c WHERE c.id = o.canonical_question_id)) AS unknown_ids""")  # fmt: skip
def two_way_cover(spark: SparkSession, d: str) -> DataFrame:
    c = corpus.scan(spark, d, "canonical", "id").distinct()
    o = corpus.scan(spark, d, "occurrence", "canonical_question_id").where("canonical_question_id IS NOT NULL").distinct().toDF("id")
    return c.join(o, "id", "left_anti").agg(F.count("*").alias("never_asked")).crossJoin(o.join(c, "id", "left_anti").agg(F.count("*").alias("unknown_ids")))


@register("mapping_consistency", """WITH o AS (SELECT DISTINCT normalized_question, canonical_question_id FROM occurrence WHERE canonical_question_id IS NOT NULL)
    SELECT normalized_question, count(*) AS identities, min(canonical_question_id) AS first_id FROM o GROUP BY 1 HAVING count(*) > 1""")  # fmt: skip
def mapping_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Wordings that lead to more than one identity."""
    o = corpus.scan(spark, d, "occurrence", "normalized_question", "canonical_question_id").where("canonical_question_id IS NOT NULL").distinct()
    return o.groupBy("normalized_question").agg(F.count("*").alias("identities"), F.min("canonical_question_id").alias("first_id")).where("identities > 1")


@register("stale_counters", """WITH n AS (SELECT canonical_question_id AS id, count(DISTINCT id) AS counted FROM occurrence WHERE canonical_question_id IS NOT NULL GROUP BY 1)
    SELECT c.id, occurrence_count AS stored, coalesce(counted, 0) AS counted FROM (SELECT DISTINCT id, occurrence_count FROM canonical) c LEFT JOIN n USING (id) WHERE occurrence_count IS DISTINCT FROM coalesce(counted, 0)""")  # fmt: skip
def stale_counters(spark: SparkSession, d: str) -> DataFrame:
    """Stored counters that differ from the records, null-safe."""
    n = corpus.records(spark, d, "occurrence", "id", "canonical_question_id").where("canonical_question_id IS NOT NULL").groupBy(F.col("canonical_question_id").alias("id")).agg(F.count("*").alias("counted"))
    c = corpus.records(spark, d, "canonical", "id", "occurrence_count").join(n, "id", "left").withColumn("counted", F.coalesce("counted", F.lit(0).cast("long")))
    return c.where(~F.col("occurrence_count").eqNullSafe(F.col("counted"))).select("id", F.col("occurrence_count").alias("stored"), "counted")


# ---------------------------------------------------------------- scoring

_LABELS2 = "n2 AS (SELECT id AS occurrence_id, CASE WHEN substr(md5(id), 10, 1) < '2' THEN 'UNKNOWN' WHEN substr(md5(id), 10, 1) < '4' THEN 'VERBAL' ELSE g.response_form END AS predicted, g.response_form AS gold FROM (SELECT DISTINCT id FROM occurrence) o JOIN annotation g ON g.occurrence_id = o.id)"


@register("label_scoring", f"""WITH {ANNOTATION_SQL}, {_LABELS2} SELECT count(*) AS samples, round(CAST(count(*) FILTER (predicted <> 'UNKNOWN') AS DOUBLE) / count(*), 6) AS coverage, round(CAST(count(*) FILTER (predicted = gold) AS DOUBLE) / count(*), 6) AS accuracy,
    round(CAST(count(*) FILTER (predicted <> 'UNKNOWN' AND predicted = gold) AS DOUBLE) / nullif(count(*) FILTER (predicted <> 'UNKNOWN'), 0), 6) AS covered_accuracy FROM n2""")  # fmt: skip
def label_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy over all samples, and over those the predictor did not leave UNKNOWN."""
    n = corpus.nibble("occurrence_id", 10)
    s = corpus.annotations(spark, d).select(F.col("response_form").alias("gold"), F.when(n < "2", "UNKNOWN").when(n < "4", "VERBAL").otherwise(F.col("response_form")).alias("predicted"))
    covered, right, c = F.col("predicted") != "UNKNOWN", F.col("predicted") == F.col("gold"), lambda x: F.count(F.when(x, 1))
    return s.agg(F.count("*").alias("samples"), E.ratio(c(covered), F.count("*")).alias("coverage"), E.ratio(c(right), F.count("*")).alias("accuracy"), E.ratio(c(covered & right), c(covered)).alias("covered_accuracy"))


_SPAN2 = """s AS (SELECT DISTINCT id, source_spans[1].revision_id AS doc_id, source_spans[1].start_char AS a, source_spans[1].end_char AS b, normalized_question AS text, substr(md5(id), 11, 1) AS n FROM occurrence WHERE len(source_spans) > 0),
j AS (SELECT g.doc_id, g.id FROM s g JOIN (SELECT * FROM s WHERE n >= '3') p ON g.doc_id = p.doc_id AND g.text = p.text AND g.a < p.b AND p.a < g.b AND g.n < 'e' QUALIFY count(*) OVER (PARTITION BY g.id) = 1 AND count(*) OVER (PARTITION BY p.id) = 1),
per AS (SELECT s.doc_id, count(*) FILTER (n < 'e') AS gold, count(*) FILTER (n >= '3') AS predicted, count(j.id) AS tp FROM s LEFT JOIN j ON j.id = s.id GROUP BY 1)"""


@register("extraction_scoring", f"""WITH {_SPAN2} SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(predicted - tp) AS BIGINT) AS fp, CAST(sum(gold - tp) AS BIGINT) AS fn, round(CAST(2 * sum(tp) AS DOUBLE) / nullif(sum(gold) + sum(predicted), 0), 6) AS micro_f1,
    round(avg(coalesce(2 * tp / CAST(nullif(gold + predicted, 0) AS DOUBLE), 0)), 6) AS document_macro_f1 FROM per""")  # fmt: skip
def extraction_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Spans found against spans wanted: micro over all, macro over documents. A digest of the id decides which side has a span."""
    n = corpus.nibble("id", 11)
    s = E.spans_of(corpus.records(spark, d, "occurrence", "id", "normalized_question", "source_spans"))
    s = s.select(F.struct("id", "position").alias("id"), F.col("span.revision_id").alias("doc_id"), F.col("span.start_char").alias("start"), F.col("span.end_char").alias("end"), F.col("normalized_question").alias("text"), (n < "e").alias("in_gold"), (n >= "3").alias("found"))
    side = s.select("id", "doc_id", "start", "end", "text", "in_gold", "found")
    hits = E.aligned(side.where("in_gold").drop("in_gold", "found"), side.where("found").drop("in_gold", "found")).select(F.col("gold_id").alias("id"), F.lit(1).alias("hit"))
    per = s.join(hits, "id", "left").groupBy("doc_id").agg(F.count(F.when(F.col("in_gold"), 1)).alias("gold"), F.count(F.when(F.col("found"), 1)).alias("predicted"), F.count("hit").alias("tp"))
    tp, g, p = F.sum("tp"), F.sum("gold"), F.sum("predicted")
    macro = F.round(F.avg(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("gold") + F.col("predicted")), F.lit(0.0))), 6)
    return per.agg(tp.alias("tp"), (p - tp).alias("fp"), (g - tp).alias("fn"), E.ratio(2 * tp, g + p).alias("micro_f1"), macro.alias("document_macro_f1"))


@register("micro_macro_precision", f"""{_RANKS}, m AS (SELECT DISTINCT id, primary_topic_id AS topic FROM canonical), p AS (SELECT query_id, count(*) AS returned, count(*) FILTER (a.topic = b.topic) AS relevant FROM t JOIN m a ON a.id = query_id JOIN m b ON b.id = doc_id WHERE rank <= 10 GROUP BY 1)
    SELECT round(CAST(sum(relevant) AS DOUBLE) / sum(returned), 6) AS micro, round(avg(CAST(relevant AS DOUBLE) / returned), 6) AS macro, count(*) AS queries FROM p""")  # fmt: skip
def micro_macro_precision(spark: SparkSession, d: str) -> DataFrame:
    """Precision weighted by returned rows, and averaged over queries that returned any."""
    m = corpus.records(spark, d, "canonical", "id", "primary_topic_id")
    got = _text_ranking(spark, d, 10)[1].join(m.toDF("query_id", "qt"), "query_id").join(m.toDF("doc_id", "dt"), "doc_id")
    per = got.groupBy("query_id").agg(F.count("*").alias("returned"), F.count(F.when(F.col("qt") == F.col("dt"), 1)).alias("relevant"))
    return per.agg(E.ratio(F.sum("relevant"), F.sum("returned")).alias("micro"), F.round(F.avg(F.try_divide(F.col("relevant").cast("double"), "returned")), 6).alias("macro"), F.count("*").alias("queries"))


@register("routing_metrics", """WITH u AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS viewed, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicked, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS wrote FROM events GROUP BY user_id, CAST(ts AS DATE))
    SELECT count(*) AS evaluated, round(avg(CAST(viewed = 1 AND clicked = 1 AND NOT (wrote = 1 AND user_id % 2 = 0) AS INTEGER)), 6) AS tool_selection_accuracy, CAST(sum(CAST(wrote = 1 AND user_id % 2 = 0 AS INTEGER)) AS BIGINT) AS unauthorized_writes FROM u""")  # fmt: skip
def routing_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A user's events of a day are the tools used: view and click are required, sign-up is a write that even users may not do."""
    u = corpus.scan(spark, d, "events", "user_id", "event_type", "ts").groupBy("user_id", F.to_date("ts")).agg(F.collect_set("event_type").alias("used"))
    bad = F.array_contains("used", "signup") & (F.col("user_id") % 2 == 0)
    right = (F.size(F.array_except(F.array(F.lit("view"), F.lit("click")), "used")) == 0) & ~bad
    return u.agg(F.count("*").alias("evaluated"), F.round(F.avg(right.cast("int")), 6).alias("tool_selection_accuracy"), F.sum(bad.cast("int")).alias("unauthorized_writes"))


@register("ordered_trajectories", """WITH v AS (SELECT user_id, min(event_id) AS a FROM events WHERE event_type = 'view' GROUP BY 1), c AS (SELECT e.user_id, min(event_id) AS b FROM events e JOIN v ON e.user_id = v.user_id AND event_id > a WHERE event_type = 'click' GROUP BY 1),
    p AS (SELECT e.user_id, min(event_id) AS x FROM events e JOIN c ON e.user_id = c.user_id AND event_id > b WHERE event_type = 'purchase' GROUP BY 1) SELECT v.user_id, a AS viewed, b AS clicked, x AS bought FROM v LEFT JOIN c USING (user_id) LEFT JOIN p USING (user_id)""")  # fmt: skip
def ordered_trajectories(spark: SparkSession, d: str) -> DataFrame:
    """The earliest view, then click, then purchase of each user: an ordered subsequence without gathering a user's events."""
    e = corpus.scan(spark, d, "events", "event_id", "user_id", "event_type")
    step = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("viewed"))
    for kind, before, name in (("click", "viewed", "clicked"), ("purchase", "clicked", "bought")):
        after = e.where(F.col("event_type") == kind).join(step.select("user_id", before), "user_id").where(F.col("event_id") > F.col(before)).groupBy("user_id").agg(F.min("event_id").alias(name))
        step = step.join(after, "user_id", "left")
    return step


@register("minimum_confidence", "SELECT interview_id, min(confidence) AS least, count(*) FILTER (confidence IS NULL) AS missing FROM (SELECT DISTINCT id, interview_id, confidence FROM occurrence) GROUP BY 1")
def minimum_confidence(spark: SparkSession, d: str) -> DataFrame:
    return corpus.records(spark, d, "occurrence", "id", "interview_id", "confidence").groupBy("interview_id").agg(F.min("confidence").alias("least"), F.count(F.when(F.col("confidence").isNull(), 1)).alias("missing"))


@register("confidence_backfill", """WITH o AS (SELECT DISTINCT id, interview_id, question_type, confidence, contains(raw_question, normalized_question) AS grounded FROM occurrence), b AS (SELECT interview_id, bool_and(coalesce(grounded, false)) AS whole FROM o GROUP BY 1)
    SELECT id, CASE WHEN NOT whole THEN 'REJECTED' WHEN coalesce(confidence, 0) < 0.7 THEN 'UNKNOWN' ELSE question_type END AS label FROM o JOIN b USING (interview_id)""")  # fmt: skip
def confidence_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Labels below the confidence limit become UNKNOWN; one ungrounded label rejects its whole batch (interview)."""
    o = corpus.records(spark, d, "occurrence", "id", "interview_id", "question_type", "confidence", "raw_question", "normalized_question")
    o = o.withColumn("grounded", F.coalesce(F.col("raw_question").contains(F.col("normalized_question")), F.lit(False)))
    batch = o.groupBy("interview_id").agg(F.bool_and("grounded").alias("whole"))
    label = F.when(~F.col("whole"), "REJECTED").when(F.coalesce("confidence", F.lit(0.0)) < 0.7, "UNKNOWN").otherwise(F.col("question_type"))
    return o.join(batch, "interview_id").select("id", label.alias("label"))


# ---------------------------------------------------------------- lookups and assembly


@register("state_with_defaults", f"WITH {STATE_SQL} SELECT c.id AS canonical_question_id, coalesce(user_status, 'UNSEEN') AS user_status, user_status IS NOT NULL AS stored FROM (SELECT DISTINCT id FROM canonical) c LEFT JOIN user_state u ON u.canonical_question_id = c.id")
def state_with_defaults(spark: SparkSession, d: str) -> DataFrame:
    ids = corpus.records(spark, d, "canonical", "id").toDF("canonical_question_id")
    return ids.join(corpus.user_states(spark, d), "canonical_question_id", "left").select("canonical_question_id", F.coalesce("user_status", F.lit("UNSEEN")).alias("user_status"), F.col("user_status").isNotNull().alias("stored"))


@register("topic_lookup", "SELECT topic_id, split_part(topic_id, '.', 1) AS topic_l1, split_part(topic_id, '.', 2) AS topic_l2, count(DISTINCT id) AS questions FROM (SELECT DISTINCT id, primary_topic_id AS topic_id FROM canonical) WHERE topic_id IN (SELECT topic_id FROM occurrence) GROUP BY ALL")
def topic_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = corpus.records(spark, d, "canonical", "id", "primary_topic_id").withColumnRenamed("primary_topic_id", "topic_id")
    return c.join(corpus.topics(spark, d), "topic_id").groupBy("topic_id", "topic_l1", "topic_l2").agg(F.count("*").alias("questions"))


_NEWEST = "SELECT DISTINCT id, created_at FROM interview ORDER BY created_at DESC, id DESC"


@register("newest_page2", f"SELECT id FROM ({_NEWEST}) LIMIT 20 OFFSET 20")
def newest_page2(spark: SparkSession, d: str) -> DataFrame:
    """Keyset by (created_at, id), both descending; one row more than a page says whether another follows."""
    rows = corpus.records(spark, d, "interview", "id", "created_at").where("created_at IS NOT NULL")
    order = [F.desc("created_at"), F.desc("id")]
    first = rows.orderBy(*order).limit(20).agg(F.min(F.struct("created_at", "id")).alias("last"), F.count("*").alias("n"))
    after = (F.col("created_at") < F.col("last.created_at")) | ((F.col("created_at") == F.col("last.created_at")) & (F.col("id") < F.col("last.id")))
    return rows.join(F.broadcast(first)).where((F.col("n") == 20) & after).orderBy(*order).limit(20).select("id")


@register("ascending_id_page", "SELECT id FROM (SELECT DISTINCT id FROM canonical) WHERE id > '8' ORDER BY id LIMIT 25")
def ascending_id_page(spark: SparkSession, d: str) -> DataFrame:
    return corpus.scan(spark, d, "canonical", "id").where("id > '8'").distinct().orderBy("id").limit(25)


@register("newest_task_per_source", """SELECT source_revision_id, id, processing_state FROM (SELECT DISTINCT id, source_revision_id, processing_state FROM document_build) QUALIFY row_number() OVER (PARTITION BY source_revision_id ORDER BY id DESC) = 1""")
def newest_task_per_source(spark: SparkSession, d: str) -> DataFrame:
    return corpus.scan(spark, d, "document_build", "id", "source_revision_id", "processing_state").groupBy("source_revision_id").agg(F.max(F.struct("id", "processing_state")).alias("b")).select("source_revision_id", "b.id", "b.processing_state")


@register("retry_set", """SELECT DISTINCT source_revision_id FROM document_build b WHERE processing_state = 'FAILED' AND NOT EXISTS (SELECT 1 FROM document_build r WHERE r.source_revision_id = b.source_revision_id AND r.processing_state = 'READY')""")
def retry_set(spark: SparkSession, d: str) -> DataFrame:
    """Revisions that failed and have no ready build."""
    b = corpus.scan(spark, d, "document_build", "source_revision_id", "processing_state")
    return b.where("processing_state = 'FAILED'").join(b.where("processing_state = 'READY'").select("source_revision_id"), "source_revision_id", "left_anti").select("source_revision_id").distinct()


@register("batches_of_ten", "SELECT id, interview_id, (row_number() OVER (PARTITION BY interview_id ORDER BY question_order, id) - 1) // 10 AS block FROM (SELECT DISTINCT id, interview_id, question_order FROM occurrence)")
def batches_of_ten(spark: SparkSession, d: str) -> DataFrame:
    """Questions of an interview in blocks of ten, the unit of a second attempt."""
    w = Window.partitionBy("interview_id").orderBy("question_order", "id")
    o = corpus.records(spark, d, "occurrence", "id", "interview_id", "question_order")
    return o.select("id", "interview_id", F.floor((F.row_number().over(w) - 1) / 10).alias("block"))


@register("result_assembly", f"""{_RANKS}, h AS (SELECT query_id, doc_id, rank FROM {_ranked_sql(_rrf_sql(1, 1), 3)}), {ACTIVE_SQL.replace('active AS', 'active_c AS')},
    f AS (SELECT canonical_question_id, count(*) AS occurrences, count(DISTINCT company_normalized) AS companies, min(source_id) AS first_source FROM active_c GROUP BY 1)
    SELECT query_id, doc_id, rank, c.canonical_text, coalesce(occurrences, 0) AS occurrences, coalesce(companies, 0) AS companies, first_source FROM h JOIN (SELECT DISTINCT id, canonical_text FROM canonical) c ON c.id = doc_id LEFT JOIN f ON f.canonical_question_id = doc_id""")  # fmt: skip
def result_assembly(spark: SparkSession, d: str) -> DataFrame:
    """The three best hits of every query with their text and facts; facts are computed for hits only."""
    hits = written(R.top_k(R.fuse([(r, 1.0) for r in _rankings(spark, d)]), 3).select("query_id", "doc_id", "rank"), "hits")
    wanted = hits.select(F.col("doc_id").alias("canonical_question_id")).distinct()
    facts = corpus.active_occurrences(spark, d, need=("company_normalized",)).join(wanted, "canonical_question_id", "left_semi").groupBy(F.col("canonical_question_id").alias("doc_id")).agg(
        F.count("*").alias("occurrences"), F.countDistinct("company_normalized").alias("companies"), F.min("source_id").alias("first_source")
    )
    zero = F.lit(0).cast("long")
    return hits.join(corpus.records(spark, d, "canonical", "id", "canonical_text").withColumnRenamed("id", "doc_id"), "doc_id").join(facts, "doc_id", "left").select(
        "query_id", "doc_id", "rank", "canonical_text", F.coalesce("occurrences", zero).alias("occurrences"), F.coalesce("companies", zero).alias("companies"), "first_source"
    )


@register("candidate_payload", f"{_WITH} SELECT canonical_question_id, 'c' || (place - 1) AS alias, left(coalesce(canonical_text, ''), 500) AS clipped FROM (SELECT a.canonical_question_id, c.canonical_text, row_number() OVER (PARTITION BY a.interview_id ORDER BY a.occurrence_id) AS place FROM active a JOIN (SELECT DISTINCT id, canonical_text FROM canonical) c ON c.id = a.canonical_question_id)")
def candidate_payload(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of an interview under short names, their canonical text clipped at 500 characters."""
    w = Window.partitionBy("interview_id").orderBy("occurrence_id")
    text = corpus.records(spark, d, "canonical", "id", "canonical_text").withColumnRenamed("id", "canonical_question_id")
    a = corpus.active_occurrences(spark, d, with_canonical=False, need=()).select("occurrence_id", "interview_id", "canonical_question_id").join(text, "canonical_question_id")
    clipped = F.left(F.coalesce("canonical_text", F.lit("")), F.lit(500))
    return a.select("canonical_question_id", F.concat(F.lit("c"), F.row_number().over(w) - 1).alias("alias"), clipped.alias("clipped"))


@register("span_lines_of_texts", """SELECT doc_id, strpos(text, '二面') AS at, CASE WHEN strpos(text, '二面') > 0 THEN array_to_string(list_slice(string_split(substr(text, 1, strpos(text, '二面') - 1), chr(10)), -4, -1), chr(10)) END AS before FROM documents""")
def span_lines_of_texts(spark: SparkSession, d: str) -> DataFrame:
    """The last four lines before the first mention of a phrase: bounded context in front of a span."""
    t = corpus.scan(spark, d, "documents", "doc_id", "text").withColumn("at", F.instr("text", "二面"))
    lines = F.split(F.expr("substring(text, 1, at - 1)"), "\n")
    last = F.array_join(F.when(F.size(lines) > 4, F.slice(lines, -4, 4)).otherwise(lines), "\n")
    return t.select("doc_id", F.col("at").cast("long").alias("at"), F.when(F.col("at") > 0, last).alias("before"))


@register("resume_points", """SELECT user_id, count(*) FILTER (event_type <> 'error') AS completed, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'purchase') AS last_write, max(event_id) FILTER (event_type = 'error') AS last_failure FROM events GROUP BY 1""")
def resume_points(spark: SparkSession, d: str) -> DataFrame:
    e = corpus.scan(spark, d, "events", "event_id", "user_id", "event_type", "ts")
    bought = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    return e.groupBy("user_id").agg(F.count(F.when(F.col("event_type") != "error", 1)).alias("completed"), F.max_by("event_id", bought).alias("last_write"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("last_failure"))


@register("set_operations", """SELECT 'both' AS part, count(*) AS topics FROM (SELECT topic_id FROM occurrence INTERSECT SELECT primary_topic_id FROM canonical) UNION ALL SELECT 'only_asked', count(*) FROM (SELECT topic_id FROM occurrence EXCEPT SELECT primary_topic_id FROM canonical)
    UNION ALL SELECT 'any', count(*) FROM (SELECT topic_id FROM occurrence UNION SELECT primary_topic_id FROM canonical)""")  # fmt: skip
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a, b = corpus.scan(spark, d, "occurrence", "topic_id"), corpus.scan(spark, d, "canonical", "primary_topic_id").toDF("topic_id")
    out = None
    for part, df in (("both", a.intersect(b)), ("only_asked", a.subtract(b)), ("any", a.union(b).distinct())):
        one = df.agg(F.count("*").alias("topics")).select(F.lit(part).alias("part"), "topics")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- grounding, nesting, incremental reading

_QUOTED = "s AS (SELECT id, raw_question, source_spans[1].quote AS quote FROM (SELECT DISTINCT id, raw_question, source_spans FROM occurrence) WHERE len(source_spans) > 0)"


@register("quote_grounding", f"""WITH {_QUOTED} SELECT id, CASE WHEN quote = '' OR n = 0 THEN 'MISSING' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'FOUND' END AS outcome, CASE WHEN quote <> '' AND n = 1 THEN strpos(raw_question, quote) - 1 END AS start_char
    FROM (SELECT *, CASE WHEN quote = '' THEN 0 ELSE len(string_split(raw_question, quote)) - 1 END AS n FROM s)""")  # fmt: skip
def quote_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Where each span's quote lies in its question, a row a span; one that occurs twice is ambiguous, one that is not there is missing."""
    o = E.spans_of(corpus.records(spark, d, "occurrence", "id", "raw_question", "source_spans"))
    s = o.select("id", "raw_question", F.col("span.quote").alias("quote"))
    shorter = F.length("raw_question") - F.length(F.replace("raw_question", "quote", F.lit("")))
    n = F.when(F.col("quote") == "", 0).otherwise(F.floor(shorter / F.length("quote")))
    outcome = F.when(n == 0, "MISSING").when(n > 1, "AMBIGUOUS").otherwise("FOUND")
    return s.select("id", outcome.alias("outcome"), F.when(n == 1, F.expr("locate(quote, raw_question)") - 1).cast("long").alias("start_char"))


@register("nested_round_trip", """WITH o AS (SELECT DISTINCT id, interview_id, question_type, question_order FROM occurrence), n AS (SELECT interview_id, list({'id': id, 'kind': question_type, 'place': question_order} ORDER BY question_order, id) AS questions FROM o GROUP BY 1)
    SELECT interview_id, len(questions) AS questions, questions[1].id AS first_id, list_aggregate(list_transform(questions, lambda q: q.place), 'max') AS last_place FROM n""")  # fmt: skip
def nested_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Questions nested in their interview in order, the form in which an extraction arrives (an interview has few)."""
    o = corpus.records(spark, d, "occurrence", "id", "interview_id", "question_type", "question_order")
    n = o.groupBy("interview_id").agg(F.array_sort(F.collect_list(F.struct("question_order", "id", "question_type"))).alias("questions"))
    return n.select("interview_id", F.size("questions").cast("long").alias("questions"), F.col("questions")[0]["id"].alias("first_id"), F.array_max(F.transform("questions", lambda q: q["question_order"])).alias("last_place"))


@register("event_tail", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200")
def event_tail(spark: SparkSession, d: str) -> DataFrame:
    """What a reader gets that has seen everything up to sequence 500: at most 200 events."""
    return corpus.scan(spark, d, "events", "event_id", "user_id", "event_type").where("event_id > 500").orderBy("event_id").limit(200)


@register("last_eight_per_user", """SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS recent FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 8) GROUP BY 1""")
def last_eight_per_user(spark: SparkSession, d: str) -> DataFrame:
    """The last eight events of each user in order; cut before they are gathered."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = corpus.scan(spark, d, "events", "user_id", "ts", "event_id", "event_type").withColumn("n", F.row_number().over(w)).where("n <= 8")
    recent = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return e.groupBy("user_id").agg(F.array_join(recent, ",").alias("recent"))


@register("snapshot_deltas", """WITH s AS (SELECT id, question_order, interview_id, normalized_question AS now, lag(normalized_question) OVER (PARTITION BY interview_id ORDER BY question_order, id) AS before FROM (SELECT DISTINCT id, question_order, interview_id, normalized_question FROM occurrence))
    SELECT id, CASE WHEN before IS NULL THEN now WHEN starts_with(now, before) THEN substr(now, length(before) + 1) ELSE now END AS delta, before IS NOT NULL AND NOT starts_with(now, before) AS restarted FROM s""")  # fmt: skip
def snapshot_deltas(spark: SparkSession, d: str) -> DataFrame:
    """What each snapshot adds to the one before it; a snapshot that does not continue it starts over."""
    w = Window.partitionBy("interview_id").orderBy("question_order", "id")
    o = corpus.records(spark, d, "occurrence", "id", "question_order", "interview_id", "normalized_question")
    s = o.withColumn("before", F.lag("normalized_question").over(w))
    goes_on = F.startswith("normalized_question", "before")
    rest = F.expr("substring(normalized_question, length(before) + 1)")
    return s.select("id", F.when(F.col("before").isNotNull() & goes_on, rest).otherwise(F.col("normalized_question")).alias("delta"), (F.col("before").isNotNull() & ~goes_on).alias("restarted"))


_POOLS = f"{_RANKS}, u AS (SELECT query_id, doc_id, rank AS text_rank, NULL AS variant_rank FROM t WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, NULL, rank FROM w WHERE rank <= 10)"


@register("judging_pool", f"{_POOLS} SELECT query_id, doc_id, min(text_rank) AS text_rank, min(variant_rank) AS variant_rank FROM u GROUP BY ALL")
def judging_pool(spark: SparkSession, d: str) -> DataFrame:
    """The union of several pipelines' best ten, with each one's rank: what a judge has to see once."""
    none = F.lit(None).cast("long")
    text, variants = _rankings(spark, d, 10)
    a = text.select("query_id", "doc_id", F.col("rank").alias("text_rank"), none.alias("variant_rank"))
    b = variants.select("query_id", "doc_id", none.alias("text_rank"), F.col("rank").alias("variant_rank"))
    return a.unionByName(b).groupBy("query_id", "doc_id").agg(F.min("text_rank").alias("text_rank"), F.min("variant_rank").alias("variant_rank"))


@register("recall_by_family", f"""{_RANKS}, m AS (SELECT DISTINCT id, primary_topic_id AS topic FROM canonical), g AS (SELECT a.id AS query_id, b.id AS doc_id, a.topic FROM (SELECT DISTINCT query_id FROM q) x JOIN m a ON a.id = x.query_id JOIN m b ON b.topic = a.topic AND b.id <> a.id WHERE a.topic NOT IN ('misc.unsorted', 'talk.hr'))
    SELECT topic, count(*) AS relevant, count(t.doc_id) AS found, round(CAST(count(t.doc_id) AS DOUBLE) / count(*), 6) AS recall FROM g LEFT JOIN t ON t.query_id = g.query_id AND t.doc_id = g.doc_id GROUP BY 1""")  # fmt: skip
def recall_by_family(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 50 of each topic family."""
    q, ranking = _text_ranking(spark, d)
    m = corpus.records(spark, d, "canonical", "id", "primary_topic_id").where("primary_topic_id NOT IN ('misc.unsorted', 'talk.hr')")
    return E.recall_of_groups(ranking, m.toDF("id", "topic"), "topic", q.select("query_id"))


@register("document_inventory", """WITH b AS (SELECT DISTINCT b.id, r.source_document_id, b.processing_state, b.decision, b.publication_state FROM document_build b JOIN (SELECT DISTINCT id, source_document_id FROM source_revision) r ON r.id = b.source_revision_id)
    SELECT s.id, count(b.id) AS builds, count(*) FILTER (b.processing_state = 'FAILED') AS failed, CASE WHEN max(s.active_build_id) IS NOT NULL THEN 'PUBLISHED' WHEN count(*) FILTER (b.processing_state = 'STAGING') > 0 THEN 'RUNNING' WHEN count(*) FILTER (b.processing_state = 'FAILED') > 0 THEN 'FAILED'
      WHEN count(b.id) > 0 THEN 'BUILT' ELSE 'PENDING' END AS status FROM (SELECT DISTINCT id, active_build_id FROM source_document) s LEFT JOIN b ON b.source_document_id = s.id GROUP BY 1""")  # fmt: skip
def document_inventory(spark: SparkSession, d: str) -> DataFrame:
    """One row a source document with its builds and the first status that applies."""
    revision = corpus.records(spark, d, "source_revision", "id", "source_document_id").select(F.col("id").alias("source_revision_id"), "source_document_id")
    build = corpus.records(spark, d, "document_build", "id", "source_revision_id", "processing_state").withColumnRenamed("id", "build_id").join(revision, "source_revision_id")
    source = corpus.records(spark, d, "source_document", "id", "active_build_id")
    n = lambda s: F.count(F.when(F.col("processing_state") == s, 1))
    status = F.when(F.max("active_build_id").isNotNull(), "PUBLISHED").when(n("STAGING") > 0, "RUNNING").when(n("FAILED") > 0, "FAILED").when(F.count("build_id") > 0, "BUILT").otherwise("PENDING")
    return source.join(build.drop("source_revision_id"), source.id == build.source_document_id, "left").groupBy("id").agg(F.count("build_id").alias("builds"), n("FAILED").alias("failed"), status.alias("status"))


@register("revision_fingerprints", "SELECT id, sha256(source_document_id || chr(31) || raw_file_hash || chr(31) || raw_file_path) AS fingerprint FROM (SELECT DISTINCT id, source_document_id, raw_file_hash, raw_file_path FROM source_revision) WHERE raw_file_hash IS NOT NULL")
def revision_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """A content fingerprint per revision, which a reviewed draft must still match when it is published."""
    r = corpus.records(spark, d, "source_revision", "id", "source_document_id", "raw_file_hash", "raw_file_path").where("raw_file_hash IS NOT NULL")
    return r.select("id", digest(F.col("source_document_id"), F.col("raw_file_hash"), F.col("raw_file_path")).alias("fingerprint"))


@register("question_memory", """SELECT company_normalized, id, created_at FROM (SELECT DISTINCT id, company_normalized, created_at FROM interview WHERE company_normalized IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY company_normalized ORDER BY created_at DESC, id) <= 3""")
def question_memory(spark: SparkSession, d: str) -> DataFrame:
    """At most the three newest records of each key."""
    w = Window.partitionBy("company_normalized").orderBy(F.desc("created_at"), "id")
    i = corpus.records(spark, d, "interview", "id", "company_normalized", "created_at").where("company_normalized IS NOT NULL")
    return i.withColumn("n", F.row_number().over(w)).where("n <= 3").select("company_normalized", "id", "created_at")


@register("verified_overrides", """WITH o AS (SELECT DISTINCT id, question_type, confidence FROM occurrence), v AS (SELECT id, CASE WHEN substr(md5(id), 12, 1) < '4' THEN NULL ELSE substr(md5(id), 13, 1) < '8' END AS keep FROM o WHERE substr(md5(id), 14, 1) < 'c')
    SELECT o.id, CASE WHEN v.id IS NULL THEN 'UNVERIFIED' WHEN keep IS NULL THEN 'INVALID' WHEN keep THEN 'KEPT' ELSE 'DROPPED' END AS outcome, CASE WHEN coalesce(keep, true) THEN confidence ELSE 0 END AS confidence FROM o LEFT JOIN v ON v.id = o.id""")  # fmt: skip
def verified_overrides(spark: SparkSession, d: str) -> DataFrame:
    """A second judgement laid over a first ranking: a valid rejection overrides it, an invalid or missing one does not."""
    o = corpus.records(spark, d, "occurrence", "id", "question_type", "confidence")
    keep = F.when(corpus.nibble("id", 12) < "4", None).otherwise(corpus.nibble("id", 13) < "8")
    v = o.where(corpus.nibble("id", 14) < "c").select("id", keep.alias("keep"), F.lit(True).alias("judged"))
    j = o.join(v, "id", "left")
    outcome = F.when(F.col("judged").isNull(), "UNVERIFIED").when(F.col("keep").isNull(), "INVALID").when(F.col("keep"), "KEPT").otherwise("DROPPED")
    return j.select("id", outcome.alias("outcome"), F.when(F.coalesce("keep", F.lit(True)), F.col("confidence")).otherwise(0.0).alias("confidence"))
