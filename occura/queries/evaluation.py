"""Registered queries: quality metrics. Gold and predicted labels come from the corpus: the question's own type is
gold, the occurrence's type is the prediction; questions of the same topic are relevant to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occura import corpus
from occura.operators import evaluation as E
from occura.queries.retrieval import _INDEX, _TEXT, _text_ranking
from occura.registry import Registry
from occura.shared import written

register = Registry()
_PAIRS = "p AS (SELECT o.id, c.question_type AS gold, o.question_type AS predicted FROM (SELECT DISTINCT id, canonical_question_id, question_type FROM occurrence) o JOIN (SELECT DISTINCT id, question_type FROM canonical) c ON o.canonical_question_id = c.id)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    o = corpus.records(spark, d, "occurrence", "id", "canonical_question_id", "question_type").withColumnRenamed("question_type", "predicted")
    c = corpus.records(spark, d, "canonical", "id", "question_type").select(F.col("id").alias("canonical_question_id"), F.col("question_type").alias("gold"))
    return o.join(c, "canonical_question_id").select("id", "gold", "predicted")


_PER = f"""{_PAIRS}, l AS (SELECT DISTINCT gold AS label FROM p), x AS (SELECT label, count(*) FILTER (gold = label AND predicted = label) AS tp, count(*) FILTER (gold <> label AND predicted = label) AS fp,
  count(*) FILTER (gold = label AND predicted <> label) AS fn FROM l, p GROUP BY 1), pc AS (SELECT label, tp, fp, fn, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall,
  round(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM x)"""
register("confusion_matrix", f"WITH {_PAIRS} SELECT gold, predicted, count(*) AS samples FROM p GROUP BY ALL")(lambda spark, d: E.confusion(_pairs(spark, d)))
register("prf_per_class", f"WITH {_PER} SELECT * FROM pc")(lambda spark, d: E.per_class(_pairs(spark, d)))
register("macro_f1", f"WITH {_PER} SELECT (SELECT round(CAST(count(*) FILTER (gold = predicted) AS DOUBLE) / count(*), 6) FROM p) AS accuracy, (SELECT count(*) FROM p) AS samples, (SELECT round(avg(coalesce(f1, 0)), 6) FROM pc) AS macro_f1")(
    lambda spark, d: E.macro(_pairs(spark, d))
)

_FAILED = "substr(md5(query_id), 1, 1) = '0'"
_EVAL = f"""WITH {_INDEX}, t AS {_TEXT}, m AS (SELECT DISTINCT id, primary_topic_id AS topic, question_type AS kind FROM canonical),
qs AS (SELECT DISTINCT query_id, {_FAILED} AS failed FROM q),
gold AS (SELECT a.id AS query_id, b.id AS doc_id, CASE WHEN a.kind = b.kind THEN 2 ELSE 1 END AS grade FROM qs JOIN m a ON a.id = qs.query_id JOIN m b ON a.topic = b.topic AND a.id <> b.id AND b.topic <> 'misc.unsorted' AND b.topic <> 'talk.hr'),
rel AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN i <= 10 THEN (2 ** grade - 1) / log2(i + 1) END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS i FROM gold) GROUP BY 1),
val AS (SELECT t.* FROM t JOIN qs USING (query_id) WHERE NOT failed AND rank <= 50),
h AS (SELECT query_id, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN (2 ** grade - 1) / log2(rank + 1) END) AS dcg FROM val JOIN gold USING (query_id, doc_id) GROUP BY 1),
per AS (SELECT query_id, failed, relevant IS NULL AS negative, CASE WHEN relevant IS NOT NULL THEN round(coalesce(h5, 0) / CAST(relevant AS DOUBLE), 6) END AS recall_5, CASE WHEN relevant IS NOT NULL THEN round(coalesce(h10, 0) / CAST(relevant AS DOUBLE), 6) END AS recall_10,
  CASE WHEN relevant IS NOT NULL THEN round(coalesce(h10, 0) / CAST(10 AS DOUBLE), 6) END AS precision_10, CASE WHEN relevant IS NOT NULL THEN round(coalesce(1 / CAST(first AS DOUBLE), 0), 6) END AS mrr,
  CASE WHEN relevant IS NOT NULL THEN round(coalesce(dcg, 0) / ideal, 6) END AS ndcg_10, CASE WHEN relevant IS NOT NULL THEN round(least(10, relevant) / CAST(relevant AS DOUBLE), 6) END AS recall_10_bound,
  CASE WHEN relevant IS NULL THEN CAST(NOT failed AND NOT EXISTS (SELECT 1 FROM val WHERE val.query_id = qs.query_id) AS INTEGER) END AS negative_correct
  FROM qs LEFT JOIN rel USING (query_id) LEFT JOIN h USING (query_id))"""


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    q, ranking = _text_ranking(spark, d)
    queries = q.select("query_id").withColumn("failed", corpus.nibble("query_id", 1) == "0")
    m = corpus.records(spark, d, "canonical", "id", "primary_topic_id", "question_type").toDF("id", "topic", "kind").where("topic NOT IN ('misc.unsorted', 'talk.hr')")
    judged = written(ranking.where("rank <= 50").select("query_id", "doc_id", "rank"), "ranking")  # a search lists a document once
    return E.retrieval_of_groups(judged, m, "topic", queries, once=True)


register("ir_metrics", f"{_EVAL} SELECT * FROM per")(_evaluated)
_IR = ("recall_5", "recall_10", "precision_10", "mrr", "ndcg_10", "recall_10_bound")
register("ir_metrics_macro", f"{_EVAL} SELECT {', '.join(f'round(avg({c}), 5) AS {c}' for c in _IR)}, count(*) FILTER (NOT negative) AS evaluated, count(*) FILTER (negative) AS negatives, count(*) FILTER (failed) AS failed FROM per")(
    lambda spark, d: _evaluated(spark, d).agg(*[F.round(F.avg(c), 5).alias(c) for c in _IR], F.count(F.when(~F.col("negative"), 1)).alias("evaluated"), F.count(F.when(F.col("negative"), 1)).alias("negatives"), F.count(F.when(F.col("failed"), 1)).alias("failed"))
)
register("efficiency_percentiles", "SELECT event_type, count(*) AS samples, quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.95) AS p95_ms, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens_known FROM events GROUP BY 1")(
    lambda spark, d: corpus.scan(spark, d, "events", "event_type", "value", "props").groupBy("event_type").agg(
        F.count("*").alias("samples"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95_ms"),
        F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens_known"),
    )
)
register(
    "rubric_assertions",
    """SELECT id, len(language_tags) > 0 AS not_empty, list_contains(language_tags, 'Java') AS has_java, len(list_distinct(language_tags)) = len(language_tags) AS unique_tags, session_order <= 2 AS early,
      abs(date_diff('day', interview_date, publish_date)) <= 7 AS published_soon, company_raw = company_normalized AS passed_through FROM (SELECT DISTINCT id, language_tags, session_order, interview_date, publish_date, company_raw, company_normalized FROM interview)""",
)(lambda spark, d: _rubric(spark, d))


def _rubric(spark: SparkSession, d: str) -> DataFrame:
    i = corpus.records(spark, d, "interview", "id", "language_tags", "session_order", "interview_date", "publish_date", "company_raw", "company_normalized")
    tags, days = F.col("language_tags"), F.date_diff("publish_date", "interview_date")
    return i.select(
        "id", E.assertion("not_empty", tags, tags).alias("not_empty"), E.assertion("contains", tags, F.lit("Java")).alias("has_java"), E.assertion("unique", tags, tags).alias("unique_tags"),
        E.assertion("lte", F.col("session_order"), F.lit(2)).alias("early"), E.assertion("approx", days, F.lit(0), 7).alias("published_soon"), E.assertion("eq", F.col("company_raw"), F.col("company_normalized")).alias("passed_through"),
    )


_THRESHOLDS = (("precision", 0.5, "min"), ("recall", 0.99, "min"), ("fp", 1e9, "max"), ("latency", 1.0, "max"))
_METRICS = f"{_PER}, m(metric, value) AS (SELECT 'precision', avg(precision) FROM pc UNION ALL SELECT 'recall', avg(recall) FROM pc UNION ALL SELECT 'fp', CAST(sum(fp) AS DOUBLE) FROM pc), th(metric, threshold, direction) AS (VALUES {', '.join(f'({n!r}, CAST({v} AS DOUBLE), {x!r})' for n, v, x in _THRESHOLDS)})"


def _metrics(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = E.per_class(_pairs(spark, d)).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.sum("fp").cast("double").alias("fp"))
    long = s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("precision", "recall", "fp")])).alias("m")).select("m.*")
    return long, spark.createDataFrame(list(_THRESHOLDS), "metric string, threshold double, direction string")


_CHECK = "CASE WHEN value IS NULL THEN 'NOT_RUN' WHEN direction = 'min' AND value >= threshold OR direction = 'max' AND value <= threshold THEN 'PASSED' ELSE 'BELOW_GATE' END"
register("gate_checks", f"WITH {_METRICS} SELECT metric, round(value, 6) AS value, threshold, direction, {_CHECK} AS status FROM th LEFT JOIN m USING (metric)")(lambda spark, d: E.gates(*_metrics(spark, d)).withColumn("value", F.round("value", 6)))
register("gate_status", f"WITH {_METRICS} SELECT CASE WHEN count(*) FILTER (s = 'NOT_RUN') > 0 THEN 'NOT_RUN' WHEN count(*) FILTER (s = 'BELOW_GATE') > 0 THEN 'BELOW_GATE' ELSE 'PASSED' END AS status, count(*) AS checks FROM (SELECT {_CHECK} AS s FROM th LEFT JOIN m USING (metric))")(
    lambda spark, d: E.gate_status(E.gates(*_metrics(spark, d)))
)
register(
    "regression_diff",
    """WITH a AS (SELECT topic_id AS key, CAST(count(*) AS DOUBLE) AS value FROM (SELECT DISTINCT id, topic_id, taxonomy_version FROM occurrence) WHERE taxonomy_version = 'v0' GROUP BY 1), b AS (SELECT topic_id AS key, CAST(count(*) AS DOUBLE) AS value FROM (SELECT DISTINCT id, topic_id, taxonomy_version FROM occurrence) WHERE taxonomy_version = 'v1' GROUP BY 1)
    SELECT key, a.value AS before, b.value AS after, round(b.value - a.value, 6) AS delta, CASE WHEN a.value IS NULL THEN 'ADDED' WHEN b.value IS NULL THEN 'REMOVED' WHEN b.value > a.value THEN 'UP' WHEN b.value < a.value THEN 'DOWN' ELSE 'SAME' END AS change FROM a FULL JOIN b USING (key)""",
)(lambda spark, d: _diff(spark, d))


def _diff(spark: SparkSession, d: str) -> DataFrame:
    o = corpus.records(spark, d, "occurrence", "id", "topic_id", "taxonomy_version")
    side = lambda v: o.where(F.col("taxonomy_version") == v).groupBy(F.col("topic_id").alias("key")).agg(F.count("*").cast("double").alias("value"))
    return E.compare_runs(side("v0"), side("v1"))


register("split_leakage", "SELECT text_hash AS group_id, count(DISTINCT split) AS splits, count(*) AS samples FROM (SELECT sha256(text) AS text_hash, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM documents) GROUP BY 1 HAVING count(DISTINCT split) > 1")(
    lambda spark, d: E.leaks(corpus.scan(spark, d, "documents", "doc_id", "text").select(F.sha2("text", 256).alias("group_id"), F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test").alias("split")))
)
register("tag_slices", "SELECT tag, count(*) AS samples, count(*) FILTER (passed) AS passed, count(*) FILTER (passed IS NULL) AS unknown FROM (SELECT unnest(language_tags) AS tag, company_raw = company_normalized AS passed FROM (SELECT DISTINCT id, language_tags, company_raw, company_normalized FROM interview)) GROUP BY 1")(
    lambda spark, d: E.slices(corpus.records(spark, d, "interview", "id", "language_tags", "company_raw", "company_normalized").select(F.col("language_tags").alias("tags"), (F.col("company_raw") == F.col("company_normalized")).alias("passed")))
)
_CUTS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
register(
    "operating_points",
    f"""WITH {_PAIRS}, s AS (SELECT o.confidence, p.gold = p.predicted AS correct FROM (SELECT DISTINCT id, confidence FROM occurrence) o JOIN p ON o.id = p.id), th(threshold) AS (VALUES {', '.join(f'(CAST({c} AS DOUBLE))' for c in _CUTS)})
    SELECT threshold, count(*) FILTER (confidence >= threshold) AS accepted, count(*) FILTER (confidence >= threshold AND NOT correct) AS errors, round(CAST(count(*) FILTER (confidence >= threshold) AS DOUBLE) / count(*), 6) AS coverage,
      round(CAST(count(*) FILTER (confidence >= threshold AND correct) AS DOUBLE) / nullif(count(*) FILTER (confidence >= threshold), 0), 6) AS precision FROM th, s GROUP BY 1""",
)(lambda spark, d: E.operating_points(_pairs(spark, d).join(corpus.records(spark, d, "occurrence", "id", "confidence"), "id").select("confidence", (F.col("gold") == F.col("predicted")).alias("correct")), list(_CUTS)))
register("stratified_sample", "SELECT id, question_type FROM (SELECT DISTINCT id, question_type FROM canonical) QUALIFY row_number() OVER (PARTITION BY question_type ORDER BY md5('s1' || id), id) <= 25")(
    lambda spark, d: E.stratified(corpus.records(spark, d, "canonical", "id", "question_type"), "id", "question_type", 25, "s1")
)
_SPANS = "s AS (SELECT DISTINCT id, source_spans[1].revision_id AS doc_id, source_spans[1].start_char AS a, source_spans[1].end_char AS b, normalized_question AS text FROM occurrence WHERE len(source_spans) > 0)"
register(
    "span_alignment",
    f"""WITH {_SPANS}, j AS (SELECT g.id AS gold_id, p.id AS predicted_id FROM s g JOIN (SELECT id, doc_id, a + 3 AS a, b + 3 AS b, text FROM s) p ON g.doc_id = p.doc_id AND g.text = p.text AND g.a < p.b AND p.a < g.b)
    SELECT gold_id, predicted_id FROM j QUALIFY count(*) OVER (PARTITION BY gold_id) = 1 AND count(*) OVER (PARTITION BY predicted_id) = 1""",
)(lambda spark, d: _aligned(spark, d))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    """Gold spans, each of a question's own, against the same spans moved by three characters."""
    o = E.spans_of(corpus.records(spark, d, "occurrence", "id", "normalized_question", "source_spans"))
    gold = o.select(F.struct("id", "position").alias("id"), F.col("span.revision_id").alias("doc_id"), F.col("span.start_char").alias("start"), F.col("span.end_char").alias("end"), F.col("normalized_question").alias("text"))
    pairs = E.aligned(gold, gold.withColumn("start", F.col("start") + 3).withColumn("end", F.col("end") + 3))
    return pairs.select(F.col("gold_id.id").alias("gold_id"), F.col("predicted_id.id").alias("predicted_id"))


register("neighbour_pairs", "SELECT id AS a, b FROM (SELECT id, identity, lead(id) OVER w AS b, lead(identity) OVER w AS other FROM (SELECT DISTINCT id, topic_id, normalized_question, canonical_question_id AS identity FROM occurrence WHERE canonical_question_id IS NOT NULL) WINDOW w AS (PARTITION BY topic_id ORDER BY normalized_question, id)) WHERE b IS NOT NULL AND identity <> other")(
    lambda spark, d: E.neighbours(corpus.records(spark, d, "occurrence", "id", "topic_id", "normalized_question", "canonical_question_id").where("canonical_question_id IS NOT NULL").withColumnRenamed("canonical_question_id", "identity"), "topic_id", ["normalized_question", "id"])
)
_JUDGE = "SELECT vec_id % 50 AS query_id, vec_id AS doc_id, label % 3 AS grade FROM embeddings WHERE label % 2 = 0"
_JUDGE2 = "SELECT vec_id % 50 AS query_id, vec_id AS doc_id, (label + 1) % 3 AS grade FROM embeddings WHERE label % 3 = 0"
register("merged_judgements", f"WITH a AS ({_JUDGE}), b AS ({_JUDGE2}) SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id AND a.doc_id = b.doc_id)")(lambda spark, d: _judgements(spark, d))


def _judgements(spark: SparkSession, d: str) -> DataFrame:
    v = corpus.scan(spark, d, "embeddings", "vec_id", "label")
    side = lambda m, k: v.where(F.col("label") % m == 0).select((F.col("vec_id") % 50).alias("query_id"), F.col("vec_id").alias("doc_id"), ((F.col("label") + k) % 3).alias("grade"))
    return E.merged_judgements(side(2, 0), side(3, 1))


register("decision_regroup", """WITH o AS (SELECT user_id AS field, event_type AS value, value / sum(value) OVER (PARTITION BY user_id) AS probability FROM events),
    g AS (SELECT field, value, least(1.0, round(sum(probability), 9)) AS probability FROM o GROUP BY ALL) SELECT field, value, probability FROM g QUALIFY row_number() OVER (PARTITION BY field ORDER BY probability DESC, value DESC) = 1""")(lambda spark, d: _regrouped(spark, d))  # fmt: skip


def _regrouped(spark: SparkSession, d: str) -> DataFrame:
    e = corpus.scan(spark, d, "events", "user_id", "event_type", "value")
    total = e.groupBy("user_id").agg(F.sum("value").alias("total"))
    return E.regrouped(e.join(total, "user_id").select(F.col("user_id").alias("field"), F.col("event_type").alias("value"), (F.col("value") / F.col("total")).alias("probability")))
