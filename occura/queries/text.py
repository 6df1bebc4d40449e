"""Registered queries: text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occura import corpus
from occura.functions import text as T
from occura.registry import Registry

register = Registry()

_TERMS = """list_distinct(list_concat(regexp_extract_all(lower({0}), '[a-z][a-z0-9_+.#-]*'),
  flatten(list_transform(regexp_extract_all(lower({0}), '[\\x{{4e00}}-\\x{{9fff}}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))))"""


def terms_sql(column: str) -> str:
    return _TERMS.format(column)


register("tokenize_terms", f"SELECT id, unnest({terms_sql('canonical_text')}) AS term FROM (SELECT DISTINCT id, canonical_text FROM canonical)")(
    lambda spark, d: corpus.records(spark, d, "canonical", "id", "canonical_text").select("id", F.explode(T.terms(F.col("canonical_text"))).alias("term"))
)
register(
    "url_identity",
    """SELECT id, CASE WHEN source_url IS NULL THEN 'path:' || lower(original_relative_path) ELSE
      'url:' || lower(regexp_extract(source_url, '^(https?)://', 1)) || '://' || lower(regexp_extract(source_url, '^https?://([^/?#:]+)', 1))
      || regexp_replace(regexp_extract(source_url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '')
      || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS identity
    FROM (SELECT DISTINCT id, source_url, original_relative_path,
      list_sort(list_filter(string_split(regexp_extract(coalesce(source_url, ''), '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content'))) AS kept
      FROM source_document)""",
)(lambda spark, d: corpus.records(spark, d, "source_document", "id", "source_url", "original_relative_path").select("id", T.url_identity(F.col("source_url"), F.col("original_relative_path")).alias("identity")))
register(
    "round_parse",
    """SELECT id, CASE WHEN len(n) = 1 THEN n[1] END AS round_name FROM (SELECT DISTINCT id, list_filter([
      CASE WHEN regexp_matches(round_raw, '[一1]面') THEN 'FIRST' END, CASE WHEN regexp_matches(round_raw, '[二2]面') THEN 'SECOND' END, CASE WHEN regexp_matches(round_raw, '[三3]面') THEN 'THIRD' END,
      CASE WHEN regexp_matches(round_raw, '[四4五5]面') THEN 'FOURTH_PLUS' END, CASE WHEN regexp_matches(round_raw, '(?i)HR') THEN 'HR' END], lambda x: x IS NOT NULL) AS n FROM interview)""",
)(lambda spark, d: corpus.records(spark, d, "interview", "id", "round_raw").select("id", T.round_name(F.col("round_raw")).alias("round_name")))
register(
    "position_parse",
    """SELECT DISTINCT id, CASE WHEN position_raw IS NULL OR position_raw = '' THEN NULL WHEN regexp_matches(position_raw, '后端|后台|服务端') THEN 'BACKEND'
      WHEN regexp_matches(position_raw, 'AI应用|Agent开发|大模型应用') THEN 'AI_APPLICATION' WHEN contains(position_raw, '算法') THEN 'ALGORITHM' ELSE 'OTHER' END AS family,
      coalesce(contains(lower(position_raw), 'java'), false) AS java FROM interview""",
)(
    lambda spark, d: corpus.records(spark, d, "interview", "id", "position_raw").select(
        "id", T.job_family(F.col("position_raw")).alias("family"), F.coalesce(F.lower("position_raw").contains("java"), F.lit(False)).alias("java")
    )
)
register(
    "company_alias",
    """SELECT DISTINCT id, CASE lower(company_raw) WHEN '' THEN NULL WHEN '字节跳动' THEN '字节' WHEN '抖音' THEN '字节' WHEN 'pdd' THEN '拼多多' WHEN 'boss' THEN 'BOSS直聘' WHEN 'boss直聘' THEN 'BOSS直聘' ELSE company_raw END AS company FROM interview""",
)(lambda spark, d: corpus.records(spark, d, "interview", "id", "company_raw").select("id", T.company_alias(F.col("company_raw")).alias("company")))
register(
    "date_parse",
    """SELECT doc_id, CASE WHEN y <> '' THEN TRY_CAST(y || '-' || lpad(m, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE) END AS first_date FROM (SELECT doc_id,
      regexp_extract(text, '(?:^|[^0-9])(20[0-9]{2})[-./年]([0-9]{1,2})[-./月]([0-9]{1,2})日?(?:[^0-9]|$)', 1) AS y, regexp_extract(text, '(?:^|[^0-9])(20[0-9]{2})[-./年]([0-9]{1,2})[-./月]([0-9]{1,2})日?(?:[^0-9]|$)', 2) AS m,
      regexp_extract(text, '(?:^|[^0-9])(20[0-9]{2})[-./年]([0-9]{1,2})[-./月]([0-9]{1,2})日?(?:[^0-9]|$)', 3) AS dd FROM documents)""",
)(lambda spark, d: corpus.scan(spark, d, "documents", "doc_id", "text").select("doc_id", T.first_date(F.col("text")).alias("first_date")))
register(
    "algorithm_match_parse",
    """SELECT id, CASE WHEN p IS NOT NULL THEN 'LEETCODE' WHEN regexp_matches(raw_question, '(?i)(^|[^\\p{L}\\p{N}_])SQL([^\\p{L}\\p{N}_]|$)|数据库查询') THEN 'SQL'
      WHEN regexp_matches(raw_question, '手撕|编程|代码|算法题') THEN 'CODING_TASK' ELSE 'UNKNOWN' END AS kind, p AS problem
    FROM (SELECT DISTINCT id, raw_question, coalesce(nullif(regexp_extract(raw_question, '(?i)(?:^|[^\\p{L}\\p{N}_])lc\\s*#?\\s*([0-9]{1,5})(?:[^\\p{L}\\p{N}_]|$)', 1), ''),
      nullif(regexp_extract(raw_question, '(?i)(?:^|[^\\p{L}\\p{N}_])leetcode\\s*#?\\s*([0-9]{1,5})(?:[^\\p{L}\\p{N}_]|$)', 1), ''), nullif(regexp_extract(raw_question, '力扣\\s*(?:第)?\\s*([0-9]{1,5})', 1), '')) AS p FROM occurrence)""",
)(lambda spark, d: corpus.records(spark, d, "occurrence", "id", "raw_question").select("id", T.coding_kind(F.col("raw_question")).alias("c")).select("id", "c.kind", "c.problem"))
register("line_number_of_offset", "SELECT doc_id, CASE WHEN strpos(text, '```') > 0 THEN len(string_split(substr(text, 1, strpos(text, '```') - 1), chr(10))) END AS code_line FROM documents")(
    lambda spark, d: corpus.scan(spark, d, "documents", "doc_id", "text").select("doc_id", F.when(F.instr("text", "```") > 0, T.line_of(F.col("text"), F.instr("text", "```") - 1)).cast("long").alias("code_line"))
)
register("line_range_reader", "SELECT doc_id, array_to_string(list_slice(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 2, 4), chr(10)) AS lines FROM documents")(
    lambda spark, d: corpus.scan(spark, d, "documents", "doc_id", "text").select("doc_id", T.line_range(T.unix_lines(F.col("text")), 2, 4).alias("lines"))
)
register(
    "decode_line_ends",
    "SELECT doc_id, length(text) AS chars, length(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS plain_chars, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS content_hash FROM documents",
)(
    lambda spark, d: corpus.scan(spark, d, "documents", "doc_id", "text").withColumn("u", T.unix_lines(F.col("text"))).select(
        "doc_id", F.length("text").cast("long").alias("chars"), F.length("u").cast("long").alias("plain_chars"), F.sha2("u", 256).alias("content_hash")
    )
)
register(
    "section_headings",
    """SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(x) < 200 AND regexp_matches(x, '(?i)^\\s*(?:#{1,6}\\s*)?(?:[0-9]+[.、\\s]*)?(?:手撕(?:代码|算法)?|手写|算法(?:题)?|(?:AI\\s*)?coding(?:部分|环节)?|笔试|讲思路)\\s*(?:[:：（(]|$)'))) AS headings FROM documents""",
)(lambda spark, d: corpus.scan(spark, d, "documents", "doc_id", "text").select("doc_id", T.section_headings(F.col("text")).cast("long").alias("headings")))
register("json_path_lookup", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.missing') IS NULL AS missing FROM events")(
    lambda spark, d: corpus.scan(spark, d, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").isNull().alias("missing"))
)
register("query_key_normalize")(lambda spark, d: corpus.records(spark, d, "canonical", "id", "canonical_text").select("id", T.query_key("canonical_text").alias("query_key")))
_QUANTITIES = """WITH t AS (SELECT DISTINCT id, canonical_text AS v FROM canonical),
    m AS (SELECT id, v, unnest(regexp_extract_all(v, '[\\p{Nd}]+|[零一二两三四五六七八九十百千]+')) AS text, generate_subscripts(regexp_extract_all(v, '[\\p{Nd}]+|[零一二两三四五六七八九十百千]+'), 1) AS k FROM t),
    g AS (SELECT id, regexp_split_to_array(v, '[\\p{Nd}]+|[零一二两三四五六七八九十百千]+') AS gaps FROM t),
    s AS (SELECT m.id, text, k, sum(length(text)) OVER (PARTITION BY m.id ORDER BY k) - length(text) + list_sum(list_transform(gaps[1:k], lambda x: length(x))) AS start FROM m JOIN g ON m.id = g.id),
    c AS (SELECT *, translate(text, '零一二两三四五六七八九', '01223456789') AS d FROM s)
    SELECT id, text, CAST(start AS INTEGER) AS start, CASE WHEN regexp_full_match(text, '[0-9]+') THEN TRY_CAST(text AS BIGINT)
      WHEN regexp_full_match(text, '[零一二两三四五六七八九十百千]+') THEN CAST(coalesce(list_sum(list_transform(regexp_extract_all(d, '[0-9]?[十百千]'), lambda u:
        greatest(coalesce(TRY_CAST(u[1] AS BIGINT), 1), 1) * CASE u[-1] WHEN '十' THEN 10 WHEN '百' THEN 100 ELSE 1000 END)), 0) + coalesce(TRY_CAST(d[-1] AS BIGINT), 0) AS BIGINT) END AS value FROM c"""
register("quantity_spans", _QUANTITIES)(lambda spark, d: corpus.records(spark, d, "canonical", "id", "canonical_text").select("id", F.explode(T.quantities(F.col("canonical_text"))).alias("q")).select("id", "q.*"))


@register("evidence_clip")
def evidence_clip(spark: SparkSession, d: str) -> DataFrame:
    """Head and tail of every wording: 500 bytes a question, shared by its occurrences (at most two count), 2/5 for a head and 1/2 for a tail."""
    o = corpus.records(spark, d, "occurrence", "id", "canonical_question_id", "raw_question")
    n = o.where("canonical_question_id IS NOT NULL").groupBy("canonical_question_id").agg(F.count("*").alias("n"))
    budget = F.floor(F.lit(500) / F.least(F.coalesce("n", F.lit(1)), F.lit(2)))
    o = o.join(n, "canonical_question_id", "left").withColumn("budget", budget)
    return o.select("id", T.clip_bytes("raw_question", F.floor(F.col("budget") * 2 / 5), F.lit(False)).alias("head"), T.clip_bytes("raw_question", F.floor(F.col("budget") / 2), F.lit(True)).alias("tail"))
