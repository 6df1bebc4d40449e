"""Registered queries: validation, decisions, verification, routing and other rules over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from occura import corpus
from occura.functions import text as T
from occura.operators import evaluation as E
from occura.operators import retrieval as R
from occura.operators import validation as V
from occura.queries.retrieval import _COS, _QV, _RANKS, BRANCH, _ranked_sql, _text_ranking
from occura.registry import Registry

register = Registry()

# ---------------------------------------------------------------- documents and sources

register("document_decisions", "SELECT DISTINCT id, CASE WHEN document_kind IN ('COMPILATION', 'TUTORIAL', 'OTHER', 'COLLECTION', 'GUIDE') THEN 'EXCLUDED' WHEN document_kind IS NULL OR document_kind = 'UNKNOWN' THEN 'NEEDS_REVIEW' ELSE 'INCLUDED' END AS decision FROM document_build")(
    lambda spark, d: corpus.records(spark, d, "document_build", "id", "document_kind").select("id", V.kind_decision(F.col("document_kind")).alias("decision"))
)
_URLS = """u AS (SELECT DISTINCT id, CASE CAST('0x' || substr(id, 1, 1) AS INTEGER) % 4 WHEN 0 THEN 'https://www.xiaohongshu.com/explore/' || substr(id, 1, 8) || '?xsec_token=1' WHEN 1 THEN 'https://www.nowcoder.com/discuss/' || substr(id, 1, 8)
  WHEN 2 THEN 'https://www.nowcoder.com/feed/main/detail/' || substr(id, 1, 8) ELSE coalesce(source_url, '') END AS url FROM source_document)"""
register("post_identity", f"""WITH {_URLS} SELECT id, CASE WHEN regexp_matches(url, '^https?://[^/?#]*xiaohongshu[.]com') AND regexp_matches(url, '^[^?#]*/(explore|discovery/item)/[A-Za-z0-9]') THEN 'xiaohongshu:' || regexp_extract(url, '/(?:explore|discovery/item)/([A-Za-z0-9]+)', 1)
    WHEN regexp_matches(url, '^https?://[^/?#]*nowcoder[.]com') AND regexp_matches(url, '^[^?#]*/(discuss|feed)/[A-Za-z0-9]') THEN 'nowcoder:' || regexp_extract(url, '/(?:discuss|feed)/([A-Za-z0-9]+)', 1) END AS post FROM u""")(lambda spark, d: _posts(spark, d))  # fmt: skip


def _posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts of the two sites whose addresses carry an id, whatever else the address says. Three quarters of the addresses are derived."""
    s = corpus.records(spark, d, "source_document", "id", "source_url")
    short, kind = F.substring("id", 1, 8), F.conv(F.substring("id", 1, 1), 16, 10).cast("int") % 4
    url = F.when(kind == 0, F.concat(F.lit("https://www.xiaohongshu.com/explore/"), short, F.lit("?xsec_token=1"))).when(kind == 1, F.concat(F.lit("https://www.nowcoder.com/discuss/"), short)).when(kind == 2, F.concat(F.lit("https://www.nowcoder.com/feed/main/detail/"), short))
    return s.select("id", T.post_identity(F.coalesce(url, "source_url", F.lit(""))).alias("post"))


register("compact_dates", """SELECT doc_id, CASE WHEN c <> '' THEN TRY_CAST(substr(c, 1, 4) || '-' || substr(c, 5, 2) || '-' || substr(c, 7, 2) AS DATE) END AS compact_date FROM (SELECT doc_id, regexp_extract(coalesce(lang, '') || ' ' || strftime(collected_at, '%Y%m%d') || ' ' || doc_id, '(?:^|[^0-9])(20[0-9]{6})(?:[^0-9]|$)', 1) AS c FROM documents)""")(
    lambda spark, d: corpus.scan(spark, d, "documents", "doc_id", "lang", "collected_at").select("doc_id", T.compact_date(F.concat_ws(" ", F.coalesce("lang", F.lit("")), F.date_format("collected_at", "yyyyMMdd"), F.col("doc_id").cast("string"))).alias("compact_date"))
)

# A task's surroundings: the last four lines before a mention with their section's heading, and three lines behind it.
_SECTION = "(?i)^\\s*(?:#{1,6}\\s*)?(?:[0-9]+[.、\\s]*)?(?:手撕(?:代码|算法)?|手写|算法(?:题)?|(?:AI\\s*)?coding(?:部分|环节)?|笔试|讲思路)\\s*(?:[:：（(]|$)"
register("task_context", f"""WITH t AS (SELECT doc_id, text, strpos(text, '面试官') AS pos FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents) WHERE strpos(text, '面试官') > 0),
    l AS (SELECT doc_id, CASE WHEN pos = 1 THEN [] ELSE string_split(regexp_replace(substr(text, 1, pos - 1), '\\n$', ''), chr(10)) END AS before, CASE WHEN pos + 2 = length(text) THEN [] ELSE string_split(regexp_replace(substr(text, pos + 3), '\\n$', ''), chr(10)) END AS behind FROM t),
    r AS (SELECT doc_id, array_to_string(before[-4:], chr(10)) AS near, list_filter(before[-20:], lambda x: length(x) < 200 AND regexp_matches(x, '{_SECTION}'))[-1] AS section, behind FROM l),
    k AS (SELECT *, CASE WHEN length(near) > 800 THEN right(near, 800) ELSE near END AS recent FROM r)
    SELECT doc_id, CASE WHEN section IS NOT NULL AND NOT contains(recent, section) THEN section || chr(10) || recent ELSE recent END AS context_before, left(array_to_string(behind[1:3], chr(10)), 400) AS context_after FROM k""")(
    lambda spark, d: corpus.scan(spark, d, "documents", "doc_id", "text").withColumn("text", T.unix_lines(F.col("text"))).withColumn("at", F.instr("text", "面试官")).where("at > 0")
    .select("doc_id", T.context_before(F.col("text"), F.col("at") - 1).alias("context_before"), T.context_behind(F.col("text"), F.col("at") + 2).alias("context_after"))
)

# ---------------------------------------------------------------- extraction


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return corpus.records(spark, d, "occurrence", "id", "raw_question", "source_spans").select("id", "raw_question", F.explode("source_spans").alias("s"))


@register("extraction_violations", """WITH o AS (SELECT DISTINCT id, interview_id, raw_question, source_spans, question_order, topic_id FROM occurrence), i AS (SELECT DISTINCT id, build_id, session_key FROM interview),
    b AS (SELECT DISTINCT id, source_revision_id, document_kind FROM document_build), s AS (SELECT id, interview_id, raw_question, unnest(source_spans) AS s FROM o)
    SELECT 'report_without_sessions' AS rule, id FROM b WHERE document_kind = 'INTERVIEW' AND id NOT IN (SELECT build_id FROM i WHERE build_id IS NOT NULL)
    UNION ALL SELECT 'report_without_questions', id FROM b WHERE document_kind = 'INTERVIEW' AND id NOT IN (SELECT build_id FROM i JOIN o ON o.interview_id = i.id WHERE build_id IS NOT NULL)
    UNION ALL SELECT DISTINCT 'session_key_twice', id FROM i QUALIFY count(*) OVER (PARTITION BY build_id, session_key) > 1
    UNION ALL SELECT DISTINCT 'question_place_twice', id FROM o QUALIFY count(*) OVER (PARTITION BY interview_id, question_order) > 1
    UNION ALL SELECT 'topic_without_second_level', id FROM o WHERE topic_id IS NOT NULL AND NOT contains(topic_id, '.')
    UNION ALL SELECT DISTINCT 'span_reversed', id FROM s WHERE s.start_char >= s.end_char OR s.start_line > s.end_line
    UNION ALL SELECT DISTINCT 'span_length_differs', id FROM s WHERE s.end_char - s.start_char <> length(s.quote)
    UNION ALL SELECT DISTINCT 'quote_not_in_question', id FROM s WHERE NOT contains(raw_question, s.quote)
    UNION ALL SELECT 'quotes_differ_from_question', id FROM o WHERE array_to_string(list_transform(source_spans, lambda x: x.quote), chr(10)) <> raw_question
    UNION ALL SELECT DISTINCT 'span_of_another_revision', s.id FROM s JOIN i ON i.id = s.interview_id JOIN b ON b.id = i.build_id WHERE s.s.revision_id <> b.source_revision_id""")  # fmt: skip
def extraction_violations(spark: SparkSession, d: str) -> DataFrame:
    """One row per broken rule of an extraction and record."""
    o = corpus.records(spark, d, "occurrence", "id", "interview_id", "raw_question", "source_spans", "question_order", "topic_id")
    i, b = corpus.records(spark, d, "interview", "id", "build_id", "session_key"), corpus.records(spark, d, "document_build", "id", "source_revision_id", "document_kind")
    report, s = b.where("document_kind = 'INTERVIEW'"), _spans(spark, d)
    asked = i.join(o.select(F.col("interview_id").alias("id")).distinct(), "id", "left_semi")
    twice = lambda df, *key: df.join(df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), list(key), "left_semi")
    homes = i.join(b.select(F.col("id").alias("build_id"), "source_revision_id"), "build_id").select(F.col("id").alias("interview_id"), "source_revision_id")
    placed = o.select("id", "interview_id", F.explode("source_spans").alias("s")).join(homes, "interview_id")
    return V.violations({
        "report_without_sessions": report.join(i.select(F.col("build_id").alias("id")), "id", "left_anti"),
        "report_without_questions": report.join(asked.select(F.col("build_id").alias("id")), "id", "left_anti"),
        "session_key_twice": twice(i, "build_id", "session_key"), "question_place_twice": twice(o, "interview_id", "question_order"),
        "topic_without_second_level": o.where("topic_id IS NOT NULL AND NOT contains(topic_id, '.')"),
        "span_reversed": s.where("s.start_char >= s.end_char OR s.start_line > s.end_line"), "span_length_differs": s.where("s.end_char - s.start_char <> length(s.quote)"),
        "quote_not_in_question": s.where("NOT contains(raw_question, s.quote)"),
        "quotes_differ_from_question": o.where(F.array_join(F.transform("source_spans", lambda x: x["quote"]), "\n") != F.col("raw_question")),
        "span_of_another_revision": placed.where("s.revision_id <> source_revision_id"),
    })


register("question_rules", """SELECT DISTINCT id, regexp_matches(raw_question, '^\\s*#{1,6}\\s') AS is_title, regexp_full_match(raw_question, '(?:[0-9]+[.、)）]\\s*)?反问(?:环节)?[\\s:：?？。.!！]*') AS is_candidate_heading,
    coalesce(split_part(topic_id, '.', 1) = 'ai' AND question_type IN ('KNOWLEDGE', 'PRINCIPLE'), false) AS wants_ai_type, lower(regexp_replace(regexp_replace(raw_question, '^\\s*[0-9]+[.、)）\\s]+', ''), '[^\\p{L}\\p{N}]+', '', 'g')) AS comparison_key,
    CASE WHEN contains(raw_question, 'Redis') OR contains(raw_question, 'redis') THEN 'redis.performance' WHEN contains(raw_question, 'Spring') AND contains(raw_question, '事务') THEN 'spring.transaction' ELSE 'other.unknown' END AS fallback_topic FROM occurrence""")(
    lambda spark, d: corpus.records(spark, d, "occurrence", "id", "raw_question", "topic_id", "question_type").select(
        "id", T.is_title(F.col("raw_question")).alias("is_title"), T.is_candidate_heading(F.col("raw_question")).alias("is_candidate_heading"),
        F.coalesce((F.split("topic_id", r"\.")[0] == "ai") & F.col("question_type").isin("KNOWLEDGE", "PRINCIPLE"), F.lit(False)).alias("wants_ai_type"),
        T.comparison_key(F.col("raw_question")).alias("comparison_key"), T.fallback_topic(F.col("raw_question")).alias("fallback_topic"))
)
register("span_paths", """WITH o AS (SELECT DISTINCT id, source_spans AS s FROM occurrence) SELECT id, s[1].quote AS first_quote, s[2].start_char AS second_start, CASE WHEN len(list_filter(s, lambda x: x.origin IS NULL)) = 0 THEN array_to_string(list_transform(s, lambda x: x.origin), ',') END AS origins FROM o""")(
    lambda spark, d: corpus.records(spark, d, "occurrence", "id", "source_spans").select(
        "id", V.path_values(F.col("source_spans"), [0, "quote"]).alias("first_quote"), V.path_values(F.col("source_spans"), [1, "start_char"]).alias("second_start"),
        F.array_join(V.path_values(F.col("source_spans"), ["*", "origin"]), ",").alias("origins"))
)
register("reference_issues", """SELECT DISTINCT 'unknown_round' AS issue, id FROM interview WHERE round IS NOT NULL AND round NOT IN ('FIRST', 'SECOND', 'THIRD', 'FOURTH_PLUS', 'HR') UNION ALL SELECT DISTINCT 'missing_family', id FROM interview WHERE job_family IS NULL AND position_normalized IS NOT NULL
    UNION ALL SELECT DISTINCT 'unknown_topic', o.id FROM occurrence o WHERE topic_id IS NOT NULL AND topic_id NOT IN (SELECT primary_topic_id FROM canonical WHERE primary_topic_id IS NOT NULL)""")(lambda spark, d: _references(spark, d))  # fmt: skip


def _references(spark: SparkSession, d: str) -> DataFrame:
    """Values of a record that are no known value of their field."""
    i, o = corpus.scan(spark, d, "interview", "id", "round", "job_family", "position_normalized"), corpus.scan(spark, d, "occurrence", "id", "topic_id").where("topic_id IS NOT NULL")
    known = corpus.scan(spark, d, "canonical", F.col("primary_topic_id").alias("topic_id")).where("topic_id IS NOT NULL").distinct()
    found = V.violations({"unknown_round": i.where("round NOT IN ('FIRST', 'SECOND', 'THIRD', 'FOURTH_PLUS', 'HR')"), "missing_family": i.where("job_family IS NULL AND position_normalized IS NOT NULL"), "unknown_topic": o.join(known, "topic_id", "left_anti")})
    return found.withColumnRenamed("rule", "issue")


# ---------------------------------------------------------------- second check of candidates, evaluation

_CHECKED = """p AS (SELECT id, interview_id, CASE WHEN substr(md5(id), 20, 1) < '6' THEN 'ACCEPTED' ELSE 'REJECTED' END AS decision, CAST('0x' || substr(md5(id), 21, 1) AS INTEGER) % 4 AS grade, substr(md5(id), 22, 1) AS n FROM (SELECT DISTINCT id, interview_id FROM occurrence)),
v AS (SELECT id, interview_id, CASE WHEN decision <> 'ACCEPTED' THEN 'NOT_REQUIRED' WHEN n < '2' THEN 'INVALID_SCHEMA' WHEN n < 'a' THEN 'CONFIRMED' ELSE 'SCOPE_REJECTED' END AS scope_status, decision AS was, grade FROM p),
w AS (SELECT id, interview_id, CASE scope_status WHEN 'NOT_REQUIRED' THEN was WHEN 'CONFIRMED' THEN 'ACCEPTED' ELSE scope_status END AS decision, CASE WHEN scope_status = 'INVALID_SCHEMA' THEN 0 ELSE grade END AS relevance_grade, scope_status FROM v)"""


def _verified(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of an interview after both checks; decisions are inputs, derived from digests."""
    o = corpus.records(spark, d, "occurrence", "id", "interview_id")
    n = corpus.nibble("id", 22)
    primary = o.select("id", F.when(corpus.nibble("id", 20) < "6", "ACCEPTED").otherwise("REJECTED").alias("decision"), (F.conv(corpus.nibble("id", 21), 16, 10).cast("int") % 4).alias("relevance_grade"))
    second = primary.where("decision = 'ACCEPTED'").select("id", (n < "a").alias("keep"), (n >= "2").alias("valid"))
    return V.scope_verified(primary, second).join(o, "id")


register("scope_verified", f"WITH {_CHECKED} SELECT id, decision, relevance_grade, scope_status FROM w")(lambda spark, d: _verified(spark, d).select("id", "decision", "relevance_grade", "scope_status"))
register("verification_status", f"WITH {_CHECKED} SELECT interview_id, count(*) AS candidates, count(*) FILTER (scope_status = 'INVALID_SCHEMA') AS invalid, CASE WHEN count(*) FILTER (scope_status = 'INVALID_SCHEMA') > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM w GROUP BY 1")(
    lambda spark, d: V.verification_status(_verified(spark, d), "interview_id")
)
register("page_audit", f"WITH {_CHECKED} SELECT id, CASE WHEN decision <> 'ACCEPTED' THEN decision WHEN row_number() OVER (PARTITION BY interview_id, decision = 'ACCEPTED' ORDER BY relevance_grade DESC, id) <= 2 THEN 'RETURNED' ELSE 'PAGE_CUTOFF' END AS outcome FROM w")(
    lambda spark, d: V.page_audit(_verified(spark, d), "interview_id", [F.desc("relevance_grade"), F.col("id")], 2).select("id", "outcome")
)


@register("dedup_recall", f"""WITH c AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (SELECT query_id, vec_id, {_COS} AS score FROM ({_QV}), embeddings WHERE vec_id <> query_id) QUALIFY place <= 10),
    g AS (SELECT q.vec_id AS query_id, min(r.vec_id) AS right_id FROM embeddings q JOIN embeddings r ON q.label = r.label AND r.vec_id > q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1),
    s AS (SELECT g.query_id, count(c.vec_id) FILTER (c.vec_id = right_id) AS hit, g.query_id % 60 = 0 AS judged_same, count(c.vec_id) AS seen FROM g LEFT JOIN c ON c.query_id = g.query_id GROUP BY ALL)
    SELECT count(*) AS same_gold, count(*) FILTER (seen > 0) AS observed, CASE WHEN count(*) FILTER (seen > 0) = count(*) THEN round(CAST(sum(hit) AS DOUBLE) / count(*), 6) END AS candidate_recall, CASE WHEN count(*) FILTER (seen > 0) = count(*) THEN round(CAST(count(*) FILTER (hit > 0 AND judged_same) AS DOUBLE) / count(*), 6) END AS end_to_end_recall FROM s""")  # fmt: skip
def dedup_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of pairs that are the same among ten candidates, and with the judgement too; only if every pair was observed."""
    e = corpus.scan(spark, d, "embeddings", "vec_id", "embedding", "label")
    q = e.where("vec_id % 20 = 0")
    candidates = R.cosine_top_k(q, e, "vec_id", "embedding", 10).select("query_id", "vec_id")
    # The next vector of the same label, within blocks of ids; behind a block's last one it is the next block's first.
    block, by = F.floor(F.col("vec_id") / 10_000), Window.partitionBy("label")
    rows = e.select("vec_id", "label", block.alias("block"))
    later = rows.groupBy("label", "block").agg(F.min("vec_id").alias("first")).select("label", "block", F.lead("first").over(by.orderBy("block")).alias("later"))
    nxt = rows.withColumn("nxt", F.lead("vec_id").over(Window.partitionBy("label", "block").orderBy("vec_id"))).join(later, ["label", "block"], "left")
    gold = nxt.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.coalesce("nxt", "later").alias("right_id")).where("right_id IS NOT NULL")
    return E.same_pair_recall(gold, candidates.withColumnRenamed("vec_id", "candidate_id"), F.col("query_id") % 60 == 0)


_DENSE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_OWN = "CAST('0x' || substr(id, 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings)"


@register("hybrid_dense_rrf", f"""{_RANKS}, own AS (SELECT DISTINCT id, {_OWN} AS vec_id FROM canonical), sim AS (SELECT a.vec_id AS qa, b.vec_id AS db, round({_DENSE}, 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT vec_id FROM own WHERE id IN (SELECT query_id FROM q))) a, embeddings b),
    dense AS (SELECT o.id AS query_id, p.id AS doc_id, score FROM own o JOIN sim ON o.vec_id = qa JOIN own p ON p.vec_id = db WHERE o.id IN (SELECT query_id FROM q) AND o.id <> p.id),
    n AS {_ranked_sql('dense')}, f AS (SELECT query_id, doc_id, round(sum(part), 9) AS score FROM (SELECT query_id, doc_id, CAST(1 AS DOUBLE) / (60 + rank) AS part FROM t UNION ALL SELECT query_id, doc_id, CAST(1 AS DOUBLE) / (60 + rank) FROM n) GROUP BY ALL)
    SELECT * FROM {_ranked_sql('f', 10)}""")  # fmt: skip
def hybrid_dense_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Text and vector rankings of one query set, fused. A question's vector is an input; here it is derived from its id."""
    q, ranking = _text_ranking(spark, d)
    number = F.conv(F.substring("id", 1, 8), 16, 10).cast("long")
    vectors = corpus.scan(spark, d, "embeddings", "vec_id", "embedding")
    total = vectors.count()
    own = corpus.records(spark, d, "canonical", "id").withColumn("vec_id", number % total)
    dense = R.cosine_top_k_shared(own.join(q.select(F.col("query_id").alias("id")), "id", "left_semi"), own, vectors, BRANCH)
    return R.top_k(R.fuse([(ranking, 1.0), (dense.withColumnRenamed("id", "doc_id"), 1.0)]), 10)


# ---------------------------------------------------------------- requests, queues and states

_ROUTE = """CASE WHEN starts_with(trim(m), '记录') OR regexp_matches(m, '帮我记录|记下|标记为|更新状态') THEN 'RECORD' WHEN regexp_matches(m, '冲刺|清单|薄弱项|复习缺口') THEN 'COMPOSITE' WHEN regexp_matches(m, '类似|相似|问法|检索') THEN 'SEARCH' WHEN regexp_matches(m, '详情|原文来源') THEN 'DETAIL'
  WHEN contains(m, '我的') AND regexp_matches(m, '状态|复习') THEN 'USER_STATE' WHEN regexp_matches(m, '核心|长尾|优先级|重要性') THEN 'IMPORTANCE' WHEN regexp_matches(m, '手撕|算法题') THEN 'ALGORITHM' WHEN regexp_matches(m, '高频|频率|频次|次数|比例|占比|趋势|分布|知识点|考点|统计|多少|排名') THEN 'STATS' ELSE 'SEARCH' END"""
register("routed_messages", f"SELECT id, {_ROUTE} AS route FROM (SELECT DISTINCT id, raw_question AS m FROM occurrence)")(
    lambda spark, d: corpus.records(spark, d, "occurrence", "id", "raw_question").select("id", T.route(F.col("raw_question")).alias("route"))
)
register("unquoted_text", """SELECT DISTINCT id, trim(regexp_replace(raw_question, '“[^”]*”|「[^」]*」|"[^"]*"|`[^`]*`', '', 'g'), ' ') AS unquoted FROM occurrence""")(
    lambda spark, d: corpus.records(spark, d, "occurrence", "id", "raw_question").select("id", T.unquoted(F.col("raw_question")).alias("unquoted"))
)
register("planned_queries", """SELECT id, array_to_string(list_distinct_in_order, ' ') AS retrieval_query, length(array_to_string(list_distinct_in_order, ' ')) <= 500 AS fits FROM (SELECT id, list_filter([a, b, c], lambda x, i: x IS NOT NULL AND list_position([a, b, c], x) = i) AS list_distinct_in_order
    FROM (SELECT DISTINCT id, canonical_text AS a, lower(canonical_text) AS b, primary_topic_id AS c FROM canonical))""")(
    lambda spark, d: corpus.records(spark, d, "canonical", "id", "canonical_text", "primary_topic_id").withColumn("retrieval_query", F.array_join(F.array_distinct(F.array_compact(F.array("canonical_text", F.lower("canonical_text"), "primary_topic_id"))), " "))
    .select("id", "retrieval_query", (F.length("retrieval_query") <= 500).alias("fits"))
)
register("tool_policy", """WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'view') > 0 AS page, count(*) FILTER (event_type = 'click') > 2 AS cursor, count(*) FILTER (event_type = 'purchase') > 0 AS granted, 8 - count(*) FILTER (event_type = 'error') AS remaining FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN remaining <= 0 THEN '' ELSE 'ANSWER,CLARIFY,COUNT' || CASE WHEN page THEN ',DETAILS' ELSE '' END || ',LIST' || CASE WHEN cursor THEN ',NEXT' ELSE '' END || CASE WHEN page AND granted THEN ',RECORD_REVIEW' ELSE '' END || CASE WHEN page THEN ',REVIEW_STATE' ELSE '' END || ',SEARCH,STATS' END AS allowed FROM s""")(lambda spark, d: _policy(spark, d))  # fmt: skip


def _policy(spark: SparkSession, d: str) -> DataFrame:
    """What a conversation may ask for in its state; none of it once the budget of tool calls is spent."""
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    s = corpus.scan(spark, d, "events", "user_id", "event_type").groupBy("user_id").agg((n("view") > 0).alias("page"), (n("click") > 2).alias("cursor"), (n("purchase") > 0).alias("granted"), (8 - n("error")).alias("remaining"))
    when = {"ANSWER": True, "CLARIFY": True, "COUNT": True, "DETAILS": F.col("page"), "LIST": True, "NEXT": F.col("cursor"), "RECORD_REVIEW": F.col("page") & F.col("granted"), "REVIEW_STATE": F.col("page"), "SEARCH": True, "STATS": True}
    allowed = F.array_compact(F.array(*[F.lit(a) if c is True else F.when(c, a) for a, c in when.items()]))
    return s.select("user_id", F.when(F.col("remaining") <= 0, "").otherwise(F.array_join(allowed, ",")).alias("allowed"))


register("conversation_focus", """SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('view', 'purchase')) AS goal, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'click') AS page_event, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1""")(lambda spark, d: _focus(spark, d))


def _focus(spark: SparkSession, d: str) -> DataFrame:
    """The last completed goal of a conversation, whatever paging came after it."""
    order, kind = F.struct("ts", "event_id"), F.col("event_type")
    e = corpus.scan(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.when(kind.isin("view", "purchase"), order)).alias("goal"), F.max_by("event_id", F.when(kind == "click", order)).alias("page_event"), F.count(F.when(kind == "error", 1)).alias("failures"))


register("calibration_admission", """SELECT user_id, count(*) FILTER (event_type = 'purchase') AS accepted, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') >= 20 AND count(*) FILTER (event_type = 'error') = 0 AS admitted FROM events GROUP BY 1""")(
    lambda spark, d: E.admitted(corpus.scan(spark, d, "events", "user_id", "event_type"), "user_id", F.col("event_type") == "purchase", F.col("event_type") == "error", 20)
)
register("run_progress", """WITH b AS (SELECT DISTINCT source_revision_id, processing_state FROM document_build), r AS (SELECT DISTINCT id, source_document_id, raw_file_path, batch_no FROM source_revision)
    SELECT batch_no, count(*) AS paths, count(*) FILTER (done) AS done, min(raw_file_path) FILTER (NOT done) AS first_remaining FROM (SELECT r.*, id IN (SELECT source_revision_id FROM b WHERE processing_state = 'READY') AS done FROM r) GROUP BY 1""")(lambda spark, d: _progress(spark, d))  # fmt: skip


def _progress(spark: SparkSession, d: str) -> DataFrame:
    """Paths done and left of every batch, and the first one left."""
    ready = corpus.scan(spark, d, "document_build", "source_revision_id", "processing_state").where("processing_state = 'READY'").select(F.col("source_revision_id").alias("id"), F.lit(True).alias("ready")).distinct()
    r = corpus.records(spark, d, "source_revision", "id", "raw_file_path", "batch_no").join(ready, "id", "left").withColumn("done", F.col("ready").isNotNull())
    return r.groupBy("batch_no").agg(F.count("*").alias("paths"), F.count(F.when(F.col("done"), 1)).alias("done"), F.min(F.when(~F.col("done"), F.col("raw_file_path"))).alias("first_remaining"))


register("queue_head", "SELECT batch_no, arg_min(id, (created_at, id)) AS id, min(created_at) AS created_at FROM source_revision WHERE created_at IS NOT NULL GROUP BY 1")(
    lambda spark, d: corpus.scan(spark, d, "source_revision", "id", "batch_no", "created_at").where("created_at IS NOT NULL").groupBy("batch_no").agg(F.min(F.struct("created_at", "id")).alias("h")).select("batch_no", "h.id", "h.created_at")
)
register("priority_order", """SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY CASE decision WHEN 'NEEDS_REVIEW' THEN 0 WHEN 'EXCLUDED' THEN 1 ELSE 2 END, processing_state, id) AS place FROM (SELECT DISTINCT id, decision, processing_state FROM document_build)) WHERE place <= 50""")(lambda spark, d: _priority(spark, d))


def _priority(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty builds by what needs attention most; sorted and cut before they are numbered."""
    urgent = F.when(F.col("decision") == "NEEDS_REVIEW", 0).when(F.col("decision") == "EXCLUDED", 1).otherwise(2)
    first = corpus.records(spark, d, "document_build", "id", "decision", "processing_state").select(urgent.alias("urgent"), "processing_state", "id").orderBy("urgent", "processing_state", "id").limit(50)
    listed = first.agg(F.array_sort(F.collect_list(F.struct("urgent", "processing_state", "id"))).alias("rows"))  # fifty rows
    return listed.select(F.posexplode("rows").alias("p", "r")).select("r.id", (F.col("p") + 1).cast("long").alias("place"))


register("sources_mentioning", "SELECT DISTINCT i.build_id FROM interview i WHERE EXISTS (SELECT 1 FROM occurrence o WHERE o.interview_id = i.id AND contains(o.raw_question, 'Redis')) AND build_id IS NOT NULL")(
    lambda spark, d: corpus.scan(spark, d, "interview", "id", "build_id").where("build_id IS NOT NULL").join(corpus.scan(spark, d, "occurrence", "interview_id", "raw_question").where("contains(raw_question, 'Redis')").select(F.col("interview_id").alias("id")), "id", "left_semi").select("build_id").distinct()
)
register("revision_equality", """WITH a AS (SELECT DISTINCT id, raw_file_hash, acquired_at, snapshot_path FROM source_revision), b AS (SELECT id, CASE WHEN substr(id, 1, 1) = 'a' THEN NULL ELSE raw_file_hash END AS raw_file_hash, acquired_at, snapshot_path FROM a WHERE substr(id, 1, 1) <> 'b')
    SELECT a.id, b.id IS NOT NULL AND a.raw_file_hash IS NOT DISTINCT FROM b.raw_file_hash AND a.acquired_at IS NOT DISTINCT FROM b.acquired_at AND a.snapshot_path IS NOT DISTINCT FROM b.snapshot_path AS equal FROM a LEFT JOIN b ON a.id = b.id""")(lambda spark, d: _equality(spark, d))  # fmt: skip


def _equality(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot against another one that lacks some records and values."""
    a = corpus.records(spark, d, "source_revision", "id", "raw_file_hash", "acquired_at", "snapshot_path")
    first = F.substring("id", 1, 1)
    return V.null_safe_equal(a, a.where(first != "b").withColumn("raw_file_hash", F.when(first != "a", F.col("raw_file_hash"))), "id")


register("active_preferences", """WITH p AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS set_at, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY ALL) SELECT user_id, event_type, value FROM p WHERE event_type <> 'error' AND last_event % 10 <> 0 AND set_at + INTERVAL 20 DAYS > (SELECT max(ts) FROM events)""")(lambda spark, d: _preferences(spark, d))


def _preferences(spark: SparkSession, d: str) -> DataFrame:
    """The last value of each preference that was neither deleted nor has run out."""
    e = corpus.scan(spark, d, "events", "event_id", "user_id", "event_type", "value", "ts")
    p = e.where("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("r"))
    newest = F.broadcast(e.agg(F.max("ts").alias("newest")))
    return p.join(newest).where((F.col("r.event_id") % 10 != 0) & (F.col("r.ts") + F.expr("INTERVAL 20 DAYS") > F.col("newest"))).select("user_id", "event_type", "r.value")


register("type_counts_map", """SELECT interview_id, array_to_string(list_sort(list(question_type || '=' || n)), ',') AS counts FROM (SELECT interview_id, question_type, count(DISTINCT id) AS n FROM occurrence WHERE question_type IS NOT NULL GROUP BY ALL) GROUP BY 1""")(
    lambda spark, d: corpus.records(spark, d, "occurrence", "id", "interview_id", "question_type").where("question_type IS NOT NULL").groupBy("interview_id", "question_type").agg(F.count("*").alias("n"))
    .groupBy("interview_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("question_type", "n")))).alias("m"))
    .select("interview_id", F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("counts"))
)
register("disjoint_samples", """SELECT question_type, CASE WHEN place <= 5 THEN 'dev' ELSE 'test' END AS sample, id FROM (SELECT question_type, id, row_number() OVER (PARTITION BY question_type ORDER BY md5(id), id) AS place FROM (SELECT DISTINCT question_type, id FROM canonical)) WHERE place <= 15""")(
    lambda spark, d: V.disjoint_quotas(corpus.records(spark, d, "canonical", "id", "question_type"), "id", "question_type", [("dev", 5), ("test", 10)])
)
register("request_status", """SELECT user_id, CASE WHEN max(event_id) FILTER (event_type = 'error') > max(event_id) FILTER (event_type = 'purchase') THEN 'CANCELLED' WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'SUCCEEDED' ELSE 'RUNNING' END AS status, count(*) AS events FROM events GROUP BY 1""")(lambda spark, d: _status(spark, d))


def _status(spark: SparkSession, d: str) -> DataFrame:
    """A request's status from its events; a cancellation counts if it came after the last success."""
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("event_id")))
    e = corpus.scan(spark, d, "events", "event_id", "user_id", "event_type").groupBy("user_id").agg(last("error").alias("cancelled"), last("purchase").alias("done"), F.count("*").alias("events"))
    return e.select("user_id", F.when(F.col("cancelled") > F.col("done"), "CANCELLED").when(F.col("done").isNotNull(), "SUCCEEDED").otherwise("RUNNING").alias("status"), "events")
