"""Registered queries: BM25, exact vectors, fusion, pools, selection. Every question whose id number is divisible by 20 is a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occura import corpus
from occura.functions import vector as V
from occura.functions.text import terms
from occura.operators import retrieval as R
from occura.queries.text import terms_sql
from occura.registry import Registry
from occura.shared import written

register = Registry()
#: Documents of each list of the main and preferred branches, and of a facet's list.
BRANCH, K = 100, 50

_NUMBER = "CAST('0x' || substr(id, 1, 8) AS BIGINT)"
_INDEX = f"""c AS (SELECT DISTINCT id, canonical_text FROM canonical),
p1 AS (SELECT id AS doc_id, term, len(ts) AS length, count(*) AS tf FROM (SELECT id, {terms_sql('canonical_text')} AS ts FROM c), unnest(ts) AS u(term) GROUP BY ALL),
v AS (SELECT canonical_question_id AS id, {terms_sql('normalized_question')} AS ts FROM (SELECT DISTINCT canonical_question_id, normalized_question FROM occurrence WHERE canonical_question_id IN (SELECT id FROM c))),
p2 AS (SELECT doc_id, term, length, count(*) AS tf FROM (SELECT id AS doc_id, flatten(list(ts)) AS ts, len(flatten(list(ts))) AS length FROM v GROUP BY 1), unnest(ts) AS u(term) GROUP BY ALL),
q AS (SELECT doc_id AS query_id, term FROM p1 WHERE CAST('0x' || substr(doc_id, 1, 8) AS BIGINT) % 20 = 0)"""


def _bm25_sql(p: str) -> str:
    return f"""(SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * length / mean_length))), 6) AS score
      FROM q JOIN (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM {p}) x ON q.term = x.term, (SELECT count(*) AS n_docs, avg(length) AS mean_length FROM (SELECT DISTINCT doc_id, length FROM {p})) s GROUP BY ALL)"""


def _ranked_sql(scores: str, k: int = BRANCH) -> str:
    return f"(SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {scores} QUALIFY rank <= {k})"


_TEXT, _VARIANTS = _ranked_sql(_bm25_sql("p1")), _ranked_sql(_bm25_sql("p2"))
_RANKS = f"WITH {_INDEX}, t AS {_TEXT}, w AS {_VARIANTS}"


def _queries(text_index: DataFrame) -> DataFrame:
    number = F.conv(F.substring("doc_id", 1, 8), 16, 10).cast("long")
    return text_index.where(number % 20 == 0).select(F.col("doc_id").alias("query_id"), "ts", *[c for c in text_index.columns if c == "kinds"])


def _kinds(of: str) -> F.Column:
    return F.collect_set(F.when(F.col(of).isNotNull(), F.xxhash64(of))).alias("kinds")


def _text(spark: SparkSession, d: str, kinds: bool = False) -> DataFrame:
    """Profiles of the questions' own texts, as a table; with ``kinds``, each question's types lie beside them."""
    c = corpus.scan(spark, d, "canonical", "id", "canonical_text", *["question_type"] * kinds)
    by_id = c.groupBy("id").agg(F.collect_set("canonical_text").alias("texts"), *[_kinds("question_type")] * kinds).withColumn("several", F.size("texts"))
    text = written(R.profiles(by_id, "id", terms(F.get("texts", F.lit(0))), "several", *["kinds"] * kinds), "text")
    if text.where("several > 1").isEmpty():
        return text.drop("several")
    mixed = R.profiles_of(R.postings(corpus.records(spark, d, "canonical", "id", "canonical_text"), "id", terms(F.col("canonical_text"))))  # ids with several texts
    return written(mixed.join(by_id.select(F.col("id").alias("doc_id"), "kinds"), "doc_id", "left") if kinds else mixed, "text")


def _variants(spark: SparkSession, d: str, kinds: bool = False) -> DataFrame:
    """Profiles of the questions' wordings, as a table. Lengths and term counts are summed per question."""
    c = corpus.scan(spark, d, "canonical", "id", *["question_type"] * kinds).withColumnRenamed("id", "canonical_question_id")
    known = c.groupBy("canonical_question_id").agg(_kinds("question_type")) if kinds else c.distinct()
    worded = corpus.scan(spark, d, "occurrence", "canonical_question_id", "normalized_question").distinct().join(known, "canonical_question_id")
    return written(R.counted_profiles(worded, "canonical_question_id", terms(F.col("normalized_question")), *["kinds"] * kinds), "variants")


def _rankings(spark: SparkSession, d: str, k: int = BRANCH) -> tuple[DataFrame, DataFrame]:
    text = _text(spark, d)
    q = _queries(text)
    return R.bm25_top_k(q, [(text, 1.0)], k), R.bm25_top_k(q, [(_variants(spark, d), 1.0)], k)


def _text_ranking(spark: SparkSession, d: str, k: int = BRANCH) -> tuple[DataFrame, DataFrame]:
    """The queries, and their ranking by text alone."""
    text = _text(spark, d)
    q = _queries(text)
    return q, R.bm25_top_k(q, [(text, 1.0)], k)


register("bm25_topk", f"{_RANKS} SELECT * FROM t")(lambda spark, d: _text_ranking(spark, d)[1])
register("bm25_variants_topk", f"{_RANKS} SELECT * FROM w")(lambda spark, d: R.bm25_top_k(_queries(_text(spark, d)), [(_variants(spark, d), 1.0)], BRANCH))


@register("bm25_two_field_max", f"WITH {_INDEX}, b AS (SELECT query_id, doc_id, max(s) AS score FROM (SELECT query_id, doc_id, 2 * score AS s FROM {_bm25_sql('p1')} UNION ALL SELECT query_id, doc_id, score FROM {_bm25_sql('p2')}) GROUP BY ALL) SELECT * FROM {_ranked_sql('b')}")
def bm25_two_field_max(spark: SparkSession, d: str) -> DataFrame:
    """Best field wins; the question's own text counts twice."""
    text = _text(spark, d)
    return R.bm25_top_k(_queries(text), [(text, 2.0), (_variants(spark, d), 1.0)], BRANCH)


def _rrf_sql(w1: float, w2: float) -> str:
    return f"(SELECT query_id, doc_id, round(sum(part), 9) AS score FROM (SELECT query_id, doc_id, CAST({w1} AS DOUBLE) / (60 + rank) AS part FROM t UNION ALL SELECT query_id, doc_id, CAST({w2} AS DOUBLE) / (60 + rank) FROM w) GROUP BY ALL)"


def _fused(spark: SparkSession, d: str, weights: tuple[float, float], k: int) -> DataFrame:
    """Both searches, whose lists meet in one shuffle."""
    text = _text(spark, d)
    q, lists = _queries(text), [("main", BRANCH, None, False)]

    def make(fields: list[dict]) -> tuple:
        ids, scores = R.fused(fields, "main", weights, k)
        return ids, scores.tolist(), range(1, len(ids) + 1)

    return R.gathered([R.find(q, text, lists), R.find(q, _variants(spark, d), lists)], make, "query_id string, doc_id string, score double, rank long")


register("rrf_two_way", f"{_RANKS} SELECT * FROM {_ranked_sql(_rrf_sql(1, 1), 10)}")(lambda spark, d: _fused(spark, d, (1.0, 1.0), 10))
register("rrf_weighted", f"{_RANKS} SELECT * FROM {_ranked_sql(_rrf_sql(1, 2), 10)}")(lambda spark, d: _fused(spark, d, (1.0, 2.0), 10))
register("hybrid_rrf_pool50", f"{_RANKS} SELECT * FROM {_ranked_sql(_rrf_sql(1, 1), 50)}")(lambda spark, d: _fused(spark, d, (1.0, 1.0), 50))

FACETS = ("facet_1", "facet_2")


def _stages(spark: SparkSession, d: str, make, schema: str, liked: bool = True) -> DataFrame:
    """What ``make`` makes of a query's ids by stage: main (fused), preferred (fused, over the questions of the query's own
    type alone), and two lexical facets. One search over the texts and one over the wordings give all of them; without
    ``liked`` there is no preferred stage."""
    text, variants = _text(spark, d, liked), _variants(spark, d, liked)
    q = _queries(text)
    both = [("main", BRANCH, None, False), *[("preferred", BRANCH, None, True)] * liked]

    def staged(fields: list[dict]) -> tuple:
        by = {stage: R.fused(fields, stage, (1.0, 1.0), BRANCH)[0] for stage, _, _, _ in both}
        return make(by | {f: fields[0][f][0] if f in fields[0] else [] for f in FACETS})

    found = [R.find(q, text, [*both, *[(f, K, half, False) for half, f in enumerate(FACETS)]]), R.find(q, variants, both)]
    return R.gathered(found, staged, schema)


def _staged(spark: SparkSession, d: str, liked: bool = True) -> DataFrame:
    """Rankings by stage."""
    rows = lambda by: ([s for s, ids in by.items() for _ in ids], [i for ids in by.values() for i in ids], [r for ids in by.values() for r in range(1, len(ids) + 1)])
    return _stages(spark, d, rows, "query_id string, stage string, doc_id string, rank long", liked)


def _pool(pool, *names: str):
    """Columns of ``pool`` over the named stages and those facets that found anything."""

    def make(by: dict) -> tuple:
        got = pool(*[by[n] for n in names], [by[f] for f in FACETS if by[f]])
        return [i for i, _ in got], range(1, len(got) + 1), [source for _, source in got]

    return make


_POOLED = "query_id string, doc_id string, place long, source string"
register("lexical_facet_pool")(lambda spark, d: _stages(spark, d, _pool(R.facet_pool, "main"), _POOLED, liked=False))
register("preferred_pool")(lambda spark, d: _stages(spark, d, _pool(R.preferred_pool, "main", "preferred"), _POOLED))


@register("rerank_select")
def rerank_select(spark: SparkSession, d: str) -> DataFrame:
    """Ten graded results a query; the grade is an input, here derived from a digest of the pair."""
    pooled = _pool(R.preferred_pool, "main", "preferred")

    def make(by: dict) -> tuple:
        ids, places, _ = pooled(by)
        ranks = [{i: r for r, i in enumerate(by[f], 1)} for f in FACETS]
        return ids, places, *[[of.get(i) for i in ids] for of in ranks]

    rows = _stages(spark, d, make, "query_id string, doc_id string, place long, f1 long, f2 long")
    return R.graded_selection(rows.withColumn("grade", F.pmod(F.xxhash64("query_id", "doc_id"), F.lit(4))), ["f1", "f2"], 10)


# ---------------------------------------------------------------- vectors

_COS = "round(list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6)"
_QV = "SELECT vec_id AS query_id, embedding AS q, label AS ql FROM embeddings WHERE vec_id % 20 = 0"
register("cosine_topk", f"SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT query_id, vec_id, {_COS} AS score FROM ({_QV}), embeddings WHERE vec_id <> query_id) QUALIFY rank <= 10")(
    lambda spark, d: _cosine(spark, d)
)


def _cosine(spark: SparkSession, d: str) -> DataFrame:
    vectors = corpus.scan(spark, d, "embeddings", "vec_id", "embedding")
    return R.cosine_top_k(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", 10)


@register("dense_filtered_topk", f"SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT query_id, vec_id, {_COS} AS score FROM ({_QV}), embeddings WHERE vec_id <> query_id AND label % 2 = 0) QUALIFY rank <= 10")
def dense_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    """Only eligible rows are compared; eligibility comes before the search."""
    vectors = corpus.scan(spark, d, "embeddings", "vec_id", "embedding", "label")
    return R.cosine_top_k(vectors.where("vec_id % 20 = 0"), vectors.where("label % 2 = 0"), "vec_id", "embedding", 10)


register("vector_validity", "SELECT vec_id, len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) AS valid, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm FROM embeddings")(
    lambda spark, d: corpus.scan(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", V.valid(F.col("embedding"), 64).alias("valid"), F.round(V.norm(F.col("embedding")), 5).alias("norm"))
)

# ---------------------------------------------------------------- judgements

_OBJECTS, _FOCI = ("SAME", "INSTANCE", "FLOW", "PARENT", "COMPONENT", "NONE", "UNKNOWN"), ("SAME", "CORE", "TRACE", "BROAD", "ADJACENT", "NONE", "UNKNOWN")
_GRADE = "CASE WHEN o IN ('NONE', 'UNKNOWN') OR f IN ('NONE', 'UNKNOWN') THEN 0 WHEN o IN ('SAME', 'INSTANCE') AND f = 'SAME' THEN 3 WHEN o IN ('SAME', 'INSTANCE') AND f IN ('CORE', 'TRACE') OR o = 'FLOW' AND f = 'TRACE' THEN 2 ELSE 1 END"


def _scope(column: str, at: int, values: tuple[str, ...]) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.conv(F.substring(F.md5(F.col(column).cast("binary")), at, 4), 16, 10).cast("int") % len(values) + 1).cast("int"))


def _scope_sql(at: int, values: tuple[str, ...]) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST('0x' || substr(md5(id), {at}, 4) AS INTEGER) % {len(values)} + 1]"


_JUDGED = f"j AS (SELECT id, raw_question AS text, {_scope_sql(1, _OBJECTS)} AS o, {_scope_sql(5, _FOCI)} AS f, substr(raw_question, 1, 4) AS object_quote, CASE WHEN substr(md5(id), 9, 1) < '4' THEN ' ' ELSE substr(normalized_question, 1, 6) END AS focus_quote FROM (SELECT DISTINCT id, raw_question, normalized_question FROM occurrence))"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    o = corpus.records(spark, d, "occurrence", "id", "raw_question", "normalized_question")
    focus = F.when(corpus.nibble("id", 9) < "4", " ").otherwise(F.substring("normalized_question", 1, 6))
    return o.select("id", F.col("raw_question").alias("text"), _scope("id", 1, _OBJECTS).alias("o"), _scope("id", 5, _FOCI).alias("f"), F.substring("raw_question", 1, 4).alias("object_quote"), focus.alias("focus_quote"))


register("grade_lattice", f"WITH {_JUDGED} SELECT o, f, min({_GRADE}) AS grade, count(*) AS judged FROM j GROUP BY ALL")(
    lambda spark, d: _judged(spark, d).groupBy("o", "f").agg(F.min(R.grade(F.col("o"), F.col("f"))).alias("grade"), F.count("*").alias("judged"))
)
register("accept_grounded", f"WITH {_JUDGED} SELECT id, grade FROM (SELECT *, {_GRADE} AS grade FROM j) WHERE grade >= 2 AND trim(object_quote) <> '' AND contains(text, object_quote) AND trim(focus_quote) <> '' AND contains(text, focus_quote)")(
    lambda spark, d: R.accepted(_judged(spark, d).withColumn("grade", R.grade(F.col("o"), F.col("f")))).select("id", "grade")
)
