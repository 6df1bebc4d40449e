from __future__ import annotations

from pyspark.sql import functions as F

from occura.functions import text as T
from occura.operators import validation as V


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


def test_violations_and_decisions(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "UNKNOWN"), ("c", "INTERVIEW"), ("d", "TUTORIAL")], "id string, kind string")
    assert sorted(tuple(r) for r in V.violations({"none": df.where("kind IS NULL"), "never": df.limit(0)}).collect()) == [("none", "a")]
    got = {r.id: r.d for r in df.select("id", V.kind_decision(F.col("kind")).alias("d")).collect()}
    assert got == {"a": "NEEDS_REVIEW", "b": "NEEDS_REVIEW", "c": "INCLUDED", "d": "EXCLUDED"}


def test_second_check(spark):
    primary = spark.createDataFrame([(i, "ACCEPTED" if i < 5 else "REJECTED", 3) for i in range(6)], "id int, decision string, relevance_grade int")
    verified = spark.createDataFrame([(0, True, True), (1, False, True), (2, True, False), (3, None, True), (4, True, None)], "id int, keep boolean, valid boolean")
    out = V.scope_verified(primary, verified)
    assert {r.id: (r.decision, r.relevance_grade) for r in out.collect()} == {0: ("ACCEPTED", 3), 1: ("SCOPE_REJECTED", 3), 2: ("INVALID_SCHEMA", 0), 3: ("SCOPE_REJECTED", 3), 4: ("INVALID_SCHEMA", 0), 5: ("REJECTED", 3)}
    status = V.verification_status(out.withColumn("g", F.lit(1)), "g").first()
    assert (status.candidates, status.invalid, status.status) == (6, 2, "PARTIAL")
    audit = V.page_audit(primary.withColumn("g", F.lit("q")), "g", [F.desc("relevance_grade"), F.col("id")], 2)
    assert {r.id: r.outcome for r in audit.collect()} == {0: "RETURNED", 1: "RETURNED", 2: "PAGE_CUTOFF", 3: "PAGE_CUTOFF", 4: "PAGE_CUTOFF", 5: "REJECTED"}


def test_null_safe_equality(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "p", None), (3, "p", "y"), (4, None, None)], "id int, u string, v string")
    b = spark.createDataFrame([(1, None, "x"), (2, None, None), (3, "p", "y"), (5, None, None)], "id int, u string, v string")
    assert {r.id: r.equal for r in V.null_safe_equal(a, b, "id").collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_samples_are_disjoint(spark):
    rows = spark.createDataFrame([("s", f"i{k:02}") for k in range(9)] + [("t", "j1"), ("t", "j1")], "stratum string, id string")
    got = V.disjoint_quotas(rows, "id", "stratum", [("dev", 3), ("test", 4)]).collect()
    assert sorted((r.stratum, r.sample) for r in got) == [("s", "dev")] * 3 + [("s", "test")] * 4 + [("t", "dev")]
    assert len({r.id for r in got}) == len(got)


def test_paths(spark):
    df = spark.createDataFrame([(1, [("a", 1), ("b", None)]), (2, []), (3, None)], "id int, s array<struct<q:string,n:int>>")
    got = {r.id: (r.a, r.b, r.c, r.d) for r in df.select("id", *[V.path_values(F.col("s"), p).alias(k) for k, p in (("a", [0, "q"]), ("b", [5, "q"]), ("c", ["*", "q"]), ("d", ["*", "n"]))]).collect()}
    assert got == {1: ("a", None, ["a", "b"], None), 2: (None, None, [], []), 3: (None, None, None, None)}


def test_text_rules(spark):
    posts = {
        "https://www.xiaohongshu.com/explore/abc123?x=1": "xiaohongshu:abc123", "http://xiaohongshu.com/discovery/item/Z9/": "xiaohongshu:Z9", "https://m.nowcoder.com/discuss/77#a": "nowcoder:77",
        "https://www.nowcoder.com/about?u=/feed/9": None, "https://example.com/explore/abc": None, "": None,
    }
    assert {u: one(spark, u, T.post_identity) for u in posts} == posts
    assert [str(one(spark, t, T.compact_date)) for t in ("on 20260102.", "20261399", "120260102", "x")] == ["2026-01-02", "None", "None", "None"]
    assert [one(spark, t, T.is_candidate_heading) for t in ("3. 反问环节：", "反问", "反问他三个问题")] == [True, True, False]
    assert one(spark, "1. Redis 为什么-快？", T.comparison_key) == "redis为什么快"
    assert [one(spark, m, T.route) for m in ("记录一下", "我的复习状态", "复习，我的", "高频题", "随便问问", "给我详情")] == ["RECORD", "USER_STATE", "USER_STATE", "STATS", "SEARCH", "DETAIL"]
    assert one(spark, "请“标记为已掌握”`x`吧", T.unquoted) == "请吧"


def test_context(spark):
    text = "\n".join(["## 手撕代码", *[f"line {i}" for i in range(8)], "ask me", "a", "b", "c", "d"])
    at = text.index("ask me")
    row = spark.createDataFrame([(text, at)], "t string, at int").select(T.context_before(F.col("t"), F.col("at")).alias("b"), T.context_behind(F.col("t"), F.col("at") + 6).alias("a")).first()
    assert row.b == "## 手撕代码\nline 4\nline 5\nline 6\nline 7" and row.a == "\na\nb"
    none = spark.createDataFrame([("ask", 0)], "t string, at int").select(T.context_before(F.col("t"), F.col("at")).alias("b"), T.context_behind(F.col("t"), F.lit(3)).alias("a")).first()
    assert (none.b, none.a) == ("", "")
