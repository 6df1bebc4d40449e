from __future__ import annotations

import hashlib
from datetime import date, datetime, timedelta

import pytest

from occura.operators import telemetry as T
from occura.operators.filters import FilterSpec
from occura.plans import execute
from occura.plans.plan import Plan, conflicts, open_cursor, problems, sign_cursor, softened, with_label_policy
from occura.sources import files
from occura.streaming import streams
from tests import corpora


def test_markdown_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "B.md").write_bytes("﻿甲\r\n乙".encode())
    (tmp_path / "sub" / "a.md").write_bytes(b"x")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "issue.md").write_bytes(b"skip")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = files.markdown_corpus(spark, str(tmp_path)).collect()
    assert [(r.relative_path, r.text, r.valid) for r in got] == [("B.md", "甲\n乙", True), ("bad.md", None, False), ("sub/a.md", "x", True)]
    assert got[2].content_hash == hashlib.sha256(b"x").hexdigest()
    with pytest.raises(ValueError, match="leaves"):
        files.contained("/root", "../etc")
    assert files.contained("/root", "a/./b.md") == "/root/a/b.md"


def test_snapshots_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("h1", "a"), ("h1", "a"), ("h2", "b"), ("h3", None)], "content_hash string, text string")
    path = str(tmp_path / "snap")
    assert files.save_snapshots(df, path) == 2
    assert files.save_snapshots(df, path) == 0
    assert spark.read.parquet(path).count() == 2


def test_json_lines(spark, tmp_path):
    good, bad = tmp_path / "g.jsonl", tmp_path / "b.jsonl"
    good.write_text('{"a": 1, "x": 0.5}\n{"a": 2}\n')
    bad.write_text('{"a": 1, "x": NaN}\n')
    assert [(r.a, r.x) for r in files.json_lines(spark, str(good), "a int, x double").collect()] == [(1, 0.5), (2, None)]
    with pytest.raises(Exception, match="(?i)malformed|finite|NaN"):
        files.json_lines(spark, str(bad), "a int, x double").collect()
    df = spark.range(5)
    assert files.export_lines(df, str(tmp_path / "out")) == 5


def test_versions(spark, tmp_path):
    v = files.Versions(spark, str(tmp_path / "index"))
    assert v.current() is None
    v.publish(spark.range(3), 1)
    v.publish(spark.range(9), 1)  # the same revision again changes nothing
    assert (v.current(), v.read().count()) == (1, 3)
    with pytest.raises(ValueError, match="instead of"):
        v.publish(spark.range(4), 2, expected_rows=5)
    assert v.current() == 1
    v.publish(spark.range(4), 2, expected_rows=4)
    assert (v.read().count(), v.read(1).count()) == (4, 3)
    with pytest.raises(ValueError, match="older"):
        v.publish(spark.range(1), 1)
    with pytest.raises(LookupError):
        v.read(7)


def test_cache_computes_only_misses(spark, tmp_path):
    asked = []

    def compute(df):
        asked.append(df.count())
        return df.selectExpr("k", "k * 2 AS v")

    path = str(tmp_path / "cache")
    assert files.cached(spark.createDataFrame([(1,), (2,), (2,)], "k int"), path, compute, "k").count() == 3
    assert sorted(r.v for r in files.cached(spark.createDataFrame([(2,), (3,)], "k int"), path, compute, "k").collect()) == [4, 6]
    assert asked == [2, 1]


def test_plan_checks_and_rewrites():
    assert problems(Plan("LIST")) == []
    assert problems(Plan("SEARCH")) and problems(Plan("COUNT", top_n=3)) and problems(Plan("STATS")) and problems(Plan("DETAILS")) and problems(Plan("FLY"))
    assert problems(Plan("LIST", group_by="company", sort="gap"))
    assert with_label_policy(Plan("LIST", FilterSpec(response_form="CODE"))).filters.annotation_status == "KNOWN"
    plan, soft = softened(Plan("SEARCH", FilterSpec(company="c", topic_l1="t", question_type="CODING"), query="x"), frozenset({"topic_l1"}))
    assert soft == {"question_type": "CODING"} and plan.filters.topic_l1 == "t" and plan.filters.question_type is None
    assert conflicts(Plan("LIST", FilterSpec(company="a")), FilterSpec(company="b", round="HR")) == ["company"]


def test_cursor():
    plan, key = Plan("LIST", top_n=40), b"k"
    token = sign_cursor(plan, (1.5, "q1"), 3, key, now=1000)
    assert open_cursor(token, Plan("LIST", top_n=40, page=50), 3, key, now=1100) == (1.5, "q1")
    with pytest.raises(ValueError, match="SNAPSHOT_CHANGED"):
        open_cursor(token, plan, 4, key, now=1100)
    for bad in (token[:-2] + "AA", "x", token.replace(".", "")):
        with pytest.raises(ValueError, match="INVALID_CURSOR"):
            open_cursor(bad, plan, 3, key, now=1100)
    with pytest.raises(ValueError, match="INVALID_CURSOR"):
        open_cursor(token, plan, 3, key, now=9999)
    with pytest.raises(ValueError, match="INVALID_CURSOR"):
        open_cursor(token, Plan("LIST", top_n=41), 3, key, now=1100)


def test_plans_run(spark, tmp_path):
    d = corpora.write(spark, str(tmp_path / "d"), corpora.seed_tables())
    as_of = date(2026, 9, 30)
    go = lambda p: execute.run(spark, d, p, as_of)
    assert tuple(go(Plan("COUNT")).first()) == (2, 3, 3, 3, 2)
    assert [r.key for r in go(Plan("LIST", sort="importance")).collect()] == ["fast", "persistence"]
    assert {r.key: r.occurrence_count for r in go(Plan("STATS", group_by="company")).collect()} == {"字节": 2, "腾讯": 1}
    found = go(Plan("SEARCH", FilterSpec(company="字节", round="SECOND"), query="Redis 持久化")).collect()
    assert [r.doc_id for r in found] == ["persistence"]
    assert go(Plan("DETAILS", ids=("fast",))).count() == 2
    with pytest.raises(ValueError, match="needs a query"):
        go(Plan("SEARCH"))


@pytest.fixture()
def event_files(spark, tmp_path):
    start = datetime(2026, 1, 1)
    rows = [(i, start + timedelta(seconds=37 * i), i % 3, ["view", "error", "click", "purchase"][i % 4], float(i % 11), "{}") for i in range(120)]
    for k in range(3):  # three files make three batches; the middle one holds the latest events
        part = rows[k * 40 : k * 40 + 40] if k == 0 else rows[(3 - k) * 40 : (3 - k) * 40 + 40]
        spark.createDataFrame(part, streams.EVENT_SCHEMA.replace("timestamp_ntz", "timestamp")).selectExpr("event_id", "CAST(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        next((tmp_path / f"p{k}").glob("*.parquet")).rename(tmp_path / f"events{k}.parquet")
    return str(tmp_path), spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")


def test_streams_equal_their_batch_twins(spark, event_files):
    d, batch = event_files
    reviews = lambda df: df.selectExpr("event_id", "user_id", "event_id % 7 AS item", "CASE event_type WHEN 'view' THEN 'UNSEEN' WHEN 'error' THEN 'WEAK' ELSE 'REVIEWED' END AS status", "CASE WHEN event_id % 3 = 0 THEN CAST(value AS long) END AS score", "ts")
    source = streams.events(spark, d, files_per_batch=1)
    last = {(r.user_id, r["item"]): (r.status, r.review_count, r.version, r.last_score, r.last_reviewed_at) for r in streams.folded_state(reviews(source)).collect()}
    want = {(r.user_id, r["item"]): (r.status, r.review_count, r.version, r.last_score, r.last_reviewed_at) for r in T.folded_state(reviews(batch)).collect()}
    assert last == want
    deliveries = lambda df: df.selectExpr("event_id", "CAST(value AS string) AS key", "event_type AS payload_hash")
    assert sorted(map(tuple, streams.receipts(deliveries(streams.events(spark, d, 1))).collect())) == sorted(map(tuple, T.receipts(deliveries(batch)).collect()))

    requests = lambda df: df.selectExpr("event_id", "user_id AS visitor_id", "CAST(user_id AS string) AS ip", "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status", "ts AS created_at")
    bins = streams.latest(streams.drain(streams.traffic_bins(requests(streams.events(spark, d, 3)), 900), "update"), "bin")
    filled = {r.bin: (r.requests, r.errors) for r in T.filled_bins(requests(batch), 900).where("requests > 0").collect()}
    assert {r.bin: (r.requests, r.errors) for r in bins.collect()} == filled
    keyed = streams.events(spark, d, 1).selectExpr("ts", "CAST(value AS string) AS key")
    assert streams.drain(streams.first_deliveries(keyed, "1 day"), "append").count() == 11


def test_a_retried_batch_writes_once(spark, tmp_path):
    for _ in range(2):
        streams.write_batch(spark.range(3), 7, str(tmp_path / "out"))
    streams.write_batch(spark.range(2), 8, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("batch").count().orderBy("batch").collect() == [(7, 3), (8, 2)]


def test_receipts_and_ledger(spark, monkeypatch):
    rows = [(1, "k", "a"), (2, "k", "a"), (3, "k", "b"), (4, "j", None), (5, "j", None)]
    got = T.receipts(spark.createDataFrame(rows, "event_id long, key string, payload_hash string")).collect()
    assert sorted(map(tuple, got)) == [("j", 4, "ACCEPTED", 1), ("j", 4, "REPLAY", 1), ("k", 1, "ACCEPTED", 1), ("k", 1, "CONFLICT", 1), ("k", 1, "REPLAY", 1)]
    monkeypatch.setattr(T, "LEDGER_BUCKET", 3)
    entries = spark.createDataFrame([(i, "a" if i % 4 else "b", float(i)) for i in range(20)], "seq long, account string, amount double")
    totals = {r.seq: (r.total, r.accepted) for r in T.ledger(entries, 30.0).collect()}
    run = {"a": 0.0, "b": 0.0}
    for i in range(20):
        run["a" if i % 4 else "b"] += i
        assert totals[i] == (run["a" if i % 4 else "b"], run["a" if i % 4 else "b"] <= 30.0)
