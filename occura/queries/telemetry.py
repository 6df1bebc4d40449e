"""Registered queries: traffic, quotas, event state. The ``events`` table is the stream in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from occura import corpus
from occura.operators import telemetry as T
from occura.registry import Registry

register = Registry()
_REQ = """r AS (SELECT event_id, user_id AS visitor_id, CASE WHEN user_id % 20 = 0 THEN 'unknown' ELSE '10.0.0.' || (user_id % 50) END AS ip, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
  value AS duration_ms, event_type = 'view' AS page_view, ts AS created_at, floor(epoch_us(ts) / 1000000.0)::BIGINT AS sec FROM events)"""
_STATE = """e AS (SELECT event_id, user_id, event_id % 7 AS item, CASE event_type WHEN 'view' THEN 'UNSEEN' WHEN 'error' THEN 'WEAK' WHEN 'click' THEN 'REVIEWED' WHEN 'purchase' THEN 'MASTERED' END AS status,
  CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) AS BIGINT) END AS score, ts FROM events WHERE event_type <> 'signup')"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    return as_requests(corpus.scan(spark, d, "events", "event_id", "user_id", "event_type", "value", "ts"))


def as_requests(events: DataFrame) -> DataFrame:
    """Events read as requests of a visitor."""
    ip = F.when(F.col("user_id") % 20 == 0, "unknown").otherwise(F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string")))
    return events.select(
        "event_id", F.col("user_id").alias("visitor_id"), ip.alias("ip"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.col("value").alias("duration_ms"), (F.col("event_type") == "view").alias("page_view"), F.col("ts").alias("created_at"),
    )


def reviews(spark: SparkSession, d: str) -> DataFrame:
    return as_reviews(corpus.scan(spark, d, "events", "event_id", "user_id", "event_type", "value", "ts"))


def as_reviews(events: DataFrame) -> DataFrame:
    """Events read as study reviews of seven items."""
    status = F.lit(None).cast("string")
    for kind, s in T.STATUS.items():
        status = F.when(F.col("event_type") == kind, s).otherwise(status)
    return events.where("event_type <> 'signup'").select(
        "event_id", "user_id", (F.col("event_id") % 7).alias("item"), status.alias("status"), F.when(F.col("event_id") % 3 == 0, F.floor("value")).cast("long").alias("score"), "ts"
    )


register("traffic_overview", f"""WITH {_REQ} SELECT count(*) AS requests, count(DISTINCT visitor_id) AS visitors, count(DISTINCT CASE WHEN ip <> 'unknown' THEN ip END) AS ips, count(*) FILTER (page_view) AS page_views,
    count(*) FILTER (status >= 500) AS errors, round(CAST(count(*) FILTER (status >= 500) AS DOUBLE) / count(*), 6) AS error_rate, quantile_disc(duration_ms, 0.95) AS p95_ms FROM r""")(lambda spark, d: T.overview(requests(spark, d)))
for _w, _s in T.BIN_SECONDS.items():
    register(
        f"traffic_bins_{_w}",
        f"""WITH {_REQ}, b AS (SELECT min(sec) AS lo, max(sec) AS hi FROM r), c AS (SELECT sec // {_s} AS bin, count(*) AS requests, count(*) FILTER (status >= 500) AS errors FROM r GROUP BY 1)
        SELECT g.bin, coalesce(requests, 0) AS requests, coalesce(errors, 0) AS errors, round(coalesce(requests, 0) / CAST(greatest(1, least(hi, (g.bin + 1) * {_s}) - greatest(lo, g.bin * {_s})) AS DOUBLE), 6) AS qps
        FROM b, LATERAL (SELECT unnest(range(lo // {_s}, hi // {_s} + 1)) AS bin) g LEFT JOIN c ON c.bin = g.bin""",
    )(lambda spark, d, s=_s: T.filled_bins(requests(spark, d), s))
register("peak_qps", f"WITH {_REQ} SELECT max(n) AS peak_qps FROM (SELECT sec, count(*) AS n FROM r GROUP BY 1)")(lambda spark, d: T.peak_per_second(requests(spark, d)))
register("p95_nearest_rank", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")(
    lambda spark, d: corpus.scan(spark, d, "events", "event_type", "value").groupBy("event_type").agg(T.percentile("value", 0.5).alias("p50"), T.percentile("value", 0.95).alias("p95"))
)
register("rate_per_minute", f"WITH {_REQ} SELECT ip, sec // 60 AS minute, count(*) AS used FROM r GROUP BY ALL")(lambda spark, d: T.rate_per_minute(requests(spark, d)))
register(
    "daily_quota_beijing",
    f"""WITH {_REQ}, k AS (SELECT 'DEVICE' AS scope, CAST(visitor_id AS VARCHAR) AS principal, created_at FROM r UNION ALL SELECT 'IP', ip, created_at FROM r)
    SELECT scope, principal, strftime(created_at + INTERVAL 8 HOURS, '%Y-%m-%d') AS day, count(*) AS used FROM k GROUP BY ALL""",
)(lambda spark, d: T.daily_quota(requests(spark, d)))
register("retention_cutoff", f"WITH {_REQ} SELECT event_id, visitor_id FROM r WHERE created_at >= (SELECT max(created_at) FROM r) - INTERVAL 7 DAYS")(lambda spark, d: T.retained(requests(spark, d), 7).select("event_id", "visitor_id"))
register("visitor_upsert", f"WITH {_REQ} SELECT visitor_id, created_at, event_id, ip, status FROM r QUALIFY row_number() OVER (PARTITION BY visitor_id ORDER BY created_at DESC, event_id DESC) = 1")(
    lambda spark, d: T.latest_per_key(requests(spark, d).select("visitor_id", "created_at", "event_id", "ip", "status"), "visitor_id", ["created_at", "event_id"])
)
register(
    "idempotent_receipts",
    """WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) || ':' || CAST(floor(value / 5) AS BIGINT) AS key, md5(event_type) AS h FROM events),
    f AS (SELECT *, first_value(event_id) OVER w AS first_event, first_value(h) OVER w AS first_hash FROM e WINDOW w AS (PARTITION BY key ORDER BY event_id))
    SELECT key, first_event, CASE WHEN event_id = first_event THEN 'ACCEPTED' WHEN h = first_hash THEN 'REPLAY' ELSE 'CONFLICT' END AS outcome, count(*) AS deliveries FROM f GROUP BY ALL""",
)(lambda spark, d: T.receipts(as_deliveries(corpus.scan(spark, d, "events", "event_id", "user_id", "event_type", "value"))))


def as_deliveries(events: DataFrame, *more: str) -> DataFrame:
    """Events read as requests under an idempotency key, with more columns if named."""
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.floor(F.col("value") / 5).cast("string"))
    return events.select("event_id", key.alias("key"), F.md5(F.col("event_type").cast("binary")).alias("payload_hash"), *more)


register(
    "user_state_fold",
    f"""WITH {_STATE} SELECT user_id, item, arg_max(status, (ts, event_id)) AS status, count(*) FILTER (status <> 'UNSEEN') AS review_count, count(*) AS version,
    arg_max(score, (ts, event_id)) FILTER (score IS NOT NULL) AS last_score, max(ts) FILTER (status <> 'UNSEEN') AS last_reviewed_at FROM e GROUP BY ALL""",
)(lambda spark, d: T.folded_state(reviews(spark, d)))
register("turn_sequence", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")(lambda spark, d: _sequence(spark, d))


def _sequence(spark: SparkSession, d: str) -> DataFrame:
    e = corpus.scan(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    return T.numbered(e, "user_id", ["ts", "event_id"], "event_type", F.to_date("ts")).select("event_id", "user_id", "sequence", "previous")


register("conversation_titles", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS title, count(*) AS turns, max(ts) AS last_turn FROM events GROUP BY 1")(
    lambda spark, d: corpus.scan(spark, d, "events", "event_id", "user_id", "ts", "event_type").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("title"), F.count("*").alias("turns"), F.max("ts").alias("last_turn"))
)
register("event_sessions", """WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTES OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS events FROM n GROUP BY user_id, k""")(lambda spark, d: T.sessions(corpus.scan(spark, d, "events", "user_id", "ts")))  # fmt: skip
register("budget_ledger", """SELECT event_id, account, total, total <= 500 AS accepted FROM (SELECT event_id, user_id AS account, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS total FROM events)""")(
    lambda spark, d: T.ledger(corpus.scan(spark, d, "events", "event_id", "user_id", "value").toDF("seq", "account", "amount"), 500.0).select(F.col("seq").alias("event_id"), "account", "total", "accepted")
)
_SETTLED = "e AS (SELECT user_id AS account, event_id AS request, value AS reserved, CASE WHEN event_type = 'purchase' THEN value / 2 END AS actual FROM events)"
register("budget_settled", f"""WITH {_SETTLED} SELECT account, round(sum(reserved), 6) AS reserved, round(sum(coalesce(actual, 0)), 6) AS settled, round(sum(CASE WHEN actual IS NULL THEN reserved ELSE 0 END), 6) AS open FROM e GROUP BY 1""")(
    lambda spark, d: T.settled(corpus.scan(spark, d, "events", "event_id", "user_id", "event_type", "value").select(
        F.col("user_id").alias("account"), F.col("event_id").alias("request"), F.col("value").alias("reserved"), F.when(F.col("event_type") == "purchase", F.col("value") / 2).alias("actual")))
)
register("lease_outcomes", """WITH n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following, (SELECT max(ts) FROM events) AS newest FROM events)
    SELECT event_id, CASE WHEN following <= ts + INTERVAL 600 SECONDS THEN 'RENEWED' WHEN coalesce(following, newest) > ts + INTERVAL 600 SECONDS THEN 'INTERRUPTED' ELSE 'RUNNING' END AS outcome FROM n""")(
    lambda spark, d: T.lease_outcomes(corpus.scan(spark, d, "events", "event_id", "user_id", "ts"), "user_id", "ts", "event_id", 600).select("event_id", "outcome")
)
register("trial_quota", """WITH f AS (SELECT user_id, CAST(floor(value / 5) AS BIGINT) AS request, min((ts, event_id)) AS first FROM events GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first, request) AS place FROM f)
    SELECT user_id, request, place, place <= 3 AS admitted FROM p""")(
    lambda spark, d: T.within_quota(corpus.scan(spark, d, "events", "event_id", "user_id", "ts", "value").withColumn("request", F.floor(F.col("value") / 5)), "user_id", "request", ["ts", "event_id"], 3)
)
register("login_throttle", f"WITH {_REQ} SELECT *, used > CASE kind WHEN 'ADMIN' THEN 5 ELSE 10 END AS refused FROM (SELECT kind, ip, sec // 60 AS minute, count(*) AS used FROM (SELECT *, CASE WHEN visitor_id % 10 = 0 THEN 'ADMIN' ELSE 'ACCOUNT' END AS kind FROM r) GROUP BY ALL)")(
    lambda spark, d: T.throttled(requests(spark, d).withColumn("kind", F.when(F.col("visitor_id") % 10 == 0, "ADMIN").otherwise("ACCOUNT")), {"ADMIN": 5, "ACCOUNT": 10})
)
register("session_purge", """WITH s AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1) SELECT user_id, last_seen, last_seen < (SELECT max(ts) FROM events) - INTERVAL 7 DAYS AS expired FROM s""")(
    lambda spark, d: T.expired(corpus.scan(spark, d, "events", "user_id", "ts"), "user_id", "ts", 7)
)
