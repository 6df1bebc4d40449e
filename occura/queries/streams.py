"""Registered queries: streams drained into tables, checked against the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from occura.queries import telemetry
from occura.registry import Registry
from occura.streaming import streams as S

register = Registry()
_SQL = telemetry.register.oracles
register("stream_rate_per_minute", _SQL["rate_per_minute"])(lambda spark, d: S.stream_rate_per_minute(spark, d, telemetry.as_requests))
for _name, _width in telemetry.T.BIN_SECONDS.items():
    register(f"stream_traffic_bins_{_name}", f"WITH {telemetry._REQ} SELECT sec // {_width} AS bin, count(*) AS requests, count(*) FILTER (status >= 500) AS errors FROM r GROUP BY 1")(
        lambda spark, d, w=_width: S.stream_traffic_bins(spark, d, telemetry.as_requests, w)
    )
register("stream_dedup_receipts", "SELECT count(DISTINCT CAST(user_id AS VARCHAR) || ':' || CAST(floor(value / 5) AS BIGINT)) AS keys FROM events")(
    lambda spark, d: S.drain(S.first_deliveries(telemetry.as_deliveries(S.events(spark, d), "ts"), "60 days").select("key"), "append").agg(F.count("*").alias("keys"))
)
register("stream_receipts", _SQL["idempotent_receipts"])(lambda spark, d: S.receipts(telemetry.as_deliveries(S.events(spark, d))))
register("stream_state_fold", _SQL["user_state_fold"])(lambda spark, d: S.folded_state(telemetry.as_reviews(S.events(spark, d))))
register("stream_peak_qps", _SQL["peak_qps"])(lambda spark, d: S.peak_per_second(telemetry.as_requests(S.events(spark, d))))
register("stream_visitor_upsert", _SQL["visitor_upsert"])(
    lambda spark, d: S.newest_per_key(telemetry.as_requests(S.events(spark, d)).select("visitor_id", "created_at", "event_id", "ip", "status"), "visitor_id", ["created_at", "event_id"])
)
