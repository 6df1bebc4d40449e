"""Request telemetry and event-sourced state in batch form; the streaming package has the same over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bin widths in seconds by window, the quota's time zone, status by event.
BIN_SECONDS = {"1h": 60, "24h": 900, "7d": 3600}
WINDOW_SECONDS = {"1h": 3600, "24h": 86_400, "7d": 604_800}
QUOTA_ZONE = "Asia/Shanghai"
STATUS = {"view": "UNSEEN", "error": "WEAK", "click": "REVIEWED", "purchase": "MASTERED"}


def seconds(column: str) -> F.Column:
    """Whole epoch seconds of a timestamp (with or without zone)."""
    return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / 1_000_000)


def percentile(column: str, p: float) -> F.Column:
    """Nearest-rank percentile."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def overview(requests: DataFrame) -> DataFrame:
    """One row of traffic figures; the unknown address is no address."""
    n = lambda c: F.count(F.when(c, 1))
    return requests.agg(
        F.count("*").alias("requests"), F.countDistinct("visitor_id").alias("visitors"), F.countDistinct(F.when(F.col("ip") != "unknown", F.col("ip"))).alias("ips"), n(F.col("page_view")).alias("page_views"),
        n(F.col("status") >= 500).alias("errors"), F.round(F.try_divide(n(F.col("status") >= 500), F.count("*")), 6).alias("error_rate"), percentile("duration_ms", 0.95).alias("p95_ms"),
    )


def filled_bins(requests: DataFrame, width: int) -> DataFrame:
    """(bin, requests, errors, qps) of every bin between the first and last request, empty ones too.

    The calendar is a sequence of bin numbers, not a scan; the first and last bin use their actual length.
    """
    at = seconds("created_at")
    bounds = requests.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    counts = requests.groupBy(F.floor(at / width).alias("bin")).agg(F.count("*").alias("requests"), F.count(F.when(F.col("status") >= 500, 1)).alias("errors"))
    calendar = bounds.where("lo IS NOT NULL").select("lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("bin"))
    span = F.greatest(F.lit(1), F.least("hi", (F.col("bin") + 1) * width) - F.greatest("lo", F.col("bin") * width))
    zero = F.lit(0).cast("long")
    return calendar.join(counts, "bin", "left").select("bin", F.coalesce("requests", zero).alias("requests"), F.coalesce("errors", zero).alias("errors"), F.round(F.coalesce("requests", zero) / span, 6).alias("qps"))


def peak_per_second(requests: DataFrame) -> DataFrame:
    return requests.groupBy(seconds("created_at").alias("s")).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("peak_qps"))


def rate_per_minute(requests: DataFrame) -> DataFrame:
    return requests.groupBy("ip", F.floor(seconds("created_at") / 60).alias("minute")).agg(F.count("*").alias("used"))


def daily_quota(requests: DataFrame) -> DataFrame:
    """(scope, principal, day, used) by device and address, days counted in the quota's zone."""
    day = F.date_format(F.from_utc_timestamp(F.col("created_at").cast("timestamp"), QUOTA_ZONE), "yyyy-MM-dd")
    principals = F.explode(F.array(F.struct(F.lit("DEVICE").alias("scope"), F.col("visitor_id").cast("string").alias("principal")), F.struct(F.lit("IP").alias("scope"), F.col("ip").alias("principal"))))
    return requests.select(principals.alias("p"), day.alias("day")).groupBy("p.scope", "p.principal", "day").agg(F.count("*").alias("used"))


def retained(requests: DataFrame, days: int) -> DataFrame:
    """Rows of the last ``days`` days before the newest row."""
    newest = requests.agg(F.max("created_at").alias("newest"))
    return requests.join(F.broadcast(newest)).where(F.col("created_at") >= F.col("newest") - F.expr(f"INTERVAL {days} DAYS")).drop("newest")


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest whole row of each key, by partial aggregation."""
    rest = [c for c in df.columns if c not in (key, *order)]
    return df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("r")).select(key, "r.*")


def receipt_parts(events: DataFrame) -> DataFrame:
    """(key, payload_hash, first_event, deliveries): a part of the receipts; parts of any split of the events can be merged."""
    return events.groupBy("key", "payload_hash").agg(F.min("event_id").alias("first_event"), F.count("*").alias("deliveries"))


def merged_receipts(parts: DataFrame) -> DataFrame:
    """(key, first_event, outcome, deliveries) from parts: the first delivery of a key counts; another with the same
    payload is a replay, one with another payload a conflict. A key's payloads are counted, its deliveries never sorted."""
    each = parts.groupBy("key", "payload_hash").agg(F.min("first_event").alias("first_event"), F.sum("deliveries").alias("n"))
    first = each.groupBy("key").agg(F.min(F.struct("first_event", "payload_hash")).alias("first"))
    known = each.join(first, "key").withColumn("same", F.col("payload_hash").eqNullSafe(F.col("first.payload_hash")))
    row = lambda outcome, n: F.struct(F.lit(outcome).alias("outcome"), n.cast("long").alias("n"))
    outcomes = F.when(F.col("same"), F.array(row("ACCEPTED", F.lit(1)), row("REPLAY", F.col("n") - 1))).otherwise(F.array(row("CONFLICT", F.col("n"))))
    counted = known.select("key", F.col("first.first_event").alias("first_event"), F.explode(outcomes).alias("o")).where("o.n > 0")
    return counted.groupBy("key", "first_event", "o.outcome").agg(F.sum("o.n").alias("deliveries"))


def receipts(events: DataFrame) -> DataFrame:
    """(key, first_event, outcome, deliveries) of all events, each with a distinct event_id."""
    return merged_receipts(receipt_parts(events))


_STATE = ("seen", "scored", "review_count", "version", "last_reviewed_at")


def state_parts(events: DataFrame) -> DataFrame:
    """A part of the folded state of (user_id, item); parts of any split of the events, in any order, can be merged."""
    review = F.col("status") != "UNSEEN"
    return events.groupBy("user_id", "item").agg(
        F.max(F.struct("ts", "event_id", "status")).alias("seen"), F.max(F.when(F.col("score").isNotNull(), F.struct("ts", "event_id", "score"))).alias("scored"),
        F.count(F.when(review, 1)).alias("review_count"), F.count("*").alias("version"), F.max(F.when(review, F.col("ts"))).alias("last_reviewed_at"),
    )


def merged_state(parts: DataFrame) -> DataFrame:
    """One part for each (user_id, item) from several."""
    how = {"seen": F.max, "scored": F.max, "review_count": F.sum, "version": F.sum, "last_reviewed_at": F.max}
    return parts.groupBy("user_id", "item").agg(*[how[c](c).alias(c) for c in _STATE])


def folded_state(events: DataFrame) -> DataFrame:
    """(user_id, item, status, review_count, version, last_score, last_reviewed_at) after all events, in order.

    Every event sets the status and raises the version; all but UNSEEN count as reviews and move the review time
    forward; a score stays until another is given.
    """
    return state_of(state_parts(events))


def state_of(part: DataFrame) -> DataFrame:
    return part.select("user_id", "item", "seen.status", "review_count", "version", F.col("scored.score").alias("last_score"), "last_reviewed_at")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, session_start, session_end, events): runs of events without a longer gap."""
    out = events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


#: Sequence numbers of one bucket of a ledger: an account of any length is summed bucket by bucket.
LEDGER_BUCKET = 10_000


def ledger(entries: DataFrame, cap: float) -> DataFrame:
    """Adds the running total and whether an entry is still within the cap, per account in order of ``seq``.

    A rejected entry keeps its place in the total, as a reservation of unknown usage does. An account's entries are
    sorted within buckets of sequence numbers only; what lies before a bucket comes from the buckets' sums.
    """
    rows = entries.withColumn("bucket", F.floor(F.col("seq") / LEDGER_BUCKET))
    upto = Window.partitionBy("account").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("account", "bucket").agg(F.sum("amount").alias("in_bucket")).withColumn("before", F.coalesce(F.sum("in_bucket").over(upto), F.lit(0.0))).drop("in_bucket")
    within = Window.partitionBy("account", "bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.round(F.col("before") + F.sum("amount").over(within), 6)
    return rows.join(sums, ["account", "bucket"]).withColumn("total", total).withColumn("accepted", F.col("total") <= cap).drop("bucket", "before")


def settled(entries: DataFrame) -> DataFrame:
    """(account, reserved, settled, open): what was reserved, what is known to be used, and what still counts as reserved.

    ``entries``: account, request, reserved, actual. A request settles with its actual amount; while that is unknown
    its reservation keeps counting.
    """
    per = entries.groupBy("account", "request").agg(F.max("reserved").alias("reserved"), F.max("actual").alias("actual"))
    known = F.col("actual").isNotNull()
    return per.groupBy("account").agg(
        F.round(F.sum("reserved"), 6).alias("reserved"), F.round(F.sum(F.when(known, F.col("actual")).otherwise(0.0)), 6).alias("settled"),
        F.round(F.sum(F.when(known, 0.0).otherwise(F.col("reserved"))), 6).alias("open"),
    )


def numbered(events: DataFrame, key: str, order: list[str], value: str, bucket: Column) -> DataFrame:
    """Adds ``sequence`` and ``previous`` (the value before) per key in ``order``; ``bucket`` cuts the order in runs, which
    alone are sorted, so that a key of any length is never one task's work."""
    rows = events.withColumn("bucket", bucket)
    by = Window.partitionBy(key).orderBy("bucket")
    runs = rows.groupBy(key, "bucket").agg(F.count("*").alias("n"), F.max(F.struct(*order, value)).alias("last"))
    runs = runs.select(key, "bucket", F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lag(f"last.{value}").over(by).alias("ahead"))
    w = Window.partitionBy(key, "bucket").orderBy(*order)
    place = F.row_number().over(w)
    out = rows.withColumn("place", place).withColumn("lagged", F.lag(value).over(w)).join(runs, [key, "bucket"])
    previous = F.when(F.col("place") == 1, F.col("ahead")).otherwise(F.col("lagged"))
    return out.withColumn("sequence", (F.col("before") + F.col("place")).cast("long")).withColumn("previous", previous).drop("bucket", "place", "lagged", "before", "ahead")


def lease_outcomes(events: DataFrame, key: str, at: str, ident: str, seconds_held: int) -> DataFrame:
    """Adds ``outcome`` to every heartbeat: RENEWED if its key's next one came within the lease, INTERRUPTED if the
    lease ended first, RUNNING if it had not ended at the newest event of all."""
    newest = events.agg(F.max(at).alias("newest"))
    by = Window.partitionBy(key).orderBy(at, ident)
    ends = F.col(at) + F.make_dt_interval(secs=F.lit(seconds_held))
    out = events.withColumn("following", F.lead(at).over(by)).join(F.broadcast(newest)).withColumn("ends", ends)
    outcome = F.when(F.col("following") <= F.col("ends"), "RENEWED").when(F.coalesce("following", "newest") > F.col("ends"), "INTERRUPTED").otherwise("RUNNING")
    return out.withColumn("outcome", outcome).drop("following", "newest", "ends")


def within_quota(attempts: DataFrame, principal: str, request: str, order: list[str], limit: int) -> DataFrame:
    """(principal, request, place, admitted): each distinct request counts once, at its first attempt; the first ``limit``
    of a principal are admitted, and a repeated attempt gets the answer of the first."""
    first = attempts.groupBy(principal, request).agg(F.min(F.struct(*order)).alias("first"))
    w = Window.partitionBy(principal).orderBy("first", request)
    return first.withColumn("place", F.row_number().over(w).cast("long")).select(principal, request, "place", (F.col("place") <= limit).alias("admitted"))


def throttled(requests: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(kind, ip, minute, used, refused): requests of a kind and address in a minute, and whether they were too many."""
    limit = F.lit(None).cast("int")
    for kind, n in limits.items():
        limit = F.when(F.col("kind") == kind, n).otherwise(limit)
    per = requests.groupBy("kind", "ip", F.floor(seconds("created_at") / 60).alias("minute")).agg(F.count("*").alias("used"))
    return per.withColumn("refused", F.col("used") > limit)


def expired(sessions_seen: DataFrame, key: str, at: str, days: int) -> DataFrame:
    """(key, last_seen, expired): sessions not seen for ``days`` days before the newest event."""
    newest = sessions_seen.agg(F.max(at).alias("newest"))
    per = sessions_seen.groupBy(key).agg(F.max(at).alias("last_seen"))
    return per.join(F.broadcast(newest)).select(key, "last_seen", (F.col("last_seen") < F.col("newest") - F.expr(f"INTERVAL {days} DAYS")).alias("expired"))
