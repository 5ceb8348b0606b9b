"""Streaming queries: the events table replayed as a stream and drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from insightspark.operators.alerts import recovery_filter  # noqa: F401
from insightspark.plans.registry import query
from insightspark.session import work_path
from insightspark.sources.tables import write_table
from insightspark.streaming import streams as S

N = lambda: F.count(F.lit(1))


def events_stream(t, **options):
    return S.read_stream(t.spark, t.path("events"), t.events.schema, **options)


# A window is emitted once the watermark (latest event - 2 h) has passed its end.
_CLOSED = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


@query("st1_tumbling_counts", f"""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events
GROUP BY date_trunc('hour', ts), event_type HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_CLOSED}""")
def st1(t):
    out = S.run_available(S.tumbling_counts(events_stream(t), "ts", ["event_type"], user="user_id"), "st1")
    return out.select("window_start", "event_type", "n")


@query("st2_sliding_rate", f"""
WITH e AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS ws, event_type FROM events, (SELECT unnest(range(0, 4)) AS k))
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, count(CASE WHEN event_type='error' THEN 1 END) AS hits, round(count(CASE WHEN event_type='error' THEN 1 END)/count(*), 6) AS rate FROM e GROUP BY ws HAVING ws + INTERVAL 1 HOUR <= {_CLOSED}""")
def st2(t):
    return S.run_available(S.sliding_rate(events_stream(t), "ts", F.col("event_type") == "error"), "st2")


@query("st3_session_windows", f"""
WITH p AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pt FROM events), n AS (SELECT *, sum(CASE WHEN pt IS NULL OR ts >= pt + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sn FROM p)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n_events FROM n GROUP BY user_id, sn HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}""")
def st3(t):
    return S.run_available(S.session_windows(events_stream(t), "ts", "user_id"), "st3")


@query("st4_dedup_stream", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS keys FROM events GROUP BY 1")
def st4(t):
    twice = events_stream(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = S.run_available(S.deduplicate(twice, "ts", "event_id"), "st4")
    return out.groupBy("event_type").agg(N().alias("n"), F.count_distinct("event_id").alias("keys"))


@query("st5_stream_interval_join", """
SELECT v.event_id AS view_id, p.event_id AS purchase_id, v.user_id FROM events v JOIN events p ON p.user_id = v.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR""")
def st5(t):
    e = events_stream(t)
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    buys = events_stream(t).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"))
    j = S.interval_join(views, buys, "user_id", "view_ts", "purchase_ts").select("view_id", "purchase_id", F.col("l.user_id").alias("user_id"))
    return S.run_available(j, "st5")


@query("st6_per_user_state", "SELECT user_id, count(*) AS n_events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY 1")
def st6(t):
    return S.per_user_state(events_stream(t), "user_id", "ts", "st6").drop("n_expired")


@query("st6_status_changes", f"""
WITH h AS (SELECT date_trunc('hour', ts) AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= {_CLOSED}), s AS (SELECT *, CASE WHEN n > 5 THEN 'FAIL' ELSE 'PASS' END AS st FROM h),
p AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY event_type ORDER BY w), 'PASS') AS pv FROM s)
SELECT event_type AS dim1, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, CASE WHEN st = 'FAIL' THEN 'FIRED' ELSE 'RECOVERED' END AS notice FROM p WHERE st <> pv""")
def st6b(t):
    path = work_path(t.spark, "st6b-windows")
    written = S.run_available(S.tumbling_counts(events_stream(t), "ts", ["event_type"]), "st6b-windows", out=path)
    closed = S.read_stream(t.spark, path, written.schema, ts=None)
    statuses = closed.select(F.lit("volume").alias("alert"), F.col("event_type").alias("dim1"), "window_start", F.when(F.col("n") > 5, "FAIL").otherwise("PASS").alias("status"))
    return S.run_available(S.status_changes(statuses), "st6b").select("dim1", "window_start", "notice")


@query("st7_stream_static_join", """
WITH l AS (SELECT event_type, avg(value) + 2*stddev_samp(value) AS lim FROM events GROUP BY 1) SELECT event_id, events.event_type, value FROM events JOIN l ON l.event_type = events.event_type WHERE value > lim""")
def st7(t):
    limits = t.events.groupBy("event_type").agg((F.avg("value") + 2 * F.stddev_samp("value")).alias("lim"))
    return S.run_available(S.with_thresholds(events_stream(t), limits, "event_type", "value", "lim"), "st7").select("event_id", "event_type", "value")


@query("st8_late_data")
def st8(t):
    path = work_path(t.spark, "st8-in")
    # rows are judged late by the watermark of the batch before, so two batches come first
    write_table(t.events.where("ts >= '2024-01-10' AND ts < '2024-01-20'"), path, mode="append")
    write_table(t.events.where("ts >= '2024-01-20'"), path, mode="append")
    write_table(t.events.where("ts < '2024-01-10'"), path, mode="append")
    e = S.read_stream(t.spark, path, t.events.schema, maxFilesPerTrigger=1)
    return S.dropped_late_rows(S.tumbling_counts(e, "ts", ["event_type"]), "st8")


@query("st9_alert_stream", """
WITH h AS (SELECT date_trunc('hour', ts) AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT *, CASE WHEN n < 2 THEN 'FAIL' ELSE 'PASS' END AS st FROM h), p AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY event_type ORDER BY w), 'PASS') AS pv FROM s)
SELECT 'low_volume' AS alert, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS dim1, n AS value, CASE WHEN st = 'FAIL' THEN 'FIRED' ELSE 'RECOVERED' END AS notice FROM p WHERE st <> pv""")
def st9(t):
    return S.alert_stream(events_stream(t), "ts", "event_type", "low_volume", 2)


@query("st10_dq_stream", """
SELECT 0::BIGINT AS batch_id, 'stream_rows' AS check_name, '*' AS subject, true AS ok, 'PASS' AS severity, CAST(count(*) AS DOUBLE) AS value, '>0' AS expected, NULL::VARCHAR AS detail FROM events
UNION ALL SELECT 0, 'stream_nulls', 'value', count(CASE WHEN event_id % 17 = 0 THEN 1 END) <= 0.2*count(*), 'PASS', CAST(count(CASE WHEN event_id % 17 = 0 THEN 1 END) AS DOUBLE), '0.2', CAST(count(*) AS VARCHAR) FROM events
UNION ALL SELECT 0, 'stream_nulls', 'user_id', true, 'PASS', 0.0, '0.2', CAST(count(*) AS VARCHAR) FROM events""")
def st10(t):
    e = events_stream(t).withColumn("value", F.when(F.col("event_id") % 17 != 0, F.col("value")))
    return S.quality_stream(e, "st10", ["value", "user_id"])
