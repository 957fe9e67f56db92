"""Batch forms of the streaming statistics, checked against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowdoc.plans.registry import register
from sparrowdoc.sources.tables import load
from sparrowdoc.streaming import events as S

register(
    "stream_daily_counts",
    lambda s, d: S.windowed(load(s, d, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"),
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
register(
    "stream_sessions",
    lambda s, d: S.sessions(load(s, d, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest")),
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
r AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, run, count(*) AS n FROM r GROUP BY ALL) GROUP BY user_id""",
)
