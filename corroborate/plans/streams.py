"""Queries that run through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corroborate.streaming.windows import event_stream, run_once, windowed_counts


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows that end an hour or more before the newest event: later ones may still change."""
    return run_once(windowed_counts(event_stream(spark, d)))


QUERIES = {"event_windows": event_windows}
SQL = {
    "event_windows": """SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, sum(value::DECIMAL(28,6)) AS total
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2
HAVING start + INTERVAL '6 hours' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'""",
}
