"""Streaming queries over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.streaming import events as ops


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.event_stream(spark, f"{sf_dir}/events.parquet")


def _naive(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def i22_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type, from a stream."""
    return _naive(ops.run_to_end(ops.tumbling_counts(_stream(spark, sf_dir))), "start")


def i22_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by overlapping two hours and type, from a stream."""
    return _naive(ops.run_to_end(ops.sliding_counts(_stream(spark, sf_dir))), "start")


def i22_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, closed by 30 quiet minutes, from a stream."""
    return _naive(ops.run_to_end(ops.sessions(_stream(spark, sf_dir))), "start", "end")


def i19_circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each user's circuit breaker, from a stateful stream."""
    out = ops.run_to_end(ops.circuit_breaker(_stream(spark, sf_dir), failed_below=20.0), mode="update")
    return out.groupBy("user_id").agg(F.max(F.struct("calls", "opened", "blocked")).alias("s")).select("user_id", "s.calls", "s.opened", "s.blocked")


QUERIES = {f.__name__: f for f in (i22_tumbling_windows, i22_sliding_windows, i22_sessions, i19_circuit_breaker)}
SQL = {
    "i22_tumbling_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "i22_sliding_windows": "SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2",
    "i22_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
}
