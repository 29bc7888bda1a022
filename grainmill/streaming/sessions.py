"""Events in time, in batches and as streams: sessions between gaps, and tasks with the results that came in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OWN = ("first_ts", "last_ts", "n", "n_errors", "highest")


def _totals(ts: str) -> list[Column]:
    return [F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.max("value").alias("highest")]


def event_sessions(events: DataFrame, gap_seconds: int = 1800, chunk_hours: int = 24, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, first_ts, last_ts, n, n_errors, highest) for each session of a key: events no further than the gap from the one before.

    Sessions are found within chunks of time, so that a key with very many events is many groups; only the first and the last session
    of a chunk, which may go on in another one, meet the others of their key. Events without a time are in no session; those without
    a key are one key's. ``value`` may be null; a session without values has none.
    """
    gap = F.expr(f"INTERVAL {gap_seconds} SECONDS")
    chunk = F.floor((F.unix_date(F.to_date(F.col(ts))) * 24 + F.hour(ts)) / chunk_hours)
    timed = events.where(F.col(ts).isNotNull()).select(F.struct(F.col(key).alias("k")).alias("_k"), chunk.alias("_c"), F.col(ts).alias("_ts"), "event_type", "value")
    by = Window.partitionBy("_k", "_c").orderBy("_ts")
    opens = F.coalesce(F.col("_ts") - F.lag("_ts").over(by) > gap, F.lit(False)).cast("long")
    timed = timed.withColumn("_new", opens)
    numbered = timed.withColumn("_s", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy("_k", "_c", "_s").agg(*_totals("_ts"))
    parts = parts.withColumn("_last", F.max("_s").over(Window.partitionBy("_k", "_c")))
    edge = (F.col("_s") == 0) | (F.col("_s") == F.col("_last"))
    along = Window.partitionBy("_k").orderBy("first_ts")
    joins = parts.where(edge).withColumn("_new", F.coalesce(F.col("first_ts") - F.lag("last_ts").over(along) > gap, F.lit(False)).cast("long"))
    # an inner session lies between two edges of its chunk: those are further apart than the gap, so leaving it out joins nothing
    joined = joins.withColumn("_s", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0))).groupBy("_k", "_s").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("n"), F.sum("n_errors").alias("n_errors"), F.max("highest").alias("highest"))
    return joined.select("_k", *_OWN).unionByName(parts.where(~edge).select("_k", *_OWN)).select(F.col("_k.k").alias(key), *_OWN)


def stream_sessions(stream: DataFrame, gap_seconds: int = 1800, lateness: str = "10 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """The sessions of ``event_sessions`` from a stream, each once the watermark has passed its end (append mode). Events that come
    later than ``lateness`` and can join no open session are left out; a stream whose events are never that late gives the same
    sessions as a batch."""
    window = F.session_window(ts, f"{gap_seconds} seconds")  # windows that touch are one
    return stream.where(F.col(ts).isNotNull()).withWatermark(ts, lateness).groupBy(window, key).agg(*_totals(ts)).select(key, *_OWN)


def task_results(tasks: DataFrame, results: DataFrame, limit_seconds: int = 3600, lateness: str = "10 minutes") -> DataFrame:
    """Tasks (task, started) with their results (task, finished, pass) that came from their start to ``limit_seconds`` after it;
    a task without one has nulls. Works on tables and on streams alike.

    On streams a task waits for the watermark to pass its limit, and what waits is bounded by the limit and ``lateness``; both sides
    are joined by task and time, so no state outlives that. Tasks that are null find no result.
    """
    left, right = tasks.select(F.col("task").alias("task"), "started"), results.select(F.col("task").alias("_task"), "finished", "pass")
    if tasks.isStreaming:
        left, right = left.withWatermark("started", lateness), right.withWatermark("finished", lateness)
    in_time = (F.col("finished") >= F.col("started")) & (F.col("finished") <= F.col("started") + F.expr(f"INTERVAL {limit_seconds} SECONDS"))
    return left.join(right, (F.col("task") == F.col("_task")) & in_time, "left").drop("_task")
