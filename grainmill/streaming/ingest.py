"""Incremental ingestion, an extension: first arrivals by instruction, and windowed counts of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.curation import instruction_fingerprint, typed, validation_errors


def new_instructions(stream: DataFrame, time_col: str = "ts", lateness: str = "1 day") -> DataFrame:
    """Valid candidates whose instruction hasn't arrived within ``lateness``. The first arrival stays, not the least ordinal;
    state is bounded by the watermark. For the decisions of a full run use the batch operator."""
    valid = typed(stream).withColumn("errors", validation_errors()).where(F.size("errors") == 0).drop("errors")
    return valid.withColumn("instruction_hash", instruction_fingerprint()).withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(["instruction_hash"])


def pass_rates(stream: DataFrame, time_col: str = "ts", window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Passed and scored results by category in tumbling windows of event time."""
    timed = stream.withWatermark(time_col, lateness).where("pass is not null")
    return timed.groupBy(F.window(time_col, window), "category").agg(F.count_if("pass").alias("passed"), F.count(F.lit(1)).alias("scored"))
