"""Event-log analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def with_context(logs: DataFrame) -> DataFrame:
    """Non-null command, page, integration joined by ', '."""
    return logs.withColumn("context", F.concat_ws(", ", "command", "page", "integration"))


def recent(logs: DataFrame, n: int, errors_only: bool = False) -> DataFrame:
    """The n newest entries (id breaks timestamp ties).

    orderBy + limit plans as TakeOrderedAndProject: each task keeps its own
    top n and only n rows per task reach the final merge.
    """
    if errors_only:
        logs = logs.where(F.col("error_message").isNotNull())
    return (with_context(logs)
            .orderBy(F.col("timestamp").desc(), F.col("id").desc())
            .limit(n)
            .select("id", "timestamp", "entry_point", "event", "context", "error_message"))


def stats(logs: DataFrame) -> DataFrame:
    """Totals; the error count is exact (no cap)."""
    return logs.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(F.col("error_message").isNotNull()).alias("error_count"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )


def event_counts(logs: DataFrame) -> DataFrame:
    """Entries per event and entry point."""
    return logs.groupBy("event", "entry_point").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("error_message").isNotNull()).alias("errors"))


def retain(logs: DataFrame, as_of_ms: int, days: int = 30) -> DataFrame:
    """The log after deleting entries older than the cut-off; where the log carries
    its time as stored (`ts`), the comparison is on that column and reaches the scan."""
    if "ts" in logs.columns:
        cut = F.timestamp_millis(F.lit(as_of_ms - days * DAY_MS)).cast("timestamp_ntz")
        return logs.where(F.col("ts") >= cut)
    return logs.where(F.col("timestamp") >= F.lit(as_of_ms - days * DAY_MS))
