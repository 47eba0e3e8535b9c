"""Checks of records as they arrive: they keep no state, so the batch functions run on streams unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from darkslide.operators.checks import datetime_findings, failing


def findings_stream(records: DataFrame, keep: tuple[str, ...] = ("source_file",)) -> DataFrame:
    """Failing records of a stream of (keep, tags MAP<STRING, STRING>) with their findings."""
    return failing(datetime_findings(records, keep=keep))


def write_findings(records: DataFrame, path: str, checkpoint: str, keep: tuple[str, ...] = ("source_file",)) -> StreamingQuery:
    """Appends findings to a parquet table, all that is there, then stops; exactly once by the checkpoint."""
    flat = findings_stream(records, keep).select(*keep, F.inline("findings"))
    return flat.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def severity_counts(findings: DataFrame, time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Findings by severity and window of arrival, rows later than late left out, of a stream with an event time."""
    return findings.withWatermark(time, late).select(time, F.inline("findings")).groupBy(F.window(time, window), "severity").agg(F.count("*").alias("findings"))
