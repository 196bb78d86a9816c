"""Live adverse-event counts by severity and onset window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carestrata.sources.runs import RunLog

COUNTS = "window_start timestamp, window_end timestamp, severity string, event_count long"


def severity_windows(adverse_events: DataFrame, width: str = "7 days") -> DataFrame:
    """window_start, window_end, severity, event_count of a batch."""
    df = adverse_events.select("severity", F.col("onset_date").cast("timestamp").alias("onset_ts"))
    return (df.groupBy(F.window("onset_ts", width), "severity").agg(F.count("*").alias("event_count"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "severity", "event_count"))


def _summed(log: RunLog, runs: list[dict]) -> DataFrame:
    counts = log.spark.read.schema(COUNTS).parquet(*[log.path(r) for r in runs])
    return counts.groupBy("window_start", "window_end", "severity").agg(F.sum("event_count").alias("event_count"))


def _write(counts: DataFrame, path: str) -> dict:
    counts.write.parquet(path)
    return {}


def start_surveillance(adverse_events: DataFrame, directory: str, checkpoint: str,
                       width: str = "7 days", fan: int = 8) -> StreamingQuery:
    """Add each micro-batch's counts as a run of its own number; :func:`current` adds them up.

    Events are often reported weeks after their onset, so no window is ever closed and no state is kept. An
    update that is run again counts once. Every ``fan`` runs of a size are merged into one, so the runs to read
    grow with the logarithm of the updates, and a crash between merge and commit leaves the sums as they are.
    """
    log = RunLog(adverse_events.sparkSession, directory, fan)

    def step(batch: DataFrame, n: int) -> None:
        log.compact(lambda runs, path: _write(_summed(log, runs), path), below=n)
        log.add(n, lambda path: _write(severity_windows(batch, width), path))

    return (adverse_events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def current(spark: SparkSession, directory: str) -> DataFrame:
    """Count of every window over all updates."""
    log = RunLog(spark, directory)
    runs = log.runs()
    return _summed(log, runs) if runs else spark.createDataFrame([], COUNTS)
