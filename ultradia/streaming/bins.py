"""The binning and session operators over streams of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ultradia.operators.readings import SOURCE
from ultradia.operators.sessions import SessionTable, local_sessions


def binned(stream: DataFrame, minutes: int = 5, late: str = "1 hour") -> DataFrame:
    """experiment_id, fly_id, bin, n, total of MT readings; bins close once the watermark has passed them. A timestamp with zone is needed for the watermark."""
    rows = stream.where((F.col("reading_type") == "MT") & F.col("value").between(0, 1000)).withWatermark("datetime", late)
    g = rows.groupBy(*SOURCE, F.window("datetime", f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(*SOURCE, F.col("w.start").alias("bin"), "n", "total")


def session_windows(stream: DataFrame, gap_s: int = 1800, late: str = "1 hour") -> DataFrame:
    """experiment_id, fly_id, session_start, session_end (end of the gap after it), n_events of readings above 0."""
    rows = stream.where((F.col("reading_type") == "MT") & F.col("value").between(1, 1000)).withWatermark("datetime", late)
    g = rows.groupBy(*SOURCE, F.session_window("datetime", f"{gap_s} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return g.select(*SOURCE, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def upserting(table: SessionTable, ts: str = "datetime", stream: str = "stream"):
    """A function for ``foreachBatch``: each micro-batch's sessions go into the session table, once, however often Spark retries it.

    Events that repeat within the batch count once; for repeats over batches give the stream ``dropDuplicatesWithinWatermark`` on keys and time.
    """
    def run(batch: DataFrame, number: int) -> None:
        events = batch.dropDuplicates([*table.keys, ts])
        table.upsert(local_sessions(events, table.keys, ts, table.gap_s), name=f"{stream}-{number}")

    return run
