"""Maps as a stream: statistics of points as they arrive, and each new map processed as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def phase_counts(points: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """(window start, phase, points) over a stream of points with an event time; rows later than `late` are dropped."""
    return points.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "phase").agg(F.count("*").alias("points")).select(F.col("w.start").alias("start"), "phase", "points")


def each_batch(points: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands every micro-batch of new points to `process`; progress is kept in `checkpoint`."""
    return points.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
