"""Streaming additions: functions are scored as they arrive, and findings are counted in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flintsieve.operators.scoring import call_sites, score_sites


def score_stream(functions: DataFrame) -> DataFrame:
    """Scored call sites of a stream of functions (fn, function, params, text); stateless, so it works for batches too."""
    return score_sites(call_sites(functions))


def window_counts(events: DataFrame, time: str = "ts", value: str = "value", high: float = 80.0, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events and high ones in tumbling windows of event time; a stream forgets windows that are later than `late`."""
    return (
        events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size)).agg(F.count("*").alias("n"), F.count_if(F.col(value) >= high).alias("n_high"))
        .select(F.col("window.start").alias("start"), "n", "n_high")
    )
