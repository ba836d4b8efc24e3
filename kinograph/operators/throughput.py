"""Counts over time: trailing windows, tumbling and sliding windows, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trailing_counts(events: DataFrame, seconds: int = 180, time: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """``by, second, events, trailing``: rows of each second with any, and rows of the ``seconds`` up to and including it.

    Rows are counted per second first. Each second is put into the span of ``seconds`` it lies in and the next one, and the
    frame runs within a span, so no window holds more than two spans, however long the log is.
    """
    second = F.unix_seconds(F.col(time).cast("timestamp")).alias("second")
    counts = events.where(F.col(time).isNotNull()).groupBy(*by, second).agg(F.count("*").alias("events"))
    own = F.floor(F.col("second") / seconds)
    placed = counts.withColumn("own", own).withColumn("span", F.explode(F.array(own, own + 1)))
    frame = W.partitionBy(*by, "span").orderBy("second").rangeBetween(-(seconds - 1), 0)
    trailing = placed.withColumn("trailing", F.sum("events").over(frame)).where(F.col("own") == F.col("span"))
    return trailing.select(*by, "second", "events", "trailing")


def tumbling_counts(events: DataFrame, length: str = "30 seconds", time: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """``start, by, events`` of each window with any."""
    return events.groupBy(F.window(time, length).alias("w"), *by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), *by, "events")


def sliding_counts(events: DataFrame, length: str = "180 seconds", slide: str = "60 seconds", time: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    return events.groupBy(F.window(time, length, slide).alias("w"), *by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), *by, "events")


def session_counts(events: DataFrame, gap: str, key: str, time: str = "ts") -> DataFrame:
    """``key, start, events`` of each run of a key's rows without a gap of ``gap`` or more."""
    sessions = events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return sessions.select(key, F.col("w.start").alias("start"), "events")
