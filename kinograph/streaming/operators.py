"""The counted and stateful operators on unbounded input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinograph.operators.interactions import coded_rows


def tumbling_counts(events: DataFrame, length: str = "30 seconds", late: str = "10 minutes", time: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """``start, by, events`` of each window, final once no row of it can come within ``late``; later rows are dropped."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), *by).agg(F.count("*").alias("events"))
    return counted.select(F.col("w.start").alias("start"), *by, "events")


def trailing_throughput(events: DataFrame, length: str = "180 seconds", slide: str = "10 seconds", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """``start, events`` of overlapping windows: the rows of the last ``length`` at each ``slide``."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, length, slide).alias("w")).agg(F.count("*").alias("events"))
    return counted.select(F.col("w.start").alias("start"), "events")


def sessions(events: DataFrame, gap: str, key: str, late: str = "1 hour", time: str = "ts") -> DataFrame:
    counted = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return counted.select(key, F.col("w.start").alias("start"), "events")


def usable_interactions(events: DataFrame, late: str = "14 days") -> DataFrame:
    """Coded rows without repeated deliveries of a user, item and timestamp that come within ``late`` of each other."""
    rows = coded_rows(events).withColumn("at", F.timestamp_millis("ts"))
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["user", "item", "ts"])


def last_events(rows: DataFrame, length: int = 13) -> DataFrame:
    """``user, events, kept``: with each batch, of its users, all rows seen so far and the last ``length`` as ``ts:event_id:item``.

    The state of a user holds ``length`` rows at most, whatever the user's activity.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, kept = state.get if state.exists else (0, "")
        held = [tuple(map(int, r.split(":"))) for r in kept.split(",") if r]
        for part in parts:
            seen += len(part)
            held = sorted({*held, *zip(part["ts"], part["event_id"], part["item"], strict=True)})[-length:]
        text = ",".join(":".join(map(str, r)) for r in held)
        state.update((seen, text))
        yield pd.DataFrame({"user": [key[0]], "events": [seen], "kept": [text]})

    return rows.groupBy("user").applyInPandasWithState(update, "user long, events long, kept string", "events long, kept string", "update", GroupStateTimeout.NoTimeout)


def upsert_batches(rows: DataFrame, keys: list[str], order: list[str], write) -> object:
    """Starts a query that reduces each batch to the last row per key and gives it to ``write(batch, number)``.

    ``write`` should replace the rows of these keys; a batch that is repeated after a failure has the same number.
    """
    from kinograph.operators.outcomes import latest

    return rows.writeStream.foreachBatch(lambda batch, number: write(latest(batch, keys, order), number)).start()
