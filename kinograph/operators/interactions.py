"""The interaction log: usable rows and distinct (user, item) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinograph.functions.ids import id_code


def positive_timestamp() -> Column:
    return F.col("timestamp").cast("bigint")


def coded_rows(events: DataFrame) -> DataFrame:
    """``user, item, ts, event_id`` (BIGINT) of the rows whose ids are ids and whose timestamp is greater than 0.

    Rows delivered twice are still there. Nulls, blanks and malformed ids drop the row; extra columns are ignored.
    """
    return events.select(
        id_code("user_id").alias("user"), id_code("item_id").alias("item"), positive_timestamp().alias("ts"), F.col("event_id").cast("bigint").alias("event_id")
    ).where("user IS NOT NULL AND item IS NOT NULL AND ts > 0")


def usable_rows(events: DataFrame) -> DataFrame:
    """``coded_rows`` with one row, the one of the smallest event_id, for each user, item and timestamp.

    The shuffle is on all three columns, so neither a hot user nor a hot item makes a large task.
    """
    return coded_rows(events).groupBy("user", "item", "ts").agg(F.min("event_id").alias("event_id"))


def user_items(events: DataFrame) -> DataFrame:
    """Distinct ``user, item`` of the usable rows, combined before and after the shuffle on both columns."""
    return coded_rows(events).select("user", "item").distinct()
