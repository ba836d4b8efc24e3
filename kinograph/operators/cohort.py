"""Interaction cohorts: counts, retained sequences, leave-one-out splits, histories and popularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinograph.operators.indexing import dense_index
from kinograph.operators.interactions import coded_rows
from kinograph.session import written

MIN_EVENTS, RETAINED, HISTORY = 5, 13, 10


def interaction_log(events: DataFrame) -> DataFrame:
    """``user, item, ts, event_id`` of all well-formed rows, repeated deliveries included."""
    return coded_rows(events)


def cohort_counts(log: DataFrame) -> DataFrame:
    """One row: users, items, interactions, and rows that repeat the user, item and timestamp of another."""
    distinct = log.groupBy("user", "item", "ts").agg(F.count("*").alias("n"))
    return distinct.agg(
        F.count_distinct("user").alias("users"), F.count_distinct("item").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("interactions"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")
    )


def user_activity(log: DataFrame, min_events: int = MIN_EVENTS, length: int = RETAINED) -> DataFrame:
    """``user, events, excluded, trimmed``: users with too short a history, and the rows that longer ones lose."""
    counts = log.groupBy("user").agg(F.count("*").alias("events"))
    short = F.col("events") < min_events
    return counts.select("user", "events", short.alias("excluded"), F.when(short, 0).otherwise(F.greatest(F.col("events") - length, F.lit(0))).alias("trimmed"))


def retained_sequences(log: DataFrame, min_events: int = MIN_EVENTS, length: int = RETAINED) -> DataFrame:
    """The last ``length`` rows of each user with at least ``min_events``, by timestamp, then event_id.

    Adds ``position`` (0-based in the kept sequence, the number of rows before) and ``back`` (1 for the last). The limit is
    applied before the shuffle too, so a user of any activity sends at most ``length`` rows from each task.
    """
    if length < min_events:
        raise ValueError("the retained length must not be below the least number of events")
    latest = W.partitionBy("user").orderBy(F.desc("ts"), F.desc("event_id"))
    recent = log.withColumn("back", F.row_number().over(latest)).where(F.col("back") <= length)
    counted = recent.withColumn("kept", F.count("*").over(W.partitionBy("user"))).where(F.col("kept") >= min_events)
    return counted.select("user", "item", "ts", "event_id", "back", (F.col("kept") - F.col("back")).alias("position"))


def leave_one_out(retained: DataFrame) -> DataFrame:
    """Adds ``phase``: ``test`` for each user's last row, ``validation`` for the one before, ``train`` for the rest."""
    phase = F.when(F.col("back") == 1, "test").when(F.col("back") == 2, "validation").otherwise("train")
    return retained.withColumn("phase", phase)


def split_summary(split: DataFrame) -> DataFrame:
    """``phase, raw, eligible, no_history``: events, those with a history, those without."""
    return split.groupBy("phase").agg(F.count("*").alias("raw"), F.count_if(F.col("position") > 0).alias("eligible"), F.count_if(F.col("position") == 0).alias("no_history"))


def renumbered(retained: DataFrame) -> DataFrame:
    """Retained rows with a dense ``event_id`` in source order; the old one is ``source_event_id``."""
    return dense_index(retained.withColumnRenamed("event_id", "source_event_id"), ["source_event_id"], "event_id")


def item_index(retained: DataFrame) -> DataFrame:
    """``item, item_idx``: the retained catalog in numeric order, numbered from 1; 0 is for padding."""
    return dense_index(retained.select("item").distinct(), ["item"], "item_idx", 1)


def history_inputs(retained: DataFrame, index: DataFrame, length: int = HISTORY) -> DataFrame:
    """``user, event_id, target, history``: of each row the item index, and those of the last ``length`` rows before it,
    left-aligned and padded with 0."""
    before = W.partitionBy("user").orderBy("position").rowsBetween(-length, -1)
    listed = retained.join(index, "item").withColumn("h", F.collect_list("item_idx").over(before))
    padded = F.concat("h", F.array_repeat(F.lit(0).cast("bigint"), F.lit(length) - F.size("h")))
    return listed.select("user", "event_id", F.col("item_idx").alias("target"), padded.alias("history"))


def popularity(split: DataFrame) -> DataFrame:
    """``item, n, q, log_q`` over the training rows that have a history."""
    counts = written(split.where("phase = 'train' AND position > 0").groupBy("item").agg(F.count("*").alias("n")), "popularity")  # two uses
    total = float(counts.agg(F.sum("n")).first()[0] or 0)
    q = F.col("n") / F.lit(total)
    return counts.select("item", "n", q.alias("q"), F.ln(q).alias("log_q"))


def train_frequency(split: DataFrame) -> DataFrame:
    """``item, frequency`` over all training rows, those without a history included."""
    return split.where("phase = 'train'").groupBy("item").agg(F.count("*").alias("frequency"))


def untrained_targets(split: DataFrame) -> DataFrame:
    """One row: test events and the fraction whose item no training row has."""
    test = split.where("phase = 'test'").select("item").join(train_frequency(split), "item", "left")
    return test.agg(F.count("*").alias("tests"), F.avg(F.col("frequency").isNull().cast("double")).alias("untrained"))


def catalog_split(retained: DataFrame, inventory: DataFrame) -> DataFrame:
    """``item_id, retained``: catalog items in the retained sequences, and those outside of them."""
    items = retained.select(F.col("item").cast("string").alias("item_id")).distinct().withColumn("retained", F.lit(True))
    return inventory.select("item_id").join(items, "item_id", "left").select("item_id", F.coalesce("retained", F.lit(False)).alias("retained"))


def log_fingerprint(log: DataFrame) -> DataFrame:
    """One row: the number of rows and two sums of row hashes, which do not depend on the order of the rows.

    An order-sensitive digest would need all rows in one place; equal logs have equal sums here.
    """
    digest = F.md5(F.concat_ws(",", *(F.col(c).cast("string") for c in ("user", "item", "ts", "event_id"))))
    part = [F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") for at in (1, 9)]
    return log.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part[0]), F.lit(0)).alias("sum_1"), F.coalesce(F.sum(part[1]), F.lit(0)).alias("sum_2"))
