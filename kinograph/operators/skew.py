"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.operators.interactions import coded_rows
from kinograph.session import written

#: Heavy keys that are looked for at least, and for each shuffle partition: a key that is not heavy holds at most a quarter of
#: an even partition's rows. Counters of the frequent-items sketch for each heavy key.
HEAVY_KEYS, KEYS_A_PARTITION, COUNTERS = 1000, 4, 4


def heavy_keys(rows: DataFrame, key: str, most: int = HEAVY_KEYS) -> DataFrame:
    """``key`` of the values that an approximate frequent-items sketch counts at a ``most``-th of the rows or more.

    The sketch is a mergeable aggregate of fixed size, so one pass over one column and no shuffle of rows is needed. It
    decides only which way a key is processed; results do not depend on it. At most ``most`` rows, which may be broadcast.
    """
    counters = max(64, 1 << (COUNTERS * most - 1).bit_length())
    sketch = rows.agg(F.count(key).alias("n"), F.expr(f"approx_top_k({key}, {most}, {counters})").alias("top"))
    return sketch.select("n", F.explode("top").alias("t")).where(F.col("t.count") * most >= F.col("n")).select(F.col("t.item").alias(key))


def item_activity(events: DataFrame, most: int | None = None) -> DataFrame:
    """``item_id, rows, users, share, first_timestamp, last_timestamp`` of every item, from the usable rows of ``events``.

    Heavy items (those with a ``most``-th of the rows, which by default follows the number of shuffle partitions; found by a
    sketch, joined by broadcast) are spread over all tasks by (user, item, timestamp) and then
    combined by (user, item); the others take one shuffle on the item, in which de-duplication, users and totals are
    all computed. The union has one row per item. An empty log gives no rows; rows without an id or with a timestamp
    that is null, 0 or negative do not count; repeated deliveries count once.
    """
    rows = coded_rows(events).select("user", "item", "ts")
    partitions = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.broadcast(written(heavy_keys(rows, "item", most or max(HEAVY_KEYS, KEYS_A_PARTITION * partitions)), "heavy"))

    per_user = [F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")]
    per_item = [F.sum("n").alias("rows"), F.count("*").alias("users"), F.min("first").alias("first_timestamp"), F.max("last").alias("last_timestamp")]
    spread = rows.join(heavy, "item", "left_semi").distinct()
    hot = spread.groupBy("item", "user").agg(*per_user).groupBy("item").agg(*per_item)
    by_item = rows.join(heavy, "item", "left_anti").repartition("item")
    rest = by_item.distinct().groupBy("item", "user").agg(*per_user).groupBy("item").agg(*per_item)

    result = written(hot.unionByName(rest), "items")
    total = result.agg(F.sum("rows")).first()[0] or 0
    return result.select(
        F.col("item").alias("item_id"), "rows", "users", (F.col("rows") / F.lit(float(total))).alias("share"), "first_timestamp", "last_timestamp"
    )


def dominant_items(events: DataFrame, share: float = 0.02) -> DataFrame:
    """``item_id`` of the items with more than ``share`` of all usable rows."""
    return item_activity(events).where(F.col("share") > share).select("item_id")
