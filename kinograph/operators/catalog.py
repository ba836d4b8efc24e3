"""Item inventories and titles: eligibility, availability, carried durations, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positive_finite(column: str) -> Column:
    value = F.col(column)
    return F.coalesce((value > 0) & ~F.isnan(value) & (value < float("inf")), F.lit(False))


def eligibility(items: DataFrame) -> DataFrame:
    """``item_id, content_id, eligible, reasons``: an item is eligible if no reason speaks against it.

    Reasons, in this order: ``missing_video`` (no path), ``empty_video`` (no size, or 0), ``invalid_duration`` (null, NaN,
    infinite, 0 or negative).
    """
    path = F.col("source_video_path")
    tests = [
        (F.coalesce(F.trim(path) == "", F.lit(True)), "missing_video"),
        (F.coalesce(F.col("source_file_size") <= 0, F.lit(True)), "empty_video"),
        (~positive_finite("duration_seconds"), "invalid_duration"),
    ]
    reasons = F.filter(F.array(*(F.when(test, F.lit(name)) for test, name in tests)), lambda x: x.isNotNull())
    return items.select("item_id", "content_id", (F.size(reasons) == 0).alias("eligible"), reasons.alias("reasons"))


def match_files(items: DataFrame, files: DataFrame) -> DataFrame:
    """Left join of items and ``files`` (``item_id, path, size, mtime_ns``) with ``status``: ``found``, ``missing`` or
    ``ambiguous`` (more than one file of an item)."""
    counted = files.groupBy("item_id").agg(F.count("*").alias("files"), F.min("path").alias("path"), F.min("size").alias("size"), F.min("mtime_ns").alias("mtime_ns"))
    status = F.when(F.col("files").isNull(), "missing").when(F.col("files") > 1, "ambiguous").otherwise("found")
    return items.join(counted, "item_id", "left").withColumn("status", status).drop("files")


def carry_durations(current: DataFrame, previous: DataFrame, keys: list[str], duration: str = "duration_seconds") -> DataFrame:
    """``current`` with the previous duration wherever all ``keys`` are equal, null to null, and its own duration is null."""
    before = previous.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(duration).alias("_duration")).distinct()
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = current.join(before, same, "left")
    return joined.withColumn(duration, F.coalesce(duration, "_duration")).drop("_duration", *(f"_{k}" for k in keys))


def source_unchanged(size: Column, mtime: Column, stored_size: Column, stored_mtime: Column) -> Column:
    """A source file is unchanged if its size and modification time are known and equal to the stored ones."""
    return F.coalesce((size == stored_size) & (mtime == stored_mtime), F.lit(False))


def _given(column: str) -> Column:
    return F.nullif(F.btrim(F.col(column), F.lit(" \t\r\n")), F.lit(""))


def complete_titles(required: DataFrame, primary: DataFrame, supplement: DataFrame) -> DataFrame:
    """``item_id, content_id, title, origin``: of every required item the primary title, else the supplementary one, else "".

    Blank titles count as missing; ``origin`` is ``primary``, ``supplement`` or ``missing``. The two sources have one row an
    item at most.
    """
    first = primary.select("item_id", _given("title").alias("_first"))
    second = supplement.select("item_id", _given("title").alias("_second"))
    joined = required.select("item_id", "content_id").join(first, "item_id", "left").join(second, "item_id", "left")
    origin = F.when(F.col("_first").isNotNull(), "primary").when(F.col("_second").isNotNull(), "supplement").otherwise("missing")
    return joined.select("item_id", "content_id", F.coalesce("_first", "_second", F.lit("")).alias("title"), origin.alias("origin"))


def completion_report(titles: DataFrame) -> DataFrame:
    """``origin, items`` for each origin of a title."""
    return titles.groupBy("origin").agg(F.count("*").alias("items"))


def duplicated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, with their rows: empty if ``keys`` are unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def available_interactions(log: DataFrame, eligible: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``log`` whose item is in ``eligible`` (``item``), and ``item, excluded``: the others counted by item."""
    kept = log.join(eligible.select("item"), "item", "left_semi")
    lost = log.join(eligible.select("item"), "item", "left_anti").groupBy("item").agg(F.count("*").alias("excluded"))
    return kept, lost


def require_all(required: DataFrame, given: DataFrame, key: str, message: str) -> None:
    """An error that names some of the ``required`` keys that are not ``given``."""
    missing = required.select(key).join(given.select(key), key, "left_anti").limit(3).collect()
    if missing:
        raise ValueError(f"{message}: {[r[0] for r in missing]}")
