"""Fixed windows over media time and the timestamps of their keyframes, exact to a tenth of a second.

All times are whole microseconds, and divisions by the number of keyframes are put off to the last step, so no binary
fraction is ever rounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinograph.operators.catalog import positive_finite

SECOND, TENTH = 1_000_000, 100_000


def check_sampling(scene_seconds: int, keyframes: int) -> None:
    if scene_seconds < 1 or keyframes < 1:
        raise ValueError("windows and keyframes must be positive whole numbers")
    if keyframes > 10 * scene_seconds:
        raise ValueError("keyframes would be closer than a tenth of a second")


def microseconds(seconds: Column) -> Column:
    return (seconds.cast("decimal(18,6)") * SECOND).cast("bigint")


def stem(ticks: Column) -> Column:
    """File stem of a timestamp in tenths: ``0031``, ``0031_1``."""
    whole = F.floor(ticks / 10).cast("bigint")
    rest = F.pmod(ticks, F.lit(10))
    padded = F.when(whole < 10000, F.lpad(whole.cast("string"), 4, "0")).otherwise(whole.cast("string"))
    return F.concat(padded, F.when(rest > 0, F.concat(F.lit("_"), rest.cast("string"))).otherwise(F.lit("")))


def fixed_windows(videos: DataFrame, key: str = "content_id", duration: str = "duration_seconds", scene_seconds: int = 30, keyframes: int = 6) -> DataFrame:
    """``key, scene_idx, scene_start, scene_end, duration, shot_changes, keyframe_ticks`` of every window of every video.

    A video of a positive finite duration has windows of ``scene_seconds``; the last one ends with the video. A window is
    divided into ``keyframes`` bins, of which those beginning before its end count; a keyframe lies in the middle of its bin
    as clipped by the end, cut down to tenths of a second (``keyframe_ticks``), each once. Other videos have no windows.
    """
    check_sampling(scene_seconds, keyframes)
    length, n = scene_seconds * SECOND, keyframes
    end = microseconds(F.col(duration))
    videos = videos.where(positive_finite(duration)).select(key, end.alias("_d")).where(F.col("_d") > 0)
    windows = videos.select(key, "_d", F.explode(F.expr(f"sequence(0L, (_d - 1) div {length}, 1L)")).alias("w"))
    start = F.col("w") * length
    stop = F.least(start + length, F.col("_d"))
    windows = windows.select(key, F.col("w").cast("int").alias("scene_idx"), start.alias("_s"), stop.alias("_e"))
    # in units of a microsecond divided by the number of keyframes
    begins = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col("_s") * n + k * length), lambda b: b < F.col("_e") * n)
    ticks = F.transform("_b", lambda b: F.floor((b + F.least(b + length, F.col("_e") * n)) / F.lit(2 * n * TENTH)).cast("bigint"))
    return windows.withColumn("_b", begins).select(
        key, "scene_idx", (F.col("_s") / SECOND).alias("scene_start"), (F.col("_e") / SECOND).alias("scene_end"), ((F.col("_e") - F.col("_s")) / SECOND).alias("duration"),
        F.transform("_b", lambda b: b / (n * SECOND)).alias("shot_changes"), F.array_distinct(ticks).alias("keyframe_ticks"),
    )


def keyframes(windows: DataFrame, key: str = "content_id") -> DataFrame:
    """``key, scene_idx, timestamp, stem``: one row per keyframe, the files a sampler has to write."""
    opened = windows.select(key, "scene_idx", F.explode("keyframe_ticks").alias("t"))
    return opened.select(key, "scene_idx", (F.col("t") / 10).alias("timestamp"), stem(F.col("t")).alias("stem"))


def evidence_totals(windows: DataFrame) -> DataFrame:
    """One row: videos, scenes and frames of a sampling plan."""
    return windows.agg(F.count_distinct("content_id").alias("videos"), F.count("*").alias("scenes"), F.coalesce(F.sum(F.size("keyframe_ticks")), F.lit(0)).alias("frames"))


def missing_scenes(windows: DataFrame, present: DataFrame) -> DataFrame:
    """``content_id, expected, missing, complete``: of each sampled video the scenes that ``present`` (``content_id, scene_idx``) lacks."""
    expected = windows.groupBy("content_id").agg(F.collect_set("scene_idx").alias("e"))
    actual = present.groupBy("content_id").agg(F.collect_set(F.col("scene_idx").cast("int")).alias("a"))
    absent = F.size(F.array_except("e", F.coalesce("a", F.array().cast("array<int>"))))
    return expected.join(actual, "content_id", "left").select("content_id", F.size("e").alias("expected"), absent.alias("missing"), (absent == 0).alias("complete"))


def keyframe_fallbacks(scenes: DataFrame, windows: DataFrame) -> DataFrame:
    """``scenes`` with ``keyframes``: of each scene its keyframes, ascending, each once, cut down to tenths of a second.

    They come from the first of these that there is: ``timeline`` (array of struct with ``timestamp``), if all of its shots have one;
    ``keyframe_timestamps``; ``keyframes_given``; the planned ones of the window with the scene's index in ``windows`` (``content_id,
    scene_idx, keyframe_ticks``), where a scene without ``scene_idx`` counts by its ``position``. Negative and unusable times are
    left out; nothing at all gives an empty list.
    """
    shots = F.transform("timeline", lambda t: t.timestamp)
    complete = (F.size("timeline") > 0) & F.forall(shots, lambda t: t.isNotNull())
    filled = lambda c: F.when(F.size(c) > 0, F.col(c))
    plan = windows.select("content_id", F.col("scene_idx").alias("_at"), F.transform("keyframe_ticks", lambda t: t / 10).alias("_planned"))
    at = scenes.withColumn("_at", F.coalesce("scene_idx", "position"))
    chosen = F.coalesce(F.when(complete, shots), filled("keyframe_timestamps"), filled("keyframes_given"), F.col("_planned"), F.array().cast("array<double>"))
    usable = F.filter(chosen, lambda t: t.isNotNull() & ~F.isnan(t) & (t >= 0) & (t < 1e11))
    tenths = F.transform(usable, lambda t: (F.floor(t.cast("decimal(18,6)") * 10) / 10).cast("double"))
    return at.join(plan, ["content_id", "_at"], "left").withColumn("keyframes", F.array_sort(F.array_distinct(tenths))).drop("_at", "_planned")


def scene_bound(own: Column, planned: Column, fallback: Column) -> Column:
    """A scene's start or end as a number: its own text or number, else the planned one, else the fallback if that is no number."""
    number = F.coalesce(own.cast("string"), planned.cast("string")).try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), fallback.cast("double"))
