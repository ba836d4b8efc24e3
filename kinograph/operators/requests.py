"""Requests for generated scenes: the frames of each scene, and what is missing of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scene_evidence(windows: DataFrame, frames: DataFrame) -> DataFrame:
    """``content_id, scene_idx, task_id, scene_start, scene_end, paths, missing``: of each window its frames in the order of time.

    ``windows``: as from ``sampling.fixed_windows``; ``frames``: ``content_id, stem, path`` of the files that are there. ``missing``
    counts keyframes without a file. Scenes without any frame are kept, with no paths. Frames are never broadcast: a plan takes rows
    opened from a video for as small as the list of videos.
    """
    from kinograph.functions.sampling import stem

    wanted = windows.select("content_id", "scene_idx", "scene_start", "scene_end", F.posexplode("keyframe_ticks").alias("k", "tick")).withColumn("stem", stem(F.col("tick")))
    found = wanted.join(frames.select("content_id", "stem", "path").hint("merge"), ["content_id", "stem"], "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("k", "path"))))
    grouped = found.groupBy("content_id", "scene_idx", "scene_start", "scene_end").agg(listed.getField("path").alias("paths"), F.count_if(F.col("path").isNull()).alias("missing"))
    task = F.concat_ws(":", "content_id", "scene_idx")
    return grouped.select("content_id", "scene_idx", task.alias("task_id"), "scene_start", "scene_end", "paths", "missing")


def incomplete_requests(evidence: DataFrame) -> DataFrame:
    """Scenes that cannot be requested, as a frame is missing; empty for complete evidence."""
    return evidence.where((F.col("missing") > 0) | (F.size("paths") == 0)).select("task_id", "missing")


def unanswered(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """``task_id, problem`` of requests without a response, and of responses that are not asked for or given twice."""
    counted = responses.groupBy("task_id").agg(F.count("*").alias("n"))
    joined = requests.select("task_id", F.lit(True).alias("asked")).join(counted, "task_id", "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return joined.select("task_id", problem.alias("problem")).where("problem IS NOT NULL")


def last_but_one_frame(frames: DataFrame) -> DataFrame:
    """``content_id, timestamp``: the second-largest different timestamp that can be decoded, to which a seek past the end goes; a
    video with one frame has that one."""
    ranked = frames.select("content_id", "timestamp").distinct().withColumn("r", F.row_number().over(W.partitionBy("content_id").orderBy(F.desc("timestamp")))).where(F.col("r") <= 2)
    return ranked.groupBy("content_id").agg(F.min("timestamp").alias("timestamp"))
