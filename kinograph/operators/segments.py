"""Activity segments of videos, their ablations, and how much these overlap.

``scenes``: ``content_id, scene_idx, activities`` (array of keys), one row per valid scene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_number(*parts: Column | str) -> Column:
    """A number below 2**32 from the digest of the parts: the same in every run, on every cluster."""
    columns = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("bigint")


def _memberships(scenes: DataFrame) -> DataFrame:
    return scenes.select("content_id", "scene_idx", F.explode(F.array_distinct("activities")).alias("activity")).where("activity IS NOT NULL")


def activity_segments(scenes: DataFrame) -> DataFrame:
    """``content_id, activity, start, scene_idx``: maximal runs of scenes whose indexes go up by 1 and that all hold one activity.

    ``start`` is the first scene of the run and names it; runs of one scene are kept, and a scene is in one run for each of
    its activities. A missing scene ends a run.
    """
    by_activity = W.partitionBy("content_id", "activity")
    island = F.col("scene_idx") - F.row_number().over(by_activity.orderBy("scene_idx"))
    runs = _memberships(scenes).withColumn("island", island)
    start = F.min("scene_idx").over(W.partitionBy("content_id", "activity", "island"))
    return runs.select("content_id", "activity", start.alias("start"), "scene_idx")


def segments(members: DataFrame) -> DataFrame:
    """``content_id, activity, start, length, scene_ids`` of each segment; ``scene_ids`` ascending."""
    grouped = members.groupBy("content_id", "activity", "start").agg(F.sort_array(F.collect_list("scene_idx")).alias("scene_ids"))
    return grouped.select("content_id", "activity", "start", F.size("scene_ids").alias("length"), "scene_ids")


def action_bags(scenes: DataFrame) -> DataFrame:
    """One segment per video and activity: all scenes that hold it, contiguous or not."""
    grouped = _memberships(scenes).groupBy("content_id", "activity").agg(F.sort_array(F.collect_set("scene_idx")).alias("scene_ids"))
    return grouped.select("content_id", "activity", F.element_at("scene_ids", 1).alias("start"), F.size("scene_ids").alias("length"), "scene_ids")


def contiguous_starts(scenes: DataFrame) -> DataFrame:
    """``content_id, scene_idx, run``: of each valid scene, how many scenes from it on follow without a gap."""
    ordered = W.partitionBy("content_id").orderBy("scene_idx")
    numbered = scenes.select("content_id", "scene_idx", (F.col("scene_idx") - F.row_number().over(ordered)).alias("island"))
    left = F.count("*").over(W.partitionBy("content_id", "island").orderBy(F.desc("scene_idx")))
    return numbered.select("content_id", "scene_idx", left.alias("run"))


def time_windows(scenes: DataFrame, seed: int = 42) -> DataFrame:
    """Each segment moved to a run of consecutive scenes of the same length in its video, drawn evenly from all such runs."""
    default = segments(activity_segments(scenes))
    ordered = W.partitionBy("content_id").orderBy("scene_idx")
    islands = scenes.select("content_id", "scene_idx", (F.col("scene_idx") - F.row_number().over(ordered)).alias("island"))
    runs = islands.groupBy("content_id", "island").agg(F.min("scene_idx").alias("begin"), F.count("*").cast("int").alias("run"))
    of_content = runs.groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("begin", "run"))).alias("runs"))
    places = F.transform("runs", lambda r: F.greatest(r.run - F.col("length") + 1, F.lit(0)))  # of each run, how many starts are in it
    joined = default.join(of_content, "content_id").withColumn("places", places)
    number = F.pmod(hash_number(F.lit(seed), "content_id", "activity", "start"), F.aggregate("places", F.lit(0), lambda s, x: s + x)).cast("int")
    begun = F.struct(number.alias("left"), F.lit(None).cast("int").alias("first"))

    def step(state: Column, run: Column) -> Column:
        here = (state.left >= 0) & (state.left < run.n)
        return F.struct((state.left - run.n).alias("left"), F.when(here, run.begin + state.left).otherwise(state.first).alias("first"))

    counted = F.zip_with("runs", "places", lambda r, n: F.struct(r.begin.alias("begin"), n.alias("n")))
    moved = joined.withColumn("first", F.aggregate(counted, begun, step).first)
    return moved.select("content_id", "activity", "start", "length", F.sequence("first", F.col("first") + F.col("length") - 1).alias("scene_ids"))


def random_scenes(scenes: DataFrame, seed: int = 42) -> DataFrame:
    """All segments of a video under one permutation of its scenes: sizes and memberships per scene stay as they are."""
    by_place, by_draw = W.partitionBy("content_id").orderBy("scene_idx"), W.partitionBy("content_id").orderBy("draw", "scene_idx")
    drawn = scenes.select("content_id", "scene_idx", hash_number(F.lit(seed), "content_id", "scene_idx").alias("draw"))
    ranked = drawn.select("content_id", "scene_idx", F.row_number().over(by_place).alias("place"), F.row_number().over(by_draw).alias("image"))
    images = ranked.select("content_id", "scene_idx", "image").join(ranked.select("content_id", F.col("place").alias("image"), F.col("scene_idx").alias("to")), ["content_id", "image"])
    moved = activity_segments(scenes).join(images, ["content_id", "scene_idx"]).select("content_id", "activity", "start", F.col("to").alias("scene_idx"))
    return segments(moved)


def overlap(variant: DataFrame, default: DataFrame) -> DataFrame:
    """``content_id, activity, start, identical, jaccard``: of each segment of a variant, whether a default segment of the
    video has the same scenes, and the best Jaccard similarity with one. Segments meet at the scenes they share, so those of a
    long video are not all compared with each other."""
    names = ["content_id", "activity", "start"]
    unique = F.array_distinct("scene_ids")
    one = variant.select(*names, F.size(unique).alias("size"), F.explode(unique).alias("scene"))
    two = default.select("content_id", F.struct("activity", "start").alias("other"), F.size(unique).alias("other_size"), F.explode(unique).alias("scene"))
    met = one.join(two, ["content_id", "scene"]).groupBy(*names, "other").agg(F.count("*").alias("common"), F.first("size").alias("size"), F.first("other_size").alias("other_size"))
    both = F.col("size") + F.col("other_size") - F.col("common")
    best = met.groupBy(*names).agg(F.max(both == F.col("common")).alias("identical"), F.max(F.col("common") / both).alias("jaccard"))
    joined = variant.select(*names).join(best, names, "left")
    return joined.select(*names, F.coalesce("identical", F.lit(False)).alias("identical"), F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"))


def length_distribution(found: DataFrame, most: int = 15) -> DataFrame:
    """``length, segments`` of the ``most`` smallest lengths."""
    return found.groupBy("length").agg(F.count("*").alias("segments")).orderBy("length").limit(most)


def segment_summary(found: DataFrame) -> DataFrame:
    """One row: segments, memberships and the fraction of segments of one scene."""
    return found.agg(F.count("*").alias("segments"), F.coalesce(F.sum("length"), F.lit(0)).alias("memberships"), F.coalesce(F.avg((F.col("length") == 1).cast("double")), F.lit(0.0)).alias("singletons"))


def broken_memberships(members: DataFrame) -> DataFrame:
    """Memberships that a sidecar must not hold: a scene twice in one segment, or no scene. Empty for sound input."""
    counted = members.groupBy("content_id", "activity", "start", "scene_idx").agg(F.count("*").alias("rows"))
    return counted.where((F.col("rows") > 1) | F.col("scene_idx").isNull() | (F.col("scene_idx") < 0))
