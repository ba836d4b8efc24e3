"""Grouped means and messages of vectors, as chains of grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str, dimensions: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(vector: str, scale: int = 1000) -> Column:
    """Whole numbers, whose sums and products are exact."""
    return F.transform(vector, lambda x: F.round(x.cast("double") * scale).try_cast("bigint"))


def group_sums(rows: DataFrame, keys: list[str], dimensions: int, vector: str = "vector") -> DataFrame:
    """``keys, size, sums``: the number of vectors of a group and their sum. Each dimension is one sum of the same aggregate, so
    what is combined and shuffled is one row for each group of a task."""
    columns = [F.sum(F.get(vector, F.lit(d))).alias(f"_{d}") for d in range(dimensions)]
    summed = rows.groupBy(*keys).agg(F.count(vector).alias("size"), *columns)
    return summed.select(*keys, "size", F.array(*(F.col(f"_{d}") for d in range(dimensions))).alias("sums"))


def group_mean(rows: DataFrame, groups: DataFrame, keys: list[str], dimensions: int, vector: str = "vector") -> DataFrame:
    """``keys, size, mean`` of every group in ``groups``; a group without vectors has the size 0 and a mean of zeros."""
    sums = group_sums(rows, keys, dimensions, vector)
    joined = groups.select(*keys).join(sums, keys, "left")
    mean = F.transform("sums", lambda x: x / F.col("size"))
    zeros = F.array_repeat(F.lit(0.0), F.lit(dimensions))
    return joined.select(*keys, F.coalesce("size", F.lit(0)).alias("size"), F.coalesce(mean, zeros).alias("mean"))


def hyperedge_messages(members: DataFrame, scenes: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """Means of the scenes of each segment, and of the segments of each scene.

    ``members``: ``segment, scene``; ``scenes``: ``scene, vector``. The first has ``segment, size, mean``, the second ``scene, degree,
    received``; a scene without a segment receives zeros.
    """
    inside = members.join(scenes, "scene")
    units = group_mean(inside, members.select("segment").distinct(), ["segment"], dimensions)
    sent = members.join(units.select("segment", F.col("mean").alias("vector")), "segment")
    received = group_mean(sent, scenes, ["scene"], dimensions)
    return units, received.select("scene", F.col("size").alias("degree"), F.col("mean").alias("received"))
