"""Dense numbers in a total order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.session import written

_ROW_BITS = 33  # of monotonically_increasing_id, which has the partition above them


def dense_index(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with the column ``name``: ``start, start + 1, ...`` in the order of the columns ``order``, which must be unique.

    Rows are range partitioned and sorted, numbered within each partition, and moved up by the sizes of the partitions
    before, of which there is one small row each. Duplicate keys would be numbered in an undefined order.
    """
    numbered = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_row", _ROW_BITS)
    sizes = sorted((r["part"], r["n"]) for r in numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, offsets = start, []
    for partition, n in sizes:
        offsets.append((partition, before))
        before += n
    spark = df.sparkSession
    moved = spark.createDataFrame(offsets, "_part long, _before long")
    result = numbered.withColumn("_part", part).join(F.broadcast(moved), "_part")
    return result.withColumn(name, F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("_part", "_before", "_row")


def first_seen_ids(values: DataFrame, value: str, position: list[str], name: str) -> DataFrame:
    """``value, name``: each distinct value with a dense number from 1 in the order of its first position; "" has the number 0.

    Values are stripped first; null counts as "". Positions need not be unique; ties go to the smaller value.
    """
    stripped = F.coalesce(F.btrim(value, F.lit(" \t\r\n")), F.lit(""))
    first = values.select(stripped.alias(value), F.struct(*position).alias("_at")).groupBy(value).agg(F.min("_at").alias("_at"))
    numbered = dense_index(first.where(F.col(value) != ""), ["_at", value], name, 1).select(value, F.col(name).cast("bigint").alias(name))
    spark = values.sparkSession
    return numbered.unionByName(spark.createDataFrame([("", 0)], f"{value} string, {name} bigint"))
