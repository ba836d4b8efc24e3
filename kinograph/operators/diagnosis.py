"""Summaries and comparisons of evaluated runs: seed means, relative changes, paired bootstrap, early stopping."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinograph.operators.segments import hash_number
from kinograph.session import map_arrow


def seed_summary(metrics: DataFrame, metric: str) -> DataFrame:
    """``arm, mean, sd``: mean over seeds of each seed's mean, with the sample standard deviation (0 for one seed)."""
    per_seed = metrics.groupBy("arm", "seed").agg(F.avg(metric).alias("m"))
    spread = F.when(F.count("*") == 1, 0.0).otherwise(F.stddev_samp("m"))
    return per_seed.groupBy("arm").agg(F.avg("m").alias("mean"), spread.alias("sd"))


def relative_change(summary: DataFrame, base: str) -> DataFrame:
    """``arm, change`` of the mean against the arm ``base``; null if the base is 0 or below."""
    found = summary.where(F.col("arm") == base).select("mean").first()
    value = found[0] if found and found[0] is not None and found[0] > 0 else None
    change = F.lit(None).cast("double") if value is None else F.col("mean") / F.lit(value) - 1
    return summary.select("arm", change.alias("change"))


def user_means(metrics: DataFrame, metric: str) -> DataFrame:
    """``user, arm, value``: mean over the seeds of each user."""
    return metrics.groupBy("user", "arm").agg(F.avg(metric).alias("value"))


#: Below which of these numbers of 2**32 a hash must be for the weights 0, 1, ...: a Poisson distribution of mean 1.
POISSON = tuple(int(2**32 * sum(math.exp(-1) / math.factorial(k) for k in range(n + 1))) for n in range(9))
#: Multiplier of the hash of user and draw (a usual mixer of 32 bits), and what a draw is multiplied with.
MIXER, STRIDE = 0x45D9F3B, 0x9E3779B9
#: Users whose weights are in memory at once.
HELD_USERS = 256


def weights(users: np.ndarray, draws: int) -> np.ndarray:
    """How often each user, given by 32 hash bits, is drawn in each resample: users x draws."""
    x = users.astype(np.uint32)[:, None] + np.arange(draws, dtype=np.uint32)[None, :] * np.uint32(STRIDE)  # all modulo 2**32
    for _ in range(2):
        x ^= x >> np.uint32(16)
        x *= np.uint32(MIXER)
    x ^= x >> np.uint32(16)
    drawn = np.zeros(x.shape, np.uint8)
    for limit in POISSON:
        drawn += x >= np.uint32(limit)
    return drawn


def bootstrap(values: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """``draw, arm, mean``: weighted means of ``values`` (``user, arm, value``) in each resample of the users.

    A user's weight in a draw comes from a hash of seed, user and draw, so all arms share it and it does not depend on where
    the user is processed. The users of a task are multiplied with their weights as matrices, so what is shuffled is draws
    times arms for each task, whatever the number of users.
    """
    users = values.groupBy("user").agg(F.collect_list(F.struct("arm", "value")).alias("arms"))  # as many as arms
    hashed = users.select(hash_number(F.lit(seed), "user").alias("hash"), "arms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, HELD_USERS):
                part = batch.slice(begin, HELD_USERS)
                drawn = weights(part.column("hash").to_numpy(), draws).astype(np.float64)
                lists = part.column("arms")
                user = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                arms, value = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("arm", "value"))
                names, arm = np.unique(arms.astype(str), return_inverse=True)
                there = ~np.isnan(value.astype(np.float64))
                table = np.zeros((2, len(names), part.num_rows))  # summed values and numbers
                np.add.at(table[0], (arm[there], user[there]), value[there])
                np.add.at(table[1], (arm[there], user[there]), 1)
                rows = (table.reshape(-1, part.num_rows) @ drawn).reshape(2, len(names), draws)
                for k, name in enumerate(names.tolist()):
                    sums[name] = sums[name] + rows[:, k] if name in sums else rows[:, k]
        for arm, (total, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws, dtype=np.int32)), pa.array([arm] * draws, pa.string()), pa.array(total), pa.array(n)], ["draw", "arm", "s", "n"])

    parts = map_arrow(hashed, run, "draw int, arm string, s double, n double")
    return parts.groupBy("draw", "arm").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))


def pairs(arms: list[str]) -> list[tuple[str, str]]:
    """Each later arm against each earlier one."""
    return [(late, early) for k, early in enumerate(arms) for late in arms[k + 1 :]]


def comparisons(observed: DataFrame, resampled: DataFrame, arms: list[str], alpha: float = 0.05) -> DataFrame:
    """``left, right, difference, low, high, superior, inferior`` of all pairs of arms.

    ``observed``: ``arm, mean``; ``resampled``: ``draw, arm, mean``. The interval holds with a family-wise level: ``alpha`` is
    divided by the number of pairs. Percentiles are exact, with linear interpolation.
    """
    spark = observed.sparkSession
    family = spark.createDataFrame(pairs(arms) or [("", "")], "left string, right string").where("left <> ''")
    tail = alpha / max(1, len(pairs(arms))) / 2
    one = resampled.select("draw", F.col("arm").alias("left"), F.col("mean").alias("_l"))
    two = resampled.select("draw", F.col("arm").alias("right"), F.col("mean").alias("_r"))
    deltas = one.join(F.broadcast(family), "left").join(two, ["draw", "right"]).select("left", "right", (F.col("_l") - F.col("_r")).alias("d"))
    limits = deltas.groupBy("left", "right").agg(F.percentile("d", F.lit(tail)).alias("low"), F.percentile("d", F.lit(1 - tail)).alias("high"))
    first = observed.select(F.col("arm").alias("left"), F.col("mean").alias("_l"))
    second = observed.select(F.col("arm").alias("right"), F.col("mean").alias("_r"))
    joined = limits.join(first, "left").join(second, "right")
    return joined.select("left", "right", (F.col("_l") - F.col("_r")).alias("difference"), "low", "high", (F.col("low") > 0).alias("superior"), (F.col("high") < 0).alias("inferior"))


def compare_runs(one: DataFrame, two: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """``arm, events, difference`` between two runs over the same events; an error if their keys differ.

    Where the runs have a ``split`` or a ``seed``, these must be the same for every arm too, also if they are no keys.
    """
    for name in ("split", "seed"):
        if (name in one.columns) != (name in two.columns):
            raise ValueError(f"only one run has a {name}")
    grid = ["arm", *(c for c in ("split", "seed") if c in one.columns)]
    for columns, what in ((grid, "arms, splits or seeds"), (keys, "events")):
        for a, b, name in ((one, two, "second"), (two, one, "first")):
            left, right = a.select(*columns), b.select(*columns)
            left, right = (left, right) if columns is keys else (left.distinct(), right.distinct())
            if not left.exceptAll(right).isEmpty():
                raise ValueError(f"the {name} run lacks {what} of the other")
    joined = one.select(*keys, F.col(metric).alias("_one")).join(two.select(*keys, F.col(metric).alias("_two")), keys)
    return joined.groupBy("arm").agg(F.count("*").alias("events"), F.avg(F.col("_two") - F.col("_one")).alias("difference"))


def early_stopping(scores: DataFrame, patience: int, min_delta: float = 0.0) -> DataFrame:
    """``run, best_epoch, best_score, stop_epoch`` of curves ``run, epoch, score`` (epochs from 1).

    The best epoch is the first of the highest score up to the stop. Progress is a gain of more than ``min_delta`` over the
    score of the last progress; the run stops once ``patience`` epochs have passed without any, else at its end.
    """
    curve = F.array_sort(F.collect_list(F.struct("epoch", "score")))
    grouped = scores.groupBy("run").agg(curve.alias("curve"))  # a curve has as many rows as epochs
    low = F.lit(float("-inf"))
    start = F.struct(F.lit(0).alias("best"), low.alias("top"), F.lit(0).alias("moved"), low.alias("level"), F.lit(0).alias("stop"))

    def step(state: Column, point: Column) -> Column:
        better, progress = point.score > state.top, point.score > state.level + min_delta
        moved = F.when(progress, point.epoch).otherwise(state.moved)
        ended = F.when(point.epoch - moved >= patience, point.epoch).otherwise(0)
        new = F.struct(
            F.when(better, point.epoch).otherwise(state.best).alias("best"), F.when(better, point.score).otherwise(state.top).alias("top"), moved.alias("moved"),
            F.when(progress, point.score).otherwise(state.level).alias("level"), ended.alias("stop"),
        )
        return F.when(state.stop > 0, state).otherwise(new)

    state = grouped.select("run", F.aggregate("curve", start, step).alias("s"), F.element_at("curve", -1).epoch.alias("last"))
    return state.select("run", F.col("s.best").alias("best_epoch"), F.col("s.top").alias("best_score"), F.when(F.col("s.stop") > 0, F.col("s.stop")).otherwise(F.col("last")).alias("stop_epoch"))
