"""Ranks of held-out items in the whole catalog, their metrics, and the in-batch loss of fixed vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinograph.operators.vectors import group_sums
from kinograph.session import map_arrow

#: Items and users of one block: a task holds the vectors of one block of items and the users that it is multiplied with.
BLOCK = 8192
#: Batches of one task, which holds the vectors of all items that they name.
GROUP = 256
CUTOFFS = (4, 8, 10, 20, 30)


def metrics(rank: Column, cutoffs: tuple[int, ...] = CUTOFFS) -> list[Column]:
    """``HR@k`` and ``NDCG@k`` of a 1-based rank."""
    hit = {k: rank <= k for k in cutoffs}
    gain = 1 / F.log2(rank + 1)
    return [*(hit[k].cast("double").alias(f"HR@{k}") for k in cutoffs), *(F.when(hit[k], gain).otherwise(0.0).alias(f"NDCG@{k}") for k in cutoffs)]


def user_vectors(histories: DataFrame, items: DataFrame, dimensions: int) -> DataFrame:
    """``event_id, target, history, vector``: the sum of the integer vectors of a row's history; zeros without any.

    ``histories``: ``event_id, target, history`` (item numbers, 0 for padding); ``items``: ``item_idx, vector``. The sums are
    exact, so they do not depend on the order of rows.
    """
    seen = histories.select("event_id", F.explode(F.filter("history", lambda x: x > 0)).alias("item_idx")).join(items, "item_idx")
    summed = group_sums(seen, ["event_id"], dimensions).select("event_id", F.col("sums").alias("vector"))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(dimensions))
    return histories.join(summed, "event_id", "left").withColumn("vector", F.coalesce("vector", zeros))


def masked_ranks(users: DataFrame, items: DataFrame, dimensions: int, block: int = BLOCK) -> DataFrame:
    """``event_id, target, rank``: the place of the target among all items by falling score, then item number.

    The score of an item is the product of its vector and the user's; items of the history have a score of minus infinity,
    also if the target is one. Ranks are counted, not sorted: an item adds one if it is better than the target. A target that
    is no item has a score of 0. Users and items are divided into blocks of about ``block``; every two blocks meet in one task, which
    multiplies them as matrices, and the counts of a user's blocks are added up. Every user has a row.
    """
    n_users, n_items = users.count(), items.count()
    user_blocks, item_blocks = max(1, -(-n_users // block)), max(1, -(-n_items // block))
    targets = items.select(F.col("item_idx").alias("target"), F.col("vector").alias("_t"))
    score = F.aggregate(F.zip_with("vector", "_t", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda s, x: s + x)
    masked = F.array_contains("history", F.col("target"))
    scored = users.join(targets, "target", "left").select(
        "event_id", "target", "vector", F.array_distinct(F.filter("history", lambda x: x > 0)).alias("history"), F.when(~masked, F.coalesce(score, F.lit(0))).alias("score")
    )
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    number = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = scored.select(number("event_id", user_blocks).alias("ub"), every(item_blocks).alias("ib"), "event_id", "target", "history", "vector", "score")
    held = items.select(every(user_blocks).alias("ub"), number("item_idx", item_blocks).alias("ib"), null("event_id", "bigint"), F.col("item_idx").alias("target"), null("history", "array<bigint>"), "vector", null("score", "bigint"))
    arranged = held.unionByName(asked).repartition("ub", "ib").sortWithinPartitions("ub", "ib", F.col("event_id").asc_nulls_first(), "target")
    counted = map_arrow(arranged, _better(dimensions), "event_id bigint, target bigint, better bigint")
    return counted.groupBy("event_id", "target").agg((F.sum("better") + 1).alias("rank"))


def _better(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, numbers, matrix = None, np.empty(0, np.int64), np.empty((0, dimensions))
        for batch in batches:
            key = batch.column("ub").to_numpy().astype(np.int64) * (1 << 32) + batch.column("ib").to_numpy()
            begins = np.flatnonzero(np.diff(key, prepend=-1)).tolist()
            for begin, end in zip(begins, [*begins[1:], len(key)], strict=True):
                if key[begin] != at:
                    at, numbers, matrix = key[begin], np.empty(0, np.int64), np.empty((0, dimensions))
                rows = batch.slice(begin, end - begin)
                known = rows.column("event_id").null_count  # items come before users
                vectors = np.array(rows.column("vector").to_pylist(), np.float64).reshape(-1, dimensions)  # exact: products stay far below 2**53
                targets = rows.column("target").to_numpy()
                if known:
                    numbers, matrix = np.concatenate([numbers, targets[:known]]), np.concatenate([matrix, vectors[:known]])
                for first in range(known, len(targets), 256):
                    part = rows.slice(first, 256)
                    target = targets[first : first + 256, None]
                    own = np.asarray(part.column("score").cast(pa.float64()).fill_null(-np.inf))[:, None]
                    product = vectors[first : first + 256] @ matrix.T
                    for k, history in enumerate(part.column("history").to_pylist()):
                        place = np.searchsorted(numbers, history)
                        inside = place < len(numbers)
                        place = place[inside][numbers[place[inside]] == np.array(history)[inside]]
                        product[k, place] = -np.inf
                    better = ((product > own) | ((product == own) & (numbers[None, :] < target))).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([part.column("event_id"), part.column("target"), pa.array(better.astype(np.int64))], ["event_id", "target", "better"])

    return run


def negative_mask(batch: DataFrame) -> DataFrame:
    """``batch_id, row, other, masked``: pairs of rows of a batch; another row's target is no negative if it is in this row's
    history or is its own target. ``batch``: ``batch_id, row, target, history``; a batch is of bounded size."""
    left = batch.select("batch_id", "row", F.col("target").alias("_t"), F.col("history").alias("_h"))
    right = batch.select("batch_id", F.col("row").alias("other"), F.col("target").alias("_o"))
    pairs = left.join(right, "batch_id").where(F.col("row") != F.col("other"))
    return pairs.select("batch_id", "row", "other", (F.array_contains("_h", F.col("_o")) | (F.col("_t") == F.col("_o"))).alias("masked"))


def in_batch_loss(batch: DataFrame, vectors: DataFrame, log_q: DataFrame, scale: float) -> DataFrame:
    """``batch_id, loss``: mean cross entropy of each row's target among the targets of its batch.

    The logit of row and target is the product of their vectors divided by ``scale``, less the target's ``log_q``; masked
    negatives have -10000. ``vectors``: ``event_id, user_vector, target_vector``; ``batch``: as in ``negative_mask``, with ``event_id``.
    A row without vectors counts with zeros; a target without ``log_q`` is an error. A batch is multiplied as a matrix in one task.
    """
    full = batch.join(vectors, "event_id", "left").join(log_q, "target", "left")
    rows = full.select("batch_id", "row", "target", "history", "user_vector", "target_vector", F.col("log_q").cast("double").alias("log_q"))
    arranged = rows.repartition("batch_id").sortWithinPartitions("batch_id", "row")
    return map_arrow(arranged, _given_losses(scale), "batch_id bigint, loss double")


def history_loss(batch: DataFrame, items: DataFrame, log_q: DataFrame, dimensions: int, scale: float, group: int = GROUP) -> DataFrame:
    """``batch_id, loss`` as of ``in_batch_loss``, where a row's vector is the sum of the vectors of its history.

    ``batch``: as in ``negative_mask``; ``items``: ``item_idx, vector`` of whole numbers; ``log_q``: ``target, log_q``. Batches with
    following numbers, ``group`` of them, meet in one task with the items that they name. So a vector is sent once to a group, not
    to each row; items of zeros are sent without one. An item with several vectors counts with each of them.
    """
    rows = batch.select(F.floor(F.col("batch_id") / group).alias("g"), "batch_id", "row", "target", "history")
    named = rows.select("g", F.explode(F.array_union(F.filter("history", lambda x: x > 0), F.array("target"))).alias("item_idx")).distinct()
    vector = F.when(F.exists("vector", lambda x: x.isNull() | (x != 0)), F.col("vector"))
    known = items.select("item_idx", vector.alias("vector")).join(log_q.select(F.col("target").alias("item_idx"), F.col("log_q").cast("double").alias("log_q")), "item_idx", "full")
    held = named.hint("merge").join(known.where("vector IS NOT NULL OR log_q IS NOT NULL"), "item_idx")
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    sent = held.select("g", null("batch_id", "bigint"), null("row", "bigint"), F.col("item_idx").alias("target"), null("history", "array<bigint>"), "vector", "log_q")
    asked = rows.select("g", "batch_id", F.col("row").cast("bigint").alias("row"), "target", "history", null("vector", "array<bigint>"), null("log_q", "double"))
    arranged = sent.unionByName(asked).repartition("g").sortWithinPartitions("g", F.col("batch_id").asc_nulls_first(), "row", "target")
    return map_arrow(arranged, _summed_losses(dimensions, scale), "batch_id bigint, loss double")


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of the rows that follow each other with the same ``keys``; a null is a key of its own."""
    at, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [batch.column(k).fill_null(-1).to_numpy() for k in keys]
        begins = np.flatnonzero(np.concatenate([[True], np.any([np.diff(p) != 0 for p in parts], axis=0)])).tolist()
        for begin, end in zip(begins, [*begins[1:], batch.num_rows], strict=True):
            key = tuple(p[begin] for p in parts)
            if held and key != at:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            at = key
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(rows: pa.Table, name: str) -> pa.Array:
    return rows.column(name).chunk(0)


def _matrix(lists: pa.Array, dimensions: int) -> np.ndarray:
    """A row for each list; zeros for a null, NaN for a null within a list. Whole numbers are exact below 2**53."""
    result = np.zeros((len(lists), dimensions))
    result[lists.is_valid().to_numpy(zero_copy_only=False)] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    return result


def _padded(lists: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of one length, filled with a number that no item has."""
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    result = np.full((len(sizes), max(1, sizes.max())), np.iinfo(np.int64).min)
    result[np.arange(result.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return result


def _cross_entropy(users: np.ndarray, vectors: np.ndarray, of: np.ndarray, targets: np.ndarray, histories: np.ndarray, log_q: np.ndarray, scale: float) -> float:
    """The mean over the rows of a batch; ``vectors`` and ``log_q`` are those of the targets of the rows ``of``, at least one for each row."""
    product = users @ vectors.T
    logits = np.where(np.isnan(product), 0.0, product) / scale - log_q[None, :]
    own = of[None, :] == np.arange(len(targets))[:, None]
    others = targets[of][None, :]
    masked = targets[:, None] == others
    for seen in histories.T:
        masked |= seen[:, None] == others
    logits[masked & ~own] = -10000.0
    top = logits.max(axis=1)
    sums = np.exp(logits - top[:, None]).sum(axis=1) * own.sum(axis=1)
    return float((np.log(sums) + top - np.where(own, logits, -np.inf).max(axis=1)).mean())


def _losses(found: list[tuple[int, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([x for _, x in found], pa.float64())], ["batch_id", "loss"])


def _given_losses(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("batch_id",)):
            lists = [_column(rows, name) for name in ("user_vector", "target_vector")]
            users, vectors = (_matrix(x, max(1, *(y.value_lengths().fill_null(0).to_numpy().max() for y in lists))) for x in lists)
            log_q = _column(rows, "log_q")
            if log_q.null_count:
                raise ValueError("a target has no log_q")
            found = _cross_entropy(users, vectors, np.arange(rows.num_rows), _column(rows, "target").to_numpy(), _padded(_column(rows, "history")), log_q.to_numpy(), scale)
            yield _losses([(rows.column("batch_id")[0].as_py(), found)])

    return run


def _summed_losses(dimensions: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, numbers, matrix, log_q, found = None, np.empty(0, np.int64), np.empty((0, dimensions)), np.empty(0), []
        for rows in _runs(batches, ("g", "batch_id")):
            group, batch_id, targets = rows.column("g")[0].as_py(), rows.column("batch_id")[0].as_py(), _column(rows, "target").to_numpy()
            if batch_id is None:  # items come before rows
                at, numbers, log_q = group, targets, _column(rows, "log_q").to_numpy(zero_copy_only=False)
                matrix = _matrix(_column(rows, "vector"), dimensions)
                different, begins = np.unique(numbers, return_index=True)
                sums = np.concatenate([np.add.reduceat(np.nan_to_num(matrix), begins), np.zeros((1, dimensions))])
                continue
            if group != at:
                raise ValueError("a target has no log_q")
            first, last = np.searchsorted(numbers, targets, "left"), np.searchsorted(numbers, targets, "right")
            copies = last - first
            places = np.repeat(first - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())
            if not copies.all() or np.isnan(log_q[places]).any():
                raise ValueError("a target has no log_q")
            histories = _padded(_column(rows, "history"))
            seen = np.minimum(np.searchsorted(different, histories), len(different) - 1)
            users = sums[np.where(different[seen] == histories, seen, len(different))].sum(axis=1)
            found.append((batch_id, _cross_entropy(users, matrix[places], np.repeat(np.arange(len(targets)), copies), targets, histories, log_q[places], scale)))
            if len(found) == 1024:
                yield _losses(found)
                found = []
        if found:
            yield _losses(found)

    return run
