"""Counts of item pairs over baskets of any length, by tiles of the matrix of pairs.

Items are numbered by falling frequency and cut into blocks of TILE. A basket is cut at the blocks' borders into chunks of at
most TILE items, and each chunk is sent once for every block that the basket also has items in. All chunks of two blocks meet
at one tile, whose TILE x TILE counts are added up as a matrix. So a basket of L items is sent about L / TILE times, spread
over as many keys, where its pairs would be L * L / 2 rows, and no task holds more than one tile and a few chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinograph.operators.indexing import dense_index
from kinograph.session import BROADCAST_ROWS, map_arrow, written

#: Items of one block.
TILE = 1024
#: Baskets that are added up in one tile by one task; with more, a tile is divided by basket and its parts are summed afterwards.
TILE_BASKETS = 100_000
#: Rows that a worker looks at together, and baskets of one matrix product.
HELD_ROWS, PRODUCT = 4096, 512

_ROWS = ["tile", "salt", "user", "right", "at", "place", "cell", "users"]


def numbered_items(items: DataFrame) -> DataFrame:
    """``item, n, at`` from ``item, n``: ``at`` is 0, 1, ... by falling ``n``, then item."""
    return written(dense_index(items.select("item", "n", (-F.col("n")).alias("less")), ["less", "item"], "at").drop("less"), "index")


def with_numbers(rows: DataFrame, index: DataFrame, column: str, name: str, to: str = "item") -> DataFrame:
    """``rows`` with the number in ``column`` looked up in ``index`` as ``name``. A counted index of few rows is broadcast."""
    known = index.select(F.col("at").alias(column), F.col(to).alias(name))
    return rows.join(F.broadcast(known) if index.count() <= BROADCAST_ROWS else known, column)


def chunks(rows: DataFrame, ordered: bool) -> DataFrame:
    """``user, block, at`` and, if ``ordered``, ``first, last``: the items of each basket (``user, at``, each once) in each block.
    ``first, last``: the places of an item's first and last row, which ``rows`` then has."""
    fields = [F.pmod("at", F.lit(TILE)).cast("smallint").alias("at"), *(["first", "last"] if ordered else [])]
    cut = rows.groupBy("user", F.floor(F.col("at") / TILE).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("c"))
    columns = [F.col("c.at").alias("at"), *([F.col("c.first").alias("first"), F.col("c.last").alias("last")] if ordered else [])]
    return cut.select("user", "block", *columns)


def tile_of(left: Column, right: Column) -> Column:
    """The tile's key from the numbers of two blocks."""
    return F.shiftleft(left.cast("bigint"), 32).bitwiseOR(right.cast("bigint"))


def sent_chunks(cut: DataFrame, salts: int, ordered: bool) -> DataFrame:
    """Each chunk once for every tile that it is a side of. Without ``ordered``, the left block is not above the right one."""
    blocks = cut.groupBy("user").agg(F.collect_list("block").alias("blocks"))  # as many as the catalog has blocks, at most
    both = cut.join(blocks, "user").repartition("user", "block")
    none = F.lit(None).cast("array<bigint>")

    def side(right: bool) -> DataFrame:
        near = F.col("blocks") if ordered else F.filter("blocks", lambda p: p <= F.col("block") if right else p >= F.col("block"))
        place = none if not ordered else F.col("last" if right else "first")
        opened = both.select("user", "block", "at", place.alias("place"), F.explode(near).alias("p"))
        tile = tile_of(F.col("p"), F.col("block")) if right else tile_of(F.col("block"), F.col("p"))
        salt = F.pmod(F.xxhash64("user"), F.lit(salts)).cast("int").alias("salt")
        return opened.select(tile.alias("tile"), salt, "user", F.lit(right).alias("right"), "at", "place", F.lit(None).cast("int").alias("cell"), F.lit(None).cast("bigint").alias("users"))

    return side(False).unionByName(side(True))


def cells(pairs: DataFrame, users: Column) -> DataFrame:
    """Pairs ``a, b`` of item numbers as rows for their tiles; ``users`` is their count so far."""
    block = lambda c: F.floor(F.col(c) / TILE)
    cell = (F.pmod("a", F.lit(TILE)) * TILE + F.pmod("b", F.lit(TILE))).cast("int")
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    return pairs.select(
        tile_of(block("a"), block("b")).alias("tile"), F.lit(0).alias("salt"), null("user", "bigint"), null("right", "boolean"), null("at", "array<smallint>"),
        null("place", "array<bigint>"), cell.alias("cell"), users.cast("bigint").alias("users"),
    )


class _Side:
    """The chunks of one side of a tile: whose they are, and the places and times of their items."""

    def __init__(self, rows: pa.Table, ordered: bool):
        self.user = rows.column("user").to_numpy()
        lists = rows.column("at").combine_chunks()
        self.offset = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int32)
        self.at = lists.flatten().to_numpy().astype(np.int64)
        self.place = rows.column("place").combine_chunks().flatten().to_numpy() if ordered else None

    def chunk(self, k: int) -> slice:
        return slice(self.offset[k], self.offset[k + 1])

    def incidence(self, members: np.ndarray, size: int) -> np.ndarray:
        matrix = np.zeros((len(members), size), np.float32)
        for row, k in enumerate(members.tolist()):
            matrix[row, self.at[self.chunk(k)]] = 1
        return matrix


def _meeting(rows: pa.Table, ordered: bool) -> tuple[_Side, _Side, np.ndarray, np.ndarray]:
    """The two sides of a tile, and the places of the baskets that have both."""
    right = rows.column("right").to_numpy(zero_copy_only=False).astype(bool)
    sides = [_Side(rows.filter(pa.array(keep)), ordered) for keep in (~right, right)]
    _, left_at, right_at = np.intersect1d(sides[0].user, sides[1].user, assume_unique=True, return_indices=True)
    return *sides, left_at, right_at


def _add(counts: np.ndarray, rows: pa.Table, ordered: bool) -> None:
    """Adds to ``counts`` the pairs of all baskets in ``rows``; if ``ordered``, those whose first item comes before the last of the second."""
    left, right, left_at, right_at = _meeting(rows, ordered)
    if ordered:
        for k, m in zip(left_at.tolist(), right_at.tolist(), strict=True):
            a, b = left.chunk(k), right.chunk(m)
            counts[np.ix_(left.at[a], right.at[b])] += left.place[a][:, None] < right.place[b][None, :]
        return
    lengths = np.diff(left.offset)[left_at] * np.diff(right.offset)[right_at]
    dense = lengths > counts.size // 100  # from here on a product of full rows takes less time
    for k, m in zip(left_at[~dense].tolist(), right_at[~dense].tolist(), strict=True):
        counts[np.ix_(left.at[left.chunk(k)], right.at[right.chunk(m)])] += 1
    left_at, right_at = left_at[dense], right_at[dense]
    for begin in range(0, len(left_at), PRODUCT):
        some = slice(begin, begin + PRODUCT)
        counts += (left.incidence(left_at[some], len(counts)).T @ right.incidence(right_at[some], len(counts))).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """Rows of one tile and salt, in order; the rows of one basket are never divided."""

    def split(table: pa.Table) -> Iterator[tuple[int, int, pa.Table]]:
        tile, salt = table.column("tile").to_numpy(), table.column("salt").to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], (tile[1:] != tile[:-1]) | (salt[1:] != salt[:-1])]))
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(tile)], strict=True):
            yield int(tile[begin]), int(salt[begin]), table.slice(begin, end - begin)

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= HELD_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            key = [np.asarray(pa.compute.fill_null(table.column(c), -1)) for c in ("tile", "salt", "user")]
            apart = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in key]))
            end = int(apart[-1]) + 1 if len(apart) else 0
            if end:
                yield from split(table.slice(0, end))
            held = table.slice(end).to_batches()
            rows = table.num_rows - end
    if rows:
        yield from split(pa.Table.from_batches(held).combine_chunks())


def _known(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Cells and counts of the pairs that are known, and the rows of chunks."""
    is_cell = rows.column("cell").is_valid()
    known = rows.filter(is_cell)
    return known.column("cell").to_numpy(), known.column("users").to_numpy(), rows.filter(pa.compute.invert(is_cell))


def _counting(least: int, ordered: bool, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, at = np.zeros((size, size), np.int64), None

        def full() -> pa.RecordBatch:
            block = at[0] >> 32, at[0] & 0xFFFFFFFF
            kept = counts if ordered or block[0] != block[1] else np.triu(counts, 1)
            a, b = np.nonzero(kept >= least)
            found = [pa.array(a + block[0] * size), pa.array(b + block[1] * size), pa.array(kept[a, b])]
            counts.fill(0)
            return pa.RecordBatch.from_arrays(found, ["a", "b", "users"])

        for tile, salt, rows in _pieces(batches):
            if at != (tile, salt):
                if at is not None:
                    yield full()
                at = tile, salt
            cell, users, sent = _known(rows)
            np.add.at(counts.reshape(-1), cell, users)
            if sent.num_rows:
                _add(counts, sent, ordered)
        if at is not None:
            yield full()

    return run


def _finding(size: int):
    """``user, a, b``: the known pairs that a basket holds in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, at = np.zeros((size, size), bool), None
        for tile, salt, rows in _pieces(batches):
            if at != (tile, salt):
                wanted.fill(False)
                at = tile, salt
            cell, _, sent = _known(rows)  # a tile's cells come before its chunks
            wanted.reshape(-1)[cell] = True
            if not sent.num_rows or not wanted.any():
                continue
            left, right, left_at, right_at = _meeting(sent, True)
            for k, m in zip(left_at.tolist(), right_at.tolist(), strict=True):
                a, b = left.chunk(k), right.chunk(m)
                i, j = np.nonzero(wanted[np.ix_(left.at[a], right.at[b])] & (left.place[a][:, None] < right.place[b][None, :]))
                if len(i):
                    found = [np.full(len(i), left.user[k]), left.at[a][i] + (tile >> 32) * size, right.at[b][j] + (tile & 0xFFFFFFFF) * size]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["user", "a", "b"])

    return run


def _arranged(rows: DataFrame) -> DataFrame:
    return rows.select(*_ROWS).repartition("tile", "salt").sortWithinPartitions("tile", "salt", "user", "right")


def pair_counts(cut: DataFrame, known: DataFrame, least: int, n_baskets: int, ordered: bool = False) -> DataFrame:
    """``a, b, users``: in how many baskets a pair of item numbers is, ``known`` ones (``a, b, users``) included, if in ``least`` or more.

    ``cut``: the ``chunks`` of ``n_baskets`` baskets. Without ``ordered``, a < b, and ``known`` has its pairs so.
    """
    salts = 1 + n_baskets // TILE_BASKETS
    sent = sent_chunks(cut, salts, ordered)
    if salts == 1:
        return map_arrow(_arranged(sent.unionByName(cells(known, F.col("users")))), _counting(least, ordered, TILE), "a bigint, b bigint, users bigint")
    parts = map_arrow(_arranged(sent), _counting(1, ordered, TILE), "a bigint, b bigint, users bigint")
    return parts.unionByName(known.select("a", "b", "users")).groupBy("a", "b").agg(F.sum("users").alias("users")).where(F.col("users") >= least)


def pairs_of_baskets(cut: DataFrame, wanted: DataFrame, n_baskets: int) -> DataFrame:
    """``user, a, b``: which of the pairs ``wanted`` (``a, b``) the baskets in ``cut`` hold in this order."""
    salts = 1 + n_baskets // TILE_BASKETS
    each = cells(wanted, F.lit(1)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return map_arrow(_arranged(sent_chunks(cut, salts, True).unionByName(each)), _finding(TILE), "user bigint, a bigint, b bigint")
