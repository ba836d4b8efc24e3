"""Item sequences that many users follow, with any gaps between their items."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm.cooccurrence import with_items, with_users
from kinograph.llm.tiles import chunks, numbered_items, pair_counts, pairs_of_baskets, with_numbers
from kinograph.operators.indexing import dense_index
from kinograph.operators.interactions import usable_rows
from kinograph.session import BROADCAST_ROWS, map_arrow, written

#: Histories of at most this many rows are cut into suffixes within one row; longer ones, however many, are worked on by tiles.
HISTORY = 1000
#: Items that the suffixes of one prefix may hold to be mined in one task; larger prefixes are first extended in Spark.
PREFIX_ITEMS = 20_000_000
#: Items that are looked through at once in a Python worker.
BLOCK_ITEMS = 1_000_000

Pattern = tuple[int, ...]


def _advance(sequence: list[int], prefixes: list[Pattern], at: int, least: int) -> tuple[int, int] | None:
    """The smallest pattern of ``sequence`` that is not below (``at``, ``least``): a prefix's number and the item after it."""
    for k in range(at, len(prefixes)):
        end = 0
        try:
            for item in prefixes[k]:
                end = sequence.index(item, end) + 1
        except ValueError:
            continue
        after = sequence[end:]
        if k == at:
            after = [x for x in after if x >= least]
        if after:
            return k, min(after)
    return None


def direct_comparison(sequences: list[list[int]], prefixes: list[Pattern], threshold: int) -> dict[Pattern, int]:
    """The patterns of a prefix and one more item that at least ``threshold`` sequences hold, with their numbers.

    ``prefixes`` are all frequent patterns one item shorter, ascending. The sequences are kept in the order of their
    minimum pattern that is still open. If the first and the threshold-th of them are equal, that pattern is frequent and
    as many sequences as begin with it hold it. If not, no pattern below the threshold-th's can be frequent, and the
    sequences before it go on to their first pattern from there, so infrequent candidates are passed over uncounted.
    """
    queue = [(*found, n) for n, s in enumerate(sequences) if (found := _advance(s, prefixes, 0, 0)) is not None]
    heapify(queue)
    frequent: dict[Pattern, int] = {}
    while len(queue) >= threshold:
        head = [heappop(queue) for _ in range(threshold)]
        first, last = head[0][:2], head[-1][:2]
        if first == last:
            while queue and queue[0][:2] == first:
                head.append(heappop(queue))
            frequent[prefixes[first[0]] + (first[1],)] = len(head)
            last = (first[0], first[1] + 1)
        for k, item, n in head:
            found = (k, item) if (k, item) >= last else _advance(sequences[n], prefixes, *last)
            if found is not None:
                heappush(queue, (*found, n))
    return frequent


def mine(sequences: list[list[int]], threshold: int, followers: dict[int, int]) -> dict[Pattern, int]:
    """All patterns in at least ``threshold`` sequences. ``followers``: the single items that are frequent, with their numbers."""
    found: dict[Pattern, int] = {(item,): n for item, n in followers.items()}
    level = found
    while level:
        level = direct_comparison(sequences, sorted(level), threshold)
        found = found | level
    return found


def _mine_block(prefixes: list[str], lengths: np.ndarray, items: np.ndarray, threshold: int) -> Iterator[tuple[str, int]]:
    """Patterns of whole groups of suffixes. Single items are counted for all groups at once, and only the groups in which
    some are frequent are looked into further, with the other items left out."""
    names, group_of_row = np.unique(np.array(prefixes, dtype=object), return_inverse=True)
    values, code = np.unique(items, return_inverse=True)
    row = np.repeat(np.arange(len(prefixes)), lengths)
    once = np.unique(row * len(values) + code)
    pair, counts = np.unique(group_of_row[once // len(values)] * len(values) + once % len(values), return_counts=True)
    pair, counts = pair[counts >= threshold], counts[counts >= threshold]
    if not len(pair):
        return
    own = group_of_row[row] * len(values) + code
    keep = pair[np.searchsorted(pair, own).clip(max=len(pair) - 1)] == own
    row, code = row[keep], code[keep]
    cuts = np.flatnonzero(np.diff(row)) + 1
    begins = np.concatenate([[0], cuts])
    order = np.argsort(group_of_row[row[begins]], kind="stable")
    pieces = np.split(code, cuts)
    of_group: dict[int, dict[int, int]] = {}
    for key, n in zip(pair.tolist(), counts.tolist(), strict=True):
        of_group.setdefault(key // len(values), {})[key % len(values)] = n
    for group, members in groupby(order.tolist(), key=lambda k: int(group_of_row[row[begins[k]]])):
        patterns = mine([pieces[k].tolist() for k in members], threshold, of_group[group])
        for pattern, n in patterns.items():
            yield ">".join([names[group], *(str(values[x]) for x in pattern)]), n


def _mining(threshold: int, block_items: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes: list[str] = []
        lengths: list[np.ndarray] = []
        items: list[np.ndarray] = []

        def mined(upto: int) -> Iterator[pa.RecordBatch]:
            nonlocal prefixes, lengths, items
            length, item = np.concatenate(lengths), np.concatenate(items)
            cut = int(length[:upto].sum())
            result = list(_mine_block(prefixes[:upto], length[:upto], item[:cut], threshold))
            prefixes, lengths, items = prefixes[upto:], [length[upto:]], [item[cut:]]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in result], pa.string()), pa.array([n for _, n in result], pa.int64())], ["pattern", "users"])

        for batch in batches:
            prefixes += batch.column("prefix").to_pylist()
            suffix = batch.column("suffix")
            lengths.append(np.diff(suffix.offsets.to_numpy()))
            items.append(suffix.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            if sum(map(len, items)) >= block_items and prefixes and prefixes[0] != prefixes[-1]:
                yield from mined(prefixes.index(prefixes[-1]))
        if prefixes:
            yield from mined(len(prefixes))

    return run


def _suffixes(histories: DataFrame) -> DataFrame:
    """``prefix, suffix``: for each item of a history the rows after its first occurrence."""
    opened = histories.select(F.posexplode("items").alias("at", "item"), "items")
    first = opened.where((F.col("at") + 1 < F.size("items")) & (F.array_position("items", F.col("item")) == F.col("at") + 1))
    return first.select(F.col("item").cast("string").alias("prefix"), F.slice("items", F.col("at") + 2, F.size("items")).alias("suffix"))


def _extensions(suffixes: DataFrame, threshold: int) -> DataFrame:
    """``prefix, item, users`` of the single items that follow a prefix in at least ``threshold`` histories."""
    opened = suffixes.select("prefix", F.explode(F.array_distinct("suffix")).alias("item"))
    return opened.groupBy("prefix", "item").agg(F.count("*").alias("users")).where(F.col("users") >= threshold)


def _extended(suffixes: DataFrame, extensions: DataFrame) -> DataFrame:
    """Suffixes of the prefixes longer by one frequent item."""
    opened = suffixes.select("prefix", "suffix", F.explode(F.array_distinct("suffix")).alias("item")).join(extensions, ["prefix", "item"])
    rest = F.slice("suffix", F.array_position("suffix", F.col("item")).cast("int") + 1, F.size("suffix"))
    return opened.select(F.concat_ws(">", "prefix", F.col("item").cast("string")).alias("prefix"), rest.alias("suffix")).where(F.size("suffix") > 0)


def _large(suffixes: DataFrame, maybe: DataFrame, most_items: int) -> DataFrame:
    """Those of the prefixes ``maybe`` whose suffixes hold more than ``most_items`` items."""
    maybe = written(maybe, "maybe")
    if maybe.isEmpty():
        return maybe
    held = suffixes.join(maybe, "prefix", "left_semi").groupBy("prefix").agg(F.sum(F.size("suffix")).alias("items"))
    return held.where(F.col("items") > most_items).select("prefix")


def _long_suffixes(rows: DataFrame, suffixes: DataFrame, kept: DataFrame, min_users: int, n_long: int) -> DataFrame:
    """Suffixes of the long histories in ``rows`` (``user, item, ts, event_id``), holding only the items that follow their prefix in
    ``min_users`` histories or more; ``suffixes``: those of all other histories.

    Pairs of items that follow each other are counted by tiles, together with those of the other histories. Only for the
    frequent ones, which are patterns of the result, the long histories' rows are joined to their prefixes.
    """
    index = numbered_items(kept)
    placed = written(dense_index(rows.join(F.broadcast(index) if index.count() <= BROADCAST_ROWS else index, "item").select("user", "at", "ts", "event_id"), ["user", "ts", "event_id", "at"], "place"), "placed")
    ends = written(placed.groupBy("user", "at").agg(F.min("place").alias("first"), F.max("place").alias("last")), "ends")
    cut = written(chunks(ends, True), "chunks")
    number = index.select(F.col("item"), F.col("at").alias("number"))
    number = F.broadcast(number) if index.count() <= BROADCAST_ROWS else number
    others = _extensions(suffixes, 1).join(number.withColumnRenamed("number", "b"), "item").drop("item")
    others = others.withColumn("item", F.col("prefix").cast("bigint")).join(number.withColumnRenamed("number", "a"), "item").select("a", "b", "users")
    frequent = written(pair_counts(cut, others, min_users, n_long, ordered=True), "frequent")
    held = pairs_of_baskets(cut, frequent, n_long).join(ends.select("user", F.col("at").alias("a"), "first"), ["user", "a"])
    after = held.join(placed.select("user", F.col("at").alias("b"), "place"), ["user", "b"]).where("place > first")
    named = with_numbers(with_numbers(after, index, "b", "item"), index, "a", "prefix")
    grouped = named.groupBy("user", "prefix").agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("s"))
    return grouped.select(F.col("prefix").cast("string").alias("prefix"), F.col("s.item").alias("suffix"))


def frequent_sequences(
    events: DataFrame, min_users: int = 12, max_share: float = 0.01, history: int = HISTORY, prefix_items: int = PREFIX_ITEMS
) -> DataFrame:
    """``pattern, users``: sequences of two or more items (``12>7>30``) that occur in this order, with any gaps, in the
    histories of at least ``min_users`` users, and the number of those users. An item may come again in a sequence.

    A history is a user's usable rows by timestamp, then event_id (null first), without the items that have more than
    ``max_share`` of all usable rows. Items in fewer than ``min_users`` rows cannot occur in a result and are left out.

    Each history gives, for each of its items, the rows after the item's first occurrence; shuffled by that item, they
    hold all that decides the patterns beginning with it. There the items that follow often enough are counted, and longer
    patterns are found by direct comparison of the sequences' minimum patterns. Prefixes whose suffixes hold more than
    ``prefix_items`` items are extended by further items in Spark until they are smaller, so no task grows with the input.

    Histories longer than ``history``, any number of them, are never gathered whole. Which items follow each other in them is
    counted by tiles together with all other histories, and of each only the rows that follow a prefix in a frequent pair go
    on, one list for each such prefix, whose length is what the results need. Nothing is lost.
    """
    rows = written(usable_rows(events), "usable")
    counts = written(rows.groupBy("item").agg(F.count("*").alias("n")), "counts")
    n_rows = counts.agg(F.sum("n")).first()[0] or 0
    kept = counts.where((F.col("n") >= min_users) & (F.col("n") <= n_rows * max_share))
    light = with_items(rows, kept, n_rows)

    long_users = written(light.groupBy("user").agg(F.count("*").alias("size")).where(F.col("size") > history).select("user"), "long")
    n_long = long_users.count()
    if n_long:
        light = written(light, "light")
        long_rows, light = with_users(light, long_users, True), with_users(light, long_users, False)
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "item")))
    suffixes = _suffixes(light.groupBy("user").agg(ordered.getField("item").alias("items")))
    if n_long:
        suffixes = written(suffixes, "suffixes")
        suffixes = suffixes.unionByName(_long_suffixes(long_rows, suffixes, kept, min_users, n_long))

    patterns = []
    small, most_rows = suffixes, max(1, prefix_items // history)
    maybe = kept if n_long else kept.where(F.col("n") > most_rows)  # the long histories are not bounded by ``history``
    large = written(_large(suffixes, maybe.select(F.col("item").cast("string").alias("prefix")), prefix_items), "large")
    while not large.isEmpty():
        bounded = large.count() <= 100_000
        large = F.broadcast(large) if bounded else large
        wide = written(suffixes.join(large, "prefix", "left_semi"), "wide")
        small = small.join(large, "prefix", "left_anti")
        extensions = written(_extensions(wide, min_users), "extensions")
        name = F.concat_ws(">", "prefix", F.col("item").cast("string"))
        patterns.append(extensions.select(name.alias("pattern"), "users"))
        suffixes = _extended(wide, extensions)
        maybe = extensions if n_long else extensions.where(F.col("users") > most_rows)
        large = written(_large(suffixes, maybe.select(name.alias("prefix")), prefix_items), "large")
        small = small.unionByName(suffixes)
    grouped = small.repartition("prefix").sortWithinPartitions("prefix")
    patterns.append(map_arrow(grouped, _mining(min_users, BLOCK_ITEMS), "pattern string, users bigint"))
    result = patterns[0]
    for more in patterns[1:]:
        result = result.unionByName(more)
    return result
