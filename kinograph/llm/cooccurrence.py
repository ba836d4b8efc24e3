"""Items that appear together in the same basket, with support and lift."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm import tiles
from kinograph.llm.tiles import chunks, numbered_items, pair_counts
from kinograph.operators.interactions import user_items
from kinograph.session import BROADCAST_ROWS, written

#: Baskets of at most this many items are paired within one row; longer ones, however many there are, by tiles.
BASKET = 1000
#: An item in more than one of so many (basket, item) rows is joined by broadcast; there are fewer of them than this.
HEAVY = 1000


def with_items(rows: DataFrame, items: DataFrame, n_rows: int, *columns: str) -> DataFrame:
    """``rows`` of the items in ``items`` (``item, n``, unique) with those of its ``columns``, without a skewed shuffle.

    A counted list of at most BROADCAST_ROWS items is broadcast. A longer one is divided: items holding more than a
    HEAVY-th of the rows, of which there are fewer than HEAVY, are broadcast, the others are shuffled on the item.
    """
    if items.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(items.select("item", *columns)), "item")
    hot = F.broadcast(items.where(F.col("n") * HEAVY > n_rows).select("item", *columns))
    heavy = rows.join(hot, "item")
    light = rows.join(hot.select("item"), "item", "left_anti").join(items.where(F.col("n") * HEAVY <= n_rows).select("item", *columns), "item")
    return heavy.unionByName(light)


def _pairs(baskets: DataFrame) -> DataFrame:
    """``a, b`` with a < b, once per basket, from ``items`` (distinct, ascending)."""
    opened = baskets.select(F.posexplode("items").alias("at", "a"), "items").where(F.col("at") + 1 < F.size("items"))
    return opened.select("a", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("b"))


def with_users(rows: DataFrame, users: DataFrame, inside: bool) -> DataFrame:
    """``rows`` of the ``users``, or of all others. A counted list of few users is broadcast."""
    users = F.broadcast(users) if users.count() <= BROADCAST_ROWS else users
    return rows.join(users, "user", "left_semi" if inside else "left_anti")


def item_pairs(events: DataFrame, min_users: int = 12, min_lift: float = 0.0, basket: int = BASKET) -> DataFrame:
    """``item_a, item_b, users, users_a, users_b, lift, pmi`` of the pairs that at least ``min_users`` users both have and whose
    lift (users with both x all users / users with a / users with b) is ``min_lift`` or more; ``item_a < item_b``.

    A user's usable rows are one basket in which an item counts once. Items are kept only if a result is possible with them:
    in at least ``min_users`` baskets, and in at most a ``min_lift``-th of all (users with both are no more than users with
    either). Pairs are emitted in order from each basket and combined before the shuffle.

    Baskets longer than ``basket`` would emit pairs in the square of their length. They are never gathered: they are cut into
    chunks and counted by tiles, to which the pairs of the other baskets are sent with their counts. This holds for any number
    of long baskets. No pair is lost. An empty log gives no rows; ties need no rule, as nothing is ranked.
    """
    rows = written(user_items(events), "baskets")
    users = rows.groupBy("user").agg(F.count("*").alias("size"))
    long = F.coalesce(F.sum((F.col("size") > basket).cast("long")), F.lit(0))
    n_users, n_rows, n_long = users.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), long).first()

    margins = rows.groupBy("item").agg(F.count("*").alias("n"))
    margins = written(margins.where((F.col("n") >= min_users) & (F.col("n") * F.lit(float(min_lift)) <= n_users)), "margins")
    key = "at" if n_long else "item"  # by which pairs are counted
    if n_long:
        margins = numbered_items(margins)
    kept = with_items(rows, margins, n_rows, *([key] if n_long else []))
    if n_long:
        long_users = written(users.where(F.col("size") > basket).select("user"), "long")
        kept = written(kept, "kept")
        long_rows, kept = with_users(kept, long_users, True), with_users(kept, long_users, False)
    baskets = kept.groupBy("user").agg(F.array_sort(F.collect_list(key)).alias("items"))
    pairs = _pairs(baskets).groupBy("a", "b").agg(F.count("*").alias("users"))
    if n_long:
        pairs = pair_counts(chunks(long_rows, False), pairs, min_users, n_long)
    else:
        pairs = pairs.where(F.col("users") >= min_users)

    small = margins.count() <= BROADCAST_ROWS
    for side in ("a", "b"):
        margin = margins.select(F.col(key).alias(side), F.col("item").alias(f"item_{side}"), F.col("n").alias(f"n_{side}"))
        pairs = pairs.join(F.broadcast(margin) if small else margin, side)
    if n_long:  # numbers are in another order than items
        turned = F.col("item_a") > F.col("item_b")
        swap = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
        pairs = pairs.select("users", *(swap(x, y) for x, y in (("item_a", "item_b"), ("item_b", "item_a"), ("n_a", "n_b"), ("n_b", "n_a"))))
    exact = "CAST({} AS DECIMAL(19,0))"
    together = F.expr(exact.format("users")) * F.lit(Decimal(n_users))
    chance = F.expr(exact.format("n_a")) * F.expr(exact.format("n_b"))
    lift = F.col("users") * F.lit(float(n_users)) / F.col("n_a") / F.col("n_b")
    enough = pairs.where(together >= chance * F.lit(Decimal(str(min_lift))))
    return enough.select("item_a", "item_b", "users", F.col("n_a").alias("users_a"), F.col("n_b").alias("users_b"), lift.alias("lift"), F.log2(lift).alias("pmi"))
