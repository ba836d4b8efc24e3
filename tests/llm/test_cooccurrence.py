import math
from collections import defaultdict
from itertools import combinations

import pytest

from kinograph.llm import cooccurrence as C

SCHEMA = "event_id long, user_id string, item_id string, timestamp long, a string, users string"


def log(spark, data):
    return spark.createDataFrame([(n, *d, "clash", None) for n, d in enumerate(data)], SCHEMA)


def brute(data, least, lift):
    baskets, sides, pairs = defaultdict(set), defaultdict(int), defaultdict(int)
    for user, item, ts in data:
        if user and item and ts and ts > 0:
            baskets[int(user)].add(int(item))
    for basket in baskets.values():
        for item in basket:
            sides[item] += 1
        for pair in combinations(sorted(basket), 2):
            pairs[pair] += 1
    n = len(baskets)
    return {p: (k, sides[p[0]], sides[p[1]]) for p, k in pairs.items() if k >= least and k * n >= lift * sides[p[0]] * sides[p[1]]}


def make():
    data = [(str(u), str(i), 1 + u % 3) for u in range(1, 61) for i in range(1, 25) if (u * i) % 7 < 2]
    data += [("99", str(i), 5) for i in range(1, 25)] + [("98", str(i), 5) for i in range(1, 22)]  # long baskets
    return data + data[:50] + [(None, "1", 1), ("", "2", 1), ("1", "3", 0), ("1", "4", None)]


@pytest.mark.parametrize("basket", [1000, 12])
@pytest.mark.parametrize("lift", [0, 1.5, 2])
@pytest.mark.parametrize("small", [True, False])
def test_pairs_equal_brute_force(spark, monkeypatch, basket, lift, small):
    if not small:
        monkeypatch.setattr(C, "BROADCAST_ROWS", 2)
        monkeypatch.setattr(C, "HEAVY", 20)
    data = make()
    found = C.item_pairs(log(spark, data), 5, lift, basket).collect()
    expected = brute(data, 5, lift)
    assert {(r.item_a, r.item_b): (r.users, r.users_a, r.users_b) for r in found} == expected and expected
    n = len({d[0] for d in data if d[0]})
    for r in found:
        assert math.isclose(r.lift, r.users * n / r.users_a / r.users_b) and math.isclose(r.pmi, math.log2(r.lift), abs_tol=1e-9)


def test_exact_limits_and_empty_log(spark):
    data = [(str(u), i, 1) for u in range(1, 13) for i in ("1", "2")] + [(str(u), "3", 1) for u in range(13, 25)]
    assert [(r.item_a, r.item_b, r.lift) for r in C.item_pairs(log(spark, data), 12, 2).collect()] == [(1, 2, 2.0)]
    assert C.item_pairs(log(spark, data), 13, 0).count() == 0
    assert C.item_pairs(log(spark, []), 12, 2).count() == 0


def test_long_baskets_of_many_users(spark, monkeypatch):
    """Every user's basket is long, and there are several tiles and parts of tiles."""
    monkeypatch.setattr(C.tiles, "TILE", 8)
    data = make()
    expected = brute(data, 5, 0)
    for baskets in (100_000, 20):
        monkeypatch.setattr(C.tiles, "TILE_BASKETS", baskets)
        found = C.item_pairs(log(spark, data), 5, 0, 1).collect()
        assert {(r.item_a, r.item_b): (r.users, r.users_a, r.users_b) for r in found} == expected
