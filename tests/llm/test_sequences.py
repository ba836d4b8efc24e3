import random
from collections import defaultdict
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinograph.llm import sequences as S
from kinograph.llm import tiles as T

SCHEMA = "event_id long, user_id string, item_id string, timestamp long, item string, prefix string"


def log(spark, data):
    return spark.createDataFrame([(*d, "clash", None) for d in data], SCHEMA)


def subsequences(sequence, most=6):
    return {tuple(sequence[k] for k in places) for n in range(1, most + 1) for places in combinations(range(len(sequence)), n)}


def brute(sequences, threshold):
    counts = defaultdict(int)
    for s in sequences:
        for pattern in subsequences(s):
            counts[pattern] += 1
    return {p: n for p, n in counts.items() if n >= threshold}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=6), max_size=12), st.integers(1, 4))
def test_mining_equals_all_subsequences(sequences, threshold):
    expected = brute(sequences, threshold)
    singles = {p[0]: n for p, n in expected.items() if len(p) == 1}
    assert S.mine(sequences, threshold, singles) == expected


def histories(data, max_share):
    usable = {}
    for event, user, item, ts in sorted(data):
        if ts and ts > 0:
            usable.setdefault((int(user), int(item), ts), event)
    counts = defaultdict(int)
    for _, item, _ in usable:
        counts[item] += 1
    users = defaultdict(list)
    for (user, item, ts), event in usable.items():
        if counts[item] <= max_share * len(usable):
            users[user].append((ts, event, item))
    return [[i for _, _, i in sorted(rows)] for rows in users.values()]


def make(seed, users=40, items=12, length=7):
    random.seed(seed)
    data = []
    for u in range(users):
        for k in range(random.randint(1, length)):
            data.append((len(data), str(u + 1), f" 0{random.randint(1, items)}", random.randint(1, 6)))
        if u % 2:
            data += [(len(data) + k, str(u + 1), str(x), 10 + k) for k, x in enumerate((3, 9, 3, 5))]
        if u % 5 == 0:
            data.append((len(data), *data[-1][1:]))  # delivered twice
    return [(n, *d[1:]) for n, d in enumerate(data)]


@pytest.mark.parametrize("settings_", [{}, {"history": 4}, {"prefix_items": 40}, {"history": 5, "prefix_items": 60}])
def test_patterns_equal_brute_force(spark, rows, settings_):
    data = make(len(settings_))
    expected = {p: n for p, n in brute(histories(data, 0.5), 6).items() if len(p) > 1}
    found = S.frequent_sequences(log(spark, data), 6, 0.5, **settings_)
    assert dict(rows(found)) == {">".join(map(str, p)): n for p, n in expected.items()} and len(expected) > 20


def test_items_of_a_large_share_are_left_out(spark, rows):
    data = [(n, str(n // 3 + 1), str(n % 3 + 1), n % 3 + 1) for n in range(60)] + [(100 + n, str(n + 1), "2", 50 + k) for n in range(20) for k in range(4)]
    assert rows(S.frequent_sequences(log(spark, data), 12, 0.5)) == [("1>3", 20)]


def test_small_blocks_and_dirty_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ITEMS", 5)
    data = make(3)
    dirty = [(9000, None, "3", 5), (9001, "x", "3", 5), (9002, "1", "", 5), (9003, "1", "3", None), (9004, "1", "3", -1)]
    expected = {p: n for p, n in brute(histories(data, 0.9), 8).items() if len(p) > 1}
    assert dict(rows(S.frequent_sequences(log(spark, data + dirty), 8, 0.9))) == {">".join(map(str, p)): n for p, n in expected.items()}
    assert S.frequent_sequences(log(spark, []), 2).count() == 0


def test_long_histories_elsewhere_do_not_make_a_prefix_large(spark, rows, monkeypatch):
    data, n = [], 0
    for user in range(101):
        for place, item in enumerate([1, 2, 3] if user < 88 else []):
            data.append((n := n + 1, str(user + 1), str(item), place + 1))
        if user >= 88:
            for k in range(60):  # in another order for each user
                data.append((n := n + 1, str(user + 1), str(200 + (k * (user - 87)) % 61), 10 + k))
    events = log(spark, data)
    expected = rows(S.frequent_sequences(events, 12, 0.5, 10, 10**9).where("pattern LIKE '1>%'"))
    assert ("1>2>3", 88) in expected
    extended = []
    monkeypatch.setattr(S, "_extended", lambda *a, f=S._extended: extended.append(1) or f(*a))
    assert rows(S.frequent_sequences(events, 12, 1.0, 10, 5000).where("pattern LIKE '1>%'")) == expected
    assert not extended


def test_long_histories_of_many_users(spark, rows, monkeypatch):
    """Every history is long; there are several tiles and parts of tiles."""
    monkeypatch.setattr(T, "TILE", 8)
    data = make(5)
    expected = {p: n for p, n in brute(histories(data, 0.5), 6).items() if len(p) > 1}
    for baskets in (100_000, 10):
        monkeypatch.setattr(T, "TILE_BASKETS", baskets)
        found = S.frequent_sequences(log(spark, data), 6, 0.5, history=1)
        assert dict(rows(found)) == {">".join(map(str, p)): n for p, n in expected.items()} and len(expected) > 20
