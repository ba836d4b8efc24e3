from collections import defaultdict

from kinograph.operators.interactions import usable_rows
from kinograph.operators.skew import dominant_items, item_activity

SCHEMA = "event_id long, user_id string, item_id string, timestamp long, source_event_id long, item string"


def log(spark, data):
    return spark.createDataFrame([(*d, None, "clash") for d in data], SCHEMA)


DATA = [
    (0, "1", "7", 10), (1, " 01\t", "007", 10), (2, "1", "7", 11), (3, "2", "7", 5), (4, None, "7", 5), (5, "", "7", 5), (6, "2", "x", 5), (7, "2", "8", None), (8, "2", "8", 0), (9, "2", "8", -4),
    (10, "3", "8", 9), (11, "0", "8", 9), (12, "1.5", "8", 9), (13, "+3", "8", 9), (14, "３", "8", 9), (15, "3\n", "8", 9), (16, "12345678901234567890", "8", 9),
]


def test_usable_rows(spark, rows):
    usable = rows(usable_rows(log(spark, DATA)), "event_id")
    assert usable == [(0,), (10,), (16,), (2,), (3,)]


def test_item_activity(spark, rows):
    found = rows(item_activity(log(spark, DATA)))
    assert [(r[0], r[1], r[2], round(r[3], 6), r[4], r[5]) for r in found] == [(7, 3, 2, 0.6, 5, 11), (8, 2, 2, 0.4, 9, 9)]


def test_heavy_and_light_items_equal_a_plain_count(spark, rows):
    data, expected = [], defaultdict(set)
    for n in range(6000):
        item = 1 if n % 3 == 0 else 2 + (n * 7919) % 400
        user, ts = (5 if n % 4 == 0 else n % 97 + 1), 1 + n % 50
        data.append((n, str(user), str(item), ts))
        expected[item].add((user, ts))
    total = sum(map(len, expected.values()))
    for most in (10_000, 100, 1):  # all heavy, some heavy, none
        found = {r[0]: tuple(r)[1:] for r in item_activity(log(spark, data), most).collect()}
        assert found == {i: (len(s), len({u for u, _ in s}), len(s) / total, min(t for _, t in s), max(t for _, t in s)) for i, s in expected.items()}
    assert rows(dominant_items(log(spark, data))) == sorted([(i,) for i, s in expected.items() if len(s) > 0.02 * total])


def test_empty_log(spark):
    assert item_activity(log(spark, [])).count() == 0
