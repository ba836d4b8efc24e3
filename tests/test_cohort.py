import math

import pytest

from kinograph.operators import cohort as K
from kinograph.operators.indexing import dense_index, first_seen_ids

LOG = "user long, item long, ts long, event_id long"


def test_leave_one_out_with_ties(spark, rows):
    log = spark.createDataFrame([(1, 11, 5, 2), (1, 12, 5, 1), (1, 13, 5, 0), (1, 14, 9, 3), (1, 15, 10, 4)], LOG)
    split = K.leave_one_out(K.retained_sequences(log))
    assert rows(split, "event_id", "phase", "position") == [(0, "train", 0), (1, "train", 1), (2, "train", 2), (3, "validation", 3), (4, "test", 4)]
    assert rows(K.split_summary(split)) == [("test", 1, 1, 0), ("train", 3, 2, 1), ("validation", 1, 1, 0)]


def sequences(spark):
    data = [(u, 100 * u + k, 1000 * k, 50 * u + k) for u, n in ((1, 5), (2, 6), (3, 16), (4, 4)) for k in range(n)]
    return spark.createDataFrame(data, LOG)


def test_retained_trimmed_and_excluded(spark, rows):
    log = sequences(spark)
    kept = K.retained_sequences(log)
    assert [(u, kept.where(f"user = {u}").count()) for u in (1, 2, 3, 4)] == [(1, 5), (2, 6), (3, 13), (4, 0)]
    assert rows(K.user_activity(log), "user", "excluded", "trimmed") == [(1, False, 0), (2, False, 0), (3, False, 3), (4, True, 0)]
    numbered = rows(K.renumbered(kept), "event_id", "source_event_id")
    assert [n for n, _ in sorted(numbered)] == list(range(24)) and [s for _, s in sorted(numbered)] == sorted(s for _, s in numbered)


def test_histories_are_padded(spark):
    kept = K.retained_sequences(sequences(spark))
    inputs = {r.event_id: r for r in K.history_inputs(kept, K.item_index(kept)).where("user = 3").collect()}
    assert inputs[153].history == [0] * 10
    first = inputs[153].target
    assert inputs[156].history == [first, first + 1, first + 2] + [0] * 7
    assert inputs[165].history == list(range(first + 2, first + 12))


def test_popularity(spark):
    split = K.leave_one_out(K.retained_sequences(sequences(spark)))
    found = K.popularity(split).collect()
    assert len(found) == 15 and all(r.n == 1 and math.isclose(r.q, 1 / 15) and math.isclose(r.log_q, math.log(1 / 15)) for r in found)
    assert K.train_frequency(split).count() == 18
    tests = K.untrained_targets(split).first()
    assert (tests.tests, tests.untrained) == (3, 1.0)


def test_counts_and_fingerprint(spark):
    log = spark.createDataFrame([(1, 2, 3, 0), (1, 2, 3, 1), (1, 2, 2, 2)], LOG)
    assert tuple(K.cohort_counts(log).first()) == (1, 1, 3, 1)
    assert K.log_fingerprint(log.orderBy("ts")).first() == K.log_fingerprint(log.repartition(3)).first()
    assert tuple(K.cohort_counts(log.limit(0)).first()) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        K.retained_sequences(log, 5, 4)


def test_dense_and_first_seen_numbers(spark, rows):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k").repartition(7)
    assert rows(dense_index(df, ["k"], "n").where("k <> n")) == []
    texts = spark.createDataFrame([(3, "b "), (1, "a"), (2, "b"), (5, ""), (4, None), (9, "a")], "p int, t string")
    assert rows(first_seen_ids(texts, "t", ["p"], "n")) == [("", 0), ("a", 1), ("b", 2)]
