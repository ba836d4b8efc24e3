import math

import numpy as np
import pytest

from kinograph.llm import neighbours as N

SCHEMA = "vec_id long, vec array<float>, id string, unit string"


def frame(spark, vectors):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], "clash", None) for k, v in vectors], SCHEMA)


def brute(vectors, k):
    ids = np.array([i for i, _ in vectors])
    unit = np.array([v for _, v in vectors], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    similarity = unit @ unit.T
    np.fill_diagonal(similarity, -9)
    return {int(ids[r]): [int(ids[c]) for c in np.lexsort((ids, -similarity[r]))[: min(k, len(ids) - 1)]] for r in range(len(ids))}


def test_recall(spark):
    rng = np.random.default_rng(0)
    vectors = [(k, v) for k, v in enumerate(rng.standard_normal((3000, 64)))]
    found = N.most_similar(frame(spark, vectors), 10).toPandas()
    expected = brute(vectors, 10)
    assert (found.groupby("id").size() == 10).all() and len(found) == 30_000
    hits = sum(len(set(g.other) & set(expected[i])) for i, g in found.groupby("id"))
    assert hits / 30_000 >= 0.95
    matrix = np.array([v / np.linalg.norm(v) for _, v in vectors])
    sample = found.sample(200, random_state=1)
    assert np.allclose(sample.cosine, np.einsum("ij,ij->i", matrix[sample.id], matrix[sample.other]), atol=1e-6)


def test_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    good = rng.standard_normal((60, 64))
    copies = [(100 + k, good[0] * 2.0 ** (k % 5)) for k in range(40)]  # a large group of one direction
    bad = [(500, None), (501, [0.0] * 64), (502, [1.0] * 63), (503, [math.nan] * 64), (504, [math.inf] + [0.0] * 63), (505, [None] + [1.0] * 63), (None, good[1])]
    vectors = [(k, v) for k, v in enumerate(good)] + copies
    found = N.most_similar(frame(spark, vectors + bad), 10).toPandas()
    assert set(found.id) == {k for k, _ in vectors} and (found.groupby("id").size() == 10).all()
    group = [0, *range(100, 140)]
    for member in (0, 100, 139):
        own = found[found.id == member].sort_values("rank")
        assert own.other.tolist() == [x for x in group if x != member][:10] and np.allclose(own.cosine, 1)
    pairs = N.similar_pairs(N.most_similar(frame(spark, vectors), 10), 0.9)
    assert pairs.where("vec_a >= vec_b").count() == 0 and pairs.count() == pairs.distinct().count() > 0


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_vectors(spark, n):
    rng = np.random.default_rng(2)
    vectors = [(k, v) for k, v in enumerate(rng.standard_normal((n, 64)))]
    found = N.most_similar(frame(spark, vectors), 10).collect()
    assert len(found) == n * max(n - 1, 0)
    expected = brute(vectors, 10) if n > 1 else {}
    for k, others in expected.items():
        assert [r.other for r in sorted(found, key=lambda r: r["rank"]) if r.id == k] == others


def test_greedy_search(spark):
    rng = np.random.default_rng(3)
    vectors = [(k, v) for k, v in enumerate(rng.standard_normal((2500, 64)))]
    found = N.graph_search(frame(spark, vectors), every=50).toPandas()
    expected = brute(vectors, 10)
    assert set(found["query"]) == set(range(0, 2500, 50)) and (found.groupby("query").size() == 10).all() and (found["query"] != found.id).all()
    hits = sum(len(set(g.id) & set(expected[q])) for q, g in found.groupby("query"))
    assert hits / len(found) >= 0.95
    assert N.graph_search(frame(spark, [])).count() == 0
    assert [(r.query, r.id) for r in N.graph_search(frame(spark, vectors[:2]), every=2).collect()] == [(0, 1)]


def test_greedy_search_with_a_third_of_copies(spark):
    rng = np.random.default_rng(4)
    hot = rng.standard_normal(64)
    hot /= np.linalg.norm(hot)
    others = rng.standard_normal((1000, 64))
    groups = []
    for _ in range(10):  # tight groups, moderately similar to the copies
        aside = rng.standard_normal(64)
        aside -= aside @ hot * hot
        centre = 0.5 * hot + math.sqrt(0.75) * aside / np.linalg.norm(aside)
        groups += [centre + 0.02 * rng.standard_normal(64) for _ in range(20)]
    vectors = list(enumerate([*groups, *others, *[hot] * 600]))
    found = N.graph_search(frame(spark, vectors), every=5).toPandas()
    expected = brute(vectors, 10)
    own = found[found["query"] < 200]
    assert (found.groupby("query").size() == 10).all() and set(found["query"]) == set(range(0, 1800, 5))
    assert sum(len(set(g.id) & set(expected[q])) for q, g in own.groupby("query")) / len(own) >= 0.95
    copies = found[found["query"] == 1500].sort_values("rank")
    assert copies.id.tolist() == list(range(1200, 1210)) and np.allclose(copies.cosine, 1)


def test_dense_group_of_near_copies(spark):
    """Cosines that half precision cannot tell apart, at norms that round differently."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    group = [(centre + 3e-3 * rng.standard_normal(64)) * 1.1**k for k in range(35)]
    vectors = [(k, v.astype(np.float32)) for k, v in enumerate([*group, *rng.standard_normal((100, 64))])]
    found = N.most_similar(frame(spark, vectors), 10).toPandas()
    expected = brute(vectors, 10)
    assert sum(len(set(g.other) & set(expected[i])) for i, g in found.groupby("id") if i < 35) >= 345


def test_block_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = [(k, v) for k, v in enumerate(rng.standard_normal((700, 64)))]
    units = N.unit_vectors(frame(spark, vectors)).cache()
    queries = units.where("id % 100 = 0").selectExpr("id AS query", "unit")
    expected = brute(vectors, 10)
    for block in (64, 8192):
        found = N.block_search(units, queries, 11, block).where("query <> id").toPandas().sort_values(["query", "rank"])
        assert {q: g.id.tolist() for q, g in found.groupby("query")} == {q: expected[q] for q in range(0, 700, 100)}
    assert N.block_search(units.limit(0), queries).count() == 0 and N.block_search(units, queries.limit(0)).count() == 0


def test_hub_in_all_lists(spark):
    """A vector that is near to all others is in all lists; its own list is right, and theirs are too."""
    rng = np.random.default_rng(6)
    spread = rng.standard_normal((1500, 64))
    vectors = [(0, np.ones(64))] + [(k + 1, np.ones(64) * 2 + v) for k, v in enumerate(spread)]
    found = N.most_similar(frame(spark, vectors), 10).toPandas()
    expected = brute(vectors, 10)
    hits = {i: len(set(g.other) & set(expected[i])) for i, g in found.groupby("id")}
    assert hits[0] >= 9 and sum(hits.values()) >= 0.95 * 10 * len(vectors)
    assert (found.other == 0).sum() > 1000
