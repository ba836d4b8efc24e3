import os
from collections import defaultdict

import numpy as np
import pytest

from kinograph.llm import packing as P
from kinograph.llm.tokens import RANK_FILE, encoding

pytestmark = pytest.mark.skipif(not os.path.exists(RANK_FILE), reason="no rank file")


def test_scores_equal_the_formula():
    items = [np.array(x) for x in ([1, 2, 2, 3], [2, 2, 5], [3, 9], [], [7])]
    shard = P.Shard(items)
    n, mean = len(items), np.mean([len(x) for x in items])
    for seed in items[:1]:
        for k, item in enumerate(items):
            score = 0.0
            for term in set(seed.tolist()):
                df, tf = sum(term in x for x in items), (item == term).sum()
                score += np.log1p((n - df + 0.5) / (df + 0.5)) * tf * (P.K1 + 1) / (tf + P.K1 * (1 - P.B + P.B * len(item) / mean)) if tf else 0
            assert np.isclose(shard.scores(0)[k], score, rtol=1e-5)


def test_seeds_take_their_neighbours_first():
    items = [np.full(60, 1), np.full(50, 2), np.full(40, 1), np.full(40, 2), np.full(3, 1)]
    assert P.fill(items, 100) == [[0, 2], [1, 3, 4]]
    assert P.fill([], 10) == []


def containers(spark, texts, **settings):
    documents = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, container string").coalesce(1)
    return P.pack_documents(documents, **settings).collect()


@pytest.mark.parametrize("settings", [{}, {"capacity": 64, "shard_items": 40}, {"capacity": 16, "shard_items": 16}])
def test_every_token_once_and_no_container_too_full(spark, settings):
    words = ["cook", "pot", "spoon", "garage", "river", "stirs", "lifts", "quietly"]
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 90)))) for _ in range(300)] + ["", None, "same", "same", "cook " * 5000]
    rows, capacity = containers(spark, texts, **settings), settings.get("capacity", P.CAPACITY)
    with open(RANK_FILE, "rb") as file:
        tokenizer = encoding(file.read())
    sizes = [len(tokenizer.encode_ordinary(t or "")) for t in texts]
    pieces, filled = defaultdict(list), defaultdict(int)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.first_token, r.tokens))
        filled[r.container] += r.tokens
    assert max(filled.values()) <= capacity and set(pieces) == set(range(len(texts)))
    for doc, parts in pieces.items():
        parts.sort()
        assert [p for p, _, _ in parts] == list(range(len(parts))) and sum(t for _, _, t in parts) == sizes[doc]
        assert [f for _, f, _ in parts] == [capacity * k for k in range(len(parts))] and all(t == capacity for _, _, t in parts[:-1])
        assert len(parts) == max(1, -(-sizes[doc] // capacity))
    assert len(filled) <= sum(sizes) / capacity * 1.1 + 2


def test_only_empty_documents(spark):
    rows = containers(spark, ["", None])
    assert len(rows) == 2 and len({r.container for r in rows}) == 1
    assert containers(spark, ["x"][:0] or [None])[0].tokens == 0
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_input_order_does_not_matter_and_neighbours_meet(spark):
    """Containers depend on neither splits nor shards of the input; copies and similar texts, however far apart, share one."""
    topics = [[f"{stem}{k}" for k in range(12)] for stem in ("cook", "river", "engine", "violin", "harbour", "library")]
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(topics[k % 6], int(rng.integers(8, 20)))) for k in range(480)]
    texts[400:440] = texts[:40]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def found(frame):
        return {r.doc_id: r.container for r in P.pack_documents(frame, 150, shard_items=64).collect()}

    one = found(documents.coalesce(1))
    assert one == found(documents.orderBy("text").repartition(5)) and len(one) == len(texts)
    mates = defaultdict(list)
    for doc, container in one.items():
        mates[container].append(doc % 6 if not 400 <= doc < 440 else (doc - 400) % 6)
    same = sum(x == y for m in mates.values() for x in m for y in m) - len(texts)
    assert same > 0.6 * sum(len(m) * (len(m) - 1) for m in mates.values())


def test_order_of_content():
    rng = np.random.default_rng(2)
    items = [np.concatenate([rng.integers(k % 5 * 50, k % 5 * 50 + 50, 30), [7]]) for k in range(400)] + [np.empty(0, np.int64)] * 3
    corpus = P.Corpus.of(items)
    points = P.projected(items, corpus)
    order = P.ContentOrder(points, 40)
    places = order.places(points)
    assert (places[:-3] >> P.SIGNS).max() < order.leaves and len(set(places[-3:])) == 1
    kinds = np.array([k % 5 for k in range(400)])[np.argsort(places[:400], kind="stable")]
    assert (kinds[1:] == kinds[:-1]).mean() > 0.9
    assert (P.ContentOrder(points[:0]).places(points) >= 0).all() and (P.ContentOrder(np.repeat(points[:1], 500, 0)).places(points) >= 0).all()
