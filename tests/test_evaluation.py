import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinograph.operators import diagnosis as D
from kinograph.operators import ranking as R
from kinograph.operators import throughput as T
from kinograph.operators import towers as N
from kinograph.operators import vectors as V


@pytest.mark.parametrize("block", [3, 1000])
def test_masked_ranks(spark, block):
    rng = np.random.default_rng(1)
    items = rng.integers(-3, 4, (12, 4))
    table = spark.createDataFrame([(k + 1, x.tolist()) for k, x in enumerate(items)], "item_idx long, vector array<long>")
    cases = [(n, int(rng.integers(1, 13)), rng.integers(0, 13, 5).tolist()) for n in range(40)] + [(40, 3, list(range(1, 13))), (41, 5, [0, 0])]
    users = spark.createDataFrame(cases, "event_id long, target long, history array<long>")
    found = {r.event_id: r["rank"] for r in R.masked_ranks(R.user_vectors(users, table, 4), table, 4, block).collect()}
    for event, target, history in cases:
        seen = {h for h in history if h}
        user = sum((items[h - 1] for h in history if h), np.zeros(4, np.int64))
        scores = [(-math.inf if k + 1 in seen else int(items[k] @ user)) for k in range(12)]
        order = sorted(range(1, 13), key=lambda k: (-scores[k - 1], k))
        assert found[event] == order.index(target) + 1


def test_metrics(spark):
    row = spark.createDataFrame([(1,), (10,), (11,)], "rank int").select(*R.metrics(F.col("rank"), (4, 10))).collect()
    for got, expected in zip(row, [(1.0, 1.0, 1.0, 1.0), (0.0, 1.0, 0.0, 1 / math.log2(11)), (0.0, 0.0, 0.0, 0.0)], strict=True):
        assert tuple(got) == pytest.approx(expected)


def test_loss_equals_numpy(spark):
    rng = np.random.default_rng(3)
    n, users, items = 6, rng.integers(-9, 9, (6, 3)), rng.integers(-9, 9, (6, 3))
    targets = [1, 2, 3, 1, 5, 6]
    histories = [[2, 0], [0, 0], [5, 6], [3, 0], [1, 0], [0, 0]]
    log_q = {t: math.log(t / 20) for t in range(1, 7)}
    batch = spark.createDataFrame([(0, k, k, targets[k], histories[k]) for k in range(n)], "batch_id long, row long, event_id long, target long, history array<long>")
    masked = {(r.row, r.other): r.masked for r in R.negative_mask(batch).collect()}
    expected = {(i, j): targets[j] in histories[i] or targets[i] == targets[j] for i in range(n) for j in range(n) if i != j}
    assert masked == expected
    vectors = spark.createDataFrame([(k, users[k].tolist(), items[k].tolist()) for k in range(n)], "event_id long, user_vector array<long>, target_vector array<long>")
    q = spark.createDataFrame(list(log_q.items()), "target long, log_q double")
    mask = np.array([[expected.get((i, j), False) for j in range(n)] for i in range(n)])
    loss = N.in_batch_loss(users / 10.0, items.astype(float), np.array([log_q[t] for t in targets]), mask)
    assert math.isclose(R.in_batch_loss(batch, vectors, q, 10.0).first().loss, loss, rel_tol=1e-9)


@pytest.mark.parametrize("group", [1, 256])
def test_loss_of_histories(spark, group):
    """Rows of three batches, an item of zeros, one without a catalog row, padded histories; item 6 has two vectors, as in a join."""
    rng = np.random.default_rng(5)
    n, d = 30, 3
    items = {k: [rng.integers(-9, 9, d)] for k in range(1, 9)} | {7: [np.zeros(d, np.int64)]}
    items[6].append(rng.integers(-9, 9, d))
    log_q = {t: math.log(t / 50) for t in range(1, 10)}  # 9 has no row
    cases = [(k // 12, k % 12, int(rng.integers(1, 10)), rng.integers(0, 10, 4).tolist()) for k in range(n)]
    batch = spark.createDataFrame(cases, "batch_id long, row long, target long, history array<long>")
    table = spark.createDataFrame([(k, v.tolist()) for k, vs in items.items() for v in vs] + [(9, [0] * d)], "item_idx long, vector array<long>")
    q = spark.createDataFrame(list(log_q.items()), "target long, log_q double")
    found = {r.batch_id: r.loss for r in R.history_loss(batch, table, q, d, 10.0, group).collect()}
    for b in range(3):
        rows, losses = [c for c in cases if c[0] == b], []
        for _, row, target, history in rows:
            user = sum((v for h in history if h for v in items.get(h, [])), np.zeros(d))
            logits = [
                (other == row, -10000.0 if other != row and (t in history or t == target) else float(user @ v) / 10 - log_q[t])
                for _, other, t, _ in rows for v in items.get(t, [np.zeros(d)])
            ]
            own = [x for mine, x in logits if mine]
            losses.append(math.log(len(own) * sum(math.exp(x) for _, x in logits)) - max(own))
        assert math.isclose(found[b], sum(losses) / len(losses), rel_tol=1e-9)


def test_loss_needs_log_q_and_no_pairs_of_rows(spark):
    batch = spark.createDataFrame([(0, 0, 1, [2]), (0, 1, 2, [0])], "batch_id long, row long, target long, history array<long>")
    table = spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "item_idx long, vector array<long>")
    q = spark.createDataFrame([(1, -1.0)], "target long, log_q double")
    loss = R.history_loss(batch, table, q, 2, 10.0)
    with pytest.raises(Exception, match="a target has no log_q"):
        loss.collect()
    plan = loss._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any("batch_id" in line for line in plan.splitlines() if "Join" in line)


def test_seed_summary_and_relative_change(spark):
    data = [("a", s, u, v) for s, values in enumerate(((1.0, 3.0), (3.0, 5.0))) for u, v in enumerate(values)] + [("b", 0, 0, 6.0), ("z", 0, 0, 0.0)]
    metrics = spark.createDataFrame(data, "arm string, seed int, user long, m double")
    found = {r.arm: (r["mean"], r.sd) for r in D.seed_summary(metrics, "m").collect()}
    assert found == {"a": (3.0, math.sqrt(2)), "b": (6.0, 0.0), "z": (0.0, 0.0)}
    summary = D.seed_summary(metrics, "m")
    assert {r.arm: r.change for r in D.relative_change(summary, "a").collect()} == {"a": 0.0, "b": 1.0, "z": -1.0}
    assert {r.change for r in D.relative_change(summary, "z").collect()} == {None}


def test_paired_bootstrap(spark):
    values = [(u, a, u / 7 + d) for u in range(60) for a, d in (("base", 0.0), ("more", 0.25))]
    df = spark.createDataFrame(values, "user long, arm string, value double")
    draws = D.bootstrap(df, 50)
    wide = draws.groupBy("draw").pivot("arm", ["base", "more"]).agg(F.first("mean"))
    assert all(math.isclose(r.more - r.base, 0.25, abs_tol=1e-9) for r in wide.collect())
    again = {(r.draw, r.arm): r["mean"] for r in D.bootstrap(df.repartition(5), 50).collect()}
    assert {(r.draw, r.arm): r["mean"] for r in draws.collect()} == pytest.approx(again)
    observed = df.groupBy("arm").agg(F.avg("value").alias("mean"))
    row = D.comparisons(observed, draws, ["base", "more"]).first()
    assert (row.left, row.right, row.superior, row.inferior) == ("more", "base", True, False) and math.isclose(row.low, 0.25, abs_tol=1e-9)
    assert D.pairs(["d", "b", "g"]) == [("b", "d"), ("g", "d"), ("g", "b")]
    weights = D.weights(np.random.default_rng(1).integers(0, 2**32, 500), 400)
    assert abs(weights.mean() - 1) < 0.01 and abs(weights.var() - 1) < 0.02 and abs(np.corrcoef(weights[:, 0], weights[:, 1])[0, 1]) < 0.15
    hashes = [r[0] for r in spark.range(60).select(D.hash_number(F.lit(42), "id")).collect()]
    drawn = D.weights(np.array(hashes), 50)
    base = np.array([u / 7 for u in range(60)])
    assert {r.draw: r["mean"] for r in draws.where("arm = 'base'").collect()} == pytest.approx({d: float(drawn[:, d] @ base / drawn[:, d].sum()) for d in range(50)})


def test_run_comparison(spark):
    schema = "user long, arm string, m double"
    one, two = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.5)], schema), spark.createDataFrame([(2, "a", 1.0), (1, "a", 0.5)], schema)
    assert tuple(D.compare_runs(one, two, ["user", "arm"], "m").first()) == ("a", 2, 0.25)
    with pytest.raises(ValueError):
        D.compare_runs(one, two.limit(1), ["user", "arm"], "m")
    for left, right in ((one.withColumn("seed", F.lit(1)), two.withColumn("seed", F.lit(2))), (one.withColumn("split", F.lit("a")), two)):
        with pytest.raises(ValueError):
            D.compare_runs(left, right, ["user", "arm"], "m")


@pytest.mark.parametrize(
    ("scores", "patience", "delta", "expected"),
    [([0.2, 0.9, 0.9, 0.1], 2, 0.0, (2, 0.9, 4)), ([0.1, 0.2, 0.3], 5, 0.0, (3, 0.3, 3)), ([0.5, 0.505, 0.51, 0.515], 2, 0.02, (3, 0.51, 3)), ([0.5, 0.4, 0.3, 0.9], 2, 0.0, (1, 0.5, 3))],
)
def test_early_stopping(spark, scores, patience, delta, expected):
    df = spark.createDataFrame([("r", k, s) for k, s in enumerate(scores, 1)], "run string, epoch int, score double")
    assert tuple(D.early_stopping(df, patience, delta).first())[1:] == expected


def test_trailing_counts(spark, rows):
    seconds = [0, 5, 179, 180, 181, 360, 361, 1000, 1000]
    df = spark.createDataFrame([(s,) for s in seconds], "s long").select(F.timestamp_seconds("s").alias("ts"))
    expected = sorted({s: (s, seconds.count(s), sum(s - 180 < x <= s for x in seconds)) for s in seconds}.values(), key=repr)
    assert rows(T.trailing_counts(df)) == expected


def test_vector_groups(spark, rows):
    data = spark.createDataFrame([(1, "a", [2, 4]), (2, "a", [4, 0]), (3, "b", [1, 1])], "scene long, g string, vector array<long>")
    groups = spark.createDataFrame([("a",), ("b",), ("c",)], "g string")
    assert rows(V.group_mean(data, groups, ["g"], 2)) == [("a", 2, [3.0, 2.0]), ("b", 1, [1.0, 1.0]), ("c", 0, [0.0, 0.0])]
    members = spark.createDataFrame([(10, 1), (10, 2), (11, 2)], "segment long, scene long")
    units, received = V.hyperedge_messages(members, data.select("scene", "vector"), 2)
    assert rows(units) == [(10, 2, [3.0, 2.0]), (11, 1, [4.0, 0.0])]
    assert rows(received) == [(1, 1, [3.0, 2.0]), (2, 2, [3.5, 1.0]), (3, 0, [0.0, 0.0])]
    dirty = spark.createDataFrame([([1.0, math.nan],), ([0.0, 0.0],), ([1.0],), (None,), ([1.0, None],), ([1.0, math.inf],), ([1.0, 2.0],)], "v array<float>")
    assert [r[0] for r in dirty.select(V.usable("v", 2)).collect()] == [False] * 6 + [True]


def video_batch(rng, text=6):
    links = np.array([[0, 1, -1, -1], [2, -1, -1, 2]])
    return {
        "titles": rng.standard_normal((4, text)), "titled": np.array([True, False, True, False]), "contexts": rng.standard_normal((3, text)), "videos": np.array([0, 0, 1]),
        "entities": rng.standard_normal((3, text)), "entity_scenes": np.array([0, 0, 2]), "actions": rng.standard_normal((2, text)), "action_scenes": np.array([0, 2]),
        "links": links, "states": np.where(links < 0, 1, 0), "members": np.array([[0, 0], [1, 0], [1, 1], [2, 2]]),
    }


def test_towers():
    rng = np.random.default_rng(5)
    batch, hidden = video_batch(rng), 3
    plain = N.scene_weights(1, 6, hidden, role_fusion=False)
    full = N.scene_weights(1, 6, hidden, attention=True, segments=True)
    assert all(np.array_equal(plain[k], full[k]) for k in plain)  # modules draw for themselves
    base = N.encode_videos(batch, N.scene_weights(1, 6, hidden, attention=True))
    assert np.allclose(N.encode_videos(batch, full), base)  # closed gates change nothing
    opened = N.encode_videos(batch, full | {"gates": np.ones(2)})
    assert not np.allclose(opened[:2], base[:2]) and np.allclose(opened[2:], base[2:])
    assert np.allclose(base[3], 0) and not np.allclose(base[2], 0)  # nothing; title only
    # by hand: one scene without entities or actions
    title, context = N.linear(batch["titles"][:1], plain, "title")[0], N.linear(batch["contexts"][1:2], plain, "context")[0]
    alone = {**batch, "titles": batch["titles"][:1], "titled": np.array([True]), "contexts": batch["contexts"][1:2], "videos": np.array([0]), "entities": np.zeros((0, 6)), "entity_scenes": np.array([], int), "actions": np.zeros((0, 6)), "action_scenes": np.array([], int)}
    scene = np.concatenate([title, np.zeros(2 * hidden), context])
    assert np.allclose(N.encode_videos(alone, plain)[0], scene + np.maximum(plain["scene.weight"] @ scene, 0))
    # videos never mix
    changed = {**batch, "contexts": batch["contexts"] + np.array([[0.0], [0.0], [9.0]])}
    assert np.allclose(N.encode_videos(changed, full | {"gates": np.ones(2)})[0], opened[0])
    texts = N.encode_descriptions(batch["titles"], batch["titled"], batch["contexts"], batch["videos"], N.linear_weights(0, "title", 3, 6) | N.linear_weights(0, "text", 9, 6) | N.linear_weights(0, "scene", 12, 12))
    assert texts.shape == (4, 12) and np.allclose(texts[3], 0)
    assert N.parameter_count(N.linear_weights(0, "x", 3, 5)) == 18


def test_role_fusion_by_hand():
    w = {"fusion.weight": np.ones((2, 10)), "fusion.bias": np.array([0.0, -100.0]), "role_states": np.stack([np.full((2, 2), float(r)) for r in range(4)])}
    fused = N.fuse_roles(np.array([[1.0, 2.0]]), np.array([[3.0, 4.0]]), np.array([[0, -1, -1, -1]]), np.array([[0, 1, 0, 1]]), w)
    assert fused.tolist() == [[1 + (3 + 7 + 2 + 4 + 6), 2.0]]


def test_users_see_only_their_past():
    rng = np.random.default_rng(6)
    w = N.sequence_weights(2, 5, 8)
    items = rng.standard_normal((2, 5, 8))
    present = np.array([[True, True, True, False, False], [True] * 5])
    first = N.encode_users(items, present, w)
    items[0, 3:] += 7  # padding
    again = N.encode_users(items, present, w)
    assert np.allclose(first, again)
    short = N.encode_users(items[:, :3], present[:, :3], w)
    assert np.allclose(short[0], first[0]) and not np.allclose(short[1], first[1])
    assert np.isfinite(N.encode_users(items, np.zeros((2, 5), bool), w)).all()


def test_encoding_of_distinct_texts(spark):
    df = spark.createDataFrame([("a ",), ("a",), ("b",), ("",), (None,)], "t string")
    found = {r.text: r.vector for r in N.encode_distinct(df, "t", N.digest_encoder(8)).collect()}
    assert set(found) == {"a", "b", ""} and found[""] == [0.0] * 8 and math.isclose(np.linalg.norm(found["a"]), 1, rel_tol=1e-6)
    mapped = N.apply_tower(spark.createDataFrame([(1, [1.0, 2.0])], "k long, v array<float>"), "v", lambda x: 2 * x, ["k"])
    assert tuple(mapped.first()) == (1, [2.0, 4.0])


def test_metrics_reach_the_cutoff_of_30(spark):
    found = spark.createDataFrame([(1,), (30,), (31,)], "rank int").select(*R.metrics(F.col("rank"))).collect()
    assert [r["HR@30"] for r in found] == [1.0, 1.0, 0.0] and [r["HR@20"] for r in found] == [1.0, 0.0, 0.0]
    assert math.isclose(found[1]["NDCG@30"], 1 / math.log2(31)) and found[2]["NDCG@30"] == 0.0
