import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kinograph.functions import graphtext
from kinograph.functions import sampling as M
from kinograph.functions.activity import activity_key
from kinograph.operators import outcomes as O
from kinograph.operators import segments as S


def test_windows_and_keyframes(spark, rows):
    videos = spark.createDataFrame([("a", 32.2), ("b", 30.0), ("c", 31.199999), ("d", 0.0), ("e", None), ("f", math.nan), ("g", math.inf), ("h", -1.0)], "content_id string, duration_seconds double")
    found = M.fixed_windows(videos)
    assert rows(found, "content_id", "scene_start", "scene_end") == [("a", 0.0, 30.0), ("a", 30.0, 32.2), ("b", 0.0, 30.0), ("c", 0.0, 30.0), ("c", 30.0, 31.199999)]
    assert rows(M.keyframes(found).where("content_id = 'a'"), "scene_idx", "timestamp") == sorted([(0, x) for x in (2.5, 7.5, 12.5, 17.5, 22.5, 27.5)] + [(1, 31.1)], key=repr)
    assert rows(M.evidence_totals(found)) == [(3, 5, 20)]
    with pytest.raises(ValueError):
        M.fixed_windows(videos, scene_seconds=1, keyframes=11)


def test_keyframes_are_exact(spark):
    values = [k / 7 * 10 + 0.05 for k in range(1, 60)]
    videos = spark.createDataFrame([(str(k), round(v, 3)) for k, v in enumerate(values)], "content_id string, duration_seconds double")
    for seconds, n in ((30, 6), (30, 7), (20, 9)):
        got = {(r.content_id, r.scene_idx): r.keyframe_ticks for r in M.fixed_windows(videos, scene_seconds=seconds, keyframes=n).collect()}
        for k, v in enumerate(values):
            d = Fraction(str(round(v, 3)))
            for w in range(math.ceil(d / seconds)):
                start, end = w * seconds, min(Fraction((w + 1) * seconds), d)
                begins = [start + Fraction(j * seconds, n) for j in range(n)]
                ticks = [math.floor((b + min(b + Fraction(seconds, n), end)) / 2 * 10) for b in begins if b < end]
                assert got[str(k), w] == list(dict.fromkeys(ticks))


def test_stems(spark):
    ticks = spark.createDataFrame([(311,), (25,), (310,), (123456,), (0,)], "t long")
    assert [r[0] for r in ticks.select(M.stem(F.col("t"))).collect()] == ["0031_1", "0002_5", "0031", "12345_6", "0000"]


@pytest.mark.parametrize(
    ("phrases", "key"),
    [
        (("cutting", "cuts", "cut", "p1 is cutting o2"), "cut"), (("talking to",), "talk"), (("eating", "ate", "eats"), "eat"), (("makes", "making", "made"), "mak"), (("stopped", "stopping"), "stop"),
        (("unknown", "none", "", "p1", "the", None), None), (("carries",), "carry"), (("washes",), "wash"), (("lying",), "li"), (("passing",), "pas"), (("sings",), "sing"), (("is",), None),
    ],
)
def test_activity_keys(spark, phrases, key):
    df = spark.createDataFrame([(p,) for p in phrases], "p string")
    assert {r[0] for r in df.select(activity_key(F.col("p"))).collect()} == {key}


def scenes(spark):
    acts = [["cut"], ["cut"], ["stir"], ["cut", "stir"], None, ["cut"], ["pour"], ["pour"]]
    return spark.createDataFrame([("v", k, a or []) for k, a in enumerate(acts) if a is not None], "content_id string, scene_idx int, activities array<string>")


def test_segments_and_bags(spark, rows):
    found = S.segments(S.activity_segments(scenes(spark)))
    assert rows(found, "activity", "scene_ids") == [("cut", [0, 1]), ("cut", [3]), ("cut", [5]), ("pour", [6, 7]), ("stir", [2, 3])]
    bags = S.action_bags(scenes(spark))
    assert rows(bags, "activity", "scene_ids") == [("cut", [0, 1, 3, 5]), ("pour", [6, 7]), ("stir", [2, 3])]
    assert rows(S.overlap(bags, found), "activity", "identical", "jaccard") == [("cut", False, 0.5), ("pour", True, 1.0), ("stir", True, 1.0)]
    assert rows(S.segment_summary(found)) == [(5, 8, 0.4)]
    assert rows(S.length_distribution(found)) == [(1, 2), (2, 3)]
    assert S.broken_memberships(S.activity_segments(scenes(spark))).count() == 0


def test_variants_keep_sizes_and_degrees(spark, rows):
    default = S.segments(S.activity_segments(scenes(spark)))
    for seed in range(3):
        moved, shuffled = S.time_windows(scenes(spark), seed), S.random_scenes(scenes(spark), seed)
        assert rows(moved, "activity", "start", "length") == rows(shuffled, "activity", "start", "length") == rows(default, "activity", "start", "length")
        present = {0, 1, 2, 3, 5, 6, 7}
        assert all(r.scene_ids == list(range(r.scene_ids[0], r.scene_ids[0] + r.length)) and set(r.scene_ids) <= present for r in moved.collect())
        degrees = lambda f: sorted(r[0] for r in f.select(F.explode("scene_ids").alias("s")).groupBy("s").count().select("count").collect())
        assert degrees(shuffled) == degrees(default)
        assert rows(S.random_scenes(scenes(spark).repartition(3), seed)) == rows(shuffled)


def test_contiguous_starts(spark, rows):
    df = spark.createDataFrame([("v", k, []) for k in (0, 1, 2, 4, 5)], "content_id string, scene_idx int, activities array<string>")
    runs = dict(rows(S.contiguous_starts(df), "scene_idx", "run"))
    assert runs == {0: 3, 1: 2, 2: 1, 4: 2, 5: 1}


def test_outcomes(spark, rows):
    data = [(1, None, [], True), (2, "boom", [], True), (3, None, ["REPEAT_OCCURRED"], True), (4, None, ["REPEAT_OCCURRED", "TOKEN_LIMIT"], True), (5, None, ["PARSE_FAILED"], False), (6, None, None, False), (7, None, ["odd"], True)]
    df = spark.createDataFrame(data, "k int, error string, tags array<string>, structured boolean")
    seen = df.select("k", O.outcome(F.col("error"), F.col("tags")), O.needs_generation(F.col("error"), F.col("tags")))
    assert rows(seen) == [(1, "success", False), (2, "error", True), (3, "repeat_occurred", False), (4, "token_limit", True), (5, "parse_failed", True), (6, "success", False), (7, "success", False)]
    assert rows(O.admission(df), "k", "rejection") == [(1, None), (2, "error"), (3, None), (4, "token_limit"), (5, "parse_failed"), (6, "raw"), (7, None)]
    counted = O.coverage(O.admission(df)).first()
    assert (counted.scenes, counted.valid, counted.error, counted.raw) == (7, 3, 1, 1)
    assert O.coverage(O.admission(df.limit(0))).first().coverage is None
    expected = spark.createDataFrame([(k,) for k in range(1, 9)], "k int")
    assert rows(O.pending(expected, df, ["k"])) == [(2,), (4,), (5,), (8,)]


def test_passes_and_latest(spark, rows):
    results = [(1, 0, None, []), (1, 1, None, ["TOKEN_LIMIT"]), (2, 0, None, ["REPEAT_OCCURRED"]), (2, 1, "x", []), (3, 0, "x", []), (3, 1, None, ["PARSE_FAILED"]), (4, 1, None, []), (4, 2, None, [])]
    df = spark.createDataFrame(results, "k int, pass int, error string, tags array<string>")
    assert rows(O.best_pass(df, ["k"]), "k", "pass") == [(1, 0), (2, 0), (3, 1), (4, 1)]
    assert rows(O.latest(df, ["k"], ["pass"]), "k", "pass") == [(1, 1), (2, 1), (3, 1), (4, 2)]
    calls = []

    def generate(left, penalty):
        calls.append((penalty, sorted(r.k for r in left.collect())))
        failed = F.when(F.col("k") + 10 * (F.lit(penalty) - 1) < 3, "x")
        return left.select("k", failed.alias("error"), F.array().cast("array<string>").alias("tags"))

    found = O.generation_passes(spark.createDataFrame([(1,), (2,), (3,)], "k int"), generate, [1.0, 1.1], ["k"])
    assert rows(found, "k", "error", "pass") == [(1, "x", 1), (2, None, 1), (3, None, 0)] and calls == [(1.0, [1, 2, 3]), (1.1, [1, 2])]


def test_repeated_lines(spark):
    df = spark.createDataFrame([("a\nb\na",), ("a\nb",), ("a",), ("a\na\nb\nb",)], "t string")
    got = [tuple(r) for r in df.select(O.repeated_line(F.col("t")), O.drop_repeated_last_line(F.col("t"))).collect()]
    assert got == [(2, "a\nb"), (None, "a\nb"), (None, "a"), (1, "a\na\nb")]


def test_keyframe_fallbacks(spark, rows):
    schema = "content_id string, scene_idx int, position int, timeline array<struct<timestamp: double>>, keyframe_timestamps array<double>, keyframes_given array<double>"
    scenes = [
        ("a", 0, 0, [(7.59,), (2.5,), (2.55,)], [1.0], None), ("a", 1, 1, [(7.5,), (None,)], [3.0, -1.0, None, 1.26], None), ("a", 2, 2, [], [], [float("nan"), 4.0]), ("a", None, 1, None, None, None), ("a", 9, 4, None, [], []),
    ]
    windows = spark.createDataFrame([("a", 0, [25, 75]), ("a", 1, [325])], "content_id string, scene_idx int, keyframe_ticks array<long>")
    found = M.keyframe_fallbacks(spark.createDataFrame(scenes, schema), windows)
    assert rows(found, "position", "keyframes") == [(0, [2.5, 7.5]), (1, [1.2, 3.0]), (1, [32.5]), (2, [4.0]), (4, [])]
    bounds = spark.createDataFrame([("3.5", 1.0, 0), (None, 2.0, 0), ("x", 2.0, 7), (None, None, 7)], "own string, planned double, other int")
    assert [r[0] for r in bounds.select(M.scene_bound(F.col("own"), F.col("planned"), F.col("other"))).collect()] == [3.5, 2.0, 7.0, 7.0]


def test_stored_rows_are_read_again(spark, rows):
    good = "[Context]\nmedium: a\nformat: b\ntopics: none\n[Entities]\ncook\n[Actions]\ncook -> stirring -> pot; none; unknown"
    kind = f"k int, raw_output string, error string, tags array<string>, mode string, graph {graphtext.GRAPH_TYPE}"
    data = [(1, good, None, ["PARSE_FAILED"], None, None), (2, good, "lost", ["PARSE_FAILED"], None, None), (3, "nothing", None, ["PARSE_FAILED"], None, None), (4, good, None, ["TOKEN_LIMIT"], None, None), (5, None, None, ["PARSE_FAILED"], None, None)]
    found = O.reclassified(spark.createDataFrame(data, kind))
    assert rows(found, "k", "changed", "mode") == [(1, True, "repaired"), (2, False, None), (3, False, None), (4, False, None), (5, False, None)]
    assert found.where("changed").first().tags == [] and found.where("k = 4").first().tags == ["TOKEN_LIMIT"] and found.columns == ["k", "raw_output", "error", "tags", "mode", "graph", "changed"]
