import json

import pytest
from pyspark.sql import functions as F

from kinograph.functions import payload as P
from kinograph.functions.sampling import fixed_windows, keyframes
from kinograph.operators import requests as R
from kinograph.sources.readers import SCENE_SCHEMA

GOOD = {
    "medium": "a", "format": "b", "topics": ["c"], "entities": [{"id": "e1", "name": "cook", "attributes": []}],
    "actions": [{"actor": "e1", "action": "stirring", "target": "e9", "tool": None, "place": "unknown"}],
}


def changed(**parts):
    return json.dumps(GOOD | parts)


ACTION, ENTITY = GOOD["actions"][0], GOOD["entities"][0]


@pytest.mark.parametrize(
    ("text", "error"),
    [
        (changed(), None), (changed(topics=[], entities=[], actions=[]), None), (None, "no object"), ("[1]", "no object"), ("text", "no object"), (changed(more=1), "fields"),
        (json.dumps({k: v for k, v in GOOD.items() if k != "topics"}), "fields"), (changed(medium=" "), "context"), (changed(topics=["x", ""]), "context"), (changed(entities=[{**ENTITY, "x": 1}]), "entity fields"),
        (changed(entities=[{**ENTITY, "name": ""}]), "entities"), (changed(entities=[{**ENTITY, "attributes": [""]}]), "entities"), (changed(actions=[{**ACTION, "location": "e1"}]), "location and place"),
        (changed(actions=[{k: v for k, v in ACTION.items() if k != "tool"}]), "action fields"), (changed(actions=[{**ACTION, "action": ""}]), "actions"), (changed(actions=[{**ACTION, "tool": ""}]), "actions"),
        (changed(actions=[{**{k: v for k, v in ACTION.items() if k != "place"}, "location": "e1"}]), None),
    ],
)
def test_graph_objects(spark, text, error):
    row = spark.createDataFrame([(text,)], "j string").select(P.graph_error(F.col("j")).alias("e"), P.stored_graph(F.col("j")).alias("g")).first()
    assert row.e == error and (row.g is None) == (error is not None)


def test_references_and_old_names(spark):
    old = {**{k: v for k, v in ACTION.items() if k != "place"}, "location": "e1"}
    graph = spark.createDataFrame([(changed(actions=[old]),)], "j string").select(P.stored_graph(F.col("j")).alias("g")).first().g
    assert graph.actions[0].asDict() == {"actor": "e1", "action": "stirring", "target": "unknown", "tool": None, "place": "e1"}


def test_rows(spark):
    rows = [
        ("c", 0, 3, [], "g", None, None, None), ("c", 1, None, None, None, "d", None, "raw"), ("c", 2, None, ["TOKEN_LIMIT"], None, None, "boom", None), (" ", 0, 1, [], "g", None, None, None), ("c", -1, 1, [], "g", None, None, None),
        ("c", None, 1, [], "g", None, None, None), ("c", 0, -1, [], "g", None, None, None), ("c", 0, 1, ["odd"], "g", None, None, None), ("c", 0, 1, [], "g", "d", None, None), ("c", 0, 1, [], None, None, None, "raw"),
    ]
    found = [r[0] for r in spark.createDataFrame(rows, SCENE_SCHEMA).select(P.row_error()).collect()]
    assert found == [None, None, None, "content_id", "scene_idx", "scene_idx", "tokens", "warning", "payload", "payload"]


def test_requests(spark, rows):
    windows = fixed_windows(spark.createDataFrame([("v", 31.0)], "content_id string, duration_seconds double"))
    frames = spark.createDataFrame([("v", s, f"{s}.png") for s in ("0002_5", "0007_5", "0012_5", "0017_5", "0022_5", "0027_5")], "content_id string, stem string, path string")
    evidence = R.scene_evidence(windows, frames)
    assert rows(evidence, "task_id", "missing") == [("v:0", 0), ("v:1", 1)]
    assert evidence.where("scene_idx = 0").first().paths[0] == "0002_5.png" and len(evidence.where("scene_idx = 0").first().paths) == 6
    assert rows(R.incomplete_requests(evidence)) == [("v:1", 1)]
    answers = spark.createDataFrame([("v:0",), ("v:0",), ("w:0",)], "task_id string")
    assert rows(R.unanswered(evidence, answers)) == [("v:0", "repeated"), ("v:1", "missing"), ("w:0", "unknown")]
    times = spark.createDataFrame([("v", 1.0), ("v", 2.0), ("v", 2.0), ("w", 5.0)], "content_id string, timestamp double")
    assert rows(R.last_but_one_frame(times)) == [("v", 1.0), ("w", 5.0)]


def test_frames_are_not_broadcast(spark, rows, tmp_path):
    """A plan takes the frames of a small file of videos for small, however long the videos are."""
    spark.createDataFrame([("v", 3000.0), ("w", 31.0)], "content_id string, duration_seconds double").write.parquet(str(tmp_path / "videos"))
    windows = fixed_windows(spark.read.parquet(str(tmp_path / "videos")))
    frames = keyframes(windows).where("content_id = 'v'").select("content_id", "stem").distinct().withColumn("path", F.col("stem"))
    evidence = R.scene_evidence(windows, frames)
    assert "Broadcast" not in evidence._jdf.queryExecution().executedPlan().toString()
    assert rows(evidence.groupBy("content_id").agg(F.count("*"), F.sum(F.size("paths")), F.sum("missing"))) == [("v", 100, 600, 0), ("w", 2, 0, 7)]
