import json

import pytest
from pyspark.sql import functions as F

from kinograph.functions import ids
from kinograph.operators import catalog as C
from kinograph.sources import manifest as M
from kinograph.sources import readers as S


def test_ids(spark):
    values = ["7", " 007\t", "0", "", None, "-1", "+1", "1.0", "1 2", "７", "1\n", "12345678901234567890123"]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = [tuple(r) for r in df.select(ids.normalize_id("x"), ids.content_id("d", "x"), ids.id_code("x") < 0).collect()]
    assert got[:2] == [("7", "d_00007", False)] * 2 and got[2:11] == [(None, None, None)] * 9 and got[11] == (values[11], f"d_{values[11]}", True)
    safe = spark.createDataFrame([("a-1_b.c",), (".",), ("..",), ("a/b",), (None,)], "x string")
    assert [r[0] for r in safe.select(ids.is_safe_content_id("x")).collect()] == [True, False, False, False, False]


def test_interactions_and_ratings(spark, rows, tmp_path):
    path = tmp_path / "pairs.csv"
    path.write_text('﻿user,item,timestamp\n1,05,1000\n"1",5,1000\r\nx,5,1000\n2,6,7\n', encoding="utf-8")
    events, rejected = S.read_interactions(spark, str(path))
    assert rows(events) == [(0, "1", "5", 1000), (1, "1", "5", 1000), (2, "2", "6", 7)] and rows(rejected, "line_no", "reason") == [(3, "user")]
    (tmp_path / "bad.csv").write_text("user;item\n1;2\n")
    with pytest.raises(S.SourceError):
        S.read_interactions(spark, str(tmp_path / "bad.csv"))
    ratings = tmp_path / "ratings.dat"
    ratings.write_text("1::2::4.5::10\n1::3::5::11\n1::2::9::12\n")
    kept, rejected = S.read_ratings(spark, str(ratings), spark.createDataFrame([("2",)], "item_id string"))
    assert rows(kept, "item_id", "timestamp") == [("2", 10000)] and rows(rejected, "reason") == [("rating",)]


def test_titles_movies_and_maps(spark, rows, tmp_path):
    titles = tmp_path / "titles.csv"
    titles.write_text('item,title\n1,"A ""b"", c"\n02,plain, with comma\n3,\n')
    assert rows(S.read_titles(spark, str(titles), header=True, quoted=True)) == [("1", 'A "b", c'), ("2", "plain, with comma"), ("3", "")]
    for text in ("1,a\n01,b\n", "x,a\n", "1\n", ""):
        titles.write_text(text)
        with pytest.raises(S.SourceError):
            S.read_titles(spark, str(titles))
    movies = tmp_path / "movies.dat"
    movies.write_text("1::A (1990)::Drama|War\n2::B::x\r\n")
    assert rows(S.read_movies(spark, str(movies))) == [("1", "A (1990)"), ("2", "B")]
    table = tmp_path / "map.tsv"
    table.write_text("newID\toldID\n0\t10\n1\t007\n")
    assert rows(S.read_id_map(spark, str(table))) == [(0, "10"), (1, "7")]
    for text in ("newID\toldID\n0\t10\n2\t11\n", "newID\toldID\n0\t10\n1\t10\n", "a\tb\n0\t1\n", "newID\toldID\n"):
        table.write_text(text)
        with pytest.raises(S.SourceError):
            S.read_id_map(spark, str(table))


def test_json_scenes_media_and_timestamps(spark, rows, tmp_path):
    folder = tmp_path / "scenes"
    folder.mkdir()
    lines = [{"content_id": "a", "scene_idx": 0, "tokens": 3, "warning": [], "scene_graph": "x"}, {"content_id": "a", "scene_idx": 1, "error": "boom"}]
    (folder / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    assert S.read_scenes(spark, str(folder)).count() == 1 and S.read_scenes(spark, str(folder), failures=True).count() == 2
    (folder / "b.jsonl").write_text(json.dumps(lines[0]))
    with pytest.raises(S.SourceError):
        S.read_scenes(spark, str(folder))
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n[2]\n')
    with pytest.raises(S.SourceError):
        S.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int")
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert rows(S.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int")) == [(1,), (2,)]
    (tmp_path / "o.json").write_text("[1]")
    with pytest.raises(S.SourceError):
        S.read_json(tmp_path / "o.json")
    media = tmp_path / "media"
    media.mkdir()
    (media / "007.mp4").write_bytes(b"abc")
    (media / "note.txt").write_text("x")
    assert rows(S.list_media(spark, str(media)), "item_id", "size") == [("7", 3)]
    stamps = tmp_path / "stamps"
    stamps.mkdir()
    (stamps / "a.json").write_text(json.dumps([{"scene_start": 0, "scene_end": 30.0, "keyframe_timestamps": [2.5, 2.5, 7.5]}, {"scene_start": 30, "scene_end": 31.0, "keyframe_timestamps": [30.5]}]))
    assert rows(S.read_timestamps(spark, str(stamps))) == [("a", 0, 2.5), ("a", 0, 7.5), ("a", 1, 30.5)]


def test_catalog(spark, rows):
    data = [("1", "c1", "/v/1.mp4", 9.0, 5), ("2", "c2", None, float("nan"), 5), ("3", "c3", " ", None, 0), ("4", "c4", "/v/4.mp4", float("inf"), None)]
    items = spark.createDataFrame(data, "item_id string, content_id string, source_video_path string, duration_seconds double, source_file_size long")
    assert rows(C.eligibility(items), "item_id", "reasons") == [("1", []), ("2", ["missing_video", "invalid_duration"]), ("3", ["missing_video", "empty_video", "invalid_duration"]), ("4", ["empty_video", "invalid_duration"])]
    files = spark.createDataFrame([("1", "a", 1, 1), ("2", "b", 1, 1), ("2", "c", 1, 1)], "item_id string, path string, size long, mtime_ns long")
    assert rows(C.match_files(items.select("item_id"), files), "item_id", "status") == [("1", "found"), ("2", "ambiguous"), ("3", "missing"), ("4", "missing")]
    schema = "k string, size long, duration_seconds double"
    now = spark.createDataFrame([("a", 1, None), ("b", 2, None), (None, 3, None), ("d", 4, 8.0)], schema)
    before = spark.createDataFrame([("a", 1, 5.0), ("b", 9, 6.0), (None, 3, 7.0), ("d", 4, 1.0)], schema)
    assert rows(C.carry_durations(now, before, ["k", "size"]), "size", "duration_seconds") == [(1, 5.0), (2, None), (3, 7.0), (4, 8.0)]
    required = spark.createDataFrame([("1", "c1"), ("2", "c2"), ("3", "c3")], "item_id string, content_id string")
    one = spark.createDataFrame([("1", " A "), ("2", " "), ("9", "x")], "item_id string, title string")
    two = spark.createDataFrame([("1", "no"), ("2", "B"), ("3", None)], "item_id string, title string")
    titles = C.complete_titles(required, one, two)
    assert rows(titles, "item_id", "title", "origin") == [("1", "A", "primary"), ("2", "B", "supplement"), ("3", "", "missing")]
    assert rows(C.completion_report(titles)) == [("missing", 1), ("primary", 1), ("supplement", 1)]
    log = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "user long, item long")
    kept, lost = C.available_interactions(log, spark.createDataFrame([(1,)], "item long"))
    assert kept.count() == 1 and rows(lost) == [(2, 2)]
    assert rows(C.duplicated_keys(log, "item")) == [(2, 2)]


def test_manifest_and_cache(spark, rows, tmp_path):
    folder = str(tmp_path / "out")
    with pytest.raises(ValueError):
        M.load(spark, folder)
    M.publish({"t": spark.range(3)}, folder, {"v": 1})
    assert rows(M.load(spark, folder, {"v": 1})["t"]) == [(0,), (1,), (2,)]
    with pytest.raises(ValueError):
        M.load(spark, folder, {"v": 2})
    made = []

    def make():
        made.append(1)
        return {"t": spark.range(2)}

    cache = M.Cache(spark, str(tmp_path / "cache"))
    for _ in range(2):
        assert cache.get_or_make({"a": [1, 2]}, make)["t"].count() == 2
    assert len(made) == 1 and M.fingerprint({"b": 1, "a": 2}) == M.fingerprint({"a": 2, "b": 1})
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert M.content_fingerprint(df) == M.content_fingerprint(df.orderBy(F.desc("k")).repartition(3)) != M.content_fingerprint(df.limit(1))
    merged = M.upsert(df, spark.createDataFrame([(2, "new"), (3, "z")], "k int, v string"), ["k"], str(tmp_path / "up"))
    assert rows(merged) == [(1, "x"), (2, "new"), (3, "z")]
    with pytest.raises(ValueError):
        M.upsert(None, df.union(df), ["k"], str(tmp_path / "up2"))
