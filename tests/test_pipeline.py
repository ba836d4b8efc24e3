import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinograph import cli
from kinograph.operators import training as T
from kinograph.plans.pipeline import Config, Pipeline, StepError
from kinograph.plans.pipeline import stand_in_text


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    folder = tmp_path_factory.mktemp("source")
    rows = ["user,item,timestamp"] + [f"{u},{100 + (u * k) % 24 + 1},{1000 * k}" for u, n in ((1, 5), (2, 6), (3, 14), (5, 9), (7, 3)) for k in range(1, n + 1)]
    (folder / "pairs.csv").write_text("\n".join(rows) + "\n")
    items = sorted({r.split(",")[1] for r in rows[1:]})
    (folder / "titles.csv").write_text("".join(f"{i},Title {i}\n" for i in items[1:]))
    (folder / "more.csv").write_text(f'item,title\n{items[0]},"The ""first"", again"\n')
    (folder / "media").mkdir()
    for i in items:
        (folder / "media" / f"{i}.mp4").write_bytes(b"x")
    return folder


def config(source, root, **more):
    settings = {"interactions": "pairs.csv", "titles": "titles.csv", "supplement": "more.csv", "media": "media"} | more
    paths = {k: str(source / settings.pop(k)) for k in ("interactions", "titles", "supplement", "media") if settings.get(k)}
    return Config(root=str(root), **paths, **settings, seeds=(1, 2), draws=60, dimensions=8, training=T.Training(width=4, epochs=3))


def test_all_steps_and_resume(spark, source, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def generate(content, scene, kind, penalty):
        calls.add(1)
        if content.endswith("102") and scene == 0 and penalty == 1.0:
            return "nothing to read"
        return stand_in_text(content, scene, kind)

    pipeline = Pipeline(spark, config(source, tmp_path, penalties=(1.0, 1.1)), duration=lambda path: 64.0, generate=generate)
    report = pipeline.run()
    assert "| titles | metadata |" in report and "graphs | titles" in report
    events = pipeline.prepare_cohort()["events"]
    assert events.count() == 37 and pipeline.prepare_cohort()["titles"].where("title = 'The \"first\", again'").count() == 1
    scenes = pipeline._scenes("graph")
    assert scenes.count() == 3 * events.select("item_id").distinct().count() and scenes.where("graph IS NULL").count() == 0
    assert calls.value == scenes.count() + 1  # one more pass for the one that failed
    assert tuple(pipeline.generation_statistics("graph").first())[:2] == (scenes.count(),) * 2
    metrics = pipeline._load("recommendations")["per_event_metrics"]
    assert metrics.count() == 2 * 2 * 4 and metrics.where("rank < 1").count() == 0
    assert pipeline.prepare_module()["segments"].count() > 0
    again = Pipeline(spark, pipeline.config, duration=None, generate=generate)
    assert again.run() == report and calls.value == scenes.count() + 1


def test_changed_interactions_are_seen_by_all_later_steps(spark, source, tmp_path):
    log = tmp_path / "pairs.csv"
    log.write_text((source / "pairs.csv").read_text())
    settings = {"titles": str(source / "titles.csv"), "supplement": str(source / "more.csv"), "media": str(source / "media"), "seeds": (1,), "draws": 20, "dimensions": 8}
    pipeline = Pipeline(spark, Config(root=str(tmp_path / "out"), interactions=str(log), experiments=(("titles", "metadata"),), training=T.Training(width=4, epochs=1), **settings), duration=lambda path: 31.0)
    names = ("cohort", "windows", "representations", "recommendations", "diagnosis")

    def made():
        pipeline.run()
        return [pipeline._made_from(n) for n in names]

    first = made()
    assert made() == first
    log.write_text(log.read_text() + "3,101,99000\n")
    second = made()
    assert all(a != b for a, b in zip(first, second, strict=True)) and pipeline._load("cohort")["events"].count() == 38


def test_mapped_movies_need_titles(spark, tmp_path):
    (tmp_path / "ratings.dat").write_text("".join(f"1::{i}::4.0::{i}\n" for i in (1, 2, 3)))
    (tmp_path / "movies.dat").write_text("".join(f"{i}::M{i}::x\n" for i in (1, 2)))
    (tmp_path / "map.tsv").write_text("newID\toldID\n0\t1\n1\t2\n")
    (tmp_path / "media").mkdir()
    for i in (1, 2):
        (tmp_path / "media" / f"{i}.mp4").write_bytes(b"x")
    settings = {"ratings": str(tmp_path / "ratings.dat"), "movies": str(tmp_path / "movies.dat"), "id_map": str(tmp_path / "map.tsv"), "media": str(tmp_path / "media")}
    assert Pipeline(spark, Config(root=str(tmp_path / "out"), **settings)).prepare_cohort()["events"].count() == 2
    (tmp_path / "map.tsv").write_text("newID\toldID\n0\t1\n1\t3\n")
    with pytest.raises(ValueError, match="without a title"):
        Pipeline(spark, Config(root=str(tmp_path / "out2"), **settings)).prepare_cohort()


def test_settings_that_are_not_known(tmp_path):
    path = tmp_path / "config.json"
    for more in ({"colour": 1}, {"training": {"depth": 3}}, {"experiments": [{"label": "a", "source": "graph", "modules": ["REAF"]}]}, {"experiments": [{"label": "../a", "source": "graph"}]}):
        path.write_text(json.dumps({"root": "x"} | more))
        with pytest.raises(ValueError):
            cli.load_config(str(path))


def test_missing_media_stop_the_cohort(spark, source, tmp_path):
    (tmp_path / "media").mkdir()
    broken = Config(root=str(tmp_path / "out"), interactions=str(source / "pairs.csv"), titles=str(source / "titles.csv"), media=str(tmp_path / "media"))
    (tmp_path / "media" / "101.mp4").write_bytes(b"x")
    with pytest.raises(StepError):
        Pipeline(spark, broken).prepare_cohort()
    with pytest.raises(ValueError):
        Pipeline(spark, broken).prepare_input_data()
    with pytest.raises(ValueError):
        Config(root="x", experiments=(("A", "metadata"), ("a", "graph")))


def test_ratings_exclude_missing_media(spark, tmp_path):
    (tmp_path / "ratings.dat").write_text("".join(f"1::{i}::4.0::{i}\n" for i in (1, 2, 3)))
    (tmp_path / "movies.dat").write_text("".join(f"{i}::M{i}::x\n" for i in (1, 2, 3)))
    (tmp_path / "media").mkdir()
    for i in (1, 2):
        (tmp_path / "media" / f"{i}.mp4").write_bytes(b"x")
    settings = Config(root=str(tmp_path / "out"), ratings=str(tmp_path / "ratings.dat"), movies=str(tmp_path / "movies.dat"), media=str(tmp_path / "media"))
    tables = Pipeline(spark, settings).prepare_cohort()
    assert tables["events"].count() == 2 and [tuple(r) for r in tables["excluded_items"].collect()] == [("3", "missing_video", 1)]


def test_gradient_and_training(spark):
    rng = np.random.default_rng(0)
    w, users, items = rng.standard_normal((3, 2)), rng.standard_normal((5, 3)), rng.standard_normal((5, 3))
    masked = np.zeros((5, 5), bool)
    masked[0, 1] = masked[3, 2] = True
    log_q = rng.standard_normal(5)
    _, gradient = T.batch_gradient(w, users, items, log_q, masked)
    for k in np.ndindex(w.shape):
        step = np.zeros_like(w)
        step[k] = 1e-6
        slope = (T.batch_gradient(w + step, users, items, log_q, masked)[0] - T.batch_gradient(w - step, users, items, log_q, masked)[0]) / 2e-6
        assert np.isclose(slope, gradient[k], atol=1e-6)
    # users go on within their group of items
    features = np.vstack([np.zeros(6), np.repeat(np.eye(6)[:4], 10, axis=0) + 0.1 * rng.standard_normal((40, 6))])
    groups = rng.integers(0, 4, 300)
    data = [(n, n, ("train", "train", "train", "validation", "test")[n % 5], int(1 + 10 * g + rng.integers(10)), [int(1 + 10 * g + rng.integers(10)), 0]) for n, g in enumerate(groups)]
    rows = spark.createDataFrame(data, "user long, event_id long, phase string, target long, history array<long>")
    table = spark.createDataFrame([("a", k, features[k].tolist()) for k in range(1, 41)], "arm string, item_idx long, vector array<double>")
    found = T.evaluate_runs(rows, table, [("a", 1), ("a", 2)], T.Training(width=4, epochs=30, rate=0.05))
    by_seed = {r.seed: r.hits for r in found.groupBy("seed").agg(F.avg((F.col("rank") <= 10).cast("double")).alias("hits")).collect()}
    assert set(by_seed) == {1, 2} and min(by_seed.values()) > 0.5  # a quarter by chance


def test_command_line(spark, source, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "create_session", lambda: spark)
    path = tmp_path / "config.json"
    settings = {"root": str(tmp_path / "out"), "interactions": str(source / "pairs.csv"), "titles": str(source / "titles.csv"), "supplement": str(source / "more.csv"), "media": str(source / "media"), "seeds": [1]}
    path.write_text(json.dumps(settings | {"experiments": [{"label": "t", "source": "metadata"}]}))
    assert cli.main(["prepare-cohort", "--config", str(path)]) == 0
    assert cli.main(["prepare-input-data", "--config", str(path)]) == 0
    path.write_text(json.dumps(settings | {"titles": "/nowhere"}))
    assert cli.main(["prepare-cohort", "--config", str(path), "--force"]) == 1


def test_draws_by_default_reach_the_percentiles_of_28_comparisons():
    assert Config(root="x", interactions="y").draws == 10_000
    assert Config(root="x", interactions="y").draws * 0.05 / 28 / 2 > 5  # draws beyond each limit
