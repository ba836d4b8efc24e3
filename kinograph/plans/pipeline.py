"""The eight steps from source files to a report. Each publishes its tables, then a manifest; a step whose manifest fits is skipped.

Models and media tools are hooks: ``generate`` turns requests into texts, ``encoder`` texts into vectors, ``sampler`` keyframes into
files. Without them the steps use deterministic stand-ins, so the whole pipeline runs offline.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinograph.functions import activity, graphtext, ids, sampling
from kinograph.operators import bundle, catalog, cohort, diagnosis, outcomes, ranking, segments, towers, training
from kinograph.session import map_arrow, ship, written
from kinograph.sources import manifest, readers


def each_row(rows: DataFrame, names: list[str], function: Callable, result: str, kind: str, arrow: pa.DataType) -> DataFrame:
    """``rows`` with ``function`` of the columns ``names`` as ``result``: one call a row, batch by batch in one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [function(*values) for values in zip(*(batch.column(n).to_pylist() for n in names), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], [*batch.schema.names, result])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"{result} {kind}"])
    return map_arrow(rows, run, schema)


class StepError(RuntimeError):
    """A step cannot go on; what speaks against it has been published where possible."""


def stand_in_text(content: str, scene: int, kind: str) -> str:
    """What the stand-in generator returns: a small graph, or a sentence."""
    actor, verb = ("cook", "dancer", "potter")[scene % 3], ("stirring", "cutting", "holding")[(len(content) + scene // 2) % 3]
    if kind == "description":
        return f"The {actor} is {verb} a bowl."
    return f"[Context]\nmedium: live_action\nformat: vlog\ntopics: {verb}\n[Entities]\n{actor}; calm\nbowl\n[Actions]\n{actor} - {verb} - bowl; none; unknown"


@dataclass(frozen=True)
class Config:
    root: str
    dataset: str = "microlens_100k"
    interactions: str = ""
    titles: str = ""
    supplement: str | None = None
    media: str = ""
    ratings: str | None = None
    movies: str | None = None
    id_map: str | None = None
    scene_seconds: int = 30
    keyframes: int = 6
    min_events: int = cohort.MIN_EVENTS
    retained: int = cohort.RETAINED
    history: int = cohort.HISTORY
    dimensions: int = 64
    penalties: tuple[float, ...] = (1.0,)
    experiments: tuple[tuple[str, str], ...] = (("titles", "metadata"), ("graphs", "graph"))
    seeds: tuple[int, ...] = (42, 43, 44)
    draws: int = 10_000
    training: training.Training = field(default_factory=training.Training)

    def __post_init__(self):
        sampling.check_sampling(self.scene_seconds, self.keyframes)
        labels = [label.casefold() for label, _ in self.experiments]
        if any(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_+.-]*", label) is None for label, _ in self.experiments):
            raise ValueError("a label names folders: it begins with a letter or digit, then letters, digits, _, +, . and - follow")
        if len(set(labels)) < len(labels) or any(source not in ("metadata", "graph", "description") for _, source in self.experiments):
            raise ValueError("experiments need labels that differ and a known source")

    def folder(self, name: str) -> str:
        return os.path.join(self.root, self.dataset, name)


@dataclass
class Pipeline:
    spark: SparkSession
    config: Config
    duration: Callable[[str], float | None] | None = None
    generate: Callable[[str, int, str, float], str] | None = None
    encoder: Callable[[list[str]], np.ndarray] | None = None
    sampler: Callable[[str, str], None] | None = None
    force: bool = False

    def __post_init__(self):
        ship(self.spark)

    def _step(self, name: str, identity: dict, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        folder = self.config.folder(name)
        if not self.force:
            try:
                return manifest.load(self.spark, folder, identity)
            except ValueError:
                pass
        manifest.publish(make(), folder, identity)
        return manifest.load(self.spark, folder, identity)

    def _made_from(self, name: str) -> str | None:
        """The identity of an earlier step's result, which holds those of the steps before it."""
        return manifest.identity_of(self.spark, self.config.folder(name))

    def _scene_identity(self, kinds: list[str]) -> dict:
        return {kind: manifest.content_fingerprint(self._scenes(kind).select("content_id", "scene_idx", "raw_output")) for kind in kinds}

    def _load(self, name: str) -> dict[str, DataFrame]:
        return manifest.load(self.spark, self.config.folder(name))

    # 1
    def prepare_cohort(self) -> dict[str, DataFrame]:
        c = self.config

        def make() -> dict[str, DataFrame]:
            if c.ratings:
                mapped = readers.read_id_map(self.spark, c.id_map) if c.id_map else None
                rows, rejected = readers.read_ratings(self.spark, c.ratings, mapped)
                names, missing_video_excludes = readers.read_movies(self.spark, c.movies), True
                if mapped is not None:
                    catalog.require_all(mapped, names, "item_id", "mapped movies without a title")
                rows = rows.withColumnRenamed("line_id", "event_id")
            else:
                rows, rejected = readers.read_interactions(self.spark, c.interactions)
                names, missing_video_excludes = readers.read_titles(self.spark, c.titles), False
            broken = rejected.limit(3).collect()
            if broken:
                raise StepError(f"malformed rows: {[(r.line_no, r.reason) for r in broken]}")
            rows = written(rows, "log")  # parsed once for all its uses
            items = rows.select("item_id").distinct().withColumn("content_id", ids.content_id(c.dataset, "item_id"))
            files = catalog.match_files(items, readers.list_media(self.spark, c.media))
            probe = self.duration or (lambda path: 30.0 + len(path) % 60)
            named = files.select("item_id", "content_id", F.when(F.col("status") == "found", F.col("path")).alias("found"), F.col("path").alias("source_video_path"), F.col("size").alias("source_file_size"), F.col("mtime_ns").alias("source_mtime_ns"))
            probed = each_row(named, ["found"], lambda path: None if path is None else probe(path), "duration_seconds", "double", pa.float64())
            inventory = written(probed.drop("found"), "inventory")  # each file is probed once
            judged = catalog.eligibility(inventory).withColumnRenamed("reasons", "exclusion_reasons")
            inventory = inventory.join(judged.drop("content_id"), "item_id")
            extra = readers.read_titles(self.spark, c.supplement, header=True, quoted=True) if c.supplement else names.limit(0)
            titles = catalog.complete_titles(items, names, extra)
            failures = titles.where("origin = 'missing'").select("item_id", F.lit("no_title").alias("reason"))
            unusable = inventory.where("NOT eligible").select("item_id", F.element_at("exclusion_reasons", 1).alias("reason"))
            if not missing_video_excludes:
                failures = failures.unionByName(unusable)
            if not failures.isEmpty():
                failures.write.mode("overwrite").json(c.folder("cohort_failures"))
                raise StepError(f"items without title or media: {[tuple(r) for r in failures.limit(3).collect()]}")
            lost = rows.join(unusable, "item_id").groupBy("item_id", "reason").agg(F.count("*").alias("interaction_count"))
            kept = rows.join(unusable, "item_id", "left_anti")
            return {"events": kept, "inventory": inventory, "titles": titles.join(unusable, "item_id", "left_anti").select("item_id", "content_id", "title"), "excluded_items": lost}

        sources = {name: manifest.file_identity(self.spark, getattr(c, name)) for name in ("interactions", "ratings", "movies", "id_map", "media", "titles", "supplement")}
        return self._step("cohort", sources, make)

    # 2
    def prepare_input_data(self) -> dict[str, DataFrame]:
        c = self.config

        def make() -> dict[str, DataFrame]:
            windows = sampling.fixed_windows(self._load("cohort")["inventory"].where("eligible"), scene_seconds=c.scene_seconds, keyframes=c.keyframes)
            frames = sampling.keyframes(windows)
            if self.sampler:
                sample = self.sampler
                each_row(frames.select("content_id", "stem"), ["content_id", "stem"], sample, "done", "boolean", pa.bool_()).write.format("noop").mode("overwrite").save()
            return {"windows": windows, "frames": frames}

        return self._step("windows", {"seconds": c.scene_seconds, "keyframes": c.keyframes, "cohort": self._made_from("cohort")}, make)

    # 3 and 4
    def extract_scenes(self, kind: str) -> dict[str, DataFrame]:
        """Generates the scenes of one kind that are not stored yet, or need to be again, and stores all."""
        c, text = self.config, self.generate or (lambda content, scene, kind, penalty: stand_in_text(content, scene, kind))
        expected = self._load("windows")["windows"].select("content_id", "scene_idx")
        keys, folder = ["content_id", "scene_idx"], c.folder(f"scenes_{kind}")
        current = manifest.read_json(self.spark, os.path.join(folder, manifest.MANIFEST))
        stored = None if self.force or not current else self.spark.read.parquet(os.path.join(folder, current["tables"][-1]))
        if stored is not None and kind == "graph":
            stored, current = self._reclassified(stored, current, folder)
        wanted = expected if stored is None else outcomes.pending(expected, stored, keys)

        def generate(left: DataFrame, penalty: float) -> DataFrame:
            made = each_row(left.select(*keys), keys, lambda content, scene: text(content, scene, kind, penalty), "raw_output", "string", pa.string())
            raw = written(made, "responses")
            failed = F.when(~F.coalesce("raw_output", F.lit("")).rlike(r"\S"), "empty output")
            if kind != "graph":
                return raw.select(*keys, "raw_output", failed.alias("error"), F.array().cast("array<string>").alias("tags"))
            read = graphtext.with_graphs(raw, F.col("raw_output"))
            tags = F.when(failed.isNull() & F.col("graph").isNull(), F.array(F.lit(graphtext.PARSE_FAILED))).otherwise(F.array().cast("array<string>"))
            return read.select(*keys, "raw_output", "graph", "mode", failed.alias("error"), tags.alias("tags"))

        if not wanted.isEmpty():
            found = outcomes.generation_passes(wanted, generate, list(c.penalties), keys).drop("pass")
            number = 1 + (int(current["tables"][-1].rpartition("_")[2]) if stored is not None else 0)
            kept = stored.join(expected, keys, "left_semi") if stored is not None else None
            manifest.upsert(kept, found, keys, os.path.join(folder, f"rows_{number}"))
            manifest.write_json(self.spark, os.path.join(folder, manifest.MANIFEST), {"status": "ready", "tables": [f"rows_{number}"]})
        return {"rows": self._scenes(kind)}

    def _reclassified(self, stored: DataFrame, current: dict, folder: str) -> tuple[DataFrame, dict]:
        """Stored rows that could not be read once and can be now; they are rewritten only if there is one."""
        found = written(outcomes.reclassified(stored), "reclassified")
        if found.where("changed").isEmpty():
            return stored, current
        name = f"rows_{1 + int(current['tables'][-1].rpartition('_')[2])}"
        found.drop("changed").write.mode("error").parquet(os.path.join(folder, name))
        current = {"status": "ready", "tables": [name]}
        manifest.write_json(self.spark, os.path.join(folder, manifest.MANIFEST), current)
        return self.spark.read.parquet(os.path.join(folder, name)), current

    def _scenes(self, kind: str) -> DataFrame:
        folder = self.config.folder(f"scenes_{kind}")
        current = manifest.read_json(self.spark, os.path.join(folder, manifest.MANIFEST))
        if not current:
            raise StepError(f"no scenes of kind {kind}")
        return self.spark.read.parquet(os.path.join(folder, current["tables"][-1]))

    def generation_statistics(self, kind: str) -> DataFrame:
        return outcomes.outcome_histogram(self._scenes(kind).select(outcomes.outcome(F.col("error"), F.col("tags")).alias("outcome")))

    # 5
    def embed_representations(self) -> dict[str, DataFrame]:
        c, encode = self.config, self.encoder or towers.digest_encoder(self.config.dimensions)

        def make() -> dict[str, DataFrame]:
            source = self._load("cohort")
            log = cohort.interaction_log(source["events"])
            kept = cohort.retained_sequences(log, c.min_events, c.retained)
            index = cohort.item_index(kept)
            inputs = cohort.history_inputs(kept, index, c.history)
            split = cohort.leave_one_out(kept).select("event_id", "phase", "position")
            rows = inputs.join(split, "event_id")
            items = source["titles"].withColumn("item", F.col("item_id").cast("bigint")).join(index, "item").select("item_idx", "content_id", "title")
            texts = [items.select(F.lit("metadata").alias("source"), "item_idx", F.col("title").alias("text"))]
            for kind in sorted({source for _, source in c.experiments} - {"metadata"}):
                scenes = outcomes.admission(self._scenes(kind).withColumn("structured", F.lit(True))).where("rejection IS NULL")
                own = bundle.nodes(scenes).select("content_id", "text") if kind == "graph" else scenes.select("content_id", F.col("raw_output").alias("text"))
                texts.append(items.select("item_idx", "content_id").join(own, "content_id").select(F.lit(kind).alias("source"), "item_idx", "text"))
            joined = texts[0]
            for more in texts[1:]:
                joined = joined.unionByName(more)
            vectors = towers.encode_distinct(joined, "text", encode)
            parts = joined.withColumn("text", F.btrim("text", F.lit(" \t\r\n"))).join(vectors, "text").select("source", "item_idx", F.posexplode("vector").alias("d", "x"))
            means = parts.groupBy("source", "item_idx", "d").agg(F.avg("x").alias("x")).groupBy("source", "item_idx").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).getField("x").alias("vector"))
            zeros = F.array_repeat(F.lit(0.0), F.lit(c.dimensions))
            sources = F.explode(F.array(*(F.lit(s) for s in sorted({s for _, s in c.experiments}))))  # a few
            full = index.select("item_idx", sources.alias("source")).join(means, ["source", "item_idx"], "left")
            return {"rows": rows, "items": items, "vocabulary": vectors, "features": full.select("source", "item_idx", F.coalesce("vector", zeros).alias("vector")), "summary": cohort.split_summary(cohort.leave_one_out(kept))}

        return self._step("representations", {"experiments": list(map(list, c.experiments)), "settings": [c.min_events, c.retained, c.history], "dimensions": c.dimensions, "cohort": self._made_from("cohort"),
            "scenes": self._scene_identity(sorted({source for _, source in c.experiments} - {"metadata"})), "encoder": getattr(self.encoder, "identity", getattr(self.encoder, "__qualname__", "digest"))}, make)

    # 6
    def prepare_module(self) -> dict[str, DataFrame]:
        def make() -> dict[str, DataFrame]:
            rows = outcomes.admission(self._scenes("graph").withColumn("structured", F.lit(True))).where("rejection IS NULL")
            keys = F.array_distinct(F.filter(F.transform("graph.actions", lambda a: activity.activity_key(a["action"])), lambda x: x.isNotNull()))
            scenes = rows.select("content_id", "scene_idx", keys.alias("activities"))
            default = segments.segments(segments.activity_segments(scenes))
            variants = {"action_bag": segments.action_bags(scenes), "time_window": segments.time_windows(scenes), "random": segments.random_scenes(scenes)}
            return {"segments": default} | {f"segments_{name}": found for name, found in variants.items()}

        return self._step("segments", {"scenes": manifest.content_fingerprint(self._scenes("graph").select("content_id", "scene_idx", "raw_output"))}, make)

    # 7
    def run_recommendation(self) -> dict[str, DataFrame]:
        c = self.config

        def make() -> dict[str, DataFrame]:
            built = self._load("representations")
            arms = self.spark.createDataFrame(list(c.experiments), "arm string, source string")
            features = built["features"].join(F.broadcast(arms), "source").select("arm", "item_idx", "vector")
            runs = [(label, seed) for label, _ in c.experiments for seed in c.seeds]
            found = training.evaluate_runs(built["rows"].where("position > 0"), features, runs, c.training)
            return {"per_event_metrics": found.select("*", *ranking.metrics(F.col("rank")))}

        return self._step("recommendations", {"experiments": list(map(list, c.experiments)), "seeds": list(c.seeds), "training": vars(c.training), "representations": self._made_from("representations")}, make)

    # 8
    def run_diagnosis(self) -> str:
        """Publishes means, deviations, changes and comparisons, and returns the report."""
        c, labels = self.config, [label for label, _ in self.config.experiments]
        metrics = self._load("recommendations")["per_event_metrics"].withColumn("ndcg", F.col("`NDCG@10`"))
        counted = metrics.groupBy("arm", "seed").agg(F.count("*").alias("n")).agg(F.min("n"), F.max("n"), F.count("*")).first()
        if counted[0] != counted[1] or counted[2] != len(labels) * len(c.seeds):
            raise StepError("runs do not have the same test events")
        summary = diagnosis.seed_summary(metrics, "ndcg")
        base = next((label for label, source in c.experiments if source == "metadata"), labels[0])
        changes = diagnosis.relative_change(summary, base)
        values = diagnosis.user_means(metrics, "ndcg")
        observed = values.groupBy("arm").agg(F.avg("value").alias("mean"))
        compared = diagnosis.comparisons(observed, diagnosis.bootstrap(values, c.draws), labels)
        tables = self._step("diagnosis", {"draws": c.draws, "metrics": manifest.content_fingerprint(metrics)}, lambda: {"summary": summary.join(changes, "arm"), "comparisons": compared})
        report = report_of(tables["summary"], tables["comparisons"], c)
        manifest.write_json(self.spark, os.path.join(c.folder("diagnosis"), "report.json"), {"report": report})
        return report

    def run(self) -> str:
        self.prepare_cohort()
        self.prepare_input_data()
        for kind in sorted({"graph"} | {source for _, source in self.config.experiments} - {"metadata"}):
            self.extract_scenes(kind)
        self.embed_representations()
        self.prepare_module()
        self.run_recommendation()
        return self.run_diagnosis()


def report_of(summary: DataFrame, comparisons: DataFrame, config: Config) -> str:
    """A Markdown report of a few rows."""
    sources = dict(config.experiments)
    ordered = summary.withColumn("place", F.row_number().over(W.orderBy(F.desc("mean"), "arm"))).orderBy("place").collect()  # a row an experiment
    lines = ["# Diagnosis", "", "| experiment | source | NDCG@10 | sd | change |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {r.arm} | {sources[r.arm]} | {r['mean']:.6f} | {r.sd:.6f} | {'' if r.change is None else f'{r.change:+.2%}'} |" for r in ordered]
    lines += ["", "| left | right | difference | interval | verdict |", "| --- | --- | --- | --- | --- |"]
    for r in comparisons.orderBy("left", "right").collect():
        verdict = "superior" if r.superior else "inferior" if r.inferior else "undecided"
        lines.append(f"| {r.left} | {r.right} | {r.difference:+.6f} | {r.low:+.6f} to {r.high:+.6f} | {verdict} |")
    return "\n".join(lines) + "\n"
