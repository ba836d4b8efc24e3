"""Registered queries over media windows, generated scenes and activity segments, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.functions import activity, graphtext, sampling
from kinograph.operators import outcomes as O
from kinograph.operators import requests as Q
from kinograph.operators import segments as S
from kinograph.plans.graphs import GRAPHS
from kinograph.plans.problems import table
from kinograph.session import written


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.fixed_windows(table(spark, sf_dir, "item_inventory"))


def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = F.array_join(F.transform("shot_changes", lambda x: x.cast("decimal(18,3)").cast("string")), ",")
    return windows(spark, sf_dir).select("content_id", "scene_idx", "scene_start", "scene_end", F.round("duration", 6).alias("duration"), rendered.alias("shot_changes"))


def keyframe_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.keyframes(windows(spark, sf_dir))


def evidence_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.evidence_totals(windows(spark, sf_dir))


def missing_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.missing_scenes(windows(spark, sf_dir), table(spark, sf_dir, "scene_outputs").select("content_id", "scene_idx"))


def scene_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each scene, of which nine in ten are there, by digest."""
    planned = windows(spark, sf_dir)
    stems = sampling.keyframes(planned).select("content_id", "stem").distinct()
    there = stems.where(S.hash_number("content_id", "stem") % 10 > 0).withColumn("path", F.concat_ws("/", "content_id", F.concat("stem", F.lit(".png"))))
    evidence = Q.scene_evidence(planned, there)
    return evidence.select("task_id", F.array_join("paths", ",").alias("paths"), "missing")


def latest_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored row of each scene and representation: the one of the last output."""
    outputs = table(spark, sf_dir, "scene_outputs").join(F.broadcast(table(spark, sf_dir, "generation_arms").select("arm", "representation")), "arm")
    rows = outputs.select("content_id", "scene_idx", "representation", "output_id", "arm", "finish_reason", "warning", "error", "raw_output")
    return O.latest(rows, ["content_id", "scene_idx", "representation"], ["output_id"])


def latest_scene_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_scenes(spark, sf_dir).select("content_id", "scene_idx", "representation", "output_id", "arm")


def tagged(rows: DataFrame) -> DataFrame:
    """``rows`` with ``error, tags, structured`` and the ``graph`` of those that hold one; texts that were cut are not read."""
    text, is_graph = F.col("raw_output"), F.col("representation") == "graph"
    cut = F.coalesce(F.col("finish_reason").rlike(O.LIMIT_REASON), F.lit(False))
    rows = graphtext.with_graphs(rows, F.when(is_graph & ~cut, text)).drop("mode", "parse_error")
    parsed = F.when(is_graph, F.col("graph").isNotNull()).otherwise(text.rlike(r"\S"))
    failed = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.coalesce(text, F.lit("")).rlike(r"\S"), "empty output")
    tags = O.response_tags(F.col("finish_reason"), text, F.col("warning"), parsed)
    return rows.withColumns({"error": failed, "tags": tags, "structured": parsed})


def scene_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tagged(latest_scenes(spark, sf_dir))
    return rows.select("content_id", "scene_idx", "representation", O.outcome(F.col("error"), F.col("tags")).alias("outcome"), O.needs_generation(F.col("error"), F.col("tags")).alias("again"))


def outcome_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = table(spark, sf_dir, "scene_outputs").join(F.broadcast(table(spark, sf_dir, "generation_arms").select("arm", "representation")), "arm")
    rows = tagged(outputs)
    return O.outcome_histogram(rows.select("arm", O.outcome(F.col("error"), F.col("tags")).alias("outcome")), "arm")


def scene_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.admission(tagged(latest_scenes(spark, sf_dir)))
    return rows.select("content_id", "scene_idx", "representation", "rejection")


def scene_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.admission(tagged(latest_scenes(spark, sf_dir)))
    return O.coverage(rows, "representation").withColumn("coverage", F.round("coverage", 12))


def pending_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tagged(latest_scenes(spark, sf_dir).where("representation = 'graph'"))
    contents = stored.select("content_id").distinct()
    expected = windows(spark, sf_dir).join(contents, "content_id", "left_semi").select("content_id", "scene_idx")
    return O.pending(expected, stored, ["content_id", "scene_idx"])


def best_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tagged(table(spark, sf_dir, "scene_outputs").withColumn("representation", F.split("arm", "_")[0]))
    passes = rows.select("content_id", "scene_idx", F.col("output_id").alias("pass"), "error", "tags")
    return O.best_pass(passes, ["content_id", "scene_idx"]).select("content_id", "scene_idx", F.col("pass").alias("output_id"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = table(spark, sf_dir, "scene_outputs").where("raw_output IS NOT NULL")
    return outputs.select("output_id", O.repeated_line(F.col("raw_output")).alias("line"), F.length(O.drop_repeated_last_line(F.col("raw_output"))).alias("kept"))


def action_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.admission(tagged(latest_scenes(spark, sf_dir).where("representation = 'graph'"))).where("rejection IS NULL")
    return rows.select("content_id", "scene_idx", F.col("graph.actions.action").alias("phrases"))


def scene_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array_distinct(F.filter(F.transform("phrases", activity.activity_key), lambda x: x.isNotNull()))
    return action_phrases(spark, sf_dir).select("content_id", "scene_idx", keys.alias("activities"))


def activity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = action_phrases(spark, sf_dir).select(F.explode("phrases").alias("phrase"))
    return phrases.groupBy("phrase").agg(F.count("*").alias("actions")).withColumn("key", activity.activity_key(F.col("phrase")))


def activity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.activity_segments(scene_activities(spark, sf_dir))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("content_id", "activity", "start", "length", F.array_join(F.col("scene_ids").cast("array<string>"), ",").alias("scene_ids"))


def segment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(S.segments(activity_segments(spark, sf_dir)))


def segment_length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.length_distribution(S.segments(activity_segments(spark, sf_dir)))


def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segment_summary(S.segments(activity_segments(spark, sf_dir))).withColumn("singletons", F.round("singletons", 12))


def action_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(S.action_bags(scene_activities(spark, sf_dir)))


def contiguous_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.contiguous_starts(scene_activities(spark, sf_dir))


def time_window_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(S.time_windows(scene_activities(spark, sf_dir)))


def random_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(S.random_scenes(scene_activities(spark, sf_dir)))


def segment_overlap_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = written(scene_activities(spark, sf_dir), "activities")
    found = S.overlap(S.action_bags(scenes), S.segments(S.activity_segments(scenes)))
    return found.withColumn("jaccard", F.round("jaccard", 12))


def keyframe_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of which, by digest, a quarter has a timeline, a quarter a broken one beside a list, a quarter nothing but an index, and a
    quarter only a position."""
    planned = windows(spark, sf_dir)
    case = (S.hash_number("content_id", "scene_idx") % 4).alias("case")
    shown = planned.select("content_id", "scene_idx", case, F.transform("keyframe_ticks", lambda t: t / 10).alias("t"))
    shot = lambda t: F.struct(t.alias("timestamp"))
    scenes = shown.select(
        "content_id", F.when(F.col("case") < 3, F.col("scene_idx")).alias("scene_idx"), F.col("scene_idx").alias("position"), F.array().cast("array<double>").alias("keyframes_given"),
        F.when(F.col("case") == 0, F.transform("t", lambda t: shot(t + 1.04))).when(F.col("case") == 1, F.array(shot(F.lit(1.0)), shot(F.lit(None).cast("double")))).alias("timeline"),
        F.when(F.col("case") == 1, F.concat(F.reverse("t"), F.array(F.lit(-1.0), F.col("t")[0] + 2.07))).alias("keyframe_timestamps"),
    )
    found = sampling.keyframe_fallbacks(scenes, planned)
    tenths = F.transform("keyframes", lambda t: F.round(t * 10).cast("bigint").cast("string"))
    return found.select("content_id", "position", F.array_join(tenths, ",").alias("tenths"))


def reclassified_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs as a reader without repairs would have stored them, read again."""
    graphs = latest_scenes(spark, sf_dir).where("representation = 'graph' AND raw_output IS NOT NULL")
    read = graphtext.with_graphs(graphs, F.col("raw_output"))
    native = F.coalesce(F.col("mode") == "native", F.lit(False))
    tags = F.when(native, F.array().cast("array<string>")).otherwise(F.array(F.lit(graphtext.PARSE_FAILED)))
    stored = read.select("output_id", "raw_output", "error", F.when(native, F.col("graph")).alias("graph"), tags.alias("tags"))
    return O.reclassified(stored).select("output_id", "changed", F.col("graph").isNotNull().alias("readable"))


QUERIES = {
    f.__name__: f
    for f in (
        keyframe_fallbacks, reclassified_scenes,
        fixed_windows, keyframe_timestamps, evidence_totals, missing_scenes, scene_requests, latest_scene_upsert, scene_tags, outcome_histogram, scene_admission, scene_coverage,
        pending_scenes, best_passes, repeated_lines, activity_keys, activity_segments, segment_list, segment_length_distribution, segment_summary, action_bag,
        contiguous_starts, time_window_variant, random_variant, segment_overlap_jaccard,
    )
}

WINDOWS = """
videos AS (SELECT content_id, CAST(CAST(duration_seconds AS DECIMAL(18,6)) * 1000000 AS BIGINT) AS d FROM item_inventory WHERE isfinite(duration_seconds) AND duration_seconds > 0),
w AS (SELECT content_id, d, unnest(range(0, (d - 1) // 30000000 + 1)) AS k FROM videos),
bounds AS (SELECT content_id, CAST(k AS INTEGER) AS scene_idx, k * 30000000 AS s, least((k + 1) * 30000000, d) AS e FROM w),
bins AS (SELECT *, [b FOR b IN [s + j * 5000000 FOR j IN range(0, 6)] IF b < e] AS b FROM bounds),
frames AS (SELECT *, list_distinct([(x + least(x + 5000000, e)) // 200000 FOR x IN b]) AS ticks FROM bins)"""

STORED = r"""
ranked AS (SELECT o.*, a.representation, row_number() OVER (PARTITION BY content_id, scene_idx, a.representation ORDER BY output_id DESC) AS r FROM scene_outputs o JOIN generation_arms a USING (arm)),
latest AS (SELECT * FROM ranked WHERE r = 1)"""


def _tagged(source: str) -> str:
    return rf"""{GRAPHS},
judged AS (SELECT *, coalesce(error, CASE WHEN raw_output IS NULL OR NOT regexp_matches(raw_output, '\S') THEN 'empty output' END) AS failure,
    CASE WHEN raw_output IS NULL THEN NULL WHEN regexp_matches(coalesce(finish_reason, ''), '(?i)length|max_?tokens') THEN 'token_limit'
         WHEN NOT CASE WHEN representation = 'graph' THEN coalesce(readable, false)
                       ELSE regexp_matches(raw_output, '\S') END THEN 'parse_failed'
         WHEN list_contains(warning, 'REPEAT_OCCURRED') THEN 'repeat_occurred' END AS tag FROM {source} LEFT JOIN (SELECT output_id, ok AS readable FROM graphs) USING (output_id)),
tagged AS (SELECT *, CASE WHEN failure IS NOT NULL THEN 'error' ELSE coalesce(tag, 'success') END AS outcome,
    failure IS NOT NULL OR coalesce(tag IN ('token_limit', 'parse_failed'), false) AS again,
    CASE WHEN failure IS NOT NULL THEN 'error' WHEN tag IN ('token_limit', 'parse_failed') THEN tag END AS rejection FROM judged)"""


#: Steps of a verb to its key; each works on the result of the one before.
_IRREGULAR = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in activity.IRREGULAR.items()) + " ELSE {0} END"
PHRASES = rf"""{STORED}, {_tagged("latest")},
scenes AS (SELECT content_id, scene_idx, [x[2] FOR x IN arms_a] AS phrases FROM tagged JOIN judged_graphs USING (output_id) WHERE representation = 'graph' AND rejection IS NULL),
texts AS (SELECT DISTINCT unnest(phrases) AS phrase FROM scenes),
verbs AS (SELECT phrase, [t FOR t IN regexp_extract_all(lower(phrase), '[a-z]+\d*') IF NOT regexp_full_match(t, '[a-z]\d+') AND t NOT IN {activity.SKIPPED}][1] AS v FROM texts),
mapped AS (SELECT phrase, v, {_IRREGULAR.format("v")} AS a FROM verbs),
bared AS (SELECT phrase, v, CASE WHEN a LIKE '%ing' AND length(a) > 4 THEN left(a, length(a) - 3) WHEN a LIKE '%ies' AND length(a) > 4 THEN left(a, length(a) - 3) || 'y'
    WHEN regexp_matches(a, '(?:s|x|z|ch|sh)es$') THEN left(a, length(a) - 2) WHEN a LIKE '%s' AND a NOT LIKE '%ss' AND length(a) > 3 THEN left(a, length(a) - 1)
    WHEN a LIKE '%ed' AND length(a) > 4 THEN left(a, length(a) - 2) ELSE a END AS b FROM mapped),
again AS (SELECT phrase, v, {_IRREGULAR.format("b")} AS c FROM bared),
ended AS (SELECT phrase, v, CASE WHEN c LIKE '%e' AND length(c) > 2 THEN left(c, length(c) - 1) ELSE c END AS d FROM again),
keys AS (SELECT phrase, CASE WHEN v IN {activity.EMPTY} THEN NULL WHEN length(d) > 2 AND d[-1] = d[-2] AND d[-1] NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(d, length(d) - 1) ELSE d END AS key FROM ended),
acts AS (SELECT DISTINCT content_id, scene_idx, key AS activity FROM (SELECT content_id, scene_idx, unnest(phrases) AS phrase FROM scenes) JOIN keys USING (phrase) WHERE key IS NOT NULL)"""

SEGMENTS = f"""{PHRASES},
islands AS (SELECT *, scene_idx - row_number() OVER (PARTITION BY content_id, activity ORDER BY scene_idx) AS island FROM acts),
members AS (SELECT content_id, activity, min(scene_idx) OVER (PARTITION BY content_id, activity, island) AS start, scene_idx FROM islands),
segments AS (SELECT content_id, activity, start, count(*) AS length, list(scene_idx ORDER BY scene_idx) AS scene_ids FROM members GROUP BY 1, 2, 3),
bags AS (SELECT content_id, activity, min(scene_idx) AS start, count(*) AS length, list(scene_idx ORDER BY scene_idx) AS scene_ids FROM acts GROUP BY 1, 2),
starts AS (SELECT content_id, scene_idx, count(*) OVER (PARTITION BY content_id, island ORDER BY scene_idx DESC) AS run
    FROM (SELECT content_id, scene_idx, scene_idx - row_number() OVER (PARTITION BY content_id ORDER BY scene_idx) AS island FROM scenes))"""

_SHOW = "content_id, activity, start, length, array_to_string(scene_ids, ',') AS scene_ids"
_HASH = "CAST('0x' || substr(md5(concat_ws('|', {})), 1, 8) AS BIGINT)"

ORACLE = {
    "keyframe_fallbacks": f"""WITH {WINDOWS}, c AS (SELECT content_id, scene_idx, ticks, {_HASH.format("content_id, scene_idx")} % 4 AS k FROM frames)
        SELECT content_id, scene_idx AS position, array_to_string(list_sort(list_distinct(CASE k WHEN 0 THEN [t + 10 FOR t IN ticks] WHEN 1 THEN list_append(ticks, list_min(ticks) + 20) ELSE ticks END)), ',') AS tenths FROM c""",
    "reclassified_scenes": f"""WITH {GRAPHS}, {STORED} SELECT output_id, ok AND NOT native AND error IS NULL AS changed, native OR ok AND error IS NULL AS readable
        FROM latest JOIN graphs USING (output_id) WHERE representation = 'graph'""",
    "fixed_windows": f"""WITH {WINDOWS} SELECT content_id, scene_idx, s / 1000000.0 AS scene_start, e / 1000000.0 AS scene_end, round((e - s) / 1000000.0, 6) AS duration,
        array_to_string([printf('%.3f', x / 1000000.0) FOR x IN b], ',') AS shot_changes FROM frames""",
    "keyframe_timestamps": f"""WITH {WINDOWS} SELECT content_id, scene_idx, t / 10.0 AS timestamp, lpad(CAST(t // 10 AS VARCHAR), 4, '0') || CASE WHEN t % 10 > 0 THEN '_' || (t % 10) ELSE '' END AS stem
        FROM (SELECT content_id, scene_idx, unnest(ticks) AS t FROM frames)""",
    "evidence_totals": f"WITH {WINDOWS} SELECT count(DISTINCT content_id) AS videos, count(*) AS scenes, CAST(sum(len(ticks)) AS BIGINT) AS frames FROM frames",
    "missing_scenes": f"""WITH {WINDOWS}, x AS (SELECT content_id, scene_idx, EXISTS (SELECT 1 FROM scene_outputs o WHERE o.content_id = f.content_id AND o.scene_idx = f.scene_idx) AS there FROM frames f)
        SELECT content_id, count(*) AS expected, count(*) FILTER (NOT there) AS missing, count(*) FILTER (NOT there) = 0 AS complete FROM x GROUP BY 1""",
    "scene_requests": f"""WITH {WINDOWS}, k AS (SELECT content_id, scene_idx, unnest(ticks) AS t FROM frames),
        n AS (SELECT *, lpad(CAST(t // 10 AS VARCHAR), 4, '0') || CASE WHEN t % 10 > 0 THEN '_' || (t % 10) ELSE '' END AS stem FROM k),
        p AS (SELECT *, {_HASH.format("content_id, stem")} % 10 > 0 AS there FROM n)
        SELECT content_id || ':' || scene_idx AS task_id, coalesce(string_agg(content_id || '/' || stem || '.png', ',' ORDER BY t) FILTER (there), '') AS paths, count(*) FILTER (NOT there) AS missing
        FROM p GROUP BY content_id, scene_idx""",
    "latest_scene_upsert": f"WITH {STORED} SELECT content_id, scene_idx, representation, output_id, arm FROM latest",
    "scene_tags": f"WITH {STORED}, {_tagged('latest')} SELECT content_id, scene_idx, representation, outcome, again FROM tagged",
    "outcome_histogram": f"""WITH s AS (SELECT o.*, representation FROM scene_outputs o JOIN generation_arms USING (arm)), {_tagged("s")} SELECT arm, count(*) AS total,
        {", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in O.OUTCOMES)} FROM tagged GROUP BY 1""",
    "scene_admission": f"WITH {STORED}, {_tagged('latest')} SELECT content_id, scene_idx, representation, rejection FROM tagged",
    "scene_coverage": f"""WITH {STORED}, {_tagged('latest')} SELECT representation, count(*) AS scenes, count(*) FILTER (rejection IS NULL) AS valid,
        {", ".join(f"count(*) FILTER (rejection = '{r}') AS {r}" for r in ("error", "token_limit", "parse_failed"))}, CAST(0 AS BIGINT) AS raw,
        round(count(*) FILTER (rejection IS NULL) / CAST(count(*) AS DOUBLE), 12) AS coverage FROM tagged GROUP BY 1""",
    "pending_scenes": f"""WITH {WINDOWS}, {STORED}, {_tagged('latest')}, g AS (SELECT * FROM tagged WHERE representation = 'graph')
        SELECT f.content_id, f.scene_idx FROM frames f LEFT JOIN g ON f.content_id = g.content_id AND f.scene_idx = g.scene_idx
        WHERE f.content_id IN (SELECT content_id FROM g) AND coalesce(g.again, true)""",
    "best_passes": f"""WITH s AS (SELECT *, string_split(arm, '_')[1] AS representation FROM scene_outputs), {_tagged("s")},
        r AS (SELECT *, CASE WHEN failure IS NOT NULL THEN 0 WHEN tag IS NULL THEN 3 WHEN tag = 'repeat_occurred' THEN 2 ELSE 1 END AS k FROM tagged)
        SELECT content_id, scene_idx, arg_max(output_id, k * 1000000000000 + CASE WHEN k = 3 THEN -output_id ELSE output_id END) AS output_id FROM r GROUP BY 1, 2""",
    "repeated_lines": r"""WITH l AS (SELECT output_id, raw_output, string_split(raw_output, chr(10)) AS lines FROM scene_outputs WHERE raw_output IS NOT NULL)
        SELECT output_id, list_min([k - 1 FOR k IN range(2, len(lines) + 1) IF list_position(lines, lines[k]) < k]) AS line,
            CASE WHEN list_contains(lines[:-2], lines[-1]) THEN length(array_to_string(lines[:-2], chr(10))) ELSE length(raw_output) END AS kept FROM l""",
    "activity_keys": f"""WITH {PHRASES}, n AS (SELECT unnest(phrases) AS phrase FROM scenes) SELECT phrase, count(*) AS actions, any_value(key) AS key FROM n JOIN keys USING (phrase) GROUP BY 1""",
    "activity_segments": f"WITH {SEGMENTS} SELECT * FROM members",
    "segment_list": f"WITH {SEGMENTS} SELECT {_SHOW} FROM segments",
    "segment_length_distribution": f"WITH {SEGMENTS} SELECT length, count(*) AS segments FROM segments GROUP BY 1 ORDER BY 1 LIMIT 15",
    "segment_summary": f"WITH {SEGMENTS} SELECT count(*) AS segments, CAST(sum(length) AS BIGINT) AS memberships, round(avg(CASE WHEN length = 1 THEN 1.0 ELSE 0.0 END), 12) AS singletons FROM segments",
    "action_bag": f"WITH {SEGMENTS} SELECT {_SHOW} FROM bags",
    "contiguous_starts": f"WITH {SEGMENTS} SELECT * FROM starts",
    "time_window_variant": f"""WITH {SEGMENTS}, p AS (SELECT s.content_id, s.activity, s.start, s.length, list(t.scene_idx ORDER BY t.scene_idx) AS places
            FROM segments s JOIN starts t ON s.content_id = t.content_id AND t.run >= s.length GROUP BY 1, 2, 3, 4),
        m AS (SELECT *, places[{_HASH.format("42, content_id, activity, start")} % len(places) + 1] AS f FROM p)
        SELECT content_id, activity, start, length, array_to_string(range(f, f + length), ',') AS scene_ids FROM m""",
    "random_variant": f"""WITH {SEGMENTS}, d AS (SELECT content_id, scene_idx, {_HASH.format("42, content_id, scene_idx")} AS draw FROM scenes),
        r AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY scene_idx) AS place, row_number() OVER (PARTITION BY content_id ORDER BY draw, scene_idx) AS image FROM d),
        i AS (SELECT a.content_id, a.scene_idx, b.scene_idx AS target FROM r a JOIN r b ON a.content_id = b.content_id AND a.image = b.place),
        v AS (SELECT m.content_id, m.activity, m.start, count(*) AS length, list(i.target ORDER BY i.target) AS scene_ids FROM members m JOIN i USING (content_id, scene_idx) GROUP BY 1, 2, 3)
        SELECT {_SHOW} FROM v""",
    "segment_overlap_jaccard": f"""WITH {SEGMENTS}, c AS (SELECT b.content_id, b.activity, b.start, b.scene_ids = s.scene_ids AS same,
            len(list_intersect(b.scene_ids, s.scene_ids)) / CAST(len(list_distinct(list_concat(b.scene_ids, s.scene_ids))) AS DOUBLE) AS j
            FROM bags b JOIN segments s USING (content_id))
        SELECT content_id, activity, start, bool_or(same) AS identical, round(max(j), 12) AS jaccard FROM c GROUP BY 1, 2, 3""",
}
