"""Registered queries over the interaction log and the catalog, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.operators import catalog as C
from kinograph.operators import cohort as K
from kinograph.plans.problems import table
from kinograph.session import written


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.interaction_log(table(spark, sf_dir, "interactions"))


def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.retained_sequences(log(spark, sf_dir))


def stored_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retained sequences, a small part of the log, for queries that need them more than once."""
    return written(retained(spark, sf_dir), "retained")


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.leave_one_out(retained(spark, sf_dir))


def cohort_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cohort_counts(log(spark, sf_dir))


def log_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.log_fingerprint(log(spark, sf_dir))


def user_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.user_activity(log(spark, sf_dir))


def short_history_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = K.user_activity(log(spark, sf_dir), min_events=15)
    return users.where("excluded").select("user", "events")


def trimmed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = K.user_activity(log(spark, sf_dir))
    return users.agg(F.count_if("excluded").alias("excluded_users"), F.sum(F.when(F.col("excluded"), F.col("events")).otherwise(0)).alias("short_events"), F.sum("trimmed").alias("trimmed"))


def retained_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retained(spark, sf_dir)


def renumbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.renumbered(retained(spark, sf_dir)).select("event_id", "source_event_id", "user", "item", "ts")


def loo_split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).select("event_id", "user", "phase", "position")


def loo_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.split_summary(split(spark, sf_dir))


def catalog_item_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.item_index(retained(spark, sf_dir))


def history_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = stored_retained(spark, sf_dir)
    inputs = K.history_inputs(kept, K.item_index(kept))
    return inputs.withColumn("history", F.array_join(F.col("history").cast("array<string>"), ","))


def popularity_logq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.popularity(split(spark, sf_dir)).withColumns({"q": F.round("q", 12), "log_q": F.round("log_q", 9)})


def train_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.train_frequency(split(spark, sf_dir))


def untrained_target_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.untrained_targets(split(spark, sf_dir)).withColumn("untrained", F.round("untrained", 12))


def catalog_excluded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = K.catalog_split(retained(spark, sf_dir), table(spark, sf_dir, "item_inventory"))
    return both.where("NOT retained").select("item_id")


def item_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = C.eligibility(table(spark, sf_dir, "item_inventory"))
    return judged.withColumn("reasons", F.array_join("reasons", ","))


def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = C.eligibility(table(spark, sf_dir, "item_inventory"))
    return judged.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("items"))


def file_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory = table(spark, sf_dir, "item_inventory")
    stem = F.regexp_extract("source_video_path", r"([^/\\]+)\.mp4$", 1)
    files = inventory.where("source_video_path IS NOT NULL").select(
        stem.alias("item_id"), F.col("source_video_path").alias("path"), F.col("source_file_size").alias("size"), F.col("source_mtime_ns").alias("mtime_ns")
    )
    matched = C.match_files(inventory.select("item_id", "content_id"), files)
    return matched.withColumn("mtime_ns", F.col("mtime_ns").cast("string"))


def carried_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory = table(spark, sf_dir, "item_inventory")
    keys = ["item_id", "content_id", "source_video_path", "source_file_size", "source_mtime_ns"]
    previous = inventory.select(*keys, "duration_seconds")
    changed = F.when(F.col("source_file_size") % 3 == 0, F.col("source_file_size") + 1).otherwise(F.col("source_file_size"))
    current = inventory.select("item_id", "content_id", "source_video_path", changed.alias("source_file_size"), "source_mtime_ns", F.lit(None).cast("double").alias("duration_seconds"))
    return C.carry_durations(current, previous, keys).withColumn("source_mtime_ns", F.col("source_mtime_ns").cast("string"))


def supplement_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the documents: of each content the first document of the kind."""
    documents = table(spark, sf_dir, "documents").where("source = 'video_title' AND content_id IS NOT NULL AND trim(text) <> ''")
    first = documents.groupBy("content_id").agg(F.min_by("text", "doc_id").alias("title"))
    return table(spark, sf_dir, "item_inventory").select("item_id", "content_id").join(first, "content_id").select("item_id", "title")


def title_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.complete_titles(table(spark, sf_dir, "item_inventory"), table(spark, sf_dir, "metadata_titles"), supplement_titles(spark, sf_dir))


def title_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.completion_report(title_completion(spark, sf_dir))


def items_without_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "metadata_titles").where(r"title RLIKE '\\S'")
    return table(spark, sf_dir, "item_inventory").join(titles, "item_id", "left_anti").select("item_id")


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = C.eligibility(table(spark, sf_dir, "item_inventory"))
    return judged.where("eligible").select(F.col("item_id").cast("bigint").alias("item"))


def available_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.available_interactions(log(spark, sf_dir), _eligible(spark, sf_dir))[0].groupBy("item").agg(F.count("*").alias("rows"))


def item_availability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.available_interactions(log(spark, sf_dir), _eligible(spark, sf_dir))[1]


def duplicated_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicated_keys(log(spark, sf_dir), "user", "item", "ts")


QUERIES = {
    f.__name__: f
    for f in (
        cohort_counts, log_fingerprint, user_activity, short_history_exclusions, trimmed_events, retained_sequences, renumbered_events, loo_split_rows,
        loo_split_summary, catalog_item_index, history_inputs, popularity_logq, train_frequency, untrained_target_fraction, catalog_excluded_items,
        item_eligibility, exclusion_reasons, file_matches, carried_durations, title_completion, title_report, items_without_title, available_interactions,
        item_availability_counts, duplicated_deliveries,
    )
}

LOG = r"""
ids AS (SELECT nullif(regexp_extract(user_id, '^[ \t]*0*([1-9][0-9]*)[ \t]*$', 1), '') AS u,
               nullif(regexp_extract(item_id, '^[ \t]*0*([1-9][0-9]*)[ \t]*$', 1), '') AS i, timestamp AS ts, event_id
        FROM interactions WHERE timestamp > 0),
log AS (SELECT CAST(u AS BIGINT) AS "user", CAST(i AS BIGINT) AS item, ts, event_id FROM ids WHERE u IS NOT NULL AND i IS NOT NULL)"""

RETAINED = f"""{LOG},
ranked AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY "user") AS events FROM log),
kept AS (SELECT "user", item, ts, event_id, back, least(events, 13) - back AS position FROM ranked WHERE back <= 13 AND events >= 5),
split AS (SELECT *, CASE back WHEN 1 THEN 'test' WHEN 2 THEN 'validation' ELSE 'train' END AS phase FROM kept),
indexed AS (SELECT item, row_number() OVER (ORDER BY item) AS item_idx FROM (SELECT DISTINCT item FROM kept))"""

ELIGIBLE = """
judged AS (SELECT item_id, content_id, [x FOR x IN [CASE WHEN source_video_path IS NULL OR trim(source_video_path) = '' THEN 'missing_video' END,
        CASE WHEN source_file_size IS NULL OR source_file_size <= 0 THEN 'empty_video' END,
        CASE WHEN duration_seconds IS NULL OR NOT isfinite(duration_seconds) OR duration_seconds <= 0 THEN 'invalid_duration' END] IF x IS NOT NULL] AS reasons
    FROM item_inventory)"""

TITLES = r"""
first_documents AS (SELECT content_id, arg_min(text, doc_id) AS title FROM documents WHERE source = 'video_title' AND content_id IS NOT NULL AND trim(text) <> '' GROUP BY 1),
completed AS (SELECT i.item_id, i.content_id, nullif(trim(m.title, chr(32) || chr(9) || chr(10) || chr(13)), '') AS a, nullif(trim(d.title, chr(32) || chr(9) || chr(10) || chr(13)), '') AS b
    FROM item_inventory i LEFT JOIN metadata_titles m ON i.item_id = m.item_id LEFT JOIN first_documents d ON i.content_id = d.content_id),
titles AS (SELECT item_id, content_id, coalesce(a, b, '') AS title, CASE WHEN a IS NOT NULL THEN 'primary' WHEN b IS NOT NULL THEN 'supplement' ELSE 'missing' END AS origin FROM completed)"""

ORACLE = {
    "cohort_counts": f"""WITH {LOG} SELECT count(DISTINCT "user") AS users, count(DISTINCT item) AS items, count(*) AS interactions,
        count(*) - count(DISTINCT ("user", item, ts)) AS duplicates FROM log""",
    "log_fingerprint": f"""WITH {LOG}, d AS (SELECT md5(concat_ws(',', "user", item, ts, event_id)) AS h FROM log)
        SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS BIGINT) AS sum_1, CAST(sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)) AS BIGINT) AS sum_2 FROM d""",
    "user_activity": f"""WITH {LOG} SELECT "user", count(*) AS events, count(*) < 5 AS excluded, CASE WHEN count(*) < 5 THEN 0 ELSE greatest(count(*) - 13, 0) END AS trimmed FROM log GROUP BY 1""",
    "short_history_exclusions": f"""WITH {LOG} SELECT "user", count(*) AS events FROM log GROUP BY 1 HAVING count(*) < 15""",
    "trimmed_events": f"""WITH {LOG}, n AS (SELECT "user", count(*) AS events FROM log GROUP BY 1) SELECT count(*) FILTER (events < 5) AS excluded_users,
        CAST(sum(CASE WHEN events < 5 THEN events ELSE 0 END) AS BIGINT) AS short_events, CAST(sum(CASE WHEN events < 5 THEN 0 ELSE greatest(events - 13, 0) END) AS BIGINT) AS trimmed FROM n""",
    "retained_sequences": f"WITH {RETAINED} SELECT * FROM kept",
    "renumbered_events": f"""WITH {RETAINED} SELECT row_number() OVER (ORDER BY event_id) - 1 AS event_id, event_id AS source_event_id, "user", item, ts FROM kept""",
    "loo_split_rows": f"""WITH {RETAINED} SELECT event_id, "user", phase, position FROM split""",
    "loo_split_summary": f"WITH {RETAINED} SELECT phase, count(*) AS raw, count(*) FILTER (position > 0) AS eligible, count(*) FILTER (position = 0) AS no_history FROM split GROUP BY 1",
    "catalog_item_index": f"WITH {RETAINED} SELECT item, item_idx FROM indexed",
    "history_inputs": f"""WITH {RETAINED}, h AS (SELECT "user", event_id, item_idx AS target, list(item_idx) OVER (PARTITION BY "user" ORDER BY position ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS l
        FROM kept JOIN indexed USING (item))
        SELECT "user", event_id, target, array_to_string(list_resize(coalesce(l, []), 10, 0), ',') AS history FROM h""",
    "popularity_logq": f"""WITH {RETAINED}, c AS (SELECT item, count(*) AS n FROM split WHERE phase = 'train' AND position > 0 GROUP BY 1)
        SELECT item, n, round(n / CAST((SELECT sum(n) FROM c) AS DOUBLE), 12) AS q, round(ln(n / CAST((SELECT sum(n) FROM c) AS DOUBLE)), 9) AS log_q FROM c""",
    "train_frequency": f"WITH {RETAINED} SELECT item, count(*) AS frequency FROM split WHERE phase = 'train' GROUP BY 1",
    "untrained_target_fraction": f"""WITH {RETAINED} SELECT count(*) AS tests, round(avg(CASE WHEN item IN (SELECT item FROM split WHERE phase = 'train') THEN 0.0 ELSE 1.0 END), 12) AS untrained
        FROM split WHERE phase = 'test'""",
    "catalog_excluded_items": f"WITH {RETAINED} SELECT item_id FROM item_inventory WHERE item_id NOT IN (SELECT CAST(item AS VARCHAR) FROM kept)",
    "item_eligibility": f"WITH {ELIGIBLE} SELECT item_id, content_id, len(reasons) = 0 AS eligible, array_to_string(reasons, ',') AS reasons FROM judged",
    "exclusion_reasons": f"WITH {ELIGIBLE} SELECT reason, count(*) AS items FROM (SELECT unnest(reasons) AS reason FROM judged) GROUP BY 1",
    "file_matches": r"""WITH f AS (SELECT regexp_extract(source_video_path, '([^/\\]+)\.mp4$', 1) AS item_id, count(*) AS files, min(source_video_path) AS path, min(source_file_size) AS size,
            CAST(min(source_mtime_ns) AS VARCHAR) AS mtime_ns FROM item_inventory WHERE source_video_path IS NOT NULL GROUP BY 1)
        SELECT i.item_id, content_id, path, size, mtime_ns, CASE WHEN files IS NULL THEN 'missing' WHEN files > 1 THEN 'ambiguous' ELSE 'found' END AS status
        FROM item_inventory i LEFT JOIN f ON i.item_id = f.item_id""",
    "carried_durations": """SELECT item_id, content_id, source_video_path, CASE WHEN source_file_size % 3 = 0 THEN source_file_size + 1 ELSE source_file_size END AS source_file_size, CAST(source_mtime_ns AS VARCHAR) AS source_mtime_ns,
        CASE WHEN source_file_size % 3 = 0 THEN NULL ELSE duration_seconds END AS duration_seconds FROM item_inventory""",
    "title_completion": f"WITH {TITLES} SELECT * FROM titles",
    "title_report": f"WITH {TITLES} SELECT origin, count(*) AS items FROM titles GROUP BY 1",
    "items_without_title": r"SELECT item_id FROM item_inventory WHERE item_id NOT IN (SELECT item_id FROM metadata_titles WHERE regexp_matches(title, '\S'))",
    "available_interactions": f"WITH {LOG}, {ELIGIBLE} SELECT item, count(*) AS rows FROM log WHERE item IN (SELECT CAST(item_id AS BIGINT) FROM judged WHERE len(reasons) = 0) GROUP BY 1",
    "item_availability_counts": f"WITH {LOG}, {ELIGIBLE} SELECT item, count(*) AS excluded FROM log WHERE item NOT IN (SELECT CAST(item_id AS BIGINT) FROM judged WHERE len(reasons) = 0) GROUP BY 1",
    "duplicated_deliveries": f"""WITH {LOG} SELECT "user", item, ts, count(*) AS rows FROM log GROUP BY 1, 2, 3 HAVING count(*) > 1""",
}
