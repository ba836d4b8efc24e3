"""Sources: delimited interaction files, titles, ratings, id maps, JSON lines, media folders, stored scenes and bundles.

Readers of whole files number nothing by position unless said so; checks are aggregates over the read table.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.functions.ids import normalize_id
from kinograph.operators.indexing import dense_index
from kinograph.sources.lines import parse_lines, rejected_lines, valid_rows


class SourceError(ValueError):
    """A source does not have the form that its reader requires."""


def _require(problem: DataFrame, message: str) -> None:
    found = problem.limit(3).collect()
    if found:
        raise SourceError(f"{message}: {[tuple(r) for r in found]}")


def read_text_lines(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """``line_id, source_file, line_no, line`` of text files, without a header line, which must be first if it is given.

    A line's number counts the lines of its file from 1; order within a file is kept by reading it in its own order.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    cleaned = read.withColumn("line", F.regexp_replace("line", "^﻿", ""))
    numbered = dense_index(cleaned, ["source_file", "block", "at"], "line_id")
    first = numbered.groupBy("source_file").agg(F.min("line_id").alias("first"), F.min_by("line", "line_id").alias("head"))
    if first.isEmpty():
        raise SourceError(f"no lines in {path}")
    skip = 0
    if header is not None:
        _require(first.where(F.rtrim("head") != header).select("source_file", "head"), f"header must be {header}")
        skip = 1
    joined = numbered.join(F.broadcast(first), "source_file")  # a row a file
    rows = joined.withColumn("line_no", F.col("line_id") - F.col("first") + 1 - skip).where(F.col("line_no") > 0)
    return rows.select("line_id", "source_file", "line_no", "line")


def read_interactions(spark: SparkSession, path: str, name: str = "MicroLens-100k_pairs.csv") -> tuple[DataFrame, DataFrame]:
    """``event_id, user_id, item_id, timestamp`` of an interaction file with the header ``user,item,timestamp``, and its rejected
    lines. ``event_id`` counts the valid rows from 0 in the order of the file; repeated rows are kept."""
    parsed = parse_lines(read_text_lines(spark, path, "user,item,timestamp").withColumn("source_file", F.lit(name)))
    events = dense_index(valid_rows(parsed), ["line_id"], "event_id")
    return events.select("event_id", "user_id", "item_id", "timestamp"), rejected_lines(parsed)


def read_ratings(spark: SparkSession, path: str, movies: DataFrame | None = None, name: str = "ratings.dat") -> tuple[DataFrame, DataFrame]:
    """``line_id, user_id, item_id, timestamp`` (ms) of a file of ``user::movie::rating::seconds``, and its rejected lines.

    Ratings are checked and dropped. With ``movies`` (``item_id``) only their ratings are kept.
    """
    parsed = parse_lines(read_text_lines(spark, path).withColumn("source_file", F.lit(name)))
    rows = valid_rows(parsed).select("line_id", "user_id", "item_id", "timestamp")
    return (rows if movies is None else rows.join(movies.select("item_id"), "item_id", "left_semi")), rejected_lines(parsed)


def read_titles(spark: SparkSession, path: str, header: bool = False, quoted: bool = False) -> DataFrame:
    """``item_id, title`` of a file of ``id,title``, cut at the first comma. A header ``item,title`` may come first, and titles
    may be quoted, if so said. An item twice, a line without a comma or a malformed id are errors; blank titles stay."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿|\r$", "").alias("line")).where("line <> ''")
    if header:
        lines = lines.where("line <> 'item,title'")
    parts = F.split("line", ",", 2)
    title = F.btrim(F.try_element_at(parts, F.lit(2)), F.lit(" \t"))
    if quoted:
        inner = F.replace(F.substring(title, F.lit(2), F.length(title) - 2), F.lit('""'), F.lit('"'))
        title = F.when(title.rlike('^"(?:[^"]|"")*"$'), inner).otherwise(title)
    rows = lines.select("line", normalize_id(parts[0]).alias("item_id"), title.alias("title"))
    if rows.isEmpty():
        raise SourceError(f"no titles in {path}")
    _require(rows.where("item_id IS NULL OR title IS NULL").select("line"), "lines must be id,title")
    if quoted:
        _require(rows.where(F.col("title").startswith('"')).select("line"), "titles with broken quotes")
    _require(rows.groupBy("item_id").count().where("count > 1"), "items with more than one title")
    return rows.select("item_id", "title")


def read_movies(spark: SparkSession, path: str) -> DataFrame:
    """``item_id, title`` of a file of ``id::title::genres``."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r+$", "").alias("line"))
    parts = F.split("line", "::")
    rows = lines.select("line", F.size(parts).alias("n"), normalize_id(parts[0]).alias("item_id"), F.trim(F.try_element_at(parts, F.lit(2))).alias("title"))
    _require(rows.where("n <> 3 OR item_id IS NULL").select("line"), "lines must be id::title::genres")
    _require(rows.groupBy("item_id").count().where("count > 1"), "movies given twice")
    return rows.select("item_id", "title")


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """``new_id, item_id`` of a tab-separated file with the header ``newID, oldID``; new ids are 0, 1, ... without gaps."""
    read = spark.read.csv(path, sep="\t", header=True, encoding="UTF-8")
    if [c.lstrip("﻿") for c in read.columns] != ["newID", "oldID"]:
        raise SourceError("header must be newID and oldID")
    read = read.toDF("new", "old")
    rows = read.select("new", "old", F.when(F.col("new").rlike(r"^[0-9]+$"), F.col("new").cast("bigint")).alias("new_id"), normalize_id("old").alias("item_id"))
    _require(rows.where("new_id IS NULL OR item_id IS NULL").select("new", "old"), "malformed row")
    counted = rows.agg(F.count("*").alias("n"), F.count_distinct("new_id").alias("new"), F.count_distinct("item_id").alias("old"), F.max("new_id").alias("top")).first()
    if not counted.n or not counted.n == counted.new == counted.old == counted.top + 1:
        raise SourceError("ids must be unique, and new ids contiguous from 0")
    return rows.select("new_id", "item_id")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects, one a line, of a given schema; blank lines are skipped, anything else that is no object is an error."""
    texts = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    _require(texts.where(~F.col("value").rlike(r"(?s)^\s*\{.*\}\s*$")).select("value"), "lines must be objects")
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_json(path: str | Path) -> dict:
    """One object of a file; anything else is an error."""
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise SourceError(f"{path} must hold an object")
    return value


def list_media(spark: SparkSession, folder: str, pattern: str = "*.mp4") -> DataFrame:
    """``item_id, path, size, mtime_ns`` of media files, named by their item; contents are not read. Other names have a null id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime", "length")
    stem = F.regexp_extract("path", r"([^/\\]+)\.[^.]+$", 1)
    return files.select(normalize_id(stem).alias("item_id"), "path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


SCENE_SCHEMA = "content_id string, scene_idx int, tokens int, warning array<string>, scene_graph string, description string, error string, raw_output string"


def read_scenes(spark: SparkSession, folder: str, failures: bool = False) -> DataFrame:
    """Stored scene rows of one JSON-lines file per content. A content must be named as its file, a scene stored once."""
    rows = spark.read.schema(SCENE_SCHEMA).json(folder, mode="FAILFAST").withColumn("_file", F.regexp_extract("_metadata.file_name", r"^(.*)\.jsonl$", 1))
    _require(rows.where("content_id IS NULL OR scene_idx IS NULL OR scene_idx < 0 OR content_id <> _file").select("_file", "content_id", "scene_idx"), "content or scene does not fit its file")
    _require(rows.groupBy("content_id", "scene_idx").count().where("count > 1"), "scenes stored twice")
    rows = rows.drop("_file")
    return rows if failures else rows.where("error IS NULL")


def read_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    """``content_id, scene_idx, timestamp`` of sampled keyframes, each once, from one JSON file of windows per content."""
    schema = "scene_start double, scene_end double, keyframe_timestamps array<double>"
    windows = spark.read.schema(schema)
    read = windows.json(folder, multiLine=True).withColumn("content_id", F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1))
    numbered = read.select("content_id", F.round(F.col("scene_start") / 30).cast("int").alias("scene_idx"), F.explode(F.array_distinct("keyframe_timestamps")).alias("timestamp"))
    return numbered.distinct()
