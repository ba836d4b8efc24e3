"""Outcomes of generated scenes: tags, admission, pending work, the stored latest row and retry passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinograph.functions import graphtext

#: One tag counts for a scene, the first of these that it has.
TAGS = ("TOKEN_LIMIT", "PARSE_FAILED", "REPEAT_OCCURRED")
USABLE_TAGS = ("REPEAT_OCCURRED",)
OUTCOMES = ("success", "repeat_occurred", "parse_failed", "token_limit", "error")
LIMIT_REASON = r"(?i)length|max_?tokens"


def primary_tag(tags: Column) -> Column:
    """The first tag in the order of TAGS; null for none, null or unknown tags."""
    return F.coalesce(*(F.when(F.array_contains(tags, t), F.lit(t)) for t in TAGS))


def outcome(error: Column, tags: Column) -> Column:
    return F.when(error.isNotNull(), "error").otherwise(F.coalesce(F.lower(primary_tag(tags)), F.lit("success")))


def needs_generation(error: Column, tags: Column) -> Column:
    """Failed, or with a tag that is not usable. A missing row needs generation too, which a left join shows as null."""
    tag = primary_tag(tags)
    return error.isNotNull() | F.coalesce(~tag.isin(*USABLE_TAGS), F.lit(False))


def response_tags(reason: Column, text: Column, warning: Column, parsed: Column) -> Column:
    """Tags of a model's response: cut texts have TOKEN_LIMIT and are never parsed, unreadable ones PARSE_FAILED, and a
    repetition counts only if the text before it could be read."""
    cut = F.coalesce(reason.rlike(LIMIT_REASON), F.lit(False))
    repeated = F.coalesce(F.array_contains(warning, "REPEAT_OCCURRED"), F.lit(False))
    tag = F.when(cut, "TOKEN_LIMIT").when(~F.coalesce(parsed, F.lit(False)), "PARSE_FAILED").when(repeated, "REPEAT_OCCURRED")
    return F.when(tag.isNull() | text.isNull(), F.array().cast("array<string>")).otherwise(F.array(tag))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one that is last in ``order``, which must be unique. Combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return newest.select(*keys, "_r.*")


def admission(scenes: DataFrame) -> DataFrame:
    """``scenes`` with ``rejection``: ``error``, then a blocking tag, then ``raw`` (no structure); null for admitted scenes.

    ``scenes`` has ``error, tags, structured``.
    """
    tag = primary_tag(F.col("tags"))
    blocking = F.when(~tag.isin(*USABLE_TAGS), F.lower(tag))
    reason = F.when(F.col("error").isNotNull(), "error").otherwise(F.coalesce(blocking, F.when(~F.coalesce("structured", F.lit(False)), "raw")))
    return scenes.withColumn("rejection", reason)


def coverage(admitted: DataFrame, *by: str) -> DataFrame:
    """Scenes, admitted scenes, counts of each reason and the admitted share (null without scenes), by some columns."""
    reasons = ("error", "token_limit", "parse_failed", "raw")
    counts = [F.count_if(F.col("rejection") == r).alias(r) for r in reasons]
    grouped = admitted.groupBy(*by).agg(F.count("*").alias("scenes"), F.count_if(F.col("rejection").isNull()).alias("valid"), *counts)
    return grouped.withColumn("coverage", F.try_divide(F.col("valid").cast("double"), F.col("scenes").cast("double")))


def pending(expected: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``expected`` without a stored row, or with one that needs generation (``stored`` has ``error, tags``)."""
    state = stored.select(*keys, needs_generation(F.col("error"), F.col("tags")).alias("_again"))
    return expected.join(state, keys, "left").where(F.coalesce("_again", F.lit(True))).select(*expected.columns)


def outcome_histogram(outcomes: DataFrame, *by: str) -> DataFrame:
    """``total`` and one count for each outcome."""
    return outcomes.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))


def best_pass(results: DataFrame, keys: list[str]) -> DataFrame:
    """Of several passes (``pass, error, tags``) over a key: the first success, else the latest usable one, else the latest."""
    tag = primary_tag(F.col("tags"))
    rank = F.when(F.col("error").isNotNull(), 0).when(tag.isNull(), 3).when(tag.isin(*USABLE_TAGS), 2).otherwise(1)
    order = F.struct(rank, F.when(rank == 3, -F.col("pass")).otherwise(F.col("pass")))
    others = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")


def reclassified(stored: DataFrame) -> DataFrame:
    """``stored`` with ``changed``: rows whose graph could not be read when they were stored are read by the reader of today.

    ``stored`` has ``raw_output, graph, error, tags``. Only rows without an error whose only tag is PARSE_FAILED are read; if that
    succeeds they get the graph and lose the tag. All other rows stay as they are.
    """
    again = F.col("error").isNull() & (F.col("tags") == F.array(F.lit(graphtext.PARSE_FAILED)))
    kept = [c for c in stored.columns if c not in ("graph", "tags", "mode")]
    old = stored.withColumnsRenamed({"graph": "_graph", "mode": "_mode"})
    read = graphtext.with_graphs(old, F.when(again, F.col("raw_output"))).withColumn("changed", F.col("graph").isNotNull())
    new = lambda c: F.when(F.col("changed"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    tags = F.when(F.col("changed"), F.array().cast("array<string>")).otherwise(F.col("tags")).alias("tags")
    by_name = {"graph": new("graph"), "tags": tags} | ({"mode": new("mode")} if "mode" in stored.columns else {})
    return read.select(*(by_name.get(c, F.col(c)) for c in stored.columns if c in kept or c in by_name), "changed")


def generation_passes(requests: DataFrame, generate, penalties: list[float], keys: list[str]) -> DataFrame:
    """Runs ``generate(pending, penalty)``, which returns ``keys, error, tags`` and more, for each penalty in turn.

    A pass gets only the requests without a success so far; ``best_pass`` then decides between the results of a key.
    """
    if not penalties or any(not 1 <= p <= 2 for p in penalties):
        raise ValueError("penalties must be between 1 and 2")
    from kinograph.session import written

    found, left = None, requests
    for number, penalty in enumerate(penalties):
        result = written(generate(left, penalty).withColumn("pass", F.lit(number)), "pass")
        found = result if found is None else found.unionByName(result)
        done = result.where(F.col("error").isNull() & primary_tag(F.col("tags")).isNull())
        left = left.join(done.select(*keys), keys, "left_anti")
    return best_pass(found, keys)


def repeated_line(text: Column) -> Column:
    """0-based number of the first line that an earlier line equals, null if there is none."""
    lines = F.split(text, r"\n")
    places = F.transform(lines, lambda x, k: F.when(F.array_position(lines, x) <= k, k))
    return F.array_min(places)


def drop_repeated_last_line(text: Column) -> Column:
    """The text without its last line, if an earlier line equals it."""
    lines = F.split(text, r"\n")
    before = F.slice(lines, F.lit(1), F.size(lines) - 1)
    return F.when(F.array_contains(before, F.element_at(lines, -1)), F.array_join(before, "\n")).otherwise(text)
