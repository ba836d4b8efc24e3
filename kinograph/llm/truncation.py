"""Outputs of text models that stop before their end, whatever cut them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinograph.session import BROADCAST_ROWS, written

#: A length is a storage limit if so many different texts of an arm have it, that many times the mean of the lengths up to
#: NEAR away, and that share of the arm's different texts.
LIMIT_TEXTS, LIMIT_TIMES, LIMIT_SHARE, NEAR = 12, 5, 0.005, 10
#: Characters that one generated token stands for, at least, in text of mostly ASCII characters. A text at a storage limit
#: that has fewer was longer when its tokens were counted.
LEAST_CHARACTERS = 3.45

_SENTENCE_END = r"""(?s)[.!?…。！？](?:["'”’»」』)\]*`\s]|[\p{So}\p{Sk}\x{FE0F}\x{200D}])*\z"""
_ABBREVIATION = r"(?i)\b(?:e\.g|i\.e|cf|vs|approx|fig|mr|mrs|ms|dr)\.\s*\z"
_LIMIT_REASON = r"(?i)length|max_?tokens|token_?limit"
_STOP_REASON = r"(?i)stop|end_?turn|eos"
_ACTION = r"^[^;]*?\S - [^;]*?\S - [^;]+; [^;]+; [^;]+\z"


def _occurrences(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def stored_lengths(text: Column) -> dict[str, Column]:
    """Lengths of a text in the forms in which something may have stored or sent it."""
    characters = F.length(text)
    wide = F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]+", ""))
    other = F.length(F.regexp_replace(text, r"[\x00-\x7F]+", ""))
    quotes, lines, returns = (_occurrences(text, c) for c in ('"', "\n", "\r"))
    escaped = quotes + lines + returns + _occurrences(text, "\t") + _occurrences(text, "\\")
    return {
        "characters": characters,
        "utf8_bytes": F.octet_length(text),
        "utf16_units": characters + wide,
        "html_escaped": characters + 4 * _occurrences(text, "&") + 3 * (_occurrences(text, "<") + _occurrences(text, ">")) + 5 * quotes + 4 * _occurrences(text, "'"),
        "json_escaped": characters + escaped,
        "json_ascii": characters + escaped + 5 * other + 6 * wide,
        "crlf_lines": characters + lines - _occurrences(text, "\r\n") / 2,
    }


def _lengths(text: Column) -> Column:
    return F.struct(*(c.cast("bigint").alias(m) for m, c in stored_lengths(text).items()))


def storage_limits(texts: DataFrame) -> DataFrame:
    """``arm, measure, length, texts`` of the lengths at which too many different texts of an arm end. ``texts``: ``arm, raw_output``."""
    return _limits(texts.select("arm", F.xxhash64("raw_output").alias("hash"), _lengths(F.col("raw_output")).alias("lengths")))


def _limits(measured: DataFrame) -> DataFrame:
    """``storage_limits`` of ``arm, hash, lengths``.

    Copies of a text count once. Each text is measured in every form; per arm and form the lengths are counted (combined before
    the shuffle) and compared with their neighbours, to which every count is sent. No text is shuffled.
    """
    names = measured.schema["lengths"].dataType.names
    different = measured.groupBy("arm", "hash").agg(*(F.max(F.col(f"lengths.{m}")).alias(m) for m in names))
    each = different.select("arm", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in names))).alias("m"))
    counts = each.groupBy("arm", "m.measure", "m.length").agg(F.count("*").alias("texts"))
    offsets = F.array(*(F.lit(d) for d in range(-NEAR, NEAR + 1)))
    sent = counts.select("arm", "measure", "length", "texts", F.explode(offsets).alias("d"))
    own, near = F.sum(F.when(F.col("d") == 0, F.col("texts"))), F.sum(F.when(F.col("d") != 0, F.col("texts")))
    compared = sent.groupBy("arm", "measure", (F.col("length") + F.col("d")).alias("length")).agg(own.alias("texts"), F.coalesce(near, F.lit(0)).alias("near"))
    totals = counts.where("measure = 'characters'").groupBy("arm").agg(F.sum("texts").alias("total"))
    peak = (F.col("texts") >= LIMIT_TEXTS) & (F.col("texts") >= LIMIT_TIMES * F.col("near") / (2 * NEAR)) & (F.col("texts") >= LIMIT_SHARE * F.col("total"))
    return compared.where(F.col("texts") >= LIMIT_TEXTS).join(totals, "arm").where(peak).select("arm", "measure", "length", "texts")


def graph_is_complete(text: Column) -> Column:
    """A line-form graph whose fence is closed and whose last line is a whole action, or ``none``, of its last section.

    An action is whole if its three parts are there and its place is ``unknown``, ``none`` or an entity of the graph.
    """
    fenced = text.rlike(r"^\s*```")
    closed = text.rlike(r"\n```\s*\z")
    body = F.regexp_replace(text, r"^\s*```[^\n]*\n|\n```\s*\z|\s+\z", "")
    lines = F.split(body, r"\r?\n")
    last = F.element_at(lines, -1)
    sections = F.filter(lines, lambda x: x.rlike(r"(?i)^\W*(?:context|entities|actions)\W*\z"))
    in_actions = F.lower(F.coalesce(F.try_element_at(sections, F.lit(-1)), F.lit(""))).contains("actions")
    place = F.trim(F.substring_index(last, "; ", -1))
    names = F.flatten(F.transform(lines, lambda x: F.transform(F.split(F.substring_index(x, ";", 1), ":"), lambda y: F.trim(y))))
    whole = last.rlike(_ACTION) & (place.isin("unknown", "none") | F.array_contains(names, place))
    return (~fenced | closed) & in_actions & (whole | (F.trim(last) == "none"))


def prose_is_complete(text: Column) -> Column:
    """A text whose last sentence has its end mark; closing quotes, brackets and pictographs may follow."""
    fence_open = text.rlike(r"^\s*```") & ~text.rlike(r"```\s*\z")
    bracket_open = text.rlike(r"(?s)\([^()]*\z")
    return text.rlike(_SENTENCE_END) & ~text.rlike(_ABBREVIATION) & ~fence_open & ~bracket_open


def judged_outputs(outputs: DataFrame, arms: DataFrame) -> DataFrame:
    """``output_id, arm, cut, cause, limit_measure``: every output with text, and whether it ends before the model's text was complete.

    ``outputs``: ``output_id, arm, raw_output, tokens, finish_reason, warning``; ``arms``: ``arm, representation, max_new_tokens``.
    Further columns are ignored. Outputs without text (null, empty or blank) are no case and have no row.

    Lengths are recomputed in all stored forms, and lengths at which an arm's texts pile up are taken as hidden limits. Then
    the ending decides, by the kind of text: an ending that is not one is a cut, of the cause ``token_limit`` where the
    model's limit was reached, ``storage_limit`` where the text has a hidden limit's length, else ``transfer``. A complete
    ending is a cut only if the finish reason or warning names the token limit, or the limit was reached and no reason says
    that the model stopped, or if a text at a hidden limit is too short for its tokens. A complete text that merely has as
    many tokens, or a length, as a limit is not cut. An arm that is unknown or null has no token limit; its text is a graph
    if it begins as one. Repeated outputs are each judged.
    """
    arms_known = arms.select("arm", F.col("representation").alias("kind"), F.col("max_new_tokens").alias("most"))
    if arms_known.count() <= BROADCAST_ROWS:
        arms_known = F.broadcast(arms_known)
    named = outputs.select(
        "output_id", F.col("arm").cast("string").alias("arm"), F.col("raw_output").cast("string").alias("raw_output"),
        F.col("tokens").cast("bigint").alias("tokens"), F.coalesce(F.col("finish_reason").cast("string"), F.lit("")).alias("reason"),
        F.coalesce(F.array_contains("warning", "TOKEN_LIMIT"), F.lit(False)).alias("warned"),
    ).where(F.col("raw_output").rlike(r"\S"))
    text = F.col("raw_output")
    graph = F.coalesce(F.col("kind") == "graph", text.rlike(r"^\s*(?:```[^\n]*\n)?\W*(?i:context)\b"))
    complete = F.when(graph, graph_is_complete(text)).otherwise(prose_is_complete(text))
    says_limit = F.col("reason").rlike(_LIMIT_REASON) | F.col("warned")
    says_stop = F.col("reason").rlike(_STOP_REASON) & ~says_limit
    reached = F.coalesce(F.col("tokens") >= F.col("most"), F.lit(False))
    scarce = F.length(text) < LEAST_CHARACTERS * F.col("tokens")
    mostly_ascii = F.length(F.regexp_replace(text, r"[^\x00-\x7F]+", "")) > 0.9 * F.length(text)
    short = F.coalesce(~reached & scarce & mostly_ascii, F.lit(False))
    measured = named.join(arms_known, "arm", "left").select(
        "output_id", F.col("arm").alias("known_arm"), F.coalesce("arm", F.lit("")).alias("arm"), complete.alias("complete"), says_limit.alias("says_limit"),
        (reached & ~says_stop).alias("reached"), short.alias("short"), F.xxhash64("raw_output").alias("hash"), _lengths(text).alias("lengths"),
    )
    measured = written(measured, "measured")  # all that is needed of the texts, which are read once
    limits = written(_limits(measured), "limits")
    by_length = limits.groupBy("arm").agg(F.array_sort(F.collect_list(F.struct("measure", "length"))).alias("limits"))  # at most 1 / LIMIT_SHARE a measure
    if limits.count() <= BROADCAST_ROWS:
        by_length = F.broadcast(by_length)
    lengths = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"lengths.{m}").alias("length")) for m in measured.schema["lengths"].dataType.names))
    hits = F.when(F.col("limits").isNotNull(), F.array_intersect("limits", lengths))
    judged = measured.join(by_length, "arm", "left").withColumn("hits", hits)
    at_limit = F.coalesce(F.size("hits") > 0, F.lit(False))
    cause = (
        F.when(F.col("says_limit") | F.col("reached"), "token_limit")
        .when(at_limit & (~F.col("complete") | F.col("short")), "storage_limit")
        .when(~F.col("complete"), "transfer")
    )
    measure = F.when(F.col("cause") == "storage_limit", F.try_element_at("hits", F.lit(1)).measure)
    judged = judged.withColumn("cause", cause)
    return judged.select("output_id", F.col("known_arm").alias("arm"), F.col("cause").isNotNull().alias("cut"), "cause", measure.alias("limit_measure"))


def cut_shares(judged: DataFrame) -> DataFrame:
    """``arm, outputs, cut, share, token_limit, storage_limit, transfer``: how often each arm's outputs with text are cut."""
    causes = [F.count_if(F.col("cause") == c).alias(c) for c in ("token_limit", "storage_limit", "transfer")]
    counted = judged.groupBy("arm").agg(F.count("*").alias("outputs"), F.count_if("cut").alias("cut"), *causes)
    return counted.select("arm", "outputs", "cut", (F.col("cut") / F.col("outputs")).alias("share"), "token_limit", "storage_limit", "transfer")
