"""Identifiers of users, items and contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spaces and tabs around, leading zeros, then a number greater than 0 written in the digits 0-9.
ID_PATTERN = r"^[ \t]*0*([1-9][0-9]*)[ \t]*\z"
#: Identifiers of at most this many digits fit BIGINT.
MAX_DIGITS = 18


def normalize_id(column: Column | str) -> Column:
    """The identifier in normal form as STRING; null for what is no identifier (null, blank, signs, 0, other digits)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.regexp_extract(column.cast("string"), ID_PATTERN, 1), F.lit(""))


def id_code(column: Column | str) -> Column:
    """The identifier as BIGINT, null for what is no identifier.

    An identifier of more than 18 digits does not fit; it is kept, under a negative code of 62 hash bits. For the others a
    number that is written back as the same digits takes the place of a pattern match.
    """
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    digits = F.ltrim(F.trim(text, F.lit(" \t")), F.lit("0"))
    number = digits.try_cast("bigint")
    short = (F.length(digits) <= MAX_DIGITS) & (number > 0) & (number.cast("string") == digits)
    long = (F.length(digits) > MAX_DIGITS) & text.rlike(ID_PATTERN)
    return F.when(short, number).when(long, F.lit(-1) - F.xxhash64(digits).bitwiseAND(F.lit((1 << 62) - 1)))


def content_id(dataset: str, item: Column | str) -> Column:
    """``{dataset}_{item:05d}``; null where the item is no identifier."""
    normal = normalize_id(item)
    width = F.greatest(F.length(normal), F.lit(5))
    return F.when(normal.isNotNull(), F.concat(F.lit(f"{dataset}_"), F.repeat(F.lit("0"), width - F.length(normal)), normal))


def is_safe_content_id(column: Column | str) -> Column:
    """Letters, digits, dot, underscore and hyphen only, and neither ``.`` nor ``..``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.rlike(r"^[A-Za-z0-9._-]+\z") & ~column.isin(".", ".."), F.lit(False))
