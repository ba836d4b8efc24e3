"""Delimited text lines: typed rows for the valid lines, a reason and an offset for the others.

Cells are found by a finite-state machine over bytes that runs over all lines of an Arrow batch at once. Lines are cut into
chunks of CHUNK bytes; each chunk first gets its transition function (the state it ends in, for every state it may begin
in), the functions of a line's chunks are composed from left to right, and each chunk is then run once more from the state
it really begins in. The work per byte is the same for one line of a gigabyte as for a million short ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinograph.session import map_arrow

CHUNK = 64
_OTHER, _QUOTE, _DELIMITER, _END, _PAD = range(5)


@dataclass(frozen=True)
class Machine:
    """``table[state, class]`` is the next state; ``delimits[state, class]`` says that this byte ends a delimiter."""

    classes: np.ndarray
    table: np.ndarray
    delimits: np.ndarray
    bad: int
    delimiter_bytes: int


def comma_quoted() -> Machine:
    """Cells divided by commas. A cell is quoted if it begins with a quote; in it two quotes stand for one."""
    start, plain, quoted, quote, done, bad = range(6)
    classes = np.full(256, _OTHER, np.uint8)
    classes[ord('"')], classes[ord(",")] = _QUOTE, _DELIMITER
    table = np.array(
        [
            [plain, quoted, start, done, start],
            [plain, plain, start, done, plain],
            [quoted, quote, quoted, bad, quoted],
            [bad, quoted, start, done, quote],
            [done] * 5,
            [bad] * 5,
        ],
        np.uint8,
    )
    delimits = np.zeros(table.shape, bool)
    delimits[[start, plain, quote], _DELIMITER] = True
    return Machine(classes, table, delimits, bad, 1)


def double_colon() -> Machine:
    """Cells divided by ``::``, without quoting; of three colons the first two divide."""
    cell, colon, done, bad = range(4)
    classes = np.full(256, _OTHER, np.uint8)
    classes[ord(":")] = _DELIMITER
    table = np.array([[cell, cell, colon, done, cell], [cell, cell, cell, done, colon], [done] * 5, [bad] * 5], np.uint8)
    delimits = np.zeros(table.shape, bool)
    delimits[colon, _DELIMITER] = True
    return Machine(classes, table, delimits, bad, 2)


@dataclass(frozen=True)
class Format:
    """Fields of one kind of source file, in order; ``unit_ms``: milliseconds in one unit of its timestamps."""

    machine: Machine
    fields: tuple[str, ...]
    unit_ms: int


#: By the name of the source file.
FORMATS = {
    "MicroLens-100k_pairs.csv": Format(comma_quoted(), ("user", "item", "timestamp"), 1),
    "ratings.dat": Format(double_colon(), ("user", "item", "rating", "timestamp"), 1000),
}


def tokenize(lines: list[bytes], machine: Machine) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Delimiters of all lines (``line``, ``offset`` of its last byte, in order) and of each line whether its quoting is
    bad and the offset where that was found (the length of the line if it was its end)."""
    n = len(lines)
    length = np.fromiter(map(len, lines), np.int64, n)
    chunks = length // CHUNK + 1  # one more byte for the end
    first = np.concatenate([[0], np.cumsum(chunks)])
    total = int(first[-1])
    seen = np.full(total * CHUNK, _PAD, np.uint8)
    line_of = np.repeat(np.arange(n), chunks)
    data = machine.classes[np.frombuffer(b"".join(lines), np.uint8)]
    begins = first[:-1] * CHUNK
    shift = begins - np.concatenate([[0], np.cumsum(length)[:-1]])
    seen[np.arange(len(data)) + np.repeat(shift, length)] = data
    seen[begins + length] = _END
    seen = seen.reshape(total, CHUNK)

    begin = np.zeros(total, np.uint8)
    if total > n:
        ends = np.broadcast_to(np.arange(len(machine.table), dtype=np.uint8), (total, len(machine.table)))
        for t in range(CHUNK):
            ends = machine.table[ends, seen[:, t, None]]
        open_lines, at = np.flatnonzero(chunks > 1), 1
        while len(open_lines):
            k = first[open_lines] + at
            begin[k] = ends[k - 1, begin[k - 1]]
            at += 1
            open_lines = open_lines[chunks[open_lines] > at]

    state, delimiter = begin, np.zeros((total, CHUNK), bool)
    bad_chunk = np.full(total, CHUNK, np.int64)
    for t in range(CHUNK):
        delimiter[:, t] = machine.delimits[state, seen[:, t]]
        state = machine.table[state, seen[:, t]]
        bad_chunk[(state == machine.bad) & (bad_chunk == CHUNK)] = t
    chunk, t = np.nonzero(delimiter)
    offset = (chunk - first[line_of[chunk]]) * CHUNK + t
    where = np.full(n, -1, np.int64)
    hit = np.flatnonzero(bad_chunk < CHUNK)[::-1]  # the first chunk of a line is written last
    where[line_of[hit]] = (hit - first[line_of[hit]]) * CHUNK + bad_chunk[hit]
    return line_of[chunk], offset, where >= 0, where


_ID = re.compile(rb"[ \t]*0*([1-9][0-9]*)[ \t]*")
_DIGITS = re.compile(rb"[0-9]+")
_LARGEST = 2**63 - 1


def _user(cell: bytes, unit_ms: int) -> str | None:
    found = _ID.fullmatch(cell)
    return found[1].decode() if found else None


def _rating(cell: bytes, unit_ms: int) -> float | None:
    try:
        value = float(cell)
    except ValueError:
        return None
    return value if math.isfinite(value) and 0.5 <= value <= 5 and value * 2 == int(value * 2) and b"_" not in cell else None


def _timestamp(cell: bytes, unit_ms: int) -> int | None:
    if not _DIGITS.fullmatch(cell):
        return None
    digits = cell.lstrip(b"0")
    value = int(digits or b"0") * unit_ms if len(digits) <= 19 else _LARGEST + 1
    return value if value <= _LARGEST else None


_PARSERS = {"user": _user, "item": _user, "rating": _rating, "timestamp": _timestamp}


def parse(lines: list[bytes], form: Format) -> list[tuple[dict, str | None, int | None]]:
    """Of each line: the parsed fields, or the first reason that it fails and the byte offset of the failing cell."""
    lines = [x[:-1] if x.endswith(b"\r") else x for x in lines]
    line, offset, bad, where = tokenize(lines, form.machine)
    bounds = np.searchsorted(line, np.arange(len(lines) + 1)).tolist()
    offsets, width, out = offset.tolist(), form.machine.delimiter_bytes, []
    for k, text in enumerate(lines):
        if bad[k]:
            out.append(({}, "quoting", int(where[k])))
            continue
        cuts = offsets[bounds[k] : bounds[k + 1]]
        if not text or len(cuts) + 1 != len(form.fields):
            out.append(({}, "columns", cuts[len(form.fields) - 1] if len(cuts) >= len(form.fields) else len(text)))
            continue
        values, begin = {}, 0
        for name, end in zip(form.fields, [*(c - width + 1 for c in cuts), len(text)], strict=True):
            cell = text[begin:end]
            if width == 1 and cell[:1] == b'"':
                cell = cell[1:-1].replace(b'""', b'"')
            values[name] = _PARSERS[name](cell, form.unit_ms)
            if values[name] is None:
                out.append(({}, name, begin))
                break
            begin = end + width
        else:
            out.append((values, None, None))
    return out


SCHEMA = "line_id bigint, source_file string, line_no bigint, user_id string, item_id string, rating double, timestamp bigint, reason string, error_offset bigint"
_ARROW = pa.schema(
    [("line_id", pa.int64()), ("source_file", pa.string()), ("line_no", pa.int64()), ("user_id", pa.string()), ("item_id", pa.string()), ("rating", pa.float64()), ("timestamp", pa.int64()), ("reason", pa.string()), ("error_offset", pa.int64())]
)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sources, numbers = (batch.column(c).to_pylist() for c in ("line_id", "source_file", "line_no"))
        texts = batch.column("line").to_pylist()
        parsed: list = [({}, "source", 0)] * len(ids)
        for name, form in FORMATS.items():
            own = [k for k, s in enumerate(sources) if s == name]
            for k, result in zip(own, parse([texts[k] or b"" for k in own], form), strict=True):
                parsed[k] = result
        columns = [ids, sources, numbers, *([v.get(f) for v, _, _ in parsed] for f in ("user", "item", "rating", "timestamp")), [r for _, r, _ in parsed], [o for _, _, o in parsed]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def parse_lines(lines: DataFrame) -> DataFrame:
    """One row per line: ``user_id, item_id, rating, timestamp`` (ms) if it is valid, else ``reason, error_offset``.

    ``lines``: ``line_id, source_file, line_no, line``, in any order, further columns ignored. Reasons, first that applies:
    ``source`` (no known source file), ``quoting``, ``columns``, ``user``, ``item``, ``rating``, ``timestamp``. A null or
    empty line has too few columns. One trailing CR is dropped. Repeated lines are each reported. The rating is null for
    sources without one. There is no shuffle.
    """
    named = lines.selectExpr("CAST(line_id AS BIGINT) line_id", "CAST(source_file AS STRING) source_file", "CAST(line_no AS BIGINT) line_no", "CAST(line AS BINARY) line")
    return map_arrow(named, _parse_batches, SCHEMA)


def valid_rows(parsed: DataFrame) -> DataFrame:
    """The typed rows of the lines that could be loaded."""
    return parsed.where("reason IS NULL").drop("reason", "error_offset")


def rejected_lines(parsed: DataFrame) -> DataFrame:
    """``line_id, source_file, line_no, reason, error_offset`` of the lines that could not be loaded."""
    return parsed.where("reason IS NOT NULL").select("line_id", "source_file", "line_no", "reason", "error_offset")


def load_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejected lines."""
    parsed = parse_lines(lines)
    return valid_rows(parsed), rejected_lines(parsed)
