import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinograph.sources import lines as L

PAIRS, RATINGS = L.FORMATS["MicroLens-100k_pairs.csv"], L.FORMATS["ratings.dat"]


def plain_cells(text: str) -> list[str] | None:
    """Cells of one line by looking at one character after the other; None for bad quoting."""
    cells, at = [], 0
    while True:
        if text[at : at + 1] == '"':
            cell, at = "", at + 1
            while True:
                if at == len(text):
                    return None
                if text[at] == '"' and text[at + 1 : at + 2] == '"':
                    cell, at = cell + '"', at + 2
                elif text[at] == '"':
                    at += 1
                    break
                else:
                    cell, at = cell + text[at], at + 1
            if at < len(text) and text[at] != ",":
                return None
        else:
            end = text.find(",", at)
            end = len(text) if end < 0 else end
            cell, at = text[at:end], end
        cells.append(cell)
        if at == len(text):
            return cells
        at += 1


def machine_cells(texts: list[str], form: L.Format) -> list[list[str] | None]:
    data = [t.encode() for t in texts]
    line, offset, bad, _ = L.tokenize(data, form.machine)
    out = []
    for k, text in enumerate(data):
        cuts, begin, cells = [int(o) for o in offset[line == k]], 0, []
        for end in [*(c - form.machine.delimiter_bytes + 1 for c in cuts), len(text)]:
            cell = text[begin:end]
            if form is PAIRS and cell[:1] == b'"':
                cell = cell[1:-1].replace(b'""', b'"')
            cells.append(cell.decode("utf-8", "replace"))
            begin = end + form.machine.delimiter_bytes
        out.append(None if bad[k] else cells)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='a",é \n1', max_size=200), min_size=1, max_size=6))
def test_quoted_cells_equal_a_plain_reading(texts):
    assert machine_cells(texts, PAIRS) == [plain_cells(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="a:é1", max_size=200), min_size=1, max_size=6))
def test_double_colon_cells_equal_split(texts):
    assert machine_cells(texts, RATINGS) == [t.split("::") for t in texts]


def test_quotes_and_delimiters_across_chunks():
    for size in (L.CHUNK - 2, L.CHUNK - 1, L.CHUNK, L.CHUNK + 1, 3 * L.CHUNK):
        inner = "x" * size + '","' + "y"
        assert machine_cells([f'"{inner.replace(chr(34), chr(34) * 2)}",1,2', "a,b"], PAIRS) == [[inner, "1", "2"], ["a", "b"]]
        assert machine_cells(["z" * size + "::q"], RATINGS) == [["z" * size, "q"]]
    assert machine_cells(['"' + "a" * 100_000], PAIRS) == [None]


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ("12,7,1577", None), ('"12"," 007\t",1577\r', None), ("", "columns"), (None, "columns"), ("1,2", "columns"), ("1,2,3,4", "columns"), ('"1,2,3', "quoting"), ('1,2,"3"x', "quoting"),
        ('1,"2" ,3', "quoting"), ('1,2"3,4', "item"), ('"1""2",3,4', "user"), ("0,1,2", "user"), ("1,-2,3", "item"), ("1,2,", "timestamp"), ("1,2, 3", "timestamp"), ("1,2,3.0", "timestamp"),
        ("1,2,9223372036854775807", None), ("1,2,9223372036854775808", "timestamp"), ("1,2,0003", None), ("x,,", "user"),
    ],
)
def test_reasons_of_pairs(line, reason):
    assert L.parse([(line or "").encode()], PAIRS)[0][1] == reason


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ("1::2::0.5::3", None), ("1::2::5::3\r", None), ("1::2::5.0::9223372036854775", None), ("1::2::5.0::9223372036854776", "timestamp"), ("1::2::0::3", "rating"), ("1::2::5.5::3", "rating"),
        ("1::2::1.3::3", "rating"), ("1::2::nan::3", "rating"), ("1::2::inf::3", "rating"), ("1::2::4,5::3", "rating"), ("1::2::4::", "timestamp"), ("1:::2::4::3", "item"), ("1::2::3", "columns"),
        ('"1"::2::4::3', "user"), ("::2::4::3", "user"),
    ],
)
def test_reasons_of_ratings(line, reason):
    assert L.parse([line.encode()], RATINGS)[0][1] == reason


def test_tables(spark, rows):
    schema = "line_id long, source_file string, line_no long, line string, reason string"
    data = [(1, "ratings.dat", 1, "1::2::4.5::10", "x"), (2, "ratings.dat", 2, "1::2::9::10", None), (2, "ratings.dat", 2, "1::2::9::10", None), (3, "MicroLens-100k_pairs.csv", 1, None, None), (4, None, 1, "1,2,3", None), (5, "other", 1, "1,2,3", None)]
    valid, rejected = L.load_lines(spark.createDataFrame(data, schema))
    assert rows(valid) == [(1, "ratings.dat", 1, "1", "2", 4.5, 10000)]
    assert rows(rejected, "line_id", "reason") == [(2, "rating"), (2, "rating"), (3, "columns"), (4, "source"), (5, "source")]
    assert L.parse_lines(spark.createDataFrame([], schema)).count() == 0
    assert re.match("line_id bigint", L.SCHEMA)
