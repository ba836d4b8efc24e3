"""Encoding of texts by a public byte-level tokenizer, and decoding to the same bytes."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.session import map_arrow

#: Rank file of the tokenizer; it is read on the driver and sent to the workers (its size, under 1 MB, is fixed).
RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text into the parts within which bytes are merged (fixed by the tokenizer).
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text that are encoded at once.
LONG_TEXT = 1 << 16
#: Ids that are put into one batch of results.
BATCH_IDS = 1 << 21

#: Between something else than white space and a space or line end, every part ends, whatever stands around.
_SAFE = re.compile(r"\S(?=[ \n])")
_encodings: dict[int, object] = {}


def rank_file(spark: SparkSession, path: str = RANK_FILE) -> Broadcast:
    """The file's bytes, broadcast."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def encoding(ranks: bytes):
    """The tokenizer of a rank file; made once in each Python worker."""
    import tiktoken

    key = hash(ranks)
    if key not in _encodings:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def pieces(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """Parts of a long text that can be encoded one by one: they end at the first safe boundary after ``size`` characters."""
    begin = 0
    while len(text) - begin > size and (found := _SAFE.search(text, begin + size)):
        yield text[begin : found.end()]
        begin = found.end()
    yield text[begin:] if begin else text


def encode(tokenizer, text: bytes | None) -> list[int]:
    """Ids of a text without special tokens; no ids for null and empty texts. Bytes that are not UTF-8 count as U+FFFD."""
    if not text:
        return []
    decoded = text.decode("utf-8", "replace")
    if len(decoded) <= LONG_TEXT:
        return tokenizer.encode_ordinary(decoded)
    return [i for part in pieces(decoded) for i in tokenizer.encode_ordinary(part)]


def text_bytes(column: str) -> Column:
    return F.col(column).cast("binary")


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = RANK_FILE) -> DataFrame:
    """``key, ids``: one row per row of ``documents`` with the ids of its whole text.

    Null and empty texts have an empty list, never null. Repeated texts and keys each keep their row; other columns are
    ignored, whatever their names. There is no shuffle; texts of more than LONG_TEXT characters are encoded part by part.
    """
    ranks = rank_file(documents.sparkSession, path)
    named = documents.select(F.col(key).alias("key"), text_bytes(text).alias("bytes"))
    key_type = named.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(ranks.value)
        for batch in batches:
            ids, lengths, begin = array("i"), [], 0
            for k, value in enumerate(batch.column("bytes")):
                found = encode(tokenizer, value.as_py())
                ids.extend(found)
                lengths.append(len(found))
                if len(ids) >= BATCH_IDS or k + 1 == batch.num_rows:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                    values = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(ids, np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column("key").slice(begin, len(lengths)), values], ["key", "ids"])
                    ids, lengths, begin = array("i"), [], k + 1

    encoded = map_arrow(named, run, f"key {key_type}, ids array<int>")
    return encoded.withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = RANK_FILE) -> DataFrame:
    """``key, bytes``: the bytes that the ids stand for, which need not be whole characters; null for null ids."""
    ranks = rank_file(encoded.sparkSession, path)
    named = encoded.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    key_type = named.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(ranks.value)
        for batch in batches:
            texts = [None if x is None else tokenizer.decode_bytes(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.binary())], ["key", "bytes"])

    return map_arrow(named, run, f"key {key_type}, bytes binary").withColumnRenamed("key", key)


def not_restored(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = RANK_FILE) -> DataFrame:
    """``key`` of the documents whose ids do not decode to the bytes of their text (none, if the text is UTF-8)."""
    decoded = decode_ids(encode_texts(documents, key, text, path), key, "ids", path)
    original = documents.select(key, F.coalesce(text_bytes(text), F.lit(b"")).alias("original"))
    return original.join(decoded, key).where("original <> bytes").select(key)
