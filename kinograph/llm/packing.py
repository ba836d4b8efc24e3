"""Documents packed into containers of a fixed number of tokens, next to documents of similar words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm.tokens import RANK_FILE, encode, encoding, rank_file, text_bytes
from kinograph.operators.indexing import dense_index
from kinograph.session import map_arrow, written

CAPACITY = 2048
#: Items of one shard of the index, and items next to each other in the order of content that stay in one shard.
SHARD_ITEMS, GROUP_ITEMS = 2048, 256
#: A container with at most this share of its room unused is closed; the items of others are packed again with those of other shards.
CLOSED = 1 / 64
#: A round of packing again is the last if it leaves more than this share of its items in open containers.
PROGRESS = 0.5
#: Documents (those with the smallest hashes) on which the order of content is fitted, about; every document has its place in it.
#: Each leaf of its tree holds so many of them, or fewer.
SAMPLE, LEAF = 8192, 64
#: Dimensions of the random projection of weighted terms, and directions of a leaf whose signs order its documents.
DIMENSIONS, SIGNS = 48, 16
#: Length of projections and directions, which are whole numbers.
SCALE = 1 << 16
#: The usual constants of BM25.
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Corpus:
    """Number of items, their mean length, and in how many items each term is: statistics of the whole corpus."""

    items: int
    mean: float
    frequency: np.ndarray

    @classmethod
    def of(cls, items: list[np.ndarray]) -> Corpus:
        frequency = np.zeros(1 + max((int(x.max()) for x in items if len(x)), default=0), np.int64)
        for x in items:
            frequency[np.unique(x).astype(np.int64)] += 1
        return cls(len(items), float(np.mean([len(x) for x in items])) if items else 0.0, frequency)

    def weight(self, term: np.ndarray, count: np.ndarray, size: np.ndarray) -> np.ndarray:
        """BM25 weight of ``term``, which is ``count`` times in an item of ``size`` terms."""
        return self.idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * size / max(self.mean, 1)))

    @cached_property
    def idf(self) -> np.ndarray:
        return np.log1p((self.items - self.frequency + 0.5) / (self.frequency + 0.5))


def _counted(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different terms of each item with their counts: item, term, count, by item and term, and the sizes of all items."""
    size = np.fromiter(map(len, items), np.int64, len(items))
    tokens = np.concatenate([*items, np.empty(0, np.int64)]).astype(np.int64)
    width = int(tokens.max(initial=0)) + 1
    key, count = np.unique(np.repeat(np.arange(len(items)), size) * width + tokens, return_counts=True)
    return key // width, key % width, count, size


class Shard:
    """An inverted index of the items of one shard, with the BM25 weight of each term in each item; scores come from the
    statistics of the whole ``corpus``, so they do not depend on how it is divided."""

    def __init__(self, items: list[np.ndarray], corpus: Corpus | None = None):
        item, term, count, self.size = _counted(items)
        weight = (corpus or Corpus.of(items)).weight(term, count, self.size[item]).astype(np.float32)
        self.terms, self.term_of_item = np.unique(term, return_inverse=True)
        order = np.argsort(term, kind="stable")
        self.item, self.weight = item[order], weight[order]
        self.begin = np.searchsorted(term[order], np.append(self.terms, np.iinfo(np.int64).max))
        self.item_begin = np.searchsorted(item, np.arange(len(items) + 1))

    def scores(self, item: int) -> np.ndarray:
        """BM25 scores of all items for the terms of one."""
        return self._scores(self.term_of_item[self.item_begin[item] : self.item_begin[item + 1]])

    def _scores(self, terms: np.ndarray) -> np.ndarray:
        first, length = self.begin[terms], self.begin[terms + 1] - self.begin[terms]
        at = np.arange(length.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        return np.bincount(self.item[at], self.weight[at], len(self.size))


def fill(items: list[np.ndarray], capacity: int, corpus: Corpus | None = None) -> list[list[int]]:
    """Containers of one shard, as lists of item numbers.

    The largest unused item is the seed. The index returns the unused items by falling score, and each that fits goes into
    the seed's window, until no unused item fits. Ties go to the earlier item.
    """
    shard = Shard(items, corpus)
    size, unused = shard.size, np.ones(len(items), bool)
    by_size, containers = np.argsort(-size, kind="stable"), []
    for seed in by_size.tolist():
        if not unused[seed]:
            continue
        unused[seed] = False
        room, inside = capacity - size[seed], [seed]
        left = np.flatnonzero(unused & (size <= room))
        if len(left):
            left = left[np.argsort(-shard.scores(seed)[left], kind="stable")]
        while len(left):
            # all leading neighbours that fit together go in at once
            fits = int(np.searchsorted(np.cumsum(size[left]), room, side="right"))
            taken = left[: max(fits, 1)]
            inside += taken.tolist()
            unused[taken] = False
            room -= size[taken].sum()
            left = left[len(taken) :]
            left = left[size[left] <= room]
        containers.append(inside)
    return containers


_ITEM = "doc_id bigint, piece int, first_token bigint, tokens int, ids binary"
_PLACED = _ITEM + ", place bigint, hash bigint"


def _items(ranks, capacity: int):
    """Full containers of large documents (without ``ids``), and the item of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(ranks.value)
        kind = _width(tokenizer.n_vocab)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        for batch in batches:
            rows: list[tuple] = []
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("bytes"), strict=True):
                ids = np.array(encode(tokenizer, value.as_py()), kind)
                whole = (len(ids) - 1) // capacity if len(ids) else 0
                rows += [(doc, k, k * capacity, capacity, None) for k in range(whole)]
                rest = ids[whole * capacity :]
                rows.append((doc, whole, whole * capacity, len(rest), rest.tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "first_token", "tokens", "ids"])

    return run


def _width(terms: int) -> str:
    return "<u2" if terms <= 1 << 16 else "<i4"


def _tokens(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind).astype(np.int64) for x in column.to_pylist()]


def _frequencies(kind: str, terms: int):
    """``term, items``: in how many of the items of a task each term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(terms, np.int64)
        for batch in batches:
            if batch.num_rows:
                found += np.bincount(_counted(_tokens(batch.column("ids"), kind))[1], minlength=terms)
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found[held])], ["term", "items"])

    return run


def _corpus(items: DataFrame, kind: str, terms: int) -> Corpus:
    """Statistics of ``items`` (``tokens, ids``); the driver holds one number for each term of the vocabulary."""
    n, total = items.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    counted = map_arrow(items.select("ids"), _frequencies(kind, terms), "term bigint, items bigint").groupBy("term").agg(F.sum("items").alias("items")).toPandas()
    frequency = np.zeros(terms, np.int64)
    frequency[counted["term"].to_numpy(np.int64)] = counted["items"].to_numpy(np.int64)
    return Corpus(n, total / max(n, 1), frequency)


def projected(items: list[np.ndarray], corpus: Corpus, seed: int = 11) -> np.ndarray:
    """Random projections of the weighted terms of each item, with norm SCALE (or 0, without terms), as whole numbers: sums of
    these are exact, so an item's place does not depend on the batch it comes in."""
    if (len(corpus.frequency), seed) not in _planes:
        _planes[len(corpus.frequency), seed] = np.random.default_rng(seed).standard_normal((len(corpus.frequency), DIMENSIONS)).astype(np.float32)
    item, term, count, size = _counted(items)
    rows = np.zeros((len(items), DIMENSIONS), np.float32)
    filled = np.flatnonzero(size)
    if len(filled):
        weight = corpus.weight(term, count, size[item]).astype(np.float32)
        rows[filled] = np.add.reduceat(_planes[len(corpus.frequency), seed][term] * weight[:, None], np.searchsorted(item, filled))
    return np.rint(rows * (SCALE / np.maximum(np.sqrt((rows * rows).cumsum(axis=1)[:, -1:]), 1e-9))).astype(np.int64)


_planes: dict[tuple[int, int], np.ndarray] = {}


class ContentOrder:
    """A binary tree over projections: each node divides the documents in two groups along their main direction.

    A document's place is its leaf's number and, in the leaf, the signs of its main directions, so documents of similar words
    have places near each other, and copies have the same one. The tree is small: at most two nodes for each of the sample.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.nodes: list[tuple] = []
        self.leaves = 0
        self._grow(points, leaf)

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        centre = points.sum(axis=0) // max(len(points), 1)
        centred = points - centre
        _, spread, axes = np.linalg.svd((centred.T @ centred).astype(np.float64))
        axes = np.rint(axes[:SIGNS] * SCALE).astype(np.int64)
        along = centred @ axes[0]
        if len(points) > leaf and spread[0] > SCALE:
            border = _two_means(along)
            left = along < border
            if left.any() and not left.all():
                self.nodes[at] = (centre, axes[:1], border, self._grow(points[left], leaf), self._grow(points[~left], leaf))
                return at
        self.nodes[at] = (centre, axes, self.leaves)
        self.leaves += 1
        return at

    def places(self, points: np.ndarray) -> np.ndarray:
        result = np.zeros(len(points), np.int64)
        work = [(0, np.arange(len(points)))]
        while work:
            at, some = work.pop()
            centre, axes, *rest = self.nodes[at]
            along = (points[some] - centre) @ axes.T
            if len(rest) == 1:
                code = np.zeros(len(some), np.int64)
                for sign in along.T > 0:
                    code = 2 * code + sign
                result[some] = (rest[0] << SIGNS) + code
            elif len(some):
                left = along[:, 0] < rest[0]
                work += [(rest[1], some[left]), (rest[2], some[~left])]
        return result


def _two_means(values: np.ndarray) -> int:
    """The border between two groups of numbers with the least spread within them."""
    ordered = np.sort(values.astype(np.float64))
    n = np.arange(1, len(ordered))
    sums = np.cumsum(ordered)[:-1]
    between = sums**2 / n + (ordered.sum() - sums) ** 2 / (len(ordered) - n)
    at = int(np.argmax(between))
    return int((ordered[at] + ordered[at + 1]) // 2) + 1


def _placing(shared, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, order = shared.value
        for batch in batches:
            if batch.num_rows:
                place = order.places(projected(_tokens(batch.column("ids"), kind), corpus))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])

    return run


_RESULT = "doc_id bigint, piece int, first_token bigint, tokens int, container string"


def _filling(shared, kind: str, capacity: int, last: bool):
    """Containers of each shard. Of those not closed, the items come out with their ``ids``, unless it is the ``last`` round."""
    columns = ["doc_id", "piece", "first_token", "tokens", "ids", "place", "hash"]

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("n").combine_chunks()
        items = _tokens(rows.column("ids"), kind)
        doc, piece = rows.column("doc_id").to_pylist(), rows.column("piece").to_pylist()
        name, closed = np.empty(len(items), object), np.zeros(len(items), bool)
        for inside in fill(items, capacity, shared.value):
            name[inside] = f"{doc[inside[0]]}:{piece[inside[0]]}"
            closed[inside] = last or sum(len(items[k]) for k in inside) >= capacity * (1 - CLOSED)
        ids = pa.array([None if c else x for c, x in zip(closed, rows.column("ids").to_pylist(), strict=True)], pa.binary())
        kept = rows.select(columns).set_column(columns.index("ids"), "ids", ids)
        return kept.append_column("container", pa.array(name.tolist(), pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                shard = batch.column("shard").to_numpy()
                if held and held[0].column("shard")[0].as_py() != shard[0]:
                    yield from packed(pa.Table.from_batches(held)).to_batches()
                    held = []
                end = int(np.searchsorted(shard, shard[0], side="right"))
                held.append(batch.slice(0, end))
                batch = batch.slice(end)
        if held:
            yield from packed(pa.Table.from_batches(held)).to_batches()

    return run


def _round(items: DataFrame, n: int, shared, kind: str, capacity: int, shard_items: int, last: bool) -> DataFrame:
    """Packs ``items`` in shards made of groups of neighbours in the order of content, taken at even distances from all of it."""
    group = max(1, min(GROUP_ITEMS, shard_items // 8))
    shards = -(-n // shard_items)
    numbered = dense_index(items, ["place", "hash", "doc_id", "piece"], "n").withColumn("shard", F.floor(F.col("n") / group) % shards)
    arranged = numbered.repartition("shard").sortWithinPartitions("shard")
    return written(map_arrow(arranged.select("shard", "n", *(c.split()[0] for c in _PLACED.split(", "))), _filling(shared, kind, capacity, last), f"{_PLACED}, container string"), "packed")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, path: str = RANK_FILE) -> DataFrame:
    """``doc_id, piece, first_token, tokens, container`` of every document, or of every piece of a document with more tokens
    than ``capacity``; the tokens of a container are at most ``capacity``. A container has the name of its seed.

    A document larger than a container is cut into full containers and a rest, which is packed like a document. Documents
    without tokens (null or empty texts) are items of size 0 and go into some container too.

    Document frequencies, number and mean length are those of all documents. Documents are put into an order of content, in
    which similar ones are near each other and copies next to each other, and the inverted index is sharded by it: a shard
    holds groups of GROUP_ITEMS neighbours from even distances of the whole order, so a seed finds its neighbours and items of
    all sizes. The largest unused item of a shard is the seed, and its unused neighbours by BM25 fill its window. Items of
    containers that are not filled are packed again together, in new shards over all of them, as long as that closes most of
    them and until one shard holds them all. The work for an item does not grow with the input.

    Nothing depends on how the input is divided or on the order of its rows. ``doc_id`` should be unique (rows equal in it and
    in their text are interchangeable); null ones are packed too, but containers are then named without it. Further columns
    are ignored. No documents, no rows.
    """
    spark = documents.sparkSession
    ranks = rank_file(spark, path)
    terms = encoding(ranks.value).n_vocab
    kind = _width(terms)
    named = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes("text").alias("bytes"))
    items = written(map_arrow(named, _items(ranks, capacity), _ITEM), "items")
    whole = items.where("ids IS NULL").withColumn("container", F.concat_ws(":", "doc_id", "piece"))
    rest = items.where("ids IS NOT NULL")
    corpus = _corpus(rest, kind, terms)
    shared = spark.sparkContext.broadcast(corpus)
    share = min(1.0, SAMPLE / max(corpus.items, 1))
    sample = rest if share == 1 else rest.where(F.xxhash64("doc_id", "tokens", "ids") <= int((2 * share - 1) * 2**62) * 2)
    points = map_arrow(sample.select("ids"), _projecting(shared, kind), "point array<bigint>").toArrow().column("point")
    points = np.array(points.to_pylist(), np.int64).reshape(-1, DIMENSIONS)
    order = spark.sparkContext.broadcast((corpus, ContentOrder(points[np.lexsort(points.T)])))
    left, n = map_arrow(rest, _placing(order, kind), _ITEM + ", place bigint").withColumn("hash", F.xxhash64("ids")), corpus.items
    columns = [c.split()[0] for c in _RESULT.split(", ")]
    result, last = whole.select(*columns), False
    while n:
        last = last or n <= shard_items
        packed = _round(left, n, shared, kind, capacity, shard_items, last)
        result = result.unionByName(packed.where("ids IS NULL").select(*columns))
        left = packed.where("ids IS NOT NULL").drop("container")
        before, n = n, left.count()
        last = n > PROGRESS * before
    return result


def _projecting(shared, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = projected(_tokens(batch.column("ids"), kind), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(list(points), pa.list_(pa.int64()))], ["point"])

    return run
