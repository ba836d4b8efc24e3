"""The most similar vectors of every vector, by descent through neighbours of neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinograph.session import discard, map_arrow, written

DIMENSIONS = 64
#: Neighbours that each vector keeps while the graph is built, and reverse neighbours that take part in a step. The graph is an
#: approximation by design; recall of the ten nearest is measured in tests and named in the README.
DEGREE = 40
#: Vectors that are compared with each other at the start: neighbours in the order of random projections, in blocks, TABLES times.
TABLES, BLOCK, CODE_BITS = 6, 256, 7
#: The descent ends when a step changes less than this share of the graph, or after so many steps.
LEAST_CHANGE, MOST_STEPS = 0.02, 8
#: Vectors whose lists are worked on together; each other vector is sent once to every such group that needs it.
GROUP = 8192
#: Pairs that are found before a worker hands out lists of them.
HELD_PAIRS = 400_000
#: Lists that are merged at once.
MERGED_ROWS = 8_000

_UNIT = pa.schema([("id", pa.int64()), ("unit", pa.binary())])


def _unit_batches(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vec")
            right = np.flatnonzero(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(vectors), -1)) == dimensions)
            taken = vectors.take(pa.array(right))
            values = taken.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
            largest = np.abs(values).max(axis=1, initial=0)
            usable = np.isfinite(largest) & (largest > 0)
            values = values[usable] / largest[usable, None]
            unit = (values / np.linalg.norm(values, axis=1, keepdims=True)).astype(np.float32)
            unit += np.float32(0)  # no negative zeros
            ids = batch.column("id").take(pa.array(right[usable]))
            yield pa.RecordBatch.from_arrays([ids, pa.array([u.tobytes() for u in unit], pa.binary())], schema=_UNIT)

    return run


def unit_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "vec", dimensions: int = DIMENSIONS) -> DataFrame:
    """``id, unit``: the usable vectors (``dimensions`` finite components, not all zero) with norm 1, as float32 bytes."""
    named = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where("id IS NOT NULL")
    return map_arrow(named, _unit_batches(dimensions), "id bigint, unit binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def _half(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).astype(np.float32).reshape(len(column), -1)


#: An entry of a list. Lists travel as the bytes of their entries, which Spark passes on without looking into them.
_ENTRY = np.dtype([("other", "<i8"), ("similarity", "<f4"), ("fresh", "?")])
_LISTS = "id bigint, entries binary"


def _pack(owner: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
    """``id, entries``: one row for each run of equal owners."""
    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    offsets = (np.append(begins, len(owner)) * _ENTRY.itemsize).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entries.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(owner[begins]), data], ["id", "entries"])


def _unpack(ids: pa.ChunkedArray | pa.Array, packed: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The owner of each entry, the entries, and the entries' number for each row."""
    packed = packed.combine_chunks() if isinstance(packed, pa.ChunkedArray) else packed
    lengths = np.asarray(pa.compute.binary_length(packed)).astype(np.int64) // _ENTRY.itemsize
    data = np.frombuffer(b"".join(packed.to_pylist()), _ENTRY)
    return np.repeat(ids.to_numpy(), lengths), data, lengths


def _entries(other: np.ndarray, similarity: np.ndarray, fresh: np.ndarray | bool) -> np.ndarray:
    entries = np.empty(len(other), _ENTRY)
    entries["other"], entries["similarity"], entries["fresh"] = other, similarity, fresh
    return entries


def _lists(owner: np.ndarray, entries: np.ndarray, most: int) -> pa.RecordBatch:
    """Of each owner the most similar others, each once; of equal ones, all must be fresh."""
    order = np.lexsort((entries["fresh"], entries["other"], owner))
    owner, entries = owner[order], entries[order]
    other = entries["other"]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, entries = owner[first], entries[first]
    kept = _best(owner, entries["other"], entries["similarity"], most)
    return _pack(owner[kept], entries[kept])


def _best(owner: np.ndarray, other: np.ndarray, similarity: np.ndarray, most: int) -> np.ndarray:
    """Places of the most similar entries of each owner, by owner and falling similarity."""
    order = np.lexsort((other, -similarity, owner))
    ordered = owner[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(owner) else np.empty(0, np.int64)
    lengths = np.diff(np.append(begins, len(owner)))
    return order[np.arange(len(owner)) - np.repeat(begins, lengths) < most]


def _coded(tables: int, dimensions: int, seed: int):
    """For each table a code of signs of random projections and one more projection to sort by."""
    planes = np.random.default_rng(seed).standard_normal((tables, dimensions, CODE_BITS + 1)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column("unit"))
            for t in range(tables):
                projected = unit @ planes[t]
                code = (projected[:, :CODE_BITS] > 0) @ (1 << np.arange(CODE_BITS))
                place = t * 2**CODE_BITS + code + 1 / (1 + np.exp(-4 * projected[:, CODE_BITS].astype(np.float64)))
                half = [u.tobytes() for u in unit.astype(np.float16)]
                yield pa.RecordBatch.from_arrays([pa.array(place), batch.column("id"), pa.array(half, pa.binary())], ["place", "id", "half"])

    return run


def _first_lists(block: int, degree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(ids: np.ndarray, unit: np.ndarray) -> pa.RecordBatch:
            similarity = unit @ unit.T
            np.fill_diagonal(similarity, -2)
            most = min(degree, len(ids) - 1)
            best = np.argpartition(-similarity, max(most - 1, 0), axis=1)[:, :most]
            return _lists(np.repeat(ids, most), _entries(ids[best].ravel(), np.take_along_axis(similarity, best, 1).ravel(), True), degree)

        ids, unit, table = np.empty(0, np.int64), np.empty((0, 1), np.float32), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            more = _half(batch.column("half"))
            ids = np.concatenate([ids, batch.column("id").to_numpy()])
            unit = np.concatenate([unit, more]) if len(unit) else more
            table = np.concatenate([table, (batch.column("place").to_numpy() // 2**CODE_BITS).astype(np.int64)])
            while len(ids) >= block:
                end = min(block, int(np.searchsorted(table, table[0], side="right")))
                if end == len(ids) and end < block:
                    break
                yield compared(ids[:end], unit[:end])
                ids, unit, table = ids[end:], unit[end:], table[end:]
        while len(ids):
            end = min(block, int(np.searchsorted(table, table[0], side="right")))
            yield compared(ids[:end], unit[:end])
            ids, unit, table = ids[end:], unit[end:], table[end:]

    return run


_GRAPH = "id bigint, entries binary, others array<bigint>, changed int, least float"


def _merge_lists(degree: int):
    """Lists of the same id, which arrive together, become one. ``changed`` counts its fresh entries; ``least`` is the similarity
    that a further neighbour must exceed."""

    def merged(table: pa.Table) -> pa.RecordBatch:
        owner, entries, _ = _unpack(table.column("id"), table.column("entries"))
        result = _lists(owner, entries, degree)
        owner, entries, lengths = _unpack(result.column("id"), result.column("entries"))
        ends = np.cumsum(lengths)
        others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.ascontiguousarray(entries["other"])))
        changed = np.add.reduceat(entries["fresh"].astype(np.int32), ends - lengths) if len(ends) else np.empty(0, np.int32)
        least = np.where(lengths >= degree, entries["similarity"][ends - 1], -2.0).astype(np.float32)
        return pa.RecordBatch.from_arrays([*result.columns, others, pa.array(changed.astype(np.int32)), pa.array(least)], ["id", "entries", "others", "changed", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            ids = batch.column("id")
            if rows >= MERGED_ROWS and held[0].column("id")[0] != ids[-1]:
                table = pa.Table.from_batches(held)
                end = int(np.searchsorted(table.column("id").to_numpy(), ids[-1].as_py()))
                yield merged(table.slice(0, end))
                held = table.slice(end).to_batches()
                rows = sum(b.num_rows for b in held)
        if held:
            yield merged(pa.Table.from_batches(held))

    return run


def _merged(lists: DataFrame, degree: int) -> DataFrame:
    arranged = lists.repartition("id").sortWithinPartitions("id")
    return map_arrow(arranged, _merge_lists(degree), _GRAPH)


def _reverse_lists(graph: DataFrame, degree: int) -> DataFrame:
    """``id, entries, others``: of the vectors in whose lists a vector is, the ``degree`` most similar. Lists are cut in each batch
    and again when they meet, so a vector that is in very many lists is not gathered with all of them."""
    return _merged(map_arrow(graph.select("id", "entries"), _reversed(degree), _LISTS), degree).select("id", "entries", "others")


def _aged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists with no entry fresh."""
    for batch in batches:
        if batch.num_rows:
            owner, entries, _ = _unpack(batch.column("id"), batch.column("entries"))
            aged = entries.copy()
            aged["fresh"] = False
            yield _pack(owner, aged)


def _step(degree: int):
    """Compares all neighbours of each vector of a group with each other, where one of the two is fresh.

    Gives to each neighbour those that are more similar to it than the last of its list."""

    def joined(ids: np.ndarray, unit: np.ndarray, least: np.ndarray, owner: np.ndarray, other: np.ndarray, fresh: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.searchsorted(ids, other)
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
        lefts, rights, values, held = [], [], [], 0
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            new = fresh[begin:end]
            if not new.any():
                continue
            members = at[begin:end]
            vectors = unit[members]
            new_at = np.flatnonzero(new)
            similarity = vectors[new_at] @ vectors.T
            similarity[np.arange(len(new_at)), new_at] = -2
            bound = least[members]
            left, right = np.nonzero(similarity > np.minimum(bound[new_at][:, None], bound[None, :]))
            value = similarity[left, right]
            a, b = members[new_at[left]].astype(np.int32), members[right].astype(np.int32)
            forth, back = value > least[a], value > least[b]
            lefts += [a[forth], b[back]]
            rights += [b[forth], a[back]]
            values += [value[forth], value[back]]
            held += len(a)
            if held >= HELD_PAIRS:
                yield _lists(ids[np.concatenate(lefts)], _entries(ids[np.concatenate(rights)], np.concatenate(values), True), degree)
                lefts, rights, values, held = [], [], [], 0
        if lefts:
            yield _lists(ids[np.concatenate(lefts)], _entries(ids[np.concatenate(rights)], np.concatenate(values), True), degree)

    return _by_group(joined, degree)


def _reversed(degree: int):
    """Lists of the vectors in whose lists a vector is; of those in one batch, the most similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                owner, entries, _ = _unpack(batch.column("id"), batch.column("entries"))
                turned = entries.copy()
                turned["other"] = owner
                yield _lists(entries["other"], turned, degree)

    return run


def _by_group(function: Callable[..., Iterator[pa.RecordBatch]], degree: int):
    """A group's vectors and its edges, one for each list entry and at most ``degree`` reverse ones for each owner, given to ``function``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=_GROUP_SCHEMA)
        if not table.num_rows:
            return
        is_list = table.column("entries").is_valid()
        vectors, lists = table.filter(pa.compute.invert(is_list)), table.filter(is_list)
        ids = vectors.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        raw = vectors.column("bytes").to_pylist()
        width = np.float16 if raw and len(raw[0]) == 2 * DIMENSIONS else np.float32
        unit = np.frombuffer(b"".join(raw), width).astype(np.float32).reshape(len(raw), DIMENSIONS)[order]
        ids, least = ids[order], vectors.column("least").to_numpy()[order]
        owner, entries, lengths = _unpack(lists.column("id"), lists.column("entries"))
        forth = np.repeat(lists.column("forth").to_numpy(zero_copy_only=False).astype(bool), lengths)
        del raw, vectors, table, lists
        back = np.flatnonzero(~forth)
        kept = np.concatenate([np.flatnonzero(forth), back[_best(owner[back], entries["other"][back], entries["similarity"][back], degree)]])
        owner, other, fresh = owner[kept], entries["other"][kept], entries["fresh"][kept]
        order = np.lexsort((~fresh, other, owner))
        owner, other, fresh = owner[order], other[order], fresh[order]
        first = np.concatenate([[True], (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])]) if len(owner) else np.empty(0, bool)
        yield from function(ids, unit, least, owner[first], other[first], fresh[first])

    return run


_GROUP_SCHEMA = pa.schema([("group", pa.int64()), ("id", pa.int64()), ("entries", pa.binary()), ("forth", pa.bool_()), ("bytes", pa.binary()), ("least", pa.float32())])


def _grouped(lists: DataFrame, needed: DataFrame, vectors: DataFrame, groups: int, function, schema: str) -> DataFrame:
    """Runs ``function`` on every group of owners, a task for each: the group's lists (``id, entries, forth``) and, once each, the
    vectors (``id, bytes, least``) that are ``needed`` (``owner, id``) for them."""
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).alias("group")
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    wanted = needed.select(group("owner"), "id").distinct()
    sent = wanted.join(vectors, "id").select("group", "id", null("entries", "binary"), null("forth", "boolean"), "bytes", "least")
    rows = lists.select(group("id"), "id", "entries", "forth", null("bytes", "binary"), null("least", "float"))
    arranged = sent.unionByName(rows).repartitionById(groups, F.col("group").cast("int"))
    return map_arrow(arranged, function, schema)


def neighbour_graph(
    units: DataFrame, n: int, degree: int = DEGREE, tables: int = TABLES, block: int = BLOCK, most_steps: int = MOST_STEPS, least_change: float = LEAST_CHANGE, seed: int = 7
) -> DataFrame:
    """``id, others, entries``: the ``degree`` nearest found of each of the ``n`` vectors in ``units`` (``id, unit``), nearest first;
    ``entries`` has them with similarities, packed.

    The first lists come from blocks of vectors that lie next to each other in the order of random projections; range
    partitioning keeps the blocks even, however dense a region is. Each step then joins lists, reverse lists and vectors,
    compares neighbours of the same vector, and merges what is nearer than the last neighbour known. Vectors travel at half
    precision. Every step is written to the shared folder, so lost executors repeat one step at most.
    """
    if n < 2:
        return map_arrow(units.limit(0), lambda batches: iter(()), _GRAPH).select("id", "others", "entries")
    degree = min(degree, n - 1)
    groups = max(12, -(-n // GROUP))
    coded = map_arrow(units, _coded(tables, DIMENSIONS, seed), "place double, id bigint, half binary")
    parts = max(min(12, n * tables // (4 * block)), -(-n * tables // 65536))  # of several blocks each, however few vectors there are
    arranged = coded.repartitionByRange(parts, "place").sortWithinPartitions("place")
    first = map_arrow(arranged, _first_lists(block, degree), _LISTS)
    halves = written(map_arrow(units, lambda batches: (pa.RecordBatch.from_arrays([b.column("id"), pa.array([u.tobytes() for u in _matrix(b.column("unit")).astype(np.float16)], pa.binary())], ["id", "bytes"]) for b in batches if b.num_rows), "id bigint, bytes binary"), "halves")
    graph = written(_merged(first, degree), "graph")
    for _ in range(most_steps):
        changed = graph.agg(F.sum("changed")).first()[0] or 0
        if changed < least_change * n * degree:
            break
        vectors = halves.join(graph.select("id", "least"), "id")
        own = graph.select("id", "entries", F.lit(True).alias("forth"))
        back = written(_reverse_lists(graph, degree), "reverse")
        needed = graph.select("id", "others").unionByName(back.select("id", "others")).select(F.col("id").alias("owner"), F.explode("others").alias("id"))
        lists = own.unionByName(back.select("id", "entries", F.lit(False).alias("forth")))
        offered = _grouped(lists, needed, vectors, groups, _step(degree), _LISTS)
        before, graph = graph, written(_merged(offered.unionByName(map_arrow(graph.select("id", "entries"), _aged, _LISTS)), degree), "graph")
        discard(before)
        discard(back)
    return graph.select("id", "others", "entries")


def _exact(ids: np.ndarray, unit: np.ndarray, least: np.ndarray, owner: np.ndarray, other: np.ndarray, fresh: np.ndarray) -> Iterator[pa.RecordBatch]:
    left, right = unit[np.searchsorted(ids, owner)], unit[np.searchsorted(ids, other)]
    cosine = np.clip(np.einsum("ij,ij->i", left.astype(np.float64), right.astype(np.float64)), -1, 1)
    yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(other), pa.array(cosine)], ["id", "other", "cosine"])


def _folded(units: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The different vectors (``id, unit``), each with the smallest id of its copies; ``id, rep``: that id for every vector;
    ``rep, ids``: the first ``k + 1`` copies."""
    by_id = W.partitionBy("unit").orderBy("id")
    members = units.groupBy("unit").agg(F.min("id").alias("rep"))
    single = written(members.select(F.col("rep").alias("id"), "unit"), "single")
    copies = units.join(members, "unit").select("id", "rep")  # equal units, so a hot group is split like any skewed join
    copies = written(copies, "copies")
    leading = units.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1).join(members, "unit").select("rep", "id")
    leading = written(leading.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids")), "leading")  # k + 1 at most
    return single, copies, leading


def most_similar(vectors: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "vec", **settings) -> DataFrame:
    """``id, other, cosine, rank``: of every usable vector the ``k`` most similar others, by falling cosine, then id.

    Vectors of another length, with null, NaN or infinite components, all zero, or with a null id have no row and are in
    nobody's list. The length (norm) does not matter. Exact copies are one vector for the graph, so a group of copies of any
    size costs nothing there, and are put back after it: each copy's own list begins with the other copies. A vector has
    fewer than ``k`` rows only if there are fewer others. The neighbours are approximate, their cosines exact.
    """
    single, copies, leading = _folded(written(unit_vectors(vectors, key, vector), "units"), k)
    n = single.count()
    graph = neighbour_graph(single, n, **settings)
    near = graph.select("id", "entries", F.lit(True).alias("forth"))  # whole lists: half precision cannot order a dense group
    needed = graph.select(F.col("id").alias("owner"), F.explode(F.concat("others", F.array("id"))).alias("id"))
    exact = _grouped(
        near, needed, single.select("id", F.col("unit").alias("bytes"), F.lit(0.0).cast("float").alias("least")), max(12, -(-n // GROUP)), _by_group(_exact, 0), "id bigint, other bigint, cosine double"
    )
    exact = exact.unionByName(single.select("id", F.col("id").alias("other"), F.lit(1.0).alias("cosine")))
    found = exact.join(leading.withColumnRenamed("rep", "other"), "other").select("id", "cosine", F.explode("ids").alias("other"))
    lists = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "other"))), 1, k + 1).alias("l"))
    each = copies.join(lists.withColumnRenamed("id", "rep"), "rep")
    kept = F.slice(F.filter("l", lambda x: x.other != F.col("id")), 1, k)
    opened = each.select("id", F.posexplode(kept).alias("p", "e"))
    return opened.select("id", F.col("e.other").alias("other"), (-F.col("e.c")).alias("cosine"), (F.col("p") + 1).alias("rank"))


def similar_pairs(neighbours: DataFrame, least: float = 0.9) -> DataFrame:
    """``vec_a, vec_b`` with vec_a < vec_b: pairs of which one is in the other's list, with a cosine of at least ``least``."""
    near = neighbours.where(F.col("cosine") >= least)
    return near.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()


def search(graph: DataFrame, units: DataFrame, queries: DataFrame, k: int = 10, beam: int = 64, entries: int = 256, most_rounds: int = 24) -> DataFrame:
    """``query, id, cosine, rank``: for each query the ``k`` most similar vectors that a greedy walk through the graph finds.

    ``graph``: as from ``neighbour_graph``; ``units``: ``id, unit`` of its vectors; ``queries``: ``query, unit``. All queries begin at
    the same ``entries`` vectors, those with the smallest hashes. In each round the best vectors of a query that are not
    expanded yet, one in four of its ``beam``, are; their neighbours are compared with it, and the best ``beam`` of all are
    kept. A query ends once all of those are expanded, the search once all queries have ended or after ``most_rounds``. One
    round is two joins on ids; what is written between rounds is ``beam`` rows a query. Without queries or vectors, no rows.
    """
    starts = units.orderBy(F.xxhash64("id"), "id").limit(entries)
    begun = starts.count()
    names, matrix = [], []
    for row in starts.collect():  # of fixed number
        names.append(row.id)
        matrix.append(np.frombuffer(row.unit, np.float32))
    if not begun:
        return queries.select("query", F.lit(0).cast("bigint").alias("id"), F.lit(0.0).alias("cosine"), F.lit(0).alias("rank")).limit(0)
    start_ids, start_units = np.array(names, np.int64), np.array(matrix)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = _matrix(batch.column("unit")).astype(np.float64) @ start_units.T
                most = min(beam, len(start_ids))
                best = np.argpartition(-cosine, most - 1, axis=1)[:, :most]
                query = np.repeat(batch.column("query").to_numpy(), most)
                columns = [pa.array(query), pa.array(start_ids[best].ravel()), pa.array(np.take_along_axis(cosine, best, 1).ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["query", "id", "cosine"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = np.einsum("ij,ij->i", _matrix(batch.column("asked")).astype(np.float64), _matrix(batch.column("unit")))
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), pa.array(cosine)], ["query", "id", "cosine"])

    schema = "query bigint, id bigint, cosine double"
    asked = written(queries.select(F.col("query").cast("bigint").alias("query"), F.col("unit").alias("asked")), "asked")
    found = map_arrow(asked.select("query", F.col("asked").alias("unit")), begin, schema).withColumn("done", F.lit(False))
    by_query = W.partitionBy("query").orderBy(F.desc("cosine"), "id")
    state = written(found.withColumn("r", F.row_number().over(by_query)), "beam")
    edges = graph.select("id", "others")
    for _ in range(most_rounds):
        open_rows = state.where("NOT done").withColumn("o", F.row_number().over(by_query)).where(F.col("o") <= max(1, beam // 4)).select("query", "id")
        ahead = written(open_rows, "ahead")
        if ahead.isEmpty():
            break
        reached = ahead.join(edges, "id").select("query", F.explode("others").alias("id")).distinct()
        new = reached.join(state.select("query", "id"), ["query", "id"], "left_anti")
        compared = map_arrow(new.join(units, "id").join(asked, "query").select("query", "id", "asked", "unit"), compare, schema)
        marked = state.drop("r").join(ahead.withColumn("now", F.lit(True)), ["query", "id"], "left").select("query", "id", "cosine", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        ranked = marked.unionByName(compared.withColumn("done", F.lit(False))).withColumn("r", F.row_number().over(by_query))
        state = written(ranked.where(F.col("r") <= beam), "beam")
    return state.where(F.col("r") <= k).select("query", "id", "cosine", F.col("r").alias("rank"))


def _block_best(k: int):
    """The ``k`` best of a block of items for each query of a block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, matrix = None, np.empty(0, np.int64), np.empty((0, DIMENSIONS), np.float32)
        for batch in batches:
            key = batch.column("block").to_numpy()
            begins = np.flatnonzero(np.diff(key, prepend=-1)).tolist()
            for begin, end in zip(begins, [*begins[1:], len(key)], strict=True):
                if key[begin] != at:
                    at, names, matrix = key[begin], np.empty(0, np.int64), np.empty((0, DIMENSIONS), np.float32)
                rows = batch.slice(begin, end - begin)
                asked = rows.column("query").null_count  # queries come after items
                unit, ids = _matrix(rows.column("unit")), rows.column("id").to_numpy(zero_copy_only=False)
                if asked:
                    names, matrix = np.concatenate([names, ids[:asked].astype(np.int64)]), np.concatenate([matrix, unit[:asked]])
                queries = rows.column("query").slice(asked).to_numpy(zero_copy_only=False).astype(np.int64)
                for first in range(0, len(queries), 256):
                    cosine = unit[asked + first : asked + first + 256].astype(np.float64) @ matrix.T.astype(np.float64)
                    most = min(k, len(names))
                    best = np.argpartition(-cosine, most - 1, axis=1)[:, :most] if most else np.empty((len(cosine), 0), np.int64)
                    owner = np.repeat(queries[first : first + 256], most)
                    yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(names[best].ravel()), pa.array(np.take_along_axis(cosine, best, 1).ravel())], ["query", "id", "cosine"])

    return run


def block_search(units: DataFrame, queries: DataFrame, k: int = 10, block: int = GROUP) -> DataFrame:
    """``query, id, cosine, rank``: the exact way, each query against every vector, in blocks; ties go to the smaller id.

    ``units``: ``id, unit``, ``queries``: ``query, unit``. Blocks of vectors and queries meet as matrices, and only the ``k`` best of a block
    are shuffled. For a stated set of queries, and to measure the recall of the other ways.
    """
    n, asked = max(1, -(-units.count() // block)), max(1, -(-queries.count() // block))
    number = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    held = units.select("id", "unit", every(asked).alias("_q")).select((number("id", n) * asked + F.col("_q")).alias("block"), F.lit(None).cast("bigint").alias("query"), "id", "unit")
    sent = queries.select("query", "unit", every(n).alias("_n")).select((F.col("_n") * asked + number("query", asked)).alias("block"), "query", F.lit(None).cast("bigint").alias("id"), "unit")
    arranged = held.unionByName(sent).repartition("block").sortWithinPartitions("block", F.col("query").asc_nulls_first())
    found = map_arrow(arranged, _block_best(k), "query bigint, id bigint, cosine double")
    by_query = W.partitionBy("query").orderBy(F.desc("cosine"), "id")  # cut to k in each task before the shuffle
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)


def graph_search(vectors: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "vec", **settings) -> DataFrame:
    """``search`` with the usable vectors whose id is divisible by ``every`` as queries, against all; a query does not find itself.

    As in ``most_similar``, exact copies are one vector for the graph and the walk, and are put back after it.
    """
    single, copies, leading = _folded(written(unit_vectors(vectors, key, vector), "units"), k)
    graph = written(neighbour_graph(single, single.count(), **settings), "graph")
    asked = copies.where(F.col("id") % every == 0).select(F.col("id").alias("query"), "rep")
    queries = written(asked.select(F.col("rep").alias("id")).distinct().join(single, "id").select(F.col("id").alias("query"), "unit"), "queries")
    found = search(graph, single, queries, k + 1).where("query <> id").select(F.col("query").alias("rep"), "id", "cosine")
    found = found.unionByName(queries.select(F.col("query").alias("rep"), F.col("query").alias("id"), F.lit(1.0).alias("cosine")))
    opened = found.join(leading.withColumnRenamed("rep", "id"), "id").select("rep", "cosine", F.explode("ids").alias("id"))
    lists = opened.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "id"))), 1, k + 1).alias("l"))
    kept = F.slice(F.filter("l", lambda x: x.id != F.col("query")), 1, k)
    each = asked.join(lists, "rep").select("query", F.posexplode(kept).alias("p", "e"))
    return each.select("query", F.col("e.id").alias("id"), (-F.col("e.c")).alias("cosine"), (F.col("p") + 1).alias("rank"))
