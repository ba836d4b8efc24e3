"""Item and user encoders as NumPy forward passes over batches, and their use on tables.

Weights are plain arrays in a dictionary; every module draws its own from a seed of its own, so adding a module never changes
the weights of another. ``H`` is the width of a part, ``4 H`` that of a scene, a video and a user.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.session import map_arrow

HIDDEN, TEXT = 128, 1024
Weights = dict[str, np.ndarray]


# -- building blocks ---------------------------------------------------------------------------------------------------------


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def gelu(x: np.ndarray) -> np.ndarray:
    """x times the normal distribution function, by the exact error function."""
    return x * 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


def layer_norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + 1e-5) * gain + bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def linear(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    return x @ w[f"{name}.weight"].T + w[f"{name}.bias"]


def residual(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    """x plus the rectified linear map of x."""
    return x + relu(linear(x, w, name))


def group_mean(values: np.ndarray, groups: np.ndarray, count: int) -> np.ndarray:
    """Mean of the rows of each group, zeros for groups without rows."""
    sums, sizes = np.zeros((count, values.shape[-1])), np.zeros(count)
    np.add.at(sums, groups, values)
    np.add.at(sizes, groups, 1)
    return sums / np.maximum(sizes, 1)[:, None]


def unit_rms(x: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    """The direction of each row, with a root mean square of 1."""
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), eps) * math.sqrt(x.shape[-1])


def drawn(seed: int, module: str) -> np.random.Generator:
    """A generator of its own for each module of a model."""
    return np.random.default_rng([seed, int.from_bytes(hashlib.sha256(module.encode()).digest()[:4], "big")])


def linear_weights(seed: int, module: str, outputs: int, inputs: int) -> Weights:
    """Xavier-normal weights and a zero bias."""
    spread = math.sqrt(2 / (outputs + inputs))
    return {f"{module}.weight": drawn(seed, module).normal(0, spread, (outputs, inputs)), f"{module}.bias": np.zeros(outputs)}


# -- scenes and videos -------------------------------------------------------------------------------------------------------


def scene_weights(seed: int, text: int = TEXT, hidden: int = HIDDEN, role_fusion: bool = True, attention: bool = False, segments: bool = False) -> Weights:
    width, w = 4 * hidden, {}
    for part in ("title", "entity", "action", "context"):
        w |= linear_weights(seed, part, hidden, text)
    if role_fusion:
        w |= linear_weights(seed, "fusion", hidden, 5 * hidden) | {"role_states": drawn(seed, "role_states").normal(0, 0.02, (4, 2, hidden))}
    w |= linear_weights(seed, "scene", width, width)
    if attention:
        spread = (6 * hidden) ** -0.5
        w |= {name: drawn(seed, name).normal(0, spread, (hidden, 3 * hidden)) for name in ("query", "key")} | linear_weights(seed, "exchange", width, width)
    if segments:
        w |= linear_weights(seed, "unit", width, width + 2) | linear_weights(seed, "message", width, 2 * width)
        w |= {"readout.weight": linear_weights(seed, "readout", width, width)["readout.weight"], "gates": np.zeros(2)}
    return w


def parameter_count(w: Weights) -> int:
    return sum(x.size for x in w.values())


def fuse_roles(actions: np.ndarray, entities: np.ndarray, links: np.ndarray, states: np.ndarray, w: Weights) -> np.ndarray:
    """Adds to each action what its actor, target, tool and place say. ``links``: the entity of each role, -1 for none;
    ``states``: 0 absent, 1 unknown, which a learned vector stands for."""
    roles = [np.where((links[:, r] >= 0)[:, None], entities[np.maximum(links[:, r], 0)] if len(entities) else 0.0, w["role_states"][r][states[:, r]]) for r in range(4)]
    return actions + relu(linear(np.concatenate([actions, *roles], axis=1), w, "fusion"))


def exchange(scenes: np.ndarray, content: np.ndarray, videos: np.ndarray, w: Weights) -> np.ndarray:
    """Each scene gets what the scenes of its video say, by softmax weights of their title-free content."""
    result = np.zeros_like(scenes)
    for video in np.unique(videos):
        rows = np.flatnonzero(videos == video)
        direction = unit_rms(content[rows])
        weights = softmax((direction @ w["query"].T) @ (direction @ w["key"].T).T / math.sqrt(len(w["query"])))
        result[rows] = scenes[rows] + relu(linear(weights @ scenes[rows], w, "exchange"))
    return result


def segment_update(scenes: np.ndarray, videos: np.ndarray, members: np.ndarray, count: int, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Scenes after messages from their segments, and each video's readout of its segments. ``members``: [scene, segment]."""
    scene, segment = members[:, 0], members[:, 1]
    number = int(segment.max()) + 1 if len(segment) else 0
    size = np.bincount(segment, minlength=number).astype(float)
    video = np.zeros(number, int)
    video[segment] = videos[scene]
    total = np.bincount(videos, minlength=count)[video] if number else np.empty(0)
    shape = np.stack([np.log(np.maximum(size, 1)), size / np.maximum(total, 1)], axis=1)
    units = relu(linear(np.concatenate([group_mean(scenes[scene], segment, number), shape], axis=1), w, "unit"))
    received = group_mean(units[segment], scene, len(scenes))
    message = relu(linear(np.concatenate([scenes, received], axis=1), w, "message"))
    inside = (np.bincount(scene, minlength=len(scenes)) > 0)[:, None]
    real = size > 0
    readout = group_mean(units[real], video[real], count) @ w["readout.weight"].T
    has = (np.bincount(video[real], minlength=count) > 0)[:, None]
    return scenes + w["gates"][0] * message * inside, w["gates"][1] * readout * has


def encode_videos(batch: dict[str, np.ndarray], w: Weights) -> np.ndarray:
    """Vectors of the videos of a batch.

    ``titles`` and ``titled`` (by video), ``contexts`` and ``videos`` (by scene), ``entities`` and ``entity_scenes``, ``actions`` and
    ``action_scenes``, ``links`` and ``states`` (by action), and for the hypergraph ``members``. A scene is its title, the means of
    its entities and actions, and its context; a video the mean of its scenes, or its title alone, or zeros.
    """
    count, scenes = len(batch["titles"]), len(batch["contexts"])
    title = np.where(batch["titled"][:, None], linear(batch["titles"], w, "title"), 0.0)
    hidden = title.shape[1]
    result = np.zeros((count, 4 * hidden))
    videos = batch["videos"]
    if scenes:
        entities, actions = linear(batch["entities"], w, "entity"), linear(batch["actions"], w, "action")
        if "fusion.weight" in w and len(actions):
            actions = fuse_roles(actions, entities, batch["links"], batch["states"], w)
        parts = [group_mean(entities, batch["entity_scenes"], scenes), group_mean(actions, batch["action_scenes"], scenes), linear(batch["contexts"], w, "context")]
        rows = residual(np.concatenate([title[videos], *parts], axis=1), w, "scene")
        if "query" in w:
            rows = exchange(rows, np.concatenate(parts, axis=1), videos, w)
        readout = 0.0
        if "gates" in w:
            rows, readout = segment_update(rows, videos, batch["members"], count, w)
        result = group_mean(rows, videos, count) + readout
    empty = np.bincount(videos, minlength=count) == 0
    alone = residual(np.concatenate([title, np.zeros((count, 3 * hidden))], axis=1), w, "scene")
    result[empty] = alone[empty]
    result[empty & ~batch["titled"]] = 0.0
    return result


def encode_descriptions(titles: np.ndarray, titled: np.ndarray, texts: np.ndarray, videos: np.ndarray, w: Weights) -> np.ndarray:
    """Videos from a quarter of title and three of the text of each scene; weights ``title``, ``text`` and ``scene``."""
    count = len(titles)
    title = np.where(titled[:, None], linear(titles, w, "title"), 0.0)
    scenes = residual(np.concatenate([title[videos], linear(texts, w, "text")], axis=1), w, "scene")
    result = group_mean(scenes, videos, count)
    empty = np.bincount(videos, minlength=count) == 0
    alone = residual(np.concatenate([title, np.zeros((count, 3 * title.shape[1]))], axis=1), w, "scene")
    result[empty] = np.where(titled[:, None], alone, 0.0)[empty]
    return result


def title_items(titles: np.ndarray, titled: np.ndarray, w: Weights) -> np.ndarray:
    """Item vectors from titles only; zeros without one. Weights ``item`` and ``mlp``."""
    return np.where(titled[:, None], residual(linear(titles, w, "item"), w, "mlp"), 0.0)


# -- users -------------------------------------------------------------------------------------------------------------------


def sequence_weights(seed: int, length: int, width: int = 4 * HIDDEN, blocks: int = 2) -> Weights:
    w = {"positions": drawn(seed, "positions").normal(0, math.sqrt(2 / (length + width)), (length, width))}
    for b in range(blocks):
        for name, outputs, inputs in (("in", 3 * width, width), ("out", width, width), ("up", 4 * width, width), ("down", width, 4 * width)):
            w |= linear_weights(seed, f"block{b}.{name}", outputs, inputs)
        w |= {f"block{b}.norm{k}.{x}": np.full(width, float(x == "gain")) for k in (1, 2) for x in ("gain", "bias")}
    w |= linear_weights(seed, "user.1", width, width) | linear_weights(seed, "user.2", width, width)
    return w | {f"{name}.{x}": np.full(width, float(x == "gain")) for name in ("norm", "user.norm") for x in ("gain", "bias")}


def encode_users(items: np.ndarray, present: np.ndarray, w: Weights, heads: int = 2) -> np.ndarray:
    """Vectors of users from their histories: ``items`` [user, place, width], ``present`` [user, place], left-aligned.

    Blocks normalise first; a place sees itself and the places before it, and no padding. The last place with an item, the
    first if there is none, goes through a residual layer with GELU.
    """
    users, length, width = items.shape
    x = items + w["positions"][:length]
    hidden = np.triu(np.ones((length, length), bool), 1)[None, None] | ~present[:, None, None, :]
    bias = np.where(hidden, -1e30, 0.0)
    b = 0
    while f"block{b}.in.weight" in w:
        name = f"block{b}"
        y = layer_norm(x, w[f"{name}.norm1.gain"], w[f"{name}.norm1.bias"])
        q, k, v = (part.reshape(users, length, heads, -1).transpose(0, 2, 1, 3) for part in np.split(linear(y, w, f"{name}.in"), 3, axis=-1))
        weights = softmax(q @ k.transpose(0, 1, 3, 2) / math.sqrt(width / heads) + bias)
        x = x + linear((weights @ v).transpose(0, 2, 1, 3).reshape(users, length, width), w, f"{name}.out")
        y = layer_norm(x, w[f"{name}.norm2.gain"], w[f"{name}.norm2.bias"])
        x = x + linear(relu(linear(y, w, f"{name}.up")), w, f"{name}.down")
        b += 1
    x = layer_norm(x, w["norm.gain"], w["norm.bias"])
    last = np.where(present, np.arange(length), 0).max(axis=1)
    u = x[np.arange(users), last]
    y = layer_norm(u, w["user.norm.gain"], w["user.norm.bias"])
    return u + linear(gelu(linear(y, w, "user.1")), w, "user.2")


def in_batch_loss(users: np.ndarray, items: np.ndarray, log_q: np.ndarray, masked: np.ndarray) -> float:
    """Mean cross entropy of each user's item among the items of the batch, corrected by their popularity."""
    logits = np.where(masked, -1e4, users @ items.T - log_q[None, :])
    top = logits.max(axis=1, keepdims=True)
    return float((np.log(np.exp(logits - top).sum(axis=1)) + top[:, 0] - np.diag(logits)).mean())


# -- on tables ---------------------------------------------------------------------------------------------------------------


def digest_encoder(dimensions: int = TEXT) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a text model: a unit vector drawn from the digest of the text."""

    def encode(texts: list[str]) -> np.ndarray:
        rows = [np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")).standard_normal(dimensions) for t in texts]
        return np.array([r / np.linalg.norm(r) for r in rows], np.float32).reshape(len(texts), dimensions)

    return encode


def encode_distinct(rows: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], batch: int = 256) -> DataFrame:
    """``text, vector`` of each distinct stripped text, encoded once however many rows have it; "" has zeros.

    ``encoder`` takes a list of texts and gives a matrix; it is sent to the workers, where a model should be loaded once.
    """
    texts = rows.select(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n")).alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches:
            values = block.column("text").to_pylist()
            for begin in range(0, len(values), batch):
                part = values[begin : begin + batch]
                vectors = np.asarray(encoder(part), np.float32)
                vectors[[k for k, t in enumerate(part) if not t]] = 0
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(list(vectors), pa.list_(pa.float32()))], ["text", "vector"])

    return map_arrow(texts, run, "text string, vector array<float>")


def apply_tower(rows: DataFrame, vector: str, tower: Callable[[np.ndarray], np.ndarray], keys: list[str]) -> DataFrame:
    """``keys, vector``: a forward pass over the vectors of a table, a block at a time; weights travel with ``tower``."""
    named = rows.select(*keys, F.col(vector).cast("array<float>").alias("vector"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema[:-1]) + ", vector array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches:
            if block.num_rows:
                result = tower(np.array(block.column("vector").to_pylist(), np.float32)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*(block.column(k) for k in keys), pa.array(list(result), pa.list_(pa.float32()))], [*keys, "vector"])

    return map_arrow(named, run, schema)
