"""A trainable sequence recommender in NumPy: one task for each experiment and seed.

Items are a learned projection of their features, users the mean of the items of their history. The loss is the cross entropy
of each row's target among the targets of its batch, corrected by popularity, without false negatives; steps are AdamW with a
clipped gradient. It stands in for models that need an accelerator, behind the same tables and metrics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.operators.towers import softmax
from kinograph.session import ship


@dataclass(frozen=True)
class Training:
    width: int = 32
    batch: int = 128
    epochs: int = 50
    patience: int = 5
    rate: float = 3e-3
    decay: float = 0.1
    clip: float = 5.0


def batch_gradient(w: np.ndarray, users: np.ndarray, items: np.ndarray, log_q: np.ndarray, masked: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss of a batch and its gradient by the projection. ``users`` and ``items``: features before it."""
    u, c = users @ w, items @ w
    logits = np.where(masked, -1e4, u @ c.T - log_q[None, :])
    p = softmax(logits)
    loss = float(-np.log(np.maximum(np.diag(p), 1e-300)).mean())
    d = np.where(masked, 0.0, p - np.eye(len(p))) / len(p)
    return loss, users.T @ (d @ c) + items.T @ (d.T @ u)


class AdamW:
    def __init__(self, shape: tuple[int, ...], settings: Training):
        self.m, self.v, self.t, self.s = np.zeros(shape), np.zeros(shape), 0, settings

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        g = g * min(1.0, self.s.clip / max(float(np.linalg.norm(g)), 1e-12))
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        update = self.m / (1 - 0.9**self.t) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
        return w * (1 - self.s.rate * self.s.decay) - self.s.rate * update


def history_means(histories: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Mean features of each history; row 0 of ``features`` is for padding and has zeros."""
    return features[histories].sum(axis=1) / np.maximum((histories > 0).sum(axis=1), 1)[:, None]


def ranks(users: np.ndarray, items: np.ndarray, targets: np.ndarray, histories: np.ndarray) -> np.ndarray:
    """1-based ranks of targets (item numbers from 1) by falling score, then number; items of the history come last."""
    result = np.empty(len(users), np.int64)
    for begin in range(0, len(users), 512):
        rows = slice(begin, begin + 512)
        scores = users[rows] @ items.T
        lines, places = np.nonzero(histories[rows])
        scores[lines, histories[rows][lines, places] - 1] = -np.inf
        own = scores[np.arange(len(scores)), targets[rows] - 1][:, None]
        before = np.arange(items.shape[0])[None, :] < (targets[rows] - 1)[:, None]
        result[rows] = 1 + ((scores > own) | ((scores == own) & before)).sum(axis=1)
    return result


def train(rows: pd.DataFrame, features: np.ndarray, seed: int, settings: Training) -> tuple[np.ndarray, list[float], int]:
    """The projection of the best epoch, the validation HR@10 of each epoch, and the best epoch (from 1).

    ``rows``: ``event_id, phase, target, history``, all with a history.
    """
    rng = np.random.default_rng(seed)
    parts = {phase: part.sort_values("event_id") for phase, part in rows.groupby("phase")}
    arrays = {phase: (np.array(part["history"].tolist()), part["target"].to_numpy()) for phase, part in parts.items()}
    histories, targets = arrays["train"]
    counts = np.bincount(targets, minlength=len(features))
    log_q = np.log(np.maximum(counts, 1) / counts.sum())
    means = history_means(histories, features)
    w = rng.normal(0, np.sqrt(2 / (features.shape[1] + settings.width)), (features.shape[1], settings.width))
    optimizer, best, best_score, best_epoch, curve = AdamW(w.shape, settings), w, -np.inf, 0, []
    for epoch in range(1, settings.epochs + 1):
        order = rng.permutation(len(targets))
        for begin in range(0, len(order), settings.batch):
            at = order[begin : begin + settings.batch]
            t = targets[at]
            masked = (histories[at][:, :, None] == t[None, None, :]).any(axis=1) | (t[:, None] == t[None, :])
            np.fill_diagonal(masked, False)
            w = optimizer.step(w, batch_gradient(w, means[at], features[t], log_q[t], masked)[1])
        h, t = arrays.get("validation", arrays["train"])
        score = float((ranks(history_means(h, features) @ w, features[1:] @ w, t, h) <= 10).mean())
        curve.append(score)
        if score > best_score:
            best, best_score, best_epoch = w, score, epoch
        if epoch - best_epoch >= settings.patience:
            break
    return best, curve, best_epoch


def evaluate_runs(rows: DataFrame, features: DataFrame, runs: list[tuple[str, int]], settings: Training = Training()) -> DataFrame:
    """``arm, seed, user, event_id, rank, best_epoch`` of the test rows of each run, trained in a task of its own.

    ``rows``: ``user, event_id, phase, target, history``, those with a history; ``features``: ``arm, item_idx, vector``, one vector
    for every item from 1 on. A run's rows and features are sent to its task and must fit there; runs are spread over tasks.
    """
    ship(rows.sparkSession)
    all_runs = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.lit(s).alias("seed")) for a, s in runs)))  # a few
    left = rows.select(all_runs.alias("run"), "user", "event_id", "phase", "target", "history").select("run.arm", "run.seed", "user", "event_id", "phase", "target", "history")
    right = features.select("arm", "item_idx", "vector", all_runs.alias("run")).where("arm = run.arm").select("run.arm", "run.seed", "item_idx", "vector")

    def one(key: tuple, data: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        vectors = vectors.sort_values("item_idx")
        matrix = np.zeros((int(vectors["item_idx"].max()) + 1, len(vectors["vector"].iloc[0])))
        matrix[vectors["item_idx"].to_numpy()] = np.array(vectors["vector"].tolist())
        w, _, best = train(data[["event_id", "phase", "target", "history"]], matrix, int(key[1]), settings)
        test = data[data["phase"] == "test"]
        histories = np.array(test["history"].tolist()).reshape(len(test), -1)
        found = ranks(history_means(histories, matrix) @ w, matrix[1:] @ w, test["target"].to_numpy(), histories) if len(test) else []
        return pd.DataFrame({"arm": key[0], "seed": key[1], "user": test["user"], "event_id": test["event_id"], "rank": found, "best_epoch": best})

    grouped = left.groupBy("arm", "seed").cogroup(right.groupBy("arm", "seed"))
    return grouped.applyInPandas(one, "arm string, seed int, user long, event_id long, rank long, best_epoch int")
