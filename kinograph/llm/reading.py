"""Reading level of prose, from the grades at which its words are acquired."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.session import map_arrow, written

LEVELS = (1, 2, 3, 4)
#: Labelled documents from which the model is fitted, at most (those with the smallest hash of their id), and words in it.
MAX_LABELLED, MAX_WORDS = 20_000, 200_000
#: Parts of the labelled documents; each one's shares are measured with the grades that the others give.
FOLDS = 5
#: A word is acquired at the first level by which it has had this share of its use, all levels read equally much.
ACQUIRED = 0.18
#: Labelled documents that must hold a word for it to be known.
MIN_DOCUMENTS = 2
#: Prose of this many words, divided by white space, or more has a level.
MIN_WORDS = 40
#: Share of a text's words that are function words from which on it is English prose. Graphs, titles, logs, settings and
#: other languages stay under 0.15, English sentences above 0.22.
PROSE_SHARE = 0.18
FUNCTION_WORDS = frozenset(
    """a about after all an and any are as at be because been before being between but by during each every for from had has have
    he her here his how if in into is it its near next no not of on one or over she so some than that the their them then there
    these they this those though to two under unless was were what when where which while who whom whose with within without
    although you your we our i my do does did can could will would may might must shall should just very also only more most
    such same other another up down out off again once too own both few until against through below above""".split()
)

_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*")
_EDGES = ".,;:!?()[]{}\"'*_-…“”‘’"


def words_of(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def is_prose(text: str, min_words: int = MIN_WORDS) -> bool:
    """English sentences, judged by the text alone."""
    parts = text.split()
    if len(parts) < min_words:
        return False
    return sum(p.strip(_EDGES).lower() in FUNCTION_WORDS for p in parts) >= PROSE_SHARE * len(parts)


@dataclass(frozen=True)
class ReadingModel:
    """``grades``: the acquisition grade of each known word. ``quantiles``: for levels 2 to 4, the quantile of a text's grades
    that must reach the level for the text to have it."""

    grades: dict[str, int]
    quantiles: tuple[float, ...]

    def shares(self, words: Counter) -> tuple[float, ...]:
        """Of the known words of a text, the share with at least the grade 2, 3 and 4; all 0 without a known word."""
        found = [0] * (LEVELS[-1] + 1)
        for word, n in words.items():
            found[self.grades.get(word, 0)] += n
        known = sum(found[1:])
        return tuple(sum(found[level:]) / known if known else 0.0 for level in LEVELS[1:])

    def level(self, words: Counter) -> int:
        """The highest level that the text's quantile for it reaches: the q-quantile is at least a level if a share of 1 - q
        of the grades is."""
        reached = [k for k, share, q in zip(LEVELS[1:], self.shares(words), self.quantiles, strict=True) if share > 0 and share >= 1 - q]
        return max(reached, default=LEVELS[0])


def acquisition_grade(use: np.ndarray) -> int:
    """From the frequencies of a word in the texts of each level."""
    return LEVELS[int(np.searchsorted(np.cumsum(use) / use.sum(), ACQUIRED))]


def calibrated_quantile(shares: np.ndarray, above: np.ndarray) -> float:
    """The quantile that divides the texts of a level and above (``above``, a weight in 0..1) from the others with the least
    error, both sides counting alike; the middle of the best range. Without texts on both sides, the median."""
    if above.sum() == 0 or (1 - above).sum() == 0:
        return 0.5
    order = np.argsort(shares, kind="stable")
    shares, above = shares[order], above[order]
    missed = np.concatenate([[0], np.cumsum(above)]) / above.sum()
    wrong = 1 - np.concatenate([[0], np.cumsum(1 - above)]) / (1 - above).sum()
    edges = np.concatenate([[0], (shares[1:] + shares[:-1]) / 2, [1]])
    error = missed + wrong
    error[1:-1][shares[1:] == shares[:-1]] = np.inf
    best = np.flatnonzero(error <= error.min() + 1e-9)
    return 1 - float((edges[best[0]] + edges[best[-1]]) / 2)


def _labelled(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``text, votes, fold`` of the labelled documents: the share of its valid labels for each level, and its part."""
    valid = labels.select("doc_id", F.col("level").cast("int").alias("level")).where(F.col("level").isin(*LEVELS) & F.col("doc_id").isNotNull())
    votes = valid.groupBy("doc_id").agg(F.array(*(F.avg((F.col("level") == k).cast("double")) for k in LEVELS)).alias("votes"))
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    return texts.select("text", "votes", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))  # copies are in the same part


def _word_use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word and part: labelled texts holding it and its summed frequency in the texts of each level."""
    use: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for text, votes, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "votes", "fold")), strict=True):
            words = words_of(text)
            total = sum(words.values())
            for word, n in words.items():
                row = use.setdefault((word, fold), np.zeros(1 + len(LEVELS)))
                row[0] += 1
                row[1:] += np.array(votes) * n / total
    table = np.array(list(use.values())).reshape(-1, 1 + len(LEVELS))
    names = [pa.array([w for w, _ in use], pa.string()), pa.array([f for _, f in use], pa.int32())]
    yield pa.RecordBatch.from_arrays([*names, *(pa.array(table[:, k]) for k in range(1 + len(LEVELS)))], ["word", "fold", "texts", *(f"use{k}" for k in LEVELS)])


def _grades(texts: np.ndarray, use: np.ndarray, read: np.ndarray, words: list[str]) -> dict[str, int]:
    """Grades of the words that enough texts hold. ``use``: words x levels; ``read``: how much was read of each level."""
    return {words[k]: acquisition_grade(use[k] / np.maximum(read, 1e-9)) for k in np.flatnonzero((texts >= MIN_DOCUMENTS) & (use.sum(axis=1) > 0))}


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_words: int = MAX_WORDS) -> ReadingModel:
    """Grades of words and quantiles of levels from ``documents`` (``doc_id, text``) and ``labels`` (``doc_id, level``).

    Quantiles are calibrated on held-out texts: the shares of each are measured with grades from the other parts of the labelled
    documents. Levels that are null or not 1 to 4 do not count; raters who differ count in part. At most ``max_labelled`` labelled
    documents, and the ``max_words`` words in most of them, are used; what reaches the driver is bounded by both.
    Without any label, no word is known and every text has level 1.
    """
    chosen = written(_labelled(documents, labels, max_labelled), "labelled")
    uses = [f"use{k}" for k in LEVELS]
    counted = map_arrow(chosen, _word_use, "word string, fold int, texts double, " + ", ".join(f"{u} double" for u in uses))
    parts = F.collect_list(F.struct("fold", "texts", F.array(*uses).alias("use")))
    summed = counted.groupBy("word", "fold").agg(F.sum("texts").alias("texts"), *(F.sum(u).alias(u) for u in uses)).groupBy("word").agg(F.sum("texts").alias("n"), parts.alias("parts"))
    rows = summed.where(F.col("n") >= MIN_DOCUMENTS).orderBy(F.desc("n"), "word").limit(max_words).collect()
    texts, use = np.zeros((FOLDS, len(rows))), np.zeros((FOLDS, len(rows), len(LEVELS)))
    for k, row in enumerate(rows):
        for part in row.parts:
            texts[part.fold, k], use[part.fold, k] = part.texts, part.use
    read = np.zeros((FOLDS, len(LEVELS)))
    for row in chosen.groupBy("fold").agg(F.array(*(F.sum(F.col("votes")[k]) for k in range(len(LEVELS)))).alias("read")).collect():
        read[row.fold] = row.read
    words = [r.word for r in rows]
    grades = _grades(texts.sum(axis=0), use.sum(axis=0), read.sum(axis=0), words)
    median = (0.5,) * (len(LEVELS) - 1)
    others = [ReadingModel(_grades(texts.sum(axis=0) - texts[f], use.sum(axis=0) - use[f], read.sum(axis=0) - read[f], words), median) for f in range(FOLDS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [list(others[f].shares(words_of(t))) for t, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shares, pa.list_(pa.float64())), batch.column("votes")], ["shares", "votes"])

    measured = map_arrow(chosen, measure, "shares array<double>, votes array<double>").collect()
    shares = np.array([r.shares for r in measured]).reshape(-1, len(LEVELS) - 1)
    votes = np.array([r.votes for r in measured]).reshape(-1, len(LEVELS))
    return ReadingModel(grades, tuple(calibrated_quantile(shares[:, k], votes[:, k + 1 :].sum(axis=1)) for k in range(len(LEVELS) - 1)))


def reading_levels(documents: DataFrame, model: ReadingModel, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, level, known_words, share_2, share_3, share_4`` of the documents of English prose with ``min_words`` words or more.

    Other texts (null, empty, short, other languages, graphs, titles, logs, settings) have no row. Whole texts are read, and
    repeated ones each have their row; a text without a known word has level 1 and no known words. There is no shuffle; the
    model, whose size is bounded when it is fitted, is broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            rows = []
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = value.as_py()
                if text and is_prose(text, min_words):
                    words = words_of(text)
                    known = sum(n for w, n in words.items() if w in fitted.grades)
                    rows.append((doc, fitted.level(words), known, *fitted.shares(words)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "level", "known_words", "share_2", "share_3", "share_4"])

    named = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(named, run, "doc_id bigint, level int, known_words bigint, share_2 double, share_3 double, share_4 double")
