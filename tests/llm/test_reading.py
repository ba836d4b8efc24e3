import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinograph.llm import reading as R

WORDS = {1: "dog sun pan frog grandmother".split(), 2: "kettle market shelf weekend pocket".split(), 3: "perspective tradition instrument commentary".split(), 4: "locus axiom heteroscedastic manifold".split()}


def text(rng, level, words=60):
    known = [w for k in range(1, level + 1) for w in WORDS[k]]
    return " ".join(f"the {rng.choice(WORDS[level] if rng.random() < 0.7 else known)} in a" for _ in range(words // 4 + 1)) + "."


def corpus(spark, n=200):
    rng = random.Random(5)
    data = [(k, text(rng, 1 + k % 4), 1 + k % 4) for k in range(n)]
    documents = spark.createDataFrame([(k, t, "en", 9) for k, t, _ in data], "doc_id long, text string, lang string, level int")
    labels = [(k, "r", v if rng.random() < 0.95 else max(1, v - 1)) for k, _, v in data] + [(0, "r", None), (1, "r", 9), (None, "r", 2), (10**6, "r", 1)]
    return documents, spark.createDataFrame(labels, "doc_id long, rater string, level int"), {k: v for k, _, v in data}


def test_held_out_levels(spark):
    documents, labels, levels = corpus(spark)
    model = R.fit(documents, labels.where("doc_id % 8 < 4"))
    found = {r.doc_id: r.level for r in R.reading_levels(documents, model).collect()}
    held = [k for k in levels if k % 8 >= 4]
    assert sum(found[k] == levels[k] for k in held) / len(held) > 0.95
    assert model.grades["dog"] == model.grades["the"] == 1 and model.grades["axiom"] == 4


def test_bounds_of_the_model(spark):
    documents, labels, _ = corpus(spark)
    assert len(R.fit(documents, labels, max_words=7).grades) == 7
    few = R.fit(documents, labels, max_labelled=3)
    assert 0 < len(few.grades) < 30
    none = R.fit(documents, labels.limit(0))
    assert none.grades == {} and {r.level for r in R.reading_levels(documents, none).collect()} == {1}


@pytest.mark.parametrize(
    ("value", "prose"),
    [
        (None, False), ("", False), ("the cook in a pot " * 10, True), ("the cook in a pot " * 7, False), ("cook - lifting - pot; none; unknown\n" * 20, False), ("step=1 video=x frames=2\n" * 20, False),
        ("el mecánico en el taller dobla una caja. " * 10, False), ("厨师在温室里把红围巾搬到另一边。" * 50, False), ("key_a: true\nkey_b: 3\n" * 30, False), ("THE COOK (in) a “pot,” " * 10, True),
    ],
)
def test_prose(spark, value, prose):
    df = spark.createDataFrame([(1, value)], "doc_id long, text string")
    assert R.reading_levels(df, R.ReadingModel({"cook": 1}, (0.5,) * 3)).count() == int(prose)


def test_quantiles():
    shares, above = np.array([0.1, 0.2, 0.2, 0.6, 0.7]), np.array([0.0, 0.0, 0.0, 1.0, 1.0])
    assert np.isclose(R.calibrated_quantile(shares, above), 0.6)
    assert R.calibrated_quantile(shares, np.zeros(5)) == 0.5
    model = R.ReadingModel({"a": 1, "b": 3}, (0.5, 0.6, 0.9))
    assert [model.level(Counter(x)) for x in ("aaaa", "aaab", "aabb", "z", "")] == [1, 1, 3, 1, 1]
    assert R.acquisition_grade(np.array([0.25] * 4)) == 1 and R.acquisition_grade(np.array([0.0, 0.1, 0.1, 0.8])) == 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_accuracy_on_the_tables(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "reading_labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = R.fit(documents, labels.where(half == 0))
    truth = labels.where((half == 1) & F.col("level").between(1, 4)).groupBy("doc_id").agg(F.avg("level").alias("rated"))
    both = R.reading_levels(documents, model).join(truth, "doc_id").where("rated <> 2.5")
    assert both.agg(F.avg(((F.col("level") >= 3) == (F.col("rated") > 2.5)).cast("double"))).first()[0] > 0.96
