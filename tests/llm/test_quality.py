import numpy as np
import pyarrow as pa
import pytest

from caseweave.llm import quality
from caseweave.llm.common import table
from tests.llm.helpers import awkward, docs

LABELS = "doc_id long, quality int, toxic int, score double, x int"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = table(spark, folder, "labels")
    got = quality.classify(table(spark, folder, "documents"), labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_held_out_labels_change_nothing(spark):
    folder = "/root/testdata/sf0.001"
    given, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    from caseweave.llm.common import held_out
    from pyspark.sql import functions as F

    other = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.classify(given, x).select("doc_id", "score").collect())) for x in (labels, other))
    assert a == b


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 5)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0).astype(float)
    trees = quality.grow(x, y, trees=30, depth=3, bins=16)
    depth = 3

    def walk(row):
        raw = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            for _ in range(depth):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            raw += leaf[node - (2**depth - 1)]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose(trees.score(x), [walk(r) for r in x])
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_statistics_of_a_text():
    text = "go go go. Stop!\ngo go go. Stop!\n###"
    row = dict(zip(quality.FEATURES, quality.statistics(pa.array([None, text, ""]))[1]))
    words = text.split()
    assert row["log_words"] == pytest.approx(np.log1p(len(words))) and row["distinct"] == pytest.approx(len(set(words)) / len(words))
    assert row["repeated_lines"] == pytest.approx(4 / 9) and row["symbols"] == pytest.approx(3 / len(text)) and row["repeated_next"] == pytest.approx(2 / 9)
    assert not quality.statistics(pa.array([None, text, ""]))[[0, 2]].any()


def test_awkward_rows(spark):
    given = docs(spark, awkward())
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in quality.classify(given, none).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1, 0, 0.0, 1), (None, 0, 0, 0.0, 1), (4, None, 0, 0.0, 1), (5, 0, 0, 0.0, 1), (5, 1, 0, 0.0, 1), (7, 1, 0, 0.0, 1), (9, 0, 0, 0.0, 1)], LABELS)
    got = quality.classify(given, some).collect()
    assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(docs(spark, []), some).count() == 0
