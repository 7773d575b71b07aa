import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.llm import quality


def test_held_out_labels_are_predicted(spark):
    folder = "/root/testdata/sf0.01"
    got = quality.op6_quality(spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(k).encode()) % 4 == 2 for k in got["doc_id"]]).all()
    held = got.merge(labels, on="doc_id").query("held_out")
    good, bad = (held[held["quality"] == q]["score"].to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.98 and (held["predicted"] == held["quality"]).mean() > 0.97
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()


def test_held_out_labels_do_not_train(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.withColumn(
        "quality",
        F.when(
            quality.fold(F.col("doc_id")) == quality.HELD_OUT_FOLD, 1 - F.col("quality")
        ).otherwise(F.col("quality")),
    )
    a, b = (quality.train(documents, x) for x in (labels, flipped))
    assert (a.leaf == b.leaf).all() and (a.threshold == b.threshold).all()


def test_training_ignores_the_tables_order_and_bounds_its_sample(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    a, b = quality.train(documents, labels, 40), quality.train(
        documents.orderBy(F.desc("doc_id")).repartition(5), labels.orderBy(F.desc("doc_id")), 40
    )
    assert (a.leaf == b.leaf).all() and a.start == b.start


def test_trees_equal_plain_traversal():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(quality.STATISTICS))).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.fit(x, y)

    def plain(row):
        total = forest.start
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    scores = forest.score(x)
    assert np.allclose(scores, [plain(r) for r in x]) and ((scores > 0.5) == y).mean() > 0.95
    fresh = rng.normal(size=(500, len(quality.STATISTICS))).astype(np.float32)
    assert ((forest.score(fresh) > 0.5) == ((fresh[:, 0] > 0) ^ (fresh[:, 1] > 0.5))).mean() > 0.85


@pytest.mark.parametrize("y", [[], [1.0], [0.0, 0.0]])
def test_labels_of_one_kind_give_a_constant(y):
    x = np.zeros((len(y), len(quality.STATISTICS)), np.float32)
    scores = quality.fit(x, np.array(y)).score(np.zeros((3, len(quality.STATISTICS)), np.float32))
    assert len(set(scores.tolist())) == 1 and scores[0] == pytest.approx((sum(y) + 1) / (len(y) + 2))


def test_statistics_of_odd_texts():
    for text in (None, "", "  \n", "x", "\ud800", "😀 " * 10, "A!! B!!", "word " * 100_000):
        found = quality.statistics(text)
        assert np.isfinite(found).all() and len(found) == len(quality.STATISTICS)
    assert not quality.statistics(None).any() and not quality.statistics(" \t").any()


def test_odd_rows(spark, odd, clashing, empty):
    labels = spark.createDataFrame(
        [(1, 1), (3, 0), (8, 1), (9, 0), (None, 1), (11, None), (12, 5), (99, 1), (10, 1), (10, 0)],
        "doc_id long, quality int",
    )
    got = quality.with_quality(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    score = lambda k: [r["score"] for r in got if r["doc_id"] == k]
    assert score(1) == score(2) and score(3) == score(4) == score(5) and len(set(score(10))) == 1
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    more = quality.with_quality(clashing, labels)
    assert sorted(
        r["score"] for r in more.collect()
    ) == sorted(r["score"] for r in got) and more.columns.count("score") == 1
    assert quality.with_quality(empty, labels).count() == 0
    assert {r["score"] for r in quality.with_quality(odd, labels.limit(0)).collect()} == {0.5}
