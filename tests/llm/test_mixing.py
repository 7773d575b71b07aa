import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from routeloom.llm import mixing


def poisson(u, mean):
    """How many values of the distribution function are at most u."""
    k, p = 0, math.exp(-mean)
    total = p
    while total <= u and k < mean + 10 * math.sqrt(mean) + 20:
        k += 1
        p *= mean / k
        total += p
    return k


def drawn(key, mean):
    parts = max(1, math.ceil(mean / mixing.MAX_MEAN))
    return sum(
        poisson(int(hashlib.md5(f"{mixing.SEED}:{key}:{j}".encode()).hexdigest()[:13], 16) / 2**52, mean / parts)
        for j in range(1, parts + 1)
    )


def test_copies_equal_brute_force(spark):
    docs = spark.createDataFrame(
        [(k, "x" * (k % 50), "big" if k % 3 else "small" if k % 2 else None) for k in range(600)],
        "doc_id long, text string, source string",
    )
    weights = {"big": 1.0, "small": 3.0, None: 300.0}
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(r["text"]) + 1
    rate = {s: weights[s] / sum(weights.values()) * sum(sizes.values()) / n for s, n in sizes.items()}
    want = Counter({r["doc_id"]: drawn(r["doc_id"], rate[r["source"]]) for r in docs.collect()})
    got = mixing.mix_sources(docs, weights).collect()
    assert Counter(r["doc_id"] for r in got) == +want
    assert all(
        sorted(r["copy"] for r in got if r["doc_id"] == k) == list(range(1, want[k] + 1)) for k in list(want)[:40]
    )


def test_large_means_are_sums_of_draws(spark):
    docs = spark.createDataFrame(
        [(1, "x", "tiny")] + [(k, "y" * 999, "huge") for k in range(2, 60)], "doc_id long, text string, source string"
    )
    got = mixing.mix_sources(docs, {"tiny": 1.0})
    mean = source_rate = 1.0 * (58 * 1000 + 2) / 2
    count = got.count()
    assert got.select("source").distinct().count() == 1 and count == drawn(1, source_rate)
    assert abs(count - mean) < 6 * math.sqrt(mean)


def test_targets_are_met_on_average(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"),
        F.lit("abcd").alias("text"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"),
    )
    got = {
        r["source"]: r["count"]
        for r in mixing.mix_sources(docs, {"a": 0.7, "b": 0.3}).groupBy("source").count().collect()
    }
    assert got["a"] == pytest.approx(21_000, rel=0.03) and got["b"] == pytest.approx(9_000, rel=0.03)


def test_order_is_a_permutation_that_depends_on_the_seed(spark):
    docs = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source")
    ).repartition(3)
    first = mixing.mix_sources(docs)
    parts = first.select(F.spark_partition_id().alias("p"), "mix_key", "doc_id").collect()
    for p in {r["p"] for r in parts}:
        keys = [r["mix_key"] for r in parts if r["p"] == p]
        assert keys == sorted(keys)
    ids = [r["doc_id"] for r in parts]
    assert abs(sum(a < b for a, b in zip(ids, ids[1:])) / len(ids) - 0.5) < 0.05
    again = mixing.mix_sources(docs.repartition(7))
    assert sorted(r["mix_key"] for r in again.collect()) == sorted(r["mix_key"] for r in parts)
    other = mixing.mix_sources(docs, seed=7).groupBy("doc_id").count()
    assert {tuple(r) for r in other.collect()} != {tuple(r) for r in first.groupBy("doc_id").count().collect()}


def test_both_joins_agree(spark, documents, monkeypatch):
    want = sorted((r["doc_id"], r["copy"]) for r in mixing.mix_sources(documents).collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 1)
    assert sorted((r["doc_id"], r["copy"]) for r in mixing.mix_sources(documents).collect()) == want


def test_odd_rows(odd, clashing, empty):
    got = mixing.mix_sources(odd, {"a": 1.0, "b": 1.0, "c": 1.0, None: 1.0})
    rows = got.collect()
    assert {r["source"] for r in rows} <= {"a", "b", "c", None}
    twin = [r for r in rows if r["doc_id"] == 10]
    assert len(twin) % 2 == 0  # a repeated row draws the same count
    more = mixing.mix_sources(clashing, {"a": 1.0, "b": 1.0, "c": 1.0, None: 1.0})
    assert sorted(str(r["doc_id"]) for r in more.collect()) == sorted(str(r["doc_id"]) for r in rows)
    assert more.columns.count("copy") == 1 and more.first()["weight"] == "own weight" and more.first()["size"] == "own size"
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(odd, {}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(odd, {"a": -1.0})
