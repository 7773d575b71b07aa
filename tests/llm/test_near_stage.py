import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from routeloom.llm import common, simhash, similar


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_groups(rows):
    """Smallest id of each group that links of Jaccard 0.8 in five-word shingles connect; texts without words are alike."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [plain_shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) < 0.8 * max(len(sets[i]), len(sets[j])) - 1e-9:
                continue
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {k: rows[find(i)][0] for i, (k, _) in enumerate(rows)}


def copies(seed):
    """Documents, each with copies of which more and more words are replaced."""
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([20, 60, 112, 250, 900]))]
        for share in (0, 0.01, 0.02, 0.03, 0.05):
            out.append(" ".join(f"x{rng.randrange(5000)}" if rng.random() < share else w for w in words))
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "chunk", "first"), [(2, 3, 1)])
def test_stage_groups_equal_all_pairs(spark, seed, chunk, first):
    rows = copies(seed)
    want = plain_groups(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.stage_groups(docs, chunk, first).collect()}
    assert got == want
    by_bits = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert len(set(want.values())) < len(set(by_bits.values()))  # 3 bits alone keep copies


def test_stage_drops_alike_texts_of_distant_fingerprints(spark, documents, sf_dir):
    rows = sorted(tuple(r) for r in documents.select("doc_id", "text").collect())
    left = corpus_pipeline.drop_copies(spark, documents, sf_dir).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in left) == sorted(set(plain_groups(rows).values()))


def test_texts_of_one_doc_id(spark):
    words = [f"w{k}" for k in range(200)]
    other = [*words[:100], "x", *words[101:]]
    rows = [(1, " ".join(words)), (2, "a b c d e f"), (2, " ".join(other)), (3, "a b c d e g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    named = sorted(tuple(r) for r in similar.stage_groups(docs).collect())
    assert named == [(1, 1), (2, 1), (2, 2), (3, 3)]


def crowd(seed, n=300):
    """A third of the documents are copies of one text with a few words replaced; others share a bucket without being alike."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    out = []
    for k in range(n):
        share = rng.choice([0, 0.01, 0.02, 0.05, 0.08]) if k % 3 else 1
        out.append(" ".join(f"x{rng.randrange(5000)}" if rng.random() < share else w for w in base))
    return list(enumerate(out)) + [(n, None), (n + 1, " "), (n + 2, "a b"), (n + 3, "A  B"), (n + 4, "a b c")]


@pytest.mark.parametrize(("chunk", "first"), [(16, 1)])
def test_one_dominant_group(spark, monkeypatch, chunk, first):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    monkeypatch.setattr(common, "SHARE", 20)
    rows = crowd(5)
    got = {r["doc_id"]: r["component_id"] for r in similar.stage_groups(
        spark.createDataFrame(rows, "doc_id long, text string"), chunk, first
    ).collect()}
    assert got == plain_groups(rows)


def test_rows_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    # pairs have a Jaccard likeness of about 0.6, so most share a band and few are alike
    rows = [(k, " ".join(f"x{rng.randrange(5000)}" if rng.random() < 0.03 else w for w in base)) for k in range(300)]
    written, write = [], similar.checkpointed

    def counted(df):
        written.append((out := write(df)).count())
        return out

    monkeypatch.setattr(similar, "checkpointed", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.stage_groups(docs).collect()}
    assert got == plain_groups(rows)
    assert max(written) <= similar.BANDS * len(rows)  # there are 44,850 pairs


@pytest.mark.parametrize("sides", [1, 2])
def test_spanning_links(sides):
    rng = np.random.default_rng(sides)
    base = rng.integers(1 << 63, size=400, dtype=np.uint64)
    sets, side = [], rng.integers(sides, size=60)
    for _ in side:
        kept = base[: rng.integers(40, 400)]
        kept = kept[rng.random(len(kept)) > 0.05]
        sets.append(np.unique(np.concatenate([kept, rng.integers(1 << 63, size=3, dtype=np.uint64)])))
    prints = np.stack([similar.wide_fingerprint(s) for s in sets])

    def roots(pairs):
        root = list(range(len(sets)))
        for a, b in pairs:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
        return root

    every = []
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9 and (sides == 1 or side[a] != side[b]):
                every.append((a, b))
    links = similar.spanning_links(sets, prints, side)
    assert set(map(frozenset, links)) <= set(map(frozenset, every))
    assert roots(links) == roots(every)
    assert len(links) == len(sets) - len(set(roots(every))) < len(every)


def test_fingerprints_of_alike_sets_are_within_the_radius():
    rng = np.random.default_rng(1)
    far = 0
    for _ in range(2000):
        n = int(rng.integers(5, 300))
        a = rng.integers(1 << 63, size=n, dtype=np.uint64)
        differ = max(1, int(n * 0.11))  # a Jaccard likeness of about 0.8
        b = np.concatenate([a[differ:], rng.integers(1 << 63, size=differ, dtype=np.uint64)])
        bits = int(np.bitwise_count(similar.wide_fingerprint(a) ^ similar.wide_fingerprint(b)).sum())
        if len(np.intersect1d(a, b)) >= 0.8 * (2 * n - len(np.intersect1d(a, b))):
            far = max(far, bits)
    assert 0 < far <= similar.RADIUS
