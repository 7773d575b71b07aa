import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from routeloom.llm import components, simhash


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [
        " ".join(words[k : k + 3]) for k in range(len(words) - 2)
    ] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, fps, radius=3):
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    arr = np.array(fps, np.uint64)
    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [least.get(find(i)) for i in range(len(keys))]


def clusters(seed, n=400):
    """Fingerprints in chains and clouds around centres, and many far ones."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        fp = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 3, 10, 80])):
            out.append(fp)
            for _ in range(rng.randint(0, 5)):
                fp ^= 1 << rng.randrange(64)
    return out[:n]


def test_fingerprints_equal_the_plain_ones(odd):
    got = {str(r): simhash.fingerprint(r["text"]) for r in odd.collect()}
    assert got == {str(r): plain_fingerprint(r["text"]) for r in odd.collect()}
    assert simhash.fingerprint("") == simhash.fingerprint(None) == 0


def test_ties_are_zero_bits():
    text = "a b c d"  # two shingles
    h = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d")]
    assert simhash.fingerprint(text) == h[0] & h[1]


@pytest.mark.parametrize("seed", range(5))
def test_bit_sliced_pairs_equal_all_pairs(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.choice([1, 2, 5, 63, 64, 65, 130, 200], 6)
    group = np.repeat(np.arange(len(sizes)), sizes)
    fp = np.array(clusters(seed, len(group)), np.uint64)
    got = sorted((min(a, b), max(a, b)) for x, y in simhash.near(fp, group) for a, b in zip(x.tolist(), y.tolist()))
    want = sorted(
        (i, j)
        for i in range(len(fp))
        for j in range(i + 1, len(fp)) if group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= 3
    )
    assert got == want and want


def test_every_near_pair_shares_a_bucket(spark):
    rng = random.Random(4)
    rows = []
    for k in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        rows.append((k, a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))
    df = spark.createDataFrame(rows, "k long, a long, b long")
    shared = df.select(
        F.size(F.array_intersect(simhash.bucket_keys(F.col("a")), simhash.bucket_keys(F.col("b")))).alias("n")
    )
    assert shared.agg(F.min("n")).first()[0] >= 1


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_links_connect_what_all_pairs_connect(spark, seed, chunk):
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in clusters(seed)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r["node"]: r["root"] for r in components.components(simhash.fingerprint_links(df, chunk)).collect()}
    want = plain_components(fps, [f % (1 << 64) for f in fps])
    assert {f: found.get(f, f) for f in fps} == dict(zip(fps, want))


def test_documents_equal_brute_force(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = dict(zip([r["doc_id"] for r in rows], zip(fps, plain_components([r["doc_id"] for r in rows], fps))))
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(documents).collect()}
    assert got == want


def test_odd_rows(spark, odd, clashing, empty):
    rows = odd.collect()
    want = sorted(
        zip(
            [r["doc_id"] for r in rows],
            plain_components([r["doc_id"] for r in rows], [plain_fingerprint(r["text"]) for r in rows]),
        ),
        key=str,
    )
    for docs in (odd, clashing):
        assert sorted(
            ((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str
        ) == want
    assert dict(want)[4] == dict(want)[5] == 3  # null, blank and empty texts
    kept = simhash.drop_near_duplicates(clashing)
    left = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, left)) == sorted(
        map(str, [1, 3, 6, 7, 8, 9, None, 10, 11, 12])
    ) and kept.columns == clashing.columns
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0
    alone = spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert [r["component_id"] for r in simhash.near_duplicates(alone).collect()] == [None, None]


def test_one_of_each_group_stays(spark, documents):
    named = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(documents).collect()}
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(documents).collect()) == sorted(set(named.values()))


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 260)] + [
        (300 + k, 300 + (k + 1) % 20) for k in range(20)
    ] + [(7, 7)]
    edges += [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(60)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {
        r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    }
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
