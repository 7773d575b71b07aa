import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routeloom.llm import common, substrings


def brute(rows, width):
    """doc_id to (words, removed words, digest of what stays); rows of one id are repeats of one document."""
    docs = {}
    for key, text in rows:
        docs[substrings.LAST if key is None else key] = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, gone = {}, {k: set() for k in docs}
    for key in sorted(docs):
        words = docs[key]
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            if window in seen:
                gone[key].update(range(k, k + width))
            else:
                seen[window] = (key, k)
    out = []
    for key, _ in rows:
        key = substrings.LAST if key is None else key
        left = " ".join(w for k, w in enumerate(docs[key]) if k not in gone[key])
        out.append((len(docs[key]), len(gone[key]), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(zip(map(str, [k for k, _ in rows]), out))


def got(df):
    return sorted((str(r["doc_id"]), (r["n_words"], r["n_removed"], r["kept_sha256"])) for r in df.collect())


def corpus(seed, n=150):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(9)}" for _ in range(rng.randint(3, 40))] for _ in range(6)]
    rows = []
    for k in rng.sample(range(1000), n):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.6 else [
                f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 30))
            ]
        rows.append((k, " ".join(words)))
    rows += [(k + 1000, t) for k, t in rows[:20]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("run_words", [substrings.RUN_WORDS, 50])
@pytest.mark.parametrize(("seed", "width"), [(1, 4), (2, 7), (3, 20), (4, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, width, run_words):
    monkeypatch.setattr(substrings, "RUN_WORDS", run_words)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(substrings.dedup_substrings(df, width=width)) == brute(rows, width)


def test_intervals_are_maximal_and_match_the_text(spark):
    rows = [(1, "a b c d e f g"), (2, "x a b c d y c d e f z"), (3, "a b c a b c a b c")]
    out = {
        r["doc_id"]: r
        for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), width=3).collect()
    }
    assert [tuple(s) for s in out[2]["removed"]] == [(1, 5), (6, 10)] and out[2]["kept_text"] == "x y z"
    assert [
        tuple(s) for s in out[3]["removed"]
    ] == [(0, 3), (3, 9)] or [tuple(s) for s in out[3]["removed"]] == [(0, 9)]
    assert out[1]["removed"] == [] and out[1]["kept_text"] == "a b c d e f g"


def test_buckets_that_are_dealt_again(spark):
    """However little text a bucket may hold, the result is the same; a passage that most documents share is one hot window."""
    rng = random.Random(8)
    shared = [f"s{k}" for k in range(12)]
    rows = [
        (k, " ".join([f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 40))] + shared * (k % 3 > 0) + ["end"] * (k % 5)))
        for k in range(120)
    ] + [(300, "again a b c d"), (300, "again a b c d"), (None, "w1 w2 w3 w4 w5"), (200, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    whole = got(substrings.dedup_substrings(df, width=4))
    assert whole == brute(rows, 4)
    for most in (1, 40):
        assert got(substrings.dedup_substrings(df, width=4, bucket_bytes=most)) == whole


def test_keys_that_are_no_integers_raise(spark):
    for kind in ("string", "double"):
        df = spark.createDataFrame([("a b c", "1")], "text string, k string").withColumn("doc_id", F.col("k").cast(kind))
        with pytest.raises(TypeError, match="integer"):
            substrings.dedup_substrings(df)


def test_overlapping_repeats_within_one_document(spark):
    rows = [(1, "a a a a a a"), (2, "b c b c b c b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substrings.dedup_substrings(df, width=3)) == brute(rows, 3)


def test_odd_rows(spark, odd, clashing, empty):
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect()], 2)
    assert got(substrings.dedup_substrings(odd, width=2)) == want
    more = substrings.dedup_substrings(clashing, width=2)
    assert got(more) == want and more.first()["score"] == "own score" and [
        c.lower() for c in more.columns
    ].count("removed") == 1
    assert substrings.dedup_substrings(empty).count() == 0


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 10)), max_size=30))
def test_merged_intervals_cover_the_same(spans):
    starts = np.array([a for a, _ in spans], np.int64)
    low, high = substrings.merged(starts, starts + np.array([n for _, n in spans], np.int64))
    covered = {x for a, n in spans for x in range(a, a + n)}
    assert {x for a, b in zip(low, high) for x in range(a, b)} == covered
    assert all(a > b for a, b in zip(low[1:], high))


@given(
    st.lists(st.integers(0, 2**64 - 1), max_size=40),
    st.lists(st.tuples(st.integers(0, 2**62), st.integers(1, 50)), min_size=1, max_size=10),
)
def test_packing_is_a_round_trip(hashes, docs):
    ids = np.sort(np.array([i for i, _ in docs], np.int64))
    counts = np.array([n for _, n in docs], np.int64)
    hashes = np.sort(np.array(hashes, np.uint64))
    ordinals = np.array([(k * 7) % counts.sum() for k in range(len(hashes))], np.int64)
    h, i, s = substrings.unpacked(substrings.packed(hashes, ordinals, ids, counts))
    doc = np.repeat(np.arange(len(ids)), counts)[ordinals] if len(ordinals) else np.zeros(0, int)
    first = np.cumsum(counts) - counts
    assert h.tolist() == hashes.tolist() and i.tolist() == ids[doc].tolist() and s.tolist() == (
        ordinals - first[doc]
    ).tolist()


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\r\x0b\x0c\x1c  é", max_size=12)), max_size=8))
def test_words_are_split_at_ascii_white_space_only(texts):
    import pyarrow as pa

    words, counts = common.split_words(pa.array(texts, pa.string()))
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert words.to_pylist() == [w for ws in want for w in ws] and counts.tolist() == [len(w) for w in want]


def test_rolling_hashes_equal_windows():
    codes = np.arange(1, 30, dtype=np.uint64) % np.uint64(4)
    hashes = common.rolling_hashes(codes, 5)
    windows = [tuple(codes[k : k + 5].tolist()) for k in range(25)]
    assert len(set(hashes.tolist())) == len(set(windows)) and all(
        (hashes[i] == hashes[j]) == (windows[i] == windows[j]) for i in range(25) for j in range(25)
    )
    assert len(common.rolling_hashes(codes[:3], 5)) == 0
