import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from routeloom.llm import decontamination as d


def plain(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute(docs, items, width=5, containment=0.8):
    out = []
    for key, text in docs:
        words = plain(text)
        for item, passage in items:
            own = plain(passage)
            if not own:
                continue
            w = min(width, len(own))
            mine = {tuple(own[k : k + w]) for k in range(len(own) - w + 1)}
            n = len(mine & {tuple(words[k : k + w]) for k in range(len(words) - w + 1)})
            if n >= containment * len(mine) - 1e-9:
                out.append((key, item, len(mine), n))
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(
        items, "item_id long, text string"
    )


def rows(df):
    return sorted(((r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in df.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    items = [(k, " ".join(words(rng.choice([1, 2, 3, 5, 6, 9, 14, 20, 31, 80])))) for k in range(40)]
    docs = []
    for k in range(120):
        body = words(rng.choice([0, 3, 40, 400, 3000]))
        if rng.random() < 0.6:
            passage = plain(rng.choice(items)[1])
            for _ in range(rng.randint(0, 4)):  # lightly changed passages lie around the threshold
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = passage
        docs.append((k, " ".join(w.upper() if rng.random() < 0.1 else w for w in body)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block", [d.BLOCK_SHINGLES, 50])
def test_equals_brute_force(spark, seed, block):
    docs, items = corpus(seed)
    want = brute(docs, items)
    assert rows(d.contained_items(*frames(spark, docs, items), block_shingles=block)) == want
    assert any(n < m for _, _, m, n in want) and len(want) > 30
    left = {r["doc_id"] for r in d.drop_contaminated(*frames(spark, docs, items), block_shingles=block).collect()}
    assert left == {k for k, _ in docs} - {k for k, *_ in want}


def test_item_dispersed_over_a_long_document(spark):
    item = [f"i{k}" for k in range(30)]
    body = []
    for k in range(26):  # every shingle on its own, far from the others
        body += item[k : k + 5] + [f"x{k}-{j}" for j in range(300)]
    docs = [(1, " ".join(body)), (2, " ".join(body[:4000]))]
    assert rows(
        d.contained_items(*frames(spark, docs, [(9, " ".join(item))]))
    ) == [(1, 9, 26, 26)] == brute(docs, [(9, " ".join(item))])


@given(st.integers(1, 500), st.floats(0.05, 1.0))
def test_no_container_can_miss_the_sketch(n, share):
    import math

    needed = math.ceil(share * n - 1e-9)
    assert d.sketch_size(n, share) + needed > n >= d.sketch_size(n, share) >= 1


def test_odd_rows(spark, odd, clashing, empty):
    items = [
        (1, "One two THREE four five"),
        (2, ""),
        (3, None),
        (4, " \n"),
        (5, "word"),
        (5, "word"),
        (None, "same row"),
        (6, "zwei Wörter"),
        (7, "one two three"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect()], items)
    assert rows(d.contained_items(odd, bench)) == want == rows(
        d.contained_items(clashing, bench.selectExpr("*", "'own' AS doc_id", "'own' AS containment"))
    )
    assert {(1, 1, 1, 1), (10, None, 1, 1), (9, 7, 1, 1), (7, 5, 1, 1)} <= set(want)
    assert sorted(str(r["doc_id"]) for r in d.drop_contaminated(clashing, bench).collect()) == sorted(
        str(r["doc_id"]) for r in odd.collect() if r["doc_id"] not in {w[0] for w in want}
    )
    assert d.contained_items(empty, bench).count() == 0 and d.contained_items(odd, bench.limit(0)).count() == 0
    assert d.drop_contaminated(
        odd, bench.limit(0)
    ).count() == odd.count() and d.drop_contaminated(empty, bench).count() == 0
