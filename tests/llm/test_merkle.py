import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from routeloom.llm import merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


PIECE = re.compile(r"[^\n]{16,48}?(?:\x20|\Z)|[^\n]{1,48}")


def plain_tree(text):
    """Sections of paragraphs of leaf digests."""
    return [[[sha(p) for p in PIECE.findall(line)] for line in s.split("\n")] for s in text.split("\n\n")]


def line_digest(line):
    return sha("".join(line))


def section_digest(section):
    return sha("".join(map(line_digest, section)))


def plain_print(text):
    tree = plain_tree(text)
    told = [
        section_digest(s)[:16] + ":" + ",".join(line_digest(p)[:16] + "".join(d[:8] for d in p) for p in s) for s in tree
    ]
    return ";".join([sha("".join(map(section_digest, tree))), *told])


def plain_likeness(a, b):
    """Descends both trees: what both have is not opened."""
    x, y = plain_tree(a), plain_tree(b)
    total = sum(len(p) for t in (x, y) for s in t for p in s)
    if a == b or not total:
        return float(a == b)
    same = {section_digest(s) for s in x} & {section_digest(s) for s in y}
    left = [[p for s in t if section_digest(s) not in same for p in s] for t in (x, y)]
    same = {line_digest(p) for p in left[0]} & {line_digest(p) for p in left[1]}
    leaves = [{d[:8] for p in side if line_digest(p) not in same for d in p} for side in left]
    return 1 - len(leaves[0] ^ leaves[1]) / total


def plain_edits(a, b):
    x, y = plain_tree(a), plain_tree(b)
    get = lambda t, k: t[k] if k < len(t) else None
    return ",".join(
        f"{i}.{j}"
        for i in range(max(len(x), len(y)))
        if get(x, i) != get(y, i)
        for j in range(max(len(get(x, i) or []), len(get(y, i) or [])))
        if get(get(x, i) or [], j) != get(get(y, i) or [], j)
    )


def brute(rows):
    texts = sorted(((-(i if i is not None else merkle.LEAST), t or "", i) for i, t in rows))
    out = []
    for k, (_, text, key) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        near = lambda x: round(plain_likeness(text, x), 9)  # noqa: B023, E731
        out.append(
            (
                key,
                len(text),
                sha(edited),
                plain_print(text),
                plain_print(edited),
                near(edited),
                near(after),
                plain_edits(text, edited),
            )
        )
    return sorted(out, key=str)


def query(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "table", lambda s, d, n: docs)
    return merkle.op3_merkle(spark, "")


def test_equals_brute_force(spark, odd, monkeypatch, tmp_path):
    got = query(spark, odd, tmp_path, monkeypatch).collect()
    assert sorted(
        ((*r[:5], round(r[5], 9), round(r[6], 9), r[7]) for r in got), key=str
    ) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_next_text_over_any_ranges(spark, documents, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(documents).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    rows = sorted(((r["doc_id"], r["text"]) for r in documents.collect()), reverse=True)
    assert got == {i: rows[(k + 1) % len(rows)][1] for k, (i, _) in enumerate(rows)}


def test_next_text_beside_other_columns(odd, clashing):
    plain = sorted((str(r["doc_id"]), r["text"], r["next_text"]) for r in merkle.with_next(odd).collect())
    more = merkle.with_next(clashing)
    assert sorted((str(r["doc_id"]), r["text"], r["next_text"]) for r in more.collect()) == plain
    assert more.first()["a.b c"] == "own a.b c"


def test_one_and_no_document(spark, empty):
    one = spark.createDataFrame([(5, "abc")], "doc_id long, text string")
    assert merkle.with_next(one).first()["next_text"] == "abc"
    assert merkle.with_next(empty).count() == 0 and merkle.with_fingerprints(empty).count() == 0


def test_trees(spark, odd, clashing):
    got = merkle.with_fingerprints(odd).collect()
    assert all(r["fingerprint"] == plain_print(r["text"] or "") and r["fingerprint"][:64] == r["root"] for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r["text"] or "", set()).add(r["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values()) and len({next(iter(f)) for f in by_text.values()}) == len(by_text)
    more = merkle.with_fingerprints(clashing)
    assert more.count() == len(got) and [
        c.lower() for c in more.columns
    ].count("root") == 1 and more.first()["score"] == "own score"


def test_edits_are_located(spark):
    a = "intro\nfirst\nsecond\n\nnext section\nthird"
    pairs = [
        (1, a, a),
        (2, a, a.replace("second", "changed")),
        (3, a, a.replace("third", "more\nlines")),
        (4, a, "intro\nfirst\nsecond"),
        (5, a, ""),
    ]
    df = spark.createDataFrame(pairs, "k int, x string, y string").select(
        "k", merkle.tree(F.col("x")).alias("tree_a"), merkle.tree(F.col("y")).alias("tree_b")
    )
    got = {r["k"]: [tuple(e) for e in r["edits"]] for r in merkle.edits(df).collect()}
    assert got[1] == [] and got[2] == [(0, 2)] and got[3] == [(1, 1), (1, 2)] and got[4] == [(1, 0), (1, 1)] and got[5] == [
        (0, 0), (0, 1), (0, 2), (1, 0), (1, 1)
    ]


def test_an_edited_half_is_nearer_than_another_document(spark, sf_dir):
    got = merkle.op3_merkle(spark, sf_dir).toPandas()
    long = got[got["n_chars"] > 200]
    assert (
        long["near_edited"] > long["near_next"]
    ).mean() > 0.97 and long["near_edited"].median() == pytest.approx(0.5, abs=0.1)


def sectioned(seed, n=60):
    """Texts of many sections and lines, and versions of them with a word, line or section put in, taken out or changed."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    out = []
    while len(out) < n:
        text = [[[word() for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 5))]
        for _ in range(3):
            out.append("\n\n".join("\n".join(" ".join(p) for p in s) for s in text))
            s = rng.choice(text)
            rng.choice(
                [lambda: s.append([word()]), lambda: s[0].insert(0, word()), lambda: text.insert(0, [[word()]]), lambda: s.pop() if len(s) > 1 else 0]
            )()
    return list(enumerate(out))


def test_sections_against_brute_force_and_sql(spark, monkeypatch, tmp_path):
    import duckdb

    rows = sectioned(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in query(spark, docs, tmp_path, monkeypatch).collect()]
    assert sorted(got, key=str) == brute(rows)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(con.execute(merkle.OP3_SQL).fetchall()) == sorted(got)
    assert 0 < sum(0.4 < r[6] < 1 for r in got)


def test_an_inserted_word_changes_few_leaves(spark):
    rng = random.Random(4)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(300)]
        rows.append((k, " ".join(words), " ".join([*words[:5], "inserted", *words[5:]])))
    pairs = spark.createDataFrame(rows, "k int, x string, y string")
    near = [
        r[0]
        for r in pairs.select(
            merkle.likeness(merkle.fingerprint(merkle.tree(F.col("x"))), merkle.fingerprint(merkle.tree(F.col("y"))))
        ).collect()
    ]
    assert sorted(near)[len(near) // 2] > 0.75  # 0.80 of 300 words; pieces of fixed length would share about none
