import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routeloom.llm import pii


def plain(text):
    out = [
        ("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)
    ]
    out += [
        ("ip", m.start(), m.end())
        for m in re.finditer(
            r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text
        ) if all(int(p) <= 255 for p in m[0].split("."))
    ]
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(d):
        doubled = [int(x) * (2 if k % 2 else 1) for k, x in enumerate(d[::-1])]
        return sum(x // 10 + x % 10 for x in doubled) % 10 == 0

    out += [
        ("card", m.start(), m.end())
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))
    ]
    out += [
        ("phone", m.start(), m.end())
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15
    ]
    return out


PIECES = [
    "a.b@c.de",
    "a@b@c.d.e",
    "@x.y",
    "x@y",
    "a@b.c",
    "%@-.-",
    "1.2.3.4",
    "1.2.3.4.5.6.7.8",
    "256.1.1.1",
    "001.02.3.0004",
    "4111 1111 1111 1111",
    "4111-1111-1111-1111",
    "4111111111111111",
    "79927398713",
    "+1 (017) 555-7713",
    "+1",
    "+12",
    "+1-2-3-4-5-6-7-8-9",
    "+1 (",
    "++49 30 123456",
    " ",
    " ",
    "\n",
    ".",
    "-",
    "+",
    "@",
    "é",
    "😀",
    "7",
    "12345678901234567890",
]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a1@.+-() %", max_size=40))
def test_base_spans_of_any_text(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize(
    "text",
    [
        "a" * 200_000,
        "1" * 200_000,
        "1." * 100_000,
        "@" * 100_000,
        "+" * 100_000,
        "a@" * 100_000,
        "+1" + "(" * 100_000,
        "a@a" + ".a" * 100_000,
        "1 " * 100_000,
    ],
)
def test_hostile_texts_take_linear_time(text):
    field = pii.own_model()
    began = time.perf_counter()
    pii.all_spans([text], field)
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("line", ["(212) 555-0199 x ", "1.2.3.4 ", "jane (at) example (dot) com , "])
def test_many_spans_take_linear_time(line):
    field = pii.own_model()
    began = time.process_time()
    ((_, spans),) = pii.all_spans([line * 50_000], field)
    assert time.process_time() - began < 5 and len(spans) >= 49_999


def test_fields_are_fitted_fast():
    began = time.process_time()
    pii.train(pii.labelled_table())
    assert time.process_time() - began < 4


def test_spans_apart_equals_comparing_all():
    rng = random.Random(2)
    draw = lambda: sorted(
        [("ip", a := rng.randrange(60), a + rng.randint(1, 9)) for _ in range(rng.randint(0, 8))], key=lambda s: s[1]
    )
    for _ in range(300):
        more, base = draw(), draw()
        want = [s for s in more if not any(s[1] < e and b < s[2] for _, b, e in base)]
        assert pii.apart(more, base) == want


def test_words_longer_than_forty_characters_keep_their_shapes():
    assert pii.shape("1-a." * 30) == "<1>-a." * 30 != pii.shape("1-a." * 30 + "x7")


def test_stretches_are_decoded_as_the_whole_chain():
    """Decoding open words by themselves equals decoding a run as one chain in which the others are held outside."""
    field, rng = pii.own_model(), random.Random(9)
    for text, _ in pii.labelled_table(60, seed=rng.randrange(1000)):
        places = [(m.start(), m.end()) for m in pii.WORD.finditer(text)]
        words = [text[a:b] for a, b in places]
        marks = [j for j, w in enumerate(words) if pii.AT.search(w)]
        scores = field.emissions([pii.describe(words, j) for j in range(len(words))])
        for j, w in enumerate(words):
            if not (pii.OPEN.search(w) or {j - 1, j + 1} & set(marks)):
                scores[j, 1:] -= 1e6
        (labels,) = field.decode([scores])
        want, j = [], 0
        while j < len(labels):
            last, kind = j, (labels[j] - 1) // 2
            while labels[j] and last + 1 < len(labels) and labels[last + 1] == 2 + 2 * kind:
                last += 1
            if labels[j]:
                (a, _), (b, _) = places[j], places[last]
                start, end = a + pii.core(words[j])[0], b + pii.core(words[last])[1]
                if pii.plausible(pii.KINDS[kind], text[start:end]):
                    want.append((pii.KINDS[kind], start, end))
            j = last + 1
        assert pii.field_spans([text], field)[0] == want


def test_the_field_finds_held_out_spans():
    rows = pii.labelled_table(300, seed=5)
    found = pii.field_spans([t for t, _ in rows], pii.own_model())
    right = sum(len(set(f) & set(s)) for f, (_, s) in zip(found, rows))
    assert right / sum(map(len, found)) > 0.97 and right / sum(len(s) for _, s in rows) > 0.97


def test_the_field_adds_what_the_patterns_miss():
    def added(text):
        (base, spans), = pii.all_spans([text], pii.own_model())
        return [(k, text[a:b]) for k, a, b in spans if (k, a, b) not in base]

    assert added("please call (212) 555-0199 for help") == [("phone", "(212) 555-0199")]
    assert added("write to jane (at) example (dot) com today") == [("email", "jane (at) example (dot) com")]
    assert added("was founded on 12.5.1987 under version 2.0 with 1,024.50 and 18:30") == []
    assert added('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and 4785380592391132') == []
    assert added("plain words only, here and there.") == []


def test_clean_documents_stay_clean(documents):
    texts = [r["text"] or "" for r in documents.collect()]
    clean = [t for t in texts if not re.search("[0-9@]", t)]
    assert len(clean) > 50 and all(both == ([], []) for both in pii.all_spans(clean, pii.own_model()))


def test_query(spark, sf_dir, documents):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for r in pii.op10_pii(spark, sf_dir).collect():
        base = plain(texts[r["doc_id"]])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert set(line.split(",")) - {""} <= set(r["spans"].split(","))


def test_odd_rows(spark, odd, clashing, empty):
    got = pii.find_personal_data(odd)
    assert got.count() == odd.count() and got.where(F.size("spans") > 0).count() == 0
    more = pii.find_personal_data(clashing)
    assert more.count() == odd.count() and more.columns.count("spans") == 1 and more.first()["score"] == "own score"
    assert pii.find_personal_data(empty).count() == 0
    row = pii.find_personal_data(spark.createDataFrame([("😀é a@b.co",)], "text string")).first()
    assert [tuple(s) for s in row["spans"]] == [("email", 3, 9)]


def test_redaction():
    text = "mail a@b.co or 1.2.3.4"
    assert pii.redact(text, pii.base_spans(text)) == "mail [email] or [ip]" and pii.redact(None, []) == ""
    rng = random.Random(3)
    assert pii.redact("0123456789", [("x", 2, 5), ("y", 4, 8)]) == "01[x]89" and rng
