"""Personal data: exact patterns, and a conditional random field over word shapes that adds spans to them."""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.llm import crf
from routeloom.llm.common import bounded_batches, table, with_columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
NUMBER = re.compile(r"[0-9]")
# digits before a run of digits would have been part of it, so runs are tried whole and from their start only
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From each @ to both sides: what stands before it starts the leftmost match, after the end of the last one."""
    done = 0
    at = text.find("@")
    while at >= 0:
        after = at + 1
        if at > done and text[at - 1] in LOCAL_CHARS and (domain := DOMAIN.match(text, at + 1)):
            start = at
            while start > done and text[start - 1] in LOCAL_CHARS:
                start -= 1
            yield "email", start, domain.end()
            done = after = domain.end()
        at = text.find("@", after)


def base_spans(text: str) -> list[Span]:
    """Leftmost, non-overlapping matches of each kind, by kind and start."""
    out = list(emails(text))
    if NUMBER.search(text):
        out += [
            ("ip", m.start(), m.end())
            for m in IP.finditer(text) if all(
                len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")
            )
        ]
        for m in CARD.finditer(text):
            if 13 <= len(m[0]) <= 40 and 13 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        out += [
            ("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15
        ] if "+" in text else []
    return out


#: Words that the field labels: those with a digit or an @, and bracketed words (at, dot) with their neighbours; all
#: others are outside any span.
OPEN = re.compile(r"[0-9@]|[(\[{](?:at|dot)[)\]}]", re.I)
AT = re.compile(r"[(\[{](?:at|dot)[)\]}]", re.I)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What may stand around a word's core: brackets, quotes, marks and ends of sentences.
SHELL = "\"'`<>,;:!?#$%&*|="
CONTEXT = 2
#: Where a word's neighbours lie that it has features of; and words that are scored at a time.
STEPS, SCORED = (-2, -1, 1, 2), 1 << 16
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def core(word: str) -> tuple[int, int]:
    """Where a word without its shell starts and ends."""
    start, end = len(word) - len(word.lstrip(SHELL)), len(word.rstrip(SHELL + "."))
    return (start, end) if start < end else (0, len(word))


def shape(word: str) -> str:
    """The word with runs of letters and digits made short: lengths of runs of digits stay, up to five."""
    word = re.sub(r"[^\W\d_]+", "a", word)
    return re.sub(
        r"[0-9]+", lambda m: f"<{len(m[0])}>" if len(m[0]) < 5 else "<5>" if len(m[0]) < 9 else "<9>", word
    )


def own_features(word: str) -> list[str]:
    """The features that a word has of its own."""
    a, b = core(word)
    own = word[a:b]
    digits = re.sub(r"[^0-9]", "", own)
    out = [
        f"shape={shape(own)}", f"digits={min(len(digits), 20)}", f"first={own[:1] if not own[:1].isalnum() else 'x'}"
    ]
    if "@" in own:
        out.append("has@")
    if AT.search(own):
        out.append("hasat")
    if own.isdigit():
        out.append("number")
        if 13 <= len(own) <= 19:
            out.append(f"luhn={luhn(own)}")
    if digits and re.search(r"[^\W\d_]", own):
        out.append("mixed")
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", own):
        out.append(f"quad={all(int(p) <= 255 for p in own.split('.'))}")
    return out


def near_features(word: str) -> list[list[str]]:
    """The features that a word gives to the word of which it is the neighbour, for each of STEPS; "" is no word."""
    a, b = core(word) if word else (0, 0)
    near = shape(word[a:b])
    cue = CUES.get(word[a:b].lower().rstrip("."))
    return [[f"{step}:shape={near}"] + [f"{step}:cue={cue}"] * bool(cue and step < 0) for step in STEPS]


def describe(words: list[str], at: int) -> list[str]:
    """The features of a word among its neighbours."""
    out = own_features(words[at])
    for j, step in enumerate(STEPS):
        out += near_features(words[at + step] if 0 <= at + step < len(words) else "")[j]
    return out


def scores(words: list[str], model: crf.Crf) -> np.ndarray:
    """The score of each label at each of the words, of which "" stands for none: each distinct word's features are summed once."""
    out = np.empty((len(words), len(LABELS)))
    reach, known = max(STEPS), model.features
    for low in range(0, len(words), SCORED):
        high = min(low + SCORED, len(words))
        part = words[max(0, low - reach) : high + reach]
        part = [""] * max(0, reach - low) + part + [""] * max(0, high + reach - len(words))
        number: dict[str, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in part])
        sums = np.array(
            [
                [model.weights[[known[f] for f in fs if f in known]].sum(0) for fs in (own_features(w), *near_features(w))]
                for w in number
            ]
        )
        at = np.arange(reach, len(part) - reach)
        out[low:high] = sums[ids[at], 0] + sum(sums[ids[at + step], 1 + j] for j, step in enumerate(STEPS))
    return out


#: Words that announce a kind.
CUES = {
    "tel": "phone",
    "phone": "phone",
    "call": "phone",
    "fax": "phone",
    "mobile": "phone",
    "telefon": "phone",
    "teléfono": "phone",
    "téléphone": "phone",
    "mail": "email",
    "email": "email",
    "e-mail": "email",
    "contact": "email",
    "ip": "ip",
    "card": "card",
    "visa": "card",
    "mastercard": "card",
}


def labelled_table(n: int = 400, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """A small table of invented lines and the spans of personal data in them, with look-alikes that are none."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices("ta ri on el ve mo sha in or du pel ka ß ñ que an".split(), k=rng.randint(1, 4)))

    def card() -> str:
        while not luhn(digits := number(16)):
            pass
        return rng.choice(
            [
                digits,
                " ".join(digits[k : k + 4] for k in range(0, 16, 4)),
                "-".join(digits[k : k + 4] for k in range(0, 16, 4)),
            ]
        )

    def not_card() -> str:
        while luhn(digits := number(16)):
            pass
        return digits

    quad = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    found = {
        "email": [
            lambda: f"{word()}.{number(2)}@mail{number(1)}.{word()}.com",
            lambda: f"{word()}@{word()}.org",
            lambda: f"{word()} (at) {word()} (dot) com",
            lambda: f"{word()}[at]{word()}.net",
            lambda: f"{word()}(at){word()}.com",
        ],
        "ip": [quad, quad],
        "card": [card, card],
        "phone": [
            lambda: f"+{rng.randint(1, 99)} ({number(3)}) 555-{number(4)}",
            lambda: f"+{number(2)} {number(3)} {number(6)}",
            lambda: f"({number(3)}) {number(3)}-{number(4)}",
            lambda: f"{number(3)}-{number(3)}-{number(4)}",
            lambda: f"tel: 0{number(3)} {number(7)}",
            lambda: f"phone 0{number(3)}/{number(6)}",
        ],
    }
    none = [
        not_card,
        not_card,
        not_card,
        lambda: f"{rng.randint(1, 9)}.0",
        lambda: f"{rng.randint(1, 9)}.0.",
        lambda: f"Version {rng.randint(1, 9)}.{number(1)}.{number(1)}",
        lambda: f'token = "{"".join(rng.choices("0123456789abcdef", k=40))}"',
        lambda: str(rng.randint(1900, 2030)),
        lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}",
        lambda: f"{rng.randint(1990, 2030)}-0{number(1)}-1{number(1)}",
        lambda: number(rng.randint(1, 12)),
        lambda: f"{number(1)},{number(3)}.{number(2)}",
        lambda: f"1{number(1)}:{number(2)}",
        lambda: f"{number(3)}.{rng.randint(256, 999)}.{number(1)}.{number(1)}",
        lambda: f"@{word()}",
        lambda: f"{number(2)}-{number(2)}",
        lambda: f"{word()}{number(2)}",
        lambda: f"{number(3)} {number(3)} {word()}",
    ]
    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 4)):
            text += "".join(f"{word()} " for _ in range(rng.randint(1, 5)))
            mark = rng.choice(["", "", "", ",", ".", "###", "%%%", "&&&", "!!", " |"])
            if rng.random() < 0.55:
                kind = rng.choice(KINDS)
                piece = rng.choice(found[kind])()
                cue = re.match(r"(tel:|phone) ", piece)
                text += cue[0] if cue else ""
                piece = piece[len(cue[0]) :] if cue else piece
                spans.append((kind, len(text), len(text) + len(piece)))
            else:
                piece = rng.choice(none)()
            text += piece + mark + " "
        rows.append((text + word(), spans))
    return rows


def train(rows: list[tuple[str, list[Span]]]) -> crf.Crf:
    """A field fitted to labelled lines: the first word of a span begins it, the others lie inside."""
    sequences = []
    for text, spans in rows:
        found = [(m.start(), m.end()) for m in WORD.finditer(text)]
        words = [text[a:b] for a, b in found]
        labels = []
        for a, b in found:
            hit = next(((k, s, e) for k, s, e in spans if a < e and s < b), None)
            labels.append(LABELS.index(f"{'B' if hit[1] >= a else 'I'}-{hit[0]}") if hit else 0)
        sequences.append(([describe(words, k) for k in range(len(words))], labels))
    return crf.train(sequences, len(LABELS))


@cache
def own_model() -> crf.Crf:
    """The field of the built-in labelled table; no randomness is left, so every process fits the same one."""
    return train(labelled_table())


def plausible(kind: str, piece: str) -> bool:
    """Whether a decoded span can be of its kind at all."""
    digits = re.sub(r"[^0-9]", "", piece)
    if kind == "email":
        return bool(
            re.fullmatch(r"[\w.%+-]+ ?(@|[(\[{]at[)\]}]) ?[\w-]+( ?(\.|[(\[{]dot[)\]}]) ?[\w-]+)+", piece, re.I)
        )
    if kind == "ip":
        return bool(
            re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", piece)
        ) and all(int(p) <= 255 for p in piece.split("."))
    if kind == "card":
        return bool(CARD.fullmatch(piece)) and 13 <= len(digits) <= 19 and luhn(digits)
    return bool(
        re.fullmatch(r"\+?\(?[0-9][\x20().0-9/-]+[0-9]", piece)
    ) and 7 <= len(digits) <= 15 and not (piece.isdigit() and len(piece) < 9)


def field_spans(texts: list[str], model: crf.Crf) -> list[list[Span]]:
    """The spans that the field decodes in each whole text; words that are not OPEN are held outside.

    The chain's best labelling falls apart at words that are held outside, so the open words between two of them are
    decoded by themselves, with the steps from and to the label outside.
    """
    flat: list[str] = []  # runs of open words with CONTEXT words about them, and room for neighbours that they don't have
    where: list[tuple[int, int, int]] = []  # text, start, end
    is_open: list[bool] = []
    edge: list[bool] = []  # whether a word has no neighbour before or after it in its run
    gap = [("", (0, 0, 0), False, True)] * CONTEXT
    for k, text in enumerate(texts):
        if not OPEN.search(text):
            continue
        places = [(m.start(), m.end()) for m in WORD.finditer(text)]
        starts = np.array([a for a, _ in places])

        def holding(pattern: re.Pattern, text: str = text, starts: np.ndarray = starts) -> np.ndarray:
            """The words with a match; no match spans white space."""
            return np.searchsorted(starts, [m.start() for m in pattern.finditer(text)], side="right") - 1

        opened = np.zeros(len(places) + 2, bool)  # one before the first word, one after the last
        opened[1 + holding(OPEN)] = True
        if AT.search(text):
            near = holding(AT)
            opened[near] = opened[near + 2] = True
        opened = opened[1:-1]
        wanted = np.flatnonzero(opened)
        for part in np.split(wanted, np.flatnonzero(np.diff(wanted) > 2 * CONTEXT) + 1):
            low, high = max(0, part[0] - CONTEXT), min(len(places), part[-1] + CONTEXT + 1)
            rows = [(text[a:b], (k, a, b), opened[low + j], False) for j, (a, b) in enumerate(places[low:high])]
            for column, values in zip((flat, where, is_open, edge), zip(*rows, *gap)):
                column += values
    out: list[list[Span]] = [[] for _ in texts]
    if not flat:
        return out
    scored, opens = scores(flat, model), np.array(is_open)
    begin = np.flatnonzero(opens & ~np.concatenate([[False], opens[:-1]]))
    end = np.flatnonzero(opens & ~np.append(opens[1:], False)) + 1
    outside = np.array([*edge, True])
    scored[begin] += np.where(outside[begin - 1, None], 0, model.steps[0] - model.first)
    scored[end - 1] += np.where(outside[end, None], 0, model.steps[:, 0])
    for low, labels in zip(begin, model.decode([scored[a:b] for a, b in zip(begin, end)])):
        at = 0
        while at < len(labels):
            if labels[at] == 0:
                at += 1
                continue
            kind, last = (labels[at] - 1) // 2, at
            while last + 1 < len(labels) and labels[last + 1] == 2 + 2 * kind:
                last += 1
            (k, a, b), (_, c, d) = where[low + at], where[low + last]
            first, final = a + core(texts[k][a:b])[0], c + core(texts[k][c:d])[1]
            if first < final and plausible(KINDS[kind], texts[k][first:final]):
                out[k].append((KINDS[kind], first, final))
            at = last + 1
    return out


def apart(spans: list[Span], base: list[Span]) -> list[Span]:
    """The spans that touch no base span: base spans are merged into intervals in a row, in which each span is looked up."""
    starts, ends = [], []
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for span in spans:
        k = bisect.bisect_left(starts, span[2])  # the intervals before it start within or before the span
        if k == 0 or ends[k - 1] <= span[1]:
            out.append(span)
    return out


def all_spans(texts: list[str], model: crf.Crf) -> list[tuple[list[Span], list[Span]]]:
    """Of each text the base spans, and all: a decoded span counts if it touches no base span."""
    out = []
    for text, more in zip(texts, field_spans(texts, model)):
        base = base_spans(text)
        out.append((base, sorted(base + apart(more, base), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def find_personal_data(docs: DataFrame, model: crf.Crf | None = None) -> DataFrame:
    """`docs` with base and spans: arrays of (kind, start, end) in code points, end exclusive, by kind and start.

    base has the exact patterns' matches; spans also has what the field adds, of the same kinds. A null text has
    none, as an empty one; texts of any length are read whole; repeated rows get equal spans; columns of these names
    are replaced; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    field = model or own_model()
    spans = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(T.StructType.fromDDL(f"base {spans}, spans {spans}"))
    def find(texts: pd.Series) -> pd.DataFrame:
        found = all_spans([t or "" for t in texts], field)
        named = [[[{"kind": k, "start": a, "end": b} for k, a, b in part] for part in row] for row in found]
        return pd.DataFrame({"base": [r[0] for r in named], "spans": [r[1] for r in named]})

    both = with_columns(docs, {"__found": find("text")})
    return with_columns(both, {"base": F.col("__found.base"), "spans": F.col("__found.spans")}).drop("__found")


def redact(text: str | None, spans: list[Span]) -> str:
    """The text with each span, or overlapping spans together, replaced by its kind in brackets."""
    text, out, at = text or "", [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))
