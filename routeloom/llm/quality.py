"""A quality classifier: histogram gradient-boosted trees over document statistics, traversed as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.llm.common import bounded_batches, table, with_columns

#: The model is fitted on at most so many labelled rows: those whose doc_id hashes lowest, whatever the table's order.
MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.7
FOLDS, HELD_OUT_FOLD = 4, 2
TREES, DEPTH, BINS, LEARNING_RATE, L2, MIN_CURVATURE = 80, 4, 64, 0.15, 1.0, 2.0

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_sd", "longest_word", "distinct_words", "adjacent_equal", "distinct_pairs",
    "lines", "words_a_line", "distinct_lines", "upper", "digits", "spaces", "stops", "commas", "exclamations", "bars",
    "symbols", "other_punctuation", "non_ascii", "capital_start", "end_stops", "bytes_entropy",
)


def byte_class(chars: bytes) -> np.ndarray:
    return np.frombuffer(chars, np.uint8)


UPPER, DIGITS, SYMBOLS, OTHER = (
    byte_class(x) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~<>{}[]\\=_", b"\"'()+-/:;?`")
)


def statistics(text: str | None) -> np.ndarray:
    """Numbers that describe a whole text; a null text counts as empty, and an empty one is all zeros."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(len(STATISTICS), np.float32)
    words = raw.split()
    if not words:
        return out
    n, n_words, lines = len(raw), len(words), raw.split(b"\n")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = count / n
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    out[:] = (
        np.log1p(n), np.log1p(n_words), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        len(set(words)) / n_words, sum(map(eq, words, words[1:])) / n_words, len(set(zip(words, words[1:]))) / n_words,
        np.log1p(len(lines)), n_words / len(lines), len(set(lines)) / len(lines), share[UPPER].sum(), share[DIGITS].sum(),
        share[32], share[46], share[44], share[33], share[124], share[SYMBOLS].sum(), share[OTHER].sum(), share[128:].sum(),
        sum(w[:1].isupper() for w in words) / n_words, sum(w.endswith(b".") for w in words) / n_words,
        -(share[share > 0] * np.log2(share[share > 0])).sum(),
    )
    return out


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: inner nodes and leaves lie in heap order, one row a tree."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of x."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosts trees on logistic loss: every level sums gradients and curvatures by node and bin of each feature.

    Without rows, or with one label only, the forest is the constant (smoothed) share of label 1.
    """
    positive = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(positive / (1 - positive)))
    inner = 2**DEPTH - 1
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), start)
    cuts = [
        np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])
    ]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    total, forest = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, curvature = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        node = np.zeros(len(y), np.int64)  # within its level
        for level in range(DEPTH):
            width = 1 << level
            best, choice, cut = np.full(width, 1e-9), np.zeros(width, np.int64), np.full(width, BINS)
            for f in range(len(cuts)):
                at = node * BINS + binned[f]
                g, h = (np.bincount(at, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (gradient, curvature))
                gr, hr = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + L2) + gr**2 / (hr + L2) - g[:, -1:] ** 2 / (h[:, -1:] + L2)
                gain[(h < MIN_CURVATURE) | (hr < MIN_CURVATURE)] = 0
                gain[:, len(cuts[f]) :] = 0
                here = gain.argmax(1)
                value = gain[np.arange(width), here]
                better = value > best
                best, choice, cut = np.where(
                    better, value, best
                ), np.where(better, f, choice), np.where(better, here, cut)
            heap = np.arange(width) + width - 1
            feature[heap] = choice
            threshold[heap] = [cuts[f][c] if c < len(cuts[f]) else np.inf for f, c in zip(choice, cut)]
            node = 2 * node + (binned[choice[node], np.arange(len(y))] > cut[node])
        g, h = (np.bincount(node, w, inner + 1) for w in (gradient, curvature))
        leaf = LEARNING_RATE * g / (h + L2)
        total += leaf[node]
        forest.append((feature, threshold, leaf))
    return Forest(*(np.stack(part) for part in zip(*forest)), start)


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Forest:
    """Fits a forest on labelled rows outside the held-out fold, at most `max_rows` of them.

    Label rows without doc_id or with a quality other than 0 and 1 don't count, equal ones count once; of documents
    that share a doc_id the least text counts. Only the sample's statistics, which executors compute, come to the
    driver: `max_rows` times the number of statistics.
    """
    bounded_batches(docs.sparkSession)
    usable = labels.select(
        F.col("doc_id").alias("__id"), "quality"
    ).where("__id IS NOT NULL AND quality IN (0, 1)").where(fold(F.col("__id")) != HELD_OUT_FOLD).distinct()
    sample = usable.orderBy(F.xxhash64("__id"), "__id", "quality").limit(max_rows)
    rows = docs.select("doc_id", "text").join(
        F.broadcast(sample), F.col("doc_id") == F.col("__id")
    ).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"], "quality": pdf["quality"], "x": [statistics(t).tolist() for t in pdf["text"]]}
            )

    found = rows.mapInPandas(
        describe,
        T.StructType(
            [
                docs.schema["doc_id"],
                T.StructField("quality", T.IntegerType()),
                T.StructField("x", T.ArrayType(T.FloatType())),
            ]
        ),
    )
    got = sorted((r["doc_id"], r["quality"], r["x"]) for r in found.collect())
    return fit(
        np.array([g[2] for g in got], np.float32).reshape(len(got), len(STATISTICS)),
        np.array([g[1] for g in got], np.float64),
    )


def score_column(forest: Forest, text: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(
            forest.score(np.array([statistics(t) for t in texts], np.float32).reshape(len(texts), len(STATISTICS)))
        )

    return score(text)


def with_quality(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, threshold: float = THRESHOLD
) -> DataFrame:
    """`docs` with score (0 to 1, from the text alone), predicted (1 from `threshold` on, else 0) and held_out.

    A null text scores as an empty one, a null doc_id isn't held out, rows repeat with equal scores, an empty
    table gives an empty result; without usable labels all texts score 0.5. Columns of these names are replaced.
    """
    forest = train(docs, labels, max_rows)
    scored = with_columns(docs, {"score": score_column(forest, F.col("text"))})
    return with_columns(
        scored,
        {
            "predicted": (F.col("score") >= threshold).cast("int"),
            "held_out": F.coalesce(fold(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False)),
        },
    )


def drop_rejected(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, threshold: float = THRESHOLD
) -> DataFrame:
    """The documents that score at least the threshold, with their columns; see with_quality."""
    return docs.where(score_column(train(docs, labels, max_rows), F.col("text")) >= threshold)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
