"""Benchmark decontamination: which documents contain a benchmark item's shingles."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.llm.common import bounded_batches, mixed, numbered, rolling_hashes, split_words, table, word_hashes

WIDTH, CONTAINMENT = 5, 0.8
#: Items go to the executors in blocks of about so many shingles, each block held against all documents.
BLOCK_SHINGLES = 2_000_000
FLAG_BITS = 20


def sketch_size(shingles: int, containment: float) -> int:
    """How many of an item's smallest hashes make up its sketch.

    A document with the asked share of the item's shingles lacks at most n - ceil(share * n) of them, so it holds one
    of any n - ceil(share * n) + 1. All items of one size form a partition with its own sketch size.
    """
    return shingles - math.ceil(containment * shingles - 1e-9) + 1


@dataclass
class Items:
    """A block of items: their shingles, and per shingle width the sorted sketch hashes and the items each stands for."""

    containment: float
    ids: list = field(default_factory=list)
    shingles: list[frozenset[tuple[str, ...]]] = field(default_factory=list)
    widths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def add(self, item: object, words: list[str], width: int) -> int:
        if not words:  # an item without words is contained nowhere
            return 0
        wide = min(width, len(words))
        self.ids.append(item)
        self.shingles.append(frozenset(tuple(words[k : k + wide]) for k in range(len(words) - wide + 1)))
        return len(self.shingles[-1])

    def close(self) -> Items:
        entries = defaultdict(list)
        for k, shingles in enumerate(self.shingles):
            wide = len(next(iter(shingles)))
            flat = pa.array([w for s in shingles for w in s], pa.large_string())
            hashes = np.sort(mixed(rolling_hashes(word_hashes(flat), wide)[::wide]))
            entries[wide] += [(int(h), k) for h in hashes[: sketch_size(len(shingles), self.containment)]]
        for wide, pairs in entries.items():
            pairs.sort()
            hashes = np.array([h for h, _ in pairs], np.uint64)
            flags = np.zeros(1 << FLAG_BITS, bool)
            flags[(hashes >> np.uint64(64 - FLAG_BITS)).astype(np.int64)] = True
            self.widths[wide] = (hashes, np.array([k for _, k in pairs]), flags)
        return self

    def found(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item, shingles found) for every text that contains enough of an item."""
        words, counts = split_words(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
        codes, ends = word_hashes(words), np.cumsum(counts)
        row_of = np.repeat(np.arange(len(counts)), counts)
        candidates: set[tuple[int, int]] = set()
        for wide, (hashes, item, flags) in self.widths.items():
            shingles = mixed(rolling_hashes(codes, wide))
            at = np.flatnonzero(flags[(shingles >> np.uint64(64 - FLAG_BITS)).astype(np.int64)])
            at = at[row_of[at] == row_of[at + wide - 1]]
            low, high = np.searchsorted(hashes, shingles[at]), np.searchsorted(hashes, shingles[at], side="right")
            for p, a, b in zip(at[low < high], low[low < high], high[low < high]):
                candidates.update((int(row_of[p]), int(k)) for k in item[a:b])
        out, known = [], (-1, 0, frozenset())
        for row, k in sorted(candidates, key=lambda c: (c[0], len(next(iter(self.shingles[c[1]]))))):
            wide = len(next(iter(self.shingles[k])))
            if known[:2] != (row, wide):
                own = words.slice(ends[row] - counts[row], counts[row]).to_pylist()
                known = (row, wide, {tuple(own[j : j + wide]) for j in range(len(own) - wide + 1)})
            n = len(self.shingles[k] & known[2])
            if n >= math.ceil(self.containment * len(self.shingles[k]) - 1e-9):
                out.append((row, k, n))
        return out


def blocks(items: DataFrame, width: int, containment: float, most: int) -> Iterator[Items]:
    """The items in blocks that are built one at a time; a null or empty text is no item."""
    block, held = Items(containment), 0
    lowered = items.select("item_id", "text").where("text IS NOT NULL")
    for row in lowered.toLocalIterator():
        words, _ = split_words(pc.ascii_lower(pa.array([row["text"]])))
        held += block.add(row["item_id"], words.to_pylist(), width)
        if held >= most:
            yield block.close()
            block, held = Items(containment), 0
    if held:
        yield block.close()


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    width: int = WIDTH,
    containment: float = CONTAINMENT,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(key, item_id, n_shingles, n_found, containment): each document that holds at least the asked share of an item's shingles.

    Shingles are distinct runs of `width` words (A-Z lower-cased); an item of fewer words is one shingle, found as a
    run of its words. An item's sketch is its smallest shingle hashes (its bottom-k MinHash), with k set by the item's
    size so that no container can miss it; a document whose shingles hit a sketch is held against the item's
    shingles word by word. Items without words and documents without words (null, empty) match nothing; rows that
    repeat, in either table, are judged each on its own; extra columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("item_id", items.schema["item_id"].dataType),
            T.StructField("n_shingles", T.IntegerType()),
            T.StructField("n_found", T.IntegerType()),
            T.StructField("containment", T.DoubleType()),
        ]
    )
    out = spark.createDataFrame([], schema)
    for block in blocks(items, width, containment, block_shingles):
        sent = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                hits = own.found(batch.column(1))
                n = [len(own.shingles[k]) for _, k, _ in hits]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([r for r, _, _ in hits], pa.int64())),
                        pa.array([own.ids[k] for _, k, _ in hits]).cast(item_type),
                        pa.array(n, pa.int32()),
                        pa.array([f for _, _, f in hits], pa.int32()),
                        pa.array([f / m for (_, _, f), m in zip(hits, n)], pa.float64()),
                    ],
                    names=schema.names,
                )

        item_type = pa.string() if isinstance(schema["item_id"].dataType, T.StringType) else pa.int32() if isinstance(
            schema["item_id"].dataType, T.IntegerType
        ) else pa.int64()
        out = out.unionByName(docs.select(key, "text").mapInArrow(scan, schema))
    return out


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    width: int = WIDTH,
    containment: float = CONTAINMENT,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """The documents that contain no item, with their columns; see contained_items."""
    bounded_batches(docs.sparkSession)
    at, out, docs_schema = docs.columns.index("text"), docs, docs.schema
    for block in blocks(items, width, containment, block_shingles):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, _, _ in sent.value.found(batch.column(at))]] = False
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(clean)).columns, names=docs_schema.names)

        out = numbered(out).mapInArrow(scan, docs_schema)
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_found", F.round("containment", 6).alias("containment"))


OP4_SQL = f"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') FROM benchmark),
shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[k : k + {WIDTH} - 1], ' ') AS s
  FROM (SELECT kind, id, w, UNNEST(range(1, len(w) - {WIDTH} + 2)) AS k FROM words WHERE len(w) >= {WIDTH}) t),
items AS (SELECT id AS item_id, s, COUNT(*) OVER (PARTITION BY id) AS n_shingles FROM shingles WHERE kind = 'i'),
hits AS (
  SELECT d.id AS doc_id, i.item_id, i.n_shingles, COUNT(*) AS n_found
  FROM shingles d JOIN items i ON d.s = i.s WHERE d.kind = 'd' GROUP BY ALL)
SELECT doc_id, item_id, CAST(n_shingles AS INTEGER) AS n_shingles, CAST(n_found AS INTEGER) AS n_found,
       ROUND(n_found / n_shingles, 6) AS containment
FROM hits WHERE n_found >= CEIL({CONTAINMENT} * n_shingles - 1e-9)
"""
