"""Near duplicates by SimHash fingerprints (Charikar, 2002), compared bit-sliced."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.llm.common import bounded_batches, by_name, checkpointed, spread_join, table
from routeloom.llm.components import components

WORDS, SEED, RADIUS = 3, 42, 3
#: A bucket of more fingerprints is compared in pairs of chunks of this size.
CHUNK = 4096
#: Distances (64 to a number) that are updated at a time.
BLOCK = 1 << 16
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's shingles, repeats included.

    The shingle of a text of fewer words is its whole sequence; a null text, or one without words, has fingerprint 0.
    """
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    last = min(words, len(parts)) - 1
    starts = (ends - lengths)[: len(parts) - last].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[last:].tolist())], dtype="<u8")
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        count += np.unpackbits(
            hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        ).sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(key, fp) of each row; fp is the fingerprint as a signed number."""
    bounded_batches(docs.sparkSession)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame(
                {key: pdf[key], "fp": np.array([fingerprint(t, words) for t in pdf["text"]], np.uint64).view(np.int64)}
            )

    return docs.select(key, "text").mapInPandas(
        scan, T.StructType([docs.schema[key], T.StructField("fp", T.LongType())])
    )


@dataclass(frozen=True)
class Blocks:
    """Fingerprints of groups, 64 to a block, each block stored as one number a bit: its bit planes."""

    planes: np.ndarray
    absent: np.ndarray  # the places of a block that hold no fingerprint
    row: np.ndarray  # the fingerprint at each place
    slot: np.ndarray  # the place of each fingerprint
    first: np.ndarray  # the first block of each group
    count: np.ndarray  # the blocks of each group


def bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp, "<u8").view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")


def blocks(fp: np.ndarray, group: np.ndarray, groups: int) -> Blocks:
    """fp has a row of 64-bit words for each fingerprint; equal numbers of `group` (0 to groups - 1) are adjacent."""
    size = np.bincount(group, minlength=groups)
    count = (size + 63) // 64
    first, total, width = np.cumsum(count) - count, int(count.sum()), 64 * fp.shape[1]
    place = np.arange(len(fp)) - (np.cumsum(size) - size)[group]
    slot = (first[group] + place // 64) * 64 + place % 64
    bits = np.zeros((total * 64, width), np.uint8)
    bits[slot] = bits_of(fp)
    planes = np.packbits(bits.reshape(total, 64, width), axis=1, bitorder="little").transpose(0, 2, 1).copy()
    held = np.zeros(total * 64, np.uint8)
    held[slot] = 1
    absent = ~np.packbits(held.reshape(total, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    row = np.full(total * 64, -1)
    row[slot] = np.arange(len(fp))
    return Blocks(planes.view("<u8")[:, :, 0], absent, row, slot, first, count)


def within(
    fp: np.ndarray, held: Blocks, row: np.ndarray, block: np.ndarray, over: np.ndarray, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row of the block's fingerprint) for each fingerprint fp[row] and each of its block within the radius.

    Plane after plane is added to as many counter planes as the radius has bits, 64 distances at a time: each plane's
    carry goes into the next one, and the last one's into an overflow plane, `over`. Counters start so high that they
    overflow just above the radius. Entries whose 64 distances have all overflowed leave after every eighth plane.
    """
    digits = radius.bit_length()
    head = (1 << digits) - 1 - radius
    counters = [np.full(len(row), FULL if head >> d & 1 else 0, np.uint64) for d in range(digits)]
    for k in range(held.planes.shape[1]):
        own = (fp[row, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
        carry = held.planes[block, k] ^ (np.uint64(0) - own)
        for d in range(digits):
            counters[d], carry = counters[d] ^ carry, counters[d] & carry
        over = over | carry
        if k % 8 == 7:
            live = over != FULL
            if not live.all():
                row, block, over = row[live], block[live], over[live]
                counters = [c[live] for c in counters]
    for k in range(0, len(row), 1 << 14):
        found, bit = np.nonzero(bits_of(~over[k : k + (1 << 14), None]))
        yield row[k + found], held.row[block[k + found] * 64 + bit]


def entries(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, block) for each row's `count` blocks from `first` on, at most BLOCK at a time."""
    done = np.cumsum(count)
    for low in range(0, int(done[-1]) if len(done) else 0, BLOCK):
        entry = np.arange(low, min(low + BLOCK, int(done[-1])))
        row = np.searchsorted(done, entry, side="right")
        yield row, first[row] + entry - (done[row] - count[row])


def near(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of fingerprints of one group that differ in at most `radius` bits; equal groups are adjacent."""
    fp, of = fp.reshape(len(fp), -1), np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    held = blocks(fp, of, int(of[-1]) + 1)
    own, upto = held.slot // 64, (held.slot % 64).astype(np.uint64)
    for row, block in entries(own, held.first[of] + held.count[of] - own):
        before = np.where(block == own[row], FULL >> (np.uint64(63) - upto[row]), np.uint64(0))
        yield from within(fp, held, row, block, held.absent[block] | before, radius)


def spanning(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n places the smallest one that the links connect it with."""
    root = np.arange(n)
    for a, b in links:
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low != high
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(root, high[apart], low[apart])
            while (root != root[root]).any():
                root = root[root]
    return root


def bucket_links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) that span each bucket's connected fingerprints, from rows sorted by bucket; a bucket may cross batches."""
    rest = pd.DataFrame()

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf[["bucket", "low", "high"]].to_numpy()
        group = np.concatenate([[0], np.cumsum((name[1:] != name[:-1]).any(1))])
        fp = pdf["fp"].to_numpy()
        root = spanning(len(fp), near(fp.view(np.uint64), group))
        linked = root != np.arange(len(fp))
        return pd.DataFrame({"a": fp[linked], "b": fp[root[linked]]})

    for pdf in frames:
        pdf = pd.concat([rest, pdf], ignore_index=True)
        if pdf.empty:
            continue
        last = (pdf[["bucket", "low", "high"]] == pdf[["bucket", "low", "high"]].iloc[-1]).all(axis=1).to_numpy()
        rest = pdf[last]
        if not last.all():
            yield links(pdf[~last])
    if len(rest):
        yield links(rest)


def bucket_keys(fp: Column) -> Column:
    """16 numbers such that fingerprints within RADIUS = 3 bits share one at least.

    Of four 16-bit parts one is equal, and of the other 48 bits, again in four parts, one 12-bit part is equal.
    """
    keys = []
    for i in range(4):
        part = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
        upper = F.shiftleft(F.shiftrightunsigned(fp, 16 * i + 16), 16 * i) if i < 3 else F.lit(0).cast("long")
        other = upper.bitwiseOR(fp.bitwiseAND(F.lit((1 << 16 * i) - 1)))
        for j in range(4):
            sub = F.shiftrightunsigned(other, 12 * j).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((4 * i + j) << 28) + F.shiftleft(part, 12) + sub)
    return F.array(*keys)


def fingerprint_links(fps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints fp that links of at most RADIUS bits connect.

    Buckets are read in sorted runs, and a bucket of over `chunk` fingerprints as pairs of chunks, each a task's
    work of its own, so no task holds more than two chunks and every pair of a bucket is still compared.
    """
    rows = fps.select("fp", F.explode(bucket_keys(F.col("fp"))).alias("bucket"))
    shared = checkpointed(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    sized = spread_join(rows, shared, "bucket", "fp", shared)
    parts = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    chunked = sized.withColumn("parts", parts).withColumn("own", own)
    other = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda c: c != F.col("own"))
    )
    paired = chunked.select("fp", "bucket", "own", F.explode(other).alias("other"))
    named = paired.select(
        "fp", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    )
    return named.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high").mapInPandas(
        bucket_links, "a long, b long"
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(key, fp, component_id) of each row: component_id is the smallest key among all rows whose fingerprints links reach.

    Rows of equal fingerprints, such as copies, empty or null texts, are linked like any other; null keys don't
    count as smallest (a component of null keys only has a null id). An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    base = checkpointed(fingerprints(docs, key, words))
    first = checkpointed(base.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n")))
    roots = components(fingerprint_links(first.select("fp"))).withColumnRenamed("node", "fp")
    rooted = first.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = checkpointed(rooted.join(least, "root").select("fp", "component_id"))
    return spread_join(base, known, "fp", key, first).select(key, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """One document of each component of `groups` stays, the one of the smallest doc_id; columns stay as they are.

    Rows of one doc_id are one document, of which one row stays. A row without doc_id can't be named and stays.
    """
    named = groups(docs.where("doc_id IS NOT NULL"))
    kept = checkpointed(named.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("__rows")))
    rows = docs.join(kept.where("__rows = 1"), "doc_id", "left_semi").select(*by_name(docs.columns))
    repeated = kept.where("__rows > 1")
    if not repeated.isEmpty():
        rows = rows.unionByName(
            docs.join(repeated, "doc_id", "left_semi").select(*by_name(docs.columns)).dropDuplicates(["doc_id"])
        )
    return rows.unionByName(docs.where("doc_id IS NULL"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
