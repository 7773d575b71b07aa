"""Substring dedup: repeated word windows, found by Rabin-Karp hashes, merge into maximal removal intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.llm.common import bounded_batches, by_name, mixed, numbered, rolling_hashes, split_words, table, word_hashes

WINDOW = 20
#: Windows that a task hashes before it sends them on.
RUN_WORDS = 1_000_000
#: Bytes of text whose windows are sorted and counted at a time, about 24 bytes of memory a window.
BUCKET_BYTES = 32 << 20
LAST = np.iinfo(np.int64).max


def planes(x: np.ndarray) -> bytes:
    """Little-endian numbers byte by byte of equal weight, so that the zeros of small numbers lie together for the codec."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(data: memoryview, dtype: str, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8, n * size).reshape(size, n).T.copy().view(dtype)[:, 0]


def packed(hashes: np.ndarray, ordinals: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted window hashes with the places of their first words in a run of documents, and the run's ids and word counts."""
    head = np.array([len(hashes), len(ids)], "<u8").tobytes()
    return zstandard.compress(
        head + planes(
            np.diff(hashes, prepend=np.uint64(0)).astype("<u8")
        ) + planes(ordinals.astype("<u4")) + planes(np.diff(ids, prepend=np.int64(0)).astype("<i8")) + planes(counts.astype("<u4")),
        1,
    )


def placed(hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> bytes:
    """Sorted window hashes with the id and first word of each."""
    head = np.array([len(hashes), 0], "<u8").tobytes()
    sizes = planes(np.diff(hashes, prepend=np.uint64(0)).astype("<u8"))
    return zstandard.compress(head + sizes + planes(ids.astype("<i8")) + planes(starts.astype("<u4")), 1)


def count_of(data: bytes) -> int:
    """The windows of a packed blob."""
    return int.from_bytes(zstandard.ZstdDecompressor().stream_reader(data).read(8), "little")


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, id, first word) of each window that `packed` or `placed` took."""
    view = memoryview(zstandard.decompress(data))
    n, docs = (int(x) for x in np.frombuffer(view, "<u8", 2))
    if not docs:
        return (
            np.cumsum(unplanes(view[16:], "<u8", n), dtype=np.uint64),
            unplanes(view[16 + 8 * n :], "<i8", n),
            unplanes(view[16 + 16 * n :], "<u4", n).astype(np.int64),
        )
    hashes = np.cumsum(unplanes(view[16:], "<u8", n), dtype=np.uint64)
    ordinals = unplanes(view[16 + 8 * n :], "<u4", n).astype(np.int64)
    ids = np.cumsum(unplanes(view[16 + 12 * n :], "<i8", docs), dtype=np.int64)
    ends = np.cumsum(unplanes(view[16 + 12 * n + 8 * docs :], "<u4", docs).astype(np.int64))
    at = np.searchsorted(ends, ordinals, side="right")
    return hashes, ids[at], ordinals - np.concatenate([[0], ends])[at]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal intervals that the intervals, end exclusive, cover together."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], starts[1:] > ends[:-1]])[: len(starts)]
    last = np.flatnonzero(fresh)[1:] - 1
    return starts[fresh], np.append(ends[last], ends[-1:])


def hash_runs(width: int, buckets: int):
    """Batches of (id, text) to rows (bucket, windows, removed): a run's distinct windows, each with its first place in the
    run, dealt by hash into buckets; removed has the intervals of windows that start earlier within the run itself."""

    def run(ids: np.ndarray, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        words, counts = split_words(texts.take(pa.array(order)))
        windows = mixed(rolling_hashes(word_hashes(words), width))
        ends = np.cumsum(counts)
        doc = np.repeat(np.arange(len(ids)), counts)
        place = np.flatnonzero(doc[: len(windows)] == doc[width - 1 :][: len(windows)])
        hashes, first = np.unique(windows[place], return_index=True)
        later = np.ones(len(place), bool)
        later[first] = False
        # a repeated row's windows meet themselves at an equal (id, start), which is not earlier
        if (ids[1:] == ids[:-1]).any():
            start = place - (ends - counts)[doc[place]]
            twin = first[np.searchsorted(hashes, windows[place])]
            later &= (ids[doc[place]] != ids[doc[place[twin]]]) | (start != start[twin])
        removed = None
        if later.any():
            apart = place[later] + doc[place[later]]  # a gap after each document, so that no interval crosses it
            low, high = merged(apart, apart + width)
            at = doc[place[later][np.searchsorted(apart, low)]]
            removed = np.stack(
                [ids[at], low - at - (ends - counts)[at], high - at - (ends - counts)[at]]
            ).astype("<i8").tobytes()
        step = (1 << 64) // buckets + 1
        cut = np.searchsorted(hashes, np.array([min(k * step, (1 << 64) - 1) for k in range(buckets + 1)], np.uint64))
        cut[-1] = len(hashes)
        used = [k for k in range(buckets) if cut[k] < cut[k + 1]]
        rows = [
            (k, packed(hashes[cut[k] : cut[k + 1]], place[first[cut[k] : cut[k + 1]]], ids, counts), None) for k in used
        ]
        if removed:
            rows.append((int(ids[0] % buckets), None, removed))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([r[1] for r in rows], pa.binary()),
                    pa.array([r[2] for r in rows], pa.binary()),
                ],
                names=["bucket", "windows", "removed"],
            )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            texts.append(batch.column(1).cast(pa.large_string()))
            size += batch.column(1).nbytes
            if size >= 6 * RUN_WORDS:
                yield from run(np.concatenate(ids), pa.concat_arrays(texts))
                ids, texts, size = [], [], 0
        if ids:
            yield from run(np.concatenate(ids), pa.concat_arrays(texts))

    return scan


def finer(buckets: int, parts: int):
    """Rows of hash_runs to rows (bucket, windows, removed): a bucket's windows dealt by hash into `parts` parts.

    Blobs are joined until they hold RUN_WORDS windows, so parts stay large enough to pack well.
    """

    def split(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        hashes, ids, starts = (np.concatenate(x) for x in zip(*map(unpacked, blobs)))
        order = np.lexsort((starts, ids, hashes))
        hashes, ids, starts = hashes[order], ids[order], starts[order]
        step = (1 << 64) // (buckets * parts) + 1
        part = (hashes // np.uint64(step)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for low, high in zip(edge, [*edge[1:], len(part)]):
            # each window counts as a document of its own here: its id, and its start as the words before it
            yield batch([int(part[low])], [placed(hashes[low:high], ids[low:high], starts[low:high])], [None])

    def batch(part: list, windows: list, removed: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array(windows, pa.binary()), pa.array(removed, pa.binary())],
            names=["bucket", "windows", "removed"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, held = [], 0
        for rows in batches:
            for windows, removed in zip(*(c.to_pylist() for c in rows.columns[1:])):
                if removed:
                    yield batch([-1], [None], [removed])
                    continue
                blobs.append(windows)
                held += count_of(windows)
                if held >= RUN_WORDS:
                    yield from split(blobs)
                    blobs, held = [], 0
        if blobs:
            yield from split(blobs)

    return scan


def later_windows(width: int):
    """Rows of hash_runs or finer, sorted by bucket, to rows (id, span): each window that starts earlier elsewhere, and the
    runs' own intervals. A span is start * 2**32 + end."""

    def rows(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(ids.astype(np.int64)), pa.array((starts << 32) + ends)], names=["__id", "span"]
        )

    def bucket(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        hashes, ids, starts = (np.concatenate(x) for x in zip(*map(unpacked, blobs)))
        order = np.argsort(hashes, kind="stable")
        same = np.concatenate([[False], hashes[order][1:] == hashes[order][:-1]])
        shared = order[same | np.append(same[1:], False)]
        hashes, ids, starts = hashes[shared], ids[shared], starts[shared]
        order = np.lexsort((starts, ids, hashes))
        hashes, ids, starts = hashes[order], ids[order], starts[order]
        lead = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)])
        head = np.repeat(lead, np.diff(np.append(lead, len(hashes))))
        later = (ids != ids[head]) | (starts != starts[head])
        for k in range(0, len(ids), 1 << 18):
            part = later[k : k + (1 << 18)]
            yield rows(
                ids[k : k + (1 << 18)][part], starts[k : k + (1 << 18)][part], starts[k : k + (1 << 18)][part] + width
            )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for key, windows, removed in zip(*(c.to_pylist() for c in batch.columns)):
                if removed:
                    yield rows(*np.frombuffer(removed, "<i8").reshape(3, -1))
                    continue
                if key != now and blobs:
                    yield from bucket(blobs)
                    blobs = []
                now = key
                blobs.append(windows)
        if blobs:
            yield from bucket(blobs)

    return scan


def repeated_spans(
    docs: DataFrame, key: str = "doc_id", width: int = WINDOW, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """(__id, __spans): per key the spans, unmerged, of windows whose words also start earlier (smaller key, or same key, earlier start).

    A null key counts as the largest. Every window's hash (64 bits) reaches the bucket of its hash once for each run of
    documents that holds it, so a passage that many documents share is combined before the shuffle. Buckets of more than
    `bucket_bytes` of text are dealt again, within their partition, so what a task sorts at a time doesn't grow with the
    data.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = id_of(docs, key)
    runs = docs.select(ids.alias("__id"), "text").mapInArrow(
        hash_runs(width, buckets), "bucket int, windows binary, removed binary"
    )
    dealt = runs.repartition("bucket")
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-held // (buckets * bucket_bytes))
    if parts > 1:  # the second deal is local; Spark sorts its parts and spills them
        dealt = dealt.mapInArrow(finer(buckets, parts), "bucket long, windows binary, removed binary")
    return dealt.sortWithinPartitions("bucket").mapInArrow(
        later_windows(width), "__id long, span long"
    ).groupBy("__id").agg(F.collect_list("span").alias("__spans"))


def id_of(docs: DataFrame, key: str) -> Column:
    """A key as a number: integers are their own, null the largest. Other types raise: no order of theirs is stated."""
    if not isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{key} must be an integer column")
    return F.coalesce(F.col(key).cast("long"), F.lit(int(LAST)))


def kept_words(text: bytes | None, spans: np.ndarray) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
    """A text's words, those that stay, and the maximal removed intervals (first word, end)."""
    words = (text or b"").split()
    if len(spans) == 0:
        none = np.zeros(0, np.int64)
        return words, words, none, none
    spans = spans.astype(np.int64)
    low, high = merged(spans >> 32, np.minimum(spans & 0xFFFFFFFF, len(words)))
    left = []
    for a, b in zip(np.concatenate([[0], high]).tolist(), [*low.tolist(), len(words)]):
        left += words[a:b]
    return words, left, low, high


def dedup_substrings(
    docs: DataFrame, key: str = "doc_id", width: int = WINDOW, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """`docs` with kept_text (the words that stay, joined by one space), n_words, n_removed, kept_sha256 and removed.

    A word goes if a window of `width` consecutive words that covers it also starts earlier; windows are judged on the
    input. removed has the maximal intervals (start, end) of removed words. A text of fewer words, empty or null has
    no windows and keeps all words. Rows of one key are taken as repeats of one document: none is earlier than the
    other, and an interval goes from each. The key is an integer column; others raise TypeError. Columns of the added names are replaced; an empty table gives an empty result.
    """
    found = repeated_spans(docs, key, width, bucket_bytes)
    added = {
        "kept_text": "string",
        "n_words": "long",
        "n_removed": "long",
        "kept_sha256": "string",
        "removed": "array<struct<start:int,end:int>>",
    }
    kept = [c for c in docs.columns if c.lower() not in added]
    ids = id_of(docs, key)

    @F.pandas_udf(T.BinaryType())
    def pack(texts: pd.Series) -> pd.Series:
        codec = zstandard.ZstdCompressor(level=1)
        return texts.map(lambda t: None if t is None else codec.compress(t.encode("utf-8", "replace")))

    base = docs.select(
        *[pack("text").alias("text") if c == "text" else F.col(f"`{c}`") for c in kept], ids.alias("__id")
    )
    joined = base.join(found, "__id", "left").select(*by_name(kept), "__spans")
    schema = T.StructType(
        [*[docs.schema[c] for c in kept], *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in added.items())).fields]
    )
    text_at = kept.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            spans = batch.column(len(kept))
            offsets, flat = spans.offsets.to_numpy(), spans.values.to_numpy(zero_copy_only=False)
            whole = [None if z is None else codec.decompress(z) for z in batch.column(text_at).to_pylist()]
            got = [kept_words(t, flat[a:b]) for t, a, b in zip(whole, offsets, offsets[1:])]
            texts = [b" ".join(left) for _, left, _, _ in got]
            own = list(batch.columns[: len(kept)])
            own[text_at] = pa.array(whole, pa.binary()).cast(pa.string())
            more = [
                pa.array(texts, pa.binary()).cast(pa.string()),
                pa.array([len(w) for w, _, _, _ in got], pa.int64()),
                pa.array([len(w) - len(k) for w, k, _, _ in got], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                pa.array(
                    [[{"start": a, "end": b} for a, b in zip(lo.tolist(), hi.tolist())] for _, _, lo, hi in got],
                    span_type,
                ),
            ]
            yield pa.RecordBatch.from_arrays(own + more, names=schema.names)

    return numbered(joined).mapInArrow(cut, schema)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP8_SQL = f"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(COALESCE(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
places AS (
  SELECT doc_id, k, w[k] AS word, CASE WHEN k + {WINDOW} - 1 <= len(w) THEN array_to_string(w[k : k + {WINDOW} - 1], ' ') END AS s
  FROM (SELECT doc_id, w, UNNEST(range(1, len(w) + 1)) AS k FROM words) t),
flagged AS (
  SELECT doc_id, k, word, CASE WHEN s IS NOT NULL AND ROW_NUMBER() OVER (PARTITION BY s ORDER BY doc_id, k) > 1 THEN 1 ELSE 0 END AS later FROM places),
covered AS (
  SELECT doc_id, k, word, MAX(later) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM flagged),
kept AS (
  SELECT doc_id, COUNT(*) AS n_words, CAST(SUM(gone) AS BIGINT) AS n_removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY k) AS t
  FROM covered GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n_words, 0) AS n_words, COALESCE(n_removed, 0) AS n_removed, sha256(COALESCE(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
