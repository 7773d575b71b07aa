"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that a Python stage holds at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of Python stages are bounded by rows and by bytes, so long texts can't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the cluster's `spark.checkpoint.dir`, else the one that the context has, else, with
    a local master only (tests), a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        named = sc.getCheckpointDir()
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared checkpoint folder: it survives lost executors and ends the lineage.

    Unlike a checkpoint it also ends what the optimizer knows of the columns, which grows with each round of a loop.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `checkpointed` wrote and that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df._written)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: A key is hot if it has more than a SHARE-th of all rows, and more than HOT_ROWS: so at most SHARE keys are.
SHARE, HOT_ROWS = 1000, 2000


def spread_join(
    rows: DataFrame, lookup: DataFrame, key: str, by: str, sizes: DataFrame, total: int | None = None, how: str = "inner"
) -> DataFrame:
    """`rows` joined with `lookup` on `key`, without all rows of a hot key in one task.

    sizes (key, n) says how many rows a key has, once a key (keys without a row there count as cold); total is its sum.
    Rows of a hot key are dealt by `by` into parts of a SHARE-th of all rows each, and the lookup's row goes to every
    part. Hot keys, at most SHARE of them, are broadcast.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0 if total is None else total
    most = max(total // SHARE, HOT_ROWS)
    if total <= most:  # so no key has more
        return rows.join(lookup, key, how)
    hot = sizes.where(F.col("n") > most).select(
        F.col(key).alias("__hot"), F.ceil(F.col("n") / most).cast("int").alias("__parts")
    )

    def parted(df: DataFrame, part: Column) -> DataFrame:
        told = df.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")  # at most SHARE rows
        return told.withColumn("__part", part).drop("__hot", "__parts")

    some = F.coalesce("__parts", F.lit(1))
    ours = parted(rows, F.pmod(F.xxhash64(by), some).cast("int"))
    theirs = parted(lookup, F.explode(F.sequence(F.lit(0), some - 1)))
    return ours.join(theirs, [key, "__part"], how).drop("__part")


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """`df` with a broadcast hint if it has at most `max_rows` rows, else unchanged (a shuffled join)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def by_name(columns: list[str]) -> list[Column]:
    """Columns by their exact names, which may hold dots."""
    return [F.col(f"`{c}`") for c in columns]


def numbered(df: DataFrame) -> DataFrame:
    """`df` with columns c0, c1, ...: mapInArrow looks its input columns up by names, which can't hold dots."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def with_columns(df: DataFrame, columns: dict) -> DataFrame:
    """Adds columns; one of the same name (in any case) that `df` already has is replaced."""
    names = {c.lower() for c in columns}
    keep = by_name([c for c in df.columns if c.lower() not in names])
    return df.select(*keep, *[v.alias(c) for c, v in columns.items()])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words `[^\\x20\\x09-\\x0D]+` of all texts in a row, and each text's word count (null: none)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat = parts.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0)
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    return flat.filter(full), np.diff(ends[offsets])


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; every distinct word of the batch is hashed once."""
    coded = words.dictionary_encode()
    known = [xxhash.xxh3_64_intdigest(w, seed) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    return np.array(known, dtype=np.uint64)[coded.indices.to_numpy()] if known else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each input bit over all output bits (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling_hashes(codes: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of every `width` consecutive codes; `base` is odd."""
    n = max(0, len(codes) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):  # Horner's rule over whole arrays
            out = out * np.uint64(base) + codes[k : k + n]
    return out
