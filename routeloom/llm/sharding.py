"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from routeloom.llm.common import bounded_batches, by_name, table, with_columns

SHARDS = 8
#: Groups of rows in which each shard is numbered; the table of their sizes, shards x blocks rows, is broadcast.
BLOCKS = 1024
#: Multiplier of the generator that the method prescribes.
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to `shards` - 1, of each 64-bit key.

    A key's shard is the last of its jump points below `shards`, so one more shard takes a 1/(shards + 1) part of
    the keys, all of it into itself. Every round moves all keys that have not passed the end yet.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    shard, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(live):
            shard[live] = ahead[live]
            state[live] = state[live] * MULTIPLIER + np.uint64(1)
            step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            ahead[live] = np.minimum((shard[live] + 1) * step, float(shards)).astype(np.int64)
            live = live[ahead[live] < shards]
    return shard.astype(np.int32)


def jump_column(key: Column, shards: int) -> Column:
    @F.pandas_udf(T.IntegerType())
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return place(key)


def stable_key(docs: DataFrame, key: str) -> Column:
    """An integer column is its own key, anything else is hashed; null counts as 0."""
    whole = isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.coalesce(
        F.col(key).cast("long"), F.lit(0)
    ) if whole else F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.xxhash64(key))


def hashable(kind: T.DataType) -> bool:
    """Whether Spark can hash the type: maps, and what holds them, can't be."""
    return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", blocks: int = BLOCKS
) -> DataFrame:
    """`docs` with shard, grown_shard (the shard if there were one more) and slot (0, 1, ... within the shard).

    Only the key and the number of shards decide. Rows of equal keys (copies of a row, or all null keys, which count
    as 0) share a shard and get slots of their own, in the order of the row's hash, so slots don't depend on partitions
    or settings; rows that agree in everything are interchangeable. A shard is numbered in `blocks` blocks of its rows,
    each its own group: the blocks' sizes give the number at which each starts, so no task sees a whole shard or all
    rows of one key. An empty table gives an empty result; columns named shard, grown_shard or slot are replaced, other columns stay.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    # rows of one key are dealt by the hash of the whole row, so many copies, or null keys, don't lie in one block
    row = F.xxhash64(*by_name([c for c in docs.columns if hashable(docs.schema[c].dataType)]))
    keyed = with_columns(docs, {"__key": stable_key(docs, key), "__row": row})
    block = F.pmod(F.xxhash64("__key", "__row"), F.lit(blocks)).cast("int")
    counts = keyed.select("__key", "__row").select(
        jump_column(F.col("__key"), shards).alias("__shard"), block.alias("__block")
    ).groupBy("__shard", "__block").count()
    before = W.partitionBy("__shard").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("__shard", "__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    placed = with_columns(
        keyed,
        {
            "shard": jump_column(F.col("__key"), shards),
            "grown_shard": jump_column(F.col("__key"), shards + 1),
            "__block": block,
        },
    )
    joined = placed.join(  # at most shards x blocks rows
        F.broadcast(starts.withColumnRenamed("__block", "__b")),
        (F.col("shard") == F.col("__shard")) & (F.col("__block") == F.col("__b")),
    )
    order = W.partitionBy("shard", "__block").orderBy("__key", "__row")
    return with_columns(
        joined, {"slot": F.col("__start") + F.row_number().over(order) - 1}
    ).drop("__key", "__row", "__block", "__b", "__shard", "__start")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    small = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = shard_documents(small)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        "grown_shard",
    )
