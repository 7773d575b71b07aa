"""Mixing sources to target weights by Poisson replication; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import broadcast_if_small, checkpointed, table, with_columns

SEED = 42
#: Without given weights, a source weighs its size to this power: small sources are repeated, large ones thinned.
ALPHA = 0.5
#: A mean above this is drawn as a sum of independent draws, so exp(-mean) can't vanish and the table stays short.
MAX_MEAN = 256.0
#: The rates are broadcast up to so many sources (each with at most about 440 numbers), else joined by shuffle.
MAX_BROADCAST_SOURCES = 2000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that the parts decide: 52 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_table(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to more than ten standard deviations above the mean."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(
        F.sequence(F.lit(1), F.ceil(mean + 10 * F.sqrt(mean) + 20).cast("int")), start, step, lambda s: s["cdf"]
    )


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """Per source: its size (code points of its texts, plus one a row), weight and mean repetition rate.

    Rates keep the corpus' total size: rate = weight share x total size / size of the source. A source that `weights`
    doesn't name weighs 0.
    """
    sizes = docs.groupBy(F.col("source").alias("__source")).agg(
        F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1).alias("size")
    )
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(ALPHA))
    else:
        if any(not w >= 0 or w == float("inf") for w in weights.values()):
            raise ValueError("weights are finite and not negative")
        weight = F.lit(0.0)
        for k, w in weights.items():
            weight = F.when(F.col("__source").eqNullSafe(F.lit(k)), F.lit(float(w))).otherwise(weight)
    sized = sizes.withColumn("weight", weight)
    total = sized.agg(F.sum("size").alias("__size"), F.sum("weight").alias("__weight"))
    return sized.join(F.broadcast(total)).select(
        "__source",
        "size",
        "weight",
        F.when(
            F.col("__weight") > 0, F.col("weight") / F.col("__weight") * F.col("__size") / F.col("size")
        ).otherwise(F.lit(0.0)).alias("rate"),
    )


def replicate(
    docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = SEED, key: str = "doc_id"
) -> DataFrame:
    """mix_sources with __rate, __copy and __mix_key, beside whatever columns `docs` has."""
    rates = checkpointed(source_rates(docs, weights))
    parts = F.greatest(F.ceil(F.col("rate") / MAX_MEAN), F.lit(1)).cast("int")
    tables = rates.select(
        "__source",
        F.col("rate").alias("__rate"),
        parts.alias("__parts"),
        poisson_table(F.col("rate") / parts).alias("__cdf"),
    )
    rated = docs.join(broadcast_if_small(tables, MAX_BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("__source")))

    def drawn(total: Column, part: Column) -> Column:
        u = uniform(F.lit(str(seed)), F.col(key).cast("string"), part.cast("string"))
        return total + F.size(F.filter("__cdf", lambda c: c <= u))

    count = F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), drawn)
    counted = with_columns(rated, {"__count": count}).where("__count > 0")
    copies = with_columns(counted, {"__copy": F.explode(F.sequence(F.lit(1), F.col("__count")))})
    keyed = with_columns(
        copies,
        {
            "__mix_key": F.md5(
                F.concat_ws(":", F.lit(f"{seed}/order"), F.col(key).cast("string"), F.col("__copy").cast("string"))
            )
        },
    )
    return keyed.drop(
        "__source", "__parts", "__cdf", "__count"
    ).repartition("__mix_key").sortWithinPartitions("__mix_key")


def mix_sources(
    docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = SEED, key: str = "doc_id"
) -> DataFrame:
    """Each row as often as a Poisson draw with its source's rate says, in a global random order.

    The draw inverts the distribution at a hash of the seed and the row's key, so it depends on nothing else: reruns,
    partitions and lost executors don't change it, and rows of one key (copies of a row; null keys, which hash as
    missing) get equal counts. Adds rate, copy (1, 2, ...) and mix_key; the copies are dealt by mix_key's hash and
    sorted by it, which is a random permutation of the whole output. A null source is a source of its own; empty
    texts weigh one; an empty table gives an empty result; columns of the added names are replaced.
    """
    mixed = replicate(docs, weights, seed, key)
    added = {"rate": "__rate", "copy": "__copy", "mix_key": "__mix_key"}
    return with_columns(mixed, {k: F.col(v) for k, v in added.items()}).drop(*added.values())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", F.round("rate", 6).alias("rate"), "copy", "mix_key", "text")


OP2_SQL = f"""
WITH sizes AS (
  SELECT source, CAST(SUM(COALESCE(LENGTH(text), 0) + 1) AS BIGINT) AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, POWER(CAST(size AS DOUBLE), {ALPHA}) / SUM(POWER(CAST(size AS DOUBLE), {ALPHA})) OVER ()
         * SUM(size) OVER () / size AS rate FROM sizes),
parts AS (
  SELECT source, rate, CAST(GREATEST(CEIL(rate / {MAX_MEAN}), 1) AS INTEGER) AS parts FROM rates),
terms AS (
  SELECT p.source, k, EXP(-rate / parts + k * LN(rate / parts) - LGAMMA(k + 1)) AS p
  FROM parts p, LATERAL (SELECT UNNEST(RANGE(0, CAST(CEIL(rate / parts + 10 * SQRT(rate / parts) + 20) AS BIGINT) + 1)) AS k) t),
cdf AS (
  SELECT source, LIST(c ORDER BY k) AS cdf
  FROM (SELECT source, k, SUM(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) t GROUP BY source),
drawn AS (
  SELECT d.doc_id, d.source, d.text, r.rate,
         LIST_SUM(LIST_TRANSFORM(RANGE(1, r.parts + 1), lambda j: LEN(LIST_FILTER(c.cdf, lambda x:
           x <= CAST(('0x' || SUBSTR(MD5(CONCAT_WS(':', '{SEED}', d.doc_id, j)), 1, 13)) AS BIGINT) / 4503599627370496.0)))) AS n
  FROM documents d JOIN parts r ON d.source IS NOT DISTINCT FROM r.source JOIN cdf c ON c.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, source, ROUND(rate, 6) AS rate, CAST(copy AS INTEGER) AS copy,
       MD5(CONCAT_WS(':', '{SEED}/order', doc_id, copy)) AS mix_key, text
FROM (SELECT *, UNNEST(RANGE(1, CAST(n AS BIGINT) + 1)) AS copy FROM drawn WHERE n > 0) t
"""
