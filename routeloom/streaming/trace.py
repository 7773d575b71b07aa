"""Search traces as streams of display steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from routeloom.plans.schema import TRACE

FRONTIER_SHOWN, SAMPLE_RATE = 80, 1


def display_steps(trace: DataFrame, rate: int = SAMPLE_RATE, shown: int = FRONTIER_SHOWN) -> DataFrame:
    """The expansions of each search as a display gets them: a short frontier, and only the newly visited node.

    Works on a stream too: how many nodes were visited is read from the step itself, so no step has to see another.
    Every rate-th expansion is kept, and the first. A brief trace, of at least `shown` entries, gives the same.
    """
    brief = "visited_size" in trace.columns
    number, waiting = (F.col(f"{c}_size") if brief else F.size(c) for c in ("visited", "frontier"))
    steps = trace.where("event = 'expand'").where((number == 1) | (number % rate == 0))
    more = F.map_from_arrays(
        F.array(*map(F.lit, ("visited_count", "frontier_count", "sample_rate", "visited_encoding"))),
        F.array(number.cast("string"), waiting.cast("string"), F.lit(str(rate)), F.lit("delta")),
    )
    return steps.select(
        "request_id",
        "index",
        "event",
        "current_node",
        F.slice("frontier", 1, shown).alias("frontier"),
        F.array().cast("array<string>").alias("visited"),
        F.array("current_node").alias("visited_delta"),
        F.map_concat(
            F.map_filter(
                "details", lambda k, _: ~k.isin("visited_count", "frontier_count", "sample_rate", "visited_encoding")
            ),
            more,
        ).alias("details"),
    )


def messages(trace: DataFrame, results: DataFrame) -> DataFrame:
    """(request_id, seq, type, body): the whole protocol of each request: started, steps in order, complete."""
    steps = display_steps(trace).select(
        "request_id",
        (F.row_number().over(W.partitionBy("request_id").orderBy("index"))).alias("seq"),
        F.lit("step").alias("type"),
        F.to_json(F.struct("index", "event", "current_node", "frontier", "visited_delta", "details")).alias("body"),
    )
    started = results.select(
        "request_id",
        F.lit(0).alias("seq"),
        F.lit("started").alias("type"),
        F.to_json(F.struct("start", "goal", "algorithm")).alias("body"),
    )
    ended = results.select(
        "request_id",
        (F.col("expanded_nodes") + 1).alias("seq"),
        F.lit("complete").alias("type"),
        F.to_json(F.struct("success", "path", "total_cost", "message")).alias("body"),
    )
    return started.unionByName(steps).unionByName(ended)


def read_trace_stream(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """A stream of the trace rows that land as Parquet in a folder; a batch takes so many files, which bounds its size."""
    return spark.readStream.schema(f"request_id long, {TRACE}").option(
        "maxFilesPerTrigger", files_a_batch
    ).parquet(path)


def stream_steps(trace: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands the display steps of each micro-batch, in order, to a callback, until what has landed is done."""
    return display_steps(trace).writeStream.foreachBatch(
        lambda df, k: handle(df.orderBy("request_id", "index"), k)
    ).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
