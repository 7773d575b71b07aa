"""Set-based graph operators: a driver loop whose every round is one distributed join over the whole frontier.

Edges are any frames with src and dst; ids may be numbers or text. Every round is written to the checkpoint folder,
so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROUNDS = 10_000
#: A frontier of up to so many entries is broadcast, so the links of a large graph aren't shuffled each round.
SENT_ENTRIES = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one is taken with a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` in the shared checkpoint folder, in its partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared checkpoint folder, for large frames: what reads it takes its own columns only.

    Unlike a checkpoint it doesn't keep partitions or the order of rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bfs_levels(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, level): how few edges lead from each source to each node that it reaches."""
    links = checkpointed(edges.select("src", "dst").distinct())
    seen = checkpointed(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("level")).distinct())
    frontier = seen
    for level in range(1, MAX_ROUNDS):
        ahead = frontier.join(
            links, F.col("node") == F.col("src")
        ).select("source", F.col("dst").alias("node")).distinct()
        frontier = checkpointed(ahead.join(seen, ["source", "node"], "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            return seen
        seen = checkpointed(seen.unionByName(frontier))
    raise RuntimeError("the search did not end")


def sent(df: DataFrame, entries: int) -> DataFrame:
    """`df`, of so many entries, to be broadcast unless it is large."""
    return F.broadcast(df) if entries <= SENT_ENTRIES else df


def onward(frontier: DataFrame, links: DataFrame, entries: int) -> DataFrame:
    """The entries of a frontier, of so many, with the links (src, ...) that go on from each node."""
    return links.join(sent(frontier, entries), F.col("node") == F.col("src"))


def shortest_paths(edges: DataFrame, sources: DataFrame, cost: str = "cost") -> DataFrame:
    """(source, node, cost, hops, parent): the cheapest way to each node; among equals the fewest hops, then least parent.

    Only entries that got better go into the next round's join, so the work shrinks as costs settle. Of parallel edges
    the cheapest makes the least offer, so they needn't be grouped first; an edge without a cost makes none.
    """
    links = written(edges.select("src", "dst", F.col(cost).alias("w")).where("w IS NOT NULL"))
    start = sources.select("source", F.col("source").alias("node")).distinct()
    zero = F.lit(0).cast(links.schema["w"].dataType)
    state = checkpointed(
        start.select(
            "source",
            "node",
            F.struct(
                zero.alias("cost"),
                F.lit(0).alias("hops"),
                F.lit(None).cast(links.schema["src"].dataType).alias("parent"),
            ).alias("best"),
        )
    )
    frontier, entries = state, state.count()
    for _ in range(MAX_ROUNDS):
        step = F.struct(
            (F.col("best.cost") + F.col("w")).alias("cost"),
            (F.col("best.hops") + 1).alias("hops"),
            F.col("src").alias("parent"),
        )
        offers = onward(frontier.select("source", "node", "best"), links, entries).select(
            "source", F.col("dst").alias("node"), step.alias("offer")
        ).groupBy("source", "node").agg(F.min("offer").alias("offer"))
        merged = checkpointed(
            state.join(offers, ["source", "node"], "full").select(
                "source",
                "node",
                F.when(
                    F.col("best").isNull() | (F.col("offer") < F.col("best")), F.col("offer")
                ).otherwise(F.col("best")).alias("best"),
                F.coalesce(F.col("best").isNull() | (F.col("offer") < F.col("best")), F.lit(False)).alias("better"),
            )
        )
        frontier = merged.where("better")
        state = merged.select("source", "node", "best")
        entries = frontier.count()
        if not entries:
            return state.select("source", "node", "best.cost", "best.hops", "best.parent")
    raise RuntimeError("costs did not settle")


def paths(found: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, goal, path): each goal's way back along the parents of shortest_paths, all goals a round together."""
    kind = found.schema["node"].dataType.simpleString()
    back = found.select("source", F.col("node").alias("at"), "parent")
    open_ = goals.select("source", "goal").distinct().join(found.select("source", F.col("node").alias("goal")), ["source", "goal"]).select(
        "source", "goal", F.col("goal").alias("at"), F.array("goal").cast(f"array<{kind}>").alias("path")
    )
    done = None
    for _ in range(MAX_ROUNDS):
        stepped = checkpointed(open_.join(back, ["source", "at"]))
        ended = stepped.where("parent IS NULL").select("source", "goal", "path")
        done = ended if done is None else done.unionByName(ended)
        open_ = stepped.where("parent IS NOT NULL").select(
            "source", "goal", F.col("parent").alias("at"), F.concat(F.array("parent"), "path").alias("path")
        )
        if open_.isEmpty():
            return done
    raise RuntimeError("the parents form a cycle")


def spread_least(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the least label that reaches each node along links (a to b)."""
    frontier, entries = labels, labels.count()
    for _ in range(MAX_ROUNDS):
        offers = links.join(
            sent(frontier, entries), F.col("node") == F.col("a")
        ).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("offer"))
        merged = checkpointed(
            labels.join(offers, "node", "left").select(
                "node",
                F.least("label", "offer").alias("label"),
                F.coalesce(F.col("offer") < F.col("label"), F.lit(False)).alias("better"),
            )
        )
        frontier, labels = merged.where("better").select("node", "label"), merged.select("node", "label")
        entries = frontier.count()
        if not entries:
            return labels
    raise RuntimeError("labels did not settle")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components, each named by its least node.

    Each round takes off nodes without a way in or out, which are components of their own; colours the rest with the
    least node that reaches them; and from each colour's own node walks links backwards within the colour. What the
    walk meets is the colour node's component.
    """
    left, links, done = checkpointed(nodes.select("node").distinct()), None, None
    links = checkpointed(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b").distinct())
    for _ in range(MAX_ROUNDS):
        while True:
            inner = left.join(
                links.select(F.col("a").alias("node")).distinct(), "node", "left_semi"
            ).join(links.select(F.col("b").alias("node")).distinct(), "node", "left_semi")
            inner = checkpointed(inner)
            alone = left.join(inner, "node", "left_anti")
            if alone.isEmpty():
                break
            own = checkpointed(alone.select("node", F.col("node").alias("component")))
            done = own if done is None else done.unionByName(own)
            left, keep = inner, sent(inner, inner.count())
            links = checkpointed(
                links.join(
                    keep.withColumnRenamed("node", "a"), "a", "left_semi"
                ).join(keep.withColumnRenamed("node", "b"), "b", "left_semi")
            )
        if left.isEmpty():
            return done if done is not None else left.select("node", F.col("node").alias("component"))
        colour = spread_least(links, left.select("node", F.col("node").alias("label")))
        told = sent(colour, colour.count())
        ends = links.join(
            told.select(F.col("node").alias("a"), F.col("label").alias("ca")), "a"
        ).join(told.select(F.col("node").alias("b"), F.col("label").alias("cb")), "b")
        within = checkpointed(ends.where("ca = cb").select(F.col("b").alias("src"), F.col("a").alias("dst")))
        met = spread_reach(within, colour.where("node = label").select("node", F.col("label").alias("component")))
        done = met if done is None else done.unionByName(met)
        left = checkpointed(left.join(met, "node", "left_anti"))
        entries = left.count()
        if not entries:
            return done
        keep = sent(left, entries)
        links = checkpointed(
            links.join(
                keep.withColumnRenamed("node", "a"), "a", "left_semi"
            ).join(keep.withColumnRenamed("node", "b"), "b", "left_semi")
        )
    raise RuntimeError("components did not settle")


def spread_reach(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, component): what each component's seed reaches along links (src to dst) that join nodes of one seed only."""
    seen, frontier, entries = seeds, seeds, seeds.count()
    for _ in range(MAX_ROUNDS):
        ahead = onward(frontier, links, entries).select(
            F.col("dst").alias("node"), "component"
        ).distinct()
        frontier = checkpointed(ahead.join(seen, "node", "left_anti"))
        entries = frontier.count()
        if not entries:
            return seen
        seen = checkpointed(seen.unionByName(frontier))
    raise RuntimeError("the walk did not end")
