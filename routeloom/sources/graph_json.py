"""Graphs from adjacency documents in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.plans.schema import EDGE, NODE, Graph, GraphError

FIELDS = ("to", "distance_km", "time_min", "congestion", "risk", "road_type")
ADJACENCY = "map<string,array<struct<to:string,distance_km:double,time_min:double,congestion:double,risk:double,road_type:string,metadata:map<string,string>>>>"
NODES = "map<string,struct<display_name:string,latitude:double,longitude:double>>"


def read_graph_json(spark: SparkSession, path: str) -> Graph:
    """The graph of an adjacency document: bare, or under `adjacency` beside `nodes`.

    The order of nodes and of each node's edges in the document becomes node_ord and edge_ord. An edge without one of
    the required fields raises; unknown fields are ignored, and missing metadata is empty.
    """
    return graph_from_documents(spark.read.text(path, wholetext=True))


def graph_from_documents(documents: DataFrame) -> Graph:
    """The graph of one document in the column value."""
    spark = documents.sparkSession
    nested = F.get_json_object("value", "$.adjacency")
    parsed = documents.select(
        F.from_json(F.coalesce(nested, F.col("value")), ADJACENCY).alias("adjacency"),
        F.from_json(F.get_json_object("value", "$.nodes"), NODES).alias("known"),
    )
    if parsed.where("adjacency IS NOT NULL").isEmpty():
        raise GraphError("not an adjacency document")
    listed = parsed.select(F.posexplode("adjacency").alias("node_ord", "node_id", "targets"), "known")
    place = F.col("known")[F.col("node_id")]
    nodes = listed.select(
        "node_id",
        "node_ord",
        place["latitude"].alias("latitude"),
        place["longitude"].alias("longitude"),
        place["display_name"].alias("display_name"),
    )
    edges = listed.select(F.col("node_id").alias("src"), F.posexplode("targets").alias("edge_ord", "e")).select(
        "src",
        "edge_ord",
        F.col("e.to").alias("dst"),
        *[F.col(f"e.{f}").alias(f) for f in FIELDS[1:]],
        F.coalesce("e.metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
    )
    lacking = F.array_compact(
        F.array(*[F.when(F.col("dst" if f == "to" else f).isNull(), F.lit(f)) for f in sorted(FIELDS)])
    )
    bad = edges.select(
        "src", "edge_ord", lacking.alias("lacking")
    ).where(F.size("lacking") > 0).orderBy("src", "edge_ord").head()
    if bad:
        raise GraphError(f"Edge {bad['edge_ord']} of {bad['src']!r} lacks fields: {', '.join(bad['lacking'])}")
    return Graph(spark.createDataFrame([], NODE).unionByName(nodes), spark.createDataFrame([], EDGE).unionByName(edges))


def coordinates(graph: Graph) -> DataFrame:
    """(node_id, latitude, longitude); raises if a node has none."""
    if graph.nodes.where("latitude IS NULL OR longitude IS NULL").head():
        raise GraphError("Graph data must contain coordinates of every node")
    return graph.nodes.select("node_id", "latitude", "longitude")


def graph_from_rows(
    spark: SparkSession, adjacency: dict[str, list[dict]], places: dict[str, tuple[float, float]] | None = None
) -> Graph:
    """A graph from Python values, checked like a document."""
    import json

    document: dict = {"adjacency": adjacency}
    if places:
        document["nodes"] = {
            k: {"display_name": k, "latitude": lat, "longitude": lon} for k, (lat, lon) in places.items()
        }
    return graph_from_documents(spark.createDataFrame([(json.dumps(document),)], "value string"))


def adjacency_json(graph: Graph) -> DataFrame:
    """One row with the document that read_graph_json reads back: a graph's round trip."""
    edge: Column = F.struct("edge_ord", F.struct(F.col("dst").alias("to"), *FIELDS[1:], "metadata").alias("e"))
    by = lambda c: lambda a, b: a[c] - b[c]
    own = graph.edges.groupBy("src").agg(
        F.transform(F.array_sort(F.collect_list(edge), by("edge_ord")), lambda x: x["e"]).alias("targets")
    )
    entry = F.struct(
        "node_ord",
        "node_id",
        F.coalesce("targets", F.array().cast(own.schema["targets"].dataType)).alias("targets"),
        F.struct("display_name", "latitude", "longitude").alias("place"),
    )
    listed = graph.nodes.join(own, F.col("node_id") == F.col("src"), "left").agg(
        F.array_sort(F.collect_list(entry), by("node_ord")).alias("all")
    )
    part = lambda value: F.map_from_arrays(
        F.transform("all", lambda x: x["node_id"]), F.transform("all", lambda x: x[value])
    )
    return listed.select(
        F.to_json(F.struct(part("place").alias("nodes"), part("targets").alias("adjacency"))).alias("value")
    )
