"""From road features to a routable graph: projection, clean-up, components, bridges and landmarks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from routeloom.functions.geo import EARTH_RADIUS_KM, haversine_km, node_id, padding_degrees
from routeloom.functions.scalar import road_type, speed_kmh, vietnamese
from routeloom.operators import kernels
from routeloom.operators.traversal import checkpointed, strong_components
from routeloom.plans.schema import Graph, GraphError
from routeloom.sources.dimensions import road_classes

MIN_DISTANCE_KM, MAJOR_COMPONENT, MAX_OFFSET_M = 0.001, 20, 75.0
#: Edges and nodes that the driver takes to find components by itself, as text and lists; more are left to tasks.
HELD_EDGES = 500_000
CONNECTOR_KMH, CONNECTOR_CONGESTION, CONNECTOR_RISK = 20.0, 2.0, 0.8


def read_roads(spark: SparkSession, path: str) -> DataFrame:
    """(feature_ord, points, properties) of the LineStrings of at least two points in a GeoJSON collection."""
    document = spark.read.text(path, wholetext=True).select(
        F.from_json(
            "value",
            "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>",
        ).alias("d")
    )
    features = document.select(F.posexplode("d.features").alias("feature_ord", "f"))
    lines = features.where("f.geometry.type = 'LineString'").select(
        "feature_ord",
        F.from_json("f.geometry.coordinates", "array<array<double>>").alias("points"),
        F.col("f.properties").alias("properties"),
    )
    return lines.where(F.size("points") >= 2).withColumn("points", F.transform("points", lambda p: F.slice(p, 1, 2)))


def road_edges(roads: DataFrame) -> DataFrame:
    """Every road as a directed edge with its features; roads from a point to itself go."""
    raw = lambda k: F.col("properties")[k]
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    ends = roads.select(
        "feature_ord",
        "points",
        "properties",
        node_id(first[0], first[1]).alias("src"),
        node_id(last[0], last[1]).alias("dst"),
        first.alias("from_point"),
        last.alias("to_point"),
        road_type(raw("highway")).alias("road_type"),
    ).where("src <> dst")
    classed = ends.join(F.broadcast(road_classes(roads.sparkSession)), "road_type")  # twelve rows
    kmh = speed_kmh(raw("maxspeed"), F.col("speed_kmh"))
    km = F.greatest(F.coalesce(raw("length").try_cast("double"), F.lit(0.0)) / 1000, F.lit(MIN_DISTANCE_KM))
    priced = classed.withColumns({"maxspeed_kmh": kmh, "distance_km": km}).withColumn(
        "time_min", F.col("distance_km") / F.col("maxspeed_kmh") * 60
    )
    oneway = F.coalesce(F.lower(raw("oneway")).isin("true", "1", "yes"), F.lit(False))
    known = {
        "name": vietnamese(raw("name")),
        "osmid": raw("osmid"),
        "oneway": oneway.cast("string"),
        "lanes": raw("lanes"),
        "maxspeed_kmh": F.col("maxspeed_kmh").cast("string"),
        "relation_id": raw("relation_id"),
        "geometry": F.to_json("points"),
        "base_time_min": F.col("time_min").cast("string"),
        "base_congestion": F.col("class_congestion").cast("string"),
        "base_risk": F.col("class_risk").cast("string"),
    }
    metadata = F.map_filter(
        F.create_map(*[x for k, v in known.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull()
    )
    return priced.select(
        "feature_ord",
        "src",
        "dst",
        "distance_km",
        "time_min",
        F.col("class_congestion").alias("congestion"),
        F.col("class_risk").alias("risk"),
        "road_type",
        metadata.alias("metadata"),
        "from_point",
        "to_point",
    )


def dedupe_parallel(edges: DataFrame, order: str = "feature_ord") -> DataFrame:
    """The fastest of parallel edges, the first among equals; it takes the place of the first one seen."""
    same = W.partitionBy("src", "dst")
    ranked = edges.withColumns(
        {"__rank": F.row_number().over(same.orderBy("time_min", order)), "__place": F.min(order).over(same)}
    )
    return ranked.where("__rank = 1").drop("__rank", order).withColumnRenamed("__place", order)


def road_nodes(edges: DataFrame) -> DataFrame:
    """(node_id, first_ord, latitude, longitude) of the ends of the edges, in the order in which features name them."""
    side = lambda node, point, k: edges.select(
        F.col(node).alias("node_id"),
        (F.col("feature_ord") * 2 + k).alias("first_ord"),
        F.col(point)[1].alias("latitude"),
        F.col(point)[0].alias("longitude"),
    )
    return side("src", "from_point", 0).unionByName(side("dst", "to_point", 1)).groupBy("node_id").agg(
        F.min("first_ord").alias("first_ord"),
        F.max_by("latitude", "first_ord").alias("latitude"),
        F.max_by("longitude", "first_ord").alias("longitude"),
    )


def component_labels(nodes: DataFrame, edges: DataFrame, most: int = HELD_EDGES) -> DataFrame:
    """(node_id, component): in one process if the graph is small (its size is checked), else set-based."""
    if edges.limit(most + 1).count() > most or nodes.limit(most + 1).count() > most:
        found = strong_components(nodes.select(F.col("node_id").alias("node")), edges)
        return found.select(F.col("node").alias("node_id"), "component")
    held = edges.select("src", "dst").toPandas().assign(edge_ord=0, cost=0.0, distance_km=0.0, time_min=0.0)
    ids = sorted(nodes.select("node_id").toPandas()["node_id"])
    net = kernels.network(
        pd.DataFrame({"node_id": ids, "node_ord": range(len(ids)), "latitude": 0.0, "longitude": 0.0}), held
    )
    label = kernels.components(net)
    return nodes.sparkSession.createDataFrame(
        pd.DataFrame({"node_id": ids, "component": [ids[k] for k in label]}), "node_id string, component string"
    )


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("size"))


def largest_component(
    graph_nodes: DataFrame, edges: DataFrame, labels: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The nodes of the largest strongly connected component (the least name among equals) and the edges between them."""
    labels = component_labels(graph_nodes, edges) if labels is None else labels
    top = component_sizes(labels).orderBy(F.desc("size"), "component").limit(1).select("component")
    kept = labels.join(F.broadcast(top), "component", "left_semi").select("node_id")
    inside = edges.join(
        kept.withColumnRenamed("node_id", "src"), "src", "left_semi"
    ).join(kept.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return graph_nodes.join(kept, "node_id", "left_semi"), inside.select(*edges.columns)


def closest_pair(a: DataFrame, b: DataFrame) -> tuple[str, str, float]:
    """The nearest nodes of two sets (node_id, latitude, longitude), by a grid join with cells that double until a pair is sure.

    Pairs within one cell's width lie in the same or neighbouring cells, so the best pair found is the best of all once
    it is no longer than the width.
    """
    width = 0.05  # km
    while True:
        degrees = width / (np.pi * EARTH_RADIUS_KM / 180)

        def cells(df: DataFrame, spread: bool) -> DataFrame:
            # a cell of longitude is as wide as needed at the largest latitude in reach
            row = F.floor(F.col("latitude") / degrees)
            turn = degrees / F.greatest(F.cos(F.radians(F.least((F.abs(row) + 2) * degrees, F.lit(89.9)))), F.lit(1e-3))
            if not spread:
                return df.withColumns({"row": row, "col": F.floor(F.col("longitude") / turn)})
            near = df.withColumn("row", F.explode(F.array(row - 1, row, row + 1)))
            turn = degrees / F.greatest(
                F.cos(F.radians(F.least((F.abs(F.col("row")) + 2) * degrees, F.lit(89.9)))), F.lit(1e-3)
            )
            column = F.floor(F.col("longitude") / turn)
            return near.withColumn("col", F.explode(F.array(column - 1, column, column + 1)))

        left = cells(a, False).select(
            F.col("node_id").alias("a"), F.col("latitude").alias("alat"), F.col("longitude").alias("alon"), "row", "col"
        )
        right = cells(b, True).select(
            F.col("node_id").alias("b"), F.col("latitude").alias("blat"), F.col("longitude").alias("blon"), "row", "col"
        )
        pairs = left.join(right, ["row", "col"]).select(
            haversine_km(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")).alias("km"), "a", "b"
        )
        best = pairs.agg(F.min(F.struct("km", "a", "b")).alias("m")).first()["m"]
        if best is not None and (best["km"] <= width or width > 2e4):
            return best["a"], best["b"], best["km"]
        if width > 4e4:
            raise GraphError("no pair of nodes with coordinates")
        width = max(width * 2, best["km"]) if best is not None else width * 4


def bridge_components(
    nodes: DataFrame, edges: DataFrame, smallest: int = MAJOR_COMPONENT
) -> tuple[DataFrame, list[tuple[str, str, float]]]:
    """The edges with both-way connectors between components of at least `smallest` nodes, largest first.

    Each such component is joined, by its nearest pair of nodes, to what is connected already; a connector replaces an
    edge between its ends. Also returns the connectors (from, to, km).
    """
    spark = nodes.sparkSession
    labels = checkpointed(component_labels(nodes, edges))
    majors = [
        r["component"]
        for r in component_sizes(labels).where(F.col("size") >= smallest).orderBy(F.desc("size"), "component").collect()
    ]
    placed = nodes.select("node_id", "latitude", "longitude").join(labels, "node_id")
    connectors = []
    for k in range(1, len(majors)):
        connectors.append(
            closest_pair(
                placed.where(F.col("component").isin(majors[:k])), placed.where(F.col("component") == majors[k])
            )
        )
    if not connectors:
        return edges, []
    both = [x for a, b, km in connectors for x in ((a, b, km), (b, a, km))]
    lines = spark.createDataFrame(
        [(s, d, max(km, MIN_DISTANCE_KM), k) for k, (s, d, km) in enumerate(both)],
        "src string, dst string, distance_km double, k int",
    )
    at = lambda side: nodes.select(
        F.col("node_id").alias(side), F.array("longitude", "latitude").alias(f"{side}_point")
    )
    minutes = F.col("distance_km") / CONNECTOR_KMH * 60
    known = {
        "name": F.lit("Boundary connector"),
        "oneway": F.lit("false"),
        "geometry": F.to_json(F.array("src_point", "dst_point")),
        "simulated_connector": F.lit("true"),
        "base_time_min": minutes.cast("string"),
        "base_congestion": F.lit(str(CONNECTOR_CONGESTION)),
        "base_risk": F.lit(str(CONNECTOR_RISK)),
    }
    last = edges.agg(F.max("feature_ord")).first()[0] or 0
    replaced = edges.join(F.broadcast(lines.select("src", "dst")), ["src", "dst"]).select(
        "src", "dst", F.col("feature_ord").alias("__old")
    )
    made = lines.join(at("src"), "src").join(at("dst"), "dst").join(replaced, ["src", "dst"], "left").select(
        F.coalesce("__old", F.col("k") + last + 1).alias("feature_ord"),
        "src",
        "dst",
        "distance_km",
        minutes.alias("time_min"),
        F.lit(CONNECTOR_CONGESTION).alias("congestion"),
        F.lit(CONNECTOR_RISK).alias("risk"),
        F.lit("unclassified").alias("road_type"),
        F.create_map(*[x for n, v in known.items() for x in (F.lit(n), v)]).alias("metadata"),
        F.col("src_point").alias("from_point"),
        F.col("dst_point").alias("to_point"),
    )
    kept = edges.join(F.broadcast(lines.select("src", "dst")), ["src", "dst"], "left_anti").select(*edges.columns)
    return kept.unionByName(made.select(*edges.columns)), connectors


def in_order(nodes: DataFrame, edges: DataFrame) -> Graph:
    """The relational graph: node_ord and edge_ord number nodes and each node's edges in the order of the features."""
    numbered = edges.withColumn("edge_ord", F.row_number().over(W.partitionBy("src").orderBy("feature_ord")) - 1)
    listed = nodes.select(
        "node_id",
        F.col("first_ord").cast("int").alias("node_ord"),
        "latitude",
        "longitude",
        F.col("node_id").alias("display_name"),
    )
    return Graph(
        listed,
        numbered.select(
            "src", "edge_ord", "dst", "distance_km", "time_min", "congestion", "risk", "road_type", "metadata"
        ),
    )


def build_graph(roads: DataFrame) -> Graph:
    """The routable graph of road features: the largest strongly connected part after bridging its major components."""
    projected = checkpointed(road_edges(roads))
    if projected.isEmpty():
        raise GraphError("no usable road")
    nodes = checkpointed(road_nodes(projected))
    bridged, _ = bridge_components(nodes, checkpointed(dedupe_parallel(projected)))
    # bridges may also draw small components in, which lie on a way between two that are joined now
    return in_order(*largest_component(nodes, checkpointed(bridged)))


def nearest_nodes(
    nodes: DataFrame, points: list[tuple[str, float, float]], k: int
) -> dict[str, list[tuple[float, int, str]]]:
    """For each point (name, latitude, longitude) its k nearest nodes as (km, node_ord, node_id), nearest first.

    Every batch of nodes gives its own k nearest a point, so what is gathered is points x k rows a batch of nodes.
    """
    names = [p[0] for p in points]
    lat, lon = (np.radians(np.array([p[c] for p in points], np.float64))[:, None] for c in (1, 2))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf.sort_values("node_ord")  # ties go to the first node
            a, b = np.radians(pdf["latitude"].to_numpy())[None, :], np.radians(pdf["longitude"].to_numpy())[None, :]
            h = np.sin((a - lat) / 2) ** 2 + np.cos(lat) * np.cos(a) * np.sin((b - lon) / 2) ** 2
            km = 2 * EARTH_RADIUS_KM * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h)))
            top = np.argsort(km, axis=1, kind="stable")[:, :k]
            at = top.ravel()
            yield pd.DataFrame(
                {
                    "name": np.repeat(names, top.shape[1]),
                    "km": np.take_along_axis(km, top, 1).ravel(),
                    "node_ord": pdf["node_ord"].to_numpy()[at],
                    "node_id": pdf["node_id"].to_numpy()[at],
                }
            )

    found = nodes.select("node_id", "node_ord", "latitude", "longitude").mapInPandas(
        scan, "name string, km double, node_ord int, node_id string"
    )
    best = found.withColumn(
        "rank", F.row_number().over(W.partitionBy("name").orderBy("km", "node_ord"))
    ).where(F.col("rank") <= k)
    out: dict[str, list[tuple[float, int, str]]] = {n: [] for n in names}
    for r in best.orderBy("name", "rank").collect():
        out[r["name"]].append((r["km"], r["node_ord"], r["node_id"]))
    return out


def snap_exclusive(nodes: DataFrame, points: list[tuple[str, float, float]]) -> dict[str, tuple[str, float]]:
    """Each point's nearest node that no earlier point took, and its distance in km.

    At most len(points) - 1 nodes are taken before a point's turn, so its len(points) nearest nodes suffice.
    """
    if nodes.limit(len(points)).count() < len(points):
        raise GraphError("There are more landmarks than routable graph nodes")
    near = nearest_nodes(nodes, points, len(points)) if points else {}
    taken: set[str] = set()
    out = {}
    for name, _, _ in points:
        km, _, node = next(x for x in near[name] if x[2] not in taken)
        taken.add(node)
        out[name] = (node, km)
    return out


#: What a landmark's missing fields are.
LANDMARK_DEFAULTS = {
    "access_kind": "nearest_road",
    "access_label": "Nearest road access",
    "access_source": "Generated",
    "access_road": "Unnamed road",
}
LANDMARK = "id string, name string, category string, description string, latitude double, longitude double, routing_latitude double, routing_longitude double, access_kind string, access_label string, access_source string, access_road string"


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """(landmark_ord, ...) of a JSON list of landmarks, with defaults for missing optional fields."""
    raw = spark.read.text(path, wholetext=True).select(
        F.posexplode(
            F.from_json(
                "value",
                f"array<struct<{LANDMARK.replace(' string', ':string').replace(' double', ':double').replace(', ', ',')}>>",
            )
        ).alias("landmark_ord", "l")
    ).select("landmark_ord", "l.*")
    return landmark_columns(raw)


def landmark_columns(raw: DataFrame) -> DataFrame:
    clean = lambda c: F.coalesce(F.nullif(vietnamese(F.col(c)), F.lit("")), F.lit(LANDMARK_DEFAULTS.get(c, "")))
    return raw.withColumns(
        {
            "name": clean("name"),
            "description": clean("description"),
            "routing_latitude": F.coalesce("routing_latitude", "latitude"),
            "routing_longitude": F.coalesce("routing_longitude", "longitude"),
            "access_kind": F.coalesce("access_kind", F.lit(LANDMARK_DEFAULTS["access_kind"])),
            **{c: clean(c) for c in ("access_label", "access_source", "access_road")},
        }
    )


def with_overrides(landmarks: DataFrame, overrides: DataFrame) -> DataFrame:
    """Landmarks whose routing point and access fields an override (id, latitude, longitude, kind, label, source) replaces."""
    o = overrides.select(
        F.col("id").alias("__id"),
        *[F.col(c).alias(f"__{c}") for c in ("latitude", "longitude", "kind", "label", "source")],
    )
    pick = {
        "routing_latitude": "__latitude",
        "routing_longitude": "__longitude",
        "access_kind": "__kind",
        "access_label": "__label",
        "access_source": "__source",
    }
    return landmarks.join(
        F.broadcast(o) if overrides.limit(10_001).count() <= 10_000 else o, F.col("id") == F.col("__id"), "left"
    ).withColumns({c: F.coalesce(v, c) for c, v in pick.items()}).drop("__id", *pick.values())


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    parsed = spark.read.text(path, wholetext=True).select(
        F.explode(
            F.from_json(
                "value",
                "map<string,struct<latitude:double,longitude:double,kind:string,label:string,source:string,use_road_projection:boolean>>",
            )
        ).alias("id", "o")
    )
    return parsed.select("id", "o.*")


def snap_landmarks(landmarks: DataFrame, nodes: DataFrame, most_m: float = MAX_OFFSET_M) -> DataFrame:
    """The landmarks with snapped_node and snapped_distance_m; a landmark is too far or repeated: the first such one raises."""
    rows = landmarks.orderBy("landmark_ord").collect()  # a dimension: as many rows as places to choose from
    found = snap_exclusive(
        nodes, [(str(r["landmark_ord"]), r["routing_latitude"], r["routing_longitude"]) for r in rows]
    )
    seen, snapped = set(), []
    for r in rows:
        node, km = found[str(r["landmark_ord"])]
        metres = round(km * 1000, 1)
        if metres > most_m:
            raise GraphError(
                f"Landmark {r['id']!r} access point is {metres:.1f} m from the driving graph; maximum allowed is {most_m:.1f} m"
            )
        if r["id"] in seen:
            raise GraphError(f"Duplicate landmark ID: {r['id']!r}")
        seen.add(r["id"])
        snapped.append((r["landmark_ord"], node, metres))
    extra = landmarks.sparkSession.createDataFrame(
        snapped, "landmark_ord int, snapped_node string, snapped_distance_m double"
    )
    return landmarks.join(extra, "landmark_ord").orderBy("landmark_ord")


def bounding_box(points: DataFrame, buffer_m: float) -> DataFrame:
    """(south, north, west, east): the box of the points, wider by a buffer at their mean latitude."""
    box = points.agg(
        F.min("latitude").alias("s"),
        F.max("latitude").alias("n"),
        F.min("longitude").alias("w"),
        F.max("longitude").alias("e"),
        F.avg("latitude").alias("m"),
    )
    up, side = padding_degrees(buffer_m, F.col("m"))
    return box.select(
        (F.col("s") - up).alias("south"),
        (F.col("n") + up).alias("north"),
        (F.col("w") - side).alias("west"),
        (F.col("e") + side).alias("east"),
    )


def network_summary(graph: Graph, landmarks: DataFrame | None = None) -> DataFrame:
    """(routable_nodes, routable_edges, landmarks, unique_landmark_nodes, simulated_connectors)."""
    edges = graph.edges.agg(
        F.count("*").alias("routable_edges"),
        F.count_if(
            F.coalesce(F.col("metadata")["simulated_connector"] == "true", F.lit(False))
        ).alias("simulated_connectors"),
    )
    out = graph.nodes.agg(F.count("*").alias("routable_nodes")).join(F.broadcast(edges))  # one row each
    if landmarks is None:
        return out.withColumns({"landmarks": F.lit(0).cast("long"), "unique_landmark_nodes": F.lit(0).cast("long")})
    return out.join(
        F.broadcast(
            landmarks.agg(
                F.count("*").alias("landmarks"), F.countDistinct("snapped_node").alias("unique_landmark_nodes")
            )
        )
    )

