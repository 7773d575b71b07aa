"""Routes as rows: hops, segments, totals and geometry of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CONGESTED = 4.0
UNNAMED = "Unnamed road"


def hops(routes: DataFrame, key: str = "request_id", path: str = "path") -> DataFrame:
    """(key, pos, src, dst): each pair of consecutive nodes of a path."""
    steps = F.transform(
        F.filter(path, lambda _, i: i < F.size(path) - 1),
        lambda n, i: F.struct(n.alias("src"), F.get(F.col(path), i + 1).alias("dst")),
    )
    return routes.select(key, F.posexplode(steps).alias("pos", "hop")).select(key, "pos", "hop.src", "hop.dst")


def first_edges(edges: DataFrame) -> DataFrame:
    """The first of parallel edges."""
    return edges.withColumn(
        "__first", F.row_number().over(W.partitionBy("src", "dst").orderBy("edge_ord"))
    ).where("__first = 1").drop("__first")


def route_segments(routes: DataFrame, edges: DataFrame, key: str = "request_id", path: str = "path") -> DataFrame:
    """What each hop of a path is like: road, metrics, cost, direction and geometry; needs costed edges."""
    meta = lambda k: F.col("metadata")[k]
    joined = hops(routes, key, path).join(first_edges(edges), ["src", "dst"])
    points = F.coalesce(
        F.transform(F.from_json(meta("geometry"), "array<array<double>>"), lambda p: F.slice(p, 1, 2)),
        F.array().cast("array<array<double>>"),
    )
    return joined.select(
        key,
        "pos",
        F.col("src").alias("from"),
        F.col("dst").alias("to"),
        F.coalesce(F.nullif(meta("name"), F.lit("")), F.lit(UNNAMED)).alias("name"),
        "road_type",
        "distance_km",
        "time_min",
        "congestion",
        "risk",
        "cost",
        F.coalesce(F.lower(meta("oneway")) == "true", F.lit(False)).alias("oneway"),
        points.alias("geometry"),
    )


def congested_by_road(segments: DataFrame, key: str = "request_id") -> DataFrame:
    """Per road name: highest congestion, minutes and number of segments at congestion 4 or more, in order of first use."""
    return segments.where(F.col("congestion") >= CONGESTED).groupBy(key, "name").agg(
        F.max("congestion").alias("congestion"),
        F.sum("time_min").alias("time_min"),
        F.count("*").alias("segment_count"),
        F.min("pos").alias("first_pos"),
    )


def road_names(segments: DataFrame, key: str = "request_id", first: int | None = None) -> DataFrame:
    """(key, names): distinct road names in order of first use, without unnamed ones; the first few if asked."""
    seen = segments.where(F.col("name") != UNNAMED).groupBy(key, "name").agg(F.min("pos").alias("pos")).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names")
    )
    return seen if first is None else seen.withColumn("names", F.slice("names", 1, first))


def route_totals(segments: DataFrame, key: str = "request_id") -> DataFrame:
    return segments.groupBy(key).agg(
        F.sum("cost").alias("total_cost"),
        F.sum("distance_km").alias("total_distance_km"),
        F.sum("time_min").alias("total_time_min"),
        F.count("*").alias("segments"),
        F.count_if(F.col("congestion") >= CONGESTED).alias("congested"),
    )


def route_coordinates(
    routes: DataFrame, nodes: DataFrame, edges: DataFrame, key: str = "request_id", path: str = "path"
) -> DataFrame:
    """(key, coordinates): the line of each path: its edges' geometries, or straight lines where they have none.

    A point that ends one edge and starts the next appears once if both are equal; one node gives one point, an
    empty path none.
    """
    at = nodes.select("node_id", F.array("longitude", "latitude").alias("point"))
    own = hops(routes, key, path).join(
        first_edges(edges).select(
            "src", "dst", F.from_json(F.col("metadata")["geometry"], "array<array<double>>").alias("line")
        ),
        ["src", "dst"],
        "left",
    )
    placed = own.join(
        at.select(F.col("node_id").alias("src"), F.col("point").alias("p")), "src"
    ).join(at.select(F.col("node_id").alias("dst"), F.col("point").alias("q")), "dst")
    lines = placed.select(
        key,
        "pos",
        F.when(F.size(F.coalesce("line", F.array())) >= 2, F.col("line")).otherwise(F.array("p", "q")).alias("line"),
    )
    ordered = lines.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines")
    )
    empty = F.array().cast("array<array<double>>")
    stitched = F.aggregate(
        "lines",
        empty,
        lambda done, line: F.concat(
            done,
            F.when(
                (F.size(done) > 0) & (
                    F.element_at(F.when(F.size(done) > 0, done).otherwise(F.array(F.array(F.lit(0.0)))), -1) == line[0]
                ),
                F.slice(line, 2, F.size(line)),
            ).otherwise(line),
        ),
    )
    single = routes.where(F.size(path) == 1).join(
        at, F.get(F.col(path), F.lit(0)) == F.col("node_id")
    ).select(key, F.array("point").alias("single"))
    return routes.select(key).join(ordered.select(key, stitched.alias("whole")), key, "left").join(single, key, "left").select(
        key, F.coalesce("whole", "single", empty).alias("coordinates")
    )


def route_geojson(coordinates: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, geojson): a Feature with the path's line."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"), "coordinates").alias("geometry"),
        F.create_map().cast("map<string,string>").alias("properties"),
    )
    return coordinates.select(key, F.to_json(feature).alias("geojson"))


def roads_features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, edge_ord, feature): one GeoJSON Feature for each directed edge."""
    at = lambda side: nodes.select(
        F.col("node_id").alias(side), F.array("longitude", "latitude").alias(f"{side}_point")
    )
    line = F.coalesce(
        F.from_json(F.col("metadata")["geometry"], "array<array<double>>"), F.array("src_point", "dst_point")
    )
    properties = F.struct(
        F.col("src").alias("from"),
        F.col("dst").alias("to"),
        F.col("metadata")["name"].alias("name"),
        "road_type",
        "distance_km",
        "time_min",
        "congestion",
        "risk",
        F.coalesce(F.col("metadata")["oneway"] == "true", F.lit(False)).alias("oneway"),
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"),
        properties.alias("properties"),
    )
    return edges.join(at("src"), "src").join(at("dst"), "dst").select(
        "src", "edge_ord", F.to_json(feature).alias("feature")
    )


def broken_hops(routes: DataFrame, edges: DataFrame, key: str = "request_id", path: str = "path") -> DataFrame:
    """Hops of a path that are no edge: none for a valid result."""
    return hops(routes, key, path).join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
