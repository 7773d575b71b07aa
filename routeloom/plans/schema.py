"""The relational form of a road graph, and the checks that a graph has to pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE = "src string, edge_ord int, dst string, distance_km double, time_min double, congestion double, risk double, road_type string, metadata map<string,string>"
NODE = "node_id string, node_ord int, latitude double, longitude double, display_name string"
SEGMENTS = "array<struct<start:string,goal:string,path:array<string>,cost:double,distance_km:double,time_min:double>>"
SEARCH_RESULT = "algorithm string, success boolean, start string, goal string, path array<string>, total_cost double, total_distance_km double, total_time_min double, visited_order array<string>, expanded_nodes int, generated_nodes int, runtime_ms double, message string, optimality string"
TOUR_RESULT = f"method string, success boolean, start string, requested_waypoints array<string>, visiting_order array<string>, full_path array<string>, segments {SEGMENTS}, total_cost double, total_distance_km double, total_time_min double, runtime_ms double, optimality string, comparison_gap_percent double, message string"
TRACE = "index int, event string, current_node string, frontier array<struct<node:string,priority:double>>, visited array<string>, details map<string,string>"

BRIEF_TRACE = TRACE.replace("visited array<string>", "frontier_size int, visited_size int")


class GraphError(ValueError):
    """A graph, request or parameter that breaks a rule of the data model."""


@dataclass(frozen=True)
class Graph:
    """Nodes and directed edges; node_ord and edge_ord carry the order that ties are broken by."""

    nodes: DataFrame
    edges: DataFrame


def not_finite(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))


def violations(graph: Graph) -> DataFrame:
    """(rule, entity): one row for each rule that an edge or node breaks; an empty graph breaks none."""
    edge = F.concat_ws("->", F.coalesce("src", F.lit("?")), F.coalesce("dst", F.lit("?")))
    edge_rules = {
        "distance_km finite and not negative": not_finite("distance_km") | (F.col("distance_km") < 0),
        "time_min finite and not negative": not_finite("time_min") | (F.col("time_min") < 0),
        "congestion from 1 to 5": not_finite("congestion") | ~F.col("congestion").between(1, 5),
        "risk from 0 to 5": not_finite("risk") | ~F.col("risk").between(0, 5),
        "dst not empty": F.col("dst").isNull() | (F.length("dst") == 0),
        "road_type not empty": F.col("road_type").isNull() | (F.length("road_type") == 0),
    }
    node_rules = {
        "node_id not empty": F.col("node_id").isNull() | (F.length("node_id") == 0),
        "latitude from -90 to 90": F.col("latitude").isNotNull() & (
            F.isnan("latitude") | ~F.col("latitude").between(-90, 90)
        ),
        "longitude from -180 to 180": F.col("longitude").isNotNull() & (
            F.isnan("longitude") | ~F.col("longitude").between(-180, 180)
        ),
    }

    def broken(df: DataFrame, rules: dict[str, Column], entity: Column) -> DataFrame:
        names = F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]))
        return df.select(F.explode(names).alias("rule"), entity.alias("entity"))

    known = graph.nodes.select(F.col("node_id").alias("__node"))
    out = broken(graph.edges, edge_rules, edge).unionByName(
        broken(graph.nodes, node_rules, F.coalesce("node_id", F.lit("?")))
    )
    for side in ("src", "dst"):
        missing = graph.edges.join(known, F.col(side) == F.col("__node"), "left_anti").select(
            F.lit(f"{side} is a node").alias("rule"), F.col(side).alias("entity")
        ).distinct()
        out = out.unionByName(missing)
    return out


def validated(graph: Graph) -> Graph:
    """The graph, or a GraphError that names the broken rules and, sorted, the entities that break them."""
    found = violations(graph).groupBy("rule").agg(
        F.array_sort(F.collect_set("entity")).alias("entities"), F.count("*").alias("n")
    )
    found = found.select("rule", "n", F.slice("entities", 1, 10).alias("entities")).orderBy("rule").collect()
    if found:
        raise GraphError("; ".join(f"{r['rule']}: {r['n']} broken, such as {', '.join(r['entities'])}" for r in found))
    return graph
