"""Batch jobs over a planner's landmarks: the matrix of all pairs, one-to-all runs, tours, the audit and the benchmark."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.functions.cost import Weights
from routeloom.operators import routes, searches, tours
from routeloom.plans import audit
from routeloom.plans.planner import RoutePlanner
from routeloom.sources.dimensions import ALGORITHMS, PRESETS, PROFILES

METRICS = ("total_cost", "total_distance_km", "total_time_min")


def landmark_nodes(planner: RoutePlanner) -> DataFrame:
    return planner.landmarks.select(F.col("snapped_node").alias("node")).distinct()


def result_rows(results: DataFrame, prefix: str = "") -> DataFrame:
    """Results flat for a table: metrics to four digits, the number of nodes on the path and of those visited."""
    columns = {
        "success": F.col("success"),
        **{c: F.round(c, 4) for c in (*METRICS, "runtime_ms")},
        "path_nodes": F.size("path"),
        "expanded_nodes": F.col("expanded_nodes"),
        "generated_nodes": F.col("generated_nodes"),
        "optimality": F.col("optimality"),
        "message": F.col("message"),
    }
    return results.select("start", "goal", "algorithm", *[v.alias(f"{prefix}{k}") for k, v in columns.items()])


def run_matrix(planner: RoutePlanner, criterion: str = "balanced", traffic_profile: str = "normal") -> DataFrame:
    """Every ordered pair of landmarks by every algorithm."""
    weights = Weights.preset(criterion)
    _, net = planner.scenario(traffic_profile, weights)
    return audit.run_matrix(net, audit.ordered_pairs(landmark_nodes(planner)), scale=weights.alpha)


def matrix_report(planner: RoutePlanner, results: DataFrame, facade: DataFrame | None = None) -> dict:
    """What the matrix shows: runs, invalid paths, cost disagreements of the optimal algorithms, means; and, against a second run, mismatches."""
    numbered = results.withColumn("request_id", F.xxhash64("start", "goal", "algorithm"))
    costs = results.where(
        F.col("success") & F.col("algorithm").isin(*audit.OPTIMAL_NAMES)
    ).groupBy("start", "goal").agg(F.countDistinct(F.round("total_cost", 6)).alias("n"))
    return {
        "runs": results.count(),
        "failures": [
            r.asDict() for r in results.where("NOT success").select("start", "goal", "algorithm").limit(20).collect()
        ],
        "invalid_hops": routes.broken_hops(numbered, planner.graph.edges).count(),
        "cost_disagreements": costs.where("n > 1").count(),
        "means": [r.asDict() for r in audit.algorithm_means(results).orderBy("algorithm").collect()],
        "facade_mismatches": audit.reconcile(results, facade).count() if facade is not None else None,
    }


def run_dijkstra_all(planner: RoutePlanner, criterion: str = "balanced", traffic_profile: str = "normal") -> DataFrame:
    """Each landmark to all landmarks in one run a source."""
    _, net = planner.scenario(traffic_profile, Weights.preset(criterion))
    goals = [r["node"] for r in landmark_nodes(planner).collect()]  # a dimension
    return searches.run_all_targets(net, landmark_nodes(planner).withColumnRenamed("node", "source"), goals)


def run_multi_location(
    planner: RoutePlanner,
    requests: Sequence[tuple[str, Sequence[str]]],
    criterion: str = "balanced",
    traffic_profile: str = "normal",
    return_to_start: bool = False,
) -> DataFrame:
    """Both tour methods for each request (start, waypoints; landmark ids)."""
    spark = planner.graph.edges.sparkSession
    _, net = planner.scenario(traffic_profile, Weights.preset(criterion))
    at = {r["id"]: r["snapped_node"] for r in planner.landmarks.select("id", "snapped_node").collect()}  # a dimension
    rows = [
        (k, at[start], [at[w] for w in stops], "compare", None, return_to_start, 8)
        for k, (start, stops) in enumerate(requests)
    ]
    return tours.run_tours(
        net,
        spark.createDataFrame(
            rows,
            "request_id long, start string, waypoints array<string>, method string, end string, return_to_start boolean, exact_limit int",
        ),
    )


def run_audit(planner: RoutePlanner) -> dict:
    """Reachability, agreement of the optimal algorithms, consistency of the heuristic, and which pairs scenarios change."""
    began = time.perf_counter()
    pairs = audit.ordered_pairs(landmark_nodes(planner)).cache()

    def cheapest(criterion: str, profile: str, names: tuple[str, ...] = ("dijkstra",)) -> DataFrame:
        weights = Weights.preset(criterion)
        return audit.run_matrix(planner.scenario(profile, weights)[1], pairs, names, weights.alpha)

    optimal = cheapest("balanced", "normal", ("ucs", "astar", "dijkstra")).cache()
    base = optimal.where("algorithm = 'dijkstra'")
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    by_profile = union([cheapest("balanced", p) for p in PROFILES if p != "normal"])
    by_criterion = union([cheapest(c, "normal") for c in PRESETS if c != "balanced"])
    nodes = planner.graph.nodes.select(F.col("node_id").alias("node"), "latitude", "longitude")
    checks = audit.heuristic_consistency(planner.graph.edges, nodes, landmark_nodes(planner)).agg(
        F.sum("checks").alias("checks"),
        F.sum("violations").alias("consistency_violations"),
        F.max("max_excess").alias("max_consistency_excess"),
    )
    out = {
        "landmarks": planner.landmarks.count(),
        **audit.agreement(optimal).first().asDict(),
        "heuristic_checks": checks.first().asDict(),
        "pairs_changed_by_traffic_profile": audit.changed_pairs(base, by_profile).count(),
        "pairs_changed_by_cost_criterion": audit.changed_pairs(base, by_criterion).count(),
        "landmark_access_offsets_m": audit.offsets(planner.landmarks).first().asDict(),
    }
    return out | {"elapsed_seconds": time.perf_counter() - began}


def run_benchmark(
    planner: RoutePlanner, start_id: str, goal_id: str, waypoint_ids: Sequence[str], repeats: int = 10
) -> dict:
    """One pair by each algorithm with its median runtime, the pair under each profile, and a tour by each way of ordering it."""
    at = {r["id"]: r["snapped_node"] for r in planner.landmarks.select("id", "snapped_node").collect()}  # a dimension
    spark, weights = planner.graph.edges.sparkSession, Weights.preset("balanced")
    _, net = planner.scenario("normal", weights)
    rows = [
        (k * len(ALGORITHMS) + j, at[start_id], at[goal_id], a)
        for k in range(repeats)
        for j, a in enumerate(ALGORITHMS)
    ]
    found = searches.run_searches(
        net, spark.createDataFrame(rows, "request_id long, start string, goal string, algorithm string"), weights.alpha
    ).cache()
    medians = {r["algorithm"]: r["median_runtime_ms"] for r in audit.median_runtimes(found).collect()}
    once = {
        r["algorithm"]: {
            c: r[c] for c in (*METRICS, "expanded_nodes", "generated_nodes")
        } | {"path_nodes": len(r["path"])}
        for r in found.where(F.col("request_id") < len(ALGORITHMS)).collect()
    }
    stops = [at[w] for w in waypoint_ids]
    both = tours.compare(net.value, at[start_id], stops)
    return {
        "algorithms": {a: once[a] | {"median_runtime_ms": medians[a]} for a in once},
        "profiles": {
            p: {c: r[c] for c in METRICS} | {"path_nodes": len(r["path"])}
            for p in PROFILES
            for r in [planner.search(start_id, goal_id, "dijkstra", traffic_profile=p)["result"]]
        },
        "tours": {"input_order": tours.fixed_order(net.value, [at[start_id], *stops])} | {
            m: {c: t[c] for c in (*METRICS, "runtime_ms", "comparison_gap_percent")} for m, t in both.items()
        },
    }


def road_totals(edges: DataFrame) -> DataFrame:
    """(roads, length_km, one_way): counts and total length of directed edges."""
    return edges.agg(
        F.count("*").alias("roads"),
        F.round(F.sum("distance_km"), 3).alias("length_km"),
        F.count_if(F.coalesce(F.col("metadata")["oneway"] == "true", F.lit(False))).alias("one_way"),
    )
