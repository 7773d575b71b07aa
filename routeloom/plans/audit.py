"""Batch reports: all pairs of landmarks by all algorithms, agreement of the optimal ones, effects of scenarios."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.functions.geo import haversine_km
from routeloom.functions.scalar import is_close
from routeloom.operators.searches import run_searches
from routeloom.sources.dimensions import ALGORITHMS, presets

OPTIMAL_NAMES = ("uniform_cost_search", "a_star", "dijkstra")
MEANS = ("total_cost", "total_distance_km", "total_time_min", "expanded_nodes", "generated_nodes", "path_nodes")


MAX_PLACES = 10_000


def dimension(places: DataFrame) -> DataFrame:
    """Places to broadcast; more than MAX_PLACES raise."""
    if places.limit(MAX_PLACES + 1).count() > MAX_PLACES:
        raise ValueError(f"more than {MAX_PLACES} places")
    return F.broadcast(places)


def ordered_pairs(places: DataFrame, key: str = "node") -> DataFrame:
    """(start, goal): every ordered pair of different places; places are a dimension of checked size."""
    dimension(places)
    a, b = places.select(F.col(key).alias("start")), F.broadcast(places.select(F.col(key).alias("goal")))
    return a.join(b, F.col("start") != F.col("goal"))


def requests(pairs: DataFrame, algorithms: tuple[str, ...] = tuple(ALGORITHMS)) -> DataFrame:
    """(request_id, start, goal, algorithm): each pair by each algorithm; a request's id is a hash of all three."""
    each = pairs.select("start", "goal", F.explode(F.array(*map(F.lit, algorithms))).alias("algorithm"))
    return each.select(F.xxhash64("start", "goal", "algorithm").alias("request_id"), "start", "goal", "algorithm")


def run_matrix(
    net: Broadcast, pairs: DataFrame, algorithms: tuple[str, ...] = tuple(ALGORITHMS), scale: float = 1.0
) -> DataFrame:
    """Results of each pair by each algorithm, without visited_order."""
    return run_searches(net, requests(pairs, algorithms), scale, visited=False)


def agreement(results: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(pairs, reachable, mismatches, max_delta) over the optimal algorithms' results of the same pairs."""
    each = results.where(F.col("algorithm").isin(*OPTIMAL_NAMES)).groupBy("start", "goal").agg(
        F.count("*").alias("n"),
        F.count_if("success").alias("won"),
        F.min("total_cost").alias("low"),
        F.max("total_cost").alias("high"),
    )
    delta = F.coalesce(F.col("high") - F.col("low"), F.lit(0.0))
    return each.agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("won") == F.col("n")).alias("reachable"),
        F.count_if(((F.col("won") > 0) & (F.col("won") < F.col("n"))) | (delta > tolerance)).alias("mismatches"),
        F.coalesce(F.max(delta), F.lit(0.0)).alias("max_delta"),
    )


def algorithm_means(results: DataFrame) -> DataFrame:
    """Per algorithm: runs, successes and the means of what successful runs measured."""
    sized = results.withColumn("path_nodes", F.size("path"))
    return sized.groupBy("algorithm").agg(
        F.count("*").alias("runs"),
        F.count_if("success").alias("successes"),
        *[F.round(F.avg(F.when(F.col("success"), F.col(c))), 4).alias(f"mean_{c}") for c in MEANS],
    )


def median_runtimes(results: DataFrame) -> DataFrame:
    return results.groupBy("algorithm").agg(F.median("runtime_ms").alias("median_runtime_ms"))


def heuristic_consistency(edges: DataFrame, nodes: DataFrame, goals: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(criterion, checks, violations, max_excess): whether alpha * great-circle km ever drops by more than an edge costs.

    edges: src, dst and metrics; nodes: node, latitude, longitude; goals (node) and the presets are dimensions.
    """
    at = lambda side: nodes.select(
        F.col("node").alias(side), F.col("latitude").alias(f"{side}_lat"), F.col("longitude").alias(f"{side}_lon")
    )
    placed = edges.join(at("src"), "src").join(at("dst"), "dst")
    ends = dimension(goals.join(nodes, "node").select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")))
    ahead = placed.join(ends).withColumn(
        "drop",
        haversine_km(
            F.col("src_lat"), F.col("src_lon"), F.col("lat"), F.col("lon")
        ) - haversine_km(F.col("dst_lat"), F.col("dst_lon"), F.col("lat"), F.col("lon")),
    )
    priced = ahead.join(F.broadcast(presets(edges.sparkSession)))
    excess = F.col("alpha") * F.col("drop") - (
        F.col("alpha") * F.col(
            "distance_km"
        ) + F.col("beta") * F.col("time_min") + F.col("gamma") * F.col("congestion") + F.col("delta") * F.col("risk")
    )
    return priced.groupBy("criterion").agg(
        F.count("*").alias("checks"),
        F.count_if(excess > tolerance).alias("violations"),
        F.greatest(F.lit(0.0), F.max(excess)).alias("max_excess"),
    )


def changed_pairs(base: DataFrame, scenarios: DataFrame, what: str = "path") -> DataFrame:
    """(start, goal): pairs whose result differs from the base in at least one scenario."""
    old = base.select("start", "goal", F.col(what).alias("__old"))
    return scenarios.join(old, ["start", "goal"]).where(
        ~F.col(what).eqNullSafe(F.col("__old"))
    ).select("start", "goal").distinct()


def offsets(landmarks: DataFrame) -> DataFrame:
    """(mean, maximum, over_100_m) of the landmarks' distances from the graph."""
    d = F.col("snapped_distance_m")
    return landmarks.agg(F.avg(d).alias("mean"), F.max(d).alias("maximum"), F.count_if(d > 100).alias("over_100_m"))


def reconcile(
    a: DataFrame,
    b: DataFrame,
    keys: tuple[str, ...] = ("start", "goal", "algorithm"),
    metrics: tuple[str, ...] = ("total_cost", "total_distance_km", "total_time_min"),
) -> DataFrame:
    """Rows of two runs of the same requests that differ in path or, beyond rounding, in a metric."""
    other = b.select(*keys, F.col("path").alias("__path"), *[F.col(m).alias(f"__{m}") for m in metrics])
    apart = ~F.col("path").eqNullSafe(F.col("__path"))
    for m in metrics:
        apart = apart | ~(
            F.col(m).eqNullSafe(F.col(f"__{m}")) | F.coalesce(
                is_close(F.col(m), F.col(f"__{m}"), 1e-9, 1e-9), F.lit(False)
            )
        )
    return a.join(other, list(keys)).where(apart).select(*keys)
