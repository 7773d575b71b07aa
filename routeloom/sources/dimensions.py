"""Small constant tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Class, speed in km/h, congestion, risk.
ROAD_CLASSES = {
    "motorway": (70.0, 2.5, 0.2),
    "trunk": (55.0, 3.0, 0.2),
    "primary": (40.0, 4.0, 0.3),
    "primary_link": (30.0, 3.5, 0.5),
    "secondary": (35.0, 3.2, 0.4),
    "secondary_link": (28.0, 3.0, 0.6),
    "tertiary": (30.0, 2.7, 0.5),
    "tertiary_link": (25.0, 2.5, 0.7),
    "residential": (22.0, 2.0, 0.7),
    "living_street": (12.0, 1.5, 0.8),
    "service": (15.0, 1.5, 1.0),
    "unclassified": (24.0, 2.2, 0.8),
}

#: Weights of distance, time, congestion and risk.
PRESETS = {
    "balanced": (1.0, 0.4, 0.08, 0.12),
    "fastest": (0.2, 1.2, 0.04, 0.08),
    "shortest": (1.5, 0.05, 0.01, 0.03),
    "low_congestion": (0.7, 0.3, 0.25, 0.15),
    "low_risk": (0.5, 0.3, 0.08, 0.8),
}

PROFILES = {
    "normal": "Typical daytime traffic",
    "rush_hour": "Heavier congestion and slower travel on main roads",
    "rainy": "Longer travel time and higher road-risk penalty",
}

#: Short name, name in results, label, whether a heuristic is used.
ALGORITHMS = {
    "bfs": ("breadth_first_search", "BFS", False),
    "dfs": ("depth_first_search", "DFS", False),
    "ucs": ("uniform_cost_search", "UCS", False),
    "astar": ("a_star", "A*", True),
    "dijkstra": ("dijkstra", "Dijkstra", False),
    "greedy": ("greedy_best_first", "Greedy Best-First", True),
}


def road_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(k, *v) for k, v in ROAD_CLASSES.items()],
        "road_type string, speed_kmh double, class_congestion double, class_risk double",
    )


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(k, *v) for k, v in PRESETS.items()], "criterion string, alpha double, beta double, gamma double, delta double"
    )


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROFILES.items()), "traffic_profile string, description string")


def algorithms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(k, *v) for k, v in ALGORITHMS.items()],
        "algorithm string, result_name string, label string, heuristic boolean",
    )
