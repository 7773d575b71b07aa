"""Every query of the engine runs on the smallest tables, and gives what its SQL gives where it has one."""

import pytest
from pyspark.sql import functions as F

from routeloom.plans.queries import ORACLE_SQL, QUERIES
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_routes_are_valid(spark, sf_dir):
    from routeloom.operators.routes import broken_hops
    from routeloom.sources.derived import basket_edges, basket_graph

    edges = basket_graph(basket_edges(spark, sf_dir)).edges
    for name in ("dfs_route", "greedy_route"):
        found = QUERIES[name](spark, sf_dir).withColumn("request_id", F.monotonically_increasing_id()).cache()
        assert broken_hops(found, edges).count() == 0
        assert found.where("success AND (path[0] <> start OR element_at(path, -1) <> goal)").count() == 0


def test_steps_equal_expansions(spark, sf_dir):
    assert QUERIES["expand_stream"](spark, sf_dir).count() == QUERIES["search_trace"](spark, sf_dir).where(
        "event = 'expand'"
    ).join(
        QUERIES["expand_stream"](spark, sf_dir).select("request_id").distinct(), "request_id"
    ).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_agreement_counts_mismatches(spark):
    from routeloom.plans.audit import agreement, changed_pairs, reconcile

    rows = [
        ("a", "b", "dijkstra", True, 1.0, ["a", "b"]),
        ("a", "b", "a_star", True, 2.0, ["a", "c", "b"]),
        ("a", "c", "dijkstra", True, 1.0, ["a", "c"]),
        ("a", "c", "a_star", True, 1.0, ["a", "c"]),
        ("b", "c", "dijkstra", False, None, []),
        ("b", "c", "a_star", False, None, []),
    ]
    df = spark.createDataFrame(
        rows, "start string, goal string, algorithm string, success boolean, total_cost double, path array<string>"
    ).withColumns({"total_distance_km": F.col("total_cost"), "total_time_min": F.col("total_cost")})
    assert tuple(agreement(df).first()) == (3, 2, 1, 1.0)
    base, other = df.where("algorithm = 'dijkstra'"), df.where("algorithm = 'a_star'")
    assert [tuple(r) for r in changed_pairs(base, other).collect()] == [("a", "b")]
    assert [tuple(r) for r in reconcile(base, other, ("start", "goal")).collect()] == [("a", "b")]


def test_explanations():
    from routeloom.plans.explain import explain_search_result, summarize_comparison

    road = {"name": "High St", "congestion": 4.5, "time_min": 2.0}
    found = {
        "success": True,
        "algorithm": "dijkstra",
        "path": ["a", "b"],
        "total_cost": 3.0,
        "total_distance_km": 1.234,
        "total_time_min": 4.0,
        "expanded_nodes": 2,
        "runtime_ms": 1.0,
        "message": "ok",
    }
    other = found | {
        "algorithm": "breadth_first_search",
        "path": ["a", "c", "b"],
        "total_cost": 3.5,
        "total_distance_km": 1.0,
        "expanded_nodes": 5,
    }
    names = {"start_name": "A", "goal_name": "B", "criterion": "fastest", "traffic_profile": "rainy"}
    said = explain_search_result(
        found,
        [road, road | {"name": "Unnamed road"}, road],
        **names,
        alternative=other,
        alternative_segments=[road],
        start_access_m=5.4,
    )
    assert said["headline"] == "A to B: 1.23 km, about 4.0 minutes."
    assert said["reasons"] == [
        "The route uses 3 road segments via High St.",
        "The fastest criterion places the strongest emphasis on estimated travel time.",
        "Traffic profile 'rainy' is reflected in travel time, congestion, and risk values.",
        "3 selected segment(s) have congestion level 4 or higher.",
        "Map markers are snapped to unique routable nodes (5 m at the start and 0 m at the destination); these access offsets are shown separately.",
        "The BFS alternative has weighted cost 0.50 higher, is 0.23 km shorter, and is 0.0 minutes slower.",
    ]
    assert said["high_congestion_segments"][0] == {
        "name": "High St", "congestion": 4.5, "time_min": 4.0, "segment_count": 2
    }
    assert said["alternative_comparison"]["high_congestion_segments"] == 1
    lost = found | {"success": False, "message": "No route exists from 'a' to 'b'."}
    assert explain_search_result(lost, [], **names)["headline"] == "No route was found from A to B."
    assert explain_search_result(
        found, [road | {"congestion": 1.0}], **names
    )["reasons"][3].startswith("The selected route avoids")
    leaders = summarize_comparison([found, other, lost])["leaders"]
    assert leaders["lowest_cost"] == {
        "algorithms": ["dijkstra"], "value": 3.0
    } and leaders["shortest_distance"]["algorithms"] == ["breadth_first_search"]
    assert len(leaders["fastest_estimate"]["algorithms"]) == 2 and summarize_comparison([lost])["leaders"] == {}
