import json
import math

import pytest
from pyspark.sql import functions as F

from routeloom.functions.cost import Weights, check_costs, costed, with_profile
from routeloom.functions.geo import haversine_km
from routeloom.functions.scalar import is_close, road_type, speed_kmh, vietnamese
from routeloom.operators import searches, traversal
from routeloom.plans.schema import Graph, GraphError, validated, violations
from routeloom.sources import sinks
from routeloom.sources.dimensions import PRESETS
from routeloom.sources.graph_json import adjacency_json, coordinates, graph_from_rows, read_graph_json

EDGE = {"distance_km": 1.0, "time_min": 2.0, "congestion": 3.0, "risk": 1.0, "road_type": "primary"}
CITY = {
    "b": [EDGE | {"to": "a"}, EDGE | {"to": "c", "distance_km": 4.0, "metadata": {"name": "High St"}}],
    "a": [EDGE | {"to": "c"}],
    "c": [],
}
PLACES = {"a": (10.0, 106.0), "b": (10.01, 106.0), "c": (10.0, 106.02)}


def test_documents_keep_their_order(spark, tmp_path):
    graph = graph_from_rows(spark, CITY, PLACES)
    assert [r["node_id"] for r in graph.nodes.orderBy("node_ord").collect()] == ["b", "a", "c"]
    assert [
        (r["src"], r["edge_ord"], r["dst"]) for r in graph.edges.orderBy("src", "edge_ord").collect()
    ] == [("a", 0, "c"), ("b", 0, "a"), ("b", 1, "c")]
    path = tmp_path / "graph.json"
    path.write_text(json.dumps(CITY))
    bare = read_graph_json(spark, str(path))
    assert bare.nodes.count() == 3 and bare.edges.where(
        "dst = 'c' AND src = 'b'"
    ).first()["metadata"] == {"name": "High St"}
    with pytest.raises(GraphError, match="coordinates"):
        coordinates(bare)


def test_round_trip(spark):
    graph = graph_from_rows(spark, CITY, PLACES)
    text = adjacency_json(graph).first()["value"]
    from routeloom.sources.graph_json import graph_from_documents

    again = graph_from_documents(spark.createDataFrame([(text,)], "value string"))
    for side in ("nodes", "edges"):
        assert sorted(map(str, getattr(graph, side).collect())) == sorted(map(str, getattr(again, side).collect()))


def test_missing_fields_are_named(spark):
    with pytest.raises(GraphError, match="lacks fields: risk, road_type"):
        graph_from_rows(spark, {"a": [{"to": "a", "distance_km": 1, "time_min": 1, "congestion": 1}]})


def test_violations(spark):
    bad = {
        "a": [
            EDGE | {"to": "z"},
            EDGE | {"to": "a", "congestion": 0.5},
            EDGE | {"to": "a", "risk": 6.0},
            EDGE | {"to": "a", "distance_km": -1.0},
            EDGE | {"to": "a", "time_min": 7.0, "road_type": ""},
        ]
    }
    graph = graph_from_rows(spark, bad)
    graph = Graph(
        graph.nodes,
        graph.edges.withColumn("time_min", F.when(F.col("time_min") == 7, float("inf")).otherwise(F.col("time_min"))),
    )
    rules = sorted(r["rule"] for r in violations(graph).collect())
    assert rules == sorted(
        [
            "dst is a node",
            "congestion from 1 to 5",
            "risk from 0 to 5",
            "distance_km finite and not negative",
            "time_min finite and not negative",
            "road_type not empty",
        ]
    )
    with pytest.raises(GraphError, match="dst is a node: 1 broken, such as z"):
        validated(graph)
    empty = graph_from_rows(spark, {})
    assert validated(empty) is empty
    from routeloom.sources.graph_json import graph_from_documents

    with pytest.raises(GraphError, match="not an adjacency document"):
        graph_from_documents(spark.createDataFrame([("{oops",)], "value string"))


def test_weights():
    assert Weights.of({"cost_weights": {"alpha_distance": 2.0}}) == Weights(2.0, 1.0, 1.0, 1.0)
    for bad in (-1.0, math.nan, math.inf):
        with pytest.raises(GraphError, match="alpha must be finite and non-negative"):
            Weights(bad)
    with pytest.raises(TypeError):
        Weights(True)
    with pytest.raises(GraphError, match="expected: balanced"):
        Weights.preset("nope")
    assert Weights.preset("fastest").to_dict() == dict(
        zip(("alpha_distance", "beta_time", "gamma_congestion", "delta_risk"), PRESETS["fastest"])
    )


def test_profiles(spark):
    graph = graph_from_rows(
        spark, {"a": [EDGE | {"to": "a"}, EDGE | {"to": "a", "road_type": "motorway", "congestion": 4.5, "risk": 4.5}]}
    )
    rows = lambda p: with_profile(graph.edges, p).orderBy("edge_ord").collect()
    rush, rain = rows("rush_hour"), rows("rainy")
    assert rush[0]["time_min"] == pytest.approx(2 * (1.25 + 0.18 * 3)) and rush[1]["time_min"] == pytest.approx(
        2 * (1.25 + 0.05 * 4.5)
    )
    assert [r["congestion"] for r in rush] == [4.0, 5.0] and [r["risk"] for r in rush] == [1.0, 4.5]
    assert rain[0]["time_min"] == pytest.approx(2 * 1.3) and [
        r["congestion"] for r in rain
    ] == pytest.approx([3.4, 4.9]) and [r["risk"] for r in rain] == [2.2, 5.0]
    assert rain[0]["metadata"] == {"traffic_profile": "rainy"} and rows("normal")[0]["metadata"] == {}
    with pytest.raises(GraphError, match="Unknown traffic profile"):
        rows("snow")


def test_costs_are_checked_everywhere(spark):
    graph = graph_from_rows(spark, CITY)
    assert costed(graph.edges, Weights(1, 0.5, 2, 1)).orderBy("src").first()["cost"] == pytest.approx(1 + 1 + 6 + 1)
    with pytest.raises(GraphError, match="non-negative"):
        check_costs(costed(graph.edges, F.lit(-1)))
    with pytest.raises(GraphError, match="finite"):
        searches.shared(Graph(graph.nodes, costed(graph.edges, F.lit(None))))
    with pytest.raises(GraphError, match="more than 1 edges"):
        searches.in_memory(Graph(graph.nodes, costed(graph.edges, F.lit(1))), 1)


def test_scalars(spark):
    row = spark.range(1).select(
        haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("quarter"),
        road_type(F.lit('["primary","service"]')).alias("first"), road_type(F.lit("motorway_link")).alias("unknown"), road_type(F.lit(None).cast("string")).alias("none"),
        speed_kmh(F.lit("50 mph"), F.lit(24.0)).alias("fifty"), speed_kmh(F.lit("130"), F.lit(24.0)).alias("fast"), speed_kmh(F.lit('["30.5","40"]'), F.lit(24.0)).alias("list"), speed_kmh(F.lit(None).cast("string"), F.lit(24.0)).alias("unset"),
        vietnamese(F.lit("Ðường")).alias("eth"), vietnamese(F.lit('["A","","A","Ð"]')).alias("several"), vietnamese(F.lit("[]")).alias("empty"),
        is_close(F.lit(1.0), F.lit(1.0 + 1e-10)).alias("near"), is_close(F.lit(0.0), F.lit(1e-13), 1e-9, 1e-12).alias("tiny"), is_close(F.lit(1.0), F.lit(1.1)).alias("far"),
    ).first()
    assert row["quarter"] == pytest.approx(math.pi / 2 * 6371.0088)
    assert (row["first"], row["unknown"], row["none"]) == ("primary", "unclassified", "unclassified")
    assert (row["fifty"], row["fast"], row["list"], row["unset"]) == (50, 24, 30.5, 24)
    assert (row["eth"], row["several"], row["empty"]) == ("Đường", "A / Đ", None)
    assert (row["near"], row["tiny"], row["far"]) == (True, True, False)


def test_sinks(spark, tmp_path):
    path = sinks.save_result_json({"a": [1, {"b": None}], 2: "ü"}, tmp_path / "deep" / "r.json")
    assert path.read_text(encoding="utf-8").endswith("\n") and json.loads(
        path.read_text(encoding="utf-8")
    ) == {"a": [1, {"b": None}], "2": "ü"}
    for bad in (object(), {"a": object()}):
        with pytest.raises(TypeError):
            sinks.save_result_json(bad, tmp_path / "x.json")
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string")
    assert sinks.to_markdown(df).splitlines()[2] == "| 1 | a\\|b |"
    sinks.write_json_lines(df, str(tmp_path / "lines"))
    assert sorted(
        r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()
    ) == ['{"k":1,"v":"a|b"}', '{"k":2,"v":null}']


def test_set_based_and_kernel_searches_agree(spark):
    import random

    rng = random.Random(5)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(110)})
    rows = spark.createDataFrame(
        [(str(a), k, str(b), float(rng.randint(1, 9)), 1.0, 1.0) for k, (a, b) in enumerate(edges) if a != b],
        "src string, edge_ord int, dst string, cost double, distance_km double, time_min double",
    )
    rows = traversal.checkpointed(rows)
    nodes = spark.createDataFrame(
        [(str(k), k, 0.0, 0.0, "") for k in range(40)],
        "node_id string, node_ord int, latitude double, longitude double, display_name string",
    )
    sources = spark.createDataFrame([("0",), ("7",)], "source string")
    shared = searches.shared(Graph(nodes, rows))
    kernel = {
        (r["source"], r["node"]): r["cost"] for r in searches.run_all_targets(shared, sources, paths=False).collect()
    }
    found = traversal.checkpointed(traversal.shortest_paths(rows, sources))
    assert {(r["source"], r["node"]): r["cost"] for r in found.collect()} == kernel
    price = {(r["src"], r["dst"]): r["cost"] for r in rows.collect()}
    for r in traversal.paths(found, found.select("source", found["node"].alias("goal"))).collect():
        assert r["path"][0] == r["source"] and sum(
            price[p] for p in zip(r["path"], r["path"][1:])
        ) == kernel[r["source"], r["goal"]]
    levels = {(r["source"], r["node"]): r["level"] for r in traversal.bfs_levels(rows, sources).collect()}
    wanted = spark.createDataFrame(
        [(k, s, g, "bfs") for k, (s, g) in enumerate(kernel)],
        "request_id long, start string, goal string, algorithm string",
    )
    assert {
        (r["start"], r["goal"]): len(r["path"]) - 1 for r in searches.run_searches(shared, wanted).collect()
    } == levels


def test_set_based_components(spark):
    from routeloom.operators.etl import component_labels

    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "a"), ("g", "h")]
    edges = spark.createDataFrame(ring, "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcdefgh"], "node string")
    want = {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "g": "g", "h": "h"}
    assert {r["node"]: r["component"] for r in traversal.strong_components(nodes, edges).collect()} == want
    named = nodes.withColumnRenamed("node", "node_id")
    assert {r["node_id"]: r["component"] for r in component_labels(named, edges).collect()} == want
    assert {r["node_id"]: r["component"] for r in component_labels(named, edges, most=3).collect()} == want


def test_components_of_many_edges_are_not_gathered(spark, monkeypatch):
    from routeloom.operators import etl

    def fail(net):
        raise AssertionError("all edges are on the driver")

    monkeypatch.setattr(etl.kernels, "components", fail)
    ids = spark.range(800).select(F.format_string("n%03d", "id").alias("node_id"))
    edges = ids.toDF("src").crossJoin(ids.toDF("dst")).where("(src < 'n700') = (dst < 'n700')")
    got = etl.component_labels(ids, edges.unionAll(ids.limit(1).select("node_id", F.lit("n799"))))
    assert {r["component"]: r["n"] for r in etl.component_sizes(got).withColumnRenamed("size", "n").collect()} == {
        "n000": 700, "n700": 100
    }


def test_links_are_not_shuffled_for_a_small_frontier(spark, monkeypatch):
    links = traversal.checkpointed(spark.range(1000).selectExpr("id AS src", "(id * 7 + 3) % 50 AS dst", "id % 9 + 1 AS w"))
    start = spark.createDataFrame([(1,), (5,)], "source long")
    frontier = start.withColumn("node", F.col("source"))
    plan = lambda n: traversal.onward(frontier, links, n)._jdf.queryExecution().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "hashpartitioning" not in plan(2) and "hashpartitioning" in plan(traversal.SENT_ENTRIES + 1)
        rows = lambda: sorted(map(tuple, traversal.shortest_paths(links, start, "w").collect()))
        sent = rows()
        monkeypatch.setattr(traversal, "SENT_ENTRIES", 0)
        assert rows() == sent and len(sent) > 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
