import random

import pytest
from pyspark.sql import functions as F

from routeloom.operators import kernels, searches, stored, tours, traversal
from routeloom.plans import queries
from routeloom.plans.schema import Graph, GraphError
from routeloom.sources import derived
from routeloom.streaming.trace import display_steps
from tests.conftest import same_rows
from tests.graphs import net


def town(spark, n=60, m=260):
    """A graph with a node that no edge touches, parallel edges, and node_ord that isn't the order of the ids."""
    rng = random.Random(3)
    ends = [(a, b) for a, b in ((rng.randrange(n - 1), rng.randrange(n - 1)) for _ in range(m)) if a != b]
    edges = spark.createDataFrame(
        [(f"ö{a}", k, f"ö{b}", float(rng.randint(1, 9)), rng.random(), rng.random()) for k, (a, b) in enumerate(ends)],
        "src string, edge_ord int, dst string, cost double, distance_km double, time_min double",
    )
    nodes = spark.createDataFrame(
        [(f"ö{k}", n - k, 10 + k / 1000, 106.0, "") for k in range(n)],
        "node_id string, node_ord int, latitude double, longitude double, display_name string",
    )
    return Graph(nodes, edges)


def test_a_stored_graph_gives_what_one_in_memory_gives(spark):
    graph = town(spark)
    whole, large = searches.in_memory(graph), searches.shared(graph, 50)
    assert isinstance(large.value, stored.StoredNetwork)
    small = stored.stored(graph, 60, 260, 17)  # of several parts
    assert len(small.targets.names) > 3 and list(small.ids) == whole.ids
    asked = [(a, s, g) for a in kernels.MESSAGES for s in ("ö0", "ö7", "ö59") for g in ("ö3", "ö58", "ö59")]
    plain = lambda r: {k: v for k, v in r.items() if k != "runtime_ms"}
    want = [plain(r) for r in kernels.search_many(whole, asked)]
    for other in (small, large.value):
        assert [plain(r) for r in kernels.search_many(other, asked)] == want
        assert kernels.all_targets(other, "ö5")[3]["path"] == kernels.all_targets(whole, "ö5")[3]["path"]
        stops = ["ö9", "ö4", "ö9", "ö21"]
        assert tours.checked(other, "ö1", stops) == tours.checked(whole, "ö1", stops)
        with pytest.raises(GraphError, match="does not exist"):
            tours.checked(other, "ö1", ["ö60"])
    sources = spark.createDataFrame([("ö0",), ("ö7",)], "source string")
    rows = lambda n: sorted(map(tuple, searches.run_all_targets(n, sources, paths=False).collect()))
    assert rows(large) == rows(spark.sparkContext.broadcast(whole))


def test_a_stored_graph_is_checked(spark):
    graph = town(spark)
    for cost, what in ((F.lit(None).cast("double"), "finite"), (F.lit(-1.0), "non-negative")):
        with pytest.raises(GraphError, match=what):
            searches.shared(Graph(graph.nodes, graph.edges.withColumn("cost", cost)), 50)
    with pytest.raises(Exception, match="not a node"):
        searches.shared(Graph(graph.nodes.where("node_id <> 'ö1'"), graph.edges), 50)


def test_brief_traces_say_what_whole_ones_say(spark):
    graph = town(spark)
    sent = spark.sparkContext.broadcast(searches.in_memory(graph))
    wanted = spark.createDataFrame(
        [(k, "ö0", "ö58", a) for k, a in enumerate(kernels.MESSAGES)],
        "request_id long, start string, goal string, algorithm string",
    )
    whole = searches.run_traces(sent, wanted).cache()
    rows = lambda df: sorted(map(repr, df.collect()))
    counted = whole.select(
        "request_id",
        "index",
        "event",
        "current_node",
        F.slice("frontier", 1, 5).alias("frontier"),
        F.size("frontier").alias("frontier_size"),
        F.size("visited").alias("visited_size"),
        "details",
    )
    assert rows(searches.run_traces(sent, wanted, shown=5)) == rows(counted)
    shown = searches.run_traces(sent, wanted, shown=5, events=("expand",))
    assert rows(display_steps(shown, 2, 5)) == rows(display_steps(whole, 2, 5))


def test_a_step_of_a_brief_trace_costs_the_same_in_a_long_search():
    """A star of 20,000 nodes: whole steps would hold 400 million entries."""
    steps = []
    star = {"hub": [(f"n{k}", 1) for k in range(20_000)]} | {f"n{k}": [] for k in range(20_000)}
    kernels.search(net(star), "dijkstra", "hub", "n19999", on_step=steps.append, shown=3, events=("expand",))
    assert len(steps) == 20_001 and steps[1]["frontier_size"] == 19_999 and len(steps[1]["frontier"]) == 3
    assert [e["node"] for e in steps[2]["frontier"]] == ["n2", "n3", "n4"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_derived_edges_are_sorted_once_and_numbered_without_a_window(spark, sf_dir):
    """60 times sf0.1 had a sort of all hops ahead of the shuffle, and the edges' order as a window of its own."""
    edges = derived.basket_edges(spark, sf_dir)
    assert "WindowGroupLimit" not in plan_of(edges)
    same_rows(edges.toPandas(), derived.run_sql(spark, sf_dir, derived.EDGES_SQL).toPandas())
    kept = spark.createDataFrame(edges.limit(50).collect(), edges.schema)
    assert "Window" not in plan_of(derived.basket_graph(kept).edges)


def test_a_stored_graph_says_which_edge_has_a_bad_cost(spark):
    graph = town(spark)
    bad = graph.edges.withColumn("cost", F.when(F.col("edge_ord") == 9, -2.0).otherwise(F.col("cost")))
    row = bad.where("edge_ord = 9").first()
    with pytest.raises(GraphError, match=f"'{row['src']}' -> '{row['dst']}' is not non-negative: -2.0"):
        stored.stored(Graph(graph.nodes, bad), 60, 260, 17)


def test_scenarios_share_one_stored_graph(spark, sf_dir, monkeypatch):
    """Each profile's graph was stored whole, though only costs differ."""
    made, store = [], stored.stored_each
    monkeypatch.setattr(searches, "stored_each", lambda *a: made.append(a) or store(*a))
    monkeypatch.setattr(searches.shared_each, "__defaults__", (50,))
    large = sorted(map(tuple, queries.scenario_changed_pairs(spark, sf_dir).collect()))
    assert len(made) == 1
    monkeypatch.undo()
    assert large == sorted(map(tuple, queries.scenario_changed_pairs(spark, sf_dir).collect())) and large


def test_names_that_are_not_asked_for_are_not_read(spark, monkeypatch):
    """Each of 3,312 searches named its whole visit, and each name was read from the files again."""
    net, read = stored.stored(town(spark), 60, 260, 17), []
    look = stored.Names.read
    monkeypatch.setattr(stored.Names, "read", lambda self, n: read.append(n) or look(self, n))
    asked = [(a, "ö0", g) for a in kernels.MESSAGES for g in ("ö3", "ö58")]
    brief = kernels.search_many(net, asked, visited=False)
    assert all(r["visited_order"] is None for r in brief) and len(read) == len(set(read))
    whole = kernels.search_many(net, asked)
    assert len(read) == len(set(read)) and all(len(r["visited_order"]) == r["expanded_nodes"] for r in whole)
    plain = lambda r: {k: v for k, v in r.items() if k not in ("runtime_ms", "visited_order")}
    assert list(map(plain, whole)) == list(map(plain, brief))


def test_admissible_costs_need_no_join(spark, sf_dir):
    edges = spark.createDataFrame(derived.basket_edges(spark, sf_dir).limit(50).collect(), queries.derived.basket_edges(spark, sf_dir).schema)
    assert "Join" not in plan_of(queries.admissible_graph(edges).edges)


def test_links_of_cheapest_paths_are_not_grouped_first(spark, monkeypatch):
    plans, write = [], traversal.written
    monkeypatch.setattr(traversal, "written", lambda df: plans.append(plan_of(df)) or write(df))
    rows = [(1, 2, 5), (1, 2, 3), (1, 2, None), (2, 3, 1), (1, 3, None)]
    edges = spark.createDataFrame(rows, "src long, dst long, cost long")
    found = traversal.shortest_paths(edges, spark.createDataFrame([(1,)], "source long")).collect()
    assert sorted((r["node"], r["cost"], r["hops"]) for r in found) == [(1, 0, 0), (2, 3, 1), (3, 4, 2)]
    assert len(plans) == 1 and "Aggregate" not in plans[0]
