import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routeloom.operators import kernels
from routeloom.plans.schema import GraphError
from tests.graphs import HARBOUR, HARBOUR_GUESS, ROUND, net, run, trace

COST_AWARE = ("ucs", "dijkstra", "astar")


CHEAPEST = ["quay", "mill", "well", "forge", "gate"]
SHORTEST = ["quay", "mill", "forge", "gate"]


@pytest.mark.parametrize(
    ("algorithm", "path", "cost"),
    [(a, CHEAPEST, 9) for a in COST_AWARE] + [("bfs", SHORTEST, 10), ("dfs", SHORTEST, 10)] + [("greedy", ["quay", "inn", "well", "gate"], 17)],
)
def test_ways_through_the_harbour(algorithm, path, cost):
    found = run(HARBOUR, algorithm, "quay", "gate", HARBOUR_GUESS)
    assert found["path"] == path and found["total_cost"] == cost and found["visited_order"][-1] == "gate"
    assert (found["optimality"] == "not_guaranteed") == (algorithm in ("dfs", "greedy"))


@pytest.mark.parametrize("algorithm", kernels.MESSAGES)
def test_nowhere_to_go(algorithm):
    here = run(HARBOUR, algorithm, "well", "well", HARBOUR_GUESS)
    assert here["path"] == ["well"] and here["success"]
    assert [here[c] for c in ("total_cost", "expanded_nodes", "generated_nodes")] == [0, 1, 1]
    back = run(HARBOUR, algorithm, "gate", "quay", HARBOUR_GUESS)
    assert not back["success"] and back["path"] == [] and back["total_cost"] is None
    assert back["message"] == "No route exists from 'gate' to 'quay'." and back["optimality"] == "not_applicable"


def test_equal_ways_go_by_the_order_of_edges():
    for first, second in (("left", "right"), ("right", "left")):
        fork = {"in": [(first, 2), (second, 2)], "left": [("out", 5)], "right": [("out", 5)], "out": []}
        for algorithm in ("bfs", "ucs", "dijkstra"):
            assert run(fork, algorithm, "in", "out")["path"] == ["in", first, "out"]


def test_outdated_entries_are_told_and_skipped():
    # the inn's second offer for the mill (4) is worse than the first (3); a shortcut makes the first one outdated
    graph = HARBOUR | {"quay": [("mill", 9), ("inn", 2)], "isle": []}
    found, steps = trace(graph, "dijkstra", "quay", "isle")
    told = [s["details"] for s in steps if s["event"] == "skip_stale"]
    assert not found["success"] and {"cost": 9.0, "best_cost": 4.0} in told
    assert len(found["visited_order"]) == len(set(found["visited_order"])) == 6


def test_totals_add_up_the_edges_of_the_way():
    graph = {"x": [("y", 2, 0.5, 7), ("z", 9, 1, 1)], "y": [("z", 3, 1.25, 4)], "z": []}
    found = run(graph, "ucs", "x", "z")
    assert [found[c] for c in ("total_cost", "total_distance_km", "total_time_min")] == [5, 1.75, 11]


def test_one_run_serves_all_targets():
    got = kernels.all_targets(net(HARBOUR | {"isle": []}), "quay")
    assert {r["goal"]: r["total_cost"] for r in got} == {
        "quay": 0, "mill": 3, "inn": 2, "well": 4, "forge": 6, "gate": 9, "isle": None
    }
    assert all(r["visited_order"] == got[0]["visited_order"] for r in got)
    assert [r["goal"] for r in kernels.all_targets(net(ROUND), "fair", ["park", "dock", "park"])] == ["park", "dock"]
    with pytest.raises(TypeError):
        kernels.all_targets(net(ROUND), "fair", "park")


def test_requests_are_checked():
    with pytest.raises(GraphError, match="does not exist"):
        run(HARBOUR, "dijkstra", "quay", "moon")
    with pytest.raises(GraphError, match="expected: bfs"):
        run(HARBOUR, "walk", "quay", "gate")


@pytest.mark.parametrize(
    ("value", "error", "said"),
    [
        (-1, GraphError, "non-negative"),
        (math.nan, GraphError, "finite"),
        (True, TypeError, "number"),
        ("1", TypeError, "number"),
    ],
)
def test_bad_guesses_raise(value, error, said):
    with pytest.raises(error, match=said):
        run(HARBOUR, "greedy", "quay", "gate", lambda n, g: value)


def test_greedy_generates_each_node_once():
    found = run(ROUND | {"isle": []}, "greedy", "dock", "isle", lambda n, g: 0)
    assert not found["success"] and found["expanded_nodes"] == found["generated_nodes"] == 4


def test_depth_first_keeps_the_parent_that_saw_a_node_first():
    # the well is seen from the mill before the inn is left, so its way doesn't lead over the inn
    graph = {"quay": [("inn", 1), ("mill", 1)], "inn": [("mill", 1)], "mill": [("well", 1)], "well": []}
    assert run(graph, "dfs", "quay", "well")["path"] == ["quay", "mill", "well"]


def test_a_star_adds_cost_and_guess_and_takes_nodes_up_again():
    _, steps = trace(HARBOUR, "astar", "quay", "gate", HARBOUR_GUESS)
    told = [s["details"] for s in steps if s["event"] in ("expand", "relax")]
    assert told and all(math.isclose(d["f"], d["g"] + d["h"]) for d in told)
    misled = {"quay": 0, "mill": 0, "inn": 0, "well": 4, "forge": 0, "gate": 0}  # the forge is reached by the mill first
    found = run(HARBOUR, "astar", "quay", "gate", misled)
    assert found["visited_order"].count("forge") == 2 and found["path"] == CHEAPEST


def test_traces_are_ordered_and_end_at_the_goal():
    for algorithm in kernels.MESSAGES:
        found, steps = trace(HARBOUR, algorithm, "quay", "gate", HARBOUR_GUESS)
        assert [s["index"] for s in steps] == list(range(len(steps))) and steps[-1]["event"] == "goal"
        assert sum(s["event"] == "expand" for s in steps) == found["expanded_nodes"]
        for s in steps:
            order = [e["priority"] for e in s["frontier"]]
            assert order == sorted(order)
    _, steps = trace(ROUND, "bfs", "dock", "fair")
    assert next(s for s in steps if s["event"] == "generate")["details"] == {"neighbor": "hall", "depth_priority": 0}


GRAPHS = st.integers(2, 9).flatmap(
    lambda n: st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(0, 9)), max_size=30).map(
        lambda es: {str(k): [(str(b), c) for a, b, c in es if a == k and b != k] for k in range(n)}
    )
)


@settings(max_examples=150, deadline=None)
@given(GRAPHS)
def test_searches_agree_with_floyd_warshall(graph):
    n = len(graph)
    far = np.full((n, n), np.inf)
    np.fill_diagonal(far, 0)
    hops = far.copy()
    for a, out in graph.items():
        for b, c in out:
            far[int(a), int(b)] = min(far[int(a), int(b)], c)
            hops[int(a), int(b)] = min(hops[int(a), int(b)], 1)
    for k in range(n):
        far, hops = (np.minimum(m, m[:, [k]] + m[[k], :]) for m in (far, hops))
    for goal in range(n):
        for algorithm in kernels.MESSAGES:
            found = run(graph, algorithm, "0", str(goal), lambda node, g: 0.0)
            assert found["success"] == bool(np.isfinite(far[0, goal]))
            if found["success"]:
                edges = {(a, b) for a, out in graph.items() for b, _ in out}
                assert all(pair in edges for pair in zip(found["path"], found["path"][1:]))
                if algorithm in COST_AWARE:
                    assert found["total_cost"] == far[0, goal]
                if algorithm == "bfs":
                    assert len(found["path"]) - 1 == hops[0, goal]


@settings(max_examples=100, deadline=None)
@given(GRAPHS)
def test_components_are_mutual_reachability(graph):
    n = len(graph)
    reach = np.eye(n, dtype=bool)
    for a, out in graph.items():
        for b, _ in out:
            reach[int(a), int(b)] = True
    for k in range(n):
        reach |= reach[:, [k]] & reach[[k], :]
    both = reach & reach.T
    assert kernels.components(net(graph)).tolist() == [int(np.flatnonzero(both[k])[0]) for k in range(n)]


@settings(max_examples=60, deadline=None)
@given(GRAPHS)
def test_shared_runs_equal_single_searches(graph):
    network = net(graph)
    requests = [(a, s, g) for a in kernels.MESSAGES for s in graph for g in graph]
    plain = lambda r: {k: v for k, v in r.items() if k != "runtime_ms"}
    for request, got in zip(requests, kernels.search_many(network, requests, lambda n, g: float(n != g))):
        assert plain(got) == plain(kernels.search(network, *request, lambda n, g: float(n != g)))
