"""The planner's verbs as requests and responses: plain dictionaries in, status and dictionaries out; no server needed."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator, Mapping

from routeloom.operators.tours import METHODS
from routeloom.plans.planner import RoutePlanner
from routeloom.plans.schema import GraphError
from routeloom.sources.dimensions import ALGORITHMS, PRESETS, PROFILES
from routeloom.sources.sinks import json_value
from routeloom.streaming.trace import FRONTIER_SHOWN, SAMPLE_RATE

OK, UNPROCESSABLE, NOT_FOUND = 200, 422, 404
Check = Callable[[object], bool]
WEIGHTS = ("alpha_distance", "beta_time", "gamma_congestion", "delta_risk")

is_text: Check = lambda v: isinstance(v, str) and len(v) > 0
is_flag: Check = lambda v: isinstance(v, bool)
is_weights: Check = lambda v: v is None or isinstance(v, Mapping) and set(v) <= set(WEIGHTS)


def one_of(choices: Mapping | tuple) -> Check:
    return lambda v: isinstance(v, str) and v in choices


SCENARIO = {
    "criterion": (one_of(PRESETS), "balanced"),
    "traffic_profile": (one_of(PROFILES), "normal"),
    "custom_weights": (is_weights, None),
}
#: Per verb its fields: how each is checked and, if it may be left out, its default. Other fields are refused.
FIELDS: dict[str, dict[str, tuple]] = {
    "search": {"start_id": (is_text,), "goal_id": (is_text,), "algorithm": (one_of(ALGORITHMS), "dijkstra"), **SCENARIO},
    "compare": {"start_id": (is_text,), "goal_id": (is_text,), **SCENARIO},
    "multi-route": {
        "start_id": (is_text,), "waypoint_ids": (lambda v: isinstance(v, list) and len(v) > 0 and all(map(is_text, v)),), "method": (one_of(tuple(METHODS)), "nearest_neighbor"), "end_id": (lambda v: v is None or is_text(v), None),
        "return_to_start": (is_flag, False), "exact_limit": (lambda v: isinstance(v, int) and not isinstance(v, bool) and 1 <= v <= 9, 8), "compare_methods": (is_flag, False), **SCENARIO,
    },
}


def checked(verb: str, payload: Mapping) -> dict:
    """The payload with defaults; a missing, unknown or bad field raises."""
    fields = FIELDS[verb]
    if extra := sorted(set(payload) - set(fields)):
        raise GraphError(f"unknown fields: {', '.join(extra)}")
    if missing := sorted(f for f, rule in fields.items() if len(rule) == 1 and f not in payload):
        raise GraphError(f"missing fields: {', '.join(missing)}")
    out = {f: payload.get(f, *rule[1:]) for f, rule in fields.items()}
    if bad := sorted(f for f, rule in fields.items() if not rule[0](out[f])):
        raise GraphError(f"bad values of: {', '.join(bad)}")
    return out


def handle(planner: RoutePlanner, verb: str, payload: Mapping | None = None) -> tuple[int, dict]:
    """A verb's response; what is wrong with a request gives status 422 and says so, other errors propagate."""
    plain = {
        "health": lambda: {
            "status": "ok",
            "nodes": planner.summary.get("routable_nodes"),
            "edges": planner.summary.get("routable_edges"),
            "landmarks": planner.summary.get("landmarks"),
        },
        "bootstrap": planner.bootstrap,
        "network": planner.roads,
    }
    verbs = {"search": planner.search, "compare": planner.compare, "multi-route": planner.multi_route}
    if verb in plain:
        return OK, json_value(plain[verb]())
    if verb not in verbs:
        return NOT_FOUND, {"detail": f"no such verb: {verb}"}
    try:
        return OK, json_value(verbs[verb](**checked(verb, payload or {})))
    except GraphError as error:
        return UNPROCESSABLE, {"detail": str(error)}


def stream_search(planner: RoutePlanner, payload: Mapping, rate: int = SAMPLE_RATE) -> Iterator[dict]:
    """started, then every rate-th expansion as it occurs, then complete; or error, which ends the stream.

    The search runs beside the reader and hands each step over, so the first steps can be shown before it ends.
    """
    try:
        wanted = checked("search", payload)
    except GraphError as error:
        yield {"type": "error", "message": str(error)}
        return
    yield {"type": "started"}
    told: queue.SimpleQueue = queue.SimpleQueue()

    def on_step(step: dict) -> None:
        number = len(step["visited"])
        if step["event"] == "expand" and (number == 1 or number % rate == 0):
            more = {
                "visited_count": number,
                "frontier_count": len(step["frontier"]),
                "sample_rate": rate,
                "visited_encoding": "delta",
            }
            told.put(
                {
                    "type": "step",
                    "step": step | {
                        "frontier": step["frontier"][:FRONTIER_SHOWN],
                        "visited": [],
                        "visited_delta": [step["current_node"]],
                        "details": step["details"] | more,
                    },
                }
            )

    def work() -> None:
        try:
            told.put({"type": "complete", "payload": json_value(planner.search(**wanted, on_step=on_step))})
        except GraphError as error:
            told.put({"type": "error", "message": str(error)})
        except BaseException as error:  # noqa: BLE001  the reader must not wait for ever
            told.put(error)

    threading.Thread(target=work, daemon=True).start()
    while True:
        message = told.get()
        if isinstance(message, BaseException):
            raise message
        yield message
        if message["type"] != "step":
            return
