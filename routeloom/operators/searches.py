"""Batches of searches: Spark deals requests to tasks, each of which has the graph."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator
from functools import partial
from itertools import islice

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.functions.cost import checked_costs
from routeloom.operators import kernels
from routeloom.operators.stored import stored_each
from routeloom.operators.traversal import written
from routeloom.plans.schema import BRIEF_TRACE, SEARCH_RESULT, TRACE, Graph, GraphError

#: A graph of more edges or nodes isn't sent to tasks (each edge takes about 150 bytes there): they map it from the shared folder.
MAX_EDGES = 1_000_000
#: Steps of a trace that a task holds, and brief ones that it hands over together.
STEPS_HELD, BRIEF_HELD = 200, 2000


def held(df: DataFrame, most: int) -> pd.DataFrame:
    """A frame on the driver, computed once; more than `most` rows raise before any is fetched."""
    df = df.persist()
    try:
        if df.count() > most:
            raise GraphError(f"the graph has more than {most} edges or nodes; use shared")
        return df.toArrow().to_pandas()
    finally:
        df.unpersist()


def in_memory(graph: Graph, most: int = MAX_EDGES) -> kernels.Network:
    """The costed graph as arrays on the driver; its size and its costs are checked."""
    edges = held(graph.edges.select("src", "edge_ord", "dst", "cost", "distance_km", "time_min"), most)
    checked_costs(edges)
    return kernels.network(held(graph.nodes.select("node_id", "node_ord", "latitude", "longitude"), most), edges)


def shared(graph: Graph, most: int = MAX_EDGES) -> Broadcast:
    """The costed graph as a broadcast that all queries of one scenario share; a large one is sent as the names of its files."""
    return shared_each(graph, ("cost",), most)["cost"]


def shared_each(graph: Graph, costs: tuple[str, ...], most: int = MAX_EDGES) -> dict[str, Broadcast]:
    """As shared, by each of some columns that hold costs: a large graph's ends and names are stored once for all of them."""
    edges = graph.edges.count()
    if edges > most:
        graph = Graph(written(graph.nodes), graph.edges)
    nodes = graph.nodes.count()
    if max(nodes, edges) > most:
        nets = stored_each(graph, nodes, edges, costs)
    else:
        nets = [in_memory(Graph(graph.nodes, graph.edges.withColumn("cost", F.col(c))), most) for c in costs]
    send = graph.edges.sparkSession.sparkContext.broadcast
    return {c: send(net) for c, net in zip(costs, nets)}


def dealt(requests: DataFrame) -> DataFrame:
    """The requests over as many tasks as there are cores, whatever file they came from."""
    return requests.repartition(requests.sparkSession.sparkContext.defaultParallelism)


def run_searches(
    net: Broadcast,
    requests: DataFrame,
    scale: float = 1.0,
    heuristic: kernels.Heuristic | None = None,
    visited: bool = True,
) -> DataFrame:
    """`requests` (request_id, start, goal, algorithm) to search results, one row each.

    scale: the weight of distance, by which A* multiplies great-circle km so that it never overestimates. Without
    visited, visited_order is null: reports that only count need not move it.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for k in range(0, len(pdf), 2000):
                part = pdf.iloc[k : k + 2000]
                rows = kernels.search_many(
                    net.value, list(zip(part["algorithm"], part["start"], part["goal"])), heuristic, scale, visited
                )
                for r, row in zip(part["request_id"], rows):
                    row["request_id"] = r
                for j in range(0, len(rows), 500):
                    yield frame(rows[j : j + 500], schema)

    schema = T.StructType.fromDDL(f"request_id long, {SEARCH_RESULT}")
    wanted = requests.select(F.col("request_id").cast("long"), "start", "goal", "algorithm")
    sharing = F.col("algorithm").isin(*kernels.KINDS)
    # requests that can share a run meet in one of four tasks; four, so that a start of many requests is no task's burden alone
    kind = F.when(
        sharing,
        F.concat_ws(
            ":", F.pmod(F.xxhash64("goal"), F.lit(4)), F.when(F.col("algorithm").isin("bfs", "dfs"), F.col("algorithm"))
        ),
    ).otherwise(F.col("goal"))
    tasks = 4 * requests.sparkSession.sparkContext.defaultParallelism
    return wanted.repartition(tasks, "start", kind).sortWithinPartitions("start", "algorithm").mapInPandas(scan, schema)


def run_all_targets(
    net: Broadcast, sources: DataFrame, goals: list[str] | None = None, paths: bool = True
) -> DataFrame:
    """`sources` (source) to cheapest routes to each goal: one run a source; without paths only (source, node, cost).

    All routes of a source share the visited order of its run.
    """
    full = T.StructType.fromDDL(f"source string, {SEARCH_RESULT}")
    brief = T.StructType.fromDDL("source string, node string, cost double")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = net.value.ready()
        for pdf in frames:
            for source in pdf["source"]:
                if paths:
                    rows = kernels.all_targets(own, source, goals)
                    for k in range(0, len(rows), 2000):
                        yield frame([{"source": source} | r for r in rows[k : k + 2000]], full)
                else:
                    cost = kernels.relaxing(own, own.at(source, "start"), None, None, None).cost
                    wanted = cost if goals is None else [own.at(g, "goal") for g in goals if own.at(g, "goal") in cost]
                    yield pd.DataFrame(
                        {"source": source, "node": [own.ids[n] for n in wanted], "cost": [cost[n] for n in wanted]}
                    )

    return dealt(sources.select("source")).mapInPandas(scan, full if paths else brief)


def steps_of(call: Callable[[Callable[[dict], None]], object]) -> Iterator[dict]:
    """The steps that a call hands to its callback, as they occur; the call waits while STEPS_HELD of them are unread."""
    told: queue.Queue = queue.Queue(STEPS_HELD)

    def work() -> None:
        try:
            call(told.put)
            told.put(None)
        except BaseException as error:  # noqa: BLE001  it is raised where the steps are read
            told.put(error)

    threading.Thread(target=work, daemon=True).start()
    while (step := told.get()) is not None:
        if isinstance(step, BaseException):
            raise step
        yield step


def run_traces(
    net: Broadcast,
    requests: DataFrame,
    scale: float = 1.0,
    shown: int | None = None,
    events: tuple[str, ...] | None = None,
) -> DataFrame:
    """`requests` to the events of their searches, one row each, or to those of some kinds.

    A step has its frontier and all nodes visited so far, so a whole trace grows with the square of the search; steps
    leave the task as they occur, a few at a time. A brief trace, with `shown`, has that many entries of each frontier,
    and frontier_size and visited_size instead of the nodes.
    """
    schema = T.StructType.fromDDL(f"request_id long, {TRACE if shown is None else BRIEF_TRACE}")
    most = STEPS_HELD if shown is None else BRIEF_HELD

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for request, start, goal, algorithm in zip(pdf["request_id"], pdf["start"], pdf["goal"], pdf["algorithm"]):
                search = partial(
                    kernels.search, net.value, algorithm, start, goal, None, scale, shown=shown, events=events
                )
                steps = steps_of(search)
                while part := list(islice(steps, most)):
                    for s in part:
                        s["details"] = {k: None if v is None else str(v) for k, v in s["details"].items()}
                    yield frame([{"request_id": request} | s for s in part], schema)

    return dealt(
        requests.select(F.col("request_id").cast("long"), "start", "goal", "algorithm")
    ).mapInPandas(scan, schema)


def frame(rows: list[dict], schema: T.StructType) -> pd.DataFrame:
    """Rows as a frame with the schema's columns; missing numbers stay missing."""
    pdf = pd.DataFrame(rows, columns=schema.names)
    for f in schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            pdf[f.name] = pdf[f.name].astype("Float64")
    return pdf


def each_step(trace: DataFrame, on_step: Callable[[dict], None]) -> None:
    """Hands every step of a trace to a callback in order, without holding the trace on the driver."""
    for row in trace.orderBy("request_id", "index").toLocalIterator():
        on_step(row.asDict(recursive=True))
