"""Graphs too large to send: tasks write the arrays of a costed graph to the shared folder, and searches map them.

A search reads the pages of what it visits, so a task needs memory for the nodes that it reaches and not for the graph;
the driver holds one row for each part.
"""

from __future__ import annotations

import os
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions.cost import checked_costs
from routeloom.operators import kernels
from routeloom.operators.traversal import checkpointed, shared_folder, written
from routeloom.plans.schema import Graph, GraphError

#: Nodes and edges of a part, about; and edges that are drawn for each to place its bounds.
PART, DRAWN = 250_000, 100
#: Edges that a process keeps as the loops read them (about 150 bytes each).
KEPT_EDGES = 500_000
#: Ids that a process keeps with their numbers, in each direction.
KEPT_IDS = 100_000
#: A table of up to so many nodes is broadcast to number the ends of edges; a larger one is joined by shuffle.
SENT_NODES = 1_500_000
#: Bits of a node's number, where its part stands above it.
NUMBER_BITS = 40
PIECE = "name string, first long, last long, n long, bad_src long, bad_dst long, bad_cost double"
PIECE_SCHEMA = pa.schema(
    [("name", pa.string()), *((c, pa.int64()) for c in ("first", "last", "n", "bad_src", "bad_dst")), ("bad_cost", pa.float64())]
)
Write = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class Parts:
    """An array in parts, each of which is mapped when it is first read; parts[k] begins at begins[k]."""

    def __init__(self, folder: str, names: list[str], begins: np.ndarray, what: str, kind: str):
        self.folder, self.names, self.what, self.kind = folder, names, what, kind
        self.begins: list[int] = begins.tolist()
        self.maps: dict[int, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return vars(self) | {"maps": {}}

    def part(self, k: int) -> np.ndarray:
        if k not in self.maps:
            path = f"{self.folder}/{self.names[k]}.{self.what}"
            self.maps[k] = np.memmap(path, self.kind, "r") if os.path.getsize(path) else np.zeros(0, self.kind)
        return self.maps[k]

    def __getitem__(self, at: int):
        k = bisect_right(self.begins, at) - 1
        return self.part(k)[at - self.begins[k]]


@dataclass
class Names:
    """The nodes' ids by number; those last read are kept."""

    n: int
    ends: Parts
    texts: Parts
    known: dict[int, str] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return vars(self) | {"known": {}}

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, node: int) -> str:
        if (known := self.known.get(node)) is not None:
            return known
        if not 0 <= node < self.n:
            raise IndexError(node)
        if len(self.known) >= KEPT_IDS:
            self.known.clear()
        self.known[node] = found = self.read(node)
        return found

    def read(self, node: int) -> str:
        k = bisect_right(self.ends.begins, node) - 1
        at, ends = node - self.ends.begins[k], self.ends.part(k)
        return self.texts.part(k)[ends[at - 1] if at else 0 : ends[at]].tobytes().decode()


class Numbers:
    """The nodes' numbers by id: a search among the hashes of the ids, which are kept in order, and a look at the ids."""

    def __init__(self, names: Names, hashes: Parts, nodes: Parts, firsts: np.ndarray):
        self.names, self.hashes, self.nodes, self.firsts = names, hashes, nodes, firsts
        self.known: dict[str, int | None] = {}

    def __getstate__(self) -> dict:
        return vars(self) | {"known": {}}

    def get(self, node: str) -> int | None:
        if node not in self.known:
            if len(self.known) >= KEPT_IDS:
                self.known.clear()
            self.known[node] = self.found(node)
        return self.known[node]

    def found(self, node: str) -> int | None:
        wanted = id_hash(node)
        for k in range(max(0, int(np.searchsorted(self.firsts, wanted)) - 1), len(self.firsts)):
            if self.firsts[k] > wanted:
                break
            part = self.hashes.part(k)
            for at in range(*(int(np.searchsorted(part, wanted, side=s)) for s in ("left", "right"))):
                if self.names[number := int(self.nodes.part(k)[at])] == node:
                    return number
        return None

    def __contains__(self, node: str) -> bool:
        return self.get(node) is not None

    def __getitem__(self, node: str) -> int:
        found = self.get(node)
        if found is None:
            raise KeyError(node)
        return found


def id_hash(node: str) -> int:
    """63 bits of an id, by FNV-1a."""
    out = 0xCBF29CE484222325
    for byte in node.encode():
        out = (out ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return out >> 1


@dataclass
class Out:
    """The (target, cost, edge) of each node's edges, in edge order; those last read are kept."""

    firsts: np.ndarray
    starts: Parts
    targets: Parts
    cost: Parts
    kept: dict[int, list[tuple[int, float, int]]] = field(default_factory=dict)
    count: int = 0

    def __getstate__(self) -> dict:
        return vars(self) | {"kept": {}, "count": 0}

    def __getitem__(self, node: int) -> list[tuple[int, float, int]]:
        if (known := self.kept.get(node)) is not None:
            return known
        k = int(np.searchsorted(self.firsts, node, side="right")) - 1
        found: list[tuple[int, float, int]] = []
        if k >= 0:
            starts, at = self.starts.part(k), node - int(self.firsts[k])
            if at + 1 < len(starts):
                a, b, first = int(starts[at]), int(starts[at + 1]), int(self.targets.begins[k])
                found = list(
                    zip(self.targets.part(k)[a:b].tolist(), self.cost.part(k)[a:b].tolist(), range(first + a, first + b))
                )
        if self.count > KEPT_EDGES:
            self.kept.clear()
            self.count = 0
        self.kept[node] = found
        self.count += len(found) + 1
        return found


@dataclass
class StoredNetwork(kernels.Network):
    """A network whose arrays lie in the shared folder."""

    def __getstate__(self) -> dict:
        return vars(self) | {"known": {}}

    def ready(self) -> StoredNetwork:
        return self


def folder_of(df: DataFrame) -> str:
    """A new folder in the shared checkpoint folder, as a path that tasks can open."""
    shared = urlparse(shared_folder(df.sparkSession))
    if shared.scheme not in ("", "file"):
        raise GraphError(
            f"a graph of this size needs a spark.checkpoint.dir that tasks can open as a folder, not {shared.scheme}:"
        )
    folder = f"{shared.path}/graph-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def pieces_of(df: DataFrame, write: Write) -> pd.DataFrame:
    """One row (name, first, last, n, ...) for each part that `write` made of the frame's partitions, by first: few rows."""
    return df.mapInArrow(write, PIECE).toPandas().sort_values("first", kind="stable").reset_index(drop=True)


def writer(folder: str, key: str, columns: dict[str, tuple[str, str]], more: Callable | None = None) -> Write:
    """A function that writes a partition's columns {name: (column, kind)} to files of a name of their own.

    more(rows, state, files) adds what isn't a plain column, and what `bad` in the state says goes to the driver. Another
    attempt at a task writes other files, and only those that a task reports are read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, files, state = uuid.uuid4().hex, {}, {}
        first, last, n = None, None, 0

        def to(what: str):
            if what not in files:
                files[what] = open(f"{folder}/{name}.{what}", "wb")  # noqa: SIM115  closed below
            return files[what]

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: v.to_numpy(zero_copy_only=False) for c, v in zip(batch.schema.names, batch.columns)}
            for what, (column, kind) in columns.items():
                to(what).write(rows[column].astype(kind, copy=False).tobytes())
            if more:
                more(rows, state, to)
            first = int(rows[key][0]) if first is None else first
            last, n = int(rows[key][-1]), n + batch.num_rows
        if more and n:
            more(None, state, to)
        for file in files.values():
            file.close()
        if n:
            values = (name, first, last, n, *state.get("bad", (None, None, None)))
            yield pa.RecordBatch.from_pylist([dict(zip(PIECE_SCHEMA.names, values))], PIECE_SCHEMA)

    return scan


def write_names(rows: dict[str, np.ndarray] | None, state: dict, to) -> None:
    """The ids one after another, and where each ends."""
    if rows is None:
        return
    texts = [v.encode() for v in rows["node_id"]]
    ends = state.get("end", 0) + np.cumsum([len(v) for v in texts], dtype=np.int64)
    to("texts").write(b"".join(texts))
    to("ends").write(ends.tobytes())
    state["end"] = int(ends[-1])


def write_starts(rows: dict[str, np.ndarray] | None, state: dict, to) -> None:
    """Where the edges of each node, from the part's first node to its last, begin; and where they all end."""
    if rows is None:
        to("starts").write(np.int64(state["n"]).tobytes())
        return
    src, n = rows["src_n"], state.get("n", 0)
    known = state.get("next", int(src[0]))  # the first node whose edges' begin isn't written yet
    starts = n + np.searchsorted(src, np.arange(known, int(src[-1]) + 1))
    to("starts").write(starts.astype(np.int64).tobytes())
    state |= {"n": n + len(src), "next": int(src[-1]) + 1}


def parted(df: DataFrame, parts: int, part: Column) -> DataFrame:
    """The rows in the partition that `part` says, without the look at all rows that a range partitioning takes first."""
    return df.repartitionById(parts, part.cast("int"))


def bounds_of(numbered: DataFrame, listed: DataFrame, edges: int, parts: int) -> np.ndarray:
    """The numbers of nodes at which parts of about as many edges begin, by some of the edges: only sizes depend on them."""
    some = listed.select("src").sample(min(1.0, DRAWN * parts / max(edges, 1)), seed=1)
    shares = [k / parts for k in range(1, parts)]
    found = shares and numbered.join(F.broadcast(some), F.col("node_id") == F.col("src")).agg(
        F.percentile_approx("number", shares)
    ).first()[0]
    return np.unique(np.array(found or [], np.int64))


def stored(graph: Graph, nodes: int, edges: int, part: int = PART) -> StoredNetwork:
    """The costed graph, of so many nodes and edges, as files in the shared folder; its costs and ends are checked."""
    return stored_each(graph, nodes, edges, ("cost",), part)[0]


def stored_each(
    graph: Graph, nodes: int, edges: int, costs: tuple[str, ...], part: int = PART
) -> list[StoredNetwork]:
    """The graph by each of some columns that hold costs; the networks share all files but those of the costs."""
    folder = folder_of(graph.nodes)
    kind = "i4" if nodes < 1 << 31 else "i8"
    node_parts, edge_parts = (max(1, -(-n // part)) for n in (nodes, edges))
    listed = graph.nodes.select("node_id", "node_ord", "latitude", "longitude")
    # equal node_ord go by id, so numbers don't depend on partitions
    placed = checkpointed(
        listed.repartitionByRange(node_parts, "node_ord", "node_id")
        .sortWithinPartitions("node_ord", "node_id")
        .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    )
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # one row a part
    begins = dict(zip(sorted(counts), np.cumsum([0, *(counts[k] for k in sorted(counts))]).tolist()))
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in (begins or {0: 0}).items() for x in kv]), F.col("part"))
    hashed = F.pandas_udf(lambda v: v.map(id_hash).astype("int64"), "long")
    numbered = placed.withColumn("number", (offset + F.col("at")).cast("long")).drop("part", "at")
    columns = {"latitude": ("latitude", "f8"), "longitude": ("longitude", "f8")}
    at = pieces_of(numbered, writer(folder, "number", columns, write_names))

    # hashes are spread evenly, so equal ranges of them are equal shares of the nodes
    share = F.least(F.floor(F.col("hash") / float(1 << 63) * node_parts), F.lit(node_parts - 1))
    looked = parted(
        numbered.select("number", hashed("node_id").alias("hash")), node_parts, share
    ).sortWithinPartitions("hash")
    index = pieces_of(looked, writer(folder, "hash", {"hashes": ("hash", "i8"), "numbers": ("number", "i8")}))

    bounds = bounds_of(numbered, graph.edges, edges, edge_parts)
    dealt = F.pandas_udf(lambda v: pd.Series(np.searchsorted(bounds, v, side="right")), "long")
    # part and number in one column, so both ends need the same two columns and one broadcast serves both
    place = F.shiftleft(dealt("number"), NUMBER_BITS).bitwiseOR(F.col("number"))
    known = written(numbered.select("node_id", place.alias("place")))

    def end(side: str) -> DataFrame:
        found = known.toDF(side, f"{side}_at")
        return F.broadcast(found) if nodes <= SENT_NODES else found

    def number(side: str) -> Column:
        return F.coalesce(F.col(f"{side}_at").bitwiseAND((1 << NUMBER_BITS) - 1), F.lit(-1)).alias(f"{side}_n")

    ends = graph.edges.select("src", "edge_ord", "dst", *dict.fromkeys((*costs, "distance_km", "time_min"))).join(
        end("src"), "src", "left"
    ).join(end("dst"), "dst", "left")
    sorted_ = parted(
        ends.select(
            number("src"),
            "edge_ord",
            number("dst"),
            *[F.col(c).cast("double").alias(f"cost{k}") for k, c in enumerate(costs)],
            *[F.col(c).cast("double").alias(c) for c in ("distance_km", "time_min")],
            F.coalesce(F.shiftright("src_at", NUMBER_BITS), F.lit(0)).alias("part"),
        ),
        edge_parts,
        F.col("part"),
    ).drop("part").sortWithinPartitions("src_n", "edge_ord", "dst_n")

    def checked(rows: dict[str, np.ndarray] | None, state: dict, to) -> None:
        if rows is not None:
            if min(rows["src_n"].min(), rows["dst_n"].min()) < 0:
                raise GraphError("an edge has an end that is not a node of the graph")
            for k in range(len(costs)):
                cost = rows[f"cost{k}"]
                bad = np.flatnonzero(~(np.isfinite(cost) & (cost >= 0)))
                if len(bad) and "bad" not in state:
                    state["bad"] = int(rows["src_n"][bad[0]]), int(rows["dst_n"][bad[0]]), float(cost[bad[0]])
        write_starts(rows, state, to)

    columns = {"targets": ("dst_n", kind), "distance": ("distance_km", "f8"), "minutes": ("time_min", "f8")}
    priced = {f"cost{k}": (f"cost{k}", "f8") for k in range(len(costs))}
    made = pieces_of(sorted_, writer(folder, "src_n", columns | priced, checked))

    def parts(pieces: pd.DataFrame, what: str, kind: str) -> Parts:
        n = pieces["n"].to_numpy(np.int64)
        return Parts(folder, pieces["name"].tolist(), np.cumsum(n) - n, what, kind)

    names = Names(int(at["n"].sum()), parts(at, "ends", "i8"), parts(at, "texts", "u1"))
    bad = made.dropna(subset=["bad_src"]).head(1)
    checked_costs(
        pd.DataFrame(
            {
                "src": [names[int(n)] for n in bad["bad_src"]],
                "dst": [names[int(n)] for n in bad["bad_dst"]],
                "cost": bad["bad_cost"].tolist(),
            }
        )
    )
    targets, starts, firsts = parts(made, "targets", kind), parts(made, "starts", "i8"), made["first"].to_numpy(np.int64)
    numbers = Numbers(
        names, parts(index, "hashes", "i8"), parts(index, "numbers", "i8"), index["first"].to_numpy(np.int64)
    )
    return [
        StoredNetwork(
            names,
            starts,
            targets,
            cost := parts(made, f"cost{k}", "f8"),
            parts(made, "distance", "f8"),
            parts(made, "minutes", "f8"),
            parts(at, "latitude", "f8"),
            parts(at, "longitude", "f8"),
            numbers,
            Out(firsts, starts, targets, cost),
        )
        for k in range(len(costs))
    ]
