"""Access points: landmarks are projected on the nearest road, which is cut there, so that routes can begin beside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.functions.geo import LATITUDE_M, LONGITUDE_M
from routeloom.functions.scalar import vietnamese
from routeloom.plans.schema import GraphError

#: Metres: a parallel road is cut if it passes the access point this near, and not so near to its ends.
NEAR_M, END_M = 0.75, 0.5
#: Landmarks are a dimension that every task holds.
MAX_LANDMARKS = 10_000
#: What the access of a landmark with and without an override is called.
CURATED = {"access_kind": "entrance", "access_label": "Entrance", "access_source": "Curated access point"}
NEAREST = {
    "access_kind": "nearest_road",
    "access_label": "Nearest road access",
    "access_source": "Generated from the nearest drivable OSM edge",
}


def plane(lon: np.ndarray, lat: np.ndarray, around: float) -> tuple[np.ndarray, np.ndarray]:
    """Metres east and north, true near a latitude."""
    return lon * LONGITUDE_M * np.cos(np.radians(around)), lat * LATITUDE_M


def project(line: np.ndarray, lon: float, lat: float) -> tuple[float, float, float, np.ndarray]:
    """(distance to the line, metres along it, its length, the nearest point on it as lon, lat) of a point."""
    x, y = plane(line[:, 0], line[:, 1], lat)
    px, py = plane(np.array(lon), np.array(lat), lat)
    dx, dy = np.diff(x), np.diff(y)
    size = np.hypot(dx, dy)
    share = np.clip(((px - x[:-1]) * dx + (py - y[:-1]) * dy) / np.where(size > 0, size**2, 1), 0, 1)
    far = np.hypot(x[:-1] + share * dx - px, y[:-1] + share * dy - py)
    k = int(far.argmin())
    return float(far[k]), float(
        size[:k].sum() + share[k] * size[k]
    ), float(size.sum()), line[k] + share[k] * (line[k + 1] - line[k])


def cut(line: np.ndarray, spots: list[tuple[float, np.ndarray]], around: float) -> list[np.ndarray]:
    """The pieces of a line between the spots (metres along, point), in order."""
    x, y = plane(line[:, 0], line[:, 1], around)
    along = np.concatenate([[0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))])
    pieces, start, low = [], line[0], 0.0
    for at, point in [*sorted(spots, key=lambda s: s[0]), (float("inf"), line[-1])]:
        inner = line[1:-1][(along[1:-1] > low) & (along[1:-1] < at)]
        pieces.append(np.vstack([start, inner, point]))
        start, low = point, at
    return pieces


def nearest_roads(roads: DataFrame, points: list[tuple[str, float, float]]) -> list[dict]:
    """For each point (name, lon, lat) the nearest road: the first one among equals."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple] = {}
        for pdf in frames:
            for order, line in zip(pdf["feature_ord"], pdf["points"]):
                line = np.array([list(p) for p in line])
                for name, lon, lat in points:
                    far, along, size, at = project(line, lon, lat)
                    if name not in best or (far, order) < best[name][:2]:
                        best[name] = (far, order, *at, *line[0], *line[-1], along, size)
        yield pd.DataFrame([(n, *v) for n, v in best.items()], columns=["name", *columns])

    columns = ["far", "feature_ord", "lon", "lat", "from_lon", "from_lat", "to_lon", "to_lat", "along", "size"]
    schema = "name string, " + ", ".join(f"{c} {'long' if c == 'feature_ord' else 'double'}" for c in columns)
    found = roads.select("feature_ord", "points").mapInPandas(scan, schema)
    least = found.groupBy("name").agg(F.min(F.struct(*columns)).alias("b")).select("name", "b.*")
    named = least.join(roads.select("feature_ord", F.col("properties")["name"].alias("road")), "feature_ord", "left")
    return [r.asDict() for r in named.collect()]


def insert_access_points(
    roads: DataFrame, landmarks: DataFrame, overrides: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Roads cut beside the landmarks, and landmarks with routing points and what their access is.

    Each landmark, or the point that an override (id, latitude, longitude, kind, label, source, use_road_projection)
    names, is projected on the nearest road. All roads between the ends of that road that pass within NEAR_M of the
    spot are cut there, in both directions; lengths are shared out. A spot within END_M of the ends cuts nothing and
    becomes the nearer end. All projections see the roads as they were. Orders of features stay, pieces follow their road's.
    """
    rows = [r.asDict() for r in landmarks.limit(MAX_LANDMARKS + 1).collect()]
    if len(rows) > MAX_LANDMARKS:
        raise GraphError(f"more than {MAX_LANDMARKS} landmarks")
    given = {
        r["id"]: r.asDict() for r in overrides.where(F.col("id").isin([r["id"] for r in rows])).collect()
    } if overrides is not None else {}
    asked = {
        r["id"]: (
            given.get(r["id"], {}).get("longitude") or r["longitude"],
            given.get(r["id"], {}).get("latitude") or r["latitude"],
        )
        for r in rows
    }
    found = {f["name"]: f for f in nearest_roads(roads, [(k, *v) for k, v in asked.items()])}
    by_ends: dict[frozenset, list[tuple[str, float, float]]] = {}
    for name, f in found.items():
        by_ends.setdefault(
            frozenset([(f["from_lon"], f["from_lat"]), (f["to_lon"], f["to_lat"])]), []
        ).append((name, f["lon"], f["lat"]))
    step = len(rows) + 1

    def spots(line: np.ndarray) -> dict[float, np.ndarray]:
        out = {}
        for _, lon, lat in by_ends.get(frozenset([tuple(line[0]), tuple(line[-1])]), []):
            far, along, size, _ = project(line, lon, lat)
            if far <= NEAR_M and END_M < along < size - END_M:
                out[along] = np.array([lon, lat])
        return out

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = []
            for order, points, properties in zip(pdf["feature_ord"], pdf["points"], pdf["properties"]):
                line = np.array([list(p) for p in points])
                at = spots(line)
                pieces = cut(line, list(at.items()), line[0, 1]) if at else [line]
                properties = dict(properties)
                whole = max(float(properties.get("length") or 0.0), 0.001)
                size = project(line, *line[0])[2]
                marks = [0.0, *sorted(at), size]
                for k, piece in enumerate(pieces):
                    own = properties if len(pieces) == 1 else properties | {
                        "length": str(whole * (marks[k + 1] - marks[k]) / size)
                    }
                    made.append((order * step + k, piece.tolist(), own))
            yield pd.DataFrame(made, columns=["feature_ord", "points", "properties"])

    schema = T.StructType.fromDDL("feature_ord long, points array<array<double>>, properties map<string,string>")
    wide = roads.select(F.col("feature_ord").cast("long"), "points", "properties").mapInPandas(scan, schema)
    out = []
    for r in rows:
        f, o = found[r["id"]], given.get(r["id"])
        on_road = (f["lon"], f["lat"])
        if not END_M < f["along"] < f["size"] - END_M:
            ends = [(f["from_lon"], f["from_lat"]), (f["to_lon"], f["to_lat"])]
            metres = lambda e: np.hypot(  # noqa: B023, E731
                *(
                    a - b
                    for a, b in zip(
                        plane(np.array(e[0]), np.array(e[1]), f["lat"]),
                        plane(np.array(f["lon"]), np.array(f["lat"]), f["lat"]),
                    )
                )
            )
            on_road = min(ends, key=metres)
        at = on_road if o is None or o.get("use_road_projection") else asked[r["id"]]
        said = NEAREST if o is None else {
            k: o.get(v) or CURATED[k]
            for k, v in (("access_kind", "kind"), ("access_label", "label"), ("access_source", "source"))
        }
        out.append((r["id"], round(at[1], 7), round(at[0], 7), *said.values(), f["road"]))
    access = landmarks.sparkSession.createDataFrame(
        out,
        "id string, routing_latitude double, routing_longitude double, access_kind string, access_label string, access_source string, access_road string",
    )
    access = access.withColumn(
        "access_road", F.coalesce(F.nullif(vietnamese(F.col("access_road")), F.lit("")), F.lit("Unnamed road"))
    )
    return wide, landmarks.drop(*access.columns[1:]).join(access, "id")
