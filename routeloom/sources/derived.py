"""A road graph derived from all order lines: parts of one order, line by line, are hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from routeloom.plans.schema import Graph

LANDMARKS = 24
#: The same text runs in Spark and in other SQL engines.
HOPS_SQL = """
SELECT l_partkey AS src,
       LEAD(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst,
       l_quantity / 10.0 AS distance_km, l_extendedprice / 10000.0 AS time_min,
       1.0 + l_discount * 40.0 AS congestion, l_tax * 62.5 AS risk, l_returnflag || l_linestatus AS flags
FROM lineitem"""
#: Parallel hops keep the fastest, and hops in place are dropped.
EDGE_COLUMNS = """src, dst, distance_km, time_min, congestion, risk,
       CASE flags WHEN 'AF' THEN 'primary' WHEN 'NF' THEN 'secondary' WHEN 'NO' THEN 'residential' WHEN 'RF' THEN 'service' ELSE 'unclassified' END AS road_type,
       CAST(ROUND(1000 * (1.0 * distance_km + 0.4 * time_min + 0.08 * congestion + 0.12 * risk)) AS BIGINT) AS cost_m"""
EDGES_SQL = f"""
SELECT {EDGE_COLUMNS}
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY src, dst ORDER BY time_min, distance_km, congestion, risk, flags) AS rn
      FROM ({HOPS_SQL}) h WHERE dst IS NOT NULL AND src <> dst) r
WHERE rn = 1"""
LATITUDE_SQL, LONGITUDE_SQL = "(10.7 + ((({k}) * 7919) % 1000) / 10000.0)", "(106.6 + ((({k}) * 104729) % 1000) / 10000.0)"

#: Every hop as a road with raw attributes; an order's town, one of four, is where its parts lie, so towns share no road.
ROADS_SQL = """
SELECT l_orderkey * 100000 + pos AS feature_ord, l_orderkey % 4 AS town, src, dst,
       CASE flags WHEN 'AF' THEN 'primary' WHEN 'NF' THEN '["secondary", "service"]' WHEN 'NO' THEN 'residential' WHEN 'RF' THEN 'footway' END AS highway,
       CASE q % 3 WHEN 1 THEN CAST(q * 3 AS STRING) || ' km/h' WHEN 2 THEN '["' || CAST(q AS STRING) || '", "60"]' END AS maxspeed,
       CASE WHEN q % 10 <> 0 THEN CAST(q * 10 AS STRING) END AS length,
       CASE l_linenumber % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'True' WHEN 2 THEN 'no' END AS oneway,
       'Ðường ' || CAST(dst % 50 AS STRING) AS name
FROM (SELECT l_orderkey, l_linenumber, l_partkey AS src, CAST(FLOOR(l_quantity) AS INT) AS q, l_returnflag || l_linestatus AS flags,
             LEAD(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst,
             ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos
      FROM lineitem) h
WHERE dst IS NOT NULL"""
TOWN_DEGREES = 0.25


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(
        sql.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    )


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, HOPS_SQL)


def basket_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, distance_km, time_min, congestion, risk, road_type, cost_m): costs in whole thousandths, so sums are exact.

    These are the rows of EDGES_SQL. A hop with none before it is the fastest, and a row number would be cut before the
    shuffle as well, which sorts all hops once more though few are parallel.
    """
    fastest = W.partitionBy("src", "dst").orderBy("time_min", "distance_km", "congestion", "risk", "flags")
    ahead = hops(spark, sf_dir).where("dst IS NOT NULL AND src <> dst").withColumn("before", F.lag("src").over(fastest))
    return spark.sql(f"SELECT {EDGE_COLUMNS} FROM {{kept}}", kept=ahead.where("before IS NULL"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature_ord, points, properties) of ROADS_SQL, as `etl.read_roads` gives them."""

    def point(key: str) -> Column:
        latitude, longitude = place(F.col(key))
        return F.array(longitude + F.col("town") * TOWN_DEGREES, latitude)

    raw = ("highway", "maxspeed", "length", "oneway", "name")
    return run_sql(spark, sf_dir, ROADS_SQL).select(
        "feature_ord",
        F.array(point("src"), point("dst")).alias("points"),
        F.create_map(*[x for k in raw for x in (F.lit(k), F.col(k))]).alias("properties"),
    )


def place(key: Column) -> tuple[Column, Column]:
    return 10.7 + (key * 7919) % 1000 / 10000.0, 106.6 + (key * 104729) % 1000 / 10000.0


def basket_nodes(edges: DataFrame) -> DataFrame:
    """(node, latitude, longitude) of every end of an edge."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    latitude, longitude = place(F.col("node"))
    return ends.select("node", latitude.alias("latitude"), longitude.alias("longitude"))


def basket_graph(edges: DataFrame) -> Graph:
    """Basket edges in the engine's relational form: ids as text, nodes and edges in the order of their keys."""
    listed = edges.select(
        F.col("src").cast("string").alias("src"),
        F.col("dst").cast("int").alias("edge_ord"),  # a node's edges have different ends
        F.col("dst").cast("string").alias("dst"),
        "distance_km",
        "time_min",
        "congestion",
        "risk",
        "road_type",
        F.create_map().cast("map<string,string>").alias("metadata"),
        F.col("cost_m").cast("double").alias("cost"),
    )
    nodes = basket_nodes(edges).select(
        F.col("node").cast("string").alias("node_id"),
        F.col("node").cast("int").alias("node_ord"),
        "latitude",
        "longitude",
        F.concat(F.lit("Part "), F.col("node")).alias("display_name"),
    )
    return Graph(nodes, listed)


def basket_landmarks(edges: DataFrame, n: int = LANDMARKS) -> DataFrame:
    """(node): the n smallest keys that have an edge out."""
    return edges.select(F.col("src").alias("node")).distinct().orderBy("node").limit(n)
