"""Road entities derived from the star-schema tables, by rules that any SQL engine can follow.

The nations stand on a lattice of five columns; neighbours are joined by a road
in either direction. Events are pings, orders are trips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, osm
from ..operators.congestion import sliding_windows
from ..operators.network import Network
from ..operators.ranking import numbered

ORIGIN_LAT, ORIGIN_LON, STEP, COLUMNS, CITY_COLUMNS = 41.14, -8.63, 0.005, 5, 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("int").alias("node_id"), F.round(F.lit(ORIGIN_LAT) + STEP * F.floor(k / COLUMNS), 6).alias("lat"), F.round(F.lit(ORIGIN_LON) + STEP * (k % COLUMNS), 6).alias("lon"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attributes of the lattice's directed edges, ids in the order of (src, dst)."""
    n = nodes(spark, sf_dir)
    step = F.explode(F.array(F.when(F.col("src") % COLUMNS < COLUMNS - 1, 1), F.when(F.col("src") % COLUMNS > 0, -1), F.lit(COLUMNS), F.lit(-COLUMNS)))
    e = n.toDF("src", "lat1", "lon1").withColumn("step", step).where("step is not null").withColumn("dst", F.col("src") + F.col("step"))
    e = e.join(n.toDF("dst", "lat2", "lon2"), "dst")
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    cls = F.get(F.array(*map(F.lit, osm.CLASSES)), (low * 3 + high) % 7)
    e = e.withColumn("highway_class", cls).withColumn("osm_way_id", (F.lit(1000) + low * 25 + high).cast("long")).withColumn("dir", F.when(F.col("src") < F.col("dst"), "F").otherwise("R"))
    e = e.withColumn("length_m", F.round(geo.haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) * (1.0 + 0.05 * ((low + high) % 8)), 3))
    e = e.withColumn("lanes_effective", osm.of_class(osm.LANES, F.col("highway_class"))).withColumn("maxspeed_kmh", osm.of_class(osm.SPEED_KMH, F.col("highway_class")))
    geometry = F.array(F.array("lon1", "lat1"), F.array("lon2", "lat2"))
    return e.select(
        (F.row_number().over(Window.orderBy("src", "dst")) - 1).cast("int").alias("edge_id"),
        F.concat_ws(":", F.col("osm_way_id").cast("string"), F.lit("0"), F.col("dir")).alias("segment_id"),
        "src", "dst", "osm_way_id", "highway_class", "lanes_effective", "length_m", "maxspeed_kmh",
        osm.freeflow_s(F.col("length_m"), F.col("maxspeed_kmh")).alias("freeflow_s"),
        osm.capacity_vph(F.col("lanes_effective"), F.col("highway_class")).alias("capacity_vph"),
        geometry.alias("geometry"),
    )


def network(spark: SparkSession, sf_dir: str) -> Network:
    return Network(nodes(spark, sf_dir), roads(spark, sf_dir).select("edge_id", "segment_id", "src", "dst", "length_m", "freeflow_s", "capacity_vph"))


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pings on edges: (ping_id, taxi_id, ts, edge_id, segment_id, speed_kmh)."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("ping_id"), F.col("user_id").cast("string").alias("taxi_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 80).cast("int").alias("edge_id"), F.col("value").alias("speed_kmh"))
    return e.join(roads(spark, sf_dir).select("edge_id", "segment_id"), "edge_id")


def observed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, load_vph): pings per edge, each counted as one in five minutes."""
    return pings(spark, sf_dir).groupBy("edge_id").agg((F.count(F.lit(1)) * 12.0).alias("load_vph"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests: (request_id, idx, src, dst, weight, depart_s). Customers are merged, never sent to the driver."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").hint("merge")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(F.col("o_orderkey").cast("string").alias("request_id"), F.col("o_orderkey").alias("idx"), F.col("c_nationkey").cast("int").alias("src"), ((F.col("o_orderkey") * 7 + 3) % 25).cast("int").alias("dst"), F.greatest(F.lit(1.0), F.floor(F.col("o_totalprice") / 50000).cast("double")).alias("weight"), (F.col("o_orderkey") % 3600).cast("double").alias("depart_s"))


def city(spark: SparkSession, sf_dir: str) -> Network:
    """A lattice that grows with the tables: a node per supplier, forty in a row, all roads alike."""
    k = F.col("node_id")
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("node_id"))
    n = own.select("node_id", (F.lit(ORIGIN_LAT) + STEP * F.floor(k / CITY_COLUMNS)).alias("lat"), (F.lit(ORIGIN_LON) + STEP * (k % CITY_COLUMNS)).alias("lon"))
    step = F.explode(F.array(F.when(k % CITY_COLUMNS < CITY_COLUMNS - 1, 1), F.when(k % CITY_COLUMNS > 0, -1), F.lit(CITY_COLUMNS), F.lit(-CITY_COLUMNS)))
    e = own.withColumn("step", step).where("step is not null").select(k.alias("src"), (k + F.col("step")).cast("int").alias("dst"))
    e = numbered(e.join(own.withColumnRenamed("node_id", "dst"), "dst", "left_semi"), "edge_id", "src", "dst")
    e = e.select(F.col("edge_id").cast("int").alias("edge_id"), F.concat(F.least("src", "dst") + 1, F.lit(":"), F.when(F.abs(F.col("src") - F.col("dst")) == 1, "0").otherwise("1"), F.when(F.col("src") < F.col("dst"), ":F").otherwise(":R")).alias("segment_id"), "src", "dst", F.lit(500.0).alias("length_m"), F.lit(36.0).alias("freeflow_s"), F.lit(1800.0).alias("capacity_vph"))
    return Network(n, e)


def city_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests between the city's nodes: (request_id, idx, src, dst, weight, depart_s)."""
    n = table(spark, sf_dir, "supplier").count()
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.cast("string").alias("request_id"), k.alias("idx"), (F.col("o_custkey") % n).cast("int").alias("src"), ((k * 7 + 3) % n).cast("int").alias("dst"), F.lit(1.0).alias("weight"), (k % 3600).cast("double").alias("depart_s"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window messages with an early and a final revision, so that keeping the latest has work."""
    w = sliding_windows(pings(spark, sf_dir).select("taxi_id", "ts", "segment_id", "speed_kmh"))
    revision = F.explode(F.array(F.struct(F.lit(False).alias("is_final"), F.lit(3).alias("lag")), F.struct(F.lit(True).alias("is_final"), F.lit(123).alias("lag"))))
    r = w.withColumn("r", revision)
    return r.select("segment_id", "window_start", "window_end", F.when(F.col("r.is_final"), F.col("vehicle_count")).otherwise(F.greatest(F.lit(0), F.col("vehicle_count") - 1)).alias("vehicle_count"), "avg_speed_kmh", "sample_pings", F.col("r.is_final").alias("is_final"), F.timestamp_add("SECOND", F.col("r.lag"), F.col("window_end")).alias("emit_time"))


# --- the same in DuckDB SQL ------------------------------------------------------

_CASE = lambda values: "CASE (low * 3 + high) % 7 " + " ".join(f"WHEN {k} THEN {v!r}" for k, v in enumerate(values)) + " END"
HAVERSINE = "2 * 6371000.0 * atan2(sqrt(sin(radians({b}lat - {a}lat) / 2) ** 2 + cos(radians({a}lat)) * cos(radians({b}lat)) * sin(radians({b}lon - {a}lon) / 2) ** 2), sqrt(1 - (sin(radians({b}lat - {a}lat) / 2) ** 2 + cos(radians({a}lat)) * cos(radians({b}lat)) * sin(radians({b}lon - {a}lon) / 2) ** 2)))"

NODES = f"nodes AS (SELECT n_nationkey AS node_id, round({ORIGIN_LAT} + {STEP} * (n_nationkey // {COLUMNS}), 6) AS lat, round({ORIGIN_LON} + {STEP} * (n_nationkey % {COLUMNS}), 6) AS lon FROM nation)"
EDGES = f"""{NODES},
pairs AS (SELECT a.node_id AS src, b.node_id AS dst, least(a.node_id, b.node_id) AS low, greatest(a.node_id, b.node_id) AS high, {HAVERSINE.format(a="a.", b="b.")} AS chord, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2
  FROM nodes a JOIN nodes b ON abs(a.node_id // {COLUMNS} - b.node_id // {COLUMNS}) + abs(a.node_id % {COLUMNS} - b.node_id % {COLUMNS}) = 1),
classed AS (SELECT *, {_CASE(osm.CLASSES)} AS highway_class, {_CASE(osm.LANES)} AS lanes_effective, {_CASE(osm.SPEED_KMH)} AS maxspeed_kmh, {_CASE(osm.CAPACITY_FACTOR)} AS factor, round(chord * (1.0 + 0.05 * ((low + high) % 8)), 3) AS length_m FROM pairs),
edges AS (SELECT CAST(row_number() OVER (ORDER BY src, dst) - 1 AS INTEGER) AS edge_id, (1000 + low * 25 + high) || ':0:' || CASE WHEN src < dst THEN 'F' ELSE 'R' END AS segment_id, src, dst, CAST(1000 + low * 25 + high AS BIGINT) AS osm_way_id, highway_class, lanes_effective, length_m, CAST(maxspeed_kmh AS DOUBLE) AS maxspeed_kmh,
  length_m / (CAST(maxspeed_kmh AS DOUBLE) / 3.6) AS freeflow_s, CAST(lanes_effective * 1800.0 * factor AS DOUBLE) AS capacity_vph, lat1, lon1, lat2, lon2 FROM classed)"""
PINGS = f"""{EDGES},
pings AS (SELECT event_id AS ping_id, CAST(user_id AS VARCHAR) AS taxi_id, ts, edges.edge_id, segment_id, value AS speed_kmh FROM events JOIN edges ON event_id % 80 = edges.edge_id)"""
LOAD = f"""{PINGS},
load AS (SELECT edge_id, count(*) * 12.0 AS load_vph FROM pings GROUP BY edge_id),
state AS (SELECT edges.*, coalesce(load_vph, 0.0)::DOUBLE AS load_vph, coalesce(load_vph, 0.0)::DOUBLE / capacity_vph AS vc, freeflow_s * (1 + 0.15 * (coalesce(load_vph, 0.0)::DOUBLE / capacity_vph) ** 4) AS time_s FROM edges LEFT JOIN load USING (edge_id))"""
TRIPS = "trips AS (SELECT CAST(o_orderkey AS VARCHAR) AS request_id, o_orderkey AS idx, c_nationkey AS src, CAST((o_orderkey * 7 + 3) % 25 AS INTEGER) AS dst, greatest(1.0, floor(o_totalprice / 50000))::DOUBLE AS weight, (o_orderkey % 3600)::DOUBLE AS depart_s FROM orders JOIN customer ON o_custkey = c_custkey)"
WINDOWS = """windows AS (SELECT segment_id, date_trunc('minute', ts) - to_minutes(k) AS window_start, date_trunc('minute', ts) - to_minutes(k) + INTERVAL 5 MINUTE AS window_end, count(DISTINCT taxi_id) AS vehicle_count, avg(speed_kmh) AS avg_speed_kmh, count(*) AS sample_pings
  FROM pings, (SELECT unnest(range(0, 5)) AS k) GROUP BY ALL),
messages AS (SELECT segment_id, window_start, window_end, CASE WHEN is_final THEN vehicle_count ELSE greatest(0, vehicle_count - 1) END AS vehicle_count, avg_speed_kmh, sample_pings, is_final, window_end + to_seconds(lag) AS emit_time
  FROM windows, (VALUES (false, 3), (true, 123)) AS r(is_final, lag)),
latest AS (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY window_start DESC, emit_time DESC) = 1)"""


def distances(cost: str, of: str, name: str = "d") -> str:
    """CTEs d0..d5: least costs of all pairs by squaring, enough for 32 steps."""
    out = f"{name}0 AS (SELECT src, dst, min({cost}) AS d FROM {of} GROUP BY src, dst UNION ALL SELECT node_id, node_id, 0.0 FROM nodes)"
    for k in range(5):
        out += f",\n{name}{k + 1} AS (SELECT a.src, b.dst, min(a.d + b.d) AS d FROM {name}{k} a JOIN {name}{k} b ON a.dst = b.src GROUP BY a.src, b.dst)"
    return out


CITY = f"""n AS (SELECT count(*) AS n FROM supplier),
trips AS (SELECT CAST(o_orderkey AS VARCHAR) AS request_id, o_orderkey AS idx, CAST(o_custkey % n AS INTEGER) AS src, CAST((o_orderkey * 7 + 3) % n AS INTEGER) AS dst FROM orders, n)"""
