"""Inputs for the registered queries, derived from the given tables in both engines' SQL.

``{us}``, ``{str}`` and ``{div}`` stand for the three spellings that differ. The chain of named
sub-queries becomes one WITH clause, so Spark and the checking engine start from equal rows.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfleet.operators.scale import prefix_sums
from wayfleet.sources.network import Network

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

SPARK = {"us": "unix_micros(CAST(ts AS TIMESTAMP))", "str": "STRING", "div": "DIV"}
DUCK = {"us": "epoch_us(ts)", "str": "VARCHAR", "div": "//"}

# Two loops that touch at (42.7325, -73.676), twelve vertices each.
NETWORK_VERTICES = """
SELECT route, v, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM (VALUES
('NORTH',0,42.738,-73.66885),('NORTH',1,42.74075,-73.669808),('NORTH',2,42.742763,-73.672425),('NORTH',3,42.7435,-73.676),
('NORTH',4,42.742763,-73.679575),('NORTH',5,42.74075,-73.682192),('NORTH',6,42.738,-73.68315),('NORTH',7,42.73525,-73.682192),
('NORTH',8,42.733237,-73.679575),('NORTH',9,42.7325,-73.676),('NORTH',10,42.733237,-73.672425),('NORTH',11,42.73525,-73.669808),
('NORTH',12,42.738,-73.66885),
('WEST',0,42.727,-73.66885),('WEST',1,42.72975,-73.669808),('WEST',2,42.731763,-73.672425),('WEST',3,42.7325,-73.676),
('WEST',4,42.731763,-73.679575),('WEST',5,42.72975,-73.682192),('WEST',6,42.727,-73.68315),('WEST',7,42.72425,-73.682192),
('WEST',8,42.722237,-73.679575),('WEST',9,42.7215,-73.676),('WEST',10,42.722237,-73.672425),('WEST',11,42.72425,-73.669808),
('WEST',12,42.727,-73.66885)) AS t(route, v, lat, lon)"""

SEGMENTS = """
SELECT a.route, CAST(a.v {div} 3 AS INT) AS polyline_idx, CAST(a.v % 3 AS INT) AS segment_idx,
       a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2
FROM network_vertices a JOIN network_vertices b ON a.route = b.route AND b.v = a.v + 1"""

STOPS = """
SELECT route, CAST(v {div} 3 AS INT) AS stop_ord, concat(substr(route,1,1), '_STOP_', CAST(v {div} 3 AS {str})) AS stop_name,
       lat, lon, CAST(4 * (v {div} 3) AS INT) AS offset_min
FROM network_vertices WHERE v % 3 = 0"""

# Pings: event times compressed 3600 times, six pings per segment, every 37th event off the line,
# a quarter of the pings that would sit on a stop about 65 m beside it, so that stops are missed.
PINGS = """
SELECT CAST(e.user_id AS {str}) AS vehicle_id, e.event_id AS ping_id, e.t_us + 1704067200000000 AS t_us, e.day_us,
       s.lat1 + (s.lat2 - s.lat1) * e.f + e.nz AS latitude,
       s.lon1 + (s.lon2 - s.lon1) * e.f AS longitude
FROM (SELECT event_id, user_id, ({us} - 1704067200000000) {div} 3600 AS t_us, {us} AS day_us,
             (rn % 6) / 6.0e0 AS f, CAST((rn {div} 6) % 12 AS INT) AS slot, user_id % 2 AS rt,
             CASE WHEN event_id % 37 = 0 THEN 0.001e0 WHEN event_id % 4 = 0 AND rn % 18 = 0 THEN 0.0006e0
                  ELSE ((event_id % 7) - 3) * 0.00001e0 END AS nz
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) q) e
JOIN segments s ON s.route = CASE WHEN e.rt = 0 THEN 'NORTH' ELSE 'WEST' END
               AND s.polyline_idx * 3 + s.segment_idx = e.slot"""

# A larger network drawn from the order lines: a route per 16 orders, a polyline per order, a vertex
# per line number. Orders with one line give one-vertex polylines.
GRID_VERTICES = """
SELECT concat('R', CAST(o.route_no AS {str})) AS route, CAST(o.polyline_idx AS INT) AS polyline_idx,
       CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber) - 1 AS INT) AS vertex_idx,
       42.5e0 + (l.part_no % 1009) / 4096.0e0 AS lat, -73.5e0 - (l.supp_no % 1013) / 4096.0e0 AS lon
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part_no, min(l_suppkey) AS supp_no
      FROM lineitem GROUP BY l_orderkey, l_linenumber) l
JOIN (SELECT l_orderkey, l_orderkey {div} 16 AS route_no,
             row_number() OVER (PARTITION BY l_orderkey {div} 16 ORDER BY l_orderkey) - 1 AS polyline_idx
      FROM (SELECT DISTINCT l_orderkey FROM lineitem) d) o ON o.l_orderkey = l.l_orderkey"""

# Stops of that network: the first vertex of every polyline.
GRID_STOPS = """
SELECT route, polyline_idx AS stop_ord, concat(route, '_S', CAST(polyline_idx AS {str})) AS stop_name, lat, lon,
       CAST(3 * polyline_idx AS INT) AS offset_min
FROM grid_vertices WHERE vertex_idx = 0"""

# Departures drawn from the orders: a service per priority, a bus per 37 customers, any minute.
DEPARTURES = """
SELECT o_orderpriority AS service, concat('Bus ', CAST(o_custkey % 37 AS {str})) AS bus, o_orderkey AS seq,
       CAST((o_orderkey * 7) % 1440 AS INT) AS minute,
       concat('R', CAST((o_orderkey {div} 16) % 200 AS {str})) AS route
FROM orders"""

CHAIN = {"network_vertices": NETWORK_VERTICES, "segments": SEGMENTS, "stops": STOPS, "pings": PINGS,
         "grid_vertices": GRID_VERTICES, "grid_stops": GRID_STOPS, "departures": DEPARTURES}
NEEDS = {"segments": ["network_vertices"], "stops": ["network_vertices"], "pings": ["segments"],
         "grid_stops": ["grid_vertices"]}


def register(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables or TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def ordered(names, needs, seen=None):
    out = [] if seen is None else seen
    for n in names:
        if n not in out:
            ordered(needs.get(n, []), needs, out)
            if n not in out:
                out.append(n)
    return out


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived inputs as a DataFrame."""
    register(spark, sf_dir, "events", "lineitem", "orders")
    chain = ordered([name], NEEDS)
    ctes = ",\n".join(f"{n} AS ({CHAIN[n].format(**SPARK)})" for n in chain)
    return spark.sql(f"WITH {ctes}\nSELECT * FROM {name}")


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pings of ``PINGS``; the row numbers per user are counted hour by hour, so a user with very
    many events is not sorted in one task."""
    e = events(spark, sf_dir).withColumns({"_us": F.unix_micros("ts"), "_hour": F.floor(F.unix_micros("ts") / 3_600_000_000)})
    numbered = prefix_sums(e.select("event_id", "user_id", "_us", "_hour"), ["user_id"], "_hour", ["_us", "event_id"], {"rn": F.lit(1)})
    placed = numbered.selectExpr(
        "user_id", "event_id AS ping_id", "(_us - 1704067200000000) DIV 3600 + 1704067200000000 AS t_us", "_us AS day_us",
        "(rn % 6) / 6.0D AS f", "CASE WHEN user_id % 2 = 0 THEN 'NORTH' ELSE 'WEST' END AS route",
        "CAST((rn DIV 6) % 12 AS INT) AS slot",
        "CASE WHEN event_id % 37 = 0 THEN 0.001D WHEN event_id % 4 = 0 AND rn % 18 = 0 THEN 0.0006D "
        "ELSE ((event_id % 7) - 3) * 0.00001D END AS nz")
    lines = derive(spark, sf_dir, "segments").withColumn("slot", F.col("polyline_idx") * 3 + F.col("segment_idx"))
    return placed.join(F.broadcast(lines), ["route", "slot"]).selectExpr(
        "CAST(user_id AS STRING) AS vehicle_id", "ping_id", "t_us", "day_us", "lat1 + (lat2 - lat1) * f + nz AS latitude",
        "lon1 + (lon2 - lon1) * f AS longitude", "timestamp_micros(t_us) AS timestamp")


@lru_cache(maxsize=8)
def network(spark: SparkSession, sf_dir: str) -> Network:
    stops = derive(spark, sf_dir, "stops")
    return Network(derive(spark, sf_dir, "segments"), stops,
                   stops.select("route", F.col("stop_ord").alias("polyline_idx"), "stop_name")).stored()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def geofence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups are entries and errors exits."""
    kind = F.when(F.col("event_type") == "signup", "geofenceEntry").otherwise("geofenceExit")
    return (events(spark, sf_dir).filter(F.col("event_type").isin("signup", "error"))
            .select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("vehicle_id"),
                    kind.alias("event_type"), F.col("ts").alias("event_time")))


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("id")).distinct()
    name = F.expr("substr(lpad(id, 3, '0'), -3)")
    return ids.select("id", name.alias("name"), F.lit("vehicle").alias("asset_type"),
                      F.concat(F.lit("FAKE"), name).alias("license_plate"))
