"""Feeds, network and schedule documents, table upkeep, stored stages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from queries import fixture as fx
from queries.enrichment import rounded
from queries.oracle import hav, sql
from queries.registry import query, stage
from wayfleet.operators import upkeep
from wayfleet.operators.scale import cut, shared_dir
from wayfleet.sources import feeds, network, schedule, stages
from wayfleet.functions.clock import clock_text
from wayfleet.sources.days import DayTable

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


# -- scans ----------------------------------------------------------------------------------------

@query("a1_read_pings", """
SELECT CAST(user_id AS VARCHAR) AS vehicle_id, value AS latitude, -value AS longitude, epoch_us(ts) AS t_us FROM events""")
def _(spark, sf):
    p = feeds.read_pings(spark, f"{sf}/events.parquet", vehicle_id="user_id", latitude="value", longitude="-value",
                         timestamp="ts")
    return p.select("vehicle_id", "latitude", "longitude", F.unix_micros("timestamp").alias("t_us"))


@query("a2_pings_window", """
SELECT 'since' AS what, CAST(user_id AS VARCHAR) AS vehicle_id, epoch_us(ts) AS t_us FROM events
WHERE ts > (SELECT ts FROM events WHERE event_id = 700)
UNION ALL SELECT 'day', CAST(user_id AS VARCHAR), epoch_us(ts) FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'""")
def _(spark, sf):
    p = feeds.read_pings(spark, f"{sf}/events.parquet", vehicle_id="user_id", latitude="value", longitude="-value",
                         timestamp="ts")
    mark = fx.events(spark, sf).filter("event_id = 700").agg(F.max("ts")).first()[0]
    day = F.lit("2024-01-20 00:00:00").cast("timestamp")
    out = lambda df, what: df.select(F.lit(what).alias("what"), "vehicle_id", F.unix_micros("timestamp").alias("t_us"))
    return out(feeds.pings_window(p, day, F.lit(mark)), "since").unionByName(out(feeds.pings_window(p, day), "day"))


# -- feed payloads, 25 readings a page ------------------------------------------------------------

def gps_payloads(spark, sf, array_form):
    i = F.col("ping_id")
    reading = lambda shift: F.struct(
        F.col("latitude"), F.col("longitude"),
        F.when(i % 13 != 0, F.date_format(F.timestamp_micros(F.col("t_us") + shift), ISO)).alias("time"),
        (i % 60).cast("double").alias("speedMilesPerHour"), (i % 360).cast("double").alias("headingDegrees"),
        F.when(i % 3 == 0, F.lit(True)).alias("isEcuSpeed"),
        F.struct(F.concat(F.lit("Spot "), (i % 5).cast("string")).alias("formattedLocation")).alias("reverseGeo"),
        F.when(i % 2 == 0, F.struct((i % 9).cast("string").alias("id"), F.lit("Depot").alias("name"))).alias("address"))
    gps = F.when(i % 4 == 0, F.array(reading(0), reading(1_000_000))).otherwise(F.array(reading(0))) if array_form else reading(0)
    entry = F.struct(F.when(i % 11 != 0, F.col("vehicle_id")).alias("id"),
                     F.concat(F.lit("Bus "), F.col("vehicle_id")).alias("name"), gps.alias("gps"))
    page = F.struct(F.lit(False).alias("hasNextPage"), F.lit("").alias("endCursor")).alias("pagination")
    pages = stage(spark, sf, "pings").groupBy(F.floor(i / 25).alias("page")).agg(F.collect_list(entry).alias("data"))
    return pages.select(F.to_json(F.struct("data", page)).alias("body"))


FEED_SQL = """
SELECT vehicle_id, concat('Bus ', vehicle_id) AS name, t_us + {shift} AS t_us, latitude, longitude,
       CAST(ping_id % 360 AS DOUBLE) AS heading_degrees, CAST(ping_id % 60 AS DOUBLE) AS speed_mph, ping_id % 3 = 0 AS is_ecu_speed,
       concat('Spot ', CAST(ping_id % 5 AS VARCHAR)) AS formatted_location,
       CASE WHEN ping_id % 2 = 0 THEN CAST(ping_id % 9 AS VARCHAR) END AS address_id,
       CASE WHEN ping_id % 2 = 0 THEN 'Depot' END AS address_name FROM pings WHERE ping_id % 11 <> 0 AND ping_id % 13 <> 0"""


def feed_rows(df):
    return df.withColumn("t_us", F.unix_micros("timestamp")).drop("timestamp")


@query("a3_flatten_gps_feed", sql("pings", FEED_SQL.format(shift=0)))
def _(spark, sf):
    return feed_rows(feeds.flatten_gps_feed(gps_payloads(spark, sf, False)))


@query("a3_flatten_gps_feed_arrays", sql("pings", FEED_SQL.format(shift=0) + " UNION ALL " + FEED_SQL.format(shift=1000000)
                                         + " AND ping_id % 4 = 0"))
def _(spark, sf):
    return feed_rows(feeds.flatten_gps_feed(gps_payloads(spark, sf, True), array_form=True))


def fence_payloads(spark, sf):
    i = F.col("event_id")
    vehicle = F.struct(
        F.col("user_id").cast("string").alias("id"),
        F.when(i % 19 != 0, F.concat(F.lit("Bus "), F.col("user_id").cast("string"))).alias("name"),
        F.concat(F.lit("FAKE"), (i % 100).cast("string")).alias("licensePlate"),
        F.when(i % 2 == 0, F.lit("bus")).alias("assetType"),
        F.struct((i % 8).cast("string").alias("maintenanceId")).alias("externalIds"),
        F.struct(F.lit("VG34").alias("model"), i.cast("string").alias("serial")).alias("gateway"))
    corner = F.struct((F.lit(42.0) + (i % 64) / 64).alias("latitude"), (F.lit(-73.0) - (i % 32) / 32).alias("longitude"))
    corners = F.when(i % 5 != 0, F.array(corner, corner)).otherwise(F.array(corner).cast("array<struct<latitude:double,longitude:double>>"))
    corners = F.when(i % 5 != 0, corners).otherwise(F.filter(corners, lambda c: F.lit(False)))
    fence = F.struct(F.when(i % 17 != 0, vehicle).alias("vehicle"), F.struct(
        F.concat(F.lit("Gate "), (i % 4).cast("string")).alias("name"), F.lit("1 Campus Way").alias("formattedAddress"),
        F.struct(F.struct(corners.alias("vertices")).alias("polygon")).alias("geofence")).alias("address"))
    entry = F.col("event_type") == "signup"
    detail = lambda is_entry: F.struct(F.struct(F.when(is_entry, fence).alias("geofenceEntry"),
                                                F.when(~is_entry, fence).alias("geofenceExit")).alias("details"))
    conditions = F.when(i % 3 == 0, F.array(detail(entry), detail(~entry))).otherwise(F.array(detail(entry)))
    return fx.events(spark, sf).filter(F.col("event_type").isin("signup", "error")).select(
        F.to_json(F.struct(i.cast("string").alias("eventId"), F.date_format("ts", ISO).alias("eventTime"),
                           F.lit("GeofenceEntry").alias("eventType"),
                           F.struct(conditions.alias("conditions")).alias("data"))).alias("body"))


CONDITIONS = """
SELECT CAST(event_id AS VARCHAR) AS id, c.n AS condition_ord, event_id AS e,
       CASE WHEN (event_type = 'signup') = (c.n = 0) THEN 'geofenceEntry' ELSE 'geofenceExit' END AS event_type,
       epoch_us(ts) AS event_us, CAST(user_id AS VARCHAR) AS vehicle_id, concat('Bus ', CAST(user_id AS VARCHAR)) AS vehicle_name,
       CASE WHEN event_id % 2 = 0 THEN 'bus' ELSE 'vehicle' END AS asset_type, concat('FAKE', CAST(event_id % 100 AS VARCHAR)) AS license_plate,
       CAST(event_id % 8 AS VARCHAR) AS maintenance_id, 'VG34' AS gateway_model, CAST(event_id AS VARCHAR) AS gateway_serial,
       concat('Gate ', CAST(event_id % 4 AS VARCHAR)) AS address_name, '1 Campus Way' AS address_formatted,
       CASE WHEN event_id % 5 <> 0 THEN 42e0 + (event_id % 64) / 64e0 END AS latitude,
       CASE WHEN event_id % 5 <> 0 THEN -73e0 - (event_id % 32) / 32e0 END AS longitude
FROM events JOIN (VALUES (0), (1)) c(n) ON c.n = 0 OR event_id % 3 = 0
WHERE event_type IN ('signup', 'error') AND event_id % 17 <> 0 AND event_id % 19 <> 0"""
FENCE_COLUMNS = ("id event_type event_us vehicle_id vehicle_name asset_type license_plate maintenance_id gateway_model "
                 "gateway_serial address_name address_formatted latitude longitude").split()


@query("a4_flatten_geofence_payloads", sql("", f"SELECT {', '.join(FENCE_COLUMNS)}, condition_ord FROM conditions", conditions=CONDITIONS))
def _(spark, sf):
    return feeds.flatten_geofence_payloads(fence_payloads(spark, sf)).withColumn(
        "event_us", F.unix_micros("event_time")).select(*FENCE_COLUMNS, "condition_ord")


def assignment_payloads(spark, sf):
    i = F.col("event_id")
    entry = F.struct(F.when(i % 6 != 0, F.date_format("ts", ISO)).alias("assignedAtTime"),
                     F.struct(F.when(i % 23 != 0, (i % 7).cast("string")).alias("id"),
                              F.concat(F.lit("Driver "), (i % 7).cast("string"), F.lit(" v"), (i % 3).cast("string")).alias("name")).alias("driver"),
                     F.struct(F.col("user_id").cast("string").alias("id")).alias("vehicle"))
    pages = fx.events(spark, sf).filter("event_type = 'purchase'").groupBy(F.floor(i / 50)).agg(F.collect_list(entry).alias("data"))
    return pages.select(F.to_json(F.struct("data")).alias("body"))


NOW = "2024-02-01 00:00:00"
ASSIGNED = f"""
SELECT event_id, CAST(event_id % 7 AS VARCHAR) AS driver_id, concat('Driver ', CAST(event_id % 7 AS VARCHAR), ' v', CAST(event_id % 3 AS VARCHAR)) AS driver_name,
       CAST(user_id AS VARCHAR) AS vehicle_id, CASE WHEN event_id % 6 <> 0 THEN ts ELSE TIMESTAMP '{NOW}' END AS assigned_at
FROM events WHERE event_type = 'purchase' AND event_id % 23 <> 0"""


def assigned(spark, sf):
    return feeds.flatten_assignments(assignment_payloads(spark, sf), F.lit(NOW).cast("timestamp"))


@query("a5_flatten_assignments", sql("", "SELECT driver_id, driver_name, vehicle_id, epoch_us(assigned_at) AS at_us FROM assigned", assigned=ASSIGNED))
def _(spark, sf):
    return assigned(spark, sf).withColumn("at_us", F.unix_micros("assigned_at")).drop("assigned_at")


# -- network and schedule documents ---------------------------------------------------------------

def route_docs(spark, sf):
    """One document per route of the network that the order lines draw."""
    v = fx.derive(spark, sf, "grid_vertices")
    lines = v.groupBy("route", "polyline_idx").agg(F.array_sort(F.collect_list(F.struct("vertex_idx", "lat", "lon"))).alias("p"))
    stop = F.concat("route", F.lit("_S"), F.col("polyline_idx").cast("string"))
    lines = lines.select("route", "polyline_idx", F.transform("p", lambda x: F.array(x["lat"], x["lon"])).alias("line"), stop.alias("stop"))
    routes = lines.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("polyline_idx", "line", "stop"))).alias("l"))
    info = F.array_join(F.transform("l", lambda x: F.concat(
        F.lit('"'), x["stop"], F.lit('":'), F.to_json(F.struct(
            F.get(x["line"], F.lit(0)).alias("COORDINATES"), (x["polyline_idx"] * 3).alias("OFFSET"), x["stop"].alias("NAME"))))), ",")
    names = F.to_json(F.transform("l", lambda x: x["stop"]))
    doc = F.concat(F.lit('{"'), F.col("route"), F.lit('":{"COLOR":"#112233","STOPS":'), names, F.lit(',"POLYLINE_STOPS":'), names,
                   F.lit(',"ROUTES":'), F.to_json(F.transform("l", lambda x: x["line"])), F.lit(","), info, F.lit("}}"))
    return routes.select(doc.alias("doc"))


@query("a6_load_network", sql("grid_vertices departures", """
SELECT a.route, a.polyline_idx, a.vertex_idx AS segment_idx, a.lat AS lat1, a.lon AS lon1, coalesce(b.lat, a.lat) AS lat2, coalesce(b.lon, a.lon) AS lon2
FROM grid_vertices a LEFT JOIN grid_vertices b ON a.route = b.route AND a.polyline_idx = b.polyline_idx AND b.vertex_idx = a.vertex_idx + 1
WHERE (b.route IS NOT NULL OR a.vertex_idx = 0) AND a.route IN (SELECT route FROM departures WHERE bus < 'Bus 2')"""))
def _(spark, sf):
    runs = fx.derive(spark, sf, "departures").filter("bus < 'Bus 2'")
    return network.load_network(route_docs(spark, sf), runs)


@query("a7_load_stops", sql("grid_stops", "SELECT route, stop_ord, stop_name, lat, lon, offset_min, stop_name AS label FROM grid_stops"))
def _(spark, sf):
    return network.load_stops(route_docs(spark, sf)).drop("route_ord")


@query("a9_flatten_route_vertices", sql("grid_vertices", """
SELECT route, count(*) AS n, string_agg(CAST(CAST(round(lat * 4096) AS BIGINT) AS VARCHAR), ',' ORDER BY polyline_idx, vertex_idx) AS lats FROM grid_vertices GROUP BY route"""))
def _(spark, sf):
    flat = network.flatten_route_vertices(network.load_vertices(route_docs(spark, sf)))
    return flat.select("route", F.size("path").cast("long").alias("n"), F.array_join(F.transform(
        "path", lambda p: F.round(p["lat"] * 4096).cast("long").cast("string")), ",").alias("lats"))


@query("w10_cumulative_polyline_km", sql("grid_vertices", f"""
SELECT route, polyline_idx, segment_idx, round(sum(km) OVER (PARTITION BY route, polyline_idx ORDER BY segment_idx), 6) AS cum_end,
       round(sum(km) OVER (PARTITION BY route, polyline_idx), 6) AS polyline_km
FROM (SELECT a.route, a.polyline_idx, a.vertex_idx AS segment_idx,
             CASE WHEN b.lat IS NULL THEN 0e0 ELSE {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} END AS km
      FROM grid_vertices a LEFT JOIN grid_vertices b ON a.route = b.route AND a.polyline_idx = b.polyline_idx AND b.vertex_idx = a.vertex_idx + 1
      WHERE b.route IS NOT NULL OR a.vertex_idx = 0) s"""))
def _(spark, sf):
    segments = network.segments_of(fx.derive(spark, sf, "grid_vertices"))
    return rounded(network.cumulative_km(segments).select("route", "polyline_idx", "segment_idx", "cum_end", "polyline_km"),
                   ["cum_end", "polyline_km"])


@query("g21_vertices_per_polyline", sql("grid_vertices", "SELECT route, polyline_idx, count(*) AS n_vertices FROM grid_vertices GROUP BY route, polyline_idx"))
def _(spark, sf):
    return network.vertices_per_polyline(fx.derive(spark, sf, "grid_vertices"))


@query("g21_stop_list_per_route", sql("grid_stops", "SELECT route, string_agg(stop_name, ',' ORDER BY stop_ord) AS stop_names FROM grid_stops GROUP BY route"))
def _(spark, sf):
    return network.stop_list_per_route(fx.derive(spark, sf, "grid_stops")).withColumn("stop_names", F.array_join("stop_names", ","))


def schedule_docs(spark, sf):
    """A document per service and 100 orders; weekdays name some of the services."""
    d = fx.derive(spark, sf, "departures").withColumn("block", F.floor(F.col("seq") / 100))
    runs = d.groupBy("service", "block", "bus").agg(F.array_sort(F.collect_list(F.struct("seq", clock_text(F.col("minute")).alias("t"), "route"))).alias("r"))
    runs = runs.select("service", "block", "bus", F.transform("r", lambda x: F.array(x["t"], x["route"])).alias("r"))
    buses = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bus", "r")))))
    days = F.lit('"MONDAY":"1-URGENT","TUESDAY":"2-HIGH","SATURDAY":"5-LOW",')
    return runs.groupBy("service", "block").agg(buses.alias("b")).select(
        F.concat(F.lit("{"), days, F.lit('"'), F.col("service"), F.lit('":'), F.col("b"), F.lit("}")).alias("doc"))


@query("a8_load_schedule", sql("departures", """
SELECT service, bus, CAST(row_number() OVER (PARTITION BY service, bus, seq // 100 ORDER BY seq) - 1 AS INT) AS seq, minute, route FROM departures"""))
def _(spark, sf):
    return schedule.load_departures(schedule_docs(spark, sf)).drop("time_str")


@query("a8_active_routes", sql("departures", "SELECT DISTINCT route FROM departures WHERE service IN ('1-URGENT', '2-HIGH', '5-LOW')"))
def _(spark, sf):
    return schedule.active_routes(schedule_docs(spark, sf))


# -- stages ---------------------------------------------------------------------------------------

def scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("a10_read_stage_csv", sql("pings", "SELECT vehicle_id, ping_id, t_us, latitude FROM pings"))
def _(spark, sf):
    path = scratch(spark, "csv")
    form = F.when(F.col("ping_id") % 2 == 0, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS'+00:00'"))
    stage(spark, sf, "pings").select("vehicle_id", "ping_id", "latitude", form.alias("timestamp")).write.option("header", True).csv(path)
    back = stages.read_stage_csv(spark, path, "vehicle_id string, ping_id long, latitude double, timestamp string")
    return back.withColumn("t_us", F.unix_micros("timestamp")).drop("timestamp")


@query("b6_write_stage", sql("l2", """
SELECT 'trips_max_distance0p02_max_timedelta15' AS stage, vehicle_id, segment_no, count(*) AS n FROM l2 GROUP BY vehicle_id, segment_no"""))
def _(spark, sf):
    path = stages.write_stage(stage(spark, sf, "l2"), scratch(spark, "stages"), "trips", max_timedelta=15, max_distance=0.02)
    back = stages.read_stage(spark, path).groupBy("vehicle_id", "segment_no").agg(F.count("*").alias("n"))
    return back.withColumn("stage", F.lit(path.rsplit("/", 1)[-1]))


@query("b7_l6_write_by_polyline", sql("l2s", """
SELECT concat(route, '_', CAST(polyline_idx AS VARCHAR)) AS polyline, count(*) AS n, sum(ping_id)::BIGINT AS ids FROM l2s
WHERE route IS NOT NULL AND polyline_idx IS NOT NULL GROUP BY route, polyline_idx"""))
def _(spark, sf):
    path = scratch(spark, "polylines")
    stages.write_by_polyline(stage(spark, sf, "l2s"), path)
    return spark.read.parquet(path).groupBy("polyline").agg(F.count("*").alias("n"), F.sum("ping_id").alias("ids"))


# -- upkeep ---------------------------------------------------------------------------------------

BATCH = """SELECT vehicle_id, ping_id, t_us, latitude FROM pings
UNION ALL SELECT vehicle_id, ping_id + 1000000000, t_us, latitude + 1 FROM pings WHERE ping_id % 5 = 0"""


def ping_batch(spark, sf):
    p = stage(spark, sf, "pings").select("vehicle_id", "ping_id", "t_us", "latitude")
    again = p.filter("ping_id % 5 = 0").withColumns({"ping_id": F.col("ping_id") + 1000000000, "latitude": F.col("latitude") + 1})
    return p.unionByName(again)


NEW_SQL = """
SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, t_us ORDER BY ping_id) AS rk FROM batch) b
WHERE rk = 1 AND NOT EXISTS (SELECT 1 FROM pings t WHERE t.ping_id % 3 <> 0 AND t.vehicle_id = b.vehicle_id AND t.t_us = b.t_us)"""


@query("b1_append_new_pings", sql("pings", NEW_SQL, batch=BATCH))
def _(spark, sf):
    return upkeep.new_pings(ping_batch(spark, sf), stage(spark, sf, "pings").filter("ping_id % 3 <> 0"))


@query("b1_updated_vehicles", sql("pings", f"SELECT DISTINCT vehicle_id FROM ({NEW_SQL}) n", batch=BATCH))
def _(spark, sf):
    return upkeep.updated_vehicles(upkeep.new_pings(ping_batch(spark, sf), stage(spark, sf, "pings").filter("ping_id % 3 <> 0")))


FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY event_us, condition_ord) AS rk FROM conditions) f WHERE rk = 1"


@query("b2_append_geofence_events", sql("", "SELECT id, event_type, vehicle_id, event_us FROM (" + FIRST.format(key="id") + ") g WHERE e % 4 <> 0", conditions=CONDITIONS))
def _(spark, sf):
    old = fx.geofence_events(spark, sf).filter("CAST(id AS BIGINT) % 4 = 0")
    fresh = upkeep.new_geofence_events(feeds.flatten_geofence_payloads(fence_payloads(spark, sf)), old)
    return fresh.select("id", "event_type", "vehicle_id", F.unix_micros("event_time").alias("event_us"))


@query("b3_upsert_vehicles", sql("vehicles", """
SELECT id, name, asset_type, license_plate, CAST(NULL AS VARCHAR) AS gateway_serial FROM vehicles WHERE CAST(id AS BIGINT) % 2 = 0
UNION ALL SELECT vehicle_id, vehicle_name, asset_type, license_plate, gateway_serial FROM (""" + FIRST.format(key="vehicle_id")
    + ") f WHERE CAST(vehicle_id AS BIGINT) % 2 <> 0", conditions=CONDITIONS))
def _(spark, sf):
    old = fx.vehicles(spark, sf).filter("CAST(id AS BIGINT) % 2 = 0")
    out = upkeep.upsert_vehicles(feeds.flatten_geofence_payloads(fence_payloads(spark, sf)), old)
    return out.select("id", "name", "asset_type", "license_plate", "gateway_serial")


@query("b4_upsert_drivers", sql("", """
SELECT coalesce(o.id, n.driver_id) AS id, coalesce(n.name, o.name) AS name
FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id, 'Old' AS name FROM events WHERE user_id < 12) o
FULL JOIN (SELECT driver_id, arg_max(driver_name, (assigned_at, driver_name)) AS name FROM assigned GROUP BY driver_id) n ON n.driver_id = o.id""", assigned=ASSIGNED))
def _(spark, sf):
    old = fx.events(spark, sf).filter("user_id < 12").select(F.col("user_id").cast("string").alias("id")).distinct().withColumn("name", F.lit("Old"))
    return upkeep.upsert_drivers(assigned(spark, sf), old)


@query("b5_eta_documents", sql("l3", """
SELECT vehicle_id, concat('{', string_agg(concat('"', stop_name, '":"', strftime(make_timestamp(u), '%Y-%m-%dT%H:%M:%S.%f'), '+00:00"'), ','
       ORDER BY stop_name), '}') AS etas
FROM (SELECT vehicle_id, stop_name, max(t_us) AS u FROM l3 WHERE stop_name IS NOT NULL GROUP BY vehicle_id, stop_name) x GROUP BY vehicle_id"""))
def _(spark, sf):
    visits = stage(spark, sf, "l3").filter("stop_name IS NOT NULL").select(
        "vehicle_id", F.col("t_us").alias("stop_ord"), "stop_name", F.col("t_us").alias("stop_us"))
    docs = upkeep.eta_documents(visits, F.lit(NOW).cast("timestamp"))
    return docs.select("vehicle_id", upkeep.eta_json(F.col("etas")).alias("etas"))


PURGE_AT = "2024-01-20 00:00:00"


@query("b8_purge_pings", f"SELECT event_id FROM events WHERE ts < TIMESTAMP '{PURGE_AT}'")
def _(spark, sf):
    return upkeep.purge_since(fx.events(spark, sf), "ts", F.lit(PURGE_AT).cast("timestamp")).select("event_id")


@query("b8_purge_events_keep_entry", sql("geofence_events", f"""
SELECT id FROM geofence_events WHERE event_time < TIMESTAMP '{PURGE_AT}'
UNION ALL SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY event_time DESC, id DESC) AS rk FROM geofence_events
                          WHERE event_time >= TIMESTAMP '{PURGE_AT}') x WHERE rk = 1 AND event_type = 'geofenceEntry'"""))
def _(spark, sf):
    return upkeep.purge_events_since(fx.geofence_events(spark, sf), F.lit(PURGE_AT).cast("timestamp"), True).select("id")


@query("b2_append_unknown_events", sql("", "SELECT id, event_type, vehicle_id, event_us, e % 4 <> 0 AS is_new FROM (" + FIRST.format(key="id") + ") g WHERE e % 4 <> 0 OR e % 8 = 0", conditions=CONDITIONS))
def _(spark, sf):
    """Every fourth event is stored before; the payloads come twice. The day table ends up with each event once."""
    flat = feeds.flatten_geofence_payloads(fence_payloads(spark, sf))
    table = DayTable(scratch(spark, "events-by-day"), "event_time", "id")
    e = F.col("id").cast("long")
    table.write(upkeep.first_per_key(flat.filter(e % 8 == 0), ["id"], ["event_time", "condition_ord"]).withColumn("is_new", F.lit(False)))
    for _ in range(2):
        upkeep.append_unknown(table, flat.filter(e % 4 != 0).withColumn("is_new", F.lit(True)), ["event_time", "condition_ord"])
    return table.rows(spark).select("id", "event_type", "vehicle_id", F.unix_micros("event_time").alias("event_us"), "is_new")


@query("a2_p2_day_window", """
SELECT 'from' AS what, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'
UNION ALL SELECT 'between', event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 12:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'""")
def _(spark, sf):
    table = DayTable(scratch(spark, "pings-by-day"), "ts")
    table.write(fx.events(spark, sf).select("event_id", "ts"))
    at = lambda text: F.lit(text).cast("timestamp")
    out = lambda df, what: df.select(F.lit(what).alias("what"), "event_id")
    return out(table.window(spark, at("2024-01-20 00:00:00")), "from").unionByName(
        out(table.window(spark, at("2024-01-10 12:00:00"), at("2024-01-12 00:00:00")), "between"))


@query("b8_purge_days", sql("geofence_events", f"""
SELECT id FROM geofence_events WHERE event_time < TIMESTAMP '{PURGE_AT}'
UNION ALL SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY event_time DESC, id DESC) AS rk FROM geofence_events
                          WHERE event_time >= TIMESTAMP '{PURGE_AT}') x WHERE rk = 1 AND event_type = 'geofenceEntry'"""))
def _(spark, sf):
    """The same purge on a day table: the day it cuts into is rewritten, later ones go, earlier ones are not touched."""
    events, at = fx.geofence_events(spark, sf), F.lit(PURGE_AT).cast("timestamp")
    table = DayTable(scratch(spark, "purged-by-day"), "event_time")
    table.write(events)
    stays = upkeep.purge_events_since(table.window(spark, at), at, True)
    table.purge_since(spark, at, cut(stays, "kept"))
    return table.rows(spark).select("id")


HISTORY = """
SELECT CAST(user_id AS VARCHAR) AS vehicle_id, CAST(event_id % 3 AS VARCHAR) AS driver_id, ts AS assigned_at, event_id FROM events WHERE event_type = 'purchase'"""
INTERVALS = """
SELECT vehicle_id, driver_id, assigned_at AS assignment_start, lead(assigned_at) OVER (PARTITION BY vehicle_id ORDER BY assigned_at, event_id) AS assignment_end
FROM (SELECT *, lag(driver_id) OVER (PARTITION BY vehicle_id ORDER BY assigned_at, event_id) AS prev FROM history) h WHERE driver_id IS DISTINCT FROM prev"""


def intervals(spark, sf):
    made = fx.events(spark, sf).filter("event_type = 'purchase'").select(
        F.col("user_id").cast("string").alias("vehicle_id"), (F.col("event_id") % 3).cast("string").alias("driver_id"),
        F.col("ts").alias("assigned_at"), F.col("event_id").alias("assignment_id"))
    return upkeep.assignment_intervals(made)


def interval_micros(df):
    return df.select("vehicle_id", "driver_id", F.unix_micros("assignment_start").alias("start_us"),
                     F.unix_micros("assignment_end").alias("end_us"))


@query("j16_assignment_intervals", sql("", "SELECT vehicle_id, driver_id, epoch_us(assignment_start) AS start_us, epoch_us(assignment_end) AS end_us FROM intervals",
                                       history=HISTORY, intervals=INTERVALS), "end_us")
def _(spark, sf):
    return interval_micros(intervals(spark, sf))


@query("j16_apply_assignments", sql("", f"""
SELECT i.vehicle_id, i.driver_id, epoch_us(i.assignment_start) AS start_us,
       epoch_us(CASE WHEN i.assignment_end IS NULL AND b.driver_id <> i.driver_id THEN TIMESTAMP '{NOW}' ELSE i.assignment_end END) AS end_us
FROM intervals i LEFT JOIN latest b ON b.vehicle_id = i.vehicle_id
UNION ALL SELECT b.vehicle_id, b.driver_id, epoch_us(b.at_), NULL FROM latest b
WHERE NOT EXISTS (SELECT 1 FROM intervals i WHERE i.vehicle_id = b.vehicle_id AND i.assignment_end IS NULL AND i.driver_id = b.driver_id)""",
    history=HISTORY, intervals=INTERVALS, latest="""
SELECT vehicle_id, driver_id, at_ FROM (SELECT CAST(user_id AS VARCHAR) AS vehicle_id, CAST(event_id % 3 AS VARCHAR) AS driver_id, ts AS at_,
       row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 3 DESC) AS rk FROM events WHERE event_type = 'view') v WHERE rk = 1"""), "end_us")
def _(spark, sf):
    batch = fx.events(spark, sf).filter("event_type = 'view'").select(
        F.col("user_id").cast("string").alias("vehicle_id"), (F.col("event_id") % 3).cast("string").alias("driver_id"), F.col("ts").alias("assigned_at"))
    return interval_micros(upkeep.apply_assignments(intervals(spark, sf), batch, F.lit(NOW).cast("timestamp")))


CACHE_CUT = 1704067200000000 + 600_000_000


@query("j24_context_rows", sql("pings", f"""
SELECT vehicle_id, t_us, ping_id FROM (
  SELECT *, row_number() OVER (PARTITION BY vehicle_id, t_us ORDER BY fresh DESC, ping_id DESC) AS rk FROM (
    SELECT vehicle_id, t_us, ping_id, 1 AS fresh FROM pings WHERE t_us >= {CACHE_CUT}
    UNION ALL SELECT vehicle_id, t_us, ping_id, 0 FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, ping_id DESC) AS r
      FROM pings WHERE t_us < {CACHE_CUT}) c WHERE r <= 2 AND vehicle_id IN (SELECT vehicle_id FROM pings WHERE t_us >= {CACHE_CUT})) u) k WHERE rk = 1"""))
def _(spark, sf):
    p = stage(spark, sf, "pings").select("vehicle_id", "t_us", "ping_id")
    return upkeep.context_rows(p.filter(F.col("t_us") < CACHE_CUT), p.filter(F.col("t_us") >= CACHE_CUT))


@query("w20_u1_merge_keep_last", sql("pings", """
SELECT vehicle_id, t_us, max(ping_id) AS ping_id, max(latitude) AS latitude FROM batch GROUP BY vehicle_id, t_us""",
    batch="""SELECT vehicle_id, t_us, max(ping_id) AS ping_id, arg_max(latitude, ping_id) AS latitude FROM (""" + BATCH + """) b GROUP BY vehicle_id, t_us"""))
def _(spark, sf):
    b = ping_batch(spark, sf)
    return upkeep.merge_keep_last(b.filter("ping_id < 1000000000"), b.filter("ping_id >= 1000000000")).select("vehicle_id", "t_us", "ping_id", "latitude")


@query("u3_membership", sql("l2 l3", """
SELECT 'kept' AS what, count(*) AS n FROM l2 WHERE ping_id IN (SELECT ping_id FROM l3) UNION ALL
SELECT 'gone', count(*) FROM l2 WHERE ping_id NOT IN (SELECT ping_id FROM l3)"""))
def _(spark, sf):
    a, b = stage(spark, sf, "l2"), stage(spark, sf, "l3").select("ping_id")
    n = lambda df, what: df.agg(F.count("*").alias("n")).withColumn("what", F.lit(what))
    return n(a.join(b, "ping_id", "left_semi"), "kept").unionByName(n(a.join(b, "ping_id", "left_anti"), "gone"))
