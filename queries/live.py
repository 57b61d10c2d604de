"""Live views and daily tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import fixture as fx
from queries.enrichment import rounded
from queries.ingest import HISTORY, INTERVALS, intervals
from queries.oracle import sql
from queries.registry import query, stage
from wayfleet.operators.asof import asof_join
from wayfleet.operators import live, matching

DAY, NOW = "2024-01-20 05:00:00", "2024-01-28 12:00:00"


def at(text):
    return F.lit(text).cast("timestamp")


def ids(spark, sf, every=3):
    some = fx.events(spark, sf).filter(F.col("user_id") % every == 0).select(F.col("user_id").cast("string").alias("vehicle_id"))
    return some.unionByName(some.select(F.concat(F.lit("x"), "vehicle_id").alias("vehicle_id"))).distinct()


IDS = """SELECT CAST(user_id AS VARCHAR) AS vehicle_id FROM events WHERE user_id % 3 = 0
UNION SELECT concat('x', CAST(user_id AS VARCHAR)) FROM events WHERE user_id % 3 = 0"""


@query("p1_active_announcements", f"""
SELECT event_id AS id, props AS message FROM events WHERE event_type = 'view' AND event_id % 2 = 0 AND event_id % 9 <> 0
       AND ts + INTERVAL 1 HOUR * CAST(floor(value) AS INT) >= TIMESTAMP '{NOW}'""")
def _(spark, sf):
    a = fx.events(spark, sf).filter("event_type = 'view'").selectExpr(
        "event_id AS id", "props AS message", "event_id % 2 = 0 AS active", "ts AS created_at",
        "CASE WHEN event_id % 9 <> 0 THEN ts + make_dt_interval(0, CAST(floor(value) AS INT)) END AS expires_at")
    return live.active_announcements(a, at(NOW)).select("id", "message")


@query("p2_today_range", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{DAY}' AND ts <= TIMESTAMP '{NOW}'")
def _(spark, sf):
    return live.between_day_start_and(fx.events(spark, sf), "ts", at(DAY), at(NOW)).select("event_id")


@query("p3_open_assignments", sql("", """
SELECT vehicle_id, driver_id, epoch_us(assignment_start) AS start_us FROM intervals WHERE assignment_end IS NULL AND vehicle_id IN (SELECT vehicle_id FROM ids)""",
    history=HISTORY, intervals=INTERVALS, ids=IDS))
def _(spark, sf):
    return live.open_assignments(intervals(spark, sf), ids(spark, sf)).select("vehicle_id", "driver_id", F.unix_micros("assignment_start").alias("start_us"))


@query("p4_only_vehicles", sql("pings", "SELECT vehicle_id, ping_id FROM pings WHERE vehicle_id IN (SELECT vehicle_id FROM ids)", ids=IDS))
def _(spark, sf):
    return live.only_vehicles(stage(spark, sf, "pings"), ids(spark, sf)).select("vehicle_id", "ping_id")


INSIDE = f"""SELECT DISTINCT g.vehicle_id FROM geofence_events g JOIN (SELECT vehicle_id, max(event_time) AS m FROM geofence_events
WHERE event_time >= TIMESTAMP '{DAY}' GROUP BY vehicle_id) l ON l.vehicle_id = g.vehicle_id AND l.m = g.event_time WHERE g.event_type = 'geofenceEntry'"""


@query("j5_vehicles_in_geofence", sql("geofence_events", INSIDE))
def _(spark, sf):
    return live.vehicles_in_geofence(fx.geofence_events(spark, sf), at(DAY))


# What the fixture's vehicles report besides their position.
REPORTED = {"heading_degrees": "CAST(ping_id * 7 % 360 AS DOUBLE)", "speed_mph": "CAST(ping_id % 50 AS DOUBLE)", "is_ecu_speed": "ping_id % 2 = 0",
            "formatted_location": "concat('Street ', CAST(ping_id % 20 AS {str}))", "address_id": "CASE WHEN ping_id % 5 = 0 THEN CAST(ping_id % 11 AS {str}) END",
            "address_name": "CASE WHEN ping_id % 5 = 0 THEN concat('Yard ', CAST(ping_id % 11 AS {str})) END"}
READINGS = ", ".join(f"{e.format(str='VARCHAR')} AS {c}" for c, e in REPORTED.items())


def readings(pings):
    return pings.withColumns({c: F.expr(e.format(str="STRING")) for c, e in REPORTED.items()})


LAST = f"""SELECT p.vehicle_id, p.ping_id, p.t_us, p.latitude, p.longitude, {READINGS}, v.name, v.asset_type, v.license_plate
FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, ping_id DESC) AS rk FROM pings) p
JOIN vehicles v ON v.id = p.vehicle_id WHERE p.rk = 1 AND p.vehicle_id IN (SELECT vehicle_id FROM inside)"""
PLACE = ["latitude", "longitude"]


def inside(spark, sf):
    return live.vehicles_in_geofence(fx.geofence_events(spark, sf), at(DAY))


@query("j6_latest_location", sql("pings geofence_events vehicles", "SELECT * REPLACE (round(latitude, 6) AS latitude, round(longitude, 6) AS longitude) FROM (" + LAST + ") l", inside=INSIDE))
def _(spark, sf):
    return rounded(live.latest_location(readings(stage(spark, sf, "pings")), inside(spark, sf), fx.vehicles(spark, sf)), PLACE)


def drivers(spark, sf):
    return fx.events(spark, sf).select((F.col("event_id") % 2).cast("string").alias("id")).distinct().withColumn(
        "name", F.concat(F.lit("Driver "), "id"))


DRIVER = """SELECT i.vehicle_id, i.driver_id, CASE WHEN i.driver_id IN ('0', '1') THEN concat('Driver ', i.driver_id) END AS driver_name
FROM intervals i WHERE i.assignment_end IS NULL"""


@query("j7_current_driver", sql("geofence_events", "SELECT vehicle_id, driver_id, driver_name FROM driver WHERE vehicle_id IN (SELECT vehicle_id FROM inside)",
                                history=HISTORY, intervals=INTERVALS, inside=INSIDE, driver=DRIVER))
def _(spark, sf):
    return live.current_driver(intervals(spark, sf), drivers(spark, sf), inside(spark, sf)).select("vehicle_id", "driver_id", "driver_name")


def etas(spark, sf):
    stop = lambda letter, n: F.concat(F.lit(f"{letter}_STOP_"), (F.col("event_id") % n).cast("string"))
    later = F.col("ts") + F.expr("INTERVAL 60 SECOND")
    return fx.events(spark, sf).filter("event_type = 'purchase'").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("vehicle_id"), F.col("ts").alias("timestamp"),
        F.create_map(stop("N", 4), F.col("ts"), stop("W", 3), later).alias("etas"))


@query("j8_latest_eta", sql("", """
SELECT vehicle_id, id, epoch_us(ts) AS at_us, concat('N_STOP_', CAST(id % 4 AS VARCHAR)) AS first_stop FROM (
  SELECT CAST(user_id AS VARCHAR) AS vehicle_id, event_id AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk
  FROM events WHERE event_type = 'purchase') e WHERE rk = 1 AND vehicle_id IN (SELECT vehicle_id FROM ids)""", ids=IDS))
def _(spark, sf):
    return live.latest_eta(etas(spark, sf), ids(spark, sf)).select(
        "vehicle_id", "id", F.unix_micros("timestamp").alias("at_us"), F.element_at(F.array_sort(F.map_keys("etas")), 1).alias("first_stop"))


def predicted(spark, sf):
    return fx.events(spark, sf).filter("event_type = 'click'").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("vehicle_id"),
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("speed_kmh"), F.col("ts").alias("timestamp"))


SPEED = """SELECT vehicle_id, speed_kmh, epoch_us(ts) AS at_us FROM (SELECT CAST(user_id AS VARCHAR) AS vehicle_id, CASE WHEN event_id % 5 <> 0 THEN value END AS speed_kmh, ts,
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events WHERE event_type = 'click') e WHERE rk = 1"""


@query("j9_latest_velocity", sql("", "SELECT * FROM speed WHERE vehicle_id IN (SELECT vehicle_id FROM ids)", speed=SPEED, ids=IDS))
def _(spark, sf):
    return live.latest_velocity(predicted(spark, sf), ids(spark, sf)).select("vehicle_id", "speed_kmh", F.unix_micros("timestamp").alias("at_us"))


LATEST = """SELECT i.vehicle_id, l.t_us, l.dist_to_route, l.route, l.polyline_idx, l.segment_idx, l.stop_name FROM {ids} i
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, ping_id DESC) AS rk FROM live) l ON l.vehicle_id = i.vehicle_id AND l.rk = 1"""


@query("j10_latest_match", sql("live", "SELECT * REPLACE (round(dist_to_route, 6) AS dist_to_route) FROM (" + LATEST.format(ids="ids") + ") m", ids=IDS),
       "t_us polyline_idx segment_idx")
def _(spark, sf):
    return rounded(live.latest_match(stage(spark, sf, "live"), ids(spark, sf)), ["dist_to_route"])


VIEW = "SELECT l.*, d.driver_id, d.driver_name FROM (" + LAST + ") l LEFT JOIN driver d ON d.vehicle_id = l.vehicle_id"


def locations(spark, sf):
    return live.live_locations(readings(stage(spark, sf, "pings")), fx.geofence_events(spark, sf), fx.vehicles(spark, sf), intervals(spark, sf),
                               drivers(spark, sf), at(DAY))


@query("j11_live_locations_view", sql("pings geofence_events vehicles", "SELECT * REPLACE (round(latitude, 6) AS latitude, round(longitude, 6) AS longitude) FROM (" + VIEW + ") v",
                                      inside=INSIDE, history=HISTORY, intervals=INTERVALS, driver=DRIVER))
def _(spark, sf):
    return rounded(locations(spark, sf), PLACE)


VELOCITY = """SELECT i.vehicle_id, s.speed_kmh, s.at_us, m.polyline_idx, m.segment_idx, m.stop_name AS current_stop, m.stop_name IS NOT NULL AS is_at_stop,
CASE WHEN m.dist_to_route < 0.05 THEN m.route END AS route_name
FROM inside i LEFT JOIN speed s ON s.vehicle_id = i.vehicle_id LEFT JOIN match m ON m.vehicle_id = i.vehicle_id"""


def velocities(spark, sf):
    return live.live_velocities(fx.geofence_events(spark, sf), predicted(spark, sf), stage(spark, sf, "live"), at(DAY))


@query("j12_live_velocity_view", sql("live geofence_events", VELOCITY, inside=INSIDE, speed=SPEED, match=LATEST.format(ids="inside")),
       "at_us polyline_idx segment_idx")
def _(spark, sf):
    return velocities(spark, sf).withColumn("at_us", F.unix_micros("timestamp")).drop("timestamp")


@query("j13_combined_live_view", sql("pings live geofence_events vehicles", """
SELECT v.vehicle_id, v.name, v.speed_mph, v.heading_degrees, v.address_name, v.driver_id, c.route_name, c.current_stop, CASE WHEN c.speed_kmh IS NOT NULL AND c.at_us IS NOT NULL THEN c.speed_kmh END AS predicted_kmh
FROM view_ v LEFT JOIN velocity c ON c.vehicle_id = v.vehicle_id""", inside=INSIDE, history=HISTORY, intervals=INTERVALS, driver=DRIVER, view_=VIEW,
    speed=SPEED, match=LATEST.format(ids="inside"), velocity=VELOCITY))
def _(spark, sf):
    return live.combined_view(locations(spark, sf), velocities(spark, sf)).select(
        "vehicle_id", "name", "speed_mph", "heading_degrees", "address_name", "driver_id", "route_name", "current_stop", F.col("predicted_location.speed_kmh").alias("predicted_kmh"))


@query("j22_dead_reckon", sql("l3 measured", """
SELECT ping_id, round(at_km, 6) AS target_km, segment_idx AS target_segment, round(lat1 + f * (lat2 - lat1), 6) AS target_lat, round(lon1 + f * (lon2 - lon1), 6) AS target_lon
FROM (SELECT q.ping_id, q.at_km, m.segment_idx, m.lat1, m.lat2, m.lon1, m.lon2, least(1e0, (q.at_km - (m.cum_end - m.seg_km)) / m.seg_km) AS f,
             row_number() OVER (PARTITION BY q.ping_id ORDER BY m.segment_idx) AS rk
      FROM (SELECT ping_id, route, polyline_idx, least(polyline_length, dist_from_start + CASE WHEN ping_id % 2 = 0 THEN (ping_id % 90) * 1e0 ELSE (ping_id % 80 + 1) * 0.621371 END * 0.44704 * 30 / 1000) AS at_km
            FROM l3 WHERE dist_from_start IS NOT NULL) q
      JOIN measured m ON m.route = q.route AND m.polyline_idx = q.polyline_idx AND q.at_km <= m.cum_end + 0e0) z WHERE rk = 1"""))
def _(spark, sf):
    i = F.col("ping_id")
    moving = stage(spark, sf, "l3").filter("dist_from_start IS NOT NULL").withColumns({
        "speed_mph": (i % 90).cast("double"), "predicted_kmh": F.when(i % 2 == 1, (i % 80 + 1).cast("double"))})
    out = matching.dead_reckon(moving, fx.network(spark, sf), 30.0).select("ping_id", "target_km", "target_segment", "target_lat", "target_lon")
    return rounded(out, ["target_km", "target_lat", "target_lon"])


@query("g3_earliest_eta_per_stop", """
SELECT stop_name, epoch_us(min(ts)) AS eta_us FROM (
  SELECT concat('N_STOP_', CAST(event_id % 4 AS VARCHAR)) AS stop_name, ts FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT concat('W_STOP_', CAST(event_id % 3 AS VARCHAR)), ts + INTERVAL 60 SECOND FROM events WHERE event_type = 'purchase') s GROUP BY stop_name""")
def _(spark, sf):
    return live.earliest_eta_per_stop(etas(spark, sf)).select("stop_name", F.unix_micros("eta").alias("eta_us"))


def daytime_pings(spark, sf):
    return stage(spark, sf, "pings").withColumn("t_us", F.col("day_us")).withColumn("timestamp", F.timestamp_micros("t_us"))


SERVICE_DAY = "epoch_us((date_trunc('day', ({ts} AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC')"


@query("g4_daily_tracks", sql("pings geofence_events", f"""
SELECT p.vehicle_id, p.day AS service_day_us, p.chunk, p.track, epoch_us(m.entry) AS entry_us, epoch_us(m.exit_) AS exit_us
FROM (SELECT vehicle_id, day, (rn - 1) // 2 AS chunk, string_agg(concat(CAST(ping_id AS VARCHAR), '@', CAST(CAST(speed_mph AS INT) AS VARCHAR), '/', CAST(CAST(heading_degrees AS INT) AS VARCHAR), '/', coalesce(address_id, '')), ',' ORDER BY day_us, ping_id) AS track
      FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, day ORDER BY day_us, ping_id) AS rn
            FROM (SELECT *, {READINGS}, {SERVICE_DAY.format(ts='make_timestamp(day_us)')} AS day FROM pings) a) b GROUP BY 1, 2, 3) p
LEFT JOIN (SELECT vehicle_id, {SERVICE_DAY.format(ts='event_time')} AS day, min(CASE WHEN event_type = 'geofenceEntry' THEN event_time END) AS entry,
                  max(CASE WHEN event_type = 'geofenceExit' THEN event_time END) AS exit_ FROM geofence_events GROUP BY 1, 2) m ON m.vehicle_id = p.vehicle_id AND m.day = p.day"""),
    "entry_us exit_us")
def _(spark, sf):
    t = live.daily_tracks(readings(daytime_pings(spark, sf)), fx.geofence_events(spark, sf), chunk_rows=2)
    return t.select("vehicle_id", F.unix_micros("service_day").alias("service_day_us"), "chunk",
                    F.array_join(F.transform("points", lambda p: F.concat(p["ping_id"].cast("string"), F.lit("@"), p["speed_mph"].cast("int").cast("string"), F.lit("/"),
                        p["heading_degrees"].cast("int").cast("string"), F.lit("/"), F.coalesce(p["address_id"], F.lit("")))), ",").alias("track"),
                    F.unix_micros("entry").alias("entry_us"), F.unix_micros("exit").alias("exit_us"))


FROM_FOUR = """epoch_us((date_trunc('day', ({ts} AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' - INTERVAL 4 HOUR) + INTERVAL 4 HOUR)
AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC')"""


@query("g4_tracks_from_four", sql("pings", f"""
SELECT vehicle_id, {FROM_FOUR.format(ts='make_timestamp(day_us)')} AS service_day_us, count(*) AS n_points FROM pings GROUP BY 1, 2"""))
def _(spark, sf):
    t = live.daily_tracks(daytime_pings(spark, sf), fx.geofence_events(spark, sf), start_seconds=4 * 3600)
    return (t.groupBy("vehicle_id", F.unix_micros("service_day").alias("service_day_us"))
             .agg(F.sum(F.size("points")).alias("n_points")))


HOT = "CASE WHEN user_id % 2 = 0 THEN 'hot' ELSE CAST(user_id AS {str}) END AS vehicle_id"


@query("j16_asof_driver", f"""
SELECT p.vehicle_id, p.event_id, CAST((SELECT arg_max(a.event_id, (a.t_us, a.event_id)) FROM a WHERE a.vehicle_id = p.vehicle_id AND a.t_us <= p.t_us) AS DOUBLE) AS assignment_id
FROM (SELECT {HOT.format(str='VARCHAR')}, event_id, epoch_us(ts) AS t_us FROM events) p""".replace("FROM a WHERE",
    f"FROM (SELECT {HOT.format(str='VARCHAR')}, event_id, epoch_us(ts) AS t_us FROM events WHERE event_type = 'purchase') a WHERE"))
def _(spark, sf):
    """The assignment in force at every event, where one vehicle has half of them; slices of six hours."""
    rows = fx.events(spark, sf).selectExpr(HOT.format(str="STRING"), "event_id", "unix_micros(ts) AS t_us", "event_type")
    assigned = rows.filter("event_type = 'purchase'").withColumn("assignment_id", F.col("event_id").cast("double"))
    found = asof_join(rows.drop("event_type"), assigned, ["vehicle_id"], ["assignment_id"], tie=["event_id"], slice_seconds=6 * 3600)
    return found.select("vehicle_id", "event_id", "assignment_id")
