"""Schedule queries. The two-route timetable used against stop visits is drawn from the orders too."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import fixture as fx
from queries.enrichment import rounded
from queries.live import daytime_pings
from queries.oracle import hav, sql
from queries.registry import query
from queries.scalars import CALENDAR_SQL, calendar
from wayfleet.operators import schedule as ops

LOCAL = "(({ts} AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"
CLOCK = "concat(CAST((minute // 60 + 11) % 12 + 1 AS VARCHAR), ':', lpad(CAST(minute % 60 AS VARCHAR), 2, '0'), CASE WHEN minute < 720 THEN ' AM' ELSE ' PM' END)"
AGGREGATED = """
SELECT c.dow, d.route, d.minute, CASE WHEN d.minute = 0 THEN 1440 ELSE d.minute END AS ord, count(*) AS n
FROM departures d JOIN calendar c ON c.service = d.service GROUP BY c.dow, d.route, d.minute"""


def aggregated(spark, sf):
    return ops.aggregate_schedule(fx.derive(spark, sf, "departures"), calendar(spark))


@query("g2_aggregate_schedule", sql("departures", f"""
SELECT dow, route, string_agg(concat({CLOCK}, 'x', CAST(n AS VARCHAR)), ',' ORDER BY ord) AS times FROM aggregated GROUP BY dow, route""",
    calendar=CALENDAR_SQL, aggregated=AGGREGATED))
def _(spark, sf):
    shown = F.transform("times", lambda t: F.concat(t["time"], F.lit("x"), t["n"].cast("string")))
    return aggregated(spark, sf).select("dow", "route", F.array_join(shown, ",").alias("times"))


NOWS = f"""
SELECT event_id, route, dow, m, at_ FROM (SELECT event_id, concat('R', CAST(event_id % 211 AS VARCHAR)) AS route, ts AS at_,
  CAST(dayofweek({LOCAL.format(ts='ts')}) AS INT) AS dow, CAST(hour({LOCAL.format(ts='ts')}) * 60 + minute({LOCAL.format(ts='ts')}) AS INT) AS m FROM events) e"""
# A list is scanned up to the first later departure; 12:00 AM stands last, after all others.
LOOPS = """
SELECT w.event_id, w.route, w.dow, w.at_, CASE WHEN count(a.minute) > 0 THEN
         CASE WHEN count(*) FILTER (a.minute > w.m) > 0 THEN count(*) FILTER (a.minute <= w.m AND a.ord < 1440) ELSE count(*) END - 1 END AS loop_idx,
       CASE WHEN count(*) FILTER (a.minute > w.m) = 0 AND bool_or(a.ord = 1440) THEN 0
            ELSE max(a.minute) FILTER (a.minute <= w.m AND a.ord < 1440) END AS departure_minute
FROM nows w LEFT JOIN aggregated a ON a.dow = w.dow AND a.route = w.route GROUP BY w.event_id, w.route, w.dow, w.at_, w.m"""


def loops(spark, sf):
    nows = fx.events(spark, sf).select("event_id", F.concat(F.lit("R"), (F.col("event_id") % 211).cast("string")).alias("route"), F.col("ts").alias("now"))
    return ops.current_loop(nows, aggregated(spark, sf))


@query("j14_current_loop", sql("departures", "SELECT event_id, route, dow, loop_idx, departure_minute FROM loops",
                               calendar=CALENDAR_SQL, aggregated=AGGREGATED, nows=NOWS, loops=LOOPS), "loop_idx departure_minute")
def _(spark, sf):
    return loops(spark, sf).drop("now")


@query("j21_scheduled_stop_times", sql("departures grid_stops", f"""
SELECT l.event_id, s.stop_name, epoch_us((date_trunc('day', {LOCAL.format(ts='l.at_')}) + INTERVAL 1 MINUTE * (l.departure_minute + s.offset_min))
       AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC') AS stop_us
FROM loops l JOIN grid_stops s ON s.route = l.route WHERE l.departure_minute IS NOT NULL""",
    calendar=CALENDAR_SQL, aggregated=AGGREGATED, nows=NOWS, loops=LOOPS))
def _(spark, sf):
    t = ops.scheduled_stop_times(loops(spark, sf), fx.derive(spark, sf, "grid_stops"))
    return t.select("event_id", "stop_name", F.unix_micros("stop_time").alias("stop_us"))


def visits_sql(since: str) -> str:
    return f"""
SELECT vehicle_id, day_us, route AS route_name, stop_name FROM (
  SELECT p.vehicle_id, p.day_us, s.route, s.stop_name, {hav('p.latitude', 'p.longitude', 's.lat', 's.lon')} AS km,
         row_number() OVER (PARTITION BY p.ping_id ORDER BY round({hav('p.latitude', 'p.longitude', 's.lat', 's.lon')}, 9), s.route, s.stop_ord) AS rk
  FROM pings p CROSS JOIN stops s WHERE p.day_us >= epoch_us(TIMESTAMP '{since}')) x WHERE rk = 1 AND km < 0.020"""


# The labels are those of one service day; what compares visits with the timetable takes all days.
ONE_DAY, ALL_DAYS = "2024-01-10 05:00:00", "1970-01-01 00:00:00"
VISITS = visits_sql(ALL_DAYS)


def visits(spark, sf, since=ALL_DAYS):
    return ops.label_stop_visits(daytime_pings(spark, sf), fx.network(spark, sf), F.lit(since).cast("timestamp"))


@query("j19_label_stop_visits", sql("pings stops", "SELECT * FROM visits", visits=visits_sql(ONE_DAY)))
def _(spark, sf):
    return visits(spark, sf, ONE_DAY).withColumn("day_us", F.unix_micros("timestamp")).drop("timestamp")


# The same departures run by NORTH and WEST, 24 buses per service.
TWO_ROUTES = """
SELECT service, concat('Bus ', CAST(seq % 24 AS VARCHAR)) AS bus, minute, CASE WHEN seq % 2 = 0 THEN 'NORTH' ELSE 'WEST' END AS route FROM departures"""


def two_routes(spark, sf):
    return fx.derive(spark, sf, "departures").selectExpr(
        "service", "concat('Bus ', CAST(seq % 24 AS STRING)) AS bus", "minute", "CASE WHEN seq % 2 = 0 THEN 'NORTH' ELSE 'WEST' END AS route")


SEEN = f"""
SELECT DISTINCT vehicle_id, CAST({LOCAL.format(ts='make_timestamp(day_us)')} AS DATE) AS service_day, upper(dayname({LOCAL.format(ts='make_timestamp(day_us)')})) AS day,
       route_name AS route, CAST(hour({LOCAL.format(ts='make_timestamp(day_us)')}) * 60 + minute({LOCAL.format(ts='make_timestamp(day_us)')}) AS INT) AS minute FROM visits"""


def overlap(spark, sf):
    return ops.schedule_overlap(visits(spark, sf), two_routes(spark, sf), calendar(spark))


@query("j17_schedule_overlap", sql("pings stops departures", """
SELECT CAST(service_day AS VARCHAR) AS service_day, vehicle_id, bus, count(*) AS n_matches, max(n_slots) AS n_slots, round(1 - count(*) / max(n_slots), 6) AS cost
FROM (SELECT s.service_day, s.vehicle_id, o.bus, o.n_slots FROM seen s JOIN calendar c ON c.day = s.day
      JOIN (SELECT DISTINCT t.service, t.bus, t.route, t.minute, n.n_slots FROM two_routes t JOIN (SELECT service, bus, count(*) AS n_slots FROM two_routes GROUP BY service, bus) n
            ON n.service = t.service AND n.bus = t.bus) o ON o.service = c.service AND o.route = s.route AND o.minute = s.minute) x
GROUP BY service_day, vehicle_id, bus""", visits=VISITS, two_routes=TWO_ROUTES, calendar=CALENDAR_SQL, seen=SEEN))
def _(spark, sf):
    return rounded(overlap(spark, sf).withColumn("service_day", F.col("service_day").cast("string")), ["cost"])


@query("j18_assign_buses")
def _(spark, sf):
    return rounded(ops.assign_buses(overlap(spark, sf)).withColumn("service_day", F.col("service_day").cast("string")), ["cost"])


@query("u2_common_pairs", sql("pings stops departures", "SELECT route, minute FROM seen INTERSECT SELECT route, minute FROM two_routes",
                              visits=VISITS, two_routes=TWO_ROUTES, seen=SEEN))
def _(spark, sf):
    local = F.from_utc_timestamp("timestamp", "America/New_York")
    v = visits(spark, sf).select(F.col("route_name").alias("route"), (F.hour(local) * 60 + F.minute(local)).alias("minute"))
    return ops.common_pairs(v, two_routes(spark, sf))


@query("u4_distinct_stops_for_day", sql("departures grid_stops", """
SELECT route, stop_ord, stop_name, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY round(lat, 6), round(lon, 6) ORDER BY route, stop_ord) AS rk
FROM grid_stops WHERE route IN (SELECT route FROM aggregated WHERE dow = 2)) x WHERE rk = 1""", calendar=CALENDAR_SQL, aggregated=AGGREGATED))
def _(spark, sf):
    return ops.distinct_stops_for_day(fx.derive(spark, sf, "grid_stops"), aggregated(spark, sf), 2)
