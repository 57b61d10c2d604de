"""Matching, trips, stops, times: the chain from raw pings to time-to-stop."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import fixture as fx
from queries.oracle import hav, sql
from queries.registry import SLICE, query, stage
from wayfleet.operators import matching, profile, stops, trips
from wayfleet.operators.scale import cut
from wayfleet.plans import enrich


def rounded(df, columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


INDEX = "polyline_idx segment_idx"
MATCH = "vehicle_id, ping_id, t_us, route, polyline_idx, segment_idx"
MATCH_SQL = f"SELECT {MATCH}, round(dist_to_route, 6) AS dist_to_route, round(closest_lat, 6) AS closest_lat, round(closest_lon, 6) AS closest_lon FROM "


def match_columns(df):
    return rounded(df.selectExpr(*MATCH.split(", "), "dist_to_route", "closest_lat", "closest_lon"),
                   ["dist_to_route", "closest_lat", "closest_lon"])


@query("j1_match_route", sql("l1", MATCH_SQL + "l1"), INDEX)
def _(spark, sf):
    return match_columns(matching.match_route(stage(spark, sf, "pings"), fx.network(spark, sf)))


@query("p6_match_missing_only", sql("l1", """
SELECT ping_id, CASE WHEN ping_id % 2 = 0 THEN 'KEPT' ELSE route END AS route,
       CASE WHEN ping_id % 2 = 0 THEN -1 ELSE polyline_idx END AS polyline_idx,
       CASE WHEN ping_id % 2 = 0 THEN -1 ELSE segment_idx END AS segment_idx FROM l1"""), INDEX)
def _(spark, sf):
    even = F.col("ping_id") % 2 == 0
    old = stage(spark, sf, "pings").withColumns({
        "route": F.when(even, "KEPT"), "polyline_idx": F.when(even, -1), "segment_idx": F.when(even, -1),
        "dist_to_route": F.when(even, 0.0), "closest_lat": F.when(even, 0.0), "closest_lon": F.when(even, 0.0)})
    out = matching.match_route(old, fx.network(spark, sf), only_missing=True)
    return out.select("ping_id", "route", "polyline_idx", "segment_idx")


@query("j2_match_target_polyline", sql("voted_std refined_std", """
SELECT ping_id, route, polyline_idx, segment_idx, round(dist_to_route, 6) AS dist_to_route, round(closest_lat, 6) AS closest_lat,
       round(closest_lon, 6) AS closest_lon FROM refined_std
WHERE ping_id IN (SELECT ping_id FROM voted_std WHERE segment_idx IS NULL AND route IS NOT NULL AND polyline_idx IS NOT NULL)"""))
def _(spark, sf):
    net, l1 = fx.network(spark, sf), stage(spark, sf, "l1")
    cuts = trips.segment_trips(l1, 15.0, "dist_to_route", 0.020, SLICE)
    lacking = trips.vote_route(cuts).filter("segment_idx IS NULL AND route IS NOT NULL AND polyline_idx IS NOT NULL")
    return rounded(matching.match_target_polyline(lacking, net).select(
        "ping_id", "route", "polyline_idx", "segment_idx", "dist_to_route", "closest_lat", "closest_lon"),
        ["dist_to_route", "closest_lat", "closest_lon"])


@query("w1_segment_trips", sql("cut_std", "SELECT vehicle_id, ping_id, segment_no FROM cut_std"))
def _(spark, sf):
    return trips.segment_trips(stage(spark, sf, "l1"), 15.0, "dist_to_route", 0.020, SLICE).select(
        "vehicle_id", "ping_id", "segment_no")


@query("w1_segment_trips_gap_only", sql("pings", """
SELECT vehicle_id, ping_id, CAST(sum(s) OVER (PARTITION BY vehicle_id ORDER BY t_us, ping_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_no
FROM (SELECT *, CASE WHEN coalesce(t_us - lag(t_us) OVER (PARTITION BY vehicle_id ORDER BY t_us, ping_id), 99000000) > 15000000 THEN 1 ELSE 0 END AS s
      FROM pings) x"""))
def _(spark, sf):
    return trips.segment_trips(stage(spark, sf, "pings"), 15.0, slice_seconds=SLICE).select("vehicle_id", "ping_id", "segment_no")


@query("w2_filter_short_trips", sql("numbered_std", "SELECT ping_id, segment_no FROM numbered_std WHERE trip_rows >= 5"))
def _(spark, sf):
    cuts = trips.segment_trips(stage(spark, sf, "l1"), 15.0, "dist_to_route", 0.020, SLICE)
    return trips.filter_short(cuts, 5).select("ping_id", "segment_no")


@query("w3_vote_route", sql("voted_std", "SELECT ping_id, route, polyline_idx FROM voted_std"), "polyline_idx")
def _(spark, sf):
    cuts = trips.segment_trips(stage(spark, sf, "l1"), 15.0, "dist_to_route", 0.020, SLICE)
    return trips.vote_route(cuts).select("ping_id", "route", "polyline_idx")


@query("w4_w6_distance_delta", sql("l2_std_all", "SELECT ping_id, round(distance_km, 6) AS distance_km FROM l2_std_all"))
def _(spark, sf):
    live = stage(spark, sf, "live").drop("distance_km", "speed_kmh")
    return rounded(trips.distance_delta(live).select("ping_id", "distance_km"), ["distance_km"])


@query("w5_speed", sql("l2_std_all", "SELECT ping_id, round(speed_kmh, 4) AS speed_kmh FROM l2_std_all"))
def _(spark, sf):
    live = stage(spark, sf, "live").drop("speed_kmh")
    return rounded(trips.speed(live).select("ping_id", "speed_kmh"), ["speed_kmh"], 4)


@query("w16_cumulative_distance", sql("l2", """
SELECT ping_id, round(sum(coalesce(distance_km, 0)) OVER (PARTITION BY vehicle_id, segment_no ORDER BY t_us, ping_id
                                                      ROWS UNBOUNDED PRECEDING), 6) AS trip_km FROM l2"""))
def _(spark, sf):
    return rounded(trips.cumulative_distance(stage(spark, sf, "l2"), SLICE).select("ping_id", "trip_km"), ["trip_km"])


@query("g18_distinct_polylines", sql("l1", "SELECT DISTINCT route, polyline_idx FROM l1 WHERE route IS NOT NULL"), "polyline_idx")
def _(spark, sf):
    return trips.distinct_polylines(stage(spark, sf, "l1"))


@query("j3_match_stop", sql("pings stops", f"""
SELECT ping_id, CASE WHEN km < 0.020 THEN route END AS stop_route, CASE WHEN km < 0.020 THEN stop_name END AS stop_name
FROM (SELECT *, row_number() OVER (PARTITION BY ping_id ORDER BY round(km, 9), route, stop_ord) AS rk
      FROM (SELECT p.ping_id, s.route, s.stop_name, s.stop_ord, {hav('p.latitude', 'p.longitude', 's.lat', 's.lon')} AS km
            FROM pings p CROSS JOIN stops s) a) b WHERE rk = 1"""))
def _(spark, sf):
    return matching.match_stop(stage(spark, sf, "pings"), fx.network(spark, sf)).select("ping_id", "stop_route", "stop_name")


@query("j20_nearest_stop", sql("pings stops", f"""
SELECT ping_id, route AS nearest_route, stop_name AS nearest_stop, round(km, 6) AS nearest_km
FROM (SELECT *, row_number() OVER (PARTITION BY ping_id ORDER BY round(km, 9), route, stop_ord) AS rk
      FROM (SELECT p.ping_id, s.route, s.stop_name, s.stop_ord,
                   {hav('(p.latitude + (p.ping_id % 9) * 0.02e0)', '(p.longitude - (p.ping_id % 7) * 0.05e0)', 's.lat', 's.lon')} AS km
            FROM pings p CROSS JOIN stops s) a) b WHERE rk = 1"""))
def _(spark, sf):
    users = stage(spark, sf, "pings").selectExpr("ping_id", "latitude + (ping_id % 9) * 0.02D AS latitude",
                                           "longitude - (ping_id % 7) * 0.05D AS longitude")
    return rounded(matching.nearest_stop(users, fx.network(spark, sf)), ["nearest_km"]).select(
        "ping_id", "nearest_route", "nearest_stop", "nearest_km")


PROGRESS = ["dist_from_start", "dist_to_end", "polyline_length"]


@query("j4_polyline_progress", sql("progress_s", """
SELECT ping_id, round(dist_from_start, 6) AS dist_from_start, round(dist_to_end, 6) AS dist_to_end,
       round(polyline_length, 6) AS polyline_length FROM progress_s"""))
def _(spark, sf):
    return rounded(matching.polyline_progress(stage(spark, sf, "l2s"), fx.network(spark, sf)).select("ping_id", *PROGRESS), PROGRESS)


@query("j23_polyline_stop_lookup", sql("l2s stops", """
SELECT l.ping_id, s.stop_name AS polyline_stop FROM l2s l LEFT JOIN stops s ON s.route = l.route AND s.stop_ord = l.polyline_idx + 2"""))
def _(spark, sf):
    ahead = stage(spark, sf, "l2s").withColumn("polyline_idx", F.col("polyline_idx") + 2)
    return stops.polyline_stop_lookup(ahead, fx.network(spark, sf)).select("ping_id", "polyline_stop")


@query("w7_repair_missed_stops", sql("l3", "SELECT ping_id, stop_name, stop_route FROM l3"))
def _(spark, sf):
    net = fx.network(spark, sf)
    seen = matching.match_stop(stage(spark, sf, "l2s"), net)
    return stops.repair_missed_stops(seen, net).select("ping_id", "stop_name", "stop_route")


@query("w8_trim_after_last_stop", sql("l4", "SELECT ping_id, segment_no, stop_name FROM l4"))
def _(spark, sf):
    return stops.trim_after_last_stop(stage(spark, sf, "l3")).select("ping_id", "segment_no", "stop_name")


@query("w9_eta_to_next_stop", sql("l3", """
SELECT t.ping_id, round(((SELECT min(s.t_us) FROM l3 s WHERE s.vehicle_id = t.vehicle_id AND s.segment_no = t.segment_no
       AND s.stop_name IS NOT NULL AND s.t_us > t.t_us) - t.t_us) / 1e6, 6) AS eta_seconds FROM l3 t"""))
def _(spark, sf):
    return rounded(stops.eta_to_next_stop(stage(spark, sf, "l3"), slice_seconds=SLICE).select("ping_id", "eta_seconds"), ["eta_seconds"])


TRAVEL = ["avg_travel_time_seconds", "std_travel_time_seconds", "min_time", "max_time"]
TRAVEL_SQL = """
SELECT route, polyline_idx, round(avg_s, 6) AS avg_travel_time_seconds, round(std_s, 6) AS std_travel_time_seconds,
       n AS sample_count, round(min_s, 6) AS min_time, round(max_s, 6) AS max_time FROM travel"""


@query("g1_polyline_travel_times", sql("travel", TRAVEL_SQL))
def _(spark, sf):
    return rounded(stops.polyline_travel_times(stage(spark, sf, "l3"), slice_seconds=SLICE), TRAVEL)


@query("g1_polyline_travel_times_distinct_stops", sql("pairs", """
SELECT route, polyline_idx, count(*) AS sample_count, round(avg((next_at - t_us) / 1e6), 6) AS avg_travel_time_seconds FROM pairs
WHERE next_stop <> stop_name AND route IS NOT NULL AND polyline_idx IS NOT NULL GROUP BY route, polyline_idx"""))
def _(spark, sf):
    t = stops.polyline_travel_times(stage(spark, sf, "l3"), slice_seconds=SLICE, distinct_stops=True)
    return rounded(t.select("route", "polyline_idx", "sample_count", "avg_travel_time_seconds"), ["avg_travel_time_seconds"])


@query("t3_top_polylines", sql("travel", TRAVEL_SQL + " ORDER BY n DESC, route, polyline_idx LIMIT 10"))
def _(spark, sf):
    return rounded(profile.top_polylines(stops.polyline_travel_times(stage(spark, sf, "l3"), slice_seconds=SLICE)), TRAVEL)


@query("g19_trips_with_stops", sql("l3", """
SELECT vehicle_id, segment_no, count(stop_name) AS n_stop_rows FROM l3 GROUP BY vehicle_id, segment_no HAVING count(stop_name) >= 2"""))
def _(spark, sf):
    return stops.trips_with_stops(stage(spark, sf, "l3"))


@query("j15_last_visit_per_stop", sql("l3", """
SELECT vehicle_id, stop_name, max(t_us) AS last_t_us FROM l3 WHERE stop_name IS NOT NULL GROUP BY vehicle_id, stop_name"""))
def _(spark, sf):
    return stops.last_visit_per_stop(stage(spark, sf, "l3"))


@query("g7_trip_speed_profile", sql("l2", """
SELECT vehicle_id, segment_no, count(*) AS n_rows, round(avg(speed_kmh), 4) AS mean_kmh, round(median(speed_kmh), 4) AS median_kmh,
       round(max(speed_kmh), 4) AS max_kmh, round(min(speed_kmh), 4) AS min_kmh, round(stddev_samp(speed_kmh), 4) AS std_kmh,
       round(sum(distance_km), 6) AS total_km, min(t_us) AS start_us, max(t_us) AS end_us,
       round((max(t_us) - min(t_us)) / 1e6, 6) AS duration_s FROM l2 GROUP BY vehicle_id, segment_no"""))
def _(spark, sf):
    p = profile.trip_speed_profile(stage(spark, sf, "l2"))
    p = rounded(p, ["mean_kmh", "median_kmh", "max_kmh", "min_kmh", "std_kmh"], 4)
    return rounded(p, ["total_km", "duration_s"])


# -- composed jobs, from raw pings every time ----------------------------------------------------

L2 = "vehicle_id, ping_id, segment_no, route, polyline_idx, segment_idx"


@query("l1_preprocess", sql("l1", f"SELECT ping_id, round((t_us - 1735689600000000) / 1e6, 6) AS epoch_seconds, route, polyline_idx FROM l1"), "polyline_idx")
def _(spark, sf):
    return rounded(enrich.preprocess(stage(spark, sf, "pings"), fx.network(spark, sf)).select(
        "ping_id", "epoch_seconds", "route", "polyline_idx"), ["epoch_seconds"])


@query("l2_segment", sql("l2", f"SELECT {L2}, round(distance_km, 6) AS distance_km, round(speed_kmh, 4) AS speed_kmh FROM l2"), INDEX)
def _(spark, sf):
    df = enrich.segment_job(stage(spark, sf, "pings"), fx.network(spark, sf), slice_seconds=SLICE)
    return rounded(rounded(df.select(*L2.split(", "), "distance_km", "speed_kmh"), ["distance_km"]), ["speed_kmh"], 4)


@query("l3_stops", sql("l3", f"SELECT {L2}, stop_name, stop_route, round(dist_from_start, 6) AS dist_from_start, round(dist_to_end, 6) AS dist_to_end FROM l3"), INDEX)
def _(spark, sf):
    df = enrich.stops_job(stage(spark, sf, "pings"), fx.network(spark, sf), slice_seconds=SLICE)
    return rounded(df.select(*L2.split(", "), "stop_name", "stop_route", "dist_from_start", "dist_to_end"), ["dist_from_start", "dist_to_end"])


@query("l4_eta", sql("l4", f"SELECT {L2}, stop_name, round(eta_seconds, 6) AS eta_seconds FROM l4"), INDEX)
def _(spark, sf):
    df = enrich.eta_job(stage(spark, sf, "pings"), fx.network(spark, sf), slice_seconds=SLICE)
    return rounded(df.select(*L2.split(", "), "stop_name", "eta_seconds"), ["eta_seconds"])


@query("l7_live_enrichment", sql("live", f"SELECT {L2}, stop_name FROM live"), INDEX)
def _(spark, sf):
    return enrich.live_job(stage(spark, sf, "pings"), fx.network(spark, sf), SLICE).select(*L2.split(", "), "stop_name")


@query("l8_travel_time_job", sql("travel", TRAVEL_SQL + " ORDER BY n DESC, route, polyline_idx LIMIT 10"))
def _(spark, sf):
    found = cut(enrich.stops_job(stage(spark, sf, "pings"), fx.network(spark, sf), slice_seconds=SLICE), "stops")
    return rounded(profile.top_polylines(stops.polyline_travel_times(found, slice_seconds=SLICE)), TRAVEL)
