"""Profiles of the enriched data."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import fixture as fx
from queries.enrichment import rounded
from queries.oracle import sql
from queries.registry import ORACLES, SLICE, query, stage
from wayfleet.operators import accounting, profile

SPREAD = ["mean", "std", "min", "max", "p25", "p50", "p75"]


def spread_sql(c, src, places):
    q = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    return (f"SELECT count({c}) AS n, " + ", ".join(
        f"round({f}, {places}) AS {n}" for n, f in
        [("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("min", f"min({c})"), ("max", f"max({c})"),
         *[(n, f"quantile_cont({c}, {p})") for n, p in q.items()]]) + f" FROM {src}")


@query("g5_dataset_summary", sql("l1", """
SELECT count(*) AS n_rows, min(t_us) AS first_us, max(t_us) AS last_us, count(DISTINCT vehicle_id) AS n_vehicles, count(DISTINCT route) AS n_routes,
       round(count(*) FILTER (route IS NULL) / count(*) * 100, 6) AS unmatched_percent FROM l1"""))
def _(spark, sf):
    return rounded(profile.dataset_summary(stage(spark, sf, "l1")), ["unmatched_percent"])


@query("g5_speed_spread", sql("l2", spread_sql("speed_kmh", "l2", 4)))
def _(spark, sf):
    return rounded(profile.describe(stage(spark, sf, "l2"), "speed_kmh"), SPREAD, 4)


@query("g6_trip_size_spread", sql("l2", spread_sql("n_rows", "(SELECT vehicle_id, segment_no, count(*) AS n_rows FROM l2 GROUP BY vehicle_id, segment_no) s", 6)))
def _(spark, sf):
    d = profile.describe(profile.trip_sizes(stage(spark, sf, "l2")), "n_rows")
    return rounded(d.withColumns({c: F.col(c).cast("double") for c in ("min", "max")}), SPREAD)


@query("g6_trip_size_shares", sql("l2", """
SELECT count(*) AS n_trips, """ + ", ".join(f"count(*) FILTER (n_rows >= {k}) AS at_least_{k}, round(count(*) FILTER (n_rows >= {k}) / count(*) * 100, 6) AS percent_{k}" for k in (10, 20, 50))
    + " FROM (SELECT vehicle_id, segment_no, count(*) AS n_rows FROM l2 GROUP BY vehicle_id, segment_no) s"))
def _(spark, sf):
    return rounded(profile.size_shares(profile.trip_sizes(stage(spark, sf, "l2"))), ["percent_10", "percent_20", "percent_50"])


@query("g8_stop_visits", sql("l3", "SELECT stop_name, count(*) AS n_visits FROM l3 WHERE stop_name IS NOT NULL GROUP BY stop_name"))
def _(spark, sf):
    return profile.stop_visits(stage(spark, sf, "l3"))


@query("g8_at_stop_share", sql("l3", "SELECT count(*) AS n_rows, count(stop_name) AS at_stop, round(count(stop_name) / count(*) * 100, 6) AS at_stop_percent FROM l3"))
def _(spark, sf):
    return rounded(profile.at_stop_share(stage(spark, sf, "l3")), ["at_stop_percent"])


@query("g9_eta_distribution", sql("l4", "SELECT s.*, round(m / 60, 4) AS mean_min, round(p / 60, 4) AS p50_min, round(x / 60, 4) AS max_min, round(z, 4) AS null_percent FROM ("
    + spread_sql("eta_seconds", "l4", 4) + """) s, (SELECT avg(eta_seconds) AS m, quantile_cont(eta_seconds, 0.5) AS p, max(eta_seconds) AS x,
    count(*) FILTER (eta_seconds IS NULL) / count(*) * 100 AS z FROM l4) t"""))
def _(spark, sf):
    return rounded(profile.eta_distribution(stage(spark, sf, "l4")), [*SPREAD, "mean_min", "p50_min", "max_min", "null_percent"], 4)


@query("g10_stage_accounting", sql("l3 l4", """
SELECT *, rows_before - rows_after AS rows_removed, trips_before - trips_after AS trips_removed, round(rows_after / rows_before * 100, 6) AS rows_kept_percent,
       round(trips_after / trips_before * 100, 6) AS trips_kept_percent
FROM (SELECT count(*) AS rows_before, count(DISTINCT (vehicle_id, segment_no)) AS trips_before FROM l3) a, (SELECT count(*) AS rows_after, count(DISTINCT (vehicle_id, segment_no)) AS trips_after FROM l4) b"""))
def _(spark, sf):
    return rounded(profile.stage_accounting(stage(spark, sf, "l3"), stage(spark, sf, "l4")), ["rows_kept_percent", "trips_kept_percent"])


@query("g10_observed_accounting", ORACLES["g10_stage_accounting"])
def _(spark, sf):
    """The same figures, counted while the rows are trimmed."""
    counts = accounting.StageCounts()
    accounting.trim_and_count(stage(spark, sf, "l3"), counts, slice_seconds=SLICE).write.format("noop").mode("overwrite").save()
    return rounded(counts.between(spark, "stops", "trimmed"), ["rows_kept_percent", "trips_kept_percent"])


@query("g11_polyline_profile", sql("l2", """
SELECT route, polyline_idx, count(*) AS n_rows, count(DISTINCT vehicle_id) AS n_vehicles, round(avg(speed_kmh), 4) AS mean_kmh, round(stddev_samp(speed_kmh), 4) AS std_kmh
FROM l2 WHERE route IS NOT NULL AND polyline_idx IS NOT NULL GROUP BY route, polyline_idx"""))
def _(spark, sf):
    return rounded(profile.polyline_profile(stage(spark, sf, "l2")), ["mean_kmh", "std_kmh"], 4)


FEATURES = ["latitude", "longitude", "speed_kmh", "dist_to_end", "eta_seconds"]


@query("g12_correlations", sql("l4", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS corr FROM l4" for i, a in enumerate(FEATURES) for b in FEATURES[i:])))
def _(spark, sf):
    return rounded(profile.correlations(stage(spark, sf, "l4"), FEATURES), ["corr"])


@query("g13_speed_histogram", sql("l2", """
SELECT CAST(least(20, floor(speed_kmh / 6) + 1) AS INT) AS bin, count(*) AS n, round((least(20, floor(speed_kmh / 6) + 1) - 1) * 6, 6) AS bin_low
FROM l2 WHERE speed_kmh BETWEEN 0 AND 120 GROUP BY 1, 3"""))
def _(spark, sf):
    return rounded(profile.histogram(stage(spark, sf, "l2"), "speed_kmh", 0.0, 120.0, 20), ["bin_low"])


@query("g13_trip_size_cdf", sql("l2", """
SELECT n_rows, n, sum(n) OVER (ORDER BY n_rows)::BIGINT AS upto, round(sum(n) OVER (ORDER BY n_rows) / sum(n) OVER (), 6) AS share
FROM (SELECT n_rows, count(*) AS n FROM (SELECT count(*) AS n_rows FROM l2 GROUP BY vehicle_id, segment_no) a GROUP BY n_rows) b"""))
def _(spark, sf):
    return rounded(profile.size_cdf(profile.trip_sizes(stage(spark, sf, "l2")), bucket=4), ["share"])


@query("g14_row_counts_today", sql("geofence_events", """
SELECT 'pings' AS what, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20 05:00:00'
UNION ALL SELECT 'events', count(*) FROM geofence_events WHERE event_time >= TIMESTAMP '2024-01-20 05:00:00'"""))
def _(spark, sf):
    return profile.row_counts_since(fx.events(spark, sf).withColumnRenamed("ts", "timestamp"), fx.geofence_events(spark, sf),
                                    F.lit("2024-01-20 05:00:00").cast("timestamp"))


@query("p5_speed_outliers", sql("l2", """
SELECT vehicle_id, ping_id, round(speed_kmh, 4) AS speed_kmh FROM l2 WHERE speed_kmh > 120 ORDER BY round(l2.speed_kmh, 6) DESC, t_us, ping_id LIMIT 10"""))
def _(spark, sf):
    return rounded(profile.speed_outliers(stage(spark, sf, "l2")).select("vehicle_id", "ping_id", "speed_kmh"), ["speed_kmh"], 4)


SIZES = "SELECT vehicle_id, segment_no, count(*) AS n_rows FROM l2 GROUP BY vehicle_id, segment_no"


@query("t1_largest_trips", sql("l2", SIZES + " ORDER BY count(*) DESC, vehicle_id, segment_no LIMIT 7"))
def _(spark, sf):
    return profile.largest_trips(stage(spark, sf, "l2"), 7)


@query("t2_rows_of_largest_trip", sql("l2", f"""
SELECT l.vehicle_id, l.ping_id, l.segment_no FROM l2 l JOIN ({SIZES} ORDER BY count(*) DESC, vehicle_id, segment_no LIMIT 1) t
ON t.vehicle_id = l.vehicle_id AND t.segment_no = l.segment_no"""))
def _(spark, sf):
    return profile.rows_of_largest_trip(stage(spark, sf, "l2")).select("vehicle_id", "ping_id", "segment_no")


@query("t4_first_trips", sql("l2", """
SELECT l.ping_id FROM l2 l JOIN (SELECT DISTINCT vehicle_id, segment_no FROM l2 ORDER BY vehicle_id, segment_no LIMIT 20) t
ON t.vehicle_id = l.vehicle_id AND t.segment_no = l.segment_no"""))
def _(spark, sf):
    return profile.first_trips(stage(spark, sf, "l2"), 20).select("ping_id")


@query("t6_rows_of_slowest_arrival", sql("l4", """
SELECT l.vehicle_id, l.segment_no, l.ping_id, round(l.eta_seconds, 6) AS eta_seconds FROM l4 l JOIN (
  SELECT vehicle_id, segment_no FROM l4 WHERE eta_seconds IS NOT NULL GROUP BY vehicle_id, segment_no ORDER BY max(eta_seconds) DESC, vehicle_id, segment_no LIMIT 1) t
ON t.vehicle_id = l.vehicle_id AND t.segment_no = l.segment_no"""))
def _(spark, sf):
    return rounded(profile.rows_of_slowest_arrival(stage(spark, sf, "l4")).select("vehicle_id", "segment_no", "ping_id", "eta_seconds"), ["eta_seconds"])


@query("t6_fastest_row", sql("l2", """
SELECT vehicle_id, ping_id, round(speed_kmh, 4) AS speed_kmh FROM l2 WHERE speed_kmh IS NOT NULL ORDER BY round(l2.speed_kmh, 6) DESC, t_us, ping_id LIMIT 1"""))
def _(spark, sf):
    return rounded(profile.fastest_row(stage(spark, sf, "l2")).select("vehicle_id", "ping_id", "speed_kmh"), ["speed_kmh"], 4)


FASTEST = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, segment_no ORDER BY round(speed_kmh, 6) DESC, t_us, ping_id) AS rk FROM l2 WHERE speed_kmh IS NOT NULL) f WHERE rk = 1"""


@query("w18_around_fastest_seconds", sql("l2", """
SELECT l.ping_id, round((l.t_us - f.t_us) / 1e6, 6) AS offset_s FROM l2 l JOIN fastest f ON f.vehicle_id = l.vehicle_id AND f.segment_no = l.segment_no
WHERE abs(l.t_us - f.t_us) <= 10000000""", fastest=FASTEST))
def _(spark, sf):
    return rounded(profile.around_fastest(stage(spark, sf, "l2"), 10.0).select("ping_id", "offset_s"), ["offset_s"])


@query("w18_around_fastest_rows", sql("l2", """
SELECT l.ping_id, l.rn - f.rn AS row_offset FROM ranked l JOIN (SELECT r.* FROM ranked r JOIN fastest x ON x.ping_id = r.ping_id) f
ON f.vehicle_id = l.vehicle_id AND f.segment_no = l.segment_no WHERE abs(l.rn - f.rn) <= 5""",
    ranked="SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY vehicle_id, segment_no ORDER BY t_us, ping_id) AS rn FROM l2", fastest=FASTEST))
def _(spark, sf):
    return profile.rows_around_fastest(stage(spark, sf, "l2")).select("ping_id", "row_offset")
