"""Live views: who is inside, where, driven by whom, how fast, due when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfleet.functions.clock import CAMPUS_TZ, DAY_START_SECONDS, data_age_label, service_day_start
from wayfleet.functions.geo import route_if_close
from wayfleet.operators.scale import lookup_join, require
from wayfleet.operators.trips import numbered


def latest_per(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last row per key by partial aggregation, ties broken by the rest of ``order``."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def active_announcements(announcements: DataFrame, now: Column) -> DataFrame:
    """Active and not expired, newest first; an announcement without expiry is not shown."""
    return (announcements.filter(F.col("active") & (F.col("expires_at") >= now))
            .orderBy(F.col("created_at").desc(), F.col("id")))


def between_day_start_and(df: DataFrame, ts: str, day_start: Column, now: Column) -> DataFrame:
    return df.filter((F.col(ts) >= day_start) & (F.col(ts) <= now))


def open_assignments(assignments: DataFrame, vehicle_ids: DataFrame) -> DataFrame:
    return assignments.filter(F.col("assignment_end").isNull()).join(
        vehicle_ids.select("vehicle_id").distinct(), "vehicle_id", "left_semi")


def only_vehicles(df: DataFrame, vehicle_ids: DataFrame) -> DataFrame:
    return df.join(vehicle_ids.select(F.col("vehicle_id").cast("string")).distinct(), "vehicle_id", "left_semi")


def vehicles_in_geofence(events: DataFrame, day_start: Column) -> DataFrame:
    """Vehicles whose latest event since ``day_start`` is an entry (any of them, if several tie)."""
    require(events, "vehicle_id", "event_type", "event_time")
    # Time and kind in one number: the largest is an entry if any event of the last instant is one.
    entry = (F.col("event_type") == "geofenceEntry").cast("long")
    last = (events.filter(F.col("event_time") >= day_start).groupBy("vehicle_id")
                  .agg(F.max(F.unix_micros("event_time") * 2 + entry).alias("_last")))
    return last.filter(F.pmod("_last", F.lit(2)) == 1).select("vehicle_id")


LOCATION = ["ping_id", "t_us", "latitude", "longitude"]
# What a reading may say besides; sources without it have none of these columns.
READING = ["heading_degrees", "speed_mph", "is_ecu_speed", "formatted_location", "address_id", "address_name"]


def reported(pings: DataFrame, columns: list[str] = READING) -> list[str]:
    return [c for c in columns if c in pings.columns]


def latest_location(pings: DataFrame, inside: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Last position of the vehicles inside, with what was reported there and the vehicles' attributes."""
    last = latest_per(pings.join(inside, "vehicle_id", "left_semi"), "vehicle_id", ["t_us", "ping_id"], LOCATION + reported(pings))
    return lookup_join(last, vehicles.withColumnRenamed("id", "vehicle_id"), ["vehicle_id"], how="inner")


def current_driver(assignments: DataFrame, drivers: DataFrame, vehicle_ids: DataFrame) -> DataFrame:
    held = open_assignments(assignments, vehicle_ids)
    names = drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name"))
    return lookup_join(held, names, ["driver_id"])


def latest_eta(etas: DataFrame, vehicle_ids: DataFrame) -> DataFrame:
    return latest_per(only_vehicles(etas, vehicle_ids), "vehicle_id", ["timestamp", "id"], ["id", "etas", "timestamp"])


def latest_velocity(predicted: DataFrame, vehicle_ids: DataFrame) -> DataFrame:
    return latest_per(only_vehicles(predicted, vehicle_ids), "vehicle_id", ["timestamp", "id"], ["speed_kmh", "timestamp"])


def latest_match(enriched: DataFrame, vehicle_ids: DataFrame) -> DataFrame:
    """Last enriched row per requested vehicle; vehicles without any stay with NULLs."""
    columns = ["t_us", "dist_to_route", "route", "polyline_idx", "segment_idx", "stop_name"]
    ids = vehicle_ids.select(F.col("vehicle_id").cast("string")).distinct()
    last = latest_per(enriched.join(ids, "vehicle_id", "left_semi"), "vehicle_id", ["t_us", "ping_id"], columns)
    return ids.join(last, "vehicle_id", "left")


def live_locations(pings: DataFrame, events: DataFrame, vehicles: DataFrame, assignments: DataFrame,
                   drivers: DataFrame, day_start: Column) -> DataFrame:
    inside = vehicles_in_geofence(events, day_start)
    at = latest_location(pings, inside, vehicles)
    driver = current_driver(assignments, drivers, inside).select("vehicle_id", "driver_id", "driver_name")
    return at.join(driver, "vehicle_id", "left")


def live_velocities(events: DataFrame, predicted: DataFrame, enriched: DataFrame, day_start: Column) -> DataFrame:
    """Predicted speed and route of every vehicle inside; the route shows only within 50 m of it."""
    inside = vehicles_in_geofence(events, day_start)
    speed = latest_velocity(predicted, inside)
    match = latest_match(enriched, inside).drop("t_us")
    return (inside.join(speed, "vehicle_id", "left").join(match, "vehicle_id", "left")
            .withColumns({"route_name": route_if_close("route", "dist_to_route"),
                          "is_at_stop": F.col("stop_name").isNotNull()})
            .withColumnRenamed("stop_name", "current_stop").drop("route", "dist_to_route"))


def combined_view(locations: DataFrame, velocities: DataFrame) -> DataFrame:
    """Locations with their velocities; a prediction needs both a speed and a time."""
    both = F.col("speed_kmh").isNotNull() & F.col("timestamp").isNotNull()
    predicted = F.when(both, F.struct("speed_kmh", "timestamp"))
    return locations.join(velocities, "vehicle_id", "left").withColumn("predicted_location", predicted).drop(
        "speed_kmh", "timestamp")


def earliest_eta_per_stop(etas: DataFrame) -> DataFrame:
    """Over all vehicles' maps, the earliest time per stop."""
    return etas.select(F.explode("etas").alias("stop_name", "at")).groupBy("stop_name").agg(F.min("at").alias("eta"))


def data_age(pings: DataFrame, now: Column) -> DataFrame:
    """Age of the oldest of the latest positions, with its label."""
    last = pings.groupBy("vehicle_id").agg(F.max("t_us").alias("_t")).agg(F.min("_t").alias("oldest_us"))
    age = (F.unix_micros(now) - F.col("oldest_us")) / F.lit(1e6)
    return last.withColumn("age_seconds", age).withColumn("label", data_age_label(F.col("age_seconds")))


def daily_tracks(pings: DataFrame, events: DataFrame, tz: str = CAMPUS_TZ, chunk_rows: int = 1000,
                 start_seconds: int = DAY_START_SECONDS) -> DataFrame:
    """Each vehicle's track per service day with its first entry and last exit.

    A day begins ``start_seconds`` after local midnight. Points have the reported speed, heading and
    address where the pings do. The track comes in numbered chunks of ``chunk_rows`` points, so one array stays small however many
    rows a vehicle has.
    """
    day = lambda ts: service_day_start(F.col(ts), tz, start_seconds)
    point = ["t_us", "ping_id", "latitude", "longitude", *reported(pings, ["speed_mph", "heading_degrees", "address_id"])]
    placed = numbered(pings.withColumn("service_day", day("timestamp")), ["vehicle_id", "service_day"])
    points = (placed.withColumn("chunk", F.floor(F.col("pos") / chunk_rows).cast("long"))
              .groupBy("vehicle_id", "service_day", "chunk")
              .agg(F.array_sort(F.collect_list(F.struct(*point))).alias("points")))
    marks = (events.withColumn("service_day", day("event_time")).groupBy("vehicle_id", "service_day")
             .agg(F.min(F.when(F.col("event_type") == "geofenceEntry", F.col("event_time"))).alias("entry"),
                  F.max(F.when(F.col("event_type") == "geofenceExit", F.col("event_time"))).alias("exit")))
    return points.join(marks, ["vehicle_id", "service_day"], "left")
