"""Schedule: departures per weekday, current loop, visits against the timetable, bus assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfleet.functions.clock import CAMPUS_TZ, DAY_START_SECONDS, clock_text, day_name, departure_order, service_day_start
from wayfleet.operators.matching import AT_STOP_KM, match_stop
from wayfleet.operators.scale import SALTS, lookup_join, require
from wayfleet.sources.feeds import pings_window
from wayfleet.sources.network import Network

MINUTES, MINUTE_US = 24 * 60, 60_000_000


def aggregate_schedule(departures: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per weekday and route the sorted departures, 12:00 AM last.

    Departures of the same minute are counted before they are listed, so a list has at most one entry
    per minute of the day: ``times`` holds (sort key, text, how often).
    """
    per_minute = (lookup_join(departures.groupBy("service", "route", "minute").agg(F.count("*").alias("n")),
                              calendar.select("service", "dow"), ["service"], how="inner")
                  .groupBy("dow", "route", "minute").agg(F.sum("n").alias("n")))
    entry = F.struct(departure_order(F.col("minute")).alias("order"), clock_text(F.col("minute")).alias("time"),
                     F.col("minute").alias("minute"), F.col("n").alias("n"))
    return per_minute.groupBy("dow", "route").agg(F.array_sort(F.collect_list(entry)).alias("times"))


def loops_by_minute(aggregated: DataFrame) -> DataFrame:
    """Per weekday and route ``_loops``, an entry per minute of the day: place and minute of the most recent departure then.

    The list is gone through in its order up to the first later departure; from the last minute of the day back,
    that is the least place seen so far.
    """
    key = ["dow", "route"]
    places = aggregated.select(*key, F.posexplode("times").alias("_at", "_t")).select(*key, (F.col("_t.minute") - 1).cast("int").alias("_m"), F.col("_at"))
    grid = aggregated.select(*key, F.explode(F.sequence(F.lit(0), F.lit(MINUTES - 1))).alias("_m"), F.lit(None).cast("int").alias("_at"))
    back = Window.partitionBy(*key).orderBy(F.col("_m").desc())
    later = (places.unionByName(grid).groupBy(*key, "_m").agg(F.min("_at").alias("_at"))
             .withColumn("_later", F.min("_at").over(back)).filter(F.col("_m").between(0, MINUTES - 1)))
    later = later.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_m", "_later"))).alias("_later"))
    place = F.transform("_later", lambda e: F.coalesce(e["_later"], F.size("times")) - 1)
    return aggregated.join(later, key).withColumn("_place", place).select(*key, F.expr(
        "transform(_place, p -> struct(p AS loop_idx, CASE WHEN p >= 0 THEN get(times, p).minute END AS departure_minute))").alias("_loops"))


def current_loop(nows: DataFrame, aggregated: DataFrame, now: str = "now", tz: str = CAMPUS_TZ) -> DataFrame:
    """The most recent departure of a route at each ``now``, looked up by its minute of the day."""
    require(nows, now, "route")
    local = F.from_utc_timestamp(F.col(now), tz)
    df = nows.withColumns({"dow": (F.dayofweek(local) - 1).cast("int"),
                           "_minute": F.hour(local) * 60 + F.minute(local)})
    df = lookup_join(df, loops_by_minute(aggregated), ["dow", "route"]).withColumn("_loop", F.get("_loops", F.col("_minute")))
    return df.withColumns({c: F.col(f"_loop.{c}") for c in ("loop_idx", "departure_minute")}).drop("_loops", "_loop", "_minute")


def scheduled_stop_times(loops: DataFrame, stops: DataFrame, now: str = "now", tz: str = CAMPUS_TZ) -> DataFrame:
    """Per stop of the route: the current loop's departure plus the stop's offset, as an instant."""
    runs = loops.filter(F.col("departure_minute").isNotNull())
    lists = stops.groupBy("route").agg(
        F.array_sort(F.collect_list(F.struct("stop_ord", "stop_name", "offset_min"))).alias("_stops"))
    # The departure is found once per row, before the stops are laid out.
    departs = F.unix_micros(F.date_trunc("day", F.from_utc_timestamp(F.col(now), tz))) + F.col("departure_minute") * F.lit(MINUTE_US).cast("long")
    df = lookup_join(runs.withColumn("_departs", departs), lists, ["route"], how="inner").withColumn("_s", F.explode("_stops"))
    at = F.to_utc_timestamp(F.timestamp_micros(F.col("_departs") + F.col("_s.offset_min") * F.lit(MINUTE_US).cast("long")), tz)
    return df.withColumns({"stop_ord": F.col("_s.stop_ord"), "stop_name": F.col("_s.stop_name"),
                           "stop_time": at}).drop("_s", "_stops", "_departs")


def label_stop_visits(pings: DataFrame, network: Network, day_start: Column, threshold: float = AT_STOP_KM) -> DataFrame:
    """The day's pings at a stop: (vehicle_id, timestamp, route_name, stop_name)."""
    seen = match_stop(pings_window(pings, day_start), network, threshold)
    return seen.filter(F.col("stop_name").isNotNull()).select(
        "vehicle_id", "timestamp", F.col("stop_route").alias("route_name"), "stop_name")


def schedule_overlap(visits: DataFrame, departures: DataFrame, calendar: DataFrame, tz: str = CAMPUS_TZ,
                     start_seconds: int = DAY_START_SECONDS) -> DataFrame:
    """How well each vehicle's visits of a day fit each bus: ``cost = 1 - matches / slots``.

    Only pairs with at least one match are rows; every other pair costs 1. Matches are distinct
    (route, minute) pairs found on both sides, slots are all departures of the bus.
    """
    local = F.from_utc_timestamp(F.col("timestamp"), tz)
    pairs = visits.select(
        "vehicle_id", F.to_date(F.from_utc_timestamp(service_day_start("timestamp", tz, start_seconds), tz)).alias("service_day"),
        day_name(local).alias("day"), F.col("route_name").alias("route"),
        (F.hour(local) * 60 + F.minute(local)).alias("minute")).distinct()
    pairs = lookup_join(pairs, calendar.select("day", "service"), ["day"], how="inner")
    slots = departures.groupBy("service", "bus").agg(F.count("*").alias("n_slots"))
    offered = departures.select("service", "bus", "route", "minute").distinct().join(slots, ["service", "bus"])
    found = pairs.join(offered, ["service", "route", "minute"])
    return (found.groupBy("service_day", "vehicle_id", "bus")
            .agg(F.count("*").alias("n_matches"), F.max("n_slots").alias("n_slots"))
            .withColumn("cost", 1 - F.col("n_matches") / F.col("n_slots")))


def _cheapest_pairs(cost: np.ndarray) -> np.ndarray:
    """Column chosen for every row of a cost matrix with at least as many columns as rows.

    Shortest augmenting paths with row and column prices.
    """
    rows, cols = cost.shape
    row_price, col_price = np.zeros(rows + 1), np.zeros(cols + 1)
    owner = np.zeros(cols + 1, dtype=int)
    for r in range(1, rows + 1):
        owner[0], at = r, 0
        best, came, done = np.full(cols + 1, np.inf), np.zeros(cols + 1, dtype=int), np.zeros(cols + 1, dtype=bool)
        while owner[at] != 0:
            done[at] = True
            slack = cost[owner[at] - 1] - row_price[owner[at]] - col_price[1:]
            better = ~done[1:] & (slack < best[1:])
            best[1:][better] = slack[better]
            came[1:][better] = at
            nxt = 1 + int(np.argmin(np.where(done[1:], np.inf, best[1:])))
            step = best[nxt]
            row_price[owner[done]] += step
            col_price[done] -= step
            best[~done] -= step
            at = nxt
        while at:
            owner[at] = owner[came[at]]
            at = came[at]
    chosen = np.full(rows, -1)
    for c in range(1, cols + 1):
        if owner[c]:
            chosen[owner[c] - 1] = c - 1
    return chosen


def _assign_day(day: pd.DataFrame) -> pd.DataFrame:
    buses, vehicles = sorted(day["bus"].unique()), sorted(day["vehicle_id"].unique())
    cost = np.ones((len(buses), len(vehicles) + len(buses)))
    b, v = day["bus"].map(buses.index), day["vehicle_id"].map(vehicles.index)
    cost[b.to_numpy(), v.to_numpy()] = day["cost"].to_numpy()
    chosen = _cheapest_pairs(cost)
    keep = [(i, c) for i, c in enumerate(chosen) if c < len(vehicles) and cost[i, c] < 1]
    return pd.DataFrame({"service_day": day["service_day"].iloc[0], "bus": [buses[i] for i, _ in keep],
                         "vehicle_id": [vehicles[c] for _, c in keep], "cost": [float(cost[i, c]) for i, c in keep]})


def assign_buses(costs: DataFrame) -> DataFrame:
    """Cheapest one-to-one assignment of vehicles to buses per service day.

    A bus never needs more candidates than there are buses that day, since the others can take at
    most that many minus one. Keeping its cheapest so many is exact and bounds a day's matrix by the
    square of the timetable, however large the fleet. Buses and vehicles without any match (all
    their pairs cost 1) stay unassigned.
    """
    per_day = costs.groupBy("service_day").agg(F.count_distinct("bus").alias("_buses"))
    near = lookup_join(costs, per_day, ["service_day"], how="inner")
    near = near.withColumn("_part", F.pmod(F.xxhash64("vehicle_id"), F.lit(SALTS)))
    for key in (["service_day", "bus", "_part"], ["service_day", "bus"]):
        rank = Window.partitionBy(*key).orderBy("cost", "vehicle_id")
        near = near.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= F.col("_buses"))
    return near.select("service_day", "bus", "vehicle_id", "cost").groupBy("service_day").applyInPandas(
        _assign_day, "service_day date, bus string, vehicle_id string, cost double")


def common_pairs(visits: DataFrame, departures: DataFrame) -> DataFrame:
    """(route, minute) pairs present on both sides."""
    return visits.select("route", "minute").intersect(departures.select("route", "minute"))


def distinct_stops_for_day(stops: DataFrame, aggregated: DataFrame, dow: int) -> DataFrame:
    """Stops of the routes running that day; of those at one place (6 decimals) the first route's stays."""
    running = aggregated.filter(F.col("dow") == dow).select("route").distinct()
    here = stops.join(running, "route", "left_semi")
    place = [F.round("lat", 6).alias("_lat"), F.round("lon", 6).alias("_lon")]
    first = here.groupBy(*place).agg(F.min_by(F.struct("route", "stop_ord", "stop_name", "lat", "lon"),
                                              F.struct("route", "stop_ord")).alias("_s"))
    return first.select("_s.*")
