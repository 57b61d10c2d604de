"""Stops: repairing missed ones, time to the next one, travel times, projected arrivals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wayfleet.operators.scale import SLICE_SECONDS, Hot, by_size, lookup_join, next_from_later, over_slices, require, time_slice
from wayfleet.operators.trips import BY_BLOCK, ORDER, TRIP, in_blocks
from wayfleet.sources.network import Network


def polyline_stop_lookup(df: DataFrame, network: Network) -> DataFrame:
    """``polyline_stop``: the stop that belongs to the row's polyline, NULL past the end of the list."""
    require(df, "route", "polyline_idx")
    dim = network.polyline_stops.select("route", "polyline_idx", F.col("stop_name").alias("polyline_stop"))
    return lookup_join(df, dim, ["route", "polyline_idx"], small=network.small)


def repair_missed_stops(df: DataFrame, network: Network, by: Sequence[str] | None = None) -> DataFrame:
    """Record the stop that was passed unseen when a vehicle moved on to the next polyline.

    If neither of the two rows is at a stop, the stop of the new polyline goes to the row that is
    closer to the route; on a tie to the later one. Distances equal to a micrometre are a tie.
    """
    if by is None:
        return in_blocks(df, 1, 1, lambda rows: repair_missed_stops(rows, network, BY_BLOCK))
    require(df, *by, *ORDER, "route", "polyline_idx", "stop_name", "dist_to_route")
    w = Window.partitionBy(*by).orderBy(*ORDER)
    prev = lambda c: F.lag(c).over(w)
    df = polyline_stop_lookup(df, network).withColumn("_km", F.round("dist_to_route", 9))
    passed = ((F.col("route") == prev("route")) & (F.col("polyline_idx") == prev("polyline_idx") + 1)
              & F.col("stop_name").isNull() & prev("stop_name").isNull()
              & F.col("dist_to_route").isNotNull() & prev("dist_to_route").isNotNull())
    df = df.withColumns({"_passed": F.coalesce(passed, F.lit(False)),
                         "_earlier": F.coalesce(prev("_km") < F.col("_km"), F.lit(False))})
    mine = F.when(F.col("_passed") & ~F.col("_earlier"), F.col("polyline_stop"))
    handed_back = F.when(F.col("_passed") & F.col("_earlier"), F.col("polyline_stop"))
    df = df.withColumn("_from_next", F.lead(handed_back).over(w))
    return df.withColumn("stop_name", F.coalesce("_from_next", mine, "stop_name")).drop(
        "polyline_stop", "_km", "_passed", "_earlier", "_from_next")


def trim_after_last_stop(df: DataFrame, by: Sequence[str] = TRIP, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Keep each trip up to and including its last stop; trips without a stop go."""
    require(df, *by, *ORDER, "stop_name")
    at = F.struct(*ORDER)
    last_stop = F.max(F.when(F.col("stop_name").isNotNull(), at))

    def whole(rows: DataFrame) -> DataFrame:
        return rows.dropna(subset=[*by, "t_us"]).withColumn("_last", last_stop.over(Window.partitionBy(*by)))

    def slices(rows: DataFrame) -> DataFrame:
        sliced = rows.withColumn("_slice", time_slice(slice_seconds))
        return sliced.join(over_slices(sliced, by, "_slice", "_last", last_stop, F.max), [*by, "_slice"]).drop("_slice")

    return by_size(df, by, whole, slices).filter(at <= F.col("_last")).drop("_last")


def eta_to_next_stop(df: DataFrame, by: Sequence[str] = TRIP, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """``eta_seconds`` to the first stop row strictly later in the trip; NULL if there is none."""
    require(df, *by, "t_us", "stop_name")
    stop_at = F.when(F.col("stop_name").isNotNull(), F.col("t_us"))
    seconds = lambda next_us: (next_us - F.col("t_us")) / F.lit(1e6)

    def whole(rows: DataFrame) -> DataFrame:
        return rows.dropna(subset=[*by, "t_us"]).withColumn("eta_seconds", seconds(F.min(stop_at).over(_after(by))))

    def slices(rows: DataFrame) -> DataFrame:
        sliced = rows.withColumn("_slice", time_slice(slice_seconds))
        beyond = next_from_later(sliced, by, "_slice", F.min(stop_at), "_beyond")
        joined = sliced.withColumn("_inside", F.min(stop_at).over(_after([*by, "_slice"]))).join(beyond, [*by, "_slice"])
        return joined.withColumn("eta_seconds", seconds(F.coalesce("_inside", "_beyond"))).drop("_slice", "_inside", "_beyond")

    return by_size(df, by, whole, slices)


def _after(by: Sequence[str]) -> WindowSpec:
    """The rows strictly later than each."""
    return Window.partitionBy(*by).orderBy(F.col("t_us").desc()).rangeBetween(Window.unboundedPreceding, -1)


def trim_and_eta(df: DataFrame, by: Sequence[str] = TRIP, slice_seconds: int = SLICE_SECONDS, hot: Hot | None = None) -> DataFrame:
    """``eta_to_next_stop`` of ``trim_after_last_stop``, a hot trip's from one summary per slice and one join.

    What is trimmed comes after the last stop, so the next stops are the same before and after. ``hot`` names the
    hot trips where they are known; without it they are counted.
    """
    require(df, *by, *ORDER, "stop_name")
    at, stop = F.struct(*ORDER), F.col("stop_name").isNotNull()

    def whole(rows: DataFrame) -> DataFrame:
        trip = Window.partitionBy(*by)
        next_us = F.min(F.when(stop, F.col("t_us"))).over(_after(by))
        timed = rows.dropna(subset=[*by, "t_us"]).withColumns({
            "_last": F.max(F.when(stop, at)).over(trip), "eta_seconds": (next_us - F.col("t_us")) / F.lit(1e6)})
        return timed.filter(at <= F.col("_last")).drop("_last")

    return by_size(df, by, whole, lambda rows: _trim_slices(rows, by, slice_seconds), hot)


def _trim_slices(df: DataFrame, by: Sequence[str], slice_seconds: int) -> DataFrame:
    at, sliced = F.struct(*ORDER), df.withColumn("_slice", time_slice(slice_seconds))
    stop = F.col("stop_name").isNotNull()
    per_slice = sliced.groupBy(*by, "_slice").agg(F.max(F.when(stop, at)).alias("_stop"), F.min(F.when(stop, F.col("t_us"))).alias("_stop_us"))
    trip = Window.partitionBy(*by)
    later = trip.orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    summary = per_slice.select(*by, "_slice", F.max("_stop").over(trip).alias("_last"),
                               F.last("_stop_us", ignorenulls=True).over(later).alias("_beyond")).filter("_last IS NOT NULL")
    kept = sliced.join(summary, [*by, "_slice"]).filter(at <= F.col("_last"))
    next_us = F.coalesce(F.min(F.when(stop, F.col("t_us"))).over(_after([*by, "_slice"])), F.col("_beyond"))
    return kept.withColumn("eta_seconds", (next_us - F.col("t_us")) / F.lit(1e6)).drop("_slice", "_last", "_beyond")


def stop_pairs(df: DataFrame, by: Sequence[str] = TRIP, slice_seconds: int = SLICE_SECONDS,
               distinct_stops: bool = False) -> DataFrame:
    """Each at-stop row with the seconds to the next at-stop row of its trip (positive ones only)."""
    require(df, *by, *ORDER, "stop_name", "route", "polyline_idx")
    at_stop = df.filter(F.col("stop_name").isNotNull()).withColumn("_slice", time_slice(slice_seconds))
    here = F.struct("t_us", "stop_name")
    inside = Window.partitionBy(*by, "_slice").orderBy(*ORDER)
    beyond = next_from_later(at_stop, by, "_slice", F.min_by(here, F.struct(*ORDER)), "_beyond")
    pairs = at_stop.withColumn("_inside", F.lead(here).over(inside)).join(beyond, [*by, "_slice"])
    pairs = pairs.withColumn("_next", F.coalesce("_inside", "_beyond")).withColumns({
        "end_stop": F.col("_next.stop_name"),
        "travel_seconds": (F.col("_next.t_us") - F.col("t_us")) / F.lit(1e6)})
    if distinct_stops:
        pairs = pairs.filter(F.col("end_stop") != F.col("stop_name"))
    return pairs.filter(F.col("travel_seconds") > 0).drop("_slice", "_inside", "_beyond", "_next")


def polyline_travel_times(df: DataFrame, by: Sequence[str] = TRIP, slice_seconds: int = SLICE_SECONDS,
                          distinct_stops: bool = False) -> DataFrame:
    """Travel time statistics per (route, polyline) of the pair's first row.

    Repeated pings at one stop count as pairs; ``distinct_stops`` leaves them out.
    """
    pairs = stop_pairs(df, by, slice_seconds, distinct_stops)
    s = "travel_seconds"
    return (pairs.filter(F.col("route").isNotNull() & F.col("polyline_idx").isNotNull())
            .groupBy("route", "polyline_idx")
            .agg(F.avg(s).alias("avg_travel_time_seconds"),
                 F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("std_travel_time_seconds"),
                 F.count(s).alias("sample_count"), F.min(s).alias("min_time"), F.max(s).alias("max_time")))


def trips_with_stops(df: DataFrame, at_least: int = 2, by: Sequence[str] = TRIP) -> DataFrame:
    return (df.groupBy(*by).agg(F.count("stop_name").alias("n_stop_rows"))
              .filter(F.col("n_stop_rows") >= at_least))


def last_visit_per_stop(df: DataFrame) -> DataFrame:
    """When each vehicle was last at each stop."""
    require(df, "vehicle_id", "stop_name", "t_us")
    return (df.filter(F.col("stop_name").isNotNull()).groupBy("vehicle_id", "stop_name")
              .agg(F.max("t_us").alias("last_t_us")))


def project_stop_times(latest: DataFrame, visits: DataFrame, next_etas: DataFrame, travel_times: DataFrame,
                       network: Network) -> DataFrame:
    """All stop times of a vehicle's route: visited, next (given) and later ones.

    ``latest(vehicle_id, route, polyline_idx, stop_name)`` is the last row per vehicle and
    ``next_etas(vehicle_id, eta_us)`` the predicted arrival at the stop it heads for. Stops before it
    carry the last visit if there was one; stops after it add average travel times leg by leg and end
    at the first leg without one. A vehicle standing at the stop with its polyline's number counts as
    one polyline further. Vehicles at the end of their route, or without a prediction, are left out.
    """
    stops = network.stops.select("route", F.col("stop_ord").alias("_ord"), F.col("stop_name").alias("_stop"))
    legs = (travel_times.select("route", F.col("polyline_idx").alias("_leg"), F.col("avg_travel_time_seconds").alias("_avg"))
            .withColumn("_ord", F.col("_leg") + 1).drop("_leg"))
    line = (stops.join(legs, ["route", "_ord"], "left").groupBy("route")
            .agg(F.array_sort(F.collect_list(F.struct("_ord", "_stop", "_avg"))).alias("_line")))
    here = latest.filter(F.col("route").isNotNull() & F.col("polyline_idx").isNotNull()).join(next_etas, "vehicle_id")
    here = lookup_join(here, line, ["route"], how="inner", small=network.small)
    standing = F.get(F.filter("_line", lambda s: s["_stop"] == F.col("stop_name")), F.lit(0))["_ord"]
    here = here.withColumn("_target", F.col("polyline_idx") + 1
                           + F.when(standing == F.col("polyline_idx"), 1).otherwise(0))
    here = here.filter(F.col("_target") < F.size("_line"))
    rows = here.select("vehicle_id", "route", "eta_us", "_target", "_line", F.explode("_line").alias("_s"))
    ahead = F.filter("_line", lambda s: (s["_ord"] > F.col("_target")) & (s["_ord"] <= F.col("_s._ord")))
    rows = rows.withColumn("_ahead", F.transform(ahead, lambda s: s["_avg"]))
    whole = ~F.exists("_ahead", lambda a: a.isNull())
    extra = F.aggregate("_ahead", F.lit(0.0), lambda acc, a: acc + a)
    rows = rows.select("vehicle_id", "route", F.col("_s._ord").alias("stop_ord"), F.col("_s._stop").alias("stop_name"),
                       F.when(F.col("_s._ord") < F.col("_target"), "visited")
                        .when(F.col("_s._ord") == F.col("_target"), "next").otherwise("later").alias("kind"),
                       "eta_us", whole.alias("_whole"), extra.alias("_extra"))
    rows = rows.join(visits.select("vehicle_id", "stop_name", "last_t_us"), ["vehicle_id", "stop_name"], "left")
    time = (F.when(F.col("kind") == "visited", F.col("last_t_us"))
             .when(F.col("_whole"), F.col("eta_us") + F.round(F.col("_extra") * 1e6).cast("long")))
    return rows.select("vehicle_id", "route", "stop_ord", "stop_name", "kind", time.alias("stop_us")).filter(
        F.col("stop_us").isNotNull())
