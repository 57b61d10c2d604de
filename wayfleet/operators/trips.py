"""Trips: cutting a vehicle's pings into segments, voting on routes, distance and speed.

The window operators take ``by``, the columns whose rows belong together. Without it they work on
trips, cut into blocks of consecutive rows with as many rows of context as they look at;
``wayfleet.plans.enrich`` gives them ``(vehicle_id, _slice, _trip)`` on rows with halo. Both yield the
same values as whole trips without ever sorting a whole trip or vehicle in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfleet.functions.clock import micros
from wayfleet.functions.geo import haversine_km, kmh
from wayfleet.operators.scale import (BLOCK_ROWS, SLICE_SECONDS, Hot, drop_halo, hot_groups, over_slices, prefix_sums, require,
                                      row_blocks, time_slice, with_halo_if_hot)

TRIP = ("vehicle_id", "segment_no")
ORDER = ("t_us", "ping_id")
BY_BLOCK = (*TRIP, "_block")


def in_blocks(df: DataFrame, before: int, after: int, work: Callable[[DataFrame], DataFrame], rows: int = BLOCK_ROWS) -> DataFrame:
    """``work``, which looks at so many rows before and after each, on blocks of the trips."""
    require(df, *TRIP, *ORDER)
    return drop_halo(work(row_blocks(df, TRIP, ORDER, before, after, rows))).drop("_block")


def ping_frame(pings: DataFrame) -> DataFrame:
    """Add what the time-ordered operators need: ``t_us`` and a ``ping_id`` that breaks ties."""
    require(pings, "vehicle_id", "latitude", "longitude")
    if "t_us" not in pings.columns:
        pings = pings.withColumn("t_us", micros("timestamp"))
    if "ping_id" not in pings.columns:
        pings = pings.withColumn("ping_id", F.xxhash64("vehicle_id", "t_us", "latitude", "longitude"))
    return pings


def starts_trip(by: Sequence[str], max_gap: float, dist_col: str | None = None, max_dist: float | None = None) -> Column:
    """True on the first row of a trip: after a gap, off the route, or right after an off-route row."""
    if max_dist is not None and dist_col is None:
        raise ValueError("max_dist needs dist_col")
    w = Window.partitionBy(*by).orderBy(*ORDER)
    gap = F.col("t_us") - F.lag("t_us").over(w)
    starts = gap.isNull() | (gap > int(max_gap * 1_000_000))
    if max_dist is not None:
        off = F.coalesce(F.col(dist_col) > max_dist, F.lit(False))
        starts = starts | off | F.coalesce(F.lag(off).over(w), F.lit(False))
    return starts


def number_trips(df: DataFrame, slice_col: str = "_slice", hot: Hot | None = None) -> DataFrame:
    """``segment_no`` from the ``_starts`` flags: counts 1, 2, … per vehicle."""
    return prefix_sums(df, ["vehicle_id"], slice_col, ORDER, {"segment_no": F.col("_starts").cast("long")}, hot)


def segment_trips(pings: DataFrame, max_gap: float = 15.0, dist_col: str | None = None,
                  max_dist: float | None = None, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Number each vehicle's trips (``segment_no`` within ``vehicle_id``).

    A predecessor further away than ``max_gap`` starts a trip no matter what it holds, so a slice
    only needs ``max_gap`` seconds of rows from before its start.
    """
    require(pings, "vehicle_id", *ORDER, *([dist_col] if dist_col else []))
    hot = hot_groups(pings, ["vehicle_id"])
    df = with_halo_if_hot(pings, max_gap, 0, slice_seconds, ["vehicle_id"], hot)
    df = drop_halo(df.withColumn("_starts", starts_trip(["vehicle_id", "_slice"], max_gap, dist_col, max_dist)))
    return number_trips(df, hot=hot).drop("_slice", "_starts")


def filter_short(df: DataFrame, min_len: int, by: Sequence[str] = TRIP) -> DataFrame:
    """Keep the trips with at least ``min_len`` rows (sizes are counted per slice before the shuffle)."""
    if min_len < 1:
        raise ValueError("min_len must be at least 1")
    sliced = require(df, *by, "t_us").withColumn("_slice", time_slice())
    long_enough = over_slices(sliced, by, "_slice", "_n", F.count("*"), F.sum).filter(F.col("_n") >= min_len)
    return sliced.join(long_enough, [*by, "_slice"], "left_semi").drop("_slice")


def vote_route(df: DataFrame, window: int = 5, by: Sequence[str] | None = None) -> DataFrame:
    """Fill a missing route or polyline from the rows around it.

    Of the ``window`` rows before and after within the same trip, those with a route vote with their
    (route, polyline) pair; a pair with more than half of the votes is taken over.
    """
    if by is None:
        return in_blocks(df, window, window, lambda rows: vote_route(rows, window, BY_BLOCK))
    require(df, *by, *ORDER, "route", "polyline_idx")
    pair = F.when(F.col("route").isNotNull(), F.struct("route", "polyline_idx"))
    w = Window.partitionBy(*by).orderBy(*ORDER)
    df = df.withColumn("_pair", pair)
    votes = F.concat(F.collect_list("_pair").over(w.rowsBetween(-window, -1)),
                     F.collect_list("_pair").over(w.rowsBetween(1, window)))
    df = df.withColumn("_votes", votes)
    needed = F.col("route").isNull() | F.col("polyline_idx").isNull()
    winner = F.get(F.filter(
        F.array_distinct("_votes"),
        lambda p: F.size(F.filter("_votes", lambda q: q.eqNullSafe(p))) * 2 > F.size("_votes")), F.lit(0))
    df = df.withColumn("_winner", F.when(needed, winner))
    won = F.col("_winner").isNotNull()
    return df.withColumns({
        "route": F.when(won, F.col("_winner.route")).otherwise(F.col("route")),
        "polyline_idx": F.when(won, F.col("_winner.polyline_idx")).otherwise(F.col("polyline_idx")),
    }).drop("_pair", "_votes", "_winner")


def distance_delta(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """``distance_km`` from the previous matched point of the trip; NULL on its first row."""
    if by is None:
        return in_blocks(df, 1, 0, lambda rows: distance_delta(rows, BY_BLOCK))
    require(df, *by, *ORDER, "closest_lat", "closest_lon")
    w = Window.partitionBy(*by).orderBy(*ORDER)
    return df.withColumns({"_plat": F.lag("closest_lat").over(w), "_plon": F.lag("closest_lon").over(w)}).withColumn(
        "distance_km", haversine_km("_plat", "_plon", "closest_lat", "closest_lon")).drop("_plat", "_plon")


def speed(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """``speed_kmh`` over the step from the previous row; NULL when no time passed."""
    if by is None:
        return in_blocks(df, 1, 0, lambda rows: speed(rows, BY_BLOCK))
    require(df, *by, *ORDER, "distance_km")
    w = Window.partitionBy(*by).orderBy(*ORDER)
    return (df.withColumn("_step", (F.col("t_us") - F.lag("t_us").over(w)) / F.lit(1e6))
              .withColumn("speed_kmh", kmh("distance_km", "_step")).drop("_step"))


def cumulative_distance(df: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """``trip_km``: distance covered since the start of the trip."""
    require(df, *TRIP, *ORDER, "distance_km")
    sliced = df.withColumn("_slice", time_slice(slice_seconds))
    return prefix_sums(sliced, TRIP, "_slice", ORDER, {"trip_km": F.coalesce("distance_km", F.lit(0.0))}).drop("_slice")


def numbered(df: DataFrame, by: Sequence[str], slice_seconds: int = SLICE_SECONDS, hot: Hot | None = None) -> DataFrame:
    """Rows of each group with their position ``pos`` 0, 1, 2, … in time order."""
    sliced = df.withColumn("_slice", time_slice(slice_seconds))
    return prefix_sums(sliced, by, "_slice", ORDER, {"pos": F.lit(1)}, hot).withColumn("pos", F.col("pos") - 1).drop("_slice")


def distinct_polylines(df: DataFrame) -> DataFrame:
    return df.filter(F.col("route").isNotNull()).select("route", "polyline_idx").distinct()
