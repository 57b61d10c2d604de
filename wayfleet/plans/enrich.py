"""The enrichment jobs: match, cut into trips, find stops, time to the next stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfleet.functions.clock import EPOCH_2025_US
from wayfleet.operators import matching, stops, trips
from wayfleet.operators.scale import SLICE_SECONDS, Hot, cut, drop_halo, hot_groups, with_halo, with_halo_if_hot
from wayfleet.sources.network import Network

# The results depend on these defaults.
TRIP_GAP_SECONDS = 15.0
TRIP_DIST_KM = 0.020
STOPS_GAP_SECONDS = 30.0
STOPS_DIST_KM = 0.005
MIN_TRIP_ROWS = 3
VOTE_WINDOW = 5
LIVE_MIN_TRIP_ROWS = 1

BY_SLICE = ("vehicle_id", "_slice")
BY_TRIP = ("vehicle_id", "_slice", "_trip")


def preprocess(pings: DataFrame, network: Network, threshold: float = matching.AMBIGUOUS_KM) -> DataFrame:
    df = trips.ping_frame(pings)
    df = df.withColumn("epoch_seconds", (F.col("t_us") - F.lit(EPOCH_2025_US)) / F.lit(1e6))
    return matching.match_route(df, network, threshold)


def segment(matched: DataFrame, network: Network, max_gap: float = TRIP_GAP_SECONDS, max_dist: float = TRIP_DIST_KM,
            min_len: int = MIN_TRIP_ROWS, window: int = VOTE_WINDOW, slice_seconds: int = SLICE_SECONDS,
            hot: Hot | None = None) -> DataFrame:
    """Trips, voted routes, refined matches, distance and speed; short trips dropped.

    Rows of a trip are at most ``max_gap`` apart, so ``n`` rows of context lie within ``n * max_gap``
    seconds. One shuffle on (vehicle, slice), hot vehicles with that much halo, serves the boundary flags, the
    vote, the refinement, the steps and the length filter; a hot vehicle's trip numbers then take one row per slice.
    """
    reach = max(window, min_len)
    hot = hot or hot_groups(matched, ["vehicle_id"])
    starts = trips.starts_trip(BY_SLICE, max_gap, "dist_to_route", max_dist)
    df = with_halo_if_hot(matched.filter("vehicle_id IS NOT NULL"), (reach + 2) * max_gap, (reach + 1) * max_gap, slice_seconds,
                          ["vehicle_id"], hot).withColumn("_starts", starts)
    upto = Window.partitionBy(*BY_SLICE).orderBy(*trips.ORDER).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_trip": F.sum(F.col("_starts").cast("long")).over(upto),
                         "_own": F.sum((F.col("_starts") & F.col("_home")).cast("long")).over(upto)})
    df = trips.vote_route(df, window, BY_TRIP)
    df = matching.match_target_polyline(df, network)
    df = trips.speed(trips.distance_delta(df, BY_TRIP), BY_TRIP)
    df = df.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*BY_TRIP)))
    df, own = drop_halo(df).filter(F.col("_rows") >= min_len), F.col("_own")
    if hot.keys is not None:
        lean = hot.join(matched.select("vehicle_id", *trips.ORDER, "dist_to_route"), ["vehicle_id"], "left_semi")
        per_slice = (drop_halo(with_halo(lean, max_gap, 0, slice_seconds).withColumn("_starts", starts)).groupBy(*BY_SLICE)
                     .agg(F.sum(F.col("_starts").cast("long")).alias("_n")))
        earlier = Window.partitionBy("vehicle_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        before = per_slice.select(*BY_SLICE, F.sum("_n").over(earlier).alias("_before"))
        df, own = df.join(before, list(BY_SLICE), "left"), F.coalesce("_before", F.lit(0)) + own
    return df.withColumn("segment_no", own).drop("_slice", "_starts", "_trip", "_own", "_rows", "_before")


def find_stops(trips_df: DataFrame, network: Network, max_gap: float = STOPS_GAP_SECONDS,
               threshold: float = matching.AT_STOP_KM, slice_seconds: int = SLICE_SECONDS,
               rematch: bool = False, hot: Hot | None = None) -> DataFrame:
    """Stop names, progress along the polyline, missed stops repaired.

    A row that ``segment`` left without a polyline was ambiguous when it was matched, so matching it
    again cannot place it; ``rematch`` is for rows whose match was lost on some other way. ``hot`` may name
    the hot vehicles of a table that holds these rows.
    """
    hot = hot or hot_groups(trips_df, ["vehicle_id"])
    return _visits(matching.match_stop(trips_df, network, threshold), network, max_gap, slice_seconds, rematch, hot)


def _visits(df: DataFrame, network: Network, max_gap: float, slice_seconds: int, rematch: bool, hot: Hot) -> DataFrame:
    df = with_halo_if_hot(df, max_gap, max_gap, slice_seconds, ["vehicle_id"], hot)
    df = drop_halo(stops.repair_missed_stops(df, network, (*BY_SLICE, "segment_no"))).drop("_slice")
    return matching.polyline_progress(df, network, rematch)     # of single rows: it need not be shuffled


def segment_and_stops(matched: DataFrame, network: Network, hot: Hot, stops_gap: float = STOPS_GAP_SECONDS,
                      threshold: float = matching.AT_STOP_KM, slice_seconds: int = SLICE_SECONDS, **options) -> DataFrame:
    """``find_stops`` of ``segment`` in one job, whose only shuffle of the rows is that on the vehicle unless it is hot.

    A position's stop does not depend on its trip, so stops are looked up in the stored ``matched``, unless it has them, and
    not in the trips, which would have to be cut once more to see whether any position lies far away.
    """
    placed = matched if "stop_name" in matched.columns else matching.match_stop(matched, network, threshold)
    trips_df = segment(placed, network, slice_seconds=slice_seconds, hot=hot, **options)
    return _visits(trips_df, network, stops_gap, slice_seconds, False, hot)


def add_eta(stops_df: DataFrame, slice_seconds: int = SLICE_SECONDS, hot: Hot | None = None) -> DataFrame:
    return stops.trim_and_eta(stops_df, slice_seconds=slice_seconds, hot=hot)


def with_eta(matched: DataFrame, network: Network, hot: Hot, slice_seconds: int = SLICE_SECONDS, **options) -> DataFrame:
    """``add_eta`` of ``segment_and_stops``, in the same job where no vehicle, and so no trip, is hot."""
    found = segment_and_stops(matched, network, hot, slice_seconds=slice_seconds, **options)
    return add_eta(found, slice_seconds, hot) if hot.keys is None else add_eta(cut(found, "stops"), slice_seconds)


def segment_job(pings: DataFrame, network: Network, **options) -> DataFrame:
    """Raw pings to trips; the matched rows are stored once because two passes read them."""
    return segment(cut(preprocess(pings, network), "matched"), network, **options)


def stops_job(pings: DataFrame, network: Network, max_gap: float = STOPS_GAP_SECONDS, max_dist: float = STOPS_DIST_KM,
              min_len: int = MIN_TRIP_ROWS, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    matched = cut(preprocess(pings, network), "matched")
    return segment_and_stops(matched, network, hot_groups(matched, ["vehicle_id"]), max_gap, slice_seconds=slice_seconds,
                             max_gap=max_gap, max_dist=max_dist, min_len=min_len)


def eta_job(pings: DataFrame, network: Network, slice_seconds: int = SLICE_SECONDS, max_gap: float = STOPS_GAP_SECONDS,
            max_dist: float = STOPS_DIST_KM, min_len: int = MIN_TRIP_ROWS) -> DataFrame:
    matched = cut(preprocess(pings, network), "matched")
    return with_eta(matched, network, hot_groups(matched, ["vehicle_id"]), slice_seconds, stops_gap=max_gap,
                    max_gap=max_gap, max_dist=max_dist, min_len=min_len)


def live_job(pings: DataFrame, network: Network, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Enrichment of the current day: default gaps, and even one-row trips stay."""
    return stops_job(pings, network, TRIP_GAP_SECONDS, TRIP_DIST_KM, LIVE_MIN_TRIP_ROWS, slice_seconds)
