"""Profiles of the enriched data: summaries, distributions, histograms, largest and fastest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfleet.operators.scale import exact_quantiles, over_slices, prefix_sums, require, time_slice
from wayfleet.operators.trips import ORDER, TRIP

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
OUTLIER_KMH = 120.0


def describe(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles, max of one column."""
    basics = df.groupBy(*group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    quartiles = exact_quantiles(df, group, value, QUARTILES)
    if group:
        return basics.join(quartiles, list(group), "left")
    one = F.lit(1)
    return basics.withColumn("_k", one).join(quartiles.withColumn("_k", one), "_k", "left").drop("_k")


def dataset_summary(df: DataFrame) -> DataFrame:
    require(df, "t_us", "vehicle_id", "route")
    return df.agg(F.count("*").alias("n_rows"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"),
                  F.count_distinct("vehicle_id").alias("n_vehicles"), F.count_distinct("route").alias("n_routes"),
                  (F.count_if(F.col("route").isNull()) / F.count("*") * 100).alias("unmatched_percent"))


def trip_sizes(df: DataFrame, by: Sequence[str] = TRIP) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"))


def size_shares(sizes: DataFrame, limits: Sequence[int] = (10, 20, 50)) -> DataFrame:
    """How many trips, and which percentage, have at least so many rows."""
    out = [F.count("*").alias("n_trips")]
    for k in limits:
        out += [F.count_if(F.col("n_rows") >= k).alias(f"at_least_{k}"),
                (F.count_if(F.col("n_rows") >= k) / F.count("*") * 100).alias(f"percent_{k}")]
    return sizes.agg(*out)


def trip_speed_profile(df: DataFrame, by: Sequence[str] = TRIP) -> DataFrame:
    """Per trip: speed statistics, distance, start, end, duration."""
    stats = df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.avg("speed_kmh").alias("mean_kmh"), F.max("speed_kmh").alias("max_kmh"),
        F.min("speed_kmh").alias("min_kmh"), F.stddev_samp("speed_kmh").alias("std_kmh"),
        F.sum("distance_km").alias("total_km"), F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"))
    stats = stats.withColumn("duration_s", (F.col("end_us") - F.col("start_us")) / F.lit(1e6))
    return stats.join(exact_quantiles(df, by, "speed_kmh", {"median_kmh": 0.5}), list(by), "left")


def stop_visits(df: DataFrame) -> DataFrame:
    return df.filter(F.col("stop_name").isNotNull()).groupBy("stop_name").agg(F.count("*").alias("n_visits"))


def at_stop_share(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count("stop_name").alias("at_stop"),
                  (F.count("stop_name") / F.count("*") * 100).alias("at_stop_percent"))


def eta_distribution(df: DataFrame) -> DataFrame:
    """Time to the next stop in seconds and minutes, and the share of rows without one."""
    spread = describe(df, "eta_seconds")
    nulls = df.agg((F.count_if(F.col("eta_seconds").isNull()) / F.count("*") * 100).alias("null_percent"))
    one = F.lit(1)
    both = spread.withColumn("_k", one).join(nulls.withColumn("_k", one), "_k").drop("_k")
    return both.withColumns({f"{c}_min": F.col(c) / 60 for c in ("mean", "p50", "max")})


def stage_accounting(before: DataFrame, after: DataFrame, by: Sequence[str] = TRIP) -> DataFrame:
    """Rows and trips kept and removed by a stage."""
    counts = lambda df, tag: df.agg(F.count("*").alias(f"rows_{tag}"), F.count_distinct(*by).alias(f"trips_{tag}"))
    one = F.lit(1)
    both = counts(before, "before").withColumn("_k", one).join(counts(after, "after").withColumn("_k", one), "_k").drop("_k")
    return both.withColumns({
        "rows_removed": F.col("rows_before") - F.col("rows_after"),
        "trips_removed": F.col("trips_before") - F.col("trips_after"),
        "rows_kept_percent": F.col("rows_after") / F.col("rows_before") * 100,
        "trips_kept_percent": F.col("trips_after") / F.col("trips_before") * 100})


def polyline_profile(df: DataFrame) -> DataFrame:
    known = df.filter(F.col("route").isNotNull() & F.col("polyline_idx").isNotNull())
    return known.groupBy("route", "polyline_idx").agg(
        F.count("*").alias("n_rows"), F.count_distinct("vehicle_id").alias("n_vehicles"),
        F.avg("speed_kmh").alias("mean_kmh"), F.stddev_samp("speed_kmh").alias("std_kmh"))


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlations over the rows where both features are known, one row per pair."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    entries = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"`{a}|{b}`").alias("corr"))
                        for a, b in pairs])
    return row.select(F.explode(entries).alias("p")).select("p.*")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows per bin of [low, high]; the upper edge belongs to the last bin."""
    inside = df.filter((F.col(value) >= low) & (F.col(value) <= high))
    width = (high - low) / bins
    at = F.least(F.lit(bins), F.floor((F.col(value) - low) / width).cast("int") + 1)
    return inside.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n")).withColumn(
        "bin_low", F.lit(low) + (F.col("bin") - 1) * F.lit(width))


def size_cdf(sizes: DataFrame, bucket: int = 1000) -> DataFrame:
    """Share of trips that have at most so many rows, for every size that occurs."""
    counts = sizes.groupBy("n_rows").agg(F.count("*").alias("n")).withColumns(
        {"_all": F.lit(1), "_range": F.floor(F.col("n_rows") / bucket)})
    total = counts.groupBy("_all").agg(F.sum("n").alias("_total"))
    upto = prefix_sums(counts, ["_all"], "_range", ["n_rows"], {"upto": F.col("n")})
    return upto.join(F.broadcast(total), "_all").select("n_rows", "n", "upto", (F.col("upto") / F.col("_total")).alias("share"))


def row_counts_since(pings: DataFrame, events: DataFrame, day_start: Column) -> DataFrame:
    a = pings.filter(F.col("timestamp") >= day_start).agg(F.count("*").alias("n")).withColumn("what", F.lit("pings"))
    b = events.filter(F.col("event_time") >= day_start).agg(F.count("*").alias("n")).withColumn("what", F.lit("events"))
    return a.unionByName(b)


def speed_outliers(df: DataFrame, limit_kmh: float = OUTLIER_KMH, top: int = 10) -> DataFrame:
    return (df.filter(F.col("speed_kmh") > limit_kmh)
              .orderBy(F.round("speed_kmh", 6).desc(), *ORDER, "vehicle_id").limit(top))


def largest_trips(df: DataFrame, n: int, by: Sequence[str] = TRIP) -> DataFrame:
    return trip_sizes(df, by).orderBy(F.col("n_rows").desc(), *by).limit(n)


def rows_of_largest_trip(df: DataFrame, by: Sequence[str] = TRIP) -> DataFrame:
    return df.join(F.broadcast(largest_trips(df, 1, by)), list(by), "left_semi")


def top_polylines(travel_times: DataFrame, n: int = 10) -> DataFrame:
    return travel_times.orderBy(F.col("sample_count").desc(), "route", "polyline_idx").limit(n)


def first_trips(df: DataFrame, k: int, by: Sequence[str] = TRIP) -> DataFrame:
    """Rows of the first ``k`` trips in key order (``k`` keys are picked, then broadcast)."""
    return df.join(F.broadcast(df.select(*by).distinct().orderBy(*by).limit(k)), list(by), "left_semi")


def rows_of_slowest_arrival(df: DataFrame, by: Sequence[str] = TRIP) -> DataFrame:
    """All rows of the trip that holds the longest time to a stop."""
    top = (df.filter(F.col("eta_seconds").isNotNull()).groupBy(*by).agg(F.max("eta_seconds").alias("_m"))
             .orderBy(F.col("_m").desc(), *by).limit(1))
    return df.join(F.broadcast(top.select(*by)), list(by), "left_semi")


def fastest_row(df: DataFrame) -> DataFrame:
    return df.filter(F.col("speed_kmh").isNotNull()).orderBy(
        F.round("speed_kmh", 6).desc(), *ORDER, "vehicle_id").limit(1)


def fastest_place(*at: str) -> Column:
    """Least on a trip's fastest row, the first of equally fast ones; NULL without a speed."""
    return F.when(F.col("speed_kmh").isNotNull(), F.struct((-F.round("speed_kmh", 6)).alias("s"), *at))


def around_fastest(df: DataFrame, seconds: float = 300.0, by: Sequence[str] = TRIP) -> DataFrame:
    """The trip's rows within so many seconds of its fastest row, with their time offset."""
    sliced = df.withColumn("_slice", time_slice())
    fast = over_slices(sliced, by, "_slice", "_at", F.min(fastest_place(*ORDER)), F.min)
    near = sliced.join(fast, [*by, "_slice"]).withColumn("offset_s", (F.col("t_us") - F.col("_at.t_us")) / F.lit(1e6))
    return near.filter(F.abs("offset_s") <= seconds).drop("_at", "_slice")


def rows_around_fastest(df: DataFrame, rows: int = 5, by: Sequence[str] = TRIP) -> DataFrame:
    """The rows up to ``rows`` places before and after each trip's fastest row."""
    ranked = prefix_sums(df.withColumn("_slice", time_slice()), by, "_slice", ORDER, {"_pos": F.lit(1)})
    fast = over_slices(ranked, by, "_slice", "_at", F.min(fastest_place(*ORDER, "_pos")), F.min)
    near = ranked.join(fast, [*by, "_slice"]).withColumn("row_offset", F.col("_pos") - F.col("_at._pos"))
    return near.filter(F.abs("row_offset") <= rows).drop("_pos", "_at", "_slice")
