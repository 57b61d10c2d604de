"""Counting stages while they run: no scan of their own, in batches and on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfleet.operators.scale import SLICE_SECONDS, require, time_slice
from wayfleet.operators.trips import ORDER, TRIP


class StageCounts:
    """Rows and trips that pass the places it watches, known once an action has run over them.

    A place counts for the first action alone. Rows of a stage that is run again after a failure count once.
    """

    def __init__(self):
        self._seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, place: str, starts: Column | None = None) -> DataFrame:
        """``df``, counted under the name ``place``; ``starts`` marks one row of each trip."""
        trips = F.count_if(starts) if starts is not None else F.lit(0).cast("long")
        self._seen[place] = Observation(place)
        return df.observe(self._seen[place], F.count(F.lit(1)).alias("rows"), (F.sum(trips) if starts is None else trips).alias("trips"))

    def of(self, place: str) -> dict[str, int]:
        """Waits for the action that runs over the place."""
        return {k: v or 0 for k, v in self._seen[place].get.items()}

    def between(self, spark: SparkSession, before: str, after: str) -> DataFrame:
        """Rows and trips kept and removed between two places, as ``profile.stage_accounting`` has them."""
        a, b = self.of(before), self.of(after)
        share = lambda part, whole: part / whole * 100 if whole else None
        row = (a["rows"], a["trips"], b["rows"], b["trips"], a["rows"] - b["rows"], a["trips"] - b["trips"],
               share(b["rows"], a["rows"]), share(b["trips"], a["trips"]))
        return spark.createDataFrame([row], "rows_before long, trips_before long, rows_after long, trips_after long, rows_removed long, "
                                            "trips_removed long, rows_kept_percent double, trips_kept_percent double")


def trim_and_count(df: DataFrame, counts: StageCounts, by: Sequence[str] = TRIP, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """``stops.trim_after_last_stop``, with the places ``stops`` before and ``trimmed`` after it counted on the way.

    A trip's first row is told by the same summary per slice that tells its last stop.
    """
    require(df, *by, *ORDER, "stop_name")
    at, sliced = F.struct(*ORDER), df.withColumn("_slice", time_slice(slice_seconds))
    per_slice = sliced.groupBy(*by, "_slice").agg(F.max(F.when(F.col("stop_name").isNotNull(), at)).alias("_last"), F.min(at).alias("_first"))
    trip = Window.partitionBy(*by)
    summary = per_slice.select(*by, "_slice", F.max("_last").over(trip).alias("_last"), F.min("_first").over(trip).alias("_first"))
    starts = at == F.col("_first")
    joined = counts.watch(sliced.join(summary, [*by, "_slice"]), "stops", starts)
    return counts.watch(joined.filter(at <= F.col("_last")), "trimmed", starts).drop("_first", "_last", "_slice")


def observed(stream: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """A stream whose batches report ``metrics``, aggregates, under ``name``."""
    return stream.observe(name, *[m.alias(k) for k, m in metrics.items()])


def reported(query: StreamingQuery, name: str) -> list[dict]:
    """What the recent batches of a stream reported, with ``batch``; batches without rows have none."""
    return [{"batch": p["batchId"], **p["observedMetrics"][name].asDict()} for p in query.recentProgress if name in (p["observedMetrics"] or {})]
