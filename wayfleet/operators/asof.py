"""As-of join: the last known row of one long table for every row of another, without sorting a whole key in one task.

Both sides are put in order together inside slices of time. What is known from earlier slices comes as one
summary row per key and slice, so a key that holds a large share of the rows spreads over its slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfleet.operators.scale import SLICE_SECONDS, previous_from_earlier, require, time_slice


def asof_join(left: DataFrame, right: DataFrame, key: Sequence[str], values: Sequence[str], time: str = "t_us", right_time: str = "t_us",
              tie: Sequence[str] = (), tolerance_seconds: float | None = None, strict: bool = False, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` of the same key at or before its time (before it, if ``strict``), and ``asof_us``, that row's time.

    Times are microseconds. Of right rows of one time the last by ``tie`` counts. With a tolerance, older rows
    count as none. Rows of ``left`` without a match, a key or a time keep nulls; rows of ``right`` without a
    key or a time take no part. No row of ``left`` is lost or repeated.
    """
    require(left, *key, time)
    require(right, *key, right_time, *values, *tie)
    known = F.struct(F.col(right_time).alias("asof_us"), *[F.col(c).alias(f"tie_{i}") for i, c in enumerate(tie)], *[F.col(c).alias(f"v_{c}") for c in values])
    held = right.filter(F.col(right_time).isNotNull()).dropna(subset=list(key)).select(
        *key, F.col(right_time).cast("long").alias("_t"), F.lit(None).alias("_row"), known.alias("_known"))
    asked = left.select(*key, F.col(time).cast("long").alias("_t"), F.struct(*left.columns).alias("_row"), F.lit(None).alias("_known"))
    usable = F.col("_t").isNotNull()
    for c in key:
        usable = usable & F.col(c).isNotNull()
    both = held.unionByName(asked.filter(usable)).withColumn("_slice", time_slice(slice_seconds, "_t"))
    earlier = previous_from_earlier(both, key, "_slice", F.max("_known"), "_earlier")
    # Right rows come before left ones of their time, or after them; among themselves by tie.
    first = F.when(F.col("_known").isNotNull(), 1 if strict else 0).otherwise(0 if strict else 1)
    upto = Window.partitionBy(*key, "_slice").orderBy("_t", first, "_known").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_inside", F.last("_known", ignorenulls=True).over(upto)).filter(F.col("_row").isNotNull())
    joined = inside.join(earlier, [*key, "_slice"]).withColumn("_hit", F.coalesce("_inside", "_earlier"))
    if tolerance_seconds is not None:
        near = F.col("_t") - F.col("_hit.asof_us") <= F.lit(int(tolerance_seconds * 1e6))
        joined = joined.withColumn("_hit", F.when(near, F.col("_hit")))
    found = joined.select("_row.*", F.col("_hit.asof_us").alias("asof_us"), *[F.col(f"_hit.v_{c}").alias(c) for c in values])
    kinds = {f.name: f.dataType for f in right.schema}
    lost = left.filter(~F.coalesce(F.col(time).isNotNull() & _all_known(key), F.lit(False))).withColumns(
        {"asof_us": F.lit(None).cast("long"), **{c: F.lit(None).cast(kinds[c]) for c in values}})
    return found.unionByName(lost)


def _all_known(key: Sequence[str]):
    known = F.lit(True)
    for c in key:
        known = known & F.col(c).isNotNull()
    return known
