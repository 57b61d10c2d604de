"""Table maintenance: insert-ignore, dimensions, assignments, predictions, purge.

Each function returns the resulting rows; the caller appends or overwrites with Spark's writer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfleet.operators.scale import next_from_later, previous_from_earlier, require, time_slice
from wayfleet.sources.days import DayTable


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key, found by aggregation so a hot key shrinks before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return (df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
              .select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns))


def keep_last(df: DataFrame, order: Sequence[str], key: Sequence[str] = ("vehicle_id", "t_us")) -> DataFrame:
    """The last version of every key."""
    rest = [c for c in df.columns if c not in key]
    return (df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
              .select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns))


def keep_last_by(df: DataFrame, group: Sequence[str], order: Sequence[str], key: Sequence[str] = ("vehicle_id", "t_us")) -> DataFrame:
    """``keep_last`` by a shuffle on ``group``, a part of the key, which later work per group goes on with; not for hot groups."""
    return keep_last(df.repartition(*group), order, key)


def new_pings(batch: DataFrame, target: DataFrame, order: Sequence[str] = ("ping_id",)) -> DataFrame:
    """Rows of a batch to append: one per (vehicle, time), none that the target already has.

    Only the target's rows within the batch's time span can be equal, so only those are read.
    """
    key = ["vehicle_id", "t_us"]
    low, high = batch.agg(F.min("t_us"), F.max("t_us")).first()
    known = target.select(*key).filter(F.col("t_us").between(low, high)) if low is not None else target.select(*key).limit(0)
    return first_per_key(batch, key, order).join(known, key, "left_anti")


def updated_vehicles(appended: DataFrame) -> DataFrame:
    return appended.select("vehicle_id").distinct()


def new_geofence_events(batch: DataFrame, target: DataFrame) -> DataFrame:
    """One row per event id, the first condition of a payload, unless the id is stored already."""
    return first_per_key(batch, ["id"], ["event_time", "condition_ord"]).join(target.select("id"), "id", "left_anti")


def append_unknown(table: DayTable, batch: DataFrame, order: Sequence[str] = ("event_time",)) -> DataFrame:
    """Append to a day table the first row of each id that it does not hold; returns the rows it wrote.

    Only days whose Bloom filter may know one of the ids are read.
    """
    return table.write(table.unknown(first_per_key(batch, [table.id], order)))


VEHICLE_COLUMNS = ("name", "asset_type", "license_plate", "vin", "maintenance_id", "gateway_model", "gateway_serial")


def upsert_vehicles(batch: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Vehicles plus those seen for the first time; known ones stay as they are."""
    seen = batch.select(F.col("vehicle_id").alias("id"), F.col("vehicle_name").alias("name"),
                        *VEHICLE_COLUMNS[1:], "event_time", "condition_ord")
    fresh = first_per_key(seen, ["id"], ["event_time", "condition_ord"]).drop("event_time", "condition_ord")
    fresh = fresh.join(vehicles.select("id"), "id", "left_anti")
    return vehicles.unionByName(fresh, allowMissingColumns=True)


def upsert_drivers(batch: DataFrame, drivers: DataFrame) -> DataFrame:
    """Drivers with the latest name of the batch; new drivers are added."""
    latest = batch.groupBy(F.col("driver_id").alias("id")).agg(
        F.max_by("driver_name", F.struct("assigned_at", "driver_name")).alias("_name"))
    return drivers.join(latest, "id", "full_outer").select("id", F.coalesce("_name", "name").alias("name"))


def assignment_intervals(assigned: DataFrame, slice_seconds: int = 86400) -> DataFrame:
    """Assignment history from (vehicle_id, driver_id, assigned_at, assignment_id).

    Repeats of the current driver change nothing; another driver closes the interval and opens one.
    """
    require(assigned, "vehicle_id", "driver_id", "assigned_at", "assignment_id")
    df = assigned.withColumn("t_us", F.unix_micros("assigned_at")).withColumn("_slice", time_slice(slice_seconds))
    order = ["t_us", "assignment_id"]
    inside = Window.partitionBy("vehicle_id", "_slice").orderBy(*order)
    earlier = previous_from_earlier(df, ["vehicle_id"], "_slice", F.max_by("driver_id", F.struct(*order)), "_earlier")
    df = df.withColumn("_prev", F.lag("driver_id").over(inside)).join(earlier, ["vehicle_id", "_slice"])
    opened = df.filter(~F.col("driver_id").eqNullSafe(F.coalesce("_prev", "_earlier"))).drop("_prev", "_earlier")
    later = next_from_later(opened, ["vehicle_id"], "_slice", F.min("assigned_at"), "_later")
    opened = opened.withColumn("_next", F.lead("assigned_at").over(inside)).join(later, ["vehicle_id", "_slice"])
    return opened.select("vehicle_id", "driver_id", F.col("assigned_at").alias("assignment_start"),
                         F.coalesce("_next", "_later").alias("assignment_end"))


def apply_assignments(current: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """One batch applied to the assignment table (the latest row per vehicle counts).

    An open assignment of another driver is closed at ``now`` and a new one opened.
    """
    latest = batch.groupBy("vehicle_id").agg(
        F.max_by(F.struct("driver_id", "assigned_at"), F.struct("assigned_at", "driver_id")).alias("_n"))
    latest = latest.select("vehicle_id", F.col("_n.driver_id").alias("_driver"), F.col("_n.assigned_at").alias("_at"))
    merged = current.join(latest, "vehicle_id", "left")
    replaced = F.col("assignment_end").isNull() & F.col("_driver").isNotNull() & (F.col("driver_id") != F.col("_driver"))
    kept = merged.select("vehicle_id", "driver_id", "assignment_start",
                         F.when(replaced, now).otherwise(F.col("assignment_end")).alias("assignment_end"))
    still = current.filter(F.col("assignment_end").isNull()).select("vehicle_id", F.col("driver_id").alias("_driver"))
    opened = latest.join(still, ["vehicle_id", "_driver"], "left_anti").select(
        "vehicle_id", F.col("_driver").alias("driver_id"), F.col("_at").alias("assignment_start"),
        F.lit(None).cast("timestamp").alias("assignment_end"))
    return kept.unionByName(opened)


def eta_documents(stop_times: DataFrame, at: Column) -> DataFrame:
    """One row per vehicle with its stop -> time map; of repeated stops the later entry wins.

    ``stop_times(vehicle_id, stop_ord, stop_name, stop_us)``; a map has one entry per stop of a route.
    """
    last = stop_times.groupBy("vehicle_id", "stop_name").agg(
        F.max_by("stop_us", F.struct("stop_ord", "stop_us")).alias("stop_us"))
    entries = F.array_sort(F.collect_list(F.struct("stop_name", F.timestamp_micros("stop_us").alias("at"))))
    return last.groupBy("vehicle_id").agg(F.map_from_entries(entries).alias("etas")).withColumn("timestamp", at)


def eta_json(etas: Column) -> Column:
    return F.to_json(F.transform_values(etas, lambda k, v: F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")))


def purge_since(df: DataFrame, ts: str, since: Column) -> DataFrame:
    """What stays when everything from ``since`` on is deleted."""
    return df.filter(F.col(ts) < since)


def purge_events_since(events: DataFrame, since: Column, keep_current_entry: bool = False) -> DataFrame:
    """The same for geofence events; optionally the latest event of a vehicle stays if it is an entry."""
    stays = events.filter(F.col("event_time") < since)
    if not keep_current_entry:
        return stays
    recent = events.filter(F.col("event_time") >= since)
    last = keep_last(recent, ["event_time", "id"], ["vehicle_id"]).filter(F.col("event_type") == "geofenceEntry")
    return stays.unionByName(last)


def context_rows(cache: DataFrame, new: DataFrame, rows: int = 2) -> DataFrame:
    """The last cached rows of each vehicle with new data, together with the new rows."""
    key = ["vehicle_id", "t_us"]
    recent = Window.partitionBy("vehicle_id").orderBy(F.col("t_us").desc(), F.col("ping_id").desc())
    context = (cache.join(new.select("vehicle_id").distinct(), "vehicle_id", "left_semi")
                    .withColumn("_rank", F.row_number().over(recent)).filter(F.col("_rank") <= rows).drop("_rank"))
    both = context.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, ["_new", "ping_id"], key).drop("_new")


def merge_keep_last(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Cached and new rows together; on the same (vehicle, time) the new one stays."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, ["_new", "ping_id"]).drop("_new")
