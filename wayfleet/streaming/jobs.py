"""Structured Streaming jobs: ingestion, live state, trips and incremental enrichment.

State that grows with time is bounded by a watermark; state that is kept per vehicle holds one row,
or the rows of the last minutes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from wayfleet.functions.clock import CAMPUS_TZ, DAY_START_SECONDS
from wayfleet.operators import forecast, matching, stops, upkeep
from wayfleet.operators.scale import Hot, by_size, cut, hot_groups, lookup_join, may_broadcast
from wayfleet.operators.trips import ping_frame
from wayfleet.plans import enrich
from wayfleet.sources.network import Network
from wayfleet.streaming.log import BucketLog

# The results depend on these defaults.
CADENCE = "5 seconds"
LATE_AFTER_SECONDS = 600
DAY_SECONDS = 86_400


def read_stream(spark: SparkSession, path: str, schema, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def paced(writer: DataStreamWriter, checkpoint: str, cadence: str | None = CADENCE) -> DataStreamWriter:
    """Fixed cadence; a cycle that overruns skips ahead. ``None`` takes what there is and stops."""
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=cadence) if cadence else writer.trigger(availableNow=True)


def deduplicated(pings: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """At-least-once input to one row per (vehicle, time)."""
    return pings.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["vehicle_id", "timestamp"])


def inside_state(events: DataFrame, tz: str = CAMPUS_TZ, delay: str = "6 hours", start_seconds: int = DAY_START_SECONDS) -> DataFrame:
    """Latest event kind per vehicle and service day; local time is the event time, so a day begins
    ``start_seconds`` after local midnight, ends a day later, and its state is dropped ``delay`` after that."""
    entry = (F.col("event_type") == "geofenceEntry").cast("int").alias("entry")
    local = events.withColumn("local_time", F.from_utc_timestamp("event_time", tz)).withWatermark("local_time", delay)
    last = local.groupBy(F.window("local_time", "1 day", startTime=f"{start_seconds} seconds"), "vehicle_id").agg(F.max(F.struct("event_time", entry)).alias("l"))
    return last.select("vehicle_id", F.to_date("window.start").alias("service_day"),
                       F.col("l.event_time").alias("event_time"), (F.col("l.entry") == 1).alias("inside"))


def latest_positions(pings: DataFrame) -> DataFrame:
    """Last position per vehicle: one row of state each."""
    last = F.max_by(F.struct("ping_id", "latitude", "longitude"), F.struct("timestamp", "ping_id"))
    return (pings.groupBy("vehicle_id").agg(F.max("timestamp").alias("timestamp"), last.alias("l"))
                 .select("vehicle_id", "timestamp", "l.*"))


def live_view(pings: DataFrame, events: DataFrame) -> DataFrame:
    """Per vehicle its last geofence event and its last position, as both streams bring them, in any order.

    ``events(vehicle_id, event_time, event_type, id)``. One row of state per vehicle serves both sides, so neither
    waits for the other; a vehicle that only one stream knows has nulls from the other.
    """
    place, event = F.struct("timestamp", "ping_id", "latitude", "longitude"), F.struct("event_time", F.col("id").alias("event_id"), "event_type")
    both = (pings.select("vehicle_id", place.alias("place"))
                 .unionByName(events.select("vehicle_id", event.alias("event")), allowMissingColumns=True))
    last = both.groupBy("vehicle_id").agg(F.max("place").alias("p"), F.max("event").alias("e"))
    return last.select("vehicle_id", "p.*", "e.event_time", "e.event_id", (F.col("e.event_type") == "geofenceEntry").alias("inside"))


def gap_trips(pings: DataFrame, max_gap: float = 15.0, delay: str = "10 minutes") -> DataFrame:
    """Trips cut by time gaps alone, one row each, sent out when the watermark has passed their end."""
    session = F.session_window("timestamp", f"{int(max_gap * 1000)} milliseconds")
    return (pings.withWatermark("timestamp", delay).groupBy("vehicle_id", session).agg(F.count("*").alias("n_rows"))
                 .select("vehicle_id", F.col("session_window.start").alias("start"),
                         F.col("session_window.end").alias("end"), "n_rows"))


def to_table(stream: DataFrame, path: str, checkpoint: str, cadence: str | None = CADENCE) -> StreamingQuery:
    """Append finished rows to a Parquet table."""
    return paced(stream.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint, cadence).start()


def versions_to_table(stream: DataFrame, path: str, checkpoint: str, cadence: str | None = CADENCE) -> StreamingQuery:
    """Write every changed row under its batch number; ``newest`` picks the current one. A batch that
    runs again after a failure replaces its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return paced(stream.writeStream.outputMode("update").foreachBatch(write), checkpoint, cadence).start()


def newest(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    rows = spark.read.parquet(path)
    return upkeep.keep_last(rows, ["batch"], key).drop("batch")


TAIL = ("vehicle_id", "ping_id", "t_us", "latitude", "longitude", *matching.MATCHED)


def enrich_batch(tail: DataFrame | None, new: DataFrame, network: Network, max_gap: float = enrich.TRIP_GAP_SECONDS,
                 max_dist: float = enrich.TRIP_DIST_KM, late_after: float = LATE_AFTER_SECONDS,
                 work: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changed rows, next tail, late rows) of one micro-batch.

    The tail holds each vehicle's matched rows of the last ``late_after`` seconds with as much before
    them as a vote can reach twice, and one older row, the anchor, from whose trip number the
    numbering goes on. New rows join the tail and it is cut and voted again; the rows a new one can
    have changed are returned. Rows more than ``late_after`` behind the vehicle's newest one come back
    as late instead of vanishing.
    """
    new = matching.match_route(ping_frame(new), network).select(*TAIL).withColumns({"_new": F.lit(1), "_no": F.lit(None).cast("long")})
    late_us, reach_us = int(late_after * 1e6), int((enrich.VOTE_WINDOW + 2) * max_gap * 1e6)
    if tail is not None:
        seen = tail.groupBy("vehicle_id").agg(F.max("t_us").alias("_seen"))
        new = new.join(seen, "vehicle_id", "left").withColumn(
            "_late", F.coalesce(F.col("t_us") < F.col("_seen") - late_us, F.lit(False))).drop("_seen")
    else:
        new = new.withColumn("_late", F.lit(False))
    marked = cut(new, "marked", work)
    late, rows = marked.filter("_late").select(*TAIL), matching.match_stop(marked.filter(~F.col("_late")).drop("_late"), network)
    if tail is not None:
        touched = rows.select("vehicle_id").distinct()
        known = matching.match_stop(tail, network).join(touched, "vehicle_id", "left_semi").withColumns({
            "_new": F.lit(0), "_no": F.expr("CASE WHEN anchor THEN segment_no END")})
        rows = known.drop("segment_no", "anchor").unionByName(rows)
    hot, order = hot_groups(rows, ["vehicle_id"], work), ["_new", "ping_id"]
    rows = by_size(rows.withColumn("_raw", F.struct(*matching.MATCHED)), ["vehicle_id"],
                   lambda r: upkeep.keep_last_by(r, ["vehicle_id"], order), lambda r: upkeep.keep_last(r, order), hot)
    rows = rows if hot.keys is None else cut(rows, "rows", work)
    done = enrich.segment_and_stops(rows, network, hot, max_gap, max_gap=max_gap, max_dist=max_dist, min_len=enrich.LIVE_MIN_TRIP_ROWS)
    done = done if hot.keys is None else cut(done, "found", work)
    # What changed and what the next batch needs is marked per vehicle in the same job; the tail has the matches from before the vote.
    done = _per_vehicle(done, hot, _newest=F.max("t_us"), _since=F.min(F.when(F.col("_new") == 1, F.col("t_us"))),
                        _base=F.max(F.col("_no") - F.col("segment_no")))
    at, known_id, since = F.struct("t_us", "ping_id"), F.col("ping_id").isNotNull(), F.col("_newest") - late_us - 2 * reach_us
    done = _per_vehicle(done, hot, _anchor=F.max(F.when((F.col("t_us") < since) & known_id, at)))
    done = done.withColumns({"segment_no": F.col("segment_no") + F.coalesce("_base", F.lit(0)), "_changed": F.col("t_us") >= F.col("_since") - reach_us,
                             "anchor": F.coalesce(at == F.col("_anchor"), F.lit(False))})
    done = done.withColumn("_raw", F.when(F.col("anchor") | ((F.col("t_us") >= since) & known_id), F.col("_raw")))
    done = cut(done.drop("_new", "_no", "_newest", "_since", "_base", "_anchor"), "done", work)
    changed = done.filter("_changed").drop("_changed", "_raw", "anchor")
    kept = done.filter("_raw IS NOT NULL").select(*[c for c in TAIL if c not in matching.MATCHED], "_raw.*", "segment_no", "anchor")
    if tail is not None:
        kept = kept.unionByName(tail.join(touched, "vehicle_id", "left_anti"))
    return changed, kept, late


def _per_vehicle(df: DataFrame, hot: Hot, **values: Column) -> DataFrame:
    """Add aggregates per vehicle: where the rows are, or of hot vehicles joined back from one row each."""
    def joined(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(rows.groupBy("vehicle_id").agg(*[v.alias(n) for n, v in values.items()])), "vehicle_id")

    return by_size(df, ["vehicle_id"], lambda rows: rows.withColumns({n: v.over(Window.partitionBy("vehicle_id")) for n, v in values.items()}),
                   joined, hot)


def incremental_enrich(pings: DataFrame, network: Network, path: str, checkpoint: str, cadence: str | None = CADENCE,
                       max_gap: float = enrich.TRIP_GAP_SECONDS, max_dist: float = enrich.TRIP_DIST_KM,
                       late_after: float = LATE_AFTER_SECONDS, on_batch: Callable | None = None) -> StreamingQuery:
    """Keep ``path/rows``, a ``BucketLog``, enriched; ``path/tail`` and ``path/late`` go with it.

    Everything is written under its batch number, so a repeated batch replaces its own output.
    """
    rows = BucketLog(f"{path}/rows")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tail = spark.read.parquet(f"{path}/tail/{batch_id - 1}") if batch_id else None
        done, kept, late = enrich_batch(tail, batch, network, max_gap, max_dist, late_after, f"{path}/work")
        rows.append(done, batch_id)
        late.write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        kept.write.mode("overwrite").parquet(f"{path}/tail/{batch_id}")
        if on_batch:
            on_batch(done, batch_id)

    return paced(pings.writeStream.foreachBatch(write), checkpoint, cadence).start()


def predictions(enriched: DataFrame, models: DataFrame, travel_times: DataFrame, network: Network, at: Column,
                n: int = forecast.SEQUENCE_LENGTH, order: tuple[int, int, int] = (3, 0, 2)) -> tuple[DataFrame, DataFrame]:
    """(ETA documents, predicted speeds) from the newest enriched rows of the vehicles."""
    newest_first = Window.partitionBy("vehicle_id").orderBy(F.col("t_us").desc(), F.col("ping_id").desc())
    latest = (enriched.withColumn("_r", F.row_number().over(newest_first)).filter("_r = 1")
                      .select("vehicle_id", "route", "polyline_idx", "stop_name"))
    etas = forecast.predict_eta(enriched, models, n).select("vehicle_id", "eta_us")
    times = stops.project_stop_times(latest, stops.last_visit_per_stop(enriched), etas, travel_times, network)
    return upkeep.eta_documents(times, at), forecast.forecast_speed(enriched, *order)


def last_day(log: BucketLog, changed: DataFrame, seconds: float = DAY_SECONDS, columns: Sequence[str] | None = None) -> DataFrame:
    """The stored rows of the vehicles among ``changed``, as far back as ``seconds`` before each one's newest.

    Only the buckets of that time are read, of ``columns`` if they are named, and only those vehicles' rows are compared
    with their older versions: in one shuffle on the vehicle, unless it is hot.
    """
    touched = cut(changed.groupBy("vehicle_id").agg(F.max("t_us").alias("_newest")), "touched")
    low, high = touched.agg(F.min("_newest"), F.max("_newest")).first()
    back = int(seconds * 1e6)
    rows = log.stored(changed.sparkSession, None if low is None else low - back, high).drop("bucket")
    if columns is not None:
        rows = rows.select(*[c for c in rows.columns if c in {*log.key, *columns, "batch"}])
    small = may_broadcast(touched)
    near = lambda r: r.filter(F.col("t_us") > F.col("_newest") - F.lit(back)).drop("_newest")
    whole = lambda r: upkeep.keep_last_by(near(r.join(F.broadcast(touched) if small else touched.hint("merge"), "vehicle_id")), ["vehicle_id"], ["batch"], log.key)
    sliced = lambda r: upkeep.keep_last(near(lookup_join(r, touched, ["vehicle_id"], "inner", small=small)), ["batch"], list(log.key))
    return by_size(rows, ["vehicle_id"], whole, sliced).drop("batch")


# What predictions look at.
PREDICT_FROM = ("vehicle_id", "ping_id", "t_us", "route", "polyline_idx", "stop_name", *forecast.ETA_FEATURES)


def write_predictions(path: str, rows: str, models: DataFrame, travel_times: DataFrame, network: Network,
                      n: int = forecast.SEQUENCE_LENGTH, order: tuple[int, int, int] = (3, 0, 2)) -> Callable:
    """``on_batch`` for ``incremental_enrich``: append both kinds of predictions per tick.

    They are made from the day that is stored in ``rows`` for the vehicles of the batch, not from the
    batch's own rows, so stop visits and speeds from before the tick count. That day is stored once for both.
    """
    def on_batch(done: DataFrame, batch_id: int) -> None:
        day = cut(last_day(BucketLog(rows), done, columns=PREDICT_FROM), "day", f"{path}/work")
        etas, speeds = predictions(day, models, travel_times, network, F.current_timestamp(), n, order)
        etas.write.mode("overwrite").parquet(f"{path}/etas/batch={batch_id}")
        speeds.write.mode("overwrite").parquet(f"{path}/speeds/batch={batch_id}")
    return on_batch
