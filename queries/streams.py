"""Streaming jobs run to the end of their input; the tables they wrote are the results."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import fixture as fx
from queries.forecasts import ETAS, GIVEN, PROJECTED, RECENT, given, trained
from queries.ingest import scratch
from queries.live import SERVICE_DAY
from queries.oracle import sql
from queries.registry import SLICE, query, stage
from wayfleet.operators import accounting, stops
from wayfleet.operators.scale import cut
from wayfleet.streaming import jobs, state
from wayfleet.streaming.log import BucketLog


def finish(started):
    started.awaitTermination()


def event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return jobs.read_stream(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def replay(spark, sf, start, parts=3, newest_first=False):
    """Let the pings arrive in so many equal time spans and run the job on each, as after a restart."""
    path = scratch(spark, "ping-files")
    rows = stage(spark, sf, "pings")
    first, last = rows.agg(F.min("t_us"), F.max("t_us")).first()
    span = (last - first) // parts + 1
    order = range(parts)
    for part in (reversed(order) if newest_first else order):
        rows.filter(F.floor((F.col("t_us") - first) / span) == part).write.mode("append").parquet(path)
        finish(start(jobs.read_stream(spark, path, rows.schema)))


@query("h3_deduplicated_ingest", sql("pings", "SELECT vehicle_id, t_us, count(*) AS n FROM pings GROUP BY vehicle_id, t_us"))
def _(spark, sf):
    path = scratch(spark, "twice")
    p = stage(spark, sf, "pings")
    p.unionByName(p).write.parquet(path)
    stream = jobs.deduplicated(jobs.read_stream(spark, path, spark.read.parquet(path).schema), "1 hour")
    out = scratch(spark, "deduplicated")
    finish(jobs.to_table(stream.select("vehicle_id", "t_us"), out, scratch(spark, "cp"), None))
    return spark.read.parquet(out).groupBy("vehicle_id", "t_us").agg(F.count("*").alias("n"))


def local_day(ts):
    return f"CAST((({ts} AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS DATE)"


@query("h5_inside_state", sql("geofence_events", f"""
SELECT vehicle_id, CAST({local_day('event_time')} AS VARCHAR) AS service_day, epoch_us(max(event_time)) AS event_us,
       arg_max(event_type = 'geofenceEntry', (event_time, event_type = 'geofenceEntry')) AS inside FROM geofence_events GROUP BY vehicle_id, {local_day('event_time')}"""))
def _(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "geofenceEntry").otherwise("geofenceExit")
    events = event_stream(spark, sf).filter(F.col("event_type").isin("signup", "error")).select(
        F.col("user_id").cast("string").alias("vehicle_id"), kind.alias("event_type"), F.col("ts").alias("event_time"))
    out = scratch(spark, "inside")
    finish(jobs.versions_to_table(jobs.inside_state(events), out, scratch(spark, "cp"), None))
    return jobs.newest(spark, out, ["vehicle_id", "service_day"]).select(
        "vehicle_id", F.col("service_day").cast("string").alias("service_day"), F.unix_micros("event_time").alias("event_us"), "inside")


@query("h6_latest_positions", sql("pings", """
SELECT vehicle_id, t_us, ping_id FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, ping_id DESC) AS rk FROM pings) x WHERE rk = 1"""))
def _(spark, sf):
    out, cp = scratch(spark, "latest"), scratch(spark, "cp")
    replay(spark, sf, lambda pings: jobs.versions_to_table(jobs.latest_positions(pings), out, cp, None))
    return jobs.newest(spark, out, ["vehicle_id"]).select("vehicle_id", F.unix_micros("timestamp").alias("t_us"), "ping_id")


@query("h7_gap_trips", sql("pings", """
SELECT vehicle_id, min(t_us) AS start_us, max(t_us) + 15000000 AS end_us, count(*) AS n_rows FROM (
  SELECT *, sum(s) OVER (PARTITION BY vehicle_id ORDER BY t_us, ping_id ROWS UNBOUNDED PRECEDING) AS no FROM (
    SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY vehicle_id ORDER BY t_us, ping_id) <= 15000000 THEN 0 ELSE 1 END AS s FROM pings) a) b
GROUP BY vehicle_id, no HAVING max(t_us) + 15000000 <= (SELECT max(t_us) FROM pings) // 1000 * 1000 - 120000000"""))
def _(spark, sf):
    out, cp = scratch(spark, "gap-trips"), scratch(spark, "cp")
    replay(spark, sf, lambda pings: jobs.to_table(jobs.gap_trips(pings, 15.0, "2 minutes"), out, cp, None))
    return spark.read.parquet(out).select("vehicle_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_rows")


@query("h2_incremental_enrich", sql("live", "SELECT vehicle_id, ping_id, segment_no, route, polyline_idx, segment_idx, stop_name FROM live"), "polyline_idx segment_idx")
def _(spark, sf):
    out, cp, net = scratch(spark, "enriched"), scratch(spark, "cp"), fx.network(spark, sf)
    replay(spark, sf, lambda pings: jobs.incremental_enrich(pings, net, out, cp, None, late_after=60.0))
    return BucketLog(f"{out}/rows").newest(spark).select(
        "vehicle_id", "ping_id", "segment_no", "route", "polyline_idx", "segment_idx", "stop_name")


LATE = """
SELECT p.vehicle_id, p.ping_id, p.t_us FROM pings p, (SELECT min(t_us) AS lo, (max(t_us) - min(t_us)) // 2 + 1 AS span FROM pings) b
WHERE p.t_us < lo + span AND p.t_us < (SELECT max(q.t_us) FROM pings q WHERE q.vehicle_id = p.vehicle_id AND q.t_us >= lo + span) - 120000000"""


@query("h4_late_rows", sql("pings", LATE))
def _(spark, sf):
    """The same input, newest span first: what comes more than two minutes behind its vehicle is set aside."""
    out, cp, net = scratch(spark, "late"), scratch(spark, "cp"), fx.network(spark, sf)
    replay(spark, sf, lambda pings: jobs.incremental_enrich(pings, net, out, cp, None, late_after=120.0), 2, True)
    return spark.read.parquet(f"{out}/late").select("vehicle_id", "ping_id", "t_us")


@query("h8_predictions_per_tick")
def _(spark, sf):
    net, out, cp = fx.network(spark, sf), scratch(spark, "ticks"), scratch(spark, "cp")
    models, _ = trained(spark, sf)
    travel = cut(stops.polyline_travel_times(stage(spark, sf, "l3"), slice_seconds=SLICE), "travel")
    # The trained models look at four rows.
    predict = jobs.write_predictions(out, f"{out}/rows", models, travel, net, 4)
    replay(spark, sf, lambda pings: jobs.incremental_enrich(pings, net, out, cp, None, on_batch=predict), 2)
    etas = spark.read.parquet(f"{out}/etas").select("batch", "vehicle_id", F.size("etas").alias("n_stops"))
    return etas.groupBy("batch").agg(F.count("*").alias("n_vehicles"), F.sum("n_stops").alias("n_stop_times"))


STATE_DELAY = 20.0


@query("h2_h7_stateful_trips", sql("live", f"""
SELECT vehicle_id, ping_id, segment_no, route, polyline_idx, segment_idx, stop_name FROM live
WHERE t_us <= (SELECT max(t_us) FROM pings) // 1000 * 1000 - {int((STATE_DELAY + state.CONTEXT_ROWS * 15.0) * 1e6)}"""), "polyline_idx segment_idx")
def _(spark, sf):
    """Trips with the off-route rule from keyed state: what the last watermark lets leave."""
    files, out, cp, net = scratch(spark, "matched"), scratch(spark, "stateful"), scratch(spark, "cp"), fx.network(spark, sf)

    def start(pings):
        finish(state.match_stream(pings, net, files, f"{cp}/match", None))
        return state.stateful_enrich(state.read_matched(spark, files), net, out, f"{cp}/trips", None, STATE_DELAY)

    replay(spark, sf, start)
    return spark.read.parquet(out).select("vehicle_id", "ping_id", "segment_no", "route", "polyline_idx", "segment_idx", "stop_name")


TICK_TIMES = """
SELECT vehicle_id, stop_name, round(arg_max(stop_us, (stop_ord, stop_us)) / 1e6, 3) AS stop_s FROM projected, span
WHERE stop_us IS NOT NULL AND (SELECT max(t_us) FROM pings p WHERE p.vehicle_id = projected.vehicle_id) >= lo + wide GROUP BY vehicle_id, stop_name"""


@query("h8_stop_times_of_last_tick", sql("live segments stops travel", TICK_TIMES, recent=RECENT, given=GIVEN, etas=ETAS, projected=PROJECTED,
                                         span="SELECT min(t_us) AS lo, (max(t_us) - min(t_us)) // 3 * 2 + 2 AS wide FROM pings"))
def _(spark, sf):
    """Stop times per vehicle of the last of three ticks, from the buckets of its day in a compacted log."""
    net, out, cp = fx.network(spark, sf), scratch(spark, "ticks"), scratch(spark, "cp")
    travel = cut(stops.polyline_travel_times(stage(spark, sf, "l3"), slice_seconds=SLICE), "travel")
    predict = jobs.write_predictions(out, f"{out}/rows", given(spark, sf), travel, net, order=(1, 0, 0))
    newest = stage(spark, sf, "pings").agg(F.max("t_us")).first()[0]

    def tick(done, batch_id):
        predict(done, batch_id)
        BucketLog(f"{out}/rows").compact(spark, newest)

    replay(spark, sf, lambda pings: jobs.incremental_enrich(pings, net, out, cp, None, late_after=60.0, on_batch=tick), 3)
    etas = spark.read.parquet(f"{out}/etas").filter("batch = 2")
    return etas.select("vehicle_id", F.explode("etas").alias("stop_name", "at")).select(
        "vehicle_id", "stop_name", F.round(F.unix_micros("at") / F.lit(1e6), 3).alias("stop_s"))


@query("h2_bucket_log", sql("pings", """
SELECT vehicle_id, t_us // 60000000 AS minute, count(*) AS n, max(ping_id) AS last_ping FROM (SELECT vehicle_id, t_us, max(ping_id) AS ping_id FROM pings GROUP BY ALL) u
WHERE t_us >= (SELECT (min(t_us) + max(t_us)) // 2 FROM pings) GROUP BY ALL"""))
def _(spark, sf):
    """Half of the time span read from a log of one-minute buckets that was written twice over, compacted and cut."""
    rows = stage(spark, sf, "pings")
    first, last = rows.agg(F.min("t_us"), F.max("t_us")).first()
    middle, log = (first + last) // 2, BucketLog(scratch(spark, "bucket-log"), seconds=60)
    for batch, part in enumerate([rows.withColumn("ping_id", F.lit(-1).cast("long")), rows.filter("ping_id % 2 = 0"), rows.filter("ping_id % 2 = 1")]):
        log.append(part, batch)
    log.append(rows.filter("ping_id % 2 = 1"), 2)
    log.compact(spark, last)
    log.expire(spark, middle)
    return log.newest(spark, middle).groupBy("vehicle_id", F.floor(F.col("t_us") / 60_000_000).alias("minute")).agg(
        F.count("*").alias("n"), F.max("ping_id").alias("last_ping"))


@query("j11_live_view_stream", sql("pings geofence_events", """
SELECT p.vehicle_id, p.t_us, p.ping_id, epoch_us(e.event_time) AS event_us
FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, ping_id DESC) AS rk FROM pings) p
JOIN (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY event_time DESC, id DESC) AS rk FROM geofence_events) e ON e.vehicle_id = p.vehicle_id
WHERE p.rk = 1 AND e.rk = 1 AND e.event_type = 'geofenceEntry'"""))
def _(spark, sf):
    """Where the vehicles inside are, kept up from the stream of events and that of pings, the newest pings first."""
    out, cp = scratch(spark, "live-view"), scratch(spark, "cp")
    kind = F.when(F.col("event_type") == "signup", "geofenceEntry").otherwise("geofenceExit")
    events = event_stream(spark, sf).filter(F.col("event_type").isin("signup", "error")).select(
        F.col("user_id").cast("string").alias("vehicle_id"), kind.alias("event_type"), F.col("ts").alias("event_time"), F.col("event_id").cast("string").alias("id"))
    replay(spark, sf, lambda pings: jobs.versions_to_table(jobs.live_view(pings, events), out, cp, None), newest_first=True)
    return jobs.newest(spark, out, ["vehicle_id"]).filter("inside AND timestamp IS NOT NULL").select(
        "vehicle_id", F.unix_micros("timestamp").alias("t_us"), "ping_id", F.unix_micros("event_time").alias("event_us"))


@query("g10_observed_batches", sql("pings", """
SELECT CAST((t_us - lo) // span AS BIGINT) AS batch, count(*) AS n, count(DISTINCT vehicle_id) > 0 AS any_vehicle, max(t_us) AS newest_us
FROM pings, (SELECT min(t_us) AS lo, (max(t_us) - min(t_us)) // 3 + 1 AS span FROM pings) b GROUP BY 1"""))
def _(spark, sf):
    """What each batch of a stream reported while it ran."""
    out, cp, told = scratch(spark, "observed"), scratch(spark, "cp"), []

    def start(pings):
        watched = accounting.observed(pings.select("vehicle_id", "t_us"), "pings", n=F.count(F.lit(1)), any_vehicle=F.bool_or(F.col("vehicle_id").isNotNull()), newest_us=F.max("t_us"))
        query = jobs.to_table(watched, out, cp, None)
        query.awaitTermination()
        told.extend(accounting.reported(query, "pings"))
        return query

    replay(spark, sf, start)
    return spark.createDataFrame([(r["batch"], r["n"], r["any_vehicle"], r["newest_us"]) for r in told], "batch long, n long, any_vehicle boolean, newest_us long")
