"""Column functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import fixture as fx
from queries.enrichment import rounded
from queries.oracle import hav, share, sql
from queries.registry import query, stage
from wayfleet.functions import clock, geo, text
from wayfleet.operators import forecast, live
from wayfleet.sources import feeds

# Instants over several years, so both clock changes occur.
INSTANTS = "SELECT o_orderkey AS id, o_orderdate + INTERVAL 1 MINUTE * (o_orderkey % 1440) AS at_ FROM orders"


def instants(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderkey AS id", "CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(0, 0, CAST(o_orderkey % 1440 AS INT)) AS at_")


@query("s1_epoch_seconds", "SELECT event_id, round((epoch_us(ts) - 1735689600000000) / 1e6, 6) AS epoch_seconds FROM events")
def _(spark, sf):
    return rounded(fx.events(spark, sf).select("event_id", clock.epoch_seconds("ts").alias("epoch_seconds")), ["epoch_seconds"])


@query("s2_s3_haversine_km", sql("pings segments", f"""
SELECT ping_id, round({hav('latitude', 'longitude', '42.7325e0', '-73.676e0')}, 6) AS km FROM pings"""))
def _(spark, sf):
    return stage(spark, sf, "pings").select("ping_id", F.round(geo.haversine_km("latitude", "longitude", "42.7325D", "-73.676D"), 6).alias("km"))


@query("s4_haversine_m", sql("pings", f"""
SELECT ping_id, round({hav('latitude', 'longitude', '42.7e0', '-73.6e0', 6371000.0)}, 3) AS m FROM pings"""))
def _(spark, sf):
    return stage(spark, sf, "pings").select("ping_id", F.round(geo.haversine_m("latitude", "longitude", "42.7D", "-73.6D"), 3).alias("m"))


LINE = ["42.730137D", "-73.680291D", "42.741713D", "-73.669877D"]


@query("s5_project_to_segment", sql("pings", f"""
SELECT ping_id, round(t, 6) AS t, round(42.730137e0 + t * (42.741713e0 - 42.730137e0), 6) AS lat, round(-73.680291e0 + t * (-73.669877e0 + 73.680291e0), 6) AS lon
FROM (SELECT ping_id, {share('latitude', 'longitude')} AS t
      FROM (SELECT *, 42.730137e0 AS lat1, -73.680291e0 AS lon1, 42.741713e0 AS lat2, -73.669877e0 AS lon2 FROM pings) p) x"""))
def _(spark, sf):
    t = geo.segment_position("latitude", "longitude", *LINE)
    df = stage(spark, sf, "pings").select("ping_id", t.alias("t"))
    return df.select("ping_id", F.round("t", 6).alias("t"),
                     F.round(F.expr(geo.along_sql(LINE[0], LINE[2], "t")), 6).alias("lat"),
                     F.round(F.expr(geo.along_sql(LINE[1], LINE[3], "t")), 6).alias("lon"))


@query("s6_service_day_start", sql("", """
SELECT id, epoch_us((date_trunc('day', (at_ AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') AS midnight_us,
       epoch_us((date_trunc('day', (at_ AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' - INTERVAL 4 HOUR) + INTERVAL 4 HOUR) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC') AS four_us
FROM instants""", instants=INSTANTS))
def _(spark, sf):
    return instants(spark, sf).select("id", F.unix_micros(clock.service_day_start("at_")).alias("midnight_us"),
                                      F.unix_micros(clock.service_day_start("at_", start_seconds=4 * 3600)).alias("four_us"))


@query("s7_parse_iso", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN epoch_us(ts) END AS t_us FROM events", "t_us")
def _(spark, sf):
    txt = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("not a time "), F.col("event_id").cast("string"))).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return fx.events(spark, sf).select("event_id", F.unix_micros(clock.parse_iso(txt)).alias("t_us"))


@query("s8_clock_strings", sql("departures", """
SELECT seq, CASE WHEN seq % 50 <> 0 THEN minute END AS minute,
       concat(CAST((minute // 60 + 11) % 12 + 1 AS VARCHAR), ':', lpad(CAST(minute % 60 AS VARCHAR), 2, '0'), CASE WHEN minute < 720 THEN ' AM' ELSE ' PM' END) AS text
FROM departures"""), "minute")
def _(spark, sf):
    d = fx.derive(spark, sf, "departures").withColumn("text", clock.clock_text(F.col("minute")))
    shown = F.when(F.col("seq") % 50 == 0, F.lit("noon")).otherwise(F.concat(F.lit(" "), F.lower("text")))
    return d.select("seq", "text", clock.minute_of_day(shown).alias("minute"))


CALENDAR = [("SUNDAY", "1-URGENT", 0), ("MONDAY", "2-HIGH", 1), ("TUESDAY", "3-MEDIUM", 2), ("WEDNESDAY", "4-NOT SPECIFIED", 3),
            ("THURSDAY", "5-LOW", 4), ("FRIDAY", "1-URGENT", 5), ("SATURDAY", "2-HIGH", 6)]
CALENDAR_SQL = "SELECT * FROM (VALUES " + ", ".join(str(r) for r in CALENDAR) + ") c(day, service, dow)"


def calendar(spark):
    return spark.createDataFrame(CALENDAR, "day string, service string, dow int")


@query("s9_service_of_day", sql("", "SELECT id, service FROM instants JOIN calendar ON day = upper(dayname(at_))", instants=INSTANTS, calendar=CALENDAR_SQL))
def _(spark, sf):
    named = instants(spark, sf).withColumn("day", clock.day_name("at_"))
    return named.join(F.broadcast(calendar(spark)), "day").select("id", "service")


@query("s10_floor_to_minute", "SELECT event_id, epoch_us(date_trunc('minute', ts)) AS minute_us FROM events")
def _(spark, sf):
    return fx.events(spark, sf).select("event_id", F.unix_micros(clock.to_minute("ts")).alias("minute_us"))


@query("s11_unit_conversion", sql("l2", """
SELECT ping_id, round(speed_kmh, 4) AS kmh, round(speed_kmh * 0.621371, 4) AS mph, round(speed_kmh * 0.621371 * 0.44704, 4) AS mps FROM l2"""))
def _(spark, sf):
    df = stage(spark, sf, "l2").withColumn("mph", geo.kmh_to_mph("speed_kmh"))
    df = df.withColumn("mps", geo.mph_to_mps("mph")).withColumn("kmh", F.col("speed_kmh"))
    return rounded(df.select("ping_id", "kmh", "mph", "mps"), ["kmh", "mph", "mps"], 4)


@query("s12_clamps", "SELECT event_id, greatest(0e0, 50 - value) AS floored, greatest(1, least(60, value)) AS cadence FROM events")
def _(spark, sf):
    return fx.events(spark, sf).select("event_id", geo.non_negative("50 - value").alias("floored"), geo.clamp("value", 1.0, 60.0).alias("cadence"))


@query("s13_route_if_close", sql("l3", """
SELECT ping_id, CASE WHEN dist_to_route < 0.05 THEN route END AS route_name, stop_name IS NOT NULL AS is_at_stop FROM l3"""))
def _(spark, sf):
    return stage(spark, sf, "l3").select("ping_id", geo.route_if_close("route", "dist_to_route").alias("route_name"),
                                         F.col("stop_name").isNotNull().alias("is_at_stop"))


@query("s14_data_age", sql("pings", """
SELECT min(t) AS oldest_us, round((1704067925000000 - min(t)) / 1e6, 6) AS age_seconds,
       CASE WHEN (1704067925000000 - min(t)) / 1e6 < 10 THEN 'Live' WHEN (1704067925000000 - min(t)) / 1e6 < 30 THEN 'Delayed' ELSE 'Stale' END AS label
FROM (SELECT vehicle_id, max(t_us) AS t FROM pings GROUP BY vehicle_id) v"""))
def _(spark, sf):
    return rounded(live.data_age(stage(spark, sf, "pings"), F.timestamp_micros(F.lit(1704067925000000))), ["age_seconds"])


@query("s14_age_labels", """
SELECT event_id, CASE WHEN value < 10 THEN 'Live' WHEN value < 30 THEN 'Delayed' ELSE 'Stale' END AS label FROM events""")
def _(spark, sf):
    return fx.events(spark, sf).select("event_id", clock.data_age_label(F.col("value")).alias("label"))


@query("s15_clean_features", sql("l4", """
SELECT ping_id, round(coalesce(speed_kmh, 0), 4) AS speed_kmh, round(coalesce(dist_to_end, 0), 6) AS dist_to_end, 0e0 AS heading FROM l4 WHERE eta_seconds IS NOT NULL"""))
def _(spark, sf):
    df = forecast.clean_features(stage(spark, sf, "l4"), ["speed_kmh", "dist_to_end", "heading"], ["eta_seconds"])
    return rounded(rounded(df.select("ping_id", "speed_kmh", "dist_to_end", "heading"), ["speed_kmh"], 4), ["dist_to_end"])


KEY = b"a shared secret"
_PAD = lambda byte: bytes(k ^ byte for k in KEY.ljust(64, b"\0")).hex()
DIGEST = (f"sha256(unhex('{_PAD(0x5C)}') || unhex(sha256(unhex('{_PAD(0x36)}') || encode(concat('v1:', CAST(event_id AS VARCHAR), ':', props)))))")


@query("s16_verify_signature", f"SELECT event_id, concat('v1=', {DIGEST}) AS signature FROM events WHERE event_id % 3 = 0")
def _(spark, sf):
    body, ts = F.col("props"), F.col("event_id").cast("string")
    right = F.concat(F.lit("v1="), text.hmac_sha256(KEY, F.concat(F.lit("v1:"), ts, F.lit(":"), body)))
    signed = fx.events(spark, sf).select("event_id", ts.alias("ts"), body.alias("body"),
                                         F.when(F.col("event_id") % 3 == 0, right).when(F.col("event_id") % 3 == 1, F.lit("v1=00")).alias("signature"))
    return feeds.verified(signed, KEY).select("event_id", "signature")


MESSAGE = "concat('Stop ', event_id, ' moved, see [map ', event_id, '](https://maps.example/', event_id, ') or [old](http://x/', user_id, ')')"


@query("s17_links", f"""
SELECT event_id, t.n AS n, regexp_extract_all(m, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 1)[t.n] AS text, regexp_extract_all(m, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 2)[t.n] AS url,
       starts_with(regexp_extract_all(m, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 2)[t.n], 'https://') AS is_link,
       concat('Stop ', event_id, ' moved, see map ', event_id, ' or old (http://x/', user_id, ')') AS plain
FROM (SELECT event_id, user_id, {MESSAGE} AS m FROM events) e CROSS JOIN (VALUES (1), (2)) t(n)""")
def _(spark, sf):
    df = fx.events(spark, sf).select("event_id", F.expr(MESSAGE).alias("m"))
    df = df.select("event_id", text.plain_message(F.col("m")).alias("plain"), F.posexplode(text.links(F.col("m"))).alias("n", "l"))
    return df.select("event_id", "plain", (F.col("n") + 1).alias("n"), "l.text", "l.url", "l.is_link")


@query("s18_string_id", "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id FROM events")
def _(spark, sf):
    return feeds.string_id(fx.events(spark, sf).select("event_id", "user_id"), "event_id", "user_id")


@query("s19_progress_percent", sql("l3", "SELECT ping_id, round(dist_from_start / nullif(polyline_length, 0) * 100, 4) AS percent FROM l3"))
def _(spark, sf):
    return stage(spark, sf, "l3").select("ping_id", F.round(geo.progress_percent("dist_from_start", "polyline_length"), 4).alias("percent"))
