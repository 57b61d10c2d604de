"""Raw inputs: the ping table and the vendor's JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfleet.functions.clock import parse_iso
from wayfleet.functions.text import signature_ok
from wayfleet.operators.scale import require

# Payload shapes.
GPS = ("latitude double, longitude double, time string, speedMilesPerHour double, headingDegrees double, "
       "isEcuSpeed boolean, reverseGeo struct<formattedLocation:string>, address struct<id:string,name:string>")
GPS_STRUCT = "struct<" + ",".join(part.strip().replace(" ", ":", 1) for part in GPS.split(", ")) + ">"
PAGE = "pagination struct<hasNextPage:boolean,endCursor:string>"
FEED_SCHEMA = f"data array<struct<id:string,name:string,gps:{GPS_STRUCT}>>, {PAGE}"
FEED_ARRAY_SCHEMA = f"data array<struct<id:string,name:string,gps:array<{GPS_STRUCT}>>>, {PAGE}"
ASSIGNMENT_SCHEMA = ("data array<struct<assignedAtTime:string,driver:struct<id:string,name:string>,"
                     f"vehicle:struct<id:string>>>, {PAGE}")
FENCE = ("struct<vehicle:struct<id:string,name:string,licensePlate:string,vin:string,assetType:string,"
         "externalIds:struct<maintenanceId:string>,gateway:struct<model:string,serial:string>>,"
         "address:struct<name:string,formattedAddress:string,"
         "geofence:struct<polygon:struct<vertices:array<struct<latitude:double,longitude:double>>>>>>")
GEOFENCE_SCHEMA = ("eventId string, eventTime string, eventType string, data struct<conditions:array<struct<"
                   f"details:struct<geofenceEntry:{FENCE},geofenceExit:{FENCE}>>>>")
PING_COLUMNS = ("vehicle_id", "latitude", "longitude", "timestamp")


def read_pings(spark: SparkSession, path: str, **sources: str) -> DataFrame:
    """The four analytic columns of a stored ping table; ``sources`` maps a column to its SQL expression.

    No order is imposed: order is a matter of the windows that need it.
    """
    raw = spark.read.parquet(path)
    return raw.select(F.expr(sources.get("vehicle_id", "vehicle_id")).cast("string").alias("vehicle_id"),
                      F.expr(sources.get("latitude", "latitude")).cast("double").alias("latitude"),
                      F.expr(sources.get("longitude", "longitude")).cast("double").alias("longitude"),
                      F.expr(sources.get("timestamp", "timestamp")).cast("timestamp").alias("timestamp"))


def read_pings_jdbc(spark: SparkSession, table: str, properties: dict, partition: dict | None = None) -> DataFrame:
    """The same four columns from a database; ``partition`` gives Spark's JDBC partitioning options."""
    options = {**properties, "dbtable": table, **(partition or {})}
    return spark.read.format("jdbc").options(**options).load().select(*PING_COLUMNS)


def pings_window(pings: DataFrame, day_start: Column, since: Column | None = None) -> DataFrame:
    """Rows after ``since`` (exclusive) when it is given, else from ``day_start`` on (inclusive)."""
    return pings.filter(F.col("timestamp") > since if since is not None else F.col("timestamp") >= day_start)


def _filled(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def flatten_gps_feed(raw: DataFrame, body: str = "body", array_form: bool = False) -> DataFrame:
    """One row per vehicle reading; entries without id, position or time are skipped."""
    schema = FEED_ARRAY_SCHEMA if array_form else FEED_SCHEMA
    rows = raw.select(F.explode(F.from_json(body, schema)["data"]).alias("v"))
    if array_form:
        rows = rows.select(F.col("v.id").alias("id"), F.col("v.name").alias("name"), F.explode("v.gps").alias("g"))
    else:
        rows = rows.select(F.col("v.id").alias("id"), F.col("v.name").alias("name"), F.col("v.gps").alias("g"))
    return rows.filter(_filled("id") & F.col("g").isNotNull() & _filled("g.time")).select(
        F.col("id").alias("vehicle_id"), "name", parse_iso("g.time").alias("timestamp"),
        F.col("g.latitude").alias("latitude"), F.col("g.longitude").alias("longitude"),
        F.col("g.headingDegrees").alias("heading_degrees"), F.col("g.speedMilesPerHour").alias("speed_mph"),
        F.coalesce("g.isEcuSpeed", F.lit(False)).alias("is_ecu_speed"),
        F.col("g.reverseGeo.formattedLocation").alias("formatted_location"),
        F.col("g.address.id").alias("address_id"), F.col("g.address.name").alias("address_name"))


def flatten_geofence_payloads(raw: DataFrame, body: str = "body") -> DataFrame:
    """One row per condition with a vehicle; the position is the first vertex of the fence."""
    e = raw.select(F.from_json(body, GEOFENCE_SCHEMA).alias("e"))
    c = e.select(F.col("e.eventId").alias("id"), parse_iso("e.eventTime").alias("event_time"),
                 F.posexplode("e.data.conditions.details").alias("condition_ord", "d"))
    entry = F.col("d.geofenceEntry").isNotNull()
    c = c.withColumns({"event_type": F.when(entry, "geofenceEntry").otherwise("geofenceExit"),
                       "f": F.when(entry, F.col("d.geofenceEntry")).otherwise(F.col("d.geofenceExit"))})
    corner = F.get(F.col("f.address.geofence.polygon.vertices"), F.lit(0))
    return c.filter(_filled("f.vehicle.id") & _filled("f.vehicle.name")).select(
        "id", "condition_ord", "event_type", "event_time", F.col("f.vehicle.id").alias("vehicle_id"),
        F.col("f.vehicle.name").alias("vehicle_name"),
        F.coalesce("f.vehicle.assetType", F.lit("vehicle")).alias("asset_type"),
        F.col("f.vehicle.licensePlate").alias("license_plate"), F.col("f.vehicle.vin").alias("vin"),
        F.col("f.vehicle.externalIds.maintenanceId").alias("maintenance_id"),
        F.col("f.vehicle.gateway.model").alias("gateway_model"),
        F.col("f.vehicle.gateway.serial").alias("gateway_serial"),
        F.col("f.address.name").alias("address_name"), F.col("f.address.formattedAddress").alias("address_formatted"),
        corner["latitude"].alias("latitude"), corner["longitude"].alias("longitude"))


def flatten_assignments(raw: DataFrame, batch_ts: Column, body: str = "body") -> DataFrame:
    """(driver_id, driver_name, vehicle_id, assigned_at); a missing time means the batch's time."""
    rows = raw.select(F.explode(F.from_json(body, ASSIGNMENT_SCHEMA)["data"]).alias("a"))
    return rows.filter(_filled("a.driver.id") & _filled("a.vehicle.id")).select(
        F.col("a.driver.id").alias("driver_id"), F.col("a.driver.name").alias("driver_name"),
        F.col("a.vehicle.id").alias("vehicle_id"),
        F.coalesce(parse_iso("a.assignedAtTime"), batch_ts).alias("assigned_at"))


def verified(raw: DataFrame, key: bytes, ts: str = "ts", body: str = "body", signature: str = "signature") -> DataFrame:
    """Payloads whose signature matches their body."""
    require(raw, ts, body, signature)
    return raw.filter(signature_ok(key, F.col(ts), F.col(body), F.col(signature)))


def string_id(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})
