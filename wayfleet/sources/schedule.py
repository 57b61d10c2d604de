"""Schedule documents: weekday -> service, service -> bus -> departures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfleet.functions.clock import minute_of_day

# Keys of the weekday entries.
DAYS = ("SUNDAY", "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY")


def _entries(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.from_json("doc", "map<string,string>")).alias("key", "value"))


def load_calendar(docs: DataFrame) -> DataFrame:
    """(day, service), with ``dow`` counted from Sunday = 0."""
    dow = F.array_position(F.array(*[F.lit(d) for d in DAYS]), F.col("key")).cast("int") - 1
    return _entries(docs).filter(F.col("key").isin(*DAYS)).select(
        F.col("key").alias("day"), F.trim(F.col("value")).alias("service"), dow.alias("dow"))


def load_departures(docs: DataFrame) -> DataFrame:
    """(service, bus, seq, time_str, minute, route)."""
    buses = (_entries(docs).filter(~F.col("key").isin(*DAYS))
             .select(F.col("key").alias("service"),
                     F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("bus", "runs")))
    rows = buses.select("service", "bus", F.posexplode("runs").alias("seq", "run"))
    time = F.get("run", F.lit(0))
    return rows.select("service", "bus", "seq", time.alias("time_str"), minute_of_day(time).alias("minute"),
                       F.get("run", F.lit(1)).alias("route"))


def active_routes(docs: DataFrame) -> DataFrame:
    """Routes of the services that some weekday runs."""
    return (load_departures(docs).join(load_calendar(docs).select("service").distinct(), "service", "left_semi")
            .select("route").distinct())
