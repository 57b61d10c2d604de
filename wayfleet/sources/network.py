"""Route network: documents to typed tables, and the derived geometry."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfleet.functions.geo import haversine_km
from wayfleet.operators.scale import cut, fits, require

NETWORK_ROWS = 50_000


@dataclass
class Network:
    """The tables the operators match against.

    ``segments(route, polyline_idx, segment_idx, lat1, lon1, lat2, lon2)``,
    ``stops(route, stop_name, stop_ord, lat, lon)`` and
    ``polyline_stops(route, polyline_idx, stop_name)``.
    """

    segments: DataFrame
    stops: DataFrame
    polyline_stops: DataFrame

    @cached_property
    def small(self) -> bool:
        """Checked once: whether the network may be broadcast."""
        return all(fits(t, NETWORK_ROWS) for t in (self.segments, self.stops, self.polyline_stops))

    @cached_property
    def measured(self) -> DataFrame:
        return cut(cumulative_km(self.segments), "measured")

    @cached_property
    def tables(self) -> dict:
        """Indexes built from the network, stored once and shared by every later match."""
        return {}

    def stored(self) -> Network:
        """The same network read back from the shared folder."""
        return Network(cut(self.segments, "segments"), cut(self.stops, "stops"),
                       cut(self.polyline_stops, "polyline_stops"))


def read_documents(spark, path: str) -> DataFrame:
    """Whole-file route documents, one ``doc`` string per file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "doc")


def _routes(docs: DataFrame) -> DataFrame:
    """One row per route of every document, its attributes still as JSON text."""
    return (docs.select(F.posexplode(F.from_json("doc", "map<string,string>")).alias("route_ord", "route", "_body"))
                .select("route_ord", "route", F.from_json("_body", "map<string,string>").alias("attrs")))


def load_vertices(docs: DataFrame) -> DataFrame:
    """(route, polyline_idx, vertex_idx, lat, lon)."""
    lines = _routes(docs).select(
        "route", F.posexplode(F.from_json(F.col("attrs")["ROUTES"], "array<array<array<double>>>"))
        .alias("polyline_idx", "_line"))
    return (lines.select("route", "polyline_idx", F.posexplode("_line").alias("vertex_idx", "_p"))
                 .select("route", "polyline_idx", "vertex_idx",
                         F.get("_p", F.lit(0)).alias("lat"), F.get("_p", F.lit(1)).alias("lon")))


def segments_of(vertices: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Consecutive vertex pairs per polyline; a polyline of one vertex gives one zero-length segment."""
    require(vertices, "route", "polyline_idx", "vertex_idx", "lat", "lon")
    if active is not None:
        vertices = vertices.join(active.select("route").distinct(), "route", "left_semi")
    line = Window.partitionBy("route", "polyline_idx").orderBy("vertex_idx")
    ends = vertices.select(
        "route", "polyline_idx", F.col("vertex_idx").alias("segment_idx"),
        F.col("lat").alias("lat1"), F.col("lon").alias("lon1"),
        F.lead("lat").over(line).alias("lat2"), F.lead("lon").over(line).alias("lon2"),
        F.lag("lat").over(line).isNull().alias("_first"))
    return (ends.filter(F.col("lat2").isNotNull() | F.col("_first"))
                .withColumns({"lat2": F.coalesce("lat2", "lat1"), "lon2": F.coalesce("lon2", "lon1")})
                .drop("_first"))


def load_network(docs: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """Segments of the routes a schedule runs (of all routes without one)."""
    return segments_of(load_vertices(docs), schedule)


def load_stops(docs: DataFrame) -> DataFrame:
    """One row per (route, stop) in file order; ``stop_ord`` counts within the route."""
    listed = _routes(docs).select(
        "route_ord", "route", "attrs",
        F.posexplode(F.from_json(F.col("attrs")["STOPS"], "array<string>")).alias("stop_ord", "stop_name"))
    info = F.from_json(F.element_at("attrs", F.col("stop_name")),
                       "COORDINATES array<double>, OFFSET int, NAME string")
    return listed.withColumn("_i", info).select(
        "route_ord", "route", "stop_ord", "stop_name",
        F.get("_i.COORDINATES", F.lit(0)).alias("lat"), F.get("_i.COORDINATES", F.lit(1)).alias("lon"),
        F.col("_i.OFFSET").alias("offset_min"), F.col("_i.NAME").alias("label"))


def load_polyline_stops(docs: DataFrame) -> DataFrame:
    return _routes(docs).select(
        "route", F.posexplode(F.from_json(F.col("attrs")["POLYLINE_STOPS"], "array<string>"))
        .alias("polyline_idx", "stop_name"))


def cumulative_km(segments: DataFrame) -> DataFrame:
    """Segments with their length, the distance at their start and end, and the polyline's length."""
    line = Window.partitionBy("route", "polyline_idx")
    upto = line.orderBy("segment_idx").rowsBetween(Window.unboundedPreceding, 0)
    return (segments.withColumn("seg_km", haversine_km("lat1", "lon1", "lat2", "lon2"))
                    .withColumn("cum_end", F.sum("seg_km").over(upto))
                    .withColumn("cum_start", F.col("cum_end") - F.col("seg_km"))
                    .withColumn("polyline_km", F.sum("seg_km").over(line)))


def flatten_route_vertices(vertices: DataFrame) -> DataFrame:
    """All vertices of a route as one ordered list (a route is a bounded, published shape)."""
    ordered = F.array_sort(F.collect_list(F.struct("polyline_idx", "vertex_idx", "lat", "lon")))
    return vertices.groupBy("route").agg(
        F.transform(ordered, lambda v: F.struct(v["lat"].alias("lat"), v["lon"].alias("lon"))).alias("path"))


def vertices_per_polyline(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("route", "polyline_idx").agg(F.count("*").alias("n_vertices"))


def stop_list_per_route(stops: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("stop_ord", "stop_name")))
    return stops.groupBy("route").agg(F.transform(ordered, lambda s: s["stop_name"]).alias("stop_names"))
