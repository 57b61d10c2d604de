"""Matching positions to the route network and its stops, without cross joins.

The network is indexed by square cells at a few sizes. A cell holds every item that comes within the
level's radius of it, so a position finds its candidates with one equi-join on its cell. A result is
final when the best distance (plus the ambiguity margin) is inside that radius: nothing outside the
cell's list can matter then. Positions that are not settled try the next, coarser level. The
candidates sit in an array next to the position: no rows are multiplied and positions never shuffle
while the index is small enough to broadcast. What is left, far from everything, searches a hierarchical
index of the whole network (``spatial.BallTree``) from its roots down, each different place once, so the
answer is always that of an exhaustive search.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfleet.functions.geo import (MPH_PER_KMH, MPS_PER_MPH, along_sql, haversine_km, haversine_sql,
                                    segment_position_sql)
from wayfleet.operators.scale import cut, lookup_join, may_broadcast, require
from wayfleet.operators.spatial import BallTree
from wayfleet.sources.network import Network

# The results depend on these defaults.
AMBIGUOUS_KM = 0.020
AT_STOP_KM = 0.020

LEVELS = ((0.002, 0.1), (0.064, 3.2))
SEGMENT_COLUMNS = ("route", "polyline_idx", "segment_idx", "lat1", "lon1", "lat2", "lon2")
KM_PER_DEGREE = 111.0
TIE_DECIMALS = 9
NEAR_CELL = 0.01           # degrees; a position in one cell with a point of an item is within 1.6 km of it
CELL_LAT_LIMIT = 70.0
CELL_LON_LIMIT = 170.0
MATCHED = ("dist_to_route", "closest_lat", "closest_lon", "route", "polyline_idx", "segment_idx")


def _cell_key(level, cx: str, cy: str) -> str:
    """Level and cell coordinates packed into one long, 18 bits per coordinate."""
    return (f"(CAST({level} AS BIGINT) * {1 << 36}L + (CAST({cy} AS BIGINT) + {1 << 17}L) * {1 << 18}L "
            f"+ (CAST({cx} AS BIGINT) + {1 << 17}L))")


def cell_index(items: DataFrame, levels: Sequence[tuple[float, float]] = LEVELS) -> DataFrame:
    """``(cell, items)`` for segments given as ``lat1, lon1, lat2, lon2`` plus any payload columns.

    Long segments are laid out piece by piece, so a diagonal does not fill its bounding box.
    """
    item = F.struct(*items.columns).alias("item")
    sizes = ", ".join(f"struct({i} AS no, {size}D AS size, {radius}D AS radius)" for i, (size, radius) in enumerate(levels))
    pieces = (items.select(item, "lat1", "lon1", "lat2", "lon2", F.expr(f"inline(array({sizes}))"))
              .withColumn("n", F.expr("greatest(1, CAST(ceil(greatest(abs(lat2 - lat1), abs(lon2 - lon1)) / (size * 4)) AS INT))"))
              .withColumn("i", F.expr("explode(sequence(0, n - 1))"))
              .selectExpr("item", "no", "size", f"radius / {KM_PER_DEGREE}D AS pad",
                          "lat1 + (lat2 - lat1) * i / n AS a_lat", "lat1 + (lat2 - lat1) * (i + 1) / n AS b_lat",
                          "lon1 + (lon2 - lon1) * i / n AS a_lon", "lon1 + (lon2 - lon1) * (i + 1) / n AS b_lon")
              .filter(f"least(abs(a_lat), abs(b_lat)) - pad <= {CELL_LAT_LIMIT}")
              .withColumn("pad_lon", F.expr("pad * 1.05D / cos(radians(least(greatest(abs(a_lat), abs(b_lat)) + pad, 80D)))")))
    cells = (pieces
             .withColumn("cy", F.expr("explode(sequence(floor((least(a_lat, b_lat) - pad) / size), "
                                      "floor((greatest(a_lat, b_lat) + pad) / size)))"))
             .withColumn("cx", F.expr("explode(sequence(floor((least(a_lon, b_lon) - pad_lon) / size), "
                                      "floor((greatest(a_lon, b_lon) + pad_lon) / size)))"))
             .select(F.expr(_cell_key("no", "cx", "cy")).alias("cell"), "item"))
    return cells.groupBy("cell").agg(F.array_sort(F.collect_set("item")).alias("items"))


def near_cells(items: DataFrame, size: float) -> DataFrame:
    """``(_cell, _near)``: the cells that hold a point of an item, points being at most a cell apart on it."""
    steps = F.expr(f"CAST(ceil(greatest(abs(lat2 - lat1), abs(lon2 - lon1)) / {size}D) AS INT)")
    points = (items.select("lat1", "lon1", "lat2", "lon2", steps.alias("n")).withColumn("i", F.expr("explode(sequence(0, n))"))
                   .selectExpr("lat1 + (lat2 - lat1) * i / greatest(n, 1) AS lat", "lon1 + (lon2 - lon1) * i / greatest(n, 1) AS lon"))
    return points.select(F.expr(_cell_key(0, f"floor(lon / {size}D)", f"floor(lat / {size}D)")).alias("_cell"), F.lit(True).alias("_near")).distinct()


def _stored_index(network: Network, kind: str, levels: tuple, sieve: float | None) -> tuple[DataFrame | None, DataFrame | None, BallTree, bool]:
    """The network's cells, near cells and tree, and the checked answer to whether the cells may be broadcast."""
    items = network.segments.select(*SEGMENT_COLUMNS) if kind == "segments" else _stop_items(network.stops)
    if (kind, levels) not in network.tables:
        # A margin beyond every level leaves none; then the tree alone serves.
        cells = cut(cell_index(items, levels), "cells").withColumnRenamed("cell", "_cell") if levels else None
        near = cut(near_cells(items, sieve), "near_cells") if sieve else None
        small = network.small and all(t is None or may_broadcast(t) for t in (cells, near))
        network.tables[kind, levels] = cells, near, small
    if kind not in network.tables:
        network.tables[kind] = BallTree(items, network.small)
    cells, near, small = network.tables[kind, levels]
    return cells, near, network.tables[kind], small


def _with_hits(df: DataFrame, network: Network, kind: str, lat: str, lon: str, margin_km: float, wanted: Column,
               within_km: float | None = None) -> DataFrame:
    """Add ``_hits``: measured candidates, complete up to ``margin_km`` beyond the best one.

    With ``within_km`` they are only complete up to that distance, which takes a single level.
    """
    if within_km is None:
        levels = tuple((s, r) for s, r in LEVELS if r > 2 * margin_km)
        sieve = min([NEAR_CELL, *((r - margin_km) / KM_PER_DEGREE / 1.6 for _, r in levels[-1:])]) if levels else None
    else:
        levels, sieve = ((max(0.002, within_km / KM_PER_DEGREE), within_km * 1.01),), None
    cells, near, tree, small = _stored_index(network, kind, levels, sieve)
    measure = (_measure_segments if kind == "segments" else _measure_points)
    inside = f"(abs({lat}) <= {CELL_LAT_LIMIT} AND abs({lon}) <= {CELL_LON_LIMIT})"
    df = df.withColumn("_open", wanted & F.expr(f"{lat} IS NOT NULL AND {lon} IS NOT NULL AND NOT isnan({lat}) AND NOT isnan({lon})"))
    cell = lambda no, size: F.expr(f"CASE WHEN _open AND {inside} THEN {_cell_key(no, f'floor({lon} / {size}D)', f'floor({lat} / {size}D)')} END")
    by_cell, far = df, df
    if sieve:  # most positions are near the network: they are not looked up a second time
        far = lookup_join(far.withColumn("_cell", cell(0, sieve)), near, ["_cell"], small=small).filter("_open AND _near IS NULL").drop("_cell", "_near")
    if within_km is not None:
        far = far.filter(f"_open AND NOT {inside}")
    settle = lambda part: _by_cells(part, cells, cell, levels, measure(lat, lon), inside, margin_km, within_km, small)
    near_rows = settle(by_cell)
    if far.isEmpty():  # asked before the plan of the search is laid out, which is as long as all the rest
        return near_rows.drop("_open")
    far = settle(far).filter("_open").withColumns({"_lat": F.col(lat), "_lon": F.col(lon)})
    found = tree.nearest(far.select("_lat", "_lon").distinct(), margin_km, measure)
    far = lookup_join(far.drop("_hits"), found, ["_lat", "_lon"], small=False).withColumnRenamed("_found", "_hits")
    return near_rows.filter("NOT _open").unionByName(far.drop("_lat", "_lon")).drop("_open")


def _by_cells(df: DataFrame, cells: DataFrame | None, cell: Callable[[int, float], Column], levels: tuple, measure: Column, inside: str,
              margin_km: float, within_km: float | None, small: bool) -> DataFrame:
    """Add ``_hits`` from the cell levels; ``_open`` stays set where they don't settle the position."""
    for no, (size, radius) in enumerate(levels):
        df = lookup_join(df.withColumn("_cell", cell(no, size)), cells, ["_cell"], small=small)
        got = F.when(F.col("_open"), measure)
        df = df.withColumn("_hits", got if no == 0 else got.otherwise(F.col("_hits"))).drop("_cell", "items")
        settled = inside if within_km is not None else f"coalesce(array_min(_hits).km + {margin_km}D <= {radius}D, false)"
        df = df.withColumn("_open", F.expr(f"_open AND NOT {settled}"))
    return df if levels else df.withColumn("_hits", F.lit(None))


def _measure_segments(lat: str, lon: str, items: str = "items") -> Column:
    """Array of segments -> array of (tie, route, polyline_idx, segment_idx, km, lat, lon)."""
    placed = (f"transform({items}, s -> struct(s, "
              f"{segment_position_sql(lat, lon, 's.lat1', 's.lon1', 's.lat2', 's.lon2')} AS t))")
    points = (f"transform({placed}, p -> struct(p.s, {along_sql('p.s.lat1', 'p.s.lat2', 'p.t')} AS lat, "
              f"{along_sql('p.s.lon1', 'p.s.lon2', 'p.t')} AS lon))")
    far = f"transform({points}, p -> struct(p.s, p.lat, p.lon, {haversine_sql(lat, lon, 'p.lat', 'p.lon')} AS km))"
    return F.expr(f"transform({far}, p -> struct(round(p.km, {TIE_DECIMALS}) AS tie, p.s.route, p.s.polyline_idx, "
                  "p.s.segment_idx, p.km, p.lat, p.lon))")


def _measure_points(lat: str, lon: str, items: str = "items") -> Column:
    """Array of stops -> array of (tie, route, stop_ord, stop_name, km)."""
    far = f"transform({items}, s -> struct(s, {haversine_sql(lat, lon, 's.lat1', 's.lon1')} AS km))"
    return F.expr(f"transform({far}, p -> struct(round(p.km, {TIE_DECIMALS}) AS tie, p.s.route, p.s.stop_ord, "
                  "p.s.stop_name, p.km))")


def match_route(pings: DataFrame, network: Network, threshold: float = AMBIGUOUS_KM,
                lat: str = "latitude", lon: str = "longitude", only_missing: bool = False) -> DataFrame:
    """Nearest point of the network for every position.

    When a second polyline lies within ``threshold`` km of the best distance the match is ambiguous:
    if all such polylines belong to one route the route, distance and point stay and the polyline and
    segment become NULL, otherwise everything is NULL. Ties go to the first route, polyline and
    segment. ``only_missing`` matches just the rows whose ``route`` is NULL and leaves the others.
    """
    require(pings, lat, lon, *(MATCHED if only_missing else ()))
    wanted = F.col("route").isNull() if only_missing else F.lit(True)
    df = pings.withColumn("_wanted", wanted)
    found = _with_hits(df, network, "segments", lat, lon, threshold, F.col("_wanted"))
    found = found.withColumn("_best", F.array_min("_hits"))
    found = found.withColumn("_close", F.expr(f"filter(_hits, h -> h.km - _best.km < {threshold}D)"))
    found = found.withColumns({
        "_sure": F.expr("size(array_distinct(transform(_close, h -> struct(h.route, h.polyline_idx)))) = 1"),
        "_one": F.expr("size(array_distinct(transform(_close, h -> h.route))) = 1")})
    fresh = {"dist_to_route": "CASE WHEN _one THEN _best.km END", "closest_lat": "CASE WHEN _one THEN _best.lat END",
             "closest_lon": "CASE WHEN _one THEN _best.lon END", "route": "CASE WHEN _one THEN _best.route END",
             "polyline_idx": "CASE WHEN _sure THEN _best.polyline_idx END",
             "segment_idx": "CASE WHEN _sure THEN _best.segment_idx END"}
    if only_missing:
        fresh = {c: f"CASE WHEN _wanted THEN {v} ELSE {c} END" for c, v in fresh.items()}
    return found.withColumns({c: F.expr(v) for c, v in fresh.items()}).drop(
        "_wanted", "_hits", "_best", "_close", "_sure", "_one")


def match_target_polyline(pings: DataFrame, network: Network, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Place rows that know their polyline but not their segment, on that polyline alone."""
    require(pings, lat, lon, *MATCHED)
    lines = (network.segments.groupBy("route", "polyline_idx")
             .agg(F.array_sort(F.collect_list(F.struct(
                 *SEGMENT_COLUMNS))).alias("_items"))
             .withColumnsRenamed({"route": "_r", "polyline_idx": "_p"}))
    todo = F.col("route").isNotNull() & F.col("polyline_idx").isNotNull() & F.col("segment_idx").isNull()
    df = pings.withColumns({"_todo": todo, "_r": F.when(todo, F.col("route")), "_p": F.when(todo, F.col("polyline_idx"))})
    df = lookup_join(df, lines, ["_r", "_p"], small=network.small)
    df = df.withColumn("_best", F.array_min(_measure_segments(lat, lon, "_items")))
    fresh = {"dist_to_route": "_best.km", "closest_lat": "_best.lat", "closest_lon": "_best.lon",
             "segment_idx": "_best.segment_idx"}
    return df.withColumns({c: F.when(F.col("_todo"), F.col(v)).otherwise(F.col(c)) for c, v in fresh.items()}).drop(
        "_todo", "_r", "_p", "_items", "_best")


def _stop_items(stops: DataFrame) -> DataFrame:
    return stops.select("route", "stop_ord", "stop_name", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"),
                        F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))


def match_stop(pings: DataFrame, network: Network, threshold: float = AT_STOP_KM,
               lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Nearest stop of any route if it is closer than ``threshold`` km; ties go to the first one listed."""
    require(pings, lat, lon)
    found = _with_hits(pings, network, "stops", lat, lon, 0.0, F.lit(True), within_km=threshold).withColumn("_best", F.array_min("_hits"))
    hit = F.col("_best.km") < threshold
    return found.withColumns({"stop_route": F.when(hit, F.col("_best.route")),
                              "stop_name": F.when(hit, F.col("_best.stop_name"))}).drop("_hits", "_best")


def nearest_stop(points: DataFrame, network: Network, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Nearest stop at any distance: ``nearest_route, nearest_stop, nearest_km``."""
    require(points, lat, lon)
    found = _with_hits(points, network, "stops", lat, lon, 0.0, F.lit(True))
    best = F.array_min("_hits")
    return (found.withColumn("_best", best)
                 .withColumns({"nearest_route": F.col("_best.route"), "nearest_stop": F.col("_best.stop_name"),
                               "nearest_km": F.col("_best.km")}).drop("_hits", "_best"))


def polyline_progress(pings: DataFrame, network: Network, rematch: bool = True,
                      lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """``dist_from_start, dist_to_end, polyline_length`` of the matched point along its polyline.

    Rows with an incomplete match are matched again first; what still has no segment gets NULLs.
    """
    require(pings, lat, lon, *MATCHED)
    df = pings
    names = {c: c for c in MATCHED}
    if rematch:
        lacking = F.lit(False)
        for c in MATCHED:
            lacking = lacking | F.col(c).isNull()
        kept = df.withColumns({f"_old_{c}": F.col(c) for c in MATCHED}).withColumn("_lacking", lacking)
        again = match_route(kept.withColumn("route", F.when(~F.col("_lacking"), F.col("route"))),
                            network, lat=lat, lon=lon, only_missing=True)
        df = again.withColumnsRenamed({c: f"_m_{c}" for c in MATCHED}).withColumnsRenamed(
            {f"_old_{c}": c for c in MATCHED})
        names = {c: f"_m_{c}" for c in MATCHED}
    starts = network.measured.select(
        F.col("route").alias("_r"), F.col("polyline_idx").alias("_p"), F.col("segment_idx").alias("_s"),
        F.col("lat1").alias("_lat1"), F.col("lon1").alias("_lon1"), "cum_start", "polyline_km")
    df = df.withColumns({"_r": F.col(names["route"]), "_p": F.col(names["polyline_idx"]), "_s": F.col(names["segment_idx"])})
    df = lookup_join(df, starts, ["_r", "_p", "_s"], small=network.small)
    into = haversine_km("_lat1", "_lon1", names["closest_lat"], names["closest_lon"])
    known = F.col("cum_start").isNotNull() & F.col(names["closest_lat"]).isNotNull()
    df = df.withColumn("dist_from_start", F.when(known, F.greatest(
        F.lit(0.0), F.least(F.col("cum_start") + into, F.col("polyline_km")))))
    df = df.withColumns({"dist_to_end": F.col("polyline_km") - F.col("dist_from_start"),
                         "polyline_length": F.when(known, F.col("polyline_km"))})
    drop = ["_r", "_p", "_s", "_lat1", "_lon1", "cum_start", "polyline_km", "_lacking"]
    return df.drop(*drop, *([f"_m_{c}" for c in MATCHED] if rematch else []))


def dead_reckon(positions: DataFrame, network: Network, seconds: float = 5.0) -> DataFrame:
    """Where a vehicle will be on its polyline after ``seconds`` at its speed.

    Needs ``route, polyline_idx, dist_from_start`` and ``speed_mph``; ``predicted_kmh`` wins when it
    is there. The polyline's segments travel as one array per polyline, so the containing segment is
    picked inside the row.
    """
    require(positions, "route", "polyline_idx", "dist_from_start", "speed_mph", "predicted_kmh")
    lines = (network.measured.groupBy("route", "polyline_idx")
             .agg(F.array_sort(F.collect_list(F.struct(
                 "segment_idx", "cum_start", "cum_end", "seg_km", "lat1", "lon1", "lat2", "lon2"))).alias("_line"),
                  F.max("polyline_km").alias("_total")))
    df = lookup_join(positions, lines, ["route", "polyline_idx"], small=network.small)
    metres = (f"coalesce(nullif(predicted_kmh, 0D) * {MPH_PER_KMH}D, speed_mph) * {MPS_PER_MPH}D * {float(seconds)}D")
    df = df.withColumn("_at", F.expr(
        f"CASE WHEN dist_from_start + {metres} IS NOT NULL THEN greatest(0D, least(dist_from_start + {metres} / 1000, _total)) END"))
    df = df.withColumn("_seg", F.expr(
        "CASE WHEN _at IS NOT NULL THEN coalesce(get(filter(_line, s -> _at <= s.cum_end), 0), element_at(_line, -1)) END"))
    df = df.withColumn("_share", F.expr(
        "CASE WHEN _seg.seg_km > 0 THEN least(1D, (_at - _seg.cum_start) / _seg.seg_km) WHEN _at IS NOT NULL THEN 0D END"))
    return df.withColumns({"target_km": F.col("_at"), "target_segment": F.col("_seg.segment_idx"),
                           "target_lat": F.expr(along_sql("_seg.lat1", "_seg.lat2", "_share")),
                           "target_lon": F.expr(along_sql("_seg.lon1", "_seg.lon2", "_share"))}
                          ).drop("_line", "_total", "_at", "_seg", "_share")
