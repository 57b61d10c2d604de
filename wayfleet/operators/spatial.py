"""A hierarchical index of items on the sphere, and the search for the nearest ones on it.

Items are ordered along a space-filling curve through the three coordinates of their middle, so poles and
the date line are places like any other, and cut into leaves of 64. Every 64 neighbouring nodes
have a parent, up to at most 64 roots. A node is one row: a centre, a radius that covers all its items,
and its children (a leaf's are the items). The distance to any item of a node differs from that to its
centre by at most the radius, so a search goes down level by level: all nodes reached so far give the
best bound yet, and only children that can beat it are joined next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfleet.functions.geo import haversine_sql
from wayfleet.operators.scale import cut, lookup_join, may_broadcast

KM_PER_DEGREE = 112.0      # an upper bound, for the length of a piece of a segment
NODE_BITS = 6              # 64 children
ROOTS = 1 << NODE_BITS
PART_BITS = 18             # items of one sorted partition: three whole levels of nodes
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _unit(lat: str, lon: str) -> dict[str, str]:
    return {"x": f"cos(radians({lat})) * cos(radians({lon}))", "y": f"cos(radians({lat})) * sin(radians({lon}))", "z": f"sin(radians({lat}))"}


def _curve(lat: str, lon: str) -> Column:
    """Place on the curve: 20 bits of each coordinate of the unit vector, interleaved."""
    out = F.lit(0).cast("long")
    for i, text in enumerate(_unit(lat, lon).values()):
        bits = F.floor((F.expr(text) + 1) / 2 * (2**20 - 1)).cast("long")
        for shift, mask in SPREAD:
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask))
        out = out.bitwiseOR(F.shiftleft(bits, i))
    return out


def _node(held: DataFrame, key: Column, children: Column, name: str, lat: str, lon: str, reach: str) -> DataFrame:
    """One row per node: the mean direction of its children as centre, and how far they reach from it."""
    sums = [F.sum(F.expr(text)).alias(c) for c, text in _unit(lat, lon).items()]
    grouped = held.groupBy(key.alias("node")).agg(F.collect_list(children).alias(name), *sums)
    centred = grouped.withColumns({"lat": F.expr("degrees(atan2(z, sqrt(x * x + y * y)))"), "lon": F.expr("degrees(atan2(y, x))")})
    radius = F.expr(f"array_max(transform({name}, c -> {reach})) + 0.001D")
    return centred.select("node", "lat", "lon", radius.alias("radius"), name)


def ball_tree(items: DataFrame) -> list[DataFrame]:
    """The levels of the index of ``items`` (``lat1, lon1, lat2, lon2`` and any payload), leaves first; each is stored.

    An item covers its two ends and the straight line between them in degrees.
    """
    parts = max(1, items.count() >> PART_BITS)
    item = F.struct(*items.columns).alias("item")
    middle = {"lat": F.expr("(lat1 + lat2) / 2"), "lon": F.expr("(lon1 + lon2) / 2")}
    sorted_items = (items.select(item, "lat1", "lon1", "lat2", "lon2").withColumns(middle).withColumn("curve", _curve("lat", "lon"))
                         .repartitionByRange(parts, "curve").sortWithinPartitions("curve"))
    placed = cut(sorted_items.select("item", "lat", "lon", F.monotonically_increasing_id().alias("no")), "sorted_items")
    reach = (f"greatest({haversine_sql('lat', 'lon', 'c.lat1', 'c.lon1')}, {haversine_sql('lat', 'lon', 'c.lat2', 'c.lon2')}) "
             f"+ {KM_PER_DEGREE}D * (abs(c.lat2 - c.lat1) + abs(c.lon2 - c.lon1)) / 2")
    levels = [cut(_node(placed, F.shiftright("no", NODE_BITS), F.col("item"), "items", "lat", "lon", reach), "leaves")]
    child_reach = f"{haversine_sql('lat', 'lon', 'c.lat', 'c.lon')} + c.radius"
    while levels[-1].count() > ROOTS:
        # The numbers of a partition's nodes are used up after three levels; then whole partitions meet.
        shift = NODE_BITS if len(levels) < PART_BITS // NODE_BITS else NODE_BITS + (33 - PART_BITS if len(levels) == PART_BITS // NODE_BITS else 0)
        below = levels[-1].select("node", "lat", "lon", "radius")
        child = F.struct("node", "lat", "lon", "radius")
        levels.append(cut(_node(below, F.shiftright("node", shift), child, "children", "lat", "lon", child_reach), "nodes"))
    return levels


class BallTree:
    """The stored levels, with the roots as one row of at most 64 nodes and the checks of what may be broadcast."""

    def __init__(self, items: DataFrame, small: bool = True):
        self.levels = ball_tree(items)
        roots = self.levels[-1].agg(F.collect_list(F.struct("node", "lat", "lon", "radius")).alias("children"))
        self.roots = cut(roots.withColumn("_root", F.lit(0)), "roots")
        self.small = [small and may_broadcast(level) for level in self.levels]

    def nearest(self, positions: DataFrame, margin_km: float, measure: Callable[[str, str, str], Column]) -> DataFrame:
        """``(_lat, _lon, _found)`` for different positions: measured items, complete up to ``margin_km`` beyond the best one.

        ``measure`` makes an array of structs with ``km`` from the texts of latitude, longitude and items.
        """
        here = Window.partitionBy("_lat", "_lon")
        far = haversine_sql("_lat", "_lon", "c.lat", "c.lon")
        rows = lookup_join(positions.select("_lat", "_lon").withColumn("_root", F.lit(0)), self.roots, ["_root"], small=True)
        rows = rows.withColumn("_bound", F.lit(float("inf"))).select("_lat", "_lon", "_bound", "children")
        for i in range(len(self.levels) - 1, -1, -1):
            scored = rows.withColumn("_near", F.expr(f"transform(transform(children, c -> struct(c.node, c.radius, {far} AS km)), "
                                                     "c -> struct(c.node, c.km - c.radius AS low, c.km + c.radius AS high))"))
            scored = scored.withColumn("_bound", F.least("_bound", F.expr("array_min(transform(_near, c -> c.high))")))
            worth = scored.select("_lat", "_lon", "_bound", F.inline(F.expr(f"filter(_near, c -> c.low <= _bound + {margin_km}D)")))
            worth = worth.withColumn("_bound", F.min("_bound").over(here)).filter(F.col("low") <= F.col("_bound") + F.lit(margin_km))
            content = "children" if i else "items"
            rows = lookup_join(worth.select("_lat", "_lon", "_bound", "node"), self.levels[i].select("node", content), ["node"], small=self.small[i])
            rows = rows.select("_lat", "_lon", "_bound", content)
        hits = rows.select("_lat", "_lon", measure("_lat", "_lon", "items").alias("_hits"))
        hits = hits.withColumn("_hits", F.expr(f"filter(_hits, h -> h.km <= array_min(transform(_hits, x -> x.km)) + {margin_km + 0.001}D)"))
        return hits.groupBy("_lat", "_lon").agg(F.flatten(F.collect_list("_hits")).alias("_found"))
