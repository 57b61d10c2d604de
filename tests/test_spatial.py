import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfleet.operators import matching, spatial

ITEMS = "route string, stop_ord int, stop_name string, lat1 double, lon1 double, lat2 double, lon2 double"


def distances(lat, lon, items):
    la, lo = np.radians(items[:, 0]), np.radians(items[:, 1])
    p, q = np.radians(lat), np.radians(lon)
    a = np.sin((la - p) / 2) ** 2 + np.cos(p) * np.cos(la) * np.sin((lo - q) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(a, 1)))


def made(n, seed=1):
    """Items in towns of very different density, at both poles and across the date line."""
    rng = np.random.default_rng(seed)
    town = rng.integers(0, 6, n)
    centre = np.array([(42.7, -73.7), (-17.5, 179.9), (89.0, 10.0), (-88.5, -60.0), (51.5, 0.0), (0.0, -179.95)])[town]
    spread = np.array([0.01, 0.3, 0.9, 1.4, 3.0, 0.2])[town]
    at = centre + rng.normal(size=(n, 2)) * spread[:, None]
    return np.stack([np.clip(at[:, 0], -90, 90), (at[:, 1] + 180) % 360 - 180], axis=1)


def frame(spark, at):
    rows = [(f"R{i % 7}", i, f"S{i}", float(a), float(b), float(a), float(b)) for i, (a, b) in enumerate(at)]
    return spark.createDataFrame(rows, ITEMS)


def places(at, n, seed=2):
    rng = np.random.default_rng(seed)
    near = at[rng.integers(0, len(at), n)] + rng.normal(size=(n, 2)) * 0.02
    wide = np.stack([rng.uniform(-90, 90, n), rng.uniform(-180, 180, n)], axis=1)
    return [(float(np.clip(a, -90, 90)), float(b)) for a, b in np.concatenate([near, wide, [[90, 0], [-90, 0], [0, 180], [0, -180]]])]


@pytest.mark.parametrize("small, margin", [(True, 0.0), (False, 30.0)])
def test_the_tree_finds_what_exhaustive_search_finds(spark, small, margin):
    at = made(20_000)
    tree = spatial.BallTree(frame(spark, at), small)
    assert len(tree.levels) == 2 and tree.levels[-1].count() <= spatial.ROOTS
    points = places(at, 60)
    df = spark.createDataFrame(points, "_lat double, _lon double")
    got = {(r["_lat"], r["_lon"]): r["_found"] for r in tree.nearest(df, margin, matching._measure_points).collect()}
    assert len(got) == len(set(points))
    for lat, lon in points:
        km = distances(lat, lon, at)
        found = {h["stop_ord"]: h["km"] for h in got[lat, lon]}
        assert min(found.values()) == pytest.approx(km.min(), abs=1e-6)
        assert set(np.flatnonzero(km <= km.min() + margin - 1e-6)) <= set(found)
        assert all(found[i] == pytest.approx(km[i], abs=1e-6) for i in found)


def test_nodes_cover_their_items_and_hold_at_most_64(spark):
    at = made(9_000, 3)
    leaves, *upper = spatial.ball_tree(frame(spark, at))
    for level, name in [(leaves, "items"), *((u, "children") for u in upper)]:
        assert level.select(F.max(F.size(name))).first()[0] <= 64
    for r in leaves.select("lat", "lon", "radius", F.transform("items", lambda i: F.struct(i["lat1"], i["lon1"])).alias("at")).collect():
        assert distances(r["lat"], r["lon"], np.array(r["at"])).max() <= r["radius"]
    assert leaves.select(F.sum(F.size("items"))).first()[0] == 9_000


def test_an_empty_network_has_no_nearest_item(spark):
    tree = spatial.BallTree(frame(spark, made(1)).limit(0))
    df = spark.createDataFrame([(1.0, 2.0)], "_lat double, _lon double")
    assert tree.nearest(df, 0.0, matching._measure_points).collect() == []


def test_near_cells_are_only_those_of_points_of_items(spark):
    items = spark.createDataFrame([("A", 0, "a", 10.0, 20.0, 10.0, 20.035), ("A", 1, "b", 42.001, -73.001, 42.001, -73.001)], ITEMS)
    cells = matching.near_cells(items, 0.01)
    assert cells.count() == 5 and cells.filter("_near").count() == 5
