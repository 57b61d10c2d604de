import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import by_id, exhaustive_match, haversine, make_network
from wayfleet.operators import matching


def polyline(route, line, points):
    pairs = list(zip(points, points[1:])) or [(points[0], points[0])]
    return [dict(route=route, polyline_idx=line, segment_idx=i, lat1=a[0], lon1=a[1], lat2=b[0], lon2=b[1]) for i, (a, b) in enumerate(pairs)]


@pytest.fixture(scope="module")
def town():
    rnd = random.Random(3)
    out = []
    for r in range(4):
        for line in range(3):
            at = [42.70 + rnd.random() * 0.05, -73.70 + rnd.random() * 0.05]
            points = [tuple(at)]
            for _ in range(5):
                at = [at[0] + rnd.uniform(-0.004, 0.004), at[1] + rnd.uniform(-0.004, 0.004)]
                points.append(tuple(at))
            out += polyline(f"R{r}", line, points)
    out += polyline("R9", 0, [(42.72, -73.68)])
    out += polyline("R9", 1, [(42.60, -73.90), (43.10, -73.10)])
    out += polyline("R8", 0, [(-17.5, 179.95), (-17.6, 179.99)])
    out += polyline("R7", 0, [(78.2, 15.6), (78.3, 15.9)])
    return out


def places(town):
    rnd = random.Random(5)
    near = []
    for _ in range(250):
        s, t = rnd.choice(town), rnd.random()
        near.append((s["lat1"] + t * (s["lat2"] - s["lat1"]) + rnd.gauss(0, 0.0004), s["lon1"] + t * (s["lon2"] - s["lon1"]) + rnd.gauss(0, 0.0004)))
    wide = [(42.7 + rnd.uniform(-3, 3), -73.7 + rnd.uniform(-3, 3)) for _ in range(80)]
    world = [(rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for _ in range(60)]
    edge = [(-17.55, -179.99), (78.25, 15.7), (89.9, 0.0), (0.0, 0.0), (town[0]["lat2"], town[0]["lon2"])]
    return [(i, float(a), float(b)) for i, (a, b) in enumerate(near + wide + world + edge)]


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("threshold", [0.020, 0.5, 2.0])
def test_cells_give_the_exhaustive_answer(spark, town, small, threshold):
    net = make_network(spark, town, [("R0", 0, "S", 42.7, -73.7)])
    net.__dict__["small"] = small
    points = places(town)
    df = spark.createDataFrame([*points, (len(points), None, 1.0)], "ping_id long, latitude double, longitude double")
    got = matching.match_route(df, net, threshold).orderBy("ping_id").collect()
    assert len(got) == len(points) + 1
    assert got[-1].route is None and got[-1].dist_to_route is None
    for (i, lat, lon), row in zip(points, got):
        route, line, seg, km = exhaustive_match(lat, lon, town, threshold)
        assert (row.route, row.polyline_idx, row.segment_idx) == (route, line, seg), (i, lat, lon)
        assert row.dist_to_route == (None if km is None else pytest.approx(km, abs=1e-6))


@pytest.mark.parametrize("small", [True, False])
def test_nearest_stop_and_threshold(spark, town, small):
    rnd = random.Random(9)
    stops = [("A", i, f"A{i}", 42.70 + rnd.random() * 0.05, -73.70 + rnd.random() * 0.05) for i in range(30)]
    stops += [("B", 0, "B0", stops[0][3], stops[0][4]), ("B", 1, "B1", 78.0, 15.0), ("B", 2, "B2", -17.5, 179.99)]
    net = make_network(spark, town, stops)
    net.__dict__["small"] = small
    points = [(i, lat + rnd.gauss(0, 0.0002), lon + rnd.gauss(0, 0.0002)) for i, (_, _, _, lat, lon) in enumerate(stops * 6)]
    df = spark.createDataFrame(points, "ping_id long, latitude double, longitude double")
    near = matching.nearest_stop(df, net).orderBy("ping_id").collect()
    at = matching.match_stop(df, net, 0.020).orderBy("ping_id").collect()
    for (i, lat, lon), n, a in zip(points, near, at):
        km, route, _, name = min((round(haversine(lat, lon, s[3], s[4]), 9), s[0], s[1], s[2]) for s in stops)
        assert (n.nearest_route, n.nearest_stop) == (route, name)
        assert n.nearest_km == pytest.approx(km, abs=1e-6)
        assert a.stop_name == (name if km < 0.020 else None)


def test_stop_threshold_of_ten_and_twenty_metres(spark, town):
    net = make_network(spark, town, [("A", 0, "Union", 42.7302, -73.6766)])
    df = spark.createDataFrame([(0, 42.7302, -73.6766), (1, 42.73033, -73.6766), (2, 42.7312, -73.6766)], "ping_id long, latitude double, longitude double")
    assert by_id(matching.match_stop(df, net, 0.020), "stop_name") == ["Union", "Union", None]
    assert by_id(matching.match_stop(df, net, 0.010), "stop_name") == ["Union", None, None]


def test_only_missing_rows_are_matched(spark, town):
    net = make_network(spark, town, [("A", 0, "S", 42.7, -73.7)])
    s = town[0]
    df = spark.createDataFrame([(0, s["lat1"], s["lon1"], None, None, None, None, None, None), (1, s["lat1"], s["lon1"], 9.0, 1.0, 2.0, "X", 5, 6)],
                               "ping_id long, latitude double, longitude double, dist_to_route double, closest_lat double, closest_lon double, "
                               "route string, polyline_idx int, segment_idx int")
    got = matching.match_route(df, net, only_missing=True).orderBy("ping_id").collect()
    assert got[0].route == s["route"]
    assert (got[1].route, got[1].polyline_idx, got[1].segment_idx, got[1].dist_to_route) == ("X", 5, 6, 9.0)


def test_progress_adds_up_and_points_have_none(spark, town):
    net = make_network(spark, town, [("A", 0, "S", 42.7, -73.7)])
    df = matching.match_route(spark.createDataFrame(places(town)[:250], "ping_id long, latitude double, longitude double"), net)
    got = matching.polyline_progress(df, net).collect()
    assert any(r.dist_from_start is not None for r in got)
    for r in got:
        if r.segment_idx is None:
            assert r.dist_from_start is None and r.dist_to_end is None
        else:
            assert r.dist_from_start + r.dist_to_end == pytest.approx(r.polyline_length)
            assert 0 <= r.dist_from_start <= r.polyline_length + 1e-12


def test_progress_matches_incomplete_rows_again(spark, town):
    net = make_network(spark, town, [("A", 0, "S", 42.7, -73.7)])
    df = matching.match_route(spark.createDataFrame(places(town)[:50], "ping_id long, latitude double, longitude double"), net)
    lost = df.withColumn("segment_idx", F.lit(None).cast("int"))
    a = by_id(matching.polyline_progress(df, net), "dist_from_start")
    b = by_id(matching.polyline_progress(lost, net), "dist_from_start")
    assert a == b and lost.columns + ["dist_from_start", "dist_to_end", "polyline_length"] == matching.polyline_progress(lost, net).columns


def test_dead_reckoning_stops_at_the_end(spark):
    town = polyline("A", 0, [(42.70, -73.70), (42.71, -73.70), (42.72, -73.70)])
    net = make_network(spark, town, [("A", 0, "S", 42.7, -73.7)])
    df = spark.createDataFrame([("A", 0, 0.0, 30.0, None), ("A", 0, 0.0, 30.0, 100.0), ("A", 0, 2.2, 60.0, None), ("A", 0, None, 60.0, None)],
                               "route string, polyline_idx int, dist_from_start double, speed_mph double, predicted_kmh double")
    got = matching.dead_reckon(df, net, 60.0).collect()
    assert got[0].target_km == pytest.approx(30 * 0.44704 * 60 / 1000)
    assert got[1].target_km == pytest.approx(100 * 0.621371 * 0.44704 * 60 / 1000)
    assert got[1].target_segment == 1
    assert (got[2].target_lat, got[2].target_segment) == (pytest.approx(42.72), 1)
    assert got[3].target_km is None and got[3].target_lat is None
