import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import by_id, pings_df
from wayfleet.operators import trips

ROUTE = "route string, polyline_idx int"


def test_gaps_cut_trips(spark):
    df = pings_df(spark, [("1", 0), ("1", 5), ("1", 10), ("1", 100), ("1", 105), ("2", 0), ("2", 5), ("2", 10)])
    assert by_id(trips.segment_trips(df, 15), "segment_no") == [1, 1, 1, 2, 2, 1, 1, 1]


def test_off_route_rows_stand_alone(spark):
    dist = [.005, .008, .025, .030, .010, .006]
    df = pings_df(spark, [("1", 5 * i, d) for i, d in enumerate(dist)], "dist_to_route double")
    assert by_id(trips.segment_trips(df, 15, "dist_to_route", 0.020), "segment_no") == [1, 1, 2, 3, 4, 4]
    unknown = pings_df(spark, [("1", 0, .001), ("1", 5, None), ("1", 10, .001)], "dist_to_route double")
    assert by_id(trips.segment_trips(unknown, 15, "dist_to_route", 0.020), "segment_no") == [1, 1, 1]


def test_missing_columns_are_named(spark):
    with pytest.raises(KeyError):
        trips.segment_trips(spark.range(1), 15)
    with pytest.raises(ValueError):
        trips.starts_trip(["vehicle_id"], 15, None, 0.02)


def walk(seed, vehicles, rows):
    rnd = random.Random(seed)
    out = []
    for v in range(vehicles):
        t = 0.0
        for _ in range(rows if v else rows * 10):
            t += rnd.choice([2, 5, 7, 14.9, 15, 15.1, 40, 700])
            route = rnd.choice(["N", "N", "N", "W", None])
            line = rnd.choice([0, 0, 0, 1, None]) if route else None
            out.append((f"v{v}", t, route, line, rnd.choice([0.001, 0.001, 0.001, 0.03, None]), 42 + rnd.random() / 100, -73 - rnd.random() / 100))
    return out


@pytest.mark.parametrize("slice_seconds", [20, 300, 10**7])
def test_slices_do_not_change_trips(spark, slice_seconds):
    rows = walk(1, 4, 60)
    df = pings_df(spark, rows, ROUTE + ", dist_to_route double, la double, lo double")
    want, state = [], {}
    for v, t, _, _, dist, _, _ in rows:
        no, last, off = state.get(v, (0, None, False))
        now_off = dist is not None and dist > 0.02
        if last is None or t - last > 15 + 1e-9 or now_off or off:
            no += 1
        state[v] = (no, t, now_off)
        want.append(no)
    assert by_id(trips.segment_trips(df, 15, "dist_to_route", 0.02, slice_seconds), "segment_no") == want


def test_short_trips_go(spark):
    df = pings_df(spark, [("1", i) for i in range(10)]).withColumn(
        "segment_no", F.when(F.col("ping_id") < 5, 1).when(F.col("ping_id") < 7, 2).otherwise(3))
    assert {r.segment_no for r in trips.filter_short(df, 3).collect()} == {1, 3}
    with pytest.raises(ValueError):
        trips.filter_short(df, 0)


def test_vote_needs_more_than_half_and_stays_in_the_trip(spark):
    rows = [("1", 0, "WEST", 0), ("1", 1, None, None), ("1", 2, "WEST", 0), ("1", 3, "NORTH", 1), ("1", 4, None, None), ("1", 5, "NORTH", 1)]
    df = pings_df(spark, rows, ROUTE).withColumn("segment_no", F.when(F.col("ping_id") < 3, 1).otherwise(2))
    assert by_id(trips.vote_route(df, 2), "route") == ["WEST", "WEST", "WEST", "NORTH", "NORTH", "NORTH"]
    tie = pings_df(spark, [("1", 0, "A", 0), ("1", 1, None, None), ("1", 2, "B", 0)], ROUTE).withColumn("segment_no", F.lit(1))
    assert by_id(trips.vote_route(tie, 2), "route") == ["A", None, "B"]
    half_known = pings_df(spark, [("1", 0, "A", None), ("1", 1, None, None), ("1", 2, "A", None), ("1", 3, "A", 1)], ROUTE).withColumn("segment_no", F.lit(1))
    assert by_id(trips.vote_route(half_known, 2), "route", "polyline_idx")[1] == ("A", None)


def test_distance_and_speed(spark):
    rows = [("1", 0, 42.7284, -73.6788), ("1", 10, 42.7290, -73.6788), ("1", 20, 42.7290, -73.6788), ("1", 20, 42.73, -73.6788), ("1", 30, None, None)]
    df = pings_df(spark, rows, "closest_lat double, closest_lon double").withColumn("segment_no", F.lit(1))
    got = trips.speed(trips.distance_delta(df)).orderBy("ping_id").collect()
    assert got[0].distance_km is None and got[0].speed_kmh is None
    assert got[1].speed_kmh == pytest.approx(got[1].distance_km / 10 * 3600)
    assert got[2].speed_kmh == 0.0
    assert got[3].distance_km > 0 and got[3].speed_kmh is None
    assert got[4].distance_km is None


@pytest.mark.parametrize("slice_seconds", [15, 10**6])
def test_running_distance_crosses_slices(spark, slice_seconds):
    df = pings_df(spark, [("1", 10 * i, float(i)) for i in range(30)], "distance_km double").withColumn("segment_no", F.lit(1))
    assert by_id(trips.cumulative_distance(df, slice_seconds), "trip_km") == [i * (i + 1) / 2 for i in range(30)]


def test_one_endless_trip_in_blocks_equals_the_whole_trip(spark):
    rows = [(i, "v1", 1, i * 7_200_000_000, "A" if i % 5 < 2 else "B" if i % 5 == 3 else None, 0 if i % 5 != 4 else None,
             42.0 + (i * i % 17) / 1000, -73.0) for i in range(23)]
    df = spark.createDataFrame(rows, "ping_id long, vehicle_id string, segment_no long, t_us long, route string, polyline_idx int, "
                                     "closest_lat double, closest_lon double")
    jobs = [(3, 3, lambda d, by: trips.vote_route(d, 3, by), ("route", "polyline_idx")),
            (1, 0, lambda d, by: trips.distance_delta(d, by), ("distance_km",)),
            (1, 0, lambda d, by: trips.speed(d.withColumn("distance_km", F.col("closest_lat")), by), ("speed_kmh",))]
    for before, after, work, columns in jobs:
        whole = by_id(work(df, trips.TRIP), *columns)
        for size in (1, 2, 4, 100):
            cut = trips.in_blocks(df, before, after, lambda d: work(d, trips.BY_BLOCK), size)
            assert by_id(cut, *columns) == whole
        assert by_id(work(df, None), *columns) == whole
