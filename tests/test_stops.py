import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import by_id, make_network, pings_df
from wayfleet.operators import stops

SEG = [dict(route="N", polyline_idx=i, segment_idx=0, lat1=42.0 + i, lon1=-73.0, lat2=43.0 + i, lon2=-73.0) for i in range(3)]


@pytest.fixture(scope="module")
def net(spark):
    return make_network(spark, SEG, [("N", i, f"S{i}", 42.0 + i, -73.0) for i in range(4)], [("N", i, f"S{i}") for i in range(3)])


def trip(spark, rows, extra):
    return pings_df(spark, rows, extra).withColumn("segment_no", F.lit(1))


@pytest.mark.parametrize("before, after, want", [(0.015, 0.003, [None, "S1", None]), (0.003, 0.015, ["S1", None, None]), (0.01, 0.01, [None, "S1", None])])
def test_missed_stop_goes_to_the_closer_row_or_the_later_one(spark, net, before, after, want):
    df = trip(spark, [("1", 0, "N", 0, None, before), ("1", 5, "N", 1, None, after), ("1", 10, "N", 1, None, .001)],
              "route string, polyline_idx int, stop_name string, dist_to_route double")
    assert by_id(stops.repair_missed_stops(df, net), "stop_name") == want


def test_repair_leaves_other_vehicles_routes_and_recorded_stops_alone(spark, net):
    extra = "route string, polyline_idx int, stop_name string, dist_to_route double"
    two = trip(spark, [("1", 0, "N", 0, None, .01), ("2", 5, "N", 1, None, .001)], extra)
    assert by_id(stops.repair_missed_stops(two, net), "stop_name") == [None, None]
    seen = trip(spark, [("1", 0, "N", 0, "S9", .01), ("1", 5, "N", 1, None, .001)], extra)
    assert by_id(stops.repair_missed_stops(seen, net), "stop_name") == ["S9", None]
    beyond = trip(spark, [("1", 0, "N", 2, None, .01), ("1", 5, "N", 3, None, .001)], extra)
    out = stops.repair_missed_stops(beyond, net)
    assert by_id(out, "stop_name") == [None, None] and sorted(out.columns) == sorted(beyond.columns)


def test_trim_keeps_the_last_stop_and_drops_trips_without(spark):
    names = [None, "A", None, None, "B", None, None]
    df = trip(spark, [("1", i, n) for i, n in enumerate(names)] + [("2", 0, None)], "stop_name string")
    assert by_id(stops.trim_after_last_stop(df), "ping_id") == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("slice_seconds", [15, 3600])
def test_eta_counts_to_the_next_later_stop(spark, slice_seconds):
    names = {20: "A", 50: "B"}
    df = trip(spark, [("1", t, names.get(t)) for t in (0, 10, 20, 30, 40, 50)], "stop_name string")
    assert by_id(stops.eta_to_next_stop(df, slice_seconds=slice_seconds), "eta_seconds") == [20, 10, 30, 20, 10, None]


@pytest.mark.parametrize("slice_seconds", [7, 3600])
def test_eta_on_random_trips(spark, slice_seconds):
    rnd = random.Random(4)
    rows = [(f"v{i % 3}", rnd.randrange(120), rnd.choice([None, None, "A", "B"])) for i in range(200)]
    want = []
    for v, t, _ in rows:
        later = [u for w, u, s in rows if w == v and s and u > t]
        want.append(min(later) - t if later else None)
    assert by_id(stops.eta_to_next_stop(trip(spark, rows, "stop_name string"), slice_seconds=slice_seconds), "eta_seconds") == want


@pytest.mark.parametrize("slice_seconds", [4, 3600])
def test_travel_times_pair_consecutive_stop_rows(spark, slice_seconds):
    rows = [("1", 0, "A", 0), ("1", 5, "A", 0), ("1", 9, None, 0), ("1", 65, "B", 1), ("1", 65, "B", 1), ("1", 100, "C", None)]
    df = trip(spark, [(v, t, s, "N", p) for v, t, s, p in rows], "stop_name string, route string, polyline_idx int")
    got = {r.polyline_idx: r for r in stops.polyline_travel_times(df, slice_seconds=slice_seconds).collect()}
    assert (got[0].sample_count, got[0].avg_travel_time_seconds, got[0].min_time, got[0].max_time) == (2, 32.5, 5.0, 60.0)
    assert (got[1].sample_count, got[1].avg_travel_time_seconds, got[1].std_travel_time_seconds) == (1, 35.0, 0.0)
    only = stops.polyline_travel_times(df, slice_seconds=slice_seconds, distinct_stops=True).filter("polyline_idx = 0").first()
    assert only.sample_count == 1


def test_projected_stop_times(spark, net):
    latest = spark.createDataFrame([("at_start", "N", 0, None), ("at_stop", "N", 0, "S0"), ("end", "N", 3, None), ("no_eta", "N", 0, None)],
                                   "vehicle_id string, route string, polyline_idx int, stop_name string")
    visits = spark.createDataFrame([("at_start", "S0", 5), ("at_stop", "S1", 7)], "vehicle_id string, stop_name string, last_t_us long")
    etas = spark.createDataFrame([("at_start", 10_000_000), ("at_stop", 20_000_000), ("end", 1)], "vehicle_id string, eta_us long")
    travel = spark.createDataFrame([("N", 1, 30.0)], "route string, polyline_idx int, avg_travel_time_seconds double")
    got = sorted((r.vehicle_id, r.stop_ord, r.kind, r.stop_us) for r in stops.project_stop_times(latest, visits, etas, travel, net).collect())
    # Leg 2 has no average, so nothing follows it; standing at the departure stop skips one leg.
    assert got == [("at_start", 0, "visited", 5), ("at_start", 1, "next", 10_000_000), ("at_start", 2, "later", 40_000_000),
                   ("at_stop", 1, "visited", 7), ("at_stop", 2, "next", 20_000_000)]


@pytest.mark.parametrize("width", [9, 3600])
def test_trim_and_eta_in_one_go_equal_both_steps(spark, width):
    rng = random.Random(width)
    rows = [(f"v{v}", s, int((s * 500 + i * 4 + rng.randint(0, 3)) * 1e6), i, rng.choice(["S", None, None, None, None]))
            for v in range(5) for s in range(1, 5) for i in range(rng.randint(1, 15))]
    df = spark.createDataFrame(rows, "vehicle_id string, segment_no long, t_us long, ping_id long, stop_name string")
    two = stops.eta_to_next_stop(stops.trim_after_last_stop(df, slice_seconds=width), slice_seconds=width)
    one = stops.trim_and_eta(df, slice_seconds=width)
    assert one.columns == two.columns and sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
