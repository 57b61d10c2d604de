"""Groups are handled whole up to a size and in slices beyond it, with the same results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import make_network, pings_df
from wayfleet.operators import forecast, likelihood, scale, stops, trips
from wayfleet.plans import enrich
from wayfleet.streaming import state

LINE = [("A", p, s, 42.7 + 0.002 * (3 * p + s), -73.6, 42.7 + 0.002 * (3 * p + s + 1), -73.6) for p in range(4) for s in range(3)]
STOPS = [("A", p, f"S{p}", 42.7 + 0.006 * p, -73.6) for p in range(5)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def net(spark):
    return make_network(spark, LINE, STOPS, [("A", p, f"S{p}") for p in range(5)]).stored()


@pytest.fixture(scope="module")
def pings(spark):
    """One vehicle with most rows, some with few, none and null ids among them; gaps, stops, rows off the line."""
    rnd, rows = random.Random(4), []
    for v, n in (("hot", 400), ("b", 40), ("c", 7), ("d", 1), (None, 30)):
        t = 0.0
        for i in range(n):
            t += rnd.choice([2.0, 5.0, 5.0, 14.0, 40.0]) if i % 9 else 0.0
            at = (i * 0.0005) % 0.024
            rows.append((v, t, 42.7 + (round(at / 0.006) * 0.006 if rnd.random() < 0.2 else at), -73.6 + rnd.choice([0.0, 0.0, 0.00002, 0.004])))
    return scale.cut(pings_df(spark, rows, "latitude double, longitude double"))


def results(pings, net):
    matched = scale.cut(enrich.preprocess(pings, net))
    out = {"cut": rows_of(trips.segment_trips(matched, 15.0, "dist_to_route", 0.02, 60), "ping_id", "segment_no")}
    l2 = scale.cut(enrich.segment(matched, net, 30.0, 0.005, slice_seconds=60))
    l3 = scale.cut(enrich.find_stops(l2, net, slice_seconds=60))
    out["l2"] = rows_of(l2, "ping_id", "segment_no", "route", "polyline_idx", "speed_kmh")
    out["l3"] = rows_of(l3, "ping_id", "segment_no", "stop_name", "dist_to_end")
    out["l4"] = rows_of(enrich.add_eta(l3, 60), "ping_id", "stop_name", "eta_seconds")
    out["trimmed"] = rows_of(stops.trim_after_last_stop(l3, slice_seconds=60), "ping_id")
    out["eta"] = rows_of(stops.eta_to_next_stop(l3, slice_seconds=60), "ping_id", "eta_seconds")
    values = l3.withColumn("y", F.log1p("speed_kmh"))
    out["ar1"] = rows_of(forecast.expanding_ar1(values, 4, "y", slice_seconds=60, rows_per_slice=8), "ping_id", "pos", F.round("predicted", 5))
    made = forecast.expanding_forecasts(values, [(1, 1, 0), (2, 0, 1)], 4, "y", slice_seconds=60, rows_per_slice=8)
    out["orders"] = rows_of(made, "ping_id", "p", "d", "q", F.round("predicted", 5))
    known = enrich.add_eta(l3, 60).filter("eta_seconds IS NOT NULL")
    out["sequences"] = rows_of(forecast.training_sequences(known, 3, ["speed_kmh"], slice_seconds=60, rows_per_slice=8), "ping_id", "sequence", "target")
    return out


def test_slices_and_whole_groups_give_the_same(spark, net, pings, monkeypatch):
    monkeypatch.setattr(scale, "HOT_ROWS", 4)
    sliced = results(pings, net)
    monkeypatch.setattr(scale, "HOT_ROWS", 50)
    mixed = results(pings, net)
    monkeypatch.setattr(scale, "HOT_ROWS", 100_000)
    whole = results(pings, net)
    assert all(whole.values())
    for name, rows in whole.items():
        assert rows == sliced[name] == mixed[name], name


def test_ordinary_groups_take_one_shuffle_and_no_copies(spark, net, pings):
    df = scale.prefix_sums(pings.withColumn("_slice", F.lit(1)), ["vehicle_id"], "_slice", trips.ORDER, {"n": F.lit(1)})
    assert plan(df).count("Exchange hashpartitioning") == 1
    for made in (trips.segment_trips(pings, 15.0), enrich.segment(scale.cut(enrich.preprocess(pings, net)), net)):
        assert "Generate explode" not in plan(made)
    trimmed = stops.trim_after_last_stop(pings.withColumns({"segment_no": F.lit(1), "stop_name": F.lit("S")}))
    assert "Join" not in plan(trimmed)


def test_running_sums_leave_out_rows_without_a_group(spark, monkeypatch):
    df = spark.createDataFrame([(k, i // 7, i, i) for i in range(60) for k in ("a", "b" if i % 9 == 0 else None)], "k string, s long, o long, v long")
    for most in (10, 1000):
        monkeypatch.setattr(scale, "HOT_ROWS", most)
        got = {(r.k, r.o): r.run for r in scale.prefix_sums(df, ["k"], "s", ["o"], {"run": F.col("v")}).collect()}
        assert got == {(k, o): sum(i for i in range(o + 1) if k == "a" or i % 9 == 0) for k in "ab" for o in range(60) if k == "a" or o % 9 == 0}


def test_running_sums_count_rows_without_a_slice_first(spark, monkeypatch):
    df = spark.createDataFrame([("a", None if i % 5 == 0 else i // 7, i, 1) for i in range(60)], "k string, s long, o long, v long")
    for most in (10, 1000):
        monkeypatch.setattr(scale, "HOT_ROWS", most)
        got = {r.o: r.run for r in scale.prefix_sums(df, ["k"], "s", ["o"], {"run": F.col("v")}).collect()}
        assert got == {o: 12 + sum(1 for i in range(o + 1) if i % 5) for o in range(60) if o % 5}


def test_salted_copies_are_not_broadcast(spark):
    dim = scale.cut(spark.range(3000).selectExpr("id AS k", "id % 2 = 0 AS even"))
    joined = scale.lookup_join(spark.range(9000).selectExpr("id % 3000 AS k", "id"), dim, ["k"], "inner", small=False)
    assert "BroadcastExchange" not in plan(joined) and joined.count() == 9000


def test_split_of_many_trips_is_not_salted(spark, monkeypatch):
    rows = [(f"v{i % 40}" if i % 3 else "hot", 1 + i % 2, i) for i in range(900)]
    df = scale.cut(spark.createDataFrame(rows, "vehicle_id string, segment_no long, id long"))
    few = rows_of(forecast.split_by_trip(df), "id", "is_test")
    monkeypatch.setattr(forecast, "may_broadcast", lambda stored: False)
    many = forecast.split_by_trip(df)
    assert rows_of(many, "id", "is_test") == few and "Generate explode" not in plan(many) and "BroadcastExchange" not in plan(many)
    monkeypatch.setattr(scale, "HOT_ROWS", 100)
    assert rows_of(forecast.split_by_trip(df), "id", "is_test") == few


def test_speeds_of_many_vehicles_take_no_group_each(spark):
    df = spark.createDataFrame([(f"v{v}", t * 5_000_000, t, float((t * 7 + v) % 11) if t % 5 else None) for v in range(4) for t in range(3 + 20 * v)],
                               "vehicle_id string, t_us long, ping_id long, speed_kmh double")
    made = forecast.forecast_speed(df)
    assert "FlatMapGroups" not in plan(made)
    got = {r.vehicle_id: r.speed_kmh for r in made.collect()}
    want = {f"v{v}": forecast.one_step_forecast(np.array([float((t * 7 + v) % 11) if t % 5 else 0.0 for t in range(3 + 20 * v)]), 3, 0, 2) for v in (1, 2, 3)}
    assert got == {v: pytest.approx(max(0.0, y)) for v, y in want.items()}


def test_covariances_before_the_first_value():
    rng = np.random.default_rng(5)
    ar, ma = likelihood.constrained(rng.normal(size=(20, 3))), rng.normal(size=(20, 2))
    got = likelihood._stationary(ar.T, np.concatenate([np.ones((1, 20)), ma.T]))
    for s in range(20):
        move, shock = np.zeros((3, 3)), np.array([1.0, *ma[s]])
        move[:, 0], move[0, 1], move[1, 2] = ar[s], 1, 1
        want = np.linalg.solve(np.eye(9) - np.kron(move, move), np.outer(shock, shock).ravel()).reshape(3, 3)
        assert [got[i, j][s] for i in range(3) for j in range(i, 3)] == pytest.approx([want[i, j] for i in range(3) for j in range(i, 3)])


class Held:
    """State and timers of one vehicle."""

    def __init__(self):
        self.list, self.value, self.timers = [], None, []

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        return type("Value", (), {"exists": lambda _: self.value is not None, "get": lambda _: self.value, "update": lambda _, v: setattr(self, "value", v)})()

    def get(self):
        return iter(self.list)

    def put(self, rows):
        self.list = rows

    def registerTimer(self, ms):
        self.timers.append(ms)


def test_trips_are_cut_from_plain_rows():
    cutter, held = state.TripCutter(15.0, 0.02, 60.0), Held()
    cutter.init(held)
    row = lambda ping, s, dist=0.0: (ping, int(s * 1e6), 1.0, 2.0, dist, 1.0, 2.0, "A", None, None, None)
    first = list(cutter._advance(("v",), [row(1, 0), row(3, 5), row(2, 5), row(4, 40), row(5, 45, 9.0), row(6, 50), row(7, 130)], 100_000_000))
    assert [(r["ping_id"], r["segment_no"], r["_home"]) for r in first] == [(1, 1, True), (3, 1, True), (4, 2, True), (5, 3, False), (6, 4, False)]
    assert held.value == (50_000_000, False, 4, 40_000_000) and held.timers == [190_001]
    last = list(cutter._advance(("v",), [row(6, 50)], 500_000_000))
    assert [(r["ping_id"], r["segment_no"], r["_home"]) for r in last] == [(1, 1, False), (3, 1, False), (4, 2, False), (5, 3, True), (6, 4, True), (7, 5, True)]


def test_from_matches_to_times_in_one_shuffle(pings, net):
    """The steps one by one give the same rows."""
    matched, columns = scale.cut(enrich.preprocess(pings, net)), ("ping_id", "segment_no", "stop_name", "eta_seconds", "dist_to_end")
    once = enrich.with_eta(matched, net, scale.Hot(), 60, max_gap=30.0, max_dist=0.005)
    l3 = scale.cut(enrich.find_stops(enrich.segment(matched, net, 30.0, 0.005, slice_seconds=60), net, slice_seconds=60))
    assert rows_of(once, *columns) == rows_of(enrich.add_eta(l3, 60), *columns) and plan(once).count("Exchange hashpartitioning(vehicle_id") == 1


def test_hot_vehicles_have_the_same_times(pings, net, monkeypatch):
    matched, columns = scale.cut(enrich.preprocess(pings, net)), ("ping_id", "segment_no", "stop_name", "eta_seconds")
    made = lambda: rows_of(enrich.with_eta(matched, net, scale.hot_groups(matched, ["vehicle_id"]), 60, max_gap=30.0, max_dist=0.005), *columns)
    whole = made()
    monkeypatch.setattr(scale, "HOT_ROWS", 20)
    assert whole and made() == whole


def test_a_split_does_not_shuffle_the_rows(spark):
    rows = [(f"v{i % 40}" if i % 41 else None, 1 + i % 2 if i % 43 else None, i) for i in range(900)]
    out = forecast.split_by_trip(scale.cut(spark.createDataFrame(rows, "vehicle_id string, segment_no long, id long")), 0.3)
    assert "Exchange" not in plan(out)
    assert out.count() == sum(v is not None and s is not None for v, s, _ in rows)
    assert out.select("vehicle_id", "segment_no", "is_test").distinct().count() == out.select("vehicle_id", "segment_no").distinct().count()
    assert 0.3 * 800 <= out.filter("is_test").count() < 0.3 * 900 + 30
