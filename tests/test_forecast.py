import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import pings_df
from wayfleet.operators import forecast


def series(spark, values, trip=1):
    return pings_df(spark, [("1", 5 * i, v) for i, v in enumerate(values)], "speed_kmh double").withColumn("segment_no", F.lit(trip).cast("long"))


def walk(n, seed=1):
    rnd, y = random.Random(seed), [20.0, 25.0]
    for _ in range(n - 2):
        y.append(5 + 0.7 * y[-1] - 0.1 * y[-2] + rnd.gauss(0, 3))
    return y


@pytest.mark.parametrize("rows_per_slice", [6, 4096])
def test_first_order_equals_a_fit_per_row(spark, rows_per_slice):
    y = walk(40)
    got = {r.pos: r for r in forecast.expanding_ar1(series(spark, y), 5, slice_seconds=17, rows_per_slice=rows_per_slice).collect()}
    assert sorted(got) == list(range(5, 40))
    for i, r in got.items():
        slope, intercept = np.polyfit(y[:i - 1], y[1:i], 1)
        assert r.predicted == pytest.approx(intercept + slope * y[i - 1], rel=1e-6)


@pytest.mark.parametrize("rows_per_slice", [6, 4096])
def test_every_order_is_fitted_on_earlier_rows_only(spark, rows_per_slice):
    y = walk(40)
    orders = [(1, 0, 0), (2, 0, 0), (2, 1, 0)]
    got = forecast.expanding_forecasts(series(spark, y), orders, 12, slice_seconds=17, rows_per_slice=rows_per_slice).collect()
    assert len(got) == 3 * 28
    for r in got:
        z = np.diff(y[:r.pos], r.d)
        x = np.column_stack([np.ones(len(z) - r.p)] + [z[r.p - k: len(z) - k] for k in range(1, r.p + 1)])
        beta = np.linalg.lstsq(x, z[r.p:], rcond=None)[0]
        want = beta @ np.concatenate([[1.0], z[::-1][:r.p]]) + (y[r.pos - 1] if r.d else 0.0)
        assert r.predicted == pytest.approx(want, rel=1e-6)
    with_shocks = forecast.expanding_forecasts(series(spark, y), [(1, 0, 1), (2, 0, 2)], 15).collect()
    # Shocks exist once the long regression has more rows than coefficients; then the order's own needs the same.
    assert len(with_shocks) == 50 and all((r.predicted is not None) == (r.q == 1 or r.pos >= 18) for r in with_shocks)


def test_one_step_forecast_follows_a_linear_rule():
    y = [1.0, 2.0]
    for _ in range(60):
        y.append(1 + 0.5 * y[-1] + 0.2 * y[-2])
    y = np.array(y) + np.random.default_rng(0).normal(0, 0.05, len(y))
    assert forecast.one_step_forecast(y, 2, 0, 0) == pytest.approx(y[-1], abs=0.3)
    assert forecast.one_step_forecast(np.arange(30.0), 1, 1, 0) == pytest.approx(30.0, abs=1e-3)
    assert forecast.one_step_forecast(np.arange(30.0) ** 3, 1, 3, 0) == pytest.approx(27_000.0, rel=1e-6)
    assert forecast.one_step_forecast(np.full(30, 7.0), 2, 0, 0) == pytest.approx(7.0)
    assert forecast.one_step_forecast(np.array([3.0, 5.0]), 3, 0, 2) is None


def test_an_order_does_not_depend_on_the_others(spark):
    df = series(spark, walk(30))
    alone = {r.pos: r.predicted for r in forecast.expanding_forecasts(df, [(1, 0, 0)], 2).collect()}
    beside = {r.pos: r.predicted for r in forecast.expanding_forecasts(df, [(4, 0, 0), (1, 0, 0), (1, 3, 0)], 2).filter("p = 1 AND d = 0").collect()}
    assert alone == beside and sum(v is not None for v in alone.values()) == 26


def test_a_constant_series_forecasts_itself(spark):
    df = series(spark, [30.0] * 12)
    assert all(r.predicted == pytest.approx(30.0) for r in forecast.expanding_ar1(df, 3).collect())
    assert all(r.predicted == pytest.approx(30.0) for r in forecast.expanding_forecasts(df, [(2, 0, 0)], 6).collect())


def test_forecast_speed_needs_five_rows_and_never_goes_below_zero(spark):
    falling = [100.0 - 10 * i for i in range(11)]
    df = series(spark, falling).unionByName(pings_df(spark, [("2", i, 1.0) for i in range(4)], "speed_kmh double").withColumn("segment_no", F.lit(1).cast("long")))
    got = forecast.forecast_speed(df, 1, 1, 0).collect()
    assert [r.vehicle_id for r in got] == ["1"] and got[0].speed_kmh == 0.0 and got[0].next_us == 55_000_000


def test_next_timestamp_averages_four_gaps_within_limits(spark):
    df = pings_df(spark, [("a", t) for t in (0, 100, 101, 103, 106.9, 111)] + [("b", 3)] + [("c", t) for t in (0, 500)] + [("d", t) for t in (0, 0.2)])
    got = {r.vehicle_id: r.step_seconds for r in forecast.next_timestamp(df).collect()}
    assert got == {"a": (1 + 2 + 3 + 4) / 4, "b": 5.0, "c": 60.0, "d": 1.0}


@pytest.mark.parametrize("rows_per_slice", [3, 4096])
def test_sequences_end_before_their_target(spark, rows_per_slice):
    df = pings_df(spark, [("1", t, float(i), float(-i)) for i, t in enumerate([0, 1, 2, 500, 501])] + [("2", 0, 9.0, 9.0)], "x double, eta_seconds double")
    df = df.withColumn("segment_no", F.lit(1))
    got = sorted((r.ping_id, list(r.sequence), r.target) for r in forecast.training_sequences(df, 3, ["x"], slice_seconds=10, rows_per_slice=rows_per_slice).collect())
    assert got == [(3, [0.0, 1.0, 2.0], -3.0), (4, [1.0, 2.0, 3.0], -4.0)]


def test_split_keeps_trips_whole(spark):
    df = pings_df(spark, [(f"v{i % 17}", i) for i in range(400)]).withColumn("segment_no", (F.col("ping_id") % 5).cast("long"))
    out = forecast.split_by_trip(df, 0.25)
    per = out.groupBy("vehicle_id", "segment_no").agg(F.count_distinct("is_test").alias("k")).collect()
    assert all(r.k == 1 for r in per)
    n = out.filter("is_test").count()
    assert 100 <= n < 100 + 400 / 17 + 1
    assert forecast.split_by_trip(df, 0.0).filter("is_test").count() > 0
    assert forecast.split_by_trip(df, 1.0).filter("is_test").count() == 400
    with pytest.raises(ValueError):
        forecast.split_by_trip(df, 1.5)


def test_models_recover_a_linear_rule(spark, tmp_path):
    rnd = random.Random(6)
    rows = []
    for trip in range(12):
        for i in range(30):
            a = rnd.random()
            rows.append((f"v{trip}", 5 * i, a, "N", trip % 2, 0.0))
    df = pings_df(spark, rows, "a double, route string, polyline_idx int, eta_seconds double").withColumn("segment_no", F.lit(1).cast("long"))
    from pyspark.sql import Window
    w = Window.partitionBy("vehicle_id").orderBy("t_us")
    df = df.withColumn("eta_seconds", F.coalesce(3 + 2 * F.lag("a", 1).over(w) + F.lag("a", 2).over(w) * (F.col("polyline_idx") + 1), F.lit(4.0)))
    models, test = forecast.train_eta(df, 2, ["a"], 0.3)
    coefs = {r.polyline_idx: r.coefficients for r in models.collect()}
    for k in (0, 1):
        assert coefs[k] == pytest.approx([3, k + 1, 2], abs=0.05)
    errors = forecast.evaluate_eta(test, models).collect()
    assert sorted(r.polyline_idx for r in errors) == [0, 1] and all(r.rmse < 0.05 and r.success_rate == 1 for r in errors)
    best = forecast.search_eta(forecast.evaluate_eta(test, forecast.train_eta(df, 2, ["a"], 0.3, ridges=(1e-8, 10.0))[0])).collect()
    assert all(r.ridge == 1e-8 for r in best)
    path = str(tmp_path / "models")
    forecast.store_models(models, path, 2)
    again = {r.polyline_idx: r for r in forecast.load_models(spark, path).collect()}
    assert {k: r.coefficients for k, r in again.items()} == coefs and {r.window for r in again.values()} == {2}
    asked = spark.createDataFrame([("N", 1), ("N", 1), ("N", 9)], "route string, polyline_idx int")
    assert [r.polyline_idx for r in forecast.load_models(spark, path, asked).collect()] == [1]
    assert {r.polyline_idx: r.rmse for r in forecast.evaluate_eta(test, forecast.load_models(spark, path)).collect()} == {
        r.polyline_idx: pytest.approx(r.rmse) for r in errors}
