import math

import numpy as np
import pytest

from wayfleet.operators import likelihood as lk


def brute_loglik(y, mean, ar, ma):
    """Density of the whole series as one normal vector: covariances from the shocks' weights, variance at its best."""
    weights = [1.0]
    for j in range(1, 3000):
        weights.append((ma[j - 1] if j <= len(ma) else 0.0) + sum(a * weights[j - i] for i, a in enumerate(ar, 1) if j >= i))
    w = np.array(weights)
    cov = [float(w[:len(w) - h] @ w[h:]) for h in range(len(y))]
    gamma = np.array([[cov[abs(i - j)] for j in range(len(y))] for i in range(len(y))])
    e = np.asarray(y) - mean
    variance = float(e @ np.linalg.solve(gamma, e)) / len(y)
    return -0.5 * (len(y) * (math.log(2 * math.pi * variance) + 1) + np.linalg.slogdet(gamma)[1]), gamma, variance


def made(n, ar, ma, mean=0.0, seed=0):
    rng = np.random.default_rng(seed)
    e, y = rng.normal(size=n + 200), np.zeros(n + 200)
    for t in range(5, n + 200):
        y[t] = sum(a * y[t - i] for i, a in enumerate(ar, 1)) + e[t] + sum(m * e[t - i] for i, m in enumerate(ma, 1))
    return y[200:] + mean


@pytest.mark.parametrize("ar, ma", [([0.5, -0.3, 0.2], [0.4, 0.1]), ([0.9], []), ([], [0.7]), ([], []), ([0.2, 0.1], [-0.5])])
def test_likelihood_equals_brute_force(ar, ma):
    y = made(40, ar, ma, 3.0)
    held = np.zeros((2, 45))
    held[0, 5:], held[1, 20:] = y, y[:25]
    given = np.zeros((2, 45), bool)
    given[0, 5:] = given[1, 20:] = True
    rows = lambda v: np.tile(np.array(v, float), (2, 1)).reshape(2, len(v))
    got, variance, ahead = lk.kalman(held, given, np.full(2, 2.5), rows(ar), rows(ma))
    for i, part in enumerate((y, y[:25])):
        want, gamma, best = brute_loglik(part, 2.5, ar, ma)
        assert got[i] == pytest.approx(want, rel=1e-8) and variance[i] == pytest.approx(best, rel=1e-8)
    weights = np.array(brute_loglik(np.zeros(41) + 1, 0.0, ar, ma)[1])          # best linear forecast of the next value
    c, g = weights[40, :40], weights[:40, :40]
    assert ahead[0] == pytest.approx(2.5 + c @ np.linalg.solve(g, y - 2.5), rel=1e-6)


def test_every_point_is_stationary_and_comes_back():
    free = np.random.default_rng(1).normal(size=(50, 4))
    ar = lk.constrained(free)
    for row in ar:
        assert max(abs(np.roots(np.r_[1, -row]))) < 1
    assert lk.unconstrained(ar, 0.999999) == pytest.approx(free, rel=1e-5, abs=1e-6)


def test_fits_are_maxima_and_many_series_give_what_one_gives():
    series = [made(n, [0.5, -0.3, 0.2], [0.4, 0.1], 20.0, seed) for seed, n in enumerate((60, 120, 200, 80))]
    forecast, loglik, numbers = lk.fit(series, 3, 0, 2)
    rng = np.random.default_rng(3)
    for i, y in enumerate(series):
        mean, ar, ma = numbers[i, 0], numbers[i, 1:4], numbers[i, 4:]
        assert loglik[i] == pytest.approx(brute_loglik(y, mean, ar, ma)[0], rel=1e-6)
        assert loglik[i] >= brute_loglik(y, 20.0, [0.5, -0.3, 0.2], [0.4, 0.1])[0] - 1e-6
        for _ in range(5):
            other = numbers[i] + rng.normal(size=6) * [0.05, 0.02, 0.02, 0.02, 0.02, 0.02]
            if max(abs(np.roots(np.r_[1, -other[1:4]]))) < 0.99:
                assert loglik[i] >= brute_loglik(y, other[0], other[1:4], other[4:])[0] - 1e-3
        alone = lk.fit([y], 3, 0, 2)
        assert alone[0][0] == pytest.approx(forecast[i], rel=1e-4) and alone[1][0] == pytest.approx(loglik[i], rel=1e-6)


def test_coefficients_are_recovered_from_long_series():
    y = made(4000, [0.6], [0.3], 5.0)
    _, _, numbers = lk.fit([y], 1, 0, 1)
    assert numbers[0] == pytest.approx([5.0, 0.6, 0.3], abs=0.12)


def test_simple_orders_have_simple_answers():
    y = [3.0, 5.0, 4.0, 8.0, 6.0, 7.5, 9.0]
    assert lk.fit([np.array(y)], 0, 0, 0)[0][0] == pytest.approx(np.mean(y), rel=1e-6)
    assert lk.fit([np.array(y)], 0, 1, 0)[0][0] == pytest.approx(9.0, abs=1e-9)
    forecast, loglik, _ = lk.fit([np.array([4.0] * 30), np.array([1.0, 2.0]), np.arange(30.0), np.array([])], 3, 0, 2)
    assert forecast[0] == 4.0 and np.isnan(forecast[[1, 3]]).all() and np.isnan(loglik[[0, 1, 3]]).all() and np.isfinite(forecast[2])
    assert lk.fit([np.arange(30.0) * 2], 1, 1, 0)[0][0] == pytest.approx(60.0)


def test_vehicles_are_forecast_beside_the_regression(spark):
    rows = [(f"v{v}", int(t * 5e6), t, float(x)) for v in range(12) for t, x in enumerate(made(30 + 20 * v, [0.5, -0.3, 0.2], [0.4, 0.1], 30.0, v))]
    rows += [("short", 0, 0, 1.0), ("still", 0, 0, 7.0)] + [("still", int(t * 5e6), t, 7.0) for t in range(1, 20)]
    df = spark.createDataFrame(rows, "vehicle_id string, t_us long, ping_id long, speed_kmh double")
    got = {r["vehicle_id"]: r for r in lk.forecast_speed(df).collect()}
    assert set(got) == {f"v{v}" for v in range(12)} | {"still"} and got["still"]["speed_kmh"] == 7.0
    values = [x for v, _, t, x in rows if v == "v11"][-200:]
    assert got["v11"]["speed_kmh"] == pytest.approx(max(0.0, lk.fit([np.array(values)], 3, 0, 2)[0][0]), rel=1e-3)
    errors = {r["method"]: r for r in lk.compare_methods(df).collect()}
    assert set(errors) == {"likelihood", "regression"} and errors["likelihood"]["n"] >= errors["regression"]["n"] > 5
