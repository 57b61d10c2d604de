"""Forecasts by exact maximum likelihood of (p, d, q) models, for many series at once.

A series of at most ``HISTORY`` values is one row; a task takes some hundred of them together. A Kalman
recursion runs over time once for all, giving the likelihood with the shocks' variance concentrated out and
the forecast of the next value. Coefficients are searched in a space where every point is stationary and
invertible, from the estimates of the two-stage regression, by a quasi-Newton method in which each series
has its own curvature and step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfleet.operators.forecast import (HISTORY, MIN_FORECAST_ROWS, _lagged, _solve, difference_weights, next_timestamp, recent_values,
                                         regression_forecasts)
from wayfleet.operators.scale import cut

SERIES = 512          # series that a task fits together
ROUNDS, HALVINGS = 80, 20
STEP = 1e-5           # of the numeric derivatives
TOGETHER = 8          # variances whose product's logarithm is taken
FLAT = 1e-9           # standard deviation below which a series counts as constant


# -- coefficients -----------------------------------------------------------------------------------

def constrained(free: np.ndarray) -> np.ndarray:
    """Autoregressive coefficients of stationary series from any numbers, [series, lag]: their bounded images are partial autocorrelations."""
    partial = free / np.sqrt(1 + free * free)
    out = np.zeros_like(partial)
    for k in range(partial.shape[1]):
        before = out[:, :k].copy()
        out[:, :k] = before - partial[:, k:k + 1] * before[:, ::-1]
        out[:, k] = partial[:, k]
    return out


def unconstrained(coefficients: np.ndarray, most: float = 0.95) -> np.ndarray:
    """The numbers that ``constrained`` turns into these coefficients, partial autocorrelations beyond ``most`` brought back to it."""
    left = coefficients.astype(float).copy()
    partial = np.zeros_like(left)
    for k in range(left.shape[1] - 1, -1, -1):
        r = np.clip(np.nan_to_num(left[:, k]), -most, most)
        partial[:, k] = r
        before = left[:, :k].copy()
        left[:, :k] = (before + r[:, None] * before[:, ::-1]) / (1 - r * r)[:, None]
    return partial / np.sqrt(1 - partial * partial)


# -- the recursion ----------------------------------------------------------------------------------

def kalman(y: np.ndarray, given: np.ndarray, mean: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, variance of the shocks and forecast of the next value, per series.

    ``y[series, time]`` counts where ``given``; a series' values lie together at the end.
    """
    n_series, p, q = len(y), ar.shape[1], ma.shape[1]
    size = max(p, q + 1)
    a, r = np.zeros((size, n_series)), np.zeros((size, n_series))
    a[:p], r[0], r[1:q + 1] = ar.T, 1, ma.T
    values, known = np.ascontiguousarray(y.T), np.ascontiguousarray(given.T)
    cov, state = _stationary(a, r), [np.zeros(n_series) for _ in range(size)]
    noise = {(i, j): r[i] * r[j] for i in range(size) for j in range(i, size)}
    logs, squares, product = np.zeros(n_series), np.zeros(n_series), np.ones(n_series)
    begun = known.all(axis=1)
    for t in range(len(values)):
        # The state moves by one place and takes in ar times its first: what a value leaves of the covariance does not depend on ar.
        spread, here = cov[0, 0], known[t]
        error = values[t] - mean - state[0]
        share = [cov[0, i] / spread for i in range(1, size)]
        ahead = [a[i] * (state[0] + error) + (state[i + 1] + share[i] * error if i + 1 < size else 0.0) for i in range(size)]
        left = {(i, j): noise[i, j] + (cov[i + 1, j + 1] - share[i] * cov[0, j + 1] if j + 1 < size else 0.0) for i, j in noise}
        counted, squared = spread, error * error / spread
        if not begun[t]:
            counted, squared = np.where(here, spread, 1.0), np.where(here, squared, 0.0)
            ahead = [np.where(here, new, old) for new, old in zip(ahead, state)]
            left = {k: np.where(here, new, cov[k]) for k, new in left.items()}
        product = product * counted
        squares += squared
        if t % TOGETHER == TOGETHER - 1:
            logs += np.log(product)
            product = np.ones(n_series)
        state, cov = ahead, left
    n = given.sum(axis=1)
    variance = np.maximum(squares / n, 1e-300)
    return -0.5 * (n * (np.log(2 * np.pi * variance) + 1) + logs + np.log(product)), variance, mean + state[0]


def _stationary(a: np.ndarray, r: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Covariances ``[i, j]``, j not below i, of the state before the first value, the shocks' variance being one.

    Each one is a sum of products with those of the first row, for which that is a linear system.
    """
    size = len(a)

    def parts(i: int, j: int) -> tuple[list, np.ndarray]:
        row, rest = [np.zeros(a.shape[1]) for _ in range(size + 1)], np.zeros(a.shape[1])
        for k in range(size - j):
            row[0] = row[0] + a[i + k] * a[j + k]
            row[j + k + 1] = row[j + k + 1] + a[i + k]
            row[i + k + 1] = row[i + k + 1] + a[j + k]
            rest = rest + r[i + k] * r[j + k]
        return row[:size], rest

    first = [parts(0, j) for j in range(size)]
    system = np.eye(size) - np.stack([np.stack(row, axis=-1) for row, _ in first], axis=1)
    top = np.linalg.solve(system, np.stack([rest for _, rest in first], axis=-1)[..., None])[..., 0].T.copy()
    cov = {(0, j): top[j] for j in range(size)}
    for i in range(1, size):
        for j in range(i, size):
            row, rest = parts(i, j)
            cov[i, j] = rest + sum(w * c for w, c in zip(row, top))
    return cov


# -- the search -------------------------------------------------------------------------------------

def minimised(f: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Minima of ``f(points, rows)`` near ``x``, a row per problem; each row has its own inverse curvature."""
    rows, k = np.arange(len(x)), x.shape[1]

    def slope(points: np.ndarray, of: np.ndarray) -> np.ndarray:
        moves = np.concatenate([np.eye(k), -np.eye(k)]) * STEP
        values = f((points[None] + moves[:, None]).reshape(-1, k), np.tile(of, 2 * k)).reshape(2 * k, len(of))
        return (values[:k] - values[k:]).T / (2 * STEP)

    x, value = x.copy(), f(x, rows)
    gradient, curve = slope(x, rows), np.tile(np.eye(k), (len(x), 1, 1))
    going = np.ones(len(x), bool)
    for _ in range(rounds):
        at = rows[going]
        if not len(at):
            break
        step = -(curve[at] @ gradient[at][:, :, None])[:, :, 0]
        uphill = (step * gradient[at]).sum(1) >= 0
        curve[at[uphill]], step[uphill] = np.eye(k), -gradient[at[uphill]]
        step /= np.maximum(1, np.abs(step).max(axis=1))[:, None]
        share, new = np.ones(len(at)), value[at].copy()
        waiting = np.ones(len(at), bool)
        for _ in range(HALVINGS):
            tried = f(x[at[waiting]] + share[waiting, None] * step[waiting], at[waiting])
            good = tried < value[at[waiting]] + 1e-4 * share[waiting] * (step[waiting] * gradient[at[waiting]]).sum(1)
            places = np.flatnonzero(waiting)
            new[places[good]] = tried[good]
            waiting[places[good]] = False
            share[waiting] /= 2
            if not waiting.any():
                break
        going[at[waiting]] = False
        at, step, share, new = at[~waiting], step[~waiting], share[~waiting], new[~waiting]
        if not len(at):
            break
        moved = share[:, None] * step
        x[at] += moved
        after = slope(x[at], at)
        change = after - gradient[at]
        slide = (moved * change).sum(1)
        fit = slide > 1e-12
        s, c, rho = moved[fit], change[fit], 1 / slide[fit]
        left = np.eye(k) - rho[:, None, None] * s[:, :, None] * c[:, None, :]
        curve[at[fit]] = left @ curve[at[fit]] @ np.swapaxes(left, 1, 2) + rho[:, None, None] * s[:, :, None] * s[:, None, :]
        going[at[(value[at] - new < 1e-10) | (np.abs(after).max(axis=1) < 1e-7)]] = False
        gradient[at], value[at] = after, new
    return x


def _first_guess(y: np.ndarray, p: int, q: int) -> np.ndarray:
    """Coefficients of the two-stage regression on one centred series; zeros where it is too short."""
    long = max(p, q) + 2 if q else 0
    start = max(p, q) + long
    if len(y) - start <= p + q or not p + q:
        return np.zeros(p + q)
    shocks = np.zeros(len(y))
    if q:
        x = _lagged(y, long)
        shocks[long:] = y[long:] - x @ _solve(x.T @ x, x.T @ y[long:])
    x = np.column_stack([_lagged(y, p)[start - p:], _lagged(shocks, q)[start - q:]])
    return _solve(x.T @ x, x.T @ y[start:])


def fit(series: list[np.ndarray], p: int, d: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(forecast, log likelihood, [mean, ar, ma])`` of each series; NaN where it has no more values than the model has numbers.

    The likelihood is that of the ``d``-th differences; with d > 0 their mean is taken as zero. A constant
    series is forecast to stay, or to go on, as it is.
    """
    k, free_mean = p + q + (d == 0), d == 0
    forecast, likelihood, numbers = np.full(len(series), np.nan), np.full(len(series), np.nan), np.full((len(series), 1 + p + q), np.nan)
    y = [np.diff(np.asarray(s, float), d) for s in series]
    back = [sum(-w * s[-i] for i, w in enumerate(difference_weights(d)) if i) if len(s) >= d else 0.0 for s in series]
    use = [i for i, v in enumerate(y) if len(v) > k + 1]
    flat = [i for i in use if y[i].std() < FLAT]
    for i in flat:
        forecast[i] = y[i][-1] + back[i]
    use = [i for i in use if y[i].std() >= FLAT]
    if not use:
        return forecast, likelihood, numbers
    centre, scale = np.array([y[i].mean() if free_mean else 0.0 for i in use]), np.array([y[i].std() for i in use])
    longest = max(len(y[i]) for i in use)
    held, given = np.zeros((len(use), longest)), np.zeros((len(use), longest), bool)
    for row, i in enumerate(use):
        held[row, longest - len(y[i]):] = (y[i] - centre[row]) / scale[row]
        given[row, longest - len(y[i]):] = True
    n, held_t, given_t = given.sum(axis=1), np.ascontiguousarray(held.T), np.ascontiguousarray(given.T)

    def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (x[:, 0] if free_mean else np.zeros(len(x))), constrained(x[:, int(free_mean):int(free_mean) + p]), -constrained(x[:, int(free_mean) + p:])

    def cost(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        value = -kalman(np.take(held_t, rows, axis=1).T, np.take(given_t, rows, axis=1).T, *split(x))[0] / n[rows]
        return np.where(np.isfinite(value), value, 1e300)

    guess = np.array([_first_guess(h[g], p, q) for h, g in zip(held, given)]).reshape(len(use), p + q)
    start = np.concatenate([np.zeros((len(use), int(free_mean))), unconstrained(guess[:, :p]), unconstrained(-guess[:, p:])], axis=1)
    plain = np.zeros_like(start)
    rows = np.arange(len(use))
    if k:
        better = cost(start, rows) < cost(plain, rows)
        start = minimised(cost, np.where(better[:, None], start, plain))
    mean, ar, ma = split(start)
    loglik, _, ahead = kalman(held, given, mean, ar, ma)
    forecast[use] = ahead * scale + centre + np.array([back[i] for i in use])
    likelihood[use] = loglik - n * np.log(scale)
    numbers[use] = np.column_stack([mean * scale + centre, ar, ma])
    return forecast, likelihood, numbers


# -- the operator -----------------------------------------------------------------------------------

def fit_series(df: DataFrame, order: tuple[int, int, int], key: str = "vehicle_id", values: str = "values") -> DataFrame:
    """``(key, forecast, log_likelihood, coefficients)`` for every row of ``df`` with an array of values, in order.

    ``coefficients`` are the mean, then the autoregressive, then the moving-average ones; all are null where there are too few values.
    """
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SERIES):
                part = batch.iloc[at:at + SERIES]
                forecast, loglik, numbers = fit([np.asarray(v, float) for v in part[values]], *order)
                plain = lambda v: None if np.isnan(v) else float(v)
                yield pd.DataFrame({key: part[key].to_numpy(), "forecast": pd.Series(map(plain, forecast), dtype=object),
                                    "log_likelihood": pd.Series(map(plain, loglik), dtype=object),
                                    "coefficients": pd.Series([None if np.isnan(c).any() else c.tolist() for c in numbers], dtype=object)})

    return df.select(key, values).mapInPandas(work, f"{key} {df.schema[key].dataType.simpleString()}, forecast double, log_likelihood double, coefficients array<double>")


def forecast_speed(df: DataFrame, p: int = 3, d: int = 0, q: int = 2) -> DataFrame:
    """As ``forecast.forecast_speed``, by likelihood: the next speed per vehicle, never below 0, and when it is due."""
    series = recent_values(df).filter(F.size("values") >= MIN_FORECAST_ROWS)
    made = fit_series(series, (p, d, q)).select("vehicle_id", F.greatest(F.lit(0.0), "forecast").alias("speed_kmh"))
    made = made.withColumn("speed_kmh", F.when(F.col("speed_kmh").isNotNull(), F.col("speed_kmh")))
    return made.join(next_timestamp(df).select("vehicle_id", "next_us"), "vehicle_id")


def compare_methods(df: DataFrame, order: tuple[int, int, int] = (3, 0, 2), value: str = "speed_kmh", history: int = HISTORY) -> DataFrame:
    """``(method, n, rmse, mae)`` of forecasting each vehicle's last value from those before it, by likelihood and by two-stage regression."""
    series = recent_values(df, value, history).filter(F.size("values") > MIN_FORECAST_ROWS)
    split = cut(series.select("vehicle_id", F.slice("values", F.lit(1), F.size("values") - 1).alias("values"),
                              F.element_at("values", -1).alias("actual")), "series")
    both = (fit_series(split, order).select("vehicle_id", "forecast", F.lit("likelihood").alias("method"))
            .unionByName(regression_forecasts(split, order).withColumn("method", F.lit("regression"))))
    error = F.col("forecast") - F.col("actual")
    return both.filter("forecast IS NOT NULL").join(split.select("vehicle_id", "actual"), "vehicle_id").groupBy("method").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"))
