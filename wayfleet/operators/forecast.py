"""Forecasting: sequences, splits, speed forecasts and time-to-stop models per polyline.

Fits are least squares on sums of products. Such sums add up, so they are formed per slice or per
Arrow batch where the rows are and only the small matrices travel; no task ever holds a whole
vehicle, trip or polyline.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfleet.operators.scale import (SLICE_SECONDS, Hot, by_size, cut, drop_halo, hot_groups, lookup_join, may_broadcast,  # noqa: F401  (a test sets it)
                                      prefix_sums, require)
from wayfleet.operators.trips import ORDER, TRIP, numbered

# The results depend on these defaults.
SEQUENCE_LENGTH = 10
ETA_FEATURES = ("latitude", "longitude", "speed_kmh", "dist_to_end")
HISTORY = 200
MIN_FORECAST_ROWS = 5
DEFAULT_STEP_SECONDS = 5.0
STEP_LIMITS = (1.0, 60.0)
STEPS_AVERAGED = 4
RIDGE = 1e-6
JITTER = 1e-12    # keeps the normal equations of a constant series solvable
ROWS_PER_SLICE = 4096


# -- sequences and splits -------------------------------------------------------------------------

def clean_features(df: DataFrame, features: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Missing feature columns become 0, rows lacking a required value go, NULL features become 0."""
    lacking = {c: F.lit(0.0) for c in features if c not in df.columns}
    df = df.withColumns(lacking) if lacking else df
    return df.dropna(subset=list(required)).fillna(0.0, subset=list(features)) if required else df.fillna(
        0.0, subset=list(features))


def last_rows(df: DataFrame, n: int, key: str = "vehicle_id") -> DataFrame:
    """The last ``n`` rows per vehicle, ``_rank`` 1 being the newest (the limit applies before the shuffle)."""
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in ORDER])
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n)


def recent_history(df: DataFrame, n: int = HISTORY) -> DataFrame:
    return last_rows(df, n).withColumnRenamed("_rank", "age")


def last_sequence(df: DataFrame, n: int = SEQUENCE_LENGTH, features: Sequence[str] = ETA_FEATURES) -> DataFrame:
    """Per vehicle its last ``n`` rows as one flat feature list, keyed by the newest row's polyline.

    Vehicles with fewer rows, or whose newest row has no polyline, are left out.
    """
    rows = last_rows(clean_features(df, features), n)
    step = F.struct((-F.col("_rank")).alias("o"), F.array(*features).alias("x"))
    newest = lambda c: F.max(F.when(F.col("_rank") == 1, F.col(c))).alias(c)
    seq = rows.groupBy("vehicle_id").agg(
        F.array_sort(F.collect_list(step)).alias("_s"), newest("route"), newest("polyline_idx"), newest("t_us"))
    return (seq.filter((F.size("_s") == n) & F.col("route").isNotNull() & F.col("polyline_idx").isNotNull())
               .withColumn("sequence", F.flatten(F.transform("_s", lambda s: s["x"]))).drop("_s"))


def with_row_halo(df: DataFrame, before: int, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Cut numbered rows into blocks of consecutive positions, each with the ``before`` rows ahead of it."""
    at = lambda pos: F.floor(pos / rows_per_slice)
    return (df.withColumn("_block", F.explode(F.sequence(at(F.col("pos")), at(F.col("pos") + before))))
              .withColumn("_home", F.col("_block") == at(F.col("pos"))))


def training_sequences(df: DataFrame, n: int = SEQUENCE_LENGTH, features: Sequence[str] = ETA_FEATURES,
                       target: str = "eta_seconds", by: Sequence[str] = TRIP, slice_seconds: int = SLICE_SECONDS,
                       rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Rows i … i+n-1 of a group as one flat feature list, with row i+n's ``target``."""
    require(df, *by, *ORDER, target)
    df = clean_features(df, features)
    hot = hot_groups(df, by)

    def looking_back(rows: DataFrame, *block: str) -> DataFrame:
        before = Window.partitionBy(*by, *block).orderBy("pos").rowsBetween(-n, -1)
        return rows.withColumn("_s", F.collect_list(F.array(*features)).over(before)).filter(F.size("_s") == n)

    seq = by_size(numbered(df, by, slice_seconds, hot), by, looking_back,
                  lambda rows: drop_halo(looking_back(with_row_halo(rows, n, rows_per_slice), "_block")).drop("_block"), hot)
    return seq.withColumn("sequence", F.flatten("_s")).withColumnRenamed(target, "target").drop("_s", "pos")


def split_by_trip(df: DataFrame, test_ratio: float = 0.2, seed: int = 42, by: Sequence[str] = TRIP) -> DataFrame:
    """Add ``is_test``: whole trips, in hash order, until they hold at least ``floor(ratio * rows)`` rows.

    At least one trip is in the test part. The running size over many trips is taken within 4096 hash
    ranges on top of the sizes of the earlier ranges. The test part is the trips up to one of them in that
    order, so only that one goes back to the rows, which are not shuffled.
    """
    if not 0 <= test_ratio <= 1:
        raise ValueError("test_ratio must be between 0 and 1")
    shuffled = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by]))
    sizes = cut(df.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("_hash", shuffled)
                  .withColumns({"_range": F.substring("_hash", 1, 3), "_all": F.lit(1)}), "sizes")
    total = sizes.groupBy("_all").agg(F.floor(F.sum("_n") * F.lit(test_ratio)).alias("_target"))
    running = prefix_sums(sizes, ["_all"], "_range", ["_hash", *by], {"_upto": F.col("_n")}).join(F.broadcast(total), "_all")
    before = F.col("_upto") - F.col("_n")
    place = lambda h: F.struct(h.alias("_hash"), *by)
    chosen = running.filter((before < F.col("_target")) | (before == 0))
    last = chosen.agg(F.max(place(F.col("_hash"))).alias("_last")).select("_last.*").first()
    upto = F.struct(F.lit(last["_hash"]).cast("string").alias("_hash"), *[F.lit(last[c]).cast(df.schema[c].dataType).alias(c) for c in by])
    return df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in by)).withColumn("is_test", place(shuffled) <= upto)


def scaler(sequences: DataFrame, n_features: int) -> DataFrame:
    """Mean and population deviation per feature over all rows of all sequences."""
    steps = sequences.select(F.posexplode("sequence").alias("_i", "_x"))
    return steps.groupBy((F.col("_i") % n_features).alias("feature")).agg(
        F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"), F.count("*").alias("n"))


# -- speed forecasts ------------------------------------------------------------------------------

def next_timestamp(df: DataFrame) -> DataFrame:
    """When the next ping is due: the mean of the last whole-second gaps, kept within [1, 60] s."""
    rows = last_rows(df, STEPS_AVERAGED + 1)
    older = Window.partitionBy("vehicle_id").orderBy("_rank")
    rows = rows.withColumn("_gap", F.floor((F.col("t_us") - F.lead("t_us").over(older)) / F.lit(1e6)))
    per = rows.groupBy("vehicle_id").agg(F.max("t_us").alias("t_us"), F.avg("_gap").alias("_g"))
    low, high = STEP_LIMITS
    step = F.when(F.col("_g").isNull(), DEFAULT_STEP_SECONDS).otherwise(
        F.greatest(F.lit(low), F.least(F.lit(high), F.col("_g"))))
    return per.select("vehicle_id", "t_us", step.alias("step_seconds"),
                      (F.col("t_us") + F.round(step * 1e6).cast("long")).alias("next_us"))


def difference_weights(d: int) -> list[float]:
    """Weights of a value and its ``d`` predecessors in the ``d``-th difference."""
    return [float((-1) ** k * comb(d, k)) for k in range(d + 1)]


def _lagged(y: np.ndarray, lags: int) -> np.ndarray:
    return np.column_stack([y[lags - k: len(y) - k] for k in range(1, lags + 1)]) if lags else np.empty((len(y), 0))


def _solve(xtx: np.ndarray, xty: np.ndarray) -> np.ndarray:
    scale = np.trace(xtx, axis1=-2, axis2=-1)[..., None, None] / xtx.shape[-1]
    return np.linalg.solve(xtx + JITTER * np.maximum(scale, 1e-9) * np.eye(xtx.shape[-1]), xty[..., None])[..., 0]


def one_step_forecast(values: np.ndarray, p: int, d: int, q: int) -> float | None:
    """Two-stage regression forecast of the value after the last one, None if there are too few.

    The ``d``-th differences are regressed on ``p`` own lags and ``q`` shock lags. The shocks are the errors
    of an autoregression on two lags more than the longer of both. A regression needs more rows than
    it has coefficients. Values are counted from the first one, which keeps large ones exact.
    """
    first = values[0] if len(values) else 0.0
    y = np.diff(np.asarray(values, dtype=float) - first, d)
    long = max(p, q) + 2 if q else 0
    start = max(p, q) + long
    if len(y) - start <= 1 + p + q or q and len(y) - long <= 1 + long:
        return None
    shocks = np.zeros(len(y))
    if q:
        x = np.column_stack([np.ones(len(y) - long), _lagged(y, long)])
        shocks[long:] = y[long:] - x @ _solve(x.T @ x, x.T @ y[long:])
    own, shock = _lagged(y, p)[start - p:], _lagged(shocks, q)[start - q:]
    x = np.column_stack([np.ones(len(y) - start), own, shock])
    beta = _solve(x.T @ x, x.T @ y[start:])
    forecast = float(np.concatenate([[1.0], y[::-1][:p], shocks[::-1][:q]]) @ beta)
    back = sum(-w * values[-k] for k, w in enumerate(difference_weights(d)) if k)
    return forecast + float(back) + (0.0 if d else float(first))


def recent_values(df: DataFrame, value: str = "speed_kmh", history: int = HISTORY) -> DataFrame:
    """``(vehicle_id, values)``: at most the last ``history`` values of each vehicle in time order, NULL counting as 0."""
    rows = last_rows(df, history).select("vehicle_id", "_rank", F.coalesce(value, F.lit(0.0)).alias("value"))
    ordered = F.sort_array(F.collect_list(F.struct(-F.col("_rank"), "value")))
    return rows.groupBy("vehicle_id").agg(F.transform(ordered, lambda r: r["value"]).alias("values"))


def regression_forecasts(series: DataFrame, order: tuple[int, int, int]) -> DataFrame:
    """``(vehicle_id, forecast)`` by ``one_step_forecast`` for every row with an array of ``values``."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [one_step_forecast(np.asarray(v, float), *order) for v in batch["values"]]
            yield pd.DataFrame({"vehicle_id": batch["vehicle_id"], "forecast": pd.Series(made, dtype=object)})

    key = series.schema["vehicle_id"].dataType.simpleString()
    return series.select("vehicle_id", "values").mapInPandas(work, f"vehicle_id {key}, forecast double")


def forecast_speed(df: DataFrame, p: int = 3, d: int = 0, q: int = 2) -> DataFrame:
    """Next speed per vehicle from at most its last 200 values (NULL counts as 0), never below 0.

    Vehicles with fewer than five rows are left out; the speed is NULL where the order needs more rows
    than there are. A vehicle is one row of at most 200 values.
    """
    series = recent_values(df).filter(F.size("values") >= MIN_FORECAST_ROWS)
    made = regression_forecasts(series, (p, d, q))
    speeds = made.select("vehicle_id", F.when(F.col("forecast").isNotNull(), F.greatest(F.lit(0.0), "forecast")).alias("speed_kmh"))
    return speeds.join(next_timestamp(df).select("vehicle_id", "next_us"), "vehicle_id")


def numbered_values(df: DataFrame, value: str, by: Sequence[str] = TRIP, slice_seconds: int = SLICE_SECONDS) -> tuple[DataFrame, Hot]:
    """Known values of each trip with their position; and the hot trips, for which the rows are stored."""
    known = df.filter(F.col(value).isNotNull()).select(*by, *ORDER, F.col(value).alias("y"))
    hot = hot_groups(known, by)
    placed = numbered(known, by, slice_seconds, hot)
    return (placed if hot.keys is None else cut(placed, "numbered")), hot


def _with_lags(df: DataFrame, by: Sequence[str], columns: dict[str, int], rows_per_slice: int, hot: Hot) -> DataFrame:
    """Add ``<column>_1 … <column>_n``, and the ``_block`` of each row of a hot trip."""
    def lagged(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*by, "_block").orderBy("pos")
        return drop_halo(rows.withColumns({f"{c}_{k}": F.lag(c, k).over(w) for c, n in columns.items() for k in range(1, n + 1)}))

    return by_size(df, by, lambda rows: lagged(rows.withColumns({"_block": F.lit(0).cast("long"), "_home": F.lit(True)})),
                   lambda rows: lagged(with_row_halo(rows, max(columns.values()), rows_per_slice)), hot)


def _expanding_moments(df: DataFrame, by: Sequence[str], xs: Sequence[str], y: str, hot: Hot) -> DataFrame:
    """``_xtx`` and ``_xty``: sums of products over the trip's earlier complete rows."""
    usable = F.lit(True)
    for c in [*xs, y]:
        usable = usable & F.col(c).isNotNull()
    terms = {"_s_0": F.lit(1.0)}
    names = ["_one", *xs]
    cell = {}
    for i, a in enumerate(names):
        for j, b in enumerate([*names, y]):
            if j < i:
                continue
            left = F.lit(1.0) if a == "_one" else F.col(a)
            right = F.lit(1.0) if b == "_one" else F.col(b)
            cell[(i, j)] = f"_s_{len(cell)}"
            terms[cell[(i, j)]] = F.when(usable, left * right).otherwise(0.0)
    summed = prefix_sums(df, by, "_block", ["pos"], terms, hot)
    upto = lambda i, j: F.col(cell[(min(i, j), max(i, j))]) - terms[cell[(min(i, j), max(i, j))]]
    k = len(names)
    return summed.withColumns({
        "_xtx": F.array(*[upto(i, j) for i in range(k) for j in range(k)]),
        "_xty": F.array(*[upto(i, k) for i in range(k)])}).drop(*terms)


def _predictions(choices: Sequence[Sequence[int]], k: int):
    """Vectorised solver: for every row one prediction per choice of regressors (NULL if not solvable)."""
    @F.pandas_udf("array<double>")
    def solve(xtx: pd.Series, xty: pd.Series, x: pd.Series) -> pd.Series:
        a = np.stack(xtx.to_numpy()).astype(float).reshape(-1, k, k)
        b = np.stack(xty.to_numpy()).astype(float)
        now = np.stack([np.asarray(v, dtype=float) for v in x])
        out = np.full((len(a), len(choices)), np.nan)
        for i, cols in enumerate(choices):
            pick = np.asarray(cols)
            ok = (a[:, 0, 0] > len(cols)) & ~np.isnan(now[:, pick]).any(axis=1)
            if ok.any():
                beta = _solve(a[ok][:, pick[:, None], pick[None, :]], b[ok][:, pick])
                out[ok, i] = (beta * now[ok][:, pick]).sum(axis=1)
        return pd.Series([[None if np.isnan(v) else float(v) for v in row] for row in out])
    return solve


def _order_forecasts(base: DataFrame, order: tuple[int, int, int], min_len: int, by: list[str], rows_per_slice: int, hot: Hot) -> DataFrame:
    """Forecasts of one order from ``base`` (position and value), fitted on all earlier rows that have this order's lags."""
    p, d, q = order
    lagged = lambda df, columns: _with_lags(df, by, columns, rows_per_slice, hot)
    rows = lagged(base, {"value": d}).drop("_block") if d else base
    past = list(enumerate(difference_weights(d)))[1:]
    z = sum((F.col(f"value_{k}") * w for k, w in past), F.col("value"))
    back = sum((F.col(f"value_{k}") * -w for k, w in past), F.lit(0.0))
    kept = [*by, *ORDER, "pos", "value", "first", "z", "back"]
    rows = rows.withColumns({"z": z, "back": back}).select(*kept)
    if q:
        long = max(p, q) + 2
        xs = [f"z_{k}" for k in range(1, long + 1)]
        fitted = _expanding_moments(lagged(rows, {"z": long}), by, xs, "z", hot).withColumn(
            "_p", _predictions([list(range(long + 1))], long + 1)("_xtx", "_xty", F.array(F.lit(1.0), *xs)))
        rows = cut(fitted.select(*kept, (F.col("z") - F.col("_p")[0]).alias("e")), "shocks")
    xs = [f"z_{k}" for k in range(1, p + 1)] + [f"e_{k}" for k in range(1, q + 1)]
    solved = _expanding_moments(lagged(rows, {c: n for c, n in (("z", p), ("e", q)) if n}), by, xs, "z", hot).withColumn(
        "_p", _predictions([list(range(len(xs) + 1))], len(xs) + 1)("_xtx", "_xty", F.array(F.lit(1.0), *xs)))
    return solved.filter(F.col("pos") >= min_len).select(
        *by, *ORDER, "pos", (F.col("value") + F.col("first")).alias("actual"), F.lit(p).alias("p"), F.lit(d).alias("d"), F.lit(q).alias("q"),
        (F.col("_p")[0] + F.col("back") + F.col("first")).alias("predicted"))


def expanding_forecasts(df: DataFrame, orders: Sequence[tuple[int, int, int]], min_len: int, value: str = "speed_kmh",
                        by: Sequence[str] = TRIP, slice_seconds: int = SLICE_SECONDS,
                        rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """One-step forecasts of every value from position ``min_len`` on, fitted on the trip's earlier values.

    Each (p, d, q) is fitted on its own: on all earlier rows that have its lags, whatever other orders
    are asked for; with no more rows than coefficients there is no forecast. Shocks are the errors of an
    expanding autoregression on two lags more than the longer of p and q. Sums of products run over
    values counted from the trip's first, so that large ones do not cancel.
    """
    by = list(by)
    numbered, hot = numbered_values(df, value, by, slice_seconds)
    first = lambda rows: rows.filter("pos = 0").select(*by, F.col("y").alias("first"))
    centred = by_size(numbered, by, lambda rows: rows.withColumn("first", F.first("y").over(Window.partitionBy(*by).orderBy("pos"))),
                      lambda rows: lookup_join(rows, first(rows), by), hot).withColumn("value", F.col("y") - F.col("first"))
    base = cut(centred.select(*by, *ORDER, "pos", "value", "first"), "centred")
    made = [_order_forecasts(base, tuple(o), min_len, by, rows_per_slice, hot) for o in orders]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def expanding_ar1(df: DataFrame, min_len: int, value: str = "speed_kmh", by: Sequence[str] = TRIP,
                  slice_seconds: int = SLICE_SECONDS, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """First-order case in closed form: slope and intercept over the trip's earlier (previous, current) pairs.

    Where the earlier values do not vary, the slope is 0 and the forecast their mean.
    """
    by = list(by)
    numbered, hot = numbered_values(df, value, by, slice_seconds)
    rows = _with_lags(numbered, by, {"y": 1}, rows_per_slice, hot)
    x, y, pair = F.col("y_1"), F.col("y"), F.col("y_1").isNotNull()
    part = {"n": F.when(pair, 1.0), "sx": x, "sy": F.when(pair, y), "sxx": x * x, "sxy": x * y}
    part = {k: F.coalesce(v, F.lit(0.0)) for k, v in part.items()}
    s = prefix_sums(rows, by, "_block", ["pos"], {f"_{k}": v for k, v in part.items()}, hot)
    s = s.withColumns({f"_{k}": F.col(f"_{k}") - v for k, v in part.items()})
    spread = F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    varies = spread > 1e-6 * F.col("_n") * F.col("_n")
    s = s.withColumn("slope", F.when(F.col("_n") >= 2, F.when(
        varies, (F.col("_n") * F.col("_sxy") - F.col("_sx") * F.col("_sy")) / spread).otherwise(0.0)))
    s = s.withColumn("intercept", (F.col("_sy") - F.col("slope") * F.col("_sx")) / F.col("_n"))
    return s.filter(F.col("pos") >= min_len).select(
        *by, *ORDER, "pos", F.col("y").alias("actual"), "slope", "intercept",
        (F.col("intercept") + F.col("slope") * F.col("y_1")).alias("predicted"))


# -- errors ---------------------------------------------------------------------------------------

def forecast_errors(df: DataFrame, by: Sequence[str] = (), actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MSE, RMSE, MAE over the rows with a prediction, how many there are, and their share."""
    e = F.col(actual) - F.col(predicted)
    out = df.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                              F.count("*").alias("n"), F.count(e).alias("n_ok"))
    return out.withColumns({"rmse": F.sqrt("mse"), "success_rate": F.col("n_ok") / F.col("n")})


def mean_errors(errors: DataFrame) -> DataFrame:
    return errors.agg(F.count("*").alias("n_models"), F.avg("rmse").alias("mean_rmse"), F.avg("mae").alias("mean_mae"))


def rollup_orders(per_trip: DataFrame) -> DataFrame:
    """Errors per (p, d, q) over the trips, weighted by their number of predictions."""
    w = F.col("n_ok")
    scored = per_trip.filter(F.col("mse").isNotNull())
    return scored.groupBy("p", "d", "q").agg(
        (F.sum(F.col("mse") * w) / F.sum(w)).alias("weighted_mse"),
        (F.sum(F.col("rmse") * w) / F.sum(w)).alias("weighted_rmse"),
        F.avg("mse").alias("mean_mse"), F.stddev_pop("mse").alias("std_mse"), F.avg("rmse").alias("mean_rmse"),
        F.count("*").alias("n_trips"), F.sum(w).alias("total_weight"))


def best_orders(rolled: DataFrame, top: int = 5) -> DataFrame:
    return rolled.orderBy(F.round("weighted_mse", 6), "p", "d", "q").limit(top)


def order_grid(p: Sequence[int], d: Sequence[int], q: Sequence[int]) -> list[tuple[int, int, int]]:
    """All (p, d, q) except p = q = 0."""
    return [o for o in product(p, d, q) if o[0] or o[2]]


def grid_search(df: DataFrame, orders: Sequence[tuple[int, int, int]], min_len: int, n_trips: int | None = None,
                by: Sequence[str] = TRIP, **options) -> DataFrame:
    """Errors of every order, rolled up over all trips, or over the ``n_trips`` largest."""
    if n_trips is not None:
        sizes = df.groupBy(*by).agg(F.count("*").alias("_n")).orderBy(F.col("_n").desc(), *by).limit(n_trips)
        df = df.join(sizes.select(*by), list(by), "left_semi")
    made = expanding_forecasts(df, orders, min_len, by=by, **options)
    return rollup_orders(forecast_errors(made, [*by, "p", "d", "q"]))


# -- time-to-stop models --------------------------------------------------------------------------

MODEL_KEY = ["route", "polyline_idx"]
STORED_MODEL = "route string, polyline_idx int, ridge double, n_samples long, coefficients array<double>, window int"


def polyline_moments(sequences: DataFrame, keys_held: int = 512) -> DataFrame:
    """Sums of products per polyline, ``(route, polyline_idx, i, s)`` for the flattened matrix.

    Every task adds its Arrow batches up and hands on one small matrix per polyline it met (or
    whenever it holds ``keys_held`` of them), so the shuffle does not grow with the rows.
    """
    def flushed(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(r, line, m.ravel().tolist()) for (r, line), m in held.items()], columns=[*MODEL_KEY, "m"])

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for rows in batches:
            for (route, line), g in rows.groupby(MODEL_KEY, sort=False):
                full = np.column_stack([np.ones(len(g)), np.stack(g["sequence"].to_numpy()).astype(float),
                                        g["target"].to_numpy(dtype=float)])
                held[(route, int(line))] = held.get((route, int(line)), 0.0) + full.T @ full
            if len(held) >= keys_held:
                yield flushed(held)
                held = {}
        if held:
            yield flushed(held)

    parts = sequences.filter(F.col("target").isNotNull()).select(*MODEL_KEY, "sequence", "target").mapInPandas(
        reduce, "route string, polyline_idx int, m array<double>")
    return parts.select(*MODEL_KEY, F.posexplode("m").alias("i", "v")).groupBy(*MODEL_KEY, "i").agg(F.sum("v").alias("s"))


def fit_polylines(moments: DataFrame, n_inputs: int, ridges: Sequence[float] = (RIDGE,)) -> DataFrame:
    """Coefficients (intercept first) per polyline and ridge; a group is one matrix of fixed size."""
    k = n_inputs + 1

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        m = cells.sort_values("i")["s"].to_numpy(dtype=float).reshape(k + 1, k + 1)
        xtx, xty = m[:k, :k], m[:k, k]
        spread = np.sqrt(np.maximum(np.diag(xtx), 1e-12))
        rows = []
        for ridge in ridges:
            beta = np.linalg.solve(xtx / np.outer(spread, spread) + ridge * np.eye(k), xty / spread) / spread
            rows.append((cells["route"].iloc[0], int(cells["polyline_idx"].iloc[0]), float(ridge), int(m[0, 0]), beta.tolist()))
        return pd.DataFrame(rows, columns=[*MODEL_KEY, "ridge", "n_samples", "coefficients"])

    return moments.groupBy(*MODEL_KEY).applyInPandas(
        solve, "route string, polyline_idx int, ridge double, n_samples long, coefficients array<double>")


def train_eta(eta_rows: DataFrame, n: int = SEQUENCE_LENGTH, features: Sequence[str] = ETA_FEATURES,
              test_ratio: float = 0.2, seed: int = 42, ridges: Sequence[float] = (RIDGE,),
              slice_seconds: int = SLICE_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(models, test sequences): a linear model per polyline on the training trips.

    Polylines seen in fewer than two trips get no model.
    """
    rows = eta_rows.filter(F.col("route").isNotNull() & F.col("polyline_idx").isNotNull())
    trip = F.when(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in TRIP)), F.struct(*TRIP))
    enough = rows.groupBy(*MODEL_KEY).agg(F.min(trip).alias("_a"), F.max(trip).alias("_z")).filter("_a <> _z").select(*MODEL_KEY)
    needed = [c for c in rows.columns if c in {*TRIP, *ORDER, *MODEL_KEY, *features, "eta_seconds"}]
    rows = rows.select(*needed).join(enough, MODEL_KEY, "left_semi").dropna(subset=["eta_seconds"])
    split = split_by_trip(rows, test_ratio, seed)
    made = cut(training_sequences(split, n, features, by=[*TRIP, *MODEL_KEY], slice_seconds=slice_seconds).drop(*features), "sequences")
    models = fit_polylines(polyline_moments(made.filter(~F.col("is_test"))), n * len(features), ridges)
    return models, made.filter("is_test")


def score(sequences: DataFrame, models: DataFrame) -> DataFrame:
    """Predicted seconds, at least 0; sequences of polylines without a model are left out."""
    dot = F.aggregate(F.zip_with("sequence", F.slice("coefficients", F.lit(2), F.size("coefficients") - 1), lambda x, b: x * b),
                      F.element_at("coefficients", 1), lambda acc, v: acc + v)
    return sequences.join(models, MODEL_KEY).withColumn("predicted", F.greatest(F.lit(0.0), dot)).drop("coefficients")


def evaluate_eta(test: DataFrame, models: DataFrame) -> DataFrame:
    return forecast_errors(score(test, models), [*MODEL_KEY, "ridge"], "target")


def search_eta(errors: DataFrame) -> DataFrame:
    """The ridge with the lowest test error per polyline."""
    return errors.groupBy(*MODEL_KEY).agg(
        F.min_by(F.struct("ridge", "rmse", "mae", "n"), F.struct(F.round("rmse", 6), "ridge")).alias("_b")).select(
        *MODEL_KEY, "_b.*")


def predict_eta(enriched: DataFrame, models: DataFrame, n: int = SEQUENCE_LENGTH,
                features: Sequence[str] = ETA_FEATURES) -> DataFrame:
    """Arrival of each vehicle at its next stop: ``eta_us`` = its last ping plus the predicted seconds."""
    scored = score(last_sequence(enriched, n, features), models)
    return scored.select("vehicle_id", *MODEL_KEY, "predicted",
                         (F.col("t_us") + F.round(F.col("predicted") * 1e6).cast("long")).alias("eta_us"))


def store_models(models: DataFrame, path: str, n: int = SEQUENCE_LENGTH) -> None:
    """Write models with their window of ``n`` pings as a new set, in a folder per route."""
    models.withColumn("window", F.lit(n)).write.mode("errorifexists").partitionBy("route").parquet(path)


def load_models(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """The stored models, or those of ``keys(route, polyline_idx)``; keys without a model give no row."""
    stored = spark.read.schema(STORED_MODEL).parquet(path)
    return stored if keys is None else stored.join(keys.select(*MODEL_KEY).distinct(), MODEL_KEY, "left_semi")


def list_models(models: DataFrame) -> DataFrame:
    return models.select(*MODEL_KEY, F.size("coefficients").alias("n_coefficients")).distinct()
