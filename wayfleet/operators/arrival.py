"""Nonlinear time-to-stop models and a random search over them.

A model looks at the last pings of a vehicle through one hidden layer: standardised inputs go on as they
are and through ``hidden`` tanh units with weights drawn from a seed, and per polyline a ridge regression on
all of them gives the seconds to the next stop. Training takes sums of products over tasks, as the linear
model does, in one pass over the sequences. The search draws window, features, hidden units and ridge,
fits on the training trips, chooses on the validation trips, and only what it chose meets the test trips.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfleet.operators.forecast import (ETA_FEATURES, MODEL_KEY, fit_polylines, forecast_errors, polyline_moments, scaler, score,
                                         split_by_trip, training_sequences)
from wayfleet.operators.scale import SLICE_SECONDS, cut
from wayfleet.operators.trips import ORDER, TRIP


@dataclass(frozen=True)
class Shape:
    """What a model looks at and how: ``window`` pings of ``features``, hidden units, ridge, seed of the hidden weights."""

    window: int = 10
    features: tuple[str, ...] = tuple(ETA_FEATURES)
    hidden: int = 64
    ridge: float = 1e-4
    seed: int = 0

    def layer(self) -> tuple[np.ndarray, np.ndarray]:
        rng, inputs = np.random.default_rng(self.seed), self.window * len(self.features)
        return rng.normal(size=(inputs, self.hidden)) * np.sqrt(2 / inputs), rng.uniform(-2, 2, self.hidden)


@dataclass(frozen=True)
class Model:
    """A shape with the inputs' scale and the coefficients per polyline, a table ``(route, polyline_idx, coefficients, …)``."""

    shape: Shape
    mean: tuple[float, ...]
    std: tuple[float, ...]
    coefficients: DataFrame

    def lifted(self, sequences: DataFrame) -> DataFrame:
        return lifted(sequences, self.shape, self.mean, self.std)

    def predict(self, sequences: DataFrame) -> DataFrame:
        """``predicted`` seconds for ``sequences(route, polyline_idx, sequence, …)``; polylines without a model are left out."""
        return score(self.lifted(sequences), self.coefficients).drop("sequence")


def lifted(sequences: DataFrame, shape: Shape, mean: Sequence[float], std: Sequence[float]) -> DataFrame:
    """``sequence`` as the regression sees it: standardised, then through the hidden units."""
    weights, bias = shape.layer()
    centre, spread = np.tile(mean, shape.window), np.tile([s if s > 1e-12 else 1.0 for s in std], shape.window)

    @F.pandas_udf("array<double>")
    def through(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        x = (np.stack(column.to_numpy()).astype(float) - centre) / spread
        return pd.Series(list(np.concatenate([x, np.tanh(x @ weights + bias)], axis=1)))

    return sequences.withColumn("sequence", through("sequence"))


def three_parts(rows: DataFrame, test_ratio: float = 0.2, validation_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``part``: whole trips are ``test``, ``validation`` or ``train``; validation is a share of what isn't test."""
    split = split_by_trip(rows, test_ratio, seed)
    rest = split_by_trip(split.filter(~F.col("is_test")).drop("is_test"), validation_ratio, seed + 1)
    rest = rest.withColumn("part", F.when(F.col("is_test"), "validation").otherwise("train")).drop("is_test")
    return rest.unionByName(split.filter("is_test").drop("is_test").withColumn("part", F.lit("test")))


def sequences(rows: DataFrame, shape: Shape, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Training sequences of rows with a polyline and a known time to the stop."""
    by = [*TRIP, *MODEL_KEY]
    known = rows.select(*[c for c in rows.columns if c in {*by, *ORDER, *shape.features, "eta_seconds", "part"}])
    known = known.dropna(subset=["route", "polyline_idx", "eta_seconds"])
    return training_sequences(known, shape.window, list(shape.features), by=by, slice_seconds=slice_seconds).drop(*shape.features)


def train(made: DataFrame, shape: Shape) -> Model:
    """Fit ``shape`` to ``made(route, polyline_idx, sequence, target)``."""
    scale = {r["feature"]: (r["mean"], r["std"]) for r in scaler(made, len(shape.features)).collect()}
    mean, std = zip(*[scale.get(i, (0.0, 1.0)) for i in range(len(shape.features))])
    up = lifted(made, shape, mean, std)
    inputs = shape.window * len(shape.features) + shape.hidden
    return Model(shape, mean, std, cut(fit_polylines(polyline_moments(up), inputs, [shape.ridge]), "arrival"))


def evaluate(model: Model, made: DataFrame) -> DataFrame:
    """``(rmse, mae, n, …)`` of the model on sequences with a target, over all polylines together."""
    return forecast_errors(model.predict(made).withColumn("whole", F.lit(1)), ["whole"], "target").drop("whole")


def draw(trials: int, seed: int, windows: Sequence[int] = (3, 5, 10), features: Sequence[str] = tuple(ETA_FEATURES),
         hidden: Sequence[int] = (0, 16, 64), ridges: tuple[float, float] = (1e-6, 1.0)) -> list[Shape]:
    """So many different shapes: any window, at least one feature, any number of hidden units, a ridge of any size in between."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < trials:
        picked = tuple(f for f in features if rng.random() < 0.7) or (features[int(rng.integers(len(features)))],)
        ridge = float(10 ** rng.uniform(np.log10(ridges[0]), np.log10(ridges[1])))
        out.append(Shape(int(rng.choice(windows)), picked, int(rng.choice(hidden)), ridge, int(rng.integers(2**31))))
    return out


def search(parts: DataFrame, shapes: Sequence[Shape], slice_seconds: int = SLICE_SECONDS) -> tuple[Model, DataFrame]:
    """``(best model, trials)`` from ``three_parts``: fitted on ``train``, chosen by the error on ``validation``.

    Rows of the test part are dropped before anything else; ``parts`` is read for every window and choice of features. Trials come as ``(trial, window, features, hidden, ridge, rmse, mae, n)``;
    ties go to the earlier one, and a shape that nothing can be predicted with comes last.
    """
    spark, seen, tried, models = parts.sparkSession, {}, [], []
    rows = parts.filter(F.col("part") != "test")
    for trial, shape in enumerate(shapes):
        looks = shape.window, shape.features
        if looks not in seen:
            seen[looks] = cut(sequences(rows, shape, slice_seconds), "sequences")
        models.append(train(seen[looks].filter("part = 'train'"), shape))
        error = evaluate(models[-1], seen[looks].filter("part = 'validation'")).first()
        tried.append((trial, shape.window, ",".join(shape.features), shape.hidden, shape.ridge,
                      *((error["rmse"], error["mae"], error["n"]) if error else (None, None, 0))))
    best = min(tried, key=lambda t: (t[5] is None, t[5] or 0.0, t[0]))[0]
    return models[best], spark.createDataFrame(tried, "trial int, window int, features string, hidden int, ridge double, rmse double, mae double, n long")


def test_errors(model: Model, parts: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Errors of a chosen model on the test trips, with its shape."""
    made = sequences(parts.filter("part = 'test'"), model.shape, slice_seconds)
    shape = {k: ",".join(v) if isinstance(v, tuple) else v for k, v in asdict(model.shape).items()}
    return evaluate(model, made).withColumns({k: F.lit(v) for k, v in shape.items()})
