import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfleet.operators import arrival
from wayfleet.operators.arrival import Shape

SCHEMA = "vehicle_id string, segment_no long, t_us long, ping_id long, route string, polyline_idx int, a double, b double, eta_seconds double"


@pytest.fixture(scope="module")
def parts(spark):
    """Trips whose time to the stop is a bent function of two slowly moving features."""
    rng, rows = random.Random(1), []
    for trip in range(60):
        a, b = rng.uniform(-2, 2), rng.uniform(-2, 2)
        for i in range(30):
            a, b = a + rng.gauss(0, 0.15), b + rng.gauss(0, 0.15)
            eta = 60 + 40 * math.tanh(2 * a) * math.sin(1.5 * b) + rng.gauss(0, 1)
            rows.append((f"v{trip}", 1, int(i * 5e6), i, "R", trip % 2, a, b, eta))
    return arrival.three_parts(spark.createDataFrame(rows, SCHEMA), seed=7).cache()


def test_trips_are_whole_and_in_one_part(parts):
    got = {r["vehicle_id"]: r["p"] for r in parts.groupBy("vehicle_id").agg(F.collect_set("part").alias("p")).collect()}
    assert all(len(p) == 1 for p in got.values())
    sizes = {k: sum(p == [k] for p in got.values()) for k in ("train", "validation", "test")}
    assert sizes["test"] == 12 and 9 <= sizes["validation"] <= 10 and sum(sizes.values()) == 60


def test_hidden_units_beat_the_ridge_on_held_out_trips(parts):
    looks = dict(window=2, features=("a", "b"), ridge=1e-3)
    errors = {}
    for hidden in (0, 64):
        shape = Shape(hidden=hidden, **looks)
        made = arrival.sequences(parts.filter("part <> 'test'"), shape)
        errors[hidden] = arrival.test_errors(arrival.train(made, shape), parts).first()
    assert errors[64]["rmse"] < 0.6 * errors[0]["rmse"] and errors[0]["n"] == errors[64]["n"] == 12 * 28
    assert errors[64]["hidden"] == 64 and errors[64]["features"] == "a,b"


def test_without_hidden_units_it_is_the_ridge(spark, parts):
    shape = Shape(1, ("a",), 0, 0.0)
    made = arrival.sequences(parts, shape).cache()
    model = arrival.train(made, shape)
    got = {r["polyline_idx"]: r["coefficients"] for r in model.coefficients.collect()}
    x = {line: np.array([(r["sequence"][0], r["target"]) for r in made.filter(F.col("polyline_idx") == line).collect()]) for line in (0, 1)}
    for line, v in x.items():
        slope, level = np.polyfit((v[:, 0] - model.mean[0]) / model.std[0], v[:, 1], 1)
        assert got[line] == pytest.approx([level, slope], rel=1e-6)


def test_the_search_draws_chooses_on_validation_and_never_sees_the_test(spark, parts):
    shapes = arrival.draw(4, 3, windows=(1, 2), features=("a", "b"), hidden=(0, 32))
    assert shapes == arrival.draw(4, 3, windows=(1, 2), features=("a", "b"), hidden=(0, 32)) != arrival.draw(4, 4, windows=(1, 2), features=("a", "b"), hidden=(0, 32))
    poisoned = parts.withColumn("eta_seconds", F.when(F.col("part") == "test", F.lit(1e9)).otherwise(F.col("eta_seconds")))
    model, trials = arrival.search(parts, shapes)
    again, same = arrival.search(poisoned, shapes)
    rows = [tuple(r) for r in trials.orderBy("trial").collect()]
    assert rows == [tuple(r) for r in same.orderBy("trial").collect()] and model.shape == again.shape
    assert model.shape == shapes[min(rows, key=lambda r: (r[5], r[0]))[0]] and len(rows) == 4
