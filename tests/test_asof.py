import random

import pytest
from pyspark.sql import functions as F

from wayfleet.operators.asof import asof_join


def made(seed=4):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", None])
    left = [(key(), rng.choice([None, *range(0, 4000, 10)]), i) for i in range(400)]
    right = [(rng.choice(["hot", "hot", "a", "c", None]), rng.choice([None, *range(0, 4000, 50)]), i, rng.choice([None, f"d{i}"])) for i in range(120)]
    return left, right


@pytest.mark.parametrize("strict, tolerance, width", [(False, None, 7), (True, None, 100), (False, 30, 7), (True, 55, 10_000)])
def test_asof_equals_a_search(spark, strict, tolerance, width):
    left, right = made()
    us = lambda s: None if s is None else s * 1_000_000
    ldf = spark.createDataFrame([(k, us(t), i) for k, t, i in left], "vehicle_id string, t_us long, ping long")
    rdf = spark.createDataFrame([(k, us(t), n, d) for k, t, n, d in right], "vehicle_id string, t_us long, n long, driver string")
    got = asof_join(ldf, rdf, ["vehicle_id"], ["driver"], tie=["n"], tolerance_seconds=tolerance, strict=strict, slice_seconds=width)
    want = {}
    for k, t, i in left:
        fits = [(rt, n, d) for rk, rt, n, d in right if k is not None and rk == k and None not in (t, rt) and (rt < t if strict else rt <= t)]
        best = max(fits, key=lambda r: r[:2], default=None)
        if best and tolerance is not None and t - best[0] > tolerance:
            best = None
        want[i] = (k, us(t), us(best[0]) if best else None, best[2] if best else None)
    assert {r["ping"]: (r["vehicle_id"], r["t_us"], r["asof_us"], r["driver"]) for r in got.collect()} == want and got.count() == 400


def test_asof_of_empty_sides(spark):
    ldf = spark.createDataFrame([("a", 1, 2)], "vehicle_id string, t_us long, ping long")
    rdf = spark.createDataFrame([], "vehicle_id string, t_us long, driver string")
    assert [tuple(r) for r in asof_join(ldf, rdf, ["vehicle_id"], ["driver"]).collect()] == [("a", 1, 2, None, None)]
    assert asof_join(ldf.limit(0), rdf, ["vehicle_id"], ["driver"]).collect() == []


def test_a_hot_key_spreads_over_its_slices(spark):
    ldf = spark.range(2000).select(F.lit("hot").alias("vehicle_id"), (F.col("id") * 1_000_000).alias("t_us"))
    rdf = ldf.filter("t_us % 97000000 = 0").withColumn("driver", F.col("t_us"))
    got = asof_join(ldf, rdf, ["vehicle_id"], ["driver"], slice_seconds=50)
    assert got.filter("driver <> t_us DIV 97000000 * 97000000").count() == 0
    assert "vehicle_id" in got._jdf.queryExecution().optimizedPlan().toString() and "_slice" in got._jdf.queryExecution().executedPlan().toString()
