import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfleet.operators import scale, schedule, upkeep


def test_prefix_sums_over_slices(spark):
    rows = [("a" if i % 3 else "b", i // 7, i, i * 2) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, s long, o long, v long")
    got = {r.o: r.run for r in scale.prefix_sums(df, ["k"], "s", ["o"], {"run": F.col("v")}).collect()}
    for k, _, o, _ in rows:
        assert got[o] == sum(v for kk, _, oo, v in rows if kk == k and oo <= o)


@pytest.mark.parametrize("group", [[], ["k"]])
def test_exact_quantiles(spark, group):
    rnd = random.Random(2)
    rows = [("a" if i % 4 else "b", rnd.choice([None, 1.0, 2.5, rnd.random() * 30])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    for r in scale.exact_quantiles(df, group, "v", probs).collect():
        mine = [v for k, v in rows if v is not None and (not group or k == r.k)]
        for n, p in probs.items():
            assert r[n] == pytest.approx(np.quantile(mine, p), abs=1e-12)


def test_quantiles_of_values_within_one_unit(spark):
    rnd = random.Random(3)
    values = [rnd.random() / 1000 for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = scale.exact_quantiles(df, [], "v", {"q10": 0.1, "q99": 0.99}).first()
    assert (got["q10"], got["q99"]) == pytest.approx(tuple(np.quantile(values, [0.1, 0.99])), abs=1e-15)


@pytest.mark.parametrize("small", [True, False])
def test_lookup_join_keeps_rows_without_a_key(spark, small):
    left = spark.createDataFrame([(i, i % 3 if i % 5 else None) for i in range(300)], "id long, k int")
    dim = spark.createDataFrame([(0, "x"), (1, "y")], "k int, name string")
    got = scale.lookup_join(left, dim, ["k"], small=small)
    want = {i: {0: "x", 1: "y"}.get(i % 3) if i % 5 else None for i in range(300)}
    assert {r.id: r.name for r in got.collect()} == want
    assert ("BroadcastExchange" in got._jdf.queryExecution().executedPlan().toString()) == small or not small


def test_cut_writes_to_the_shared_folder(spark):
    made = scale.cut(spark.range(5))
    assert made.count() == 5 and scale.shared_dir(spark) in made.inputFiles()[0].replace("file://", "")


@pytest.mark.parametrize("seed", range(4))
def test_bus_assignment_is_cheapest(spark, seed):
    from itertools import permutations
    rnd = random.Random(seed)
    rows = []
    for day in ("2024-01-01", "2024-01-02"):
        for b in range(4):
            for v in rnd.sample(range(9), 5):
                rows.append((day, f"v{v}", f"b{b}", rnd.randrange(1, 10) / 10))
    df = spark.createDataFrame(rows, "service_day string, vehicle_id string, bus string, cost double").withColumn("service_day", F.to_date("service_day"))
    got = schedule.assign_buses(df).collect()
    for day in ("2024-01-01", "2024-01-02"):
        mine = [r for r in got if str(r.service_day) == day]
        cost = {(v, b): c for d, v, b, c in rows if d == day}
        best = min(sum(cost.get((f"v{v}", f"b{b}"), 1.0) for b, v in enumerate(p)) for p in permutations(range(9), 4))
        assert sum(r.cost for r in mine) + (4 - len(mine)) == pytest.approx(best)
        assert len({r.vehicle_id for r in mine}) == len(mine) == len({r.bus for r in mine})
        assert all(cost[(r.vehicle_id, r.bus)] == r.cost for r in mine)


def test_assignment_history_across_slices(spark):
    rnd = random.Random(8)
    rows = [("hot" if i % 3 else f"v{i}", str(rnd.randrange(2)), i * 400, i) for i in range(200)]
    df = spark.createDataFrame(rows, "vehicle_id string, driver_id string, s long, assignment_id long").withColumn("assigned_at", F.timestamp_seconds("s"))
    got = sorted((r.vehicle_id, r.s, r.e, r.driver_id) for r in upkeep.assignment_intervals(df, 3600).select(
        "vehicle_id", "driver_id", F.unix_seconds("assignment_start").alias("s"), F.coalesce(F.unix_seconds("assignment_end"), F.lit(-1)).alias("e")).collect())
    want = []
    for v in {r[0] for r in rows}:
        last = None
        for _, d, s, _ in [r for r in rows if r[0] == v]:
            if last is None or last[3] != d:
                if last:
                    want.append((v, last[1], s, last[3]))
                last = (v, s, -1, d)
        want.append(last)
    assert got == sorted(want)


def test_current_loops_are_looked_up_as_the_lists_are_read(spark):
    rnd = random.Random(6)
    lists = {"a": sorted(rnd.sample(range(1, 1440), 40)) + [0], "b": [1439], "c": [0], "d": [600, 300, 900]}
    aggregated = spark.createDataFrame([(1, r, [(i, "", m, 1) for i, m in enumerate(ms)]) for r, ms in lists.items()],
                                       "dow int, route string, times array<struct<order int, time string, minute int, n long>>")
    nows = spark.createDataFrame([(r, 1704672000 + 60 * m) for r in [*lists, "x"] for m in range(0, 1440, 7)], "route string, s long")   # a Monday
    got = schedule.current_loop(nows.withColumn("now", F.timestamp_seconds("s")), aggregated, tz="UTC")
    for r in got.collect():
        ms, m = lists.get(r.route), (r.s - 1704672000) // 60
        at = None if ms is None else next((i for i, x in enumerate(ms) if x > m), len(ms)) - 1
        assert (r.loop_idx, r.departure_minute) == (at, None if at is None or at < 0 else ms[at])
    assert "transform(sequence" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_scheduled_times_over_a_clock_change(spark):
    loops = spark.createDataFrame([(1, "a", 1710053940, 60)], "id long, route string, s long, departure_minute int").withColumn("now", F.timestamp_seconds("s"))
    stops = spark.createDataFrame([("a", i, f"S{i}", i * 45) for i in range(4)], "route string, stop_ord int, stop_name string, offset_min int")
    got = schedule.scheduled_stop_times(loops, stops).orderBy("stop_ord")
    # 10 March 2024 in New York: 1:00 and 1:45 in winter time, then 2:30, which there is not, and 3:15 in summer time.
    assert [r.u for r in got.select(F.unix_seconds("stop_time").alias("u")).collect()] == [1710050400, 1710053100, 1710055800, 1710054900]
