import os

import pytest
from pyspark.sql import functions as F

from queries import fixture as fx
from wayfleet.operators import scale, upkeep
from wayfleet.operators.scale import cut
from wayfleet.plans import enrich
from wayfleet.streaming import jobs

SF = "/root/testdata/sf0.001"
COLUMNS = ["vehicle_id", "ping_id", "segment_no", "route", "polyline_idx", "segment_idx", "stop_name"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS, F.round("speed_kmh", 6)).collect()), key=lambda r: r[1])


@pytest.fixture(scope="module")
def pings(spark):
    return cut(fx.pings(spark, SF))


@pytest.fixture(scope="module")
def whole(spark, pings):
    return rows(enrich.live_job(pings, fx.network(spark, SF)))


# Scrambled batches need all rows at hand; batches in time order only the last half minute.
@pytest.mark.parametrize("batch_of, late_after", [("ping_id * 7919 % 3", 10_000.0), ("(t_us - 1704067200000000) DIV 240000000", 30.0)])
def test_micro_batches_end_at_the_batch_result(spark, pings, whole, batch_of, late_after):
    net, tail, out = fx.network(spark, SF), None, None
    for no in range(3):
        batch = pings.filter(F.expr(batch_of) == no).select("vehicle_id", "ping_id", "t_us", "latitude", "longitude")
        done, tail, late = jobs.enrich_batch(tail, batch, net, late_after=late_after)
        tail = cut(tail)
        assert late.count() == 0
        done = cut(done.withColumn("batch", F.lit(no)))
        out = done if out is None else out.unionByName(done)
    assert rows(upkeep.keep_last(out, ["batch"], ["vehicle_id", "t_us"])) == whole
    if late_after < 100:
        assert tail.filter("anchor").count() > 0 and tail.count() < pings.count()


def test_late_rows_come_back(spark, pings):
    net = fx.network(spark, SF)
    newest = pings.filter("t_us >= 1704067200000000 + 400000000")
    _, tail, _ = jobs.enrich_batch(None, newest, net, late_after=60.0)
    done, _, late = jobs.enrich_batch(cut(tail), pings.filter("t_us < 1704067200000000 + 100000000"), net, late_after=60.0)
    assert late.count() > 0 and done.count() + late.count() >= pings.filter("t_us < 1704067200000000 + 100000000").count()


def test_a_stream_can_be_paced_or_drained(spark, tmp_path):
    spark.range(10).withColumn("timestamp", F.timestamp_seconds("id")).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), "id long, timestamp timestamp")
    query = jobs.to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "1 second")
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_a_first_batch_delivered_twice_counts_once(spark, pings, whole):
    narrow = pings.select("vehicle_id", "ping_id", "t_us", "latitude", "longitude")
    done, tail, _ = jobs.enrich_batch(None, narrow.union(narrow), fx.network(spark, SF), late_after=10_000.0)
    assert rows(done) == whole
    assert tail.count() == tail.select("vehicle_id", "t_us").distinct().count()


def ticks(pings, net):
    tail, out = None, []
    for no in range(2):
        batch = pings.filter(F.expr("(t_us - 1704067200000000) DIV 360000000") == no).select("vehicle_id", "ping_id", "t_us", "latitude", "longitude")
        done, tail, _ = jobs.enrich_batch(tail, batch, net, late_after=30.0)
        tail, done = cut(tail), cut(done)
        out.append((rows(done), sorted(map(tuple, tail.select("ping_id", "segment_no", "anchor", "route", "polyline_idx", F.round("dist_to_route", 9)).collect()), key=str)))
    return out


def test_a_batch_is_cut_into_trips_once_and_hot_vehicles_give_the_same(spark, pings, monkeypatch):
    net, stored = fx.network(spark, SF), {}

    def kept(df, name="cut", folder=None):
        stored[name] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df, name, folder)

    monkeypatch.setattr(jobs, "cut", kept)
    whole = ticks(pings, net)
    assert stored["done"].count("Exchange hashpartitioning(vehicle_id") <= 2    # of the rows, and of the vehicles they belong to
    monkeypatch.setattr(scale, "HOT_ROWS", 20)
    assert ticks(pings, net) == whole
