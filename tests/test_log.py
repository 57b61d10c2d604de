import re

import pytest
from pyspark.sql import functions as F

from wayfleet.streaming import jobs
from wayfleet.streaming.log import BucketLog

MINUTE = 60_000_000


def versions(spark, batch, minutes):
    return spark.createDataFrame([(f"v{v}", m * MINUTE + v, f"{batch}:{v}:{m}") for v in range(4) for m in minutes], "vehicle_id string, t_us long, said string")


@pytest.fixture
def log(spark, tmp_path):
    made = BucketLog(str(tmp_path / "log"), seconds=120)
    assert made.newest(spark) is None and made.folders(spark) == {} and made.compact(spark, 10**12) == []
    for batch, minutes in enumerate([range(0, 10), range(5, 12), (3, 11)]):
        made.append(versions(spark, batch, minutes), batch)
    return made


def said(df):
    return sorted(r["said"] for r in df.collect())


WANT = sorted(f"{2 if m in (3, 11) else 1 if m >= 5 else 0}:{v}:{m}" for v in range(4) for m in range(12))


def test_the_last_version_counts_through_compaction_and_repeats(spark, log):
    assert said(log.newest(spark)) == WANT
    log.append(versions(spark, 1, range(5, 12)), 1)                       # the batch runs again
    assert said(log.newest(spark)) == WANT
    assert log.compact(spark, 9 * MINUTE) == [1, 2, 3]                    # bucket 0 has one batch, bucket 4 is not over yet
    assert log.folders(spark) == {0: [0], 1: [2], 2: [1], 3: [1], 4: [0, 1], 5: [1, 2]}
    assert said(log.newest(spark)) == WANT and log.stored(spark).filter("bucket BETWEEN 1 AND 3").count() == 24
    log.append(versions(spark, 3, (6,)), 3)                               # a correction after compaction
    assert said(log.newest(spark, 6 * MINUTE, 7 * MINUTE - 1)) == [f"3:{v}:6" for v in range(4)]


def test_a_repeated_batch_with_fewer_buckets_leaves_nothing_behind(spark, log):
    log.append(versions(spark, 2, (3,)), 2)
    assert log.folders(spark)[5] == [1] and said(log.newest(spark, 11 * MINUTE)) == [f"1:{v}:11" for v in range(4)]


def test_a_compaction_that_is_cut_short_changes_nothing(spark, log, monkeypatch):
    def fail(self, spark, name):
        raise OSError("lost")
    monkeypatch.setattr(BucketLog, "_delete", fail)
    with pytest.raises(OSError):
        log.compact(spark, 9 * MINUTE)
    assert said(log.newest(spark)) == WANT
    monkeypatch.undo()
    log.compact(spark, 9 * MINUTE)
    assert said(log.newest(spark)) == WANT


def test_retention_drops_whole_buckets(spark, log):
    assert log.expire(spark, 5 * MINUTE) == [0, 1]
    assert said(log.newest(spark)) == [s for s in WANT if int(s.split(":")[2]) >= 4]


def test_a_span_reads_only_its_buckets(spark, log):
    rows = log.newest(spark, 4 * MINUTE, 6 * MINUTE - 1)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    files = {re.search(r"bucket=(\d+)", r[0]).group(1) for r in log.stored(spark, 4 * MINUTE, 6 * MINUTE - 1).select(F.input_file_name()).distinct().collect()}
    assert files == {"2"} and said(rows) == [s for s in WANT if s.split(":")[2] in "45"]


def test_a_tick_reads_the_day_of_its_vehicles(spark, log):
    changed = spark.createDataFrame([("v1", 9 * MINUTE + 1)], "vehicle_id string, t_us long")
    day = jobs.last_day(log, changed, 240.0)
    assert said(day) == [f"1:1:{m}" for m in range(6, 10)]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", day._jdf.queryExecution().optimizedPlan().toString() + day._jdf.queryExecution().executedPlan().toString())
