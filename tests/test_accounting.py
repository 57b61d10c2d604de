import random

from pyspark.sql import functions as F

from wayfleet.operators import profile, stops
from wayfleet.operators.accounting import StageCounts, observed, reported, trim_and_count
from wayfleet.streaming import jobs

SCHEMA = "vehicle_id string, segment_no long, t_us long, ping_id long, stop_name string"


def test_counts_are_those_of_two_scans(spark):
    rng = random.Random(2)
    rows = [(f"v{v}", s, int((s * 1000 + i * 7) * 1e6), i, rng.choice(["S", None, None, None])) for v in range(6) for s in range(1, 5) for i in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, SCHEMA)
    counts = StageCounts()
    got = trim_and_count(df, counts, slice_seconds=20)
    kept = sorted(map(tuple, got.collect()))
    plain = stops.trim_after_last_stop(df, slice_seconds=20)
    assert kept == sorted(map(tuple, plain.select(*got.columns).collect())) and len(kept) < len(rows)
    assert counts.between(spark, "stops", "trimmed").first().asDict() == profile.stage_accounting(df, plain).first().asDict()


def test_nothing_kept_and_nothing_there(spark):
    counts = StageCounts()
    df = spark.createDataFrame([("a", 1, 5, 1, None)], SCHEMA)
    assert trim_and_count(df, counts).collect() == [] and counts.of("trimmed") == {"rows": 0, "trips": 0} and counts.of("stops") == {"rows": 1, "trips": 1}
    empty = StageCounts()
    trim_and_count(df.limit(0), empty).collect()
    assert empty.between(spark, "stops", "trimmed").first()["rows_kept_percent"] is None
    rows_only = StageCounts()
    rows_only.watch(df, "rows").collect()
    assert rows_only.of("rows") == {"rows": 1, "trips": 0}


def test_a_stream_reports_per_batch(spark, tmp_path):
    for part in range(2):
        spark.range(10 * part + 10).write.mode("append").parquet(str(tmp_path / "in"))
        stream = observed(jobs.read_stream(spark, str(tmp_path / "in"), "id long"), "ids", n=F.count(F.lit(1)), top=F.max("id"))
        query = jobs.to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"), None)
        query.awaitTermination()
        assert reported(query, "ids") == [{"batch": part, "n": 10 * part + 10, "top": 10 * part + 9}]
