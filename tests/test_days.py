import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wayfleet.operators import upkeep
from wayfleet.sources.days import DayTable

AT = "2024-01-05 12:00:00"


def events(spark, ids):
    return (spark.createDataFrame([(str(i), i) for i in ids], "id string, hours int")
            .select("id", F.timestamp_seconds(F.lit(1704067200) + F.col("hours") * 3600).alias("event_time")))


@pytest.fixture
def table(spark, tmp_path):
    made = DayTable(str(tmp_path / "events"), "event_time", "id", bits=1 << 14)
    assert made.rows(spark) is None and made.window(spark, F.lit(AT).cast("timestamp")) is None and made.may_hold(events(spark, [1])) == []
    made.write(events(spark, range(0, 200)))
    made.write(events(spark, range(200, 240)))
    return made


def ids(df):
    return sorted(int(r["id"]) for r in df.collect())


def files(df):
    return {re.search(r"service_day=([^/]+)", r[0]).group(1) for r in df.select(F.input_file_name()).distinct().collect()}


def test_days_begin_at_local_midnight(spark, table):
    got = {str(r["d"]) for r in spark.createDataFrame([(datetime(2024, 1, 5, 4, 59),), (datetime(2024, 1, 5, 5, 0),), (None,)], "t timestamp")
           .select(table.day_of(F.col("t")).alias("d")).collect()}
    assert got == {"2024-01-04", "2024-01-05", "None"}
    late = DayTable("x", "t", start_seconds=3 * 3600)
    assert str(spark.range(1).select(late.day_of(F.lit("2024-01-05 07:59:59").cast("timestamp"))).first()[0]) == "2024-01-04"


def test_a_window_reads_only_its_days(spark, table):
    since = F.lit(AT).cast("timestamp")
    got = table.window(spark, since)
    assert ids(got) == list(range(108, 240)) and ids(table.window(spark, since, inclusive=False)) == list(range(109, 240))
    assert re.search(r"PartitionFilters: \[[^\]]*service_day", got._jdf.queryExecution().executedPlan().toString())
    until = F.lit("2024-01-06 06:00:00").cast("timestamp")
    assert ids(table.window(spark, since, until)) == list(range(108, 126))
    assert files(table.rows(spark).filter((F.col("service_day") >= table.day_of(since)) & (F.col("service_day") <= table.day_of(until)))) == {"2024-01-05", "2024-01-06"}


def test_a_purge_touches_only_its_days(spark, table, tmp_path):
    before = {r[0] for r in table.rows(spark).filter("service_day < '2024-01-05'").select(F.input_file_name()).distinct().collect()}
    keep = events(spark, [239])
    assert table.purge_since(spark, F.lit(AT).cast("timestamp"), keep) == [f"2024-01-{d:02d}" for d in range(5, 11)]
    assert ids(table.rows(spark)) == [*range(108), 239]
    assert before == {r[0] for r in table.rows(spark).filter("service_day < '2024-01-05'").select(F.input_file_name()).distinct().collect()}
    assert files(table.rows(spark)) == {"2023-12-31", *(f"2024-01-{d:02d}" for d in range(1, 6)), "2024-01-10"}


def test_unknown_ids_are_found_from_few_days(spark, table):
    batch = events(spark, [50, 51, 1000, 1001])
    assert "2024-01-02" in table.may_hold(batch) and len(table.may_hold(batch)) <= 3
    assert ids(table.unknown(batch)) == [1000, 1001]
    assert ids(upkeep.append_unknown(table, batch.union(batch))) == [1000, 1001] and ids(upkeep.append_unknown(table, batch)) == []
    assert ids(table.rows(spark)) == [*range(240), 1000, 1001]


def test_false_positives_cost_reads_but_no_rows(spark, tmp_path):
    full = DayTable(str(tmp_path / "full"), "event_time", "id", bits=64)      # filters of full days know everything
    full.write(events(spark, range(0, 240)))
    batch = events(spark, range(200, 400))
    assert len(full.may_hold(batch)) >= 10 and ids(full.unknown(batch)) == list(range(240, 400))


def test_an_event_moved_to_another_day_is_still_known(spark, table):
    moved = events(spark, [7]).withColumn("event_time", F.lit("2024-03-01 00:00:00").cast("timestamp"))
    assert ids(table.unknown(moved)) == []


def test_what_is_appended_is_stored_apart_once(spark, tmp_path):
    made = DayTable(str(tmp_path / "appended"), "event_time", "id", bits=1 << 14)
    assert ids(upkeep.append_unknown(made, events(spark, [1, 2, 2, 30]))) == [1, 2, 30]
    assert ids(made.write(events(spark, [31]))) == [31] and ids(made.rows(spark)) == [1, 2, 30, 31]
