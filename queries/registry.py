"""Where the registered queries and their SQL are kept, and the stages they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries import fixture as fx
from wayfleet.operators.scale import cut, hot_groups
from wayfleet.plans import enrich

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The fixture spans twelve minutes; four-minute slices make every operator cross slice borders.
SLICE = 240

_stages: dict[tuple, DataFrame] = {}


def query(name: str, sql: str | None = None, nullable: str = ""):
    """Register a query with its SQL. Whole-number columns listed in ``nullable`` leave both engines as
    doubles, because data frames of the two hold missing integers differently."""
    wide = nullable.split()

    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in wide}) if wide else fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in wide)
            ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({sql}) q" if wide else sql
        return fn
    return keep


def stage(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stage of the enrichment, computed once per session and input folder and stored in between.

    l2 uses the trip defaults; l2s, l3 and l4 the stop defaults; live keeps one-row trips. l4 goes on from l3 where
    that is stored already, and is made in one job otherwise.
    """
    stop_options = {"max_gap": 30.0, "max_dist": 0.005, "slice_seconds": SLICE}

    def found(matched, net, stops_gap, **options):
        return enrich.segment_and_stops(matched, net, hot_groups(matched, ["vehicle_id"]), stops_gap, **options)

    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stages:
        net = fx.network(spark, sf_dir)
        get = lambda n: stage(spark, sf_dir, n)
        make = {
            "pings": lambda: fx.pings(spark, sf_dir),
            "l1": lambda: enrich.preprocess(get("pings"), net),
            "l2": lambda: enrich.segment(get("l1"), net, slice_seconds=SLICE),
            "l2s": lambda: enrich.segment(get("l1"), net, 30.0, 0.005, slice_seconds=SLICE),
            "l3": lambda: found(get("l1"), net, 30.0, **stop_options),
            "l4": lambda: (enrich.add_eta(get("l3"), SLICE) if (*key[:2], "l3") in _stages else
                           enrich.with_eta(get("l1"), net, hot_groups(get("l1"), ["vehicle_id"]), **stop_options)),
            "live": lambda: found(get("l1"), net, 15.0, min_len=1, slice_seconds=SLICE),
        }[name]
        _stages[key] = cut(make(), name)
    return _stages[key]
