"""Tables laid out by service day, with Bloom filters of their ids.

A window scan reads the days it needs, a purge rewrites the day it cuts into and drops those after it, and
appending only what is new reads the days that may hold one of the batch's ids. A day's Bloom filter is
built and merged by Spark, a row per word of 64 bits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfleet.functions.clock import CAMPUS_TZ, DAY_START_SECONDS
from wayfleet.operators.scale import cut, lookup_join

BLOOM_BITS = 1 << 23      # per day: 1 % of unknown ids pass at 870,000 ids a day
BLOOM_HASHES = 4


@dataclass(frozen=True)
class DayTable:
    """Rows with a timestamp ``time`` under ``path``, one folder per service day; ``id`` names the column of the filters."""

    path: str
    time: str
    id: str | None = None
    tz: str = CAMPUS_TZ
    start_seconds: int = DAY_START_SECONDS
    bits: int = BLOOM_BITS

    @property
    def bloom_path(self) -> str:
        return f"{self.path}.bloom"

    def day_of(self, at: Column) -> Column:
        """The service day that ``at`` belongs to; null for a null."""
        return F.to_date(F.from_utc_timestamp(at, self.tz) - F.expr(f"INTERVAL {int(self.start_seconds)} SECOND"))

    def rows(self, spark: SparkSession) -> DataFrame | None:
        """All rows with their ``service_day``; None before anything is stored."""
        try:
            return spark.read.parquet(self.path)
        except AnalysisException:
            return None

    def write(self, rows: DataFrame) -> DataFrame:
        """Append rows to their days, and their ids to the days' filters; returns what was written, stored apart."""
        placed = cut(rows.withColumn("service_day", self.day_of(F.col(self.time))), "placed")
        if self.id:
            self._remember(placed)   # before the rows: a filter that knows too much costs a read, one that knows too little a copy
        placed.write.partitionBy("service_day").mode("append").parquet(self.path)
        return placed.drop("service_day")

    def window(self, spark: SparkSession, since: Column, until: Column | None = None, inclusive: bool = True) -> DataFrame | None:
        """Rows from ``since`` on, constants both, up to ``until`` (exclusive); only the days in between are read."""
        rows = self.rows(spark)
        if rows is None:
            return None
        at = F.col(self.time)
        rows = rows.filter((F.col("service_day") >= self.day_of(since)) & ((at >= since) if inclusive else (at > since)))
        if until is not None:
            rows = rows.filter((F.col("service_day") <= self.day_of(until)) & (at < until))
        return rows.drop("service_day")

    def purge_since(self, spark: SparkSession, since: Column, keep: DataFrame | None = None) -> list[str]:
        """Delete everything from ``since`` on but ``keep``; returns the days that were touched, others are left alone.

        Filters may go on knowing ids that are gone.
        """
        rows = self.rows(spark)
        if rows is None:
            return []
        touched = rows.filter(F.col("service_day") >= self.day_of(since))
        days = sorted(str(r["service_day"]) for r in touched.select("service_day").distinct().collect())
        stay = touched.filter(F.col(self.time) < since)
        if keep is not None:
            stay = stay.unionByName(keep.withColumn("service_day", self.day_of(F.col(self.time))))
        stay = cut(stay, "stay")
        left = {str(r["service_day"]) for r in stay.select("service_day").distinct().collect()}
        stay.write.partitionBy("service_day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        for day in set(days) - left:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/service_day={day}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        return days

    # -- filters ------------------------------------------------------------------------------------

    def _places(self, value: Column) -> Column:
        """The bits of an id, as (word, bit)."""
        bit = lambda i: F.pmod(F.xxhash64(F.lit(i), value), F.lit(self.bits))
        return F.array(*[F.struct(F.floor(bit(i) / 64).cast("int").alias("word"), F.expr("1L").alias("one"), (bit(i) % 64).cast("int").alias("bit"))
                         for i in range(BLOOM_HASHES)])

    def _words(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        bits = rows.select(*keys, F.inline(self._places(F.col(self.id).cast("string"))))
        return bits.groupBy(*keys, "word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits"))

    def _blooms(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.parquet(self.bloom_path)
        except AnalysisException:
            return None

    def _remember(self, placed: DataFrame) -> None:
        """Merge ids into the filters of their days; other days' filters are not read."""
        spark, new = placed.sparkSession, self._words(placed.filter(F.col(self.id).isNotNull()), ["service_day"])
        stored = self._blooms(spark)
        if stored is not None:
            days = placed.select("service_day").distinct()
            new = new.unionByName(stored.join(F.broadcast(days), "service_day", "left_semi").select("service_day", "word", "bits"))
        merged = cut(new.groupBy("service_day", "word").agg(F.bit_or("bits").alias("bits")), "bloom")
        merged.write.partitionBy("service_day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.bloom_path)

    def may_hold(self, batch: DataFrame) -> list[str]:
        """The days whose filter knows all bits of some id of ``batch``: all days that hold one, and now and then another."""
        stored = self._blooms(batch.sparkSession)
        if stored is None:
            return []
        wanted = batch.filter(F.col(self.id).isNotNull()).select(F.col(self.id).cast("string").alias("_id")).distinct()
        bits = wanted.select("_id", F.inline(self._places(F.col("_id")))).withColumn("mask", F.expr("shiftleft(one, bit)")).select("_id", "word", "mask").distinct()
        needs = bits.groupBy("_id").agg(F.count("*").alias("needs"))
        known = lookup_join(stored, bits.groupBy("word").agg(F.collect_set(F.struct("_id", "mask")).alias("asked")), ["word"], "inner")
        hits = known.select("service_day", F.col("bits"), F.inline("asked")).filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        found = hits.groupBy("service_day", "_id").agg(F.count("*").alias("hits")).join(needs, "_id").filter("hits = needs")
        return sorted(str(r["service_day"]) for r in found.select("service_day").distinct().collect())

    def unknown(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` whose id is not stored: an exact anti-join with the days that may hold one of them."""
        stored = self.rows(batch.sparkSession)
        days = self.may_hold(batch) if stored is not None else []
        if not days:
            return batch
        return batch.join(stored.filter(F.col("service_day").isin([date.fromisoformat(d) for d in days])).select(self.id), self.id, "left_anti")
