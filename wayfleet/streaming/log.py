"""A table of versioned rows as a log of time buckets.

Every batch adds a folder to each bucket of event time that it touches: ``bucket=…/batch=…``. The version
of a row with the highest batch number counts. Reads name a span of time and touch its buckets only, so
what a tick reads does not grow with history. Compaction puts a bucket's batches into one, retention drops
old buckets. A batch that is written again replaces its own folders; a compaction that is cut short
leaves versions that count as before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfleet.operators.scale import cut
from wayfleet.operators.upkeep import keep_last

BUCKET_SECONDS = 3600


@dataclass(frozen=True)
class BucketLog:
    """``path`` holds the rows; ``key`` tells rows apart; ``time`` (microseconds) places them and belongs to the key."""

    path: str
    key: Sequence[str] = ("vehicle_id", "t_us")
    time: str = "t_us"
    seconds: int = BUCKET_SECONDS

    def bucket(self, us: int) -> int:
        return us // (self.seconds * 1_000_000)

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Add a batch. Repeated, it replaces the folders it writes and empties those it no longer needs."""
        spark = rows.sparkSession
        placed = rows.withColumns({"bucket": F.floor(F.col(self.time) / F.lit(self.seconds * 1_000_000)).cast("long"), "batch": F.lit(batch_id)})
        for bucket in [b for b, batches in self.folders(spark).items() if batch_id in batches]:
            self._delete(spark, f"bucket={bucket}/batch={batch_id}")
        # One task per bucket would gather a bucket's rows; left as they are, each task writes what it holds.
        placed.write.partitionBy("bucket", "batch").mode("append").parquet(self.path)

    def stored(self, spark: SparkSession, since: int | None = None, until: int | None = None) -> DataFrame | None:
        """All versions of rows from ``since`` to ``until`` (microseconds, inclusive), with ``bucket`` and ``batch``; None before the first batch."""
        try:
            rows = spark.read.parquet(self.path)
        except AnalysisException:
            return None
        if since is not None:
            rows = rows.filter((F.col("bucket") >= self.bucket(since)) & (F.col(self.time) >= since))
        if until is not None:
            rows = rows.filter((F.col("bucket") <= self.bucket(until)) & (F.col(self.time) <= until))
        return rows

    def newest(self, spark: SparkSession, since: int | None = None, until: int | None = None) -> DataFrame | None:
        """The version of each row that counts. A key lies in one bucket, so the span may be cut first."""
        rows = self.stored(spark, since, until)
        return None if rows is None else keep_last(rows, ["batch"], list(self.key)).drop("bucket", "batch")

    def folders(self, spark: SparkSession) -> dict[int, list[int]]:
        """Batches by bucket, as the folders say."""
        files, root = self._files(spark, "")
        if not files.exists(root):
            return {}
        names = lambda path, kind: [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith(kind)]
        number = lambda path: int(path.getName().split("=")[1])
        return {number(b): sorted(number(p) for p in names(b, "batch=")) for b in names(root, "bucket=")}

    def compact(self, spark: SparkSession, until: int) -> list[int]:
        """Put the batches of each bucket that ends by ``until`` into one; returns the buckets.

        The compacted rows take the place of the bucket's last batch before the others go, so at every
        moment the folders that are there give the same newest rows.
        """
        done = [b for b, batches in sorted(self.folders(spark).items()) if len(batches) > 1 and (b + 1) * self.seconds * 1_000_000 <= until]
        if not done:
            return []
        folders = self.folders(spark)
        rows = spark.read.parquet(self.path).filter(F.col("bucket").isin(done))
        kept = cut(keep_last(rows, ["batch"], list(self.key)), "compacted")
        last = F.create_map(*[F.lit(x) for b in done for x in (b, folders[b][-1])])[F.col("bucket")]
        moved = kept.withColumn("batch", last).repartition("bucket", F.pmod(F.xxhash64(*self.key), F.lit(8)))
        moved.write.partitionBy("bucket", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        for b in done:
            for batch in folders[b][:-1]:
                self._delete(spark, f"bucket={b}/batch={batch}")
        return done

    def expire(self, spark: SparkSession, before: int) -> list[int]:
        """Drop the buckets that end by ``before``; returns them."""
        old = [b for b in sorted(self.folders(spark)) if (b + 1) * self.seconds * 1_000_000 <= before]
        for b in old:
            self._delete(spark, f"bucket={b}")
        return old

    def _files(self, spark: SparkSession, name: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _delete(self, spark: SparkSession, name: str) -> None:
        files, path = self._files(spark, name)
        files.delete(path, True)
