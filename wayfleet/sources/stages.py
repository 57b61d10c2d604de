"""Stored stages: naming, writing, reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfleet.operators.scale import require


def stage_path(root: str, base: str, **params) -> str:
    """``root/base_param1value_param2value``: parameters sorted, floats short, ``.`` as ``p``, no ``_``."""
    text = lambda v: (f"{v:g}" if isinstance(v, float) else str(v)).replace("_", "").replace(".", "p")
    return "/".join([root.rstrip("/"), "_".join([base, *(f"{k}{text(v)}" for k, v in sorted(params.items()))])])


def write_stage(df: DataFrame, root: str, base: str, **params) -> str:
    path = stage_path(root, base, **params)
    df.write.mode("overwrite").parquet(path)
    return path


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_stage_csv(spark: SparkSession, path: str, schema: str, timestamp: str = "timestamp") -> DataFrame:
    """A stage handed over as CSV: typed by ``schema``, its timestamp text in any ISO form, read as UTC."""
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return raw.withColumn(timestamp, F.try_to_timestamp(F.col(timestamp)))


def polyline_dir(route: Column, polyline_idx: Column) -> Column:
    return F.concat_ws("_", F.regexp_replace(route, "[ /]", "_"), polyline_idx.cast("int").cast("string"))


def write_by_polyline(df: DataFrame, path: str, max_rows_per_file: int = 5_000_000) -> None:
    """One folder per (route, polyline); rows without either are left out.

    The rebalance hint lets AQE gather small polylines into one file and split the large ones.
    """
    require(df, "route", "polyline_idx")
    known = df.filter(F.col("route").isNotNull() & F.col("polyline_idx").isNotNull())
    (known.withColumn("polyline", polyline_dir(F.col("route"), F.col("polyline_idx")))
          .hint("rebalance", "polyline").write.mode("overwrite")
          .option("maxRecordsPerFile", max_rows_per_file).partitionBy("polyline").parquet(path))
