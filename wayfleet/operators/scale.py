"""Shared tools that keep the operators safe on large and skewed inputs.

A vehicle, trip or stop may hold a large share of all rows, so no group of more than ``HOT_ROWS`` rows
is sorted in one task. Its time-ordered work is cut into slices, ``(group, slice)`` being the shuffle key,
and what must cross a slice border travels either as copied border rows (``with_halo``, when the reach is
bounded in time) or as one summary row per slice (``prefix_sums``, ``next_from_later`` and
``previous_from_earlier``, when it is not). Groups up to that size, most often all of them, are counted
first and handled whole: one shuffle, no copies, no summaries.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_SECONDS = 3600
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 32
RANGES = 128
BLOCK_ROWS = 4096
HOT_ROWS = 100_000        # a group of more rows is cut into slices


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing column(s) {missing}, have {df.columns}")
    return df


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="wayfleet-")


def shared_dir(spark: SparkSession) -> str:
    """Folder for stage tables: the cluster's ``spark.checkpoint.dir``; a temporary one only locally."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_dir()


def cut(df: DataFrame, name: str = "cut", folder: str | None = None) -> DataFrame:
    """Write ``df`` and read it back, so later passes scan it instead of redoing it.

    Without ``folder`` it goes to a new place in the shared folder; with one, ``folder/name`` is
    replaced, which keeps long-running streams from piling up files.
    """
    spark = df.sparkSession
    path = f"{folder}/{name}" if folder else f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def stored_bytes(df: DataFrame) -> int:
    """Size of the files behind a table that was read back, as Spark's own statistics have it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def may_broadcast(stored: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a stored table is small enough in rows and in bytes."""
    return stored_bytes(stored) <= BROADCAST_BYTES and fits(stored, max_rows)


def _salt(df: DataFrame) -> Column:
    plain = [f.name for f in df.schema.fields
             if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
    return F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int")


def lookup_join(df: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "left",
                small: bool | None = None) -> DataFrame:
    """Equi-join a large table to a dimension.

    The dimension is broadcast when its stored size allows it (``small`` carries a check that was
    already made). Otherwise both sides shuffle on the key plus a salt, so one hot key, or the rows
    without any key, spread over many tasks. The hint keeps Spark from broadcasting the salted copies, whose
    number its statistics don't know: they would pass through the driver.
    """
    if small is None:
        dim = cut(dim, "dim")
        small = may_broadcast(dim)
    if small:
        return df.join(F.broadcast(dim), list(keys), how)
    salted = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", _salt(df)).join(salted.hint("merge"), [*keys, "_salt"], how).drop("_salt")


@dataclass(frozen=True)
class Hot:
    """``keys`` of the groups with more than ``HOT_ROWS`` rows, None if there are none."""

    keys: DataFrame | None = None

    def join(self, df: DataFrame, group: Sequence[str], how: str) -> DataFrame:
        """``df`` with the keys, of which there are at most one per ``HOT_ROWS`` rows; null keys are equal."""
        keys, same = self.keys.withColumnsRenamed({c: f"_h_{c}" for c in group}), F.lit(True)
        for c in group:
            same = same & F.col(c).eqNullSafe(F.col(f"_h_{c}"))
        return df.join(F.broadcast(keys), same, how)


def hot_groups(df: DataFrame, group: Sequence[str], folder: str | None = None) -> Hot:
    """Counts the rows per group, on the map side first; ``folder`` as for ``cut``."""
    return hot_sizes(df.groupBy(*group).agg(F.count("*").alias("_n")), group, folder)


def hot_sizes(sizes: DataFrame, group: Sequence[str], folder: str | None = None) -> Hot:
    """The same from groups that were counted, ``_n`` rows each."""
    keys = cut(sizes.filter(F.col("_n") > HOT_ROWS).select(*group), "hot", folder)
    return Hot(None if keys.isEmpty() else keys)


def by_size(df: DataFrame, group: Sequence[str], whole: Callable[[DataFrame], DataFrame], sliced: Callable[[DataFrame], DataFrame],
            hot: Hot | None = None) -> DataFrame:
    """``sliced(rows)`` of the hot groups and ``whole(rows)`` of the others; without ``hot`` they are counted."""
    hot = hot or hot_groups(df, group)
    if hot.keys is None:
        return whole(df)
    return whole(hot.join(df, group, "left_anti")).unionByName(sliced(hot.join(df, group, "left_semi")))


def time_slice(seconds: int = SLICE_SECONDS, us: str = "t_us") -> Column:
    return F.floor(F.col(us) / F.lit(int(seconds) * 1_000_000)).cast("long")


def with_halo(df: DataFrame, before: float, after: float, seconds: int = SLICE_SECONDS) -> DataFrame:
    """Give every row its slice and copy it to each slice that begins or ends within reach of it.

    ``before``/``after`` are seconds of context that a slice needs ahead of its start / past its end.
    ``_home`` marks the row's own slice; ``drop_halo`` removes the copies again.
    """
    width = int(seconds) * 1_000_000
    slice_of = lambda shift: F.floor((F.col("t_us") + F.lit(int(shift * 1_000_000))) / F.lit(width)).cast("long")
    return (df.withColumn("_slice", F.explode(F.sequence(slice_of(-after), slice_of(before))))
              .withColumn("_home", F.col("_slice") == time_slice(seconds)))


def with_halo_if_hot(df: DataFrame, before: float, after: float, seconds: int, group: Sequence[str], hot: Hot) -> DataFrame:
    """As ``with_halo`` for the rows of hot groups; every other group is one slice, without copies."""
    df = df.filter(F.col("t_us").isNotNull())
    if hot.keys is None:
        return df.withColumns({"_slice": F.lit(0).cast("long"), "_home": F.lit(True)})
    return with_halo(hot.join(df, group, "left_semi"), before, after, seconds).unionByName(
        hot.join(df, group, "left_anti").withColumns({"_slice": F.lit(0).cast("long"), "_home": F.lit(True)}))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter("_home").drop("_home")


def prefix_sums(df: DataFrame, group: Sequence[str], slice_col: str, order: Sequence[str],
                sums: dict[str, Column], hot: Hot | None = None) -> DataFrame:
    """Running sums (current row included) over ``group`` in ``(slice_col, *order)`` order.

    Of a hot group only one row per slice is ever sorted; the rows themselves are sorted per slice. Rows
    without a group or a slice are left out; those without a slice count before the others.
    """
    return by_size(df, group, lambda rows: _whole_sums(rows, group, slice_col, order, sums),
                   lambda rows: _sliced_sums(rows, group, slice_col, order, sums), hot)


def _whole_sums(df: DataFrame, group: Sequence[str], slice_col: str, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    upto = Window.partitionBy(*group).orderBy(slice_col, *order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.dropna(subset=list(group)).withColumns({n: F.coalesce(F.sum(v).over(upto), F.lit(0)) for n, v in sums.items()})
    return summed.dropna(subset=[slice_col])     # but its rows count, as the group's first


def _sliced_sums(df: DataFrame, group: Sequence[str], slice_col: str, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    totals = df.groupBy(*group, slice_col).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    earlier = Window.partitionBy(*group).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, slice_col, *[
        F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*group, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({f"_l_{n}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in sums.items()})
    joined = local.join(offsets, [*group, slice_col])
    return joined.withColumns({n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in sums}).drop(
        *[f"_l_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def row_blocks(df: DataFrame, group: Sequence[str], order: Sequence[str], before: int, after: int,
               rows: int = BLOCK_ROWS, seconds: int = SLICE_SECONDS) -> DataFrame:
    """Give every row its ``_block`` of ``rows`` consecutive ones of its group, and copy it to the blocks near it.

    A block gets the ``before`` rows ahead of its first and the ``after`` rows past its last, however far
    away in time they are. ``drop_halo`` removes the copies; rows without a group or a time are left out.
    """
    placed = prefix_sums(df.withColumn("_slice", time_slice(seconds)), group, "_slice", order, {"_pos": F.lit(1)})
    block_of = lambda shift: F.floor((F.col("_pos") + F.lit(shift)) / F.lit(rows)).cast("long")
    return (placed.withColumn("_block", F.explode(F.sequence(block_of(-after), block_of(before))))
                  .withColumn("_home", F.col("_block") == block_of(0)).drop("_slice", "_pos"))


def over_slices(df: DataFrame, group: Sequence[str], slice_col: str, name: str, per_slice: Column,
                merge: Callable[[str], Column]) -> DataFrame:
    """One aggregate per group, on a row per ``(group, slice)``: joined on both, a hot group spreads over its slices."""
    parts = df.groupBy(*group, slice_col).agg(per_slice.alias(name))
    return parts.withColumn(name, merge(name).over(Window.partitionBy(*group)))


def next_from_later(df: DataFrame, group: Sequence[str], slice_col: str, first: Column, name: str) -> DataFrame:
    """Per ``(group, slice)``: the first non-null ``first`` (an aggregate) among the later slices."""
    per_slice = df.groupBy(*group, slice_col).agg(first.alias("_first"))
    later = Window.partitionBy(*group).orderBy(F.col(slice_col).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(*group, slice_col, F.last("_first", ignorenulls=True).over(later).alias(name))


def previous_from_earlier(df: DataFrame, group: Sequence[str], slice_col: str, last: Column, name: str) -> DataFrame:
    """Per ``(group, slice)``: the last non-null ``last`` (an aggregate) among the earlier slices."""
    per_slice = df.groupBy(*group, slice_col).agg(last.alias("_last"))
    earlier = Window.partitionBy(*group).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(*group, slice_col, F.last("_last", ignorenulls=True).over(earlier).alias(name))


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``probs``.

    Equal values are counted before the shuffle and ranked within value ranges, so no task sorts a
    whole group. The ranges part each group's distinct values about evenly, wherever they lie. The
    counts are stored because three passes read them.
    """
    whole = not group
    if whole:
        df, group = df.withColumn("_all", F.lit(1)), ["_all"]
    counts = cut(df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n")), "counts")
    parts = [i / ranges for i in range(1, ranges)]
    bounds = counts.groupBy(*group).agg(F.array_distinct(F.percentile_approx(value, parts, 20 * ranges)).alias("_bounds"))
    counts = cut(lookup_join(counts, bounds, group).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col(value))))
                 .drop("_bounds"), "counts")
    ranked = prefix_sums(counts, group, "_range", [value], {"_upto": F.col("_n")})
    sizes = over_slices(counts, group, "_range", "_size", F.sum("_n"), F.sum)
    ranked = ranked.join(sizes, [*group, "_range"])
    picks = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("_size") - 1)
        holds = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
        picks += [F.max(F.when(holds(F.floor(at)), F.col(value))).alias(f"_lo_{name}"),
                  F.max(F.when(holds(F.ceil(at)), F.col(value))).alias(f"_hi_{name}"),
                  F.max(at - F.floor(at)).alias(f"_w_{name}")]
    got = ranked.groupBy(*group).agg(*picks)
    return got.select(*([] if whole else group), *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n) for n in probs])
