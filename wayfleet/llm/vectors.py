"""Vector tables: which rows take part, and pairing a query set with all rows block by block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfleet.llm.common import cut

ROWS, QUERIES = 8192, 1024   # rows and queries in a block


def valid_vectors(table: DataFrame, zero: bool = True) -> DataFrame:
    """``(vec_id, embedding, dim)`` with each vec_id once.

    Rows whose id is null or whose vector is null, empty, or holds null or non-finite components take
    no part, nor do zero vectors unless ``zero``. A repeated vec_id counts once, with the least of its vectors.
    """
    raw = table.select(table["vec_id"].cast("long").alias("vec_id"), table["embedding"].cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    kept = raw.filter("vec_id IS NOT NULL AND size(embedding) > 0").filter(finite)
    if not zero:
        kept = kept.filter(F.exists("embedding", lambda x: x != 0))
    return kept.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))


def block_pairs(vectors: DataFrame, queries_in: Column | DataFrame, compute: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
                rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """``compute(queries, rows)`` for every block of queries with every block of rows of the same dimension.
    The queries are a table of their own, or the rows of ``vectors`` that a condition picks.

    Blocks are dealt by a hash of vec_id and their number follows the counts, so that a task holds
    one block of each side whatever the size of the table.
    """
    vectors = cut(vectors, "vectors")
    asked = vectors.filter(queries_in) if isinstance(queries_in, Column) else queries_in
    row_blocks, query_blocks = (max(1, -(-df.count() // size)) for df, size in ((vectors, rows), (asked, queries)))
    deal = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = vectors.withColumn("rows_block", deal(1, row_blocks)).withColumn("query_block", every(query_blocks))
    left = asked.withColumn("query_block", deal(2, query_blocks)).withColumn("rows_block", every(row_blocks))
    keys = ["dim", "query_block", "rows_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compute, schema)


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block, in order of id."""
    ids = table.column("vec_id").to_numpy()
    flat = table.column("embedding").combine_chunks().flatten().to_numpy()
    order = np.argsort(ids)
    return ids[order], flat.reshape(len(ids), -1)[order] if len(ids) else np.zeros((0, 0))


def best(result: DataFrame, k: int, score, columns: list[str]) -> DataFrame:
    """The first ``k`` rows of each query over all blocks, ranked from 1."""
    from pyspark.sql import Window
    order = Window.partitionBy("query_id").orderBy(score, "vec_id")
    ranked = result.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), *columns)
