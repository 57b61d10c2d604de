"""Small helpers the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfleet.operators.scale import cut

__all__ = ["cut", "table", "text_or_empty", "row_key", "unused", "connected"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(df: DataFrame) -> Column:
    """The text column; a null text counts as an empty one."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def row_key(doc_id: Column, text: Column) -> Column:
    """A key that two rows share only if both their id and their whole text are the same.

    Joins that carry a decision back to documents use it, so null or repeated ids do no harm: rows
    that are alike in id and text get the same decision.
    """
    return F.md5(F.concat_ws("\x1f", F.coalesce(doc_id.cast("string"), F.lit("\x1e")), F.coalesce(text, F.lit(""))))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def connected(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, root)`` per node, root its least node.

    Every round gives each node the least label among its own and its neighbours', then follows that
    label's own label (pointer jumping), so the number of rounds is logarithmic in practice. Labels
    are written to the shared folder each round; joins have two shuffled sides, which adaptive
    execution splits where a node holds a large share of the edges.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                     .select("node", F.least("node", "least").alias("root")), "labels")
    while True:
        seen = (both.join(labels.select(F.col("node").alias("b"), "root"), "b")
                    .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near")))
        lower = labels.join(seen, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        after = cut(lower.join(jump, "low").select("node", F.least("low", "far").alias("new"), "root"), "labels")
        labels = after.select("node", F.col("new").alias("root"))
        if after.filter(F.col("new") < F.col("root")).isEmpty():
            return labels
