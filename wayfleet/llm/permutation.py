"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order of distance, and posted under each of them
together with the pivot's place in that order. A query reads the files of its own nearest pivots and
adds up the footrule distance to every vector posted there: how far the shared pivots are apart in the
two orders, a missing pivot counting as the place after the last. The closest vectors by footrule
are reranked by their exact distance.

Each distinct vector is indexed once and stands for all rows that hold it: copies neither crowd the
pivots nor fill the part that is reranked. The pivots are a bounded sample, ``PIVOTS`` distinct
vectors; the index holds every row.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfleet.llm.common import cut
from wayfleet.llm.vectors import best, block_pairs, matrix, valid_vectors

K, EVERY = 10, 100
PIVOTS, PREFIX = 256, 64
SHARE, LEAST = 0.3, 200    # part of a block's distinct vectors that is reranked, and the least number
PARTS = 16                 # parts in which the rows of one vector are first cut to their least ids
HIT = "query_id long, vec_id long, score double"


def prefixes(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Each vector's nearest pivots, nearest first, equal distances by pivot number."""
    apart = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.argsort(apart, axis=1, kind="stable")[:, :length]


class InvertedFiles:
    """The vectors of a block posted under the pivots of their prefixes."""

    def __init__(self, orders: np.ndarray, pivots: int):
        n, self.length = orders.shape
        places = np.tile(np.arange(self.length), n)
        by_pivot = np.argsort(orders.ravel(), kind="stable")
        self.rows, self.places = by_pivot // self.length, places[by_pivot]
        self.starts = np.searchsorted(orders.ravel()[by_pivot], np.arange(pivots + 1))
        self.size = n

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of every vector to one prefix. Two prefixes that share no pivot are
        ``length * (length + 1)`` apart; each shared one takes off what it had counted as missing in both."""
        total = np.full(self.size, self.length * (self.length + 1))
        for place, pivot in enumerate(order):
            part = slice(self.starts[pivot], self.starts[pivot + 1])
            total[self.rows[part]] -= 2 * (self.length - np.maximum(place, self.places[part]))
        return total


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """``(embedding, dim, vec_id, ids)`` per distinct vector: its least id, and its ``k + 1`` least ids in order,
    which is all that the ``k`` nearest of any row can hold of it. A common vector is cut in every task, then
    in parts, before its rows meet."""
    least = Window.partitionBy("embedding", "part").orderBy("vec_id")
    few = (vectors.withColumn("part", F.spark_partition_id() % PARTS)
                  .withColumn("place", F.row_number().over(least)).filter(F.col("place") <= k + 1))
    ids = F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1)
    return few.groupBy("embedding").agg(F.first("dim").alias("dim"), F.min("vec_id").alias("vec_id"), ids.alias("ids"))


def _block(pivots: dict[int, np.ndarray], k: int, share: float, least: int, asked: pa.Table, held: pa.Table) -> pa.Table:
    query_ids, queries = matrix(asked)
    ids, rows = matrix(held)
    out: list[list[np.ndarray]] = [[], [], []]
    if len(query_ids) and len(ids):
        copies = dict(zip(held.column("vec_id").to_pylist(), held.column("ids").to_pylist()))
        place = {x.tobytes(): n for n, x in enumerate(rows + 0.0)}   # without the sign of zeros
        among = pivots.get(rows.shape[1])
        count = max(least, int(np.ceil(share * len(ids))))
        if among is not None:
            length = min(PREFIX, len(among))
            files = InvertedFiles(prefixes(rows, among, length), len(among))
            orders = prefixes(queries, among, length)
        for i, (q, x) in enumerate(zip(query_ids, queries + 0.0)):
            near = np.arange(len(ids))
            if among is not None and count < len(ids):
                near = np.argsort(files.footrule(orders[i]), kind="stable")[:count]
                own = place.get(x.tobytes())
                if own is not None and own not in near:
                    near = np.append(near, own)
            apart = np.sqrt(((rows[near] - x) ** 2).sum(1))
            first = np.lexsort((ids[near], apart))[:k + 1]   # one of them may hold no row but the query's
            found = [(d, n) for at, d in zip(ids[near[first]], apart[first]) for n in copies[at] if n != q]
            found = sorted(found)[:k]
            for col, values in zip(out, ([q] * len(found), [n for _, n in found], [d for d, _ in found])):
                col.append(np.array(values))
    none = np.zeros(0)
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.table([pa.array(np.concatenate(c or [none]).astype(t.to_pandas_dtype()), t) for c, t in zip(out, kinds)],
                    names=["query_id", "vec_id", "score"])


def pick_pivots(vectors: DataFrame, count: int = PIVOTS) -> dict[int, np.ndarray]:
    """``count`` vectors by least hash of their id, by dimension."""
    rows = vectors.select("dim", "embedding").orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(count).collect()
    return {d: np.array([r["embedding"] for r in rows if r["dim"] == d]) for d in {r["dim"] for r in rows}}


def nearest(table: DataFrame, k: int = K, every: int = EVERY, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest other rows found for each query, by Euclidean distance.

    Queries are the rows whose vec_id is divisible by ``every``. Ties go to the smaller vec_id, at equal
    footrule too. See ``valid_vectors`` for null, non-finite and repeated rows; zero vectors take no part
    either; vectors of different length are not compared. An empty table gives no rows; other columns
    are not read.
    """
    vectors = cut(valid_vectors(table, zero=False), "vectors")
    index = cut(distinct_vectors(vectors, k), "distinct_vectors")
    compute = partial(_block, pick_pivots(index), k, share, least)
    hits = block_pairs(index, vectors.filter(F.col("vec_id") % every == 0), compute, HIT)
    return best(hits, k, F.asc("score"), ["vec_id", "score"])
