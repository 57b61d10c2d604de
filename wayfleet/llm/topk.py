"""Exact top-k search by multi-resolution segment statistics.

Vectors are cut into segments; of each, mean and standard deviation are kept. For two segments of n
components the squared distance is at least n * ((difference of means)^2 + (difference of deviations)^2),
so a few numbers give a lower bound on the distance of two vectors, and with their norms an upper
bound on their inner product. Pairs that a coarse resolution cannot rule out against the k-th best
score known so far are tried on a finer one, and the survivors are computed exactly.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfleet.llm.vectors import best, block_pairs, matrix, valid_vectors

K, SCALE, EVERY = 20, 64, 20
RESOLUTIONS = (2, 8, 16)   # segments, coarse to fine
FIRST = 512                # rows of a block whose exact scores give the first bound
HIT = "query_id long, vec_id long, score long"


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, scaled so that their distance bounds that of the vectors."""
    starts = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]), endpoint=False).astype(int))
    sizes = np.diff(np.r_[starts, x.shape[1]])
    mean = np.add.reduceat(x, starts, axis=1) / sizes
    square = np.add.reduceat(x * x, starts, axis=1) / sizes
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.concatenate([mean, deviation], axis=1) * np.sqrt(np.r_[sizes, sizes])


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T


def search(queries: np.ndarray, rows: np.ndarray, same: np.ndarray, k: int) -> np.ndarray:
    """Scores of all pairs that can be among a query's ``k`` best; minus infinity for the others.

    ``same`` marks the pairs of a query with itself. Components are whole numbers, so products and
    sums are exact in double precision.
    """
    norms, query_norms = (rows * rows).sum(1), (queries * queries).sum(1)
    order = np.argsort(-norms, kind="stable")
    lead, rest = order[:max(FIRST, 2 * k)], order[max(FIRST, 2 * k):]
    scores = np.full((len(queries), len(rows)), -np.inf)
    scores[:, lead] = queries @ rows[lead].T
    scores[same] = -np.inf
    if not len(rest):
        return scores
    bound = np.partition(scores[:, lead], len(lead) - k, axis=1)[:, len(lead) - k]
    ask, have = np.arange(len(queries)), rest
    alive = np.ones((len(ask), len(have)), bool)
    for segments in RESOLUTIONS:
        apart = squared_distances(segment_statistics(queries[ask], segments), segment_statistics(rows[have], segments))
        most = (query_norms[ask][:, None] + norms[have][None] - apart) / 2
        alive &= most >= bound[ask][:, None] - 1e-6 * (1 + np.abs(most))   # room for rounding of the bound
        some, any_of = alive.any(1), alive.any(0)
        ask, have, alive = ask[some], have[any_of], alive[some][:, any_of]
        if not alive.size:
            return scores
    exact = queries[ask] @ rows[have].T
    scores[np.ix_(ask, have)] = np.where(alive, exact, -np.inf)
    scores[same] = -np.inf
    return scores


def _block(k: int, scale: int, asked: pa.Table, held: pa.Table) -> pa.Table:
    query_ids, queries = matrix(asked)
    ids, rows = matrix(held)
    out: list[list[np.ndarray]] = [[], [], []]
    if len(query_ids) and len(ids):
        queries, rows = np.floor(scale * queries), np.floor(scale * rows)
        scores = search(queries, rows, query_ids[:, None] == ids[None], k)
        for q, line in zip(query_ids, scores):
            least = np.partition(line, len(line) - k)[len(line) - k] if len(line) > k else -np.inf
            at = np.flatnonzero((line >= least) & (line > -np.inf))
            at = at[np.lexsort((ids[at], -line[at]))[:k]]
            for col, values in zip(out, (np.full(len(at), q), ids[at], line[at].astype(np.int64))):
                col.append(values)
    none = np.zeros(0, np.int64)
    return pa.table([pa.array(np.concatenate(c or [none]), pa.int64()) for c in out], names=["query_id", "vec_id", "score"])


def top_k(table: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest inner products of each query with any other row.

    Queries are the rows whose vec_id is divisible by ``every``; components are taken as floor(scale * x).
    Ties go to the smaller vec_id. See ``valid_vectors`` for null, non-finite and repeated rows; vectors
    of different length are not compared. A query without any other row has no rows, as has an empty
    table; other columns are not read.
    """
    vectors = valid_vectors(table)
    hits = block_pairs(vectors, F.col("vec_id") % every == 0, partial(_block, k, scale), HIT)
    return best(hits, k, F.desc("score"), ["vec_id", "score"])


ORACLE = """
WITH v AS (
  SELECT vec_id, min(embedding) AS embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), w AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM v),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.e, r.e) AS BIGINT) AS score
  FROM w q JOIN w r ON q.vec_id <> r.vec_id AND len(q.e) = len(r.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
