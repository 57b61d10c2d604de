"""SimHash near-duplicates found by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the vector of their bit counts is its
embedding. Flipping a bit changes one count by one, so the Manhattan distance of two embeddings never
exceeds the Hamming distance of the fingerprints. The grid join uses this: the 32 coordinates are
split into ``BITS + 2`` bands, and embeddings within ``BITS`` of each other agree in at least two whole
bands, so every pair of bands is one grid whose cells are joined by equality. A cell that grows too
large is split along its other coordinates in the same way: of ``BITS + 1`` bands of those, embeddings
within ``BITS`` of each other agree in at least one. Inside a cell the Manhattan distance over all
coordinates rejects most pairs, and the rest are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfleet.llm.common import connected, cut, row_key, text_or_empty, unused

WORDS, SEED, BITS = 4, 42, 4
CELL_ROWS = 1024      # a larger cell is compared block by block
SMALL_CELL = 24       # up to here, neighbours in sorted order are compared at once for a whole batch
LOW = np.uint64(0x5555555555555555)
ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, words: int = WORDS) -> list[int]:
    """XXH64 of every run of ``words`` words, repeats included; of all words if there are fewer."""
    tokens = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not tokens:
        return []
    joined, ends, at = memoryview(b" ".join(tokens)), [], -1
    for t in tokens:
        at += len(t) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[:-1]]
    digest = xxhash.xxh64_intdigest
    if len(tokens) < words:
        return [digest(joined, SEED)]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1:])]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint per run of ``sizes`` hashes: the bits set in over half of the run; 0 for no hash.

    Eight counters of eight bits each are added at once, in runs of at most 255 hashes.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    begin = np.cumsum(n) - n
    runs = -(-n // 255)
    first = np.cumsum(runs) - runs
    inside = np.arange(runs.sum()) - np.repeat(first, runs)
    cuts = np.repeat(begin, runs) + 255 * inside
    lanes = np.stack([np.add.reduceat((hashes >> np.uint64(s)) & ONES, cuts) for s in range(8)], axis=1)
    counts = lanes.view(np.uint8).reshape(len(cuts), 64).astype(np.int64)  # [run, shift * 8 + byte]
    counts = np.add.reduceat(counts, first, axis=0)
    bits = (2 * counts > n[:, None]).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 64)  # [byte * 8 + shift]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, parts = [], []
        for text in batch.column("text").to_pylist():
            got = np.array(shingle_hashes(text), np.uint64)
            sizes.append(len(got))
            parts.append(got)
        prints = majority(np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(sizes, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(prints.view(np.int64))],
                                         names=["doc_id", "row", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, fp)`` for every row; ``row`` identifies its id and text together."""
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    keyed = narrow.withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    return keyed.mapInArrow(_fingerprint_batches, "doc_id long, row string, fp long")


def embedding(fp: Column) -> Column:
    """The 32 bit counts (0 to 2), each in the place of its segment."""
    low, next_bit = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    one = fp.bitwiseXOR(next_bit).bitwiseAND(low)
    two = fp.bitwiseAND(next_bit).bitwiseAND(low)
    return one.bitwiseOR(F.shiftleft(two, 1))


def bands(count: int = BITS + 2) -> list[int]:
    """Masks that split the 32 segments into ``count`` bands."""
    edges = [round(32 * i / count) for i in range(count + 1)]
    return [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def grid_cells(prints: DataFrame) -> DataFrame:
    """``(grid, cell, fp)``: each fingerprint's cell in each grid, that is in each pair of bands."""
    emb = embedding(F.col("fp"))
    cells = [F.struct(F.lit(g).cast("byte").alias("grid"), emb.bitwiseAND(F.lit(_signed(a | b))).alias("cell"))
             for g, (a, b) in enumerate(combinations(bands(), 2))]
    return prints.select("fp", F.inline(F.array(*cells))).select("grid", "cell", "fp")


def finer_bands(mask: int, count: int = BITS + 1) -> list[int]:
    """Masks that split the segments outside ``mask`` into ``count`` bands."""
    rest = [3 << (2 * s) for s in range(32) if not mask >> (2 * s) & 1]
    edges = [round(len(rest) * i / count) for i in range(count + 1)]
    return [sum(rest[a:b]) for a, b in zip(edges, edges[1:])]


def finer_keys(fp: Column, grid: Column) -> Column:
    """For each band of the segments that the grid leaves out, a key of the counts there: a hash, and the
    band's number in the lowest bits. Two values that share a hash only make a cell larger."""
    masks = F.array(*[F.array(*[F.lit(_signed(m)) for m in finer_bands(a | b)]) for a, b in combinations(bands(), 2)])
    return F.transform(F.get(masks, grid.cast("int")),
                       lambda m, i: F.shiftleft(F.xxhash64(embedding(fp).bitwiseAND(m)), 3).bitwiseOR(i.cast("long") + 1))


def blocks(cells: DataFrame, limit: int = CELL_ROWS) -> DataFrame:
    """``(grid, cell, sub, block, fp)``: the rows that are compared with each other, as blocks of bounded size.

    Cells of at most ``limit`` rows stay whole. A larger one is refined where that leaves fewer pairs to
    compare than before. The rows of a cell that is still too large are dealt into parts, and each pair of
    parts is a block, so that no task gets a whole large cell and every pair of its rows still meets.
    """
    cell, none = ["grid", "cell"], F.lit(0).cast("long")
    sizes = cut(cells.groupBy(*cell).count().filter(F.col("count") > limit), "large_cells")
    if sizes.isEmpty():
        return cells.select(*cell, none.alias("sub"), none.alias("block"), "fp")
    keys = finer_keys(F.col("fp"), F.col("grid"))
    finer = cells.join(sizes.select(*cell), cell, "left_semi").select(*cell, F.explode(keys).alias("sub"))
    finer = cut(finer.groupBy(*cell, "sub").count(), "finer_cells")
    pairs = finer.groupBy(*cell).agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs"))
    gain = F.col("pairs") < F.col("count").cast("double") * F.col("count")
    sizes = cut(sizes.join(pairs, cell).select(*cell, "count", gain.alias("refine")), "refined_cells")
    left = (sizes.filter("NOT refine").select(*cell, none.alias("sub"), "count")
                 .unionByName(finer.filter(F.col("count") > limit).join(sizes.filter("refine").select(*cell), cell, "left_semi")))
    left = cut(left.select(*cell, "sub", F.ceil(F.col("count") / F.lit(limit)).cast("int").alias("parts")), "dealt_cells")
    rows = cells.join(sizes.select(*cell, "refine"), cell, "left")
    rows = rows.select(*cell, "fp", F.explode(F.when(F.col("refine"), keys).otherwise(F.array(none))).alias("sub"))
    dealt = rows.join(left, [*cell, "sub"], "left").withColumn("part", F.pmod(F.xxhash64("fp", "grid"), F.col("parts")).cast("long"))
    other = F.explode(F.when(F.col("parts").isNull(), F.array(none)).otherwise(F.sequence(none, F.col("parts").cast("long") - 1)))
    pair = F.least("part", "other") * F.lit(1 << 31) + F.greatest("part", "other")
    return (dealt.withColumn("other", other)
                 .select(*cell, "sub", F.when(F.col("parts").isNull(), none).otherwise(pair + 1).alias("block"), "fp"))


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of embeddings: a two-bit field of the exclusive or is 1 or 3 for one, 2 for two."""
    x = a ^ b
    low, high = x & LOW, (x >> np.uint64(1)) & LOW
    return np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low)


def _near(fa: np.ndarray, fb: np.ndarray) -> np.ndarray:
    """Which pairs differ in at most ``BITS`` bits; only those that pass the lower bound are compared bit by bit."""
    ea, eb = (f - ((f >> np.uint64(1)) & LOW) for f in (fa, fb))
    out = _manhattan(ea, eb) <= BITS
    at = np.nonzero(out)
    fa, fb = np.broadcast_arrays(fa, fb)
    out[at] = np.bitwise_count(fa[at] ^ fb[at]) <= BITS
    return out


def _spanning(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is connected among ``prints``, one less than there are members."""
    left = np.arange(len(prints))
    a, b = [], []
    while len(left):
        root, front = left[0], left[:1]
        left = left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for part in np.array_split(front, -(-len(front) // 256)):
                hit |= _near(prints[part][:, None], prints[left][None]).any(axis=0)
            front, left = left[hit], left[~hit]
            a.append(np.full(len(front), root))
            b.append(front)
    none = np.zeros(0, int)
    return prints[np.concatenate(a or [none])], prints[np.concatenate(b or [none])]


def _cell_links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
    """Links inside the cells of rows sorted by cell; ``keys`` numbers the cells."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [], []
    small = np.repeat((sizes > 1) & (sizes <= SMALL_CELL), sizes)
    keys_s, prints_s = keys[small], prints[small]
    for step in range(1, SMALL_CELL):
        same = np.flatnonzero(keys_s[step:] == keys_s[:-step]) if len(keys_s) > step else np.zeros(0, int)
        if not len(same):
            break
        same = same[_near(prints_s[same], prints_s[same + step])]
        a.append(prints_s[same])
        b.append(prints_s[same + step])
    for start, size in zip(starts[sizes > SMALL_CELL], sizes[sizes > SMALL_CELL]):
        one, two = _spanning(prints[start:start + size])
        a.append(one)
        b.append(two)
    none = np.zeros(0, np.uint64)
    one, two = (np.concatenate(x or [none]).view(np.int64) for x in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by cell; a cell that a batch may have cut waits for the next batch."""
    kept = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("grid", "cell", "sub", "block")]
        cells = np.concatenate([kept[0], np.stack(cols, axis=1)])
        prints = np.concatenate([kept[1], batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(cells):
            continue
        new = np.r_[True, (cells[1:] != cells[:-1]).any(axis=1)]
        last = np.flatnonzero(new)[-1]
        kept = cells[last:], prints[last:]
        yield _cell_links(np.cumsum(new)[:last], prints[:last])
    yield _cell_links(np.zeros(len(kept[1]), np.int64), kept[1])


def links(prints: DataFrame) -> DataFrame:
    """``(a, b)`` between distinct fingerprints, enough of the pairs within ``BITS`` bits to connect all of them."""
    cells = blocks(grid_cells(prints))
    key = ["grid", "cell", "sub", "block"]
    sorted_cells = cells.repartition(*key).sortWithinPartitions(*key)
    return sorted_cells.mapInArrow(_link_batches, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, fp, component_id, keep)`` for every row of ``docs(doc_id, text)``.

    Copies share a fingerprint and are joined as one. ``component_id`` is the smallest doc_id that links
    of at most ``BITS`` bits reach. ``keep`` marks one document of each component: the one with that id
    (among equal ids the least ``row``); all rows alike in id and text carry the same mark.
    A null text counts as empty; a text without words has fingerprint zero, which is linked like any
    other. Null ids are never smallest; a component of null ids only has a null id. No rows give no rows.
    """
    rows = cut(fingerprints(docs), "fingerprints")
    prints = cut(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")), "prints")
    roots = connected(links(prints.select("fp"))).withColumnRenamed("node", "fp")
    rooted = prints.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("best"))
    place = rooted.join(firsts, "root").select("fp", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("best_row"))
    return rows.join(place, "fp").select("doc_id", "row", "fp", "component_id", (F.col("row") == F.col("best_row")).alias("keep"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one document of each component, one row of equal ones.

    All columns of ``docs`` are kept as they are; see ``near_duplicates`` for nulls and ties.
    """
    row = unused(docs, "row")
    keep = near_duplicates(docs).filter("keep").select(F.col("row").alias(row)).distinct()
    keyed = docs.withColumn(row, row_key(docs["doc_id"].cast("long"), text_or_empty(docs)))
    return keyed.join(keep, row, "left_semi").dropDuplicates([row]).drop(row)


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, fingerprint as 16 hex digits, component_id."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
