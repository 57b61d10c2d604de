"""Best-fit packing of token sequences by hierarchical residual packing.

Pieces are dealt at random, so that every task sees all lengths mixed. It packs them best-fit, longest
first, a batch at a time. Bins that are nearly full are final; up to ``PASS`` others, the emptiest,
wait for the next batch, and the rest are items of the next level. There, and in all levels above, a
node takes about ``FAN_IN * PASS`` open bins, whole, and packs them best-fit again; the number of nodes
follows from the number of open bins, so no task holds more however many there are. In a node at most
one bin stays half empty, as it would take up any other such bin. These meet in one node of the next
level. When at most one is left, no two of the others fit together, and all bins are final.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfleet.llm.common import cut, text_or_empty
from wayfleet.llm.tokens import word_ids

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LENGTH = 2048
FULL = 0.99      # a bin filled to this share is nearly full
FAN_IN = 8
PASS = 4096
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECE}, node long, bin long, offset long, fill long, done boolean"


def _piece_batches(path: str, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = word_ids(text, path) + b"\0\0\0\0"
            for n, at in enumerate(range(0, len(ids), 4 * limit)):
                part = ids[at:at + 4 * limit]
                rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
        cols = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                         names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, path: str = VOCABULARY, limit: int = LENGTH) -> DataFrame:
    """The token pieces of every document: its ids and a closing 0, cut only where they exceed ``limit``."""
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    return narrow.mapInArrow(partial(_piece_batches, path, limit), PIECE)


def best_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset there, and each bin's fill.

    Bins wait in one stack per room that they have left, and the bits of ``rooms`` tell which stacks
    hold any, so the tightest bin with enough room is the lowest bit from an item's length on.
    """
    stacks: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms, fills = 0, []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, b = limit, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if room > size:
            stacks[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(fills, np.int64)


def _pack_partition(limit: int, full: float, keep: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Level 0, one batch of pieces at a time; the emptiest open bins after a batch are items of the next one."""
    node, made, carried = TaskContext.get().partitionId(), 0, None
    for frame in frames:
        frame = frame.drop(columns="deal").sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        frame = frame.assign(node=node, bin=made + np.arange(len(frame)), offset=0, fill=frame["length"], done=False)
        made += len(frame)
        packed = repack(frame if carried is None else pd.concat([carried, frame]), node, made, limit, full)
        made = int(packed["bin"].max()) + 1 if len(packed) else made
        open_bins = packed.loc[~packed["done"], ["bin", "fill"]].drop_duplicates("bin").sort_values(["fill", "bin"])
        waits = packed["bin"].isin(open_bins["bin"].iloc[:keep])
        carried = packed[waits]
        yield packed[~waits]
    if carried is not None:
        yield carried


def repack(rows: pd.DataFrame, node: int, first: int, limit: int, full: float) -> pd.DataFrame:
    """Pack the bins that ``rows`` lie in into new bins numbered from ``first`` on; nearly full ones are done."""
    items = rows[["node", "bin", "fill"]].drop_duplicates(["node", "bin"]).sort_values(["node", "bin"])
    bins, offsets, fills = best_fit(items["fill"].to_numpy(), limit)
    done = fills >= full * limit
    moved = items[["node", "bin"]].assign(to=first + bins, shift=offsets, now=fills[bins], final=done[bins])
    rows = rows.merge(moved, on=["node", "bin"], how="left", sort=False)
    return rows.assign(node=node, bin=rows["to"], offset=rows["offset"] + rows["shift"], fill=rows["now"],
                       done=rows["final"]).drop(columns=["to", "shift", "now", "final"])


def _pack_node(limit: int, full: float, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return repack(rows.drop(columns="parent"), int(key[0]), 0, limit, full)


def pack(items: DataFrame, limit: int = LENGTH, full: float = FULL, fan_in: int = FAN_IN, keep: int = PASS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``items`` (columns of ``PIECE``), each of 1 to ``limit`` tokens.

    Every level is written before the next one reads it, so a lost executor cannot mix two packings.
    A sequence number holds the level, the node and the bin in the node.
    """
    schema = ", ".join(PLACED.split(", "))
    stored = cut(items.withColumn("deal", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())), "pieces")
    mixed = stored.repartition("deal").sortWithinPartitions("deal")
    placed = cut(mixed.mapInPandas(partial(_pack_partition, limit, full, keep), schema), "packed")
    out, level, nodes = [], 0, 0
    half_empty = F.col("fill") <= limit // 2
    while True:
        number = F.lit(level << 54) + F.col("node") * F.lit(1 << 32) + F.col("bin")
        part = placed.select(*[c.split()[0] for c in PIECE.split(", ")], number.alias("sequence_id"), "offset", "done")
        rest = placed.filter("NOT done")
        starts = rest.filter("offset = 0").agg(F.count("*"), F.count(F.when(half_empty, 1))).first()   # one row per bin
        if nodes == 1 or starts[1] <= 1:
            out.append(part.drop("done"))
            break
        out.append(part.filter("done").drop("done"))
        nodes, level = -(-starts[0] // (fan_in * keep)), level + 1
        parent = F.when(half_empty, 0).otherwise(F.pmod(F.xxhash64("node", "bin", F.lit(level)), F.lit(nodes))).cast("long")
        placed = cut(rest.withColumn("parent", parent).groupBy("parent").applyInPandas(partial(_pack_node, limit, full), schema), "packed")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def packed(docs: DataFrame, path: str = VOCABULARY, limit: int = LENGTH) -> DataFrame:
    """Pack all documents: per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty; such a document is one piece of one token. Pieces of equal length
    are taken in the order of doc_id and piece, equal rows are packed each for itself, and null ids
    stay null. No rows give no rows. Other columns are not read.
    """
    return pack(pieces(docs, path, limit), limit)
