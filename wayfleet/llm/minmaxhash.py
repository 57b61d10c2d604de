"""MinHash near-duplicates by min-max hashing.

A document is the set of hashes of its five-word shingles. Each of ``PERMUTATIONS`` permutations gives two
signature values, the set's minimum and its maximum, so that hashes are evaluated half as often as with
minima alone. Each of the two agrees for two sets with the probability of their Jaccard similarity, and as
they rarely agree by the same shingles the estimate varies less than with as many minima.

The signature is used twice. Bands of ``ROWS`` minima, or of ``ROWS`` maxima, bring together sets that may be
similar; a sketch of one bit per value says for each such pair whether it can be: of ``2 * PERMUTATIONS``
bits, sets at the threshold differ in about 12, and pairs that differ in over ``DIFFERENT`` are passed over. What
the two keep from being compared is a link at the very threshold with a probability of 1e-8.

Sets that are brought together, directly or by others, form a group, and inside groups links are confirmed
on the full sets. Only links that connect are looked for, so a group of copies takes one comparison each.
A group too large for a task is dealt into chunks, linked inside chunks and with two sets that all chunks get;
what is still apart after that is compared with all chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfleet.llm.common import connected, cut, text_or_empty
from wayfleet.llm.simhash import shingle_hashes
from wayfleet.operators.scale import lookup_join

WORDS, PERCENT = 5, 85
PERMUTATIONS, ROWS = 80, 5
DIFFERENT = 40             # sketch bits in which linked sets may differ
FIRST = 4                  # bands that are looked at before the others
BUCKET = 8192              # different sets that share a band; more of them form one group without a look at their sketches
GROUP = 1 << 21            # hashes of a group, or of a chunk of it, that are compared in one task
HOT = 4096                 # copies of a set from which its rows are joined apart
BLOCK = 1 << 16            # hashes that are permuted at a time
MIX = np.uint64(0x9E3779B97F4A7C15)
SKETCH = ["s0", "s1", "s2"]


# -- sets and signatures ----------------------------------------------------------------------------

@cache
def multipliers() -> np.ndarray:
    return np.random.PCG64(11).random_raw(PERMUTATIONS).astype(np.uint64) | np.uint64(1)


def extremes(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of each run of hashes that begins at ``starts``, [run, permutation]."""
    low, high = (np.empty((len(starts), PERMUTATIONS), np.uint64) for _ in range(2))
    ends = np.r_[starts[1:], len(hashes)]
    first = 0
    while first < len(starts):   # whole runs, a block's worth of them at a time
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, "right")))
        part, cuts = hashes[starts[first]:ends[last - 1]], starts[first:last] - starts[first]
        part = part ^ (part >> np.uint64(32))
        for p, factor in enumerate(multipliers()):
            permuted = part * factor
            low[first:last, p] = np.minimum.reduceat(permuted, cuts)
            high[first:last, p] = np.maximum.reduceat(permuted, cuts)
        first = last
    return low, high


def bands(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One key per band: ``ROWS`` minima or ``ROWS`` maxima of the same permutations, and the band's number."""
    out = []
    for values in (low, high):
        for i in range(0, PERMUTATIONS, ROWS):
            key = np.full(len(values), len(out) + 1, np.uint64)
            for j in range(i, i + ROWS):
                key = (key ^ values[:, j]) * MIX
                key ^= key >> np.uint64(29)
            out.append(key)
    return np.stack(out, axis=1)


def sketches(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A bit of each value, in three words."""
    values = np.concatenate([low, high], axis=1)
    bits = ((values ^ (values >> np.uint64(31))) * MIX >> np.uint64(63)).astype(np.uint8)
    bits = np.pad(bits, ((0, 0), (0, 192 - bits.shape[1])))
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _signed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(np.array(shingle_hashes(t, WORDS), np.uint64)) for t in batch.column("text").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        low, high = extremes(hashes, (np.cumsum(sizes) - sizes)[full])
        keys, bits = np.zeros((len(sets), 2 * PERMUTATIONS // ROWS), np.uint64), np.zeros((len(sets), 3), np.uint64)
        keys[full], bits[full] = bands(low, high), sketches(low, high)
        listed = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(sizes),
             *(pa.array(bits[:, i].view(np.int64)) for i in range(3)), listed],
            names=["doc_id", "text_key", "digest", "n", *SKETCH, "bands"])


def _texts(docs: DataFrame) -> DataFrame:
    text = text_or_empty(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("text_key"))


def signed(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, text_key, digest, n, sketch, bands)`` per document; equal sets have equal digests."""
    made = _texts(docs).mapInArrow(_signed_batches, "doc_id long, text_key binary, digest binary, n long, s0 long, s1 long, s2 long, bands array<long>")
    return made.withColumn("row", F.monotonically_increasing_id())


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(np.array(shingle_hashes(t, WORDS), np.uint64)).tobytes() for t in batch.column("text").to_pylist()]
        kept = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sets, pa.binary())], names=[*kept.schema.names, "hashes"])


def full_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` with the hashes of their sets, made anew from one text of each: only these are ever stored."""
    found = lookup_join(_texts(docs).select("text", "text_key"), members, ["text_key"], "inner").drop("text_key")
    columns = [c for c in members.columns if c != "text_key"]
    once = found.groupBy(*columns).agg(F.any_value("text").alias("text"))
    return once.mapInArrow(_set_batches, ", ".join(f"{c} long" for c in columns) + ", hashes binary")


# -- groups of sets that may be linked --------------------------------------------------------------

def _alike(n: np.ndarray, sketch: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` may be linked with ``one``, by size and by sketch."""
    a, b = n[one], n[others]
    sized = 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)
    return sized & (np.bitwise_count(sketch[others] ^ sketch[one]).sum(axis=1, dtype=np.int64) <= DIFFERENT)


def _bucket_links(ids: np.ndarray, labels: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect all sets of a bucket that are alike, directly or by others; equal labels are connected already."""
    out, left = [], np.arange(len(ids))
    while len(left):
        mine = labels[left] == labels[left[0]]
        front, left = list(left[mine]), left[~mine]
        while front and len(left):
            one = front.pop()
            hit = left[_alike(n, sketch, one, left)]
            if len(hit):
                new, first = np.unique(labels[hit], return_index=True)
                out += [(ids[one], ids[i]) for i in hit[first]]
                joined = np.isin(labels[left], new)
                front += list(left[joined])
                left = left[~joined]
    return out


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.sort(np.array(pairs, np.int64).reshape(-1, 2), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _runs(keys: np.ndarray) -> np.ndarray:
    """Borders of runs of equal keys, both ends included."""
    return np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]


def _bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by band key; the last run of a batch waits for the next one."""
    names = ["key", "id", "label", "n", *SKETCH]
    kept = np.zeros((0, len(names)), np.int64)
    for batch in batches:
        rows = np.concatenate([kept, np.stack([batch.column(c).to_numpy() for c in names], axis=1)])
        if len(rows):
            borders = _runs(rows[:, 0])
            kept = rows[borders[-2]:]
            yield _bucket_pairs(rows, borders[:-1])
    yield _bucket_pairs(kept, np.array([0, len(kept)]))


def _bucket_pairs(rows: np.ndarray, borders: np.ndarray) -> pa.RecordBatch:
    _, ids, labels, n = rows[:, :4].T
    pairs, sketch = [], np.ascontiguousarray(rows[:, 4:]).view(np.uint64)
    sizes = np.diff(borders)
    two = borders[:-1][sizes == 2]     # most buckets that are shared at all
    near = np.bitwise_count(sketch[two] ^ sketch[two + 1]).sum(axis=1, dtype=np.int64) <= DIFFERENT
    near &= (100 * np.minimum(n[two], n[two + 1]) >= PERCENT * np.maximum(n[two], n[two + 1])) & (labels[two] != labels[two + 1])
    pairs += list(zip(ids[two[near]], ids[two[near] + 1]))
    for i in np.flatnonzero(sizes > 2):
        part = slice(borders[i], borders[i + 1])
        pairs += _bucket_links(ids[part], labels[part], n[part], sketch[part])
    return _edges(list(set(pairs)))


def _band_links(sets: DataFrame, bucket: int) -> DataFrame:
    """``(a, b)``: pairs of ``sets(id, label, n, sketch, bands)`` that share a band and connect labels that may be linked."""
    rows = sets.select("id", "label", "n", *SKETCH, F.explode("bands").alias("key"))
    crowded = cut(rows.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("hub")).filter(F.col("size") > bucket).select("key", "hub"), "crowded")
    stars = None
    if not crowded.isEmpty():
        marked = lookup_join(rows, crowded, ["key"])
        stars = marked.filter("hub IS NOT NULL AND hub <> label").select(F.col("hub").alias("a"), F.col("label").alias("b")).distinct()
        rows = marked.filter("hub IS NULL").drop("hub")
    pairs = rows.select("key", "id", "label", "n", *SKETCH).repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_batches, "a long, b long")
    return (pairs if stars is None else pairs.unionByName(stars)).distinct()


def candidates(sets: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: enough pairs of sets that may be linked to connect all of them.

    What the first bands connect is one label to the others, so a large group of copies is linked a few
    times, not once in every band.
    """
    lean = sets.select("id", "n", *SKETCH, "bands")
    first = _band_links(lean.withColumn("label", F.col("id")).withColumn("bands", F.slice("bands", 1, FIRST)), bucket)
    labels = cut(connected(first).select(F.col("node").alias("id"), F.col("root").alias("label")), "labels")
    named = lean.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    more = _band_links(named.withColumn("bands", F.slice("bands", FIRST + 1, 2 * PERMUTATIONS)), bucket)
    return labels.filter("id <> label").select(F.col("label").alias("a"), F.col("id").alias("b")).unionByName(more)


# -- confirming links on full sets ------------------------------------------------------------------

class _Block:
    """Full sets that are compared with each other."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sketch: np.ndarray, hashes: list[bytes]):
        self.ids, self.n, self.sketch = ids, n, sketch
        joined = np.frombuffer(b"".join(hashes), np.uint64)
        values, self.numbers = np.unique(joined, return_inverse=True)
        self.starts = np.cumsum(n) - n
        self.marked = np.zeros(len(values), bool)

    def _of(self, one: int) -> np.ndarray:
        return self.numbers[self.starts[one]:self.starts[one] + self.n[one]]

    def linked(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` are linked with ``one``: sketches first, then full sets."""
        out = _alike(self.n, self.sketch, one, others)
        ask = others[out]
        if len(ask):
            self.marked[self._of(one)] = True
            at = np.repeat(self.starts[ask] - np.r_[0, np.cumsum(self.n[ask])[:-1]], self.n[ask]) + np.arange(self.n[ask].sum())
            common = np.add.reduceat(self.marked[self.numbers[at]].astype(np.int64), np.cumsum(self.n[ask]) - self.n[ask])
            self.marked[self._of(one)] = False
            out[out] = 100 * common >= PERCENT * (self.n[one] + self.n[ask] - common)
        return out

    def spanning(self) -> list[tuple[int, int]]:
        """Links that connect all that is connected."""
        out, left = [], np.arange(len(self.ids))
        while len(left) > 1:
            front, left = [left[0]], left[1:]
            while front and len(left):
                one = front.pop()
                hit = self.linked(one, left)
                out += [(self.ids[one], i) for i in self.ids[left[hit]]]
                front += list(left[hit])
                left = left[~hit]
        return out

    def across(self, asked: np.ndarray, roots: np.ndarray) -> list[tuple[int, int]]:
        """For each set of ``asked`` a link to every part that it is not in, if there is one."""
        out = []
        for one in np.flatnonzero(asked):
            others = np.flatnonzero(roots != roots[one])
            hit = others[self.linked(one, others)]
            _, first = np.unique(roots[hit], return_index=True)
            out += [(self.ids[one], i) for i in self.ids[hit[first]]]
        return out


def _confirm_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; a block that goes on in the next batch waits for it."""
    waiting: list[pa.RecordBatch] = []

    def links(rows: pa.Table) -> list[tuple[int, int]]:
        col = lambda c: rows.column(c).to_numpy()
        sketch = np.stack([col(c) for c in SKETCH], axis=1).view(np.uint64)
        block = _Block(col("id"), col("n"), sketch, rows.column("hashes").to_pylist())
        asked = col("asked")
        return block.across(asked > 0, col("root")) if asked.max() >= 0 else block.spanning()

    def flush(rows: pa.Table) -> pa.RecordBatch:
        keys = rows.column("block").to_numpy()
        borders = _runs(keys) if len(keys) else np.zeros(1, int)
        return _edges([p for a, b in zip(borders, borders[1:]) if b - a > 1 for p in links(rows.slice(a, b - a))])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("block").to_numpy()
        begin = _runs(keys)[-2]
        if begin or waiting and waiting[-1].column("block")[-1].as_py() != keys[0]:
            done = waiting + ([batch.slice(0, begin)] if begin else [])
            yield flush(pa.Table.from_batches(done))
            waiting = []
        waiting.append(batch.slice(begin))
    if waiting:
        yield flush(pa.Table.from_batches(waiting))


def _confirmed(rows: DataFrame) -> DataFrame:
    """Links inside the blocks of ``rows(block, asked, root, id, n, sketch, hashes)``."""
    rows = rows.select("block", "asked", "root", "id", "n", *SKETCH, "hashes")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(_confirm_batches, "a long, b long")


def _block(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def links(sets: DataFrame, docs: DataFrame, group: int = GROUP, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: links between different sets, enough of them to connect all that are connected."""
    groups = connected(candidates(sets, bucket)).withColumnRenamed("node", "id").withColumnRenamed("root", "of")
    members = cut(groups.join(sets.select("id", "text_key", "n", *SKETCH), "id"), "members")
    sizes = members.groupBy("of").agg(F.sum("n").alias("weight"), F.min("id").alias("hub_a"), F.max("id").alias("hub_b"))
    large = cut(sizes.filter(F.col("weight") > group).select("of", "hub_a", "hub_b", F.ceil(F.col("weight") / group).cast("int").alias("chunks")), "large_groups")
    full = lookup_join(cut(full_sets(docs, members), "full_sets"), large, ["of"])
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    hub = (F.col("id") == F.col("hub_a")) | (F.col("id") == F.col("hub_b"))
    to = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).when(hub, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(chunk))
    first = full.withColumn("to", F.explode(to)).withColumns({"block": _block(F.col("of"), F.col("to")), "asked": F.lit(-1), "root": F.lit(0).cast("long")})
    found = cut(_confirmed(first), "links")
    if large.isEmpty():
        return found
    # Sets of large groups that are not connected with most of their group yet meet all the others.
    dealt = full.filter("chunks IS NOT NULL").select("of", "chunks", "id", "n")
    roots = connected(found).withColumnRenamed("node", "id")
    parts = cut(dealt.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "parts")
    heavy = parts.groupBy("of", "root").agg(F.sum("n").alias("weight")).groupBy("of").agg(F.max(F.struct("weight", "root")).alias("most"), F.sum("weight").alias("all"))
    heavy = heavy.select("of", F.col("most.root").alias("main"), F.ceil((F.col("all") - F.col("most.weight")) / group).cast("int").alias("apart")).filter("apart > 0")
    again = lookup_join(parts.select("id", "of", "root"), heavy, ["of"], "inner").drop("of")
    again = full.filter("chunks IS NOT NULL").join(again, "id").withColumns({"chunk": chunk, "part": F.pmod(F.xxhash64(F.lit(1), "id"), F.col("apart")).cast("int")})
    copied = lambda of, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(of)
    whole = again.select("*", copied("with", "apart")).withColumns({"block": _block(F.col("of"), F.col("chunk"), F.col("with")), "asked": F.lit(0)})
    apart = again.filter(F.col("root") != F.col("main")).select("*", copied("with", "chunks")).withColumns({"block": _block(F.col("of"), F.col("with"), F.col("part")), "asked": F.lit(1)})
    return found.unionByName(cut(_confirmed(whole.unionByName(apart)), "links"))


# -- the operator -----------------------------------------------------------------------------------

def near_duplicates(docs: DataFrame, group: int = GROUP, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text)``.

    Rows are linked if 100 times the common shingles of their sets are at least ``PERCENT`` times all of
    them; equal sets are one and cost one comparison. ``component_id`` is the smallest doc_id that links
    reach, null ids never being smallest; only null ids have a null one. A null text, or one without words,
    has no shingles and is a component of its own; one with fewer than five words is one shingle. ``kept``
    marks rows whose doc_id is the component's, so repeated ids are kept together. No rows give no rows;
    other columns are not read. Shingles are told apart by 64-bit hashes.
    """
    rows = cut(signed(docs), "signed")
    same = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.min("row").alias("id"), F.count("*").alias("copies"), F.min("text_key").alias("text_key"),
                                                      *[F.any_value(c).alias(c) for c in ("n", *SKETCH, "bands")])
    sets = cut(same, "sets")
    roots = connected(links(sets, docs, group, bucket)).withColumnRenamed("node", "id")
    rooted = cut(sets.select("digest", "id", "doc", "copies").join(roots, "id", "left"), "rooted")
    least = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc").alias("least"))
    placed = cut(lookup_join(rooted, least, ["root"]).select("digest", "copies", F.coalesce("least", "doc").alias("component_id")), "placed")
    narrow = rows.select("doc_id", "digest", F.col("n").alias("n_shingles"))
    often = placed.filter(F.col("copies") >= hot).select("digest", "component_id", F.lit(True).alias("often"))
    marked = lookup_join(narrow.filter("n_shingles > 0"), often, ["digest"])
    seldom = marked.filter("often IS NULL").drop("component_id").join(placed.filter(F.col("copies") < hot).select("digest", "component_id"), "digest")
    columns = ["doc_id", "n_shingles", "component_id"]
    out = marked.filter("often").select(*columns).unionByName(seldom.select(*columns))
    out = out.unionByName(narrow.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, CAST(len(w) - 3 AS BIGINT)), lambda i: array_to_string(w[i:i + 4], ' '))) END AS shingles FROM t
), n AS (SELECT doc_id, len(shingles) AS n FROM s),
g AS (SELECT doc_id, unnest(shingles) AS x FROM s),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN least USING (doc_id)
"""
