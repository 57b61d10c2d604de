"""Conversation prefix trie, built with burst tries.

Every conversation is a sequence of turn ids; conversations that are alike are one entry with a count.
Entries lie in containers under the heads of the trie, at first all of them under the root. A container
of over ``CONTAINER`` entries bursts: what its entries have in common becomes a chain of nodes, and the
entries move, by their next turn id, to containers of their own. Bursting goes on until all containers are
small. Those are spread over tasks, sorted, and swept into nodes entry by entry: what an entry does not
share with the one before is opened, what is left behind is closed. Sums over subtrees go up from the
containers through the burst nodes, round by round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfleet.llm.common import cut
from wayfleet.operators.scale import lookup_join

FAMILY, HEADS = 5, 9       # conversations share the beginning of the first of FAMILY; fewer than HEADS turns of it
CONTAINER = 4096           # entries of a container that are swept in one task
ID_RANGE = 1 << 14         # conversation ids that are listed in one piece
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SWEPT = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODE) + ", above string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversations(table: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: per conversation its turns in order, each as ``(id, bytes)``.

    An id is the digest of role and text, so equal turns have equal ids. Turns of the same number are ordered
    by role and text. Rows without a conv_id take no part.
    """
    rows = table.select(table["conv_id"].cast("long").alias("conv_id"), table["turn"].cast("long").alias("turn"),
                        F.coalesce(table["role"].cast("string"), F.lit("")).alias("role"),
                        F.coalesce(table["text"].cast("string"), F.lit("")).alias("text")).filter("conv_id IS NOT NULL")
    ids = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    item = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "role", "text", ids.alias("id"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), F.octet_length(t["text"]).cast("long").alias("bytes"))).alias("turns"))


def rebuilt(table: DataFrame) -> DataFrame:
    """``(conv_id, ids, bytes)``: the first h turns of the family's first conversation, then the own ones after h.

    The family's first conversation is c - c mod 5, c mod 5 being 0 to 4 also for negative ids.
    """
    convs = cut(conversations(table), "conversations")
    family = F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))
    first = convs.filter(F.pmod("conv_id", F.lit(FAMILY)) == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, HEADS - 1).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    both = convs.withColumn("family", family).join(first, "family", "left")
    turns = F.concat(F.when(F.col("lead").isNull(), F.slice("turns", F.lit(1), F.lit(0))).otherwise(F.slice("lead", F.lit(1), h)),
                     F.slice("turns", h + 1, F.size("turns") + 1))
    return both.select("conv_id", turns.alias("turns")).select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.bytes").alias("bytes"))


# -- equal conversations and the digests of their ids ------------------------------------------------

def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the listed ids; rows come sorted by sequence and place, and only one digest is open at a time."""
    open_key, digest = None, None
    for batch in batches:
        keys, ends = [], []
        for key, listed in zip(batch.column("sequence").to_pylist(), batch.column("listed").to_pylist()):
            if key != open_key:
                if digest is not None:
                    keys.append(open_key)
                    ends.append(digest.hexdigest())
                open_key, digest = key, hashlib.sha256(listed.encode())
            else:
                digest.update(b"," + listed.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ends, pa.string())], names=["sequence", "ends"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_key]), pa.array([digest.hexdigest()])], names=["sequence", "ends"])


def entries(convs: DataFrame) -> DataFrame:
    """``(sequence, ids, bytes, conv, n, ends)``: different sequences, their least conversation, how many
    there are, and the digest of all their ids.

    Ids are listed per range of ids, so no list grows with the number of conversations that are alike; the
    digest of a sequence, which has to go through its ids in order, reads those lists one after another.
    """
    keyed = convs.withColumn("sequence", F.sha2(F.concat_ws("", F.transform("ids", F.hex)), 256))
    parts = keyed.groupBy("sequence", F.floor(F.col("conv_id") / F.lit(ID_RANGE)).cast("long").alias("range")).agg(
        F.sort_array(F.collect_list("conv_id")).alias("members"), F.any_value("ids").alias("ids"), F.any_value("bytes").alias("bytes"))
    parts = cut(parts.select("sequence", "range", "ids", "bytes", F.element_at("members", 1).alias("conv"), F.size("members").cast("long").alias("n"),
                             F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("listed")), "members")
    alike = parts.groupBy("sequence").agg(F.any_value("ids").alias("ids"), F.any_value("bytes").alias("bytes"),
                                          F.min("conv").alias("conv"), F.sum("n").alias("n"))
    ordered = parts.select("sequence", "range", "listed").repartition("sequence").sortWithinPartitions("sequence", "range")
    return alike.join(ordered.mapInArrow(_hash_batches, "sequence string, ends string"), "sequence")


# -- sweeping containers ----------------------------------------------------------------------------

class _Open:
    """A node whose subtree is not complete yet."""

    __slots__ = ("id", "depth", "bytes", "conv", "n", "children", "leaves", "saved", "ends", "rows")

    def __init__(self, id_: bytes | None, depth: int, last: int):
        self.id, self.depth, self.bytes = id_, depth, last
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends, self.rows = None, 0, 0, 0, 0, NO_ENDS, []

    def add(self, conv: int, n: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n += n

    def closed(self) -> tuple:
        """The node's row, without its parent."""
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.bytes
        return self.conv, self.depth, self.n, self.children, self.leaves, self.saved, self.ends


class _Sweep:
    """Nodes of one container, whose entries come in order."""

    def __init__(self, head: str, parent: str | None, depth: int, last: int, up: int | None):
        self.head, self.parent, self.up, self.path, self.out = head, parent, up, [_Open(None, depth, last)], []

    def _close(self) -> None:
        node = self.path.pop()
        row = node.closed()
        self.out += [(conv, depth, node.conv, *rest, None) for conv, depth, *rest in node.rows]
        if self.path:
            above = self.path[-1]
            above.add(node.conv, node.n)
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
            above.rows.append(row)
        else:
            self.out.append((row[0], row[1], self.up, *row[2:], self.parent))

    def entry(self, ids: list[bytes], sizes: list[int], conv: int, n: int, ends: str) -> None:
        shared = 0
        while shared < len(ids) and shared + 1 < len(self.path) and self.path[shared + 1].id == ids[shared]:
            shared += 1
        while len(self.path) > shared + 1:
            self._close()
        for i in range(shared, len(ids)):
            self.path.append(_Open(ids[i], self.path[-1].depth + 1, sizes[i]))
        self.path[-1].add(conv, n)
        self.path[-1].ends = ends

    def finish(self) -> list[tuple]:
        while self.path:
            self._close()
        return self.taken()

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _sweep_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string() if c in ("ends_sha256", "above") else pa.int64() for c in [*NODE, "above"]]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=[*NODE, "above"])
    sweep = None
    for batch in batches:
        rows = []
        for head, parent, depth, last, up, ids, sizes, conv, n, ends in zip(*(batch.column(c).to_pylist() for c in ("head", "parent", "depth", "last", "up", "ids", "bytes", "conv", "n", "ends"))):
            if sweep is None or sweep.head != head:
                rows += sweep.finish() if sweep else []
                sweep = _Sweep(head, parent, depth, last, up)
            sweep.entry(ids, sizes, conv, n, ends)
        yield table(rows + (sweep.taken() if sweep else []))
    yield table(sweep.finish() if sweep else [])


# -- bursting ---------------------------------------------------------------------------------------

def _shared(least: Column, most: Column) -> Column:
    """How many first elements two arrays have in common."""
    differ = F.array_position(F.zip_with(least, most, lambda a, b: ~a.eqNullSafe(b)), F.lit(True))
    return F.when(differ == 0, F.size(least)).otherwise(differ - 1).cast("int")


def _below(head: Column, ids: Column) -> Column:
    """The head that is reached from ``head`` by ``ids``."""
    return F.aggregate(ids, head, lambda above, i: F.md5(F.concat(above, F.hex(i)).cast("binary")))


def large_containers(held: DataFrame, limit: int) -> DataFrame:
    """The heads of containers of over ``limit`` entries, with the beginning that all their entries share."""
    sizes = held.groupBy("head").agg(F.count("*").alias("entries"), F.min(F.struct("ids", "bytes", "ends")).alias("least"), F.max("ids").alias("most"),
                                     F.min("conv").alias("conv"), F.sum("n").alias("n"), *[F.any_value(c).alias(c) for c in ("parent", "depth", "last", "up")])
    large = sizes.filter(F.col("entries") > limit).withColumn("shared", _shared(F.col("least.ids"), F.col("most")))
    ended = F.when(F.size("least.ids") == F.col("shared"), F.col("least.ends")).otherwise(F.lit(NO_ENDS))
    return cut(large.select("head", "parent", "depth", "up", "conv", "n", "shared", ended.alias("ends"),
                            _below(F.col("head"), F.slice("least.ids", F.lit(1), F.col("shared"))).alias("node"),
                            F.concat(F.array("last"), F.slice("least.bytes", F.lit(1), F.col("shared"))).alias("sizes")), "heads")


def burst(held: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(the containers that stay, those that the entries of the large ones move to)``."""
    places = large.select("head", "shared", "node", F.col("conv").alias("above"))
    marked = lookup_join(held, places, ["head"])
    moving = marked.filter(F.size("ids") > F.col("shared"))
    rest = lambda c: F.slice(c, F.col("shared") + 2, F.size(c))
    below = moving.select(_below(F.col("node"), F.slice("ids", F.col("shared") + 1, F.lit(1))).alias("head"), F.col("node").alias("parent"),
                          (F.col("depth") + F.col("shared") + 1).cast("long").alias("depth"), F.get("bytes", F.col("shared")).alias("last"), F.col("above").alias("up"),
                          rest("ids").alias("ids"), rest("bytes").alias("bytes"), "conv", "n", "ends")
    return marked.filter(F.col("node").isNull()).select(*held.columns), cut(below, "containers")


def _chain_nodes(chains: DataFrame, sums: DataFrame) -> DataFrame:
    """The nodes of burst heads, one per turn that all entries share, with the sums of what lies below."""
    full = chains.join(sums.withColumnRenamed("parent", "node"), "node")
    step = full.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("shared"))))
    own = F.aggregate(F.slice("sizes", F.col("at") + 1, F.size("sizes")), F.lit(0).cast("long"), lambda a, b: a + b) * (F.col("n") - 1)
    last = F.col("at") == F.col("shared")
    return step.select(F.col("conv").alias("conv_id"), (F.col("depth") + F.col("at")).cast("long").alias("depth"),
                       F.when(F.col("at") == 0, F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
                       F.when(last, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
                       (own + F.col("saved")).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
                       F.col("parent").alias("above"), (F.col("at") == 0).alias("top"))


def trie(convs: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """The nodes of all different beginnings of ``convs(conv_id, ids, bytes)``; see ``prefix_trie``."""
    zero = F.lit(0).cast("long")
    held = cut(entries(convs).select(F.lit("").alias("head"), F.lit(None).cast("string").alias("parent"), zero.alias("depth"), zero.alias("last"),
                                     F.lit(None).cast("long").alias("up"), "ids", "bytes", "conv", "n", "ends"), "entries")
    heads, small = [], None
    while not (large := large_containers(held, limit)).isEmpty():
        heads.append(large)
        stay, held = burst(held, large)
        small = stay if small is None else small.unionByName(stay)
    small = held if small is None else small.unionByName(held)
    swept = cut(small.repartition("head").sortWithinPartitions("head", "ids").mapInArrow(_sweep_batches, SWEPT), "swept")
    nodes, tops = swept, swept.filter("above IS NOT NULL").select("above", "n_leaves", "saved_tokens")
    for large in reversed(heads):
        sums = tops.groupBy(F.col("above").alias("node")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        made = cut(_chain_nodes(large, sums), "nodes")
        tops = tops.unionByName(made.filter("top AND above IS NOT NULL").select("above", "n_leaves", "saved_tokens"))
        nodes = nodes.unionByName(made.drop("top"))
    return nodes.select(*NODE)


def prefix_trie(table: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see ``rebuilt``): ``conv_id``, its smallest member; ``depth``;
    ``parent_conv_id``; ``n_convs``, members; ``n_children``; ``n_leaves`` of its subtree; ``saved_tokens``, summed
    over its subtree the bytes of each node's last text times its members but one; ``ends_sha256``, the digest
    of the ids of the conversations that end there.

    Null roles and texts count as empty ones; a null turn comes first; turns of one number go by role and
    text; rows without a conv_id take no part. Repeated rows are turns of their own. A conversation without any
    turn left is a member of the root. An empty table has no rows; other columns are not read.
    """
    return trie(rebuilt(table), limit)


ORACLE = """
WITH RECURSIVE r AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, list({'i': sha256(length(role) || ':' || role || text), 'b': CAST(strlen(text) AS BIGINT)} ORDER BY turn NULLS FIRST, role, text) AS ts
  FROM r GROUP BY conv_id
), h AS (
  SELECT conv_id, ts, CAST(xor(list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
    lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384), CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS BIGINT) AS h
  FROM o
), seq AS (
  SELECT h.conv_id, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts
  FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - ((h.conv_id % 5) + 5) % 5
), key AS (SELECT conv_id, ts, list_transform(ts, lambda t: t.i) AS ids FROM seq),
pre AS (
  SELECT conv_id, d, ids[1:d] AS p, len(ids) = d AS stops, CASE WHEN d = 0 THEN 0 ELSE ts[d].b END AS b
  FROM key, LATERAL (SELECT unnest(range(0, CAST(len(ids) + 1 AS BIGINT))) AS d)
), node AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, any_value(b) AS b,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (stops), '')) AS ends
  FROM pre GROUP BY p, d
), kids AS (SELECT p[1:d - 1] AS up, count(*) AS c FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(c, 0) AS c FROM node LEFT JOIN kids ON kids.up = node.p),
below AS (SELECT p[1:u] AS top, c, (n - 1) * b AS saved FROM full_node, LATERAL (SELECT unnest(range(0, CAST(d + 1 AS BIGINT))) AS u)),
sums AS (SELECT top, count(*) FILTER (c = 0) AS leaves, sum(saved) AS saved FROM below GROUP BY top)
SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n AS n_convs, CAST(x.c AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM full_node x JOIN sums ON sums.top = x.p LEFT JOIN node y ON x.d > 0 AND y.d = x.d - 1 AND y.p = x.p[1:x.d - 1]
"""
