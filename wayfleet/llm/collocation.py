"""Phrase collocation mining with tries of candidates.

Phrases are counted level by level. A phrase of k words can only be frequent if its first and its last
k - 1 words are, so level k looks at no others: the frequent phrases of k - 1 words are laid out as
double-array tries and broadcast, numpy moves the states of all text positions through a trie at once,
one word at a time, and a position that ends in an accepting state, whose next word keeps the last
k - 1 words possibly frequent, is an occurrence of a candidate. Occurrences are counted per task, by
accepting state and next word, and the tasks' counts are summed by Spark.

What is broadcast is bounded whatever the input: a trie holds at most ``TRIE_PHRASES`` phrases, more of
them take further passes over the text; the check of the last words is a bit table of ``FILTER_BITS``
bits, which lets a few too many through, never too few.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfleet.llm.common import cut, text_or_empty
from wayfleet.operators.scale import lookup_join, may_broadcast

WORDS, LEAST, TOP, WITHIN = 5, 100, 2000, 100
UNKNOWN = "und"
TRIE_PHRASES = 1 << 19
FILTER_BITS = 1 << 26
CHUNK = 1 << 22           # bytes of text that are split into words at a time
LOCAL_WORDS = 1 << 20     # different words that a task numbers before it hands on its counts
LOCAL_COUNTS = 1 << 21    # counts that a task keeps before it merges them
OUT_ROWS = 1 << 16
TRIES = 8                 # rounds of random places, and places of a round, that a node's children are tried at
EMPTY, EDGE = 0, 1        # numbers of the empty word and of a border between pieces
SEPARATORS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
SPREAD = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "lang string, phrase string, n long"


# -- words of a task --------------------------------------------------------------------------------

class Words(dict):
    """Numbers of a task's words, in order of appearance, with their hashes."""

    def __init__(self):
        super().__init__({b"": EMPTY, b"\n": EDGE})
        self.seen = [b"", b"\n"]
        self.hashed = np.zeros(2, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.seen)
        self.seen.append(word)
        return n

    def number(self, data: bytes) -> np.ndarray:
        """Numbers of the words of ``data``, with an ``EDGE`` between pieces."""
        tokens = data.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))
        return ids[ids != EMPTY]

    def hashes(self) -> np.ndarray:
        new = [xxhash.xxh64_intdigest(w) for w in self.seen[len(self.hashed):]]
        self.hashed = np.concatenate([self.hashed, np.array(new, np.uint64)])
        return self.hashed


def _parts(data: bytes) -> Iterator[bytes]:
    """A text in parts of about ``CHUNK`` bytes, cut between pieces only."""
    at = 0
    while len(data) - at > CHUNK:
        end = data.rfind(b"\n", at + 1, at + CHUNK)
        end = data.find(b"\n", at + CHUNK) if end < 0 else end
        if end < 0:
            break
        yield data[at:end]
        at = end + 1
    yield data[at:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """``(lang, text)``: the texts of a batch, those of a language together, a border between any two."""
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            held, size = [], 0
            for part in (p for t in texts for p in _parts(t.lower().translate(SEPARATORS))):
                held.append(part)
                size += len(part)
                if size >= CHUNK:
                    yield lang, b"\n".join(held)
                    held, size = [], 0
            yield lang, b"\n".join(held)


def _out(langs: pa.Array, phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(counts), OUT_ROWS):
        yield pa.RecordBatch.from_arrays([langs[i:i + OUT_ROWS], phrases[i:i + OUT_ROWS].cast(pa.string()), pa.array(counts[i:i + OUT_ROWS], pa.int64())],
                                         names=["lang", "phrase", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, totals = Words(), {}

    def flush():
        seen = pa.array(words.seen, pa.binary())
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            at = at[at > EDGE]
            yield from _out(pa.array([lang], pa.string()).take(pa.array(np.zeros(len(at), np.int32))), seen.take(pa.array(at)), total[at])

    for lang, data in _chunks(batches):
        got = np.bincount(words.number(data), minlength=len(words))
        total = totals.get(lang, np.zeros(0, np.int64))
        got[:len(total)] += total
        totals[lang] = got
        if len(words) > LOCAL_WORDS:
            yield from flush()
            words, totals = Words(), {}
    yield from flush()


# -- double-array tries -----------------------------------------------------------------------------

@dataclass
class Trie:
    """Phrases of one length as a double array. From state s a word of code c leads to base[s] + c, if check there is s."""

    width: int
    starts: dict[str, int]     # language -> state before the first word
    codes: dict[bytes, int]    # word -> code, from 1
    base: np.ndarray
    check: np.ndarray
    phrase_of: np.ndarray      # state -> phrase number, -1 if it does not accept
    langs: pa.Array
    phrases: pa.Array

    def accepting(self, lang: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a phrase of the trie begins, and its number; code 0 is a word of no phrase."""
        start = self.starts.get(lang)
        at = np.flatnonzero(codes) if start is not None else np.zeros(0, np.int64)
        state = np.full(len(at), start or 0, np.int64)
        for step in range(self.width):
            inside = at + step < len(codes)
            at, state = at[inside], state[inside]
            code = codes[at + step]
            after = self.base[state] + code
            alive = (code > 0) & (self.check[after] == state)
            at, state = at[alive], after[alive]
        return at, self.phrase_of[state]


def build(langs: list[str], phrases: list[bytes]) -> Trie:
    """Lay out ``phrases``, all of as many words: nodes of one child go to the first free slot, the others,
    those of most children first, to one of some random places, or behind all if none of those fits."""
    split = [p.split(b" ") for p in phrases]
    codes = {w: i + 1 for i, (w, _) in enumerate(Counter(w for p in split for w in p).most_common())}
    names = {lang: len(codes) + 1 + i for i, lang in enumerate(sorted(set(langs)))}
    children: list[dict[int, int]] = [{}]      # node -> code -> node
    last = []
    for lang, words in zip(langs, split):
        node = 0
        for code in (names[lang], *(codes[w] for w in words)):
            node = children[node].setdefault(code, len(children))
            if node == len(children):
                children.append({})
        last.append(node)
    widest = len(codes) + len(names) + 1
    top = widest + 2 * len(children)           # places below it are tried first; slots below ``widest`` stay free of bases
    used, base, check = np.zeros(2 * top + widest, bool), np.zeros(2 * top + widest, np.int64), np.full(2 * top + widest, -1, np.int64)
    used[:widest] = True
    state, free, end, level, rng = {0: 0}, widest, widest, [0], np.random.default_rng(0)
    while level:
        level.sort(key=lambda n: -len(children[n]))
        for node in level:
            if not children[node]:
                continue
            want = np.array(sorted(children[node]))
            if len(want) == 1:                 # any free slot will do
                while used[free]:
                    free += 1
                begin = free - want[0]
            else:
                for _ in range(TRIES):
                    begins = rng.integers(widest, top, TRIES) - want[0]
                    fits = ~used[begins[:, None] + want].any(axis=1)
                    if fits.any():
                        begin = begins[fits.argmax()]
                        break
                else:
                    begin = end - want[0]      # nothing lies from ``end`` on
                    top = max(top, int(begin + want[-1]) + 1)
            end = max(end, int(begin + want[-1]) + 1)
            if max(end, top) + widest >= len(used):
                more = len(used)
                used, base, check = np.r_[used, np.zeros(more, bool)], np.r_[base, np.zeros(more, np.int64)], np.r_[check, np.full(more, -1)]
            own = state[node]
            base[own] = begin
            used[begin + want] = True
            check[begin + want] = own
            for code, child in children[node].items():
                state[child] = int(begin + code)
        level = [c for n in level for c in children[n].values()]
    size = max(state.values()) + widest + 1
    phrase_of = np.full(size, -1, np.int64)
    phrase_of[[state[n] for n in last]] = np.arange(len(last))
    return Trie(len(split[0]), {lang: state[children[0][c]] for lang, c in names.items()}, codes, base[:size],
                np.r_[check, np.full(max(0, size - len(check)), -1)][:size], phrase_of, pa.array(langs, pa.string()), pa.array(phrases, pa.binary()))


# -- the check of a phrase's last words --------------------------------------------------------------

def _slots(lang: np.ndarray | int, words: list[np.ndarray]) -> np.ndarray:
    """Place of a phrase in the bit table, from the hashes of its language and words."""
    mixed = lang
    for h in words:
        mixed = (mixed ^ h) * SPREAD
        mixed = mixed ^ (mixed >> np.uint64(29))
    return (mixed * SPREAD) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)


def _slot_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array([xxhash.xxh64_intdigest(x) for x in batch.column("lang").to_pylist()], np.uint64)
        split = [p.encode().split(b" ") for p in batch.column("phrase").to_pylist()]
        words = [np.array([xxhash.xxh64_intdigest(w) for w in level], np.uint64) for level in zip(*split)]
        slots = _slots(langs, words) if split else np.zeros(0, np.uint64)
        bits = (np.uint64(1) << (slots & np.uint64(63))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int64)), pa.array(bits)], names=["place", "bits"])


def bit_table(frequent: DataFrame) -> np.ndarray:
    """The table of phrases that may be frequent: ``FILTER_BITS`` bits, put together by Spark."""
    bits = frequent.select("lang", "phrase").mapInArrow(_slot_batches, "place long, bits long")
    rows = bits.groupBy("place").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[rows["place"].to_numpy()] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return table


# -- counting a level -------------------------------------------------------------------------------

def _merged(kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in kept]), len(keys)).astype(np.int64)


def _count_extended(shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the candidates that extend the trie's phrases by a word: the phrase's number and the word's
    code as one key; a word that is in none of the trie's phrases is spelled out."""
    trie, table = shared.value
    words, codes = Words(), np.zeros(0, np.int64)
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        if kept:
            keys, counts = _merged(kept)
            code = codes[keys & 0xFFFFFFFF]
            spelled = pa.array(words.seen, pa.binary()).take(pa.array(keys & 0xFFFFFFFF, mask=code > 0)).cast(pa.string())
            keys = keys >> 32 << 32 | code
            for i in range(0, len(keys), OUT_ROWS):
                part = slice(i, i + OUT_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part]), spelled[part], pa.array(counts[part])], names=["key", "word", "n"])

    for lang, data in _chunks(batches):
        ids = words.number(data)
        codes = np.concatenate([codes, np.array([trie.codes.get(w, 0) for w in words.seen[len(codes):]], np.int64)])
        at, phrase = trie.accepting(lang, codes[ids])
        inside = at + trie.width < len(ids)
        at, phrase = at[inside], phrase[inside]
        inside = ids[at + trie.width] != EDGE
        at, phrase = at[inside], phrase[inside]
        hashes = words.hashes()
        slot = _slots(np.uint64(xxhash.xxh64_intdigest(lang)), [hashes[ids[at + 1 + j]] for j in range(trie.width)])
        may = (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
        keys, counts = np.unique(phrase[may] << 32 | ids[at[may] + trie.width], return_counts=True)
        if len(keys):
            kept.append((keys, counts))
        if len(kept) > 1 and sum(len(k) for k, _ in kept) > LOCAL_COUNTS:
            kept = [_merged(kept)]
        if len(words) > LOCAL_WORDS or sum(len(k) for k, _ in kept) > 2 * LOCAL_COUNTS:
            yield from flush()
            words, codes, kept = Words(), np.zeros(0, np.int64), []
    yield from flush()


def _spell(shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted candidates as phrases again."""
    trie, _ = shared.value
    by_code = pa.array([b"", *trie.codes], pa.binary())
    for batch in batches:
        keys = batch.column("key").to_numpy()
        phrase, code = pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF)
        word = pc.coalesce(batch.column("word").cast(pa.binary()), by_code.take(code))
        yield from _out(trie.langs.take(phrase), pc.binary_join_element_wise(trie.phrases.take(phrase), word, b" "), batch.column("n").to_numpy())


def extended(texts: DataFrame, frequent: DataFrame, least: int, trie_phrases: int = TRIE_PHRASES) -> DataFrame:
    """The frequent phrases that are a word longer than those of ``frequent``, with their counts."""
    context = texts.sparkSession.sparkContext
    shards = -(-frequent.count() // trie_phrases)
    table, found = bit_table(frequent), []
    dealt = frequent.withColumn("shard", F.pmod(F.xxhash64("lang", "phrase"), F.lit(max(1, shards))))
    for shard in range(shards):
        held = dealt.filter(F.col("shard") == shard).select("lang", "phrase").toPandas()
        if not len(held):
            continue
        shared = context.broadcast((build(list(held["lang"]), [p.encode() for p in held["phrase"]]), table))
        counts = texts.mapInArrow(partial(_count_extended, shared), "key long, word string, n long").groupBy("key", "word").agg(F.sum("n").alias("n"))
        found.append(cut(counts.filter(F.col("n") >= least).mapInArrow(partial(_spell, shared), COUNTS), "phrases"))
        shared.unpersist()
    out = found[0] if found else frequent.limit(0)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# -- the operator -----------------------------------------------------------------------------------

def phrase_counts(docs: DataFrame, words: int = WORDS, least: int = LEAST, trie_phrases: int = TRIE_PHRASES) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, n, words)`` of all phrases of up to ``words`` words that occur ``least`` times, and ``(lang, n)``: all words."""
    texts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty(docs).cast("binary").alias("text"))
    counted = cut(texts.mapInArrow(_count_words, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    level = cut(counted.filter(F.col("n") >= least), "phrases")
    levels = [level.withColumn("words", F.lit(1))]
    for k in range(2, words + 1):
        level = extended(texts, level, least, trie_phrases)
        if level.isEmpty():
            break
        levels.append(level.withColumn("words", F.lit(k)))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return cut(out, "frequent"), cut(totals, "totals")


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, top: int = TOP, within: int = WITHIN,
                 trie_phrases: int = TRIE_PHRASES) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` best phrases of each language.

    A phrase of 2 to ``words`` words that occurs ``a >= least`` times scores floor(1000 a n / (l r)) at the cut
    where that is lowest, the first such, l and r being how often its parts occur and n all words of the
    language. It is dropped if a longer one that holds it occurs at least ``within`` per cent as often;
    it is enough to look at phrases one word longer, as those in between occur at least as often.

    Null texts are empty, a null language is ``und``. Repeated rows count as often as they are there. Ties
    go to the higher count, then to the smaller phrase by bytes. No frequent phrase gives no rows; other
    columns are not read.
    """
    frequent, totals = phrase_counts(docs, words, least, trie_phrases)
    small = may_broadcast(frequent)
    known = lambda phrase, n: frequent.select("lang", F.col("phrase").alias(phrase), F.col("n").alias(n))
    candidates = frequent.filter(F.col("words") > 1).withColumnRenamed("n", "a").withColumn("split", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", "a", "split", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("split", F.lit(1), F.col("k"))).alias("first"),
                       F.concat_ws(" ", F.slice("split", F.col("k") + 1, F.col("words") - F.col("k"))).alias("rest"))
    cuts = lookup_join(lookup_join(cuts, known("first", "l"), ["lang", "first"], "inner", small), known("rest", "r"), ["lang", "rest"], "inner", small)
    cuts = lookup_join(cuts, totals, ["lang"], "inner")
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    cuts = cuts.withColumns({"above": (exact("a") * exact("n") * F.lit(1000).cast("decimal(4,0)")), "below": exact("l") * exact("r")})
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("best"))
    ends = F.array(F.concat_ws(" ", F.slice("split", F.lit(1), F.col("words") - 1)), F.concat_ws(" ", F.slice("split", F.lit(2), F.col("words") - 1)))
    holders = (candidates.filter(F.col("words") > 2).select("lang", F.explode(ends).alias("phrase"), "a")
                         .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    left = best.join(holders, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < within * F.col("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = (left.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
                  .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top))
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM t),
g AS (
  SELECT lang, m, unnest(list_transform(range(1, CAST(len(ws) - m + 2 AS BIGINT)), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(ws) >= m
), c AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE m >= 2 AND f >= 100),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM cand),
scored AS (
  SELECT x.lang, x.m, x.phrase, x.a, x.k, p.f AS l, q.f AS r, total.n,
         (CAST(1000 AS HUGEINT) * x.a * total.n) // (CAST(p.f AS HUGEINT) * q.f) AS score
  FROM cuts x JOIN total USING (lang)
  JOIN c p ON p.lang = x.lang AND p.phrase = array_to_string(x.ws[1:x.k], ' ')
  JOIN c q ON q.lang = x.lang AND q.phrase = array_to_string(x.ws[x.k + 1:], ' ')
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM cand y WHERE y.lang = b.lang AND y.m > b.m AND contains(' ' || y.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * y.a >= 100 * b.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
