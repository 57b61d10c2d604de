"""Min-max hashing, collocations and the prefix trie against plain Python, on awkward rows and on given ones."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfleet.llm import collocation, minmaxhash, prefixtrie

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
TURNS = "conv_id long, turn long, role string, text string"
CLASH = {"key": "a", "id": 1, "n": 2, "row": 3, "digest": "b", "phrase": "c", "words": 4, "head": "d", "ids": "e", "Root": 5, "shared": 6, "rank": 7}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def clashing(df):
    return df.withColumns({name: F.lit(value) for name, value in CLASH.items() if name.lower() not in {c.lower() for c in df.columns}})


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def variants(rng, base, count, edits):
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(9999)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    base = [f"wort{rng.randrange(300)}" for _ in range(120)]
    rows = [(i, t, "en" if i % 3 else "de") for i, t in enumerate(variants(rng, base, 60, 4))]
    rows += [(100 + i, t, None) for i, t in enumerate(variants(rng, base[:30], 30, 2))]
    rows += [(200, None, "en"), (201, "", "en"), (202, " \t\n", None), (203, "one two", "en"), (204, "One TWO", "fr"), (205, "one two three", "en"),
             (None, rows[0][1], "en"), (None, None, None), (206, "x" * 5000, "en"), (207, ", ".join(["a b"] * 400) + "\x0bé\xa0ü É. b", "und"),
             (3, rows[7][1], "en"), rows[5], rows[5], (208, "\0 \0 a\x00b", "en"), (209, "solo " * 3000, "fr")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- min-max hashing --------------------------------------------------------------------------------

def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {" ".join(words[i:i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def brute_near(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted(repr((i, len(sets[x]), c, i is not None and i == c)) for x, (i, _) in enumerate(rows) for c in [least.get(find(x))])


def got_near(df, **options):
    return sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in minmaxhash.near_duplicates(df, **options).collect())


@pytest.mark.parametrize("table", ["docs", "given"])
@pytest.mark.parametrize("options", [{}, {"bucket": 2, "group": 700, "hot": 2}])
def test_near_duplicates_equal_brute_force(table, options, request):
    df = request.getfixturevalue(table)
    want = brute_near([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert got_near(df, **options) == want


def test_large_groups_lose_no_link(spark):
    """Chains and texts that share a band but not enough shingles, in groups far larger than the limit."""
    rng = random.Random(8)
    words, rows = [f"w{i}" for i in range(150)], []
    for i in range(50):                                    # a chain: each differs a little from the one before
        rows.append((i, " ".join(words)))
        words[rng.randrange(150)] = f"c{i}"
    base = [f"v{i}" for i in range(100)]
    rows += [(100 + i, t) for i, t in enumerate(variants(rng, base, 50, 5))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(rows)
    assert got_near(df) == want
    assert got_near(df, group=300, bucket=1) == want
    assert got_near(df, group=2000, bucket=5) == want


def test_signatures_are_unbiased_and_minmax_varies_less():
    rng = np.random.default_rng(1)
    errors, both, single = [], [], []
    for _ in range(150):
        pool = rng.integers(0, 2**63, 60, dtype=np.uint64)
        a, b = np.unique(pool[:50]), np.unique(pool[5:])
        low, high = minmaxhash.extremes(np.concatenate([a, b]), np.array([0, len(a)]))
        same_low, same_high = low[0] == low[1], high[0] == high[1]
        both.append((same_low.mean() + same_high.mean()) / 2)
        single.append(same_low.mean())
        errors.append(both[-1] - 45 / 60)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(both) < 0.7 * np.var(single)


def test_near_duplicates_of_awkward_tables(spark, docs):
    assert got_near(clashing(docs)) == got_near(docs)
    assert minmaxhash.near_duplicates(docs.limit(0)).collect() == []
    assert got_near(docs.filter("text IS NULL")) == sorted(repr((i, 0, i, i is not None)) for i in (200, None))


# -- collocations -----------------------------------------------------------------------------------

def brute_phrases(rows, least, top, within=100):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 6):
                counts[lang or "und"].update(" ".join(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in counts.items():
        n = sum(f for p, f in c.items() if " " not in p)
        found = {p: f for p, f in c.items() if " " in p and f >= least}
        kept = []
        for p, a in found.items():
            w = p.split(" ")
            score, k = min((1000 * a * n // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k) for k in range(1, len(w)))
            if not any(len(q) > len(p) and f" {p} " in f" {q} " and 100 * f >= within * a for q, f in found.items()):
                kept.append((-score, -a, p.encode(), lang, a, c[" ".join(w[:k])], c[" ".join(w[k:])], n))
        for rank, (score, _, p, *rest) in enumerate(sorted(kept)[:top], 1):
            out.append((rest[0], rank, p.decode(), *rest[1:], -score))
    return sorted(out)


def got_phrases(df, **options):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocation.collocations(df, **options).collect())


@pytest.mark.parametrize("table, least, top, trie", [("docs", 3, 2000, 1 << 19), ("docs", 2, 50, 40), ("given", 5, 300, 200)])
def test_collocations_equal_brute_force(table, least, top, trie, request):
    df = request.getfixturevalue(table)
    rows = [(r["lang"], r["text"]) for r in df.select("lang", "text").collect()]
    want = brute_phrases(rows, least, top)
    assert want and got_phrases(df, least=least, top=top, trie_phrases=trie) == want


def test_longer_phrases_have_to_hold_most_occurrences(docs):
    rows = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    assert got_phrases(docs, least=4, within=60) == brute_phrases(rows, 4, 2000, 60)


def test_scores_are_exact_beyond_64_bits(spark):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    df = spark.createDataFrame([(1, "p q. " * 1000 + "z " * 90_000, "en")], DOCS)
    assert got_phrases(df, words=2)[0][-1] >= 1000 * 1000 * 92_000 // (90_000 * 90_000)
    big = spark.sql("SELECT CAST(400000000000 AS DECIMAL(16,0)) * CAST(9000000000000000 AS DECIMAL(16,0)) * CAST(1000 AS DECIMAL(4,0)) "
                    "div (CAST(3 AS DECIMAL(16,0)) * CAST(700000000000 AS DECIMAL(16,0))) AS s").first()["s"]
    assert big == 400000000000 * 9000000000000000 * 1000 // (3 * 700000000000)


def test_tasks_hand_on_counts_when_they_hold_too_many(monkeypatch):
    texts = [b"a b. c\nd a b " * 50, b"", b"e f " * 200, b"a b c d " * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "x", "y", "x"]), pa.array(texts, pa.binary())], names=["lang", "text"])
    total = lambda: sum((Counter({(a, p): n}) for b in collocation._count_words(iter([batch, batch])) for a, p, n in zip(*(c.to_pylist() for c in b.columns))), Counter())
    whole = total()
    monkeypatch.setattr(collocation, "CHUNK", 16)
    monkeypatch.setattr(collocation, "LOCAL_WORDS", 3)
    assert total() == whole and whole["x", "a"] == 2 * (100 + 30)


def test_tries_accept_their_phrases_and_no_others():
    rng = random.Random(2)
    phrases = sorted({(rng.choice("xy"), " ".join(rng.choice("abcdefghij") for _ in range(3)).encode()) for _ in range(300)})
    trie = collocation.build([lang for lang, _ in phrases], [p for _, p in phrases])
    for lang in "xyz":
        words = [rng.choice("abcdefghijk").encode() for _ in range(2000)]
        at, number = trie.accepting(lang, np.array([trie.codes.get(w, 0) for w in words]))
        assert [phrases[i] for i in number] == [(lang, b" ".join(words[i:i + 3])) for i in at]
        assert list(at) == [i for i in range(1998) if (lang, b" ".join(words[i:i + 3])) in set(phrases)]


@pytest.mark.parametrize("seed", range(6))
def test_every_phrase_of_a_crowded_trie_is_found(seed):
    """Many nodes with many children, so that random places run out and nodes are put behind all others."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60 if seed % 2 else 400)]
    phrases = sorted({(rng.choice("xyz"), f"{rng.choice(words)} {rng.choice(words[:40])}".encode()) for _ in range(6000)})
    trie = collocation.build([lang for lang, _ in phrases], [p for _, p in phrases])
    number = {p: i for i, p in enumerate(phrases)}
    for lang in "xyz":
        mine = [p for la, p in phrases if la == lang]
        codes = np.array([trie.codes[w] for p in mine for w in p.split()])
        at, found = trie.accepting(lang, codes)
        got = dict(zip(at.tolist(), found.tolist()))
        assert all(got[2 * i] == number[lang, p] for i, p in enumerate(mine))


def test_collocations_of_awkward_tables(docs):
    assert got_phrases(clashing(docs), least=3) == got_phrases(docs, least=3)
    assert got_phrases(docs.limit(0)) == [] and got_phrases(docs.filter("text IS NULL")) == [] and got_phrases(docs, least=10**6) == []


# -- prefix trie ------------------------------------------------------------------------------------

def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(t)] for c, t in turns.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members, stops = defaultdict(list), defaultdict(list)
    for c, t in made.items():
        stops[t].append(c)
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = Counter(t[:-1] for t in members if t)
    leaves, saved = Counter(), Counter()
    for t, m in members.items():
        for d in range(len(t) + 1):
            leaves[t[:d]] += not kids[t]
            saved[t[:d]] += (len(m) - 1) * len(t[-1][1].encode()) if t else 0
    return sorted((min(m), len(t), min(members[t[:-1]]) if t else None, len(m), kids[t], leaves[t], saved[t],
                   hashlib.sha256(",".join(map(str, sorted(stops[t]))).encode()).hexdigest()) for t, m in members.items())


def got_trie(df, **options):
    return sorted(tuple(r[c] for c in prefixtrie.NODE) for r in prefixtrie.prefix_trie(df, **options).collect())


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "é so", "", None])) for c in range(60) for t in range(rng.randint(1, 12))]
    rows += [(c, t, "user", f"always {t}") for c in range(100, 160) for t in range(6)]      # one conversation many times
    rows += [(c, t, "user", f"long {t}") for c in (200, 203) for t in range(40)]
    rows += [(7, None, None, "first"), (7, None, "user", None), (301, 0, "user", "x"), (None, 1, "user", "lost"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (-3, 0, "user", "minus")]
    return spark.createDataFrame(rows, TURNS)


@pytest.mark.parametrize("limit", [1, 4, 4096])
def test_trie_equals_brute_force(spark, talks, limit):
    for df in (talks, spark.read.parquet(f"{SF}/conversations.parquet")):
        rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
        assert sorted(map(repr, got_trie(df, limit=limit))) == sorted(map(repr, brute_trie(rows)))


def test_trie_of_awkward_tables(talks):
    assert sorted(map(repr, got_trie(clashing(talks), limit=8))) == sorted(map(repr, got_trie(talks)))
    assert got_trie(talks.limit(0)) == [] and got_trie(talks.filter("conv_id IS NULL")) == []


def test_ids_of_equal_conversations_are_listed_in_ranges(spark, monkeypatch):
    ids = [5, 9, 10, 23, 24, 1000, -7]
    df = spark.createDataFrame([(c, [b"\x01"], [3]) for c in ids] + [(3, [], [])], "conv_id long, ids array<binary>, bytes array<long>")
    monkeypatch.setattr(prefixtrie, "ID_RANGE", 4)
    got = {r["conv"]: (r["n"], r["ends"]) for r in prefixtrie.entries(df).collect()}
    assert got == {-7: (7, hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()), 3: (1, hashlib.sha256(b"3").hexdigest())}
