"""The operators on documents against plain Python, on awkward rows and on the smallest table."""

import base64
import hashlib
import math
import os
import random
import re
import time
import zlib
from fractions import Fraction
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wayfleet.llm import bpe, langid, packing, pii, quality, simhash, tokens
from wayfleet.llm.common import connected

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that operators use inside themselves, and one that differs from another by case only.
CLASHING = ", row string, fp long, start int, base string, found string, score double, Kind string, bin long, keep boolean"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def awkward():
    long = " ".join(f"wort{i % 700}" for i in range(6000))
    return [(1, "hello there my dear friend", "en", "a"), (1, "hello there my dear friend", "en", "a"), (2, "Hello There my dear friend", "en", None),
            (3, None, "en", "a"), (4, "", None, "b"), (None, "jo@x.example.com wrote +1 (437) 555-0689", None, None), (5, None, None, None),
            (6, long, "de", "b"), (7, long + " ende", "de", "b"), (8, "!!! ??? 123 ½ ²", "fr", "c"), (9, "x" * 5000, "fr", "c"),
            (10, "été\u0301 naïve 漢字 <|endoftext|> <s>\t\n\x0b ok", "fr", "c"), (11, "4111 1111 1111 1111, 10.0.0.1, 300.1.1.1", "en", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in awkward()], SCHEMA)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def clashing(df):
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in (c.split() for c in CLASHING.strip(", ").split(", "))})


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# -- SimHash ----------------------------------------------------------------------------------------

def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Component number per fingerprint, by comparing all pairs."""
    f = np.array(prints, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None]) <= simhash.BITS
    label = np.arange(len(f))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("table", ["docs", "given"])
def test_near_duplicates_equal_brute_force(table, request):
    df = request.getfixturevalue(table)
    got = simhash.digest(df).collect()
    source = texts(df)
    prints = [fingerprint(t) for _, t in source]
    label = components(prints)
    least = {}
    for (i, _), c in zip(source, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(repr((i, f"{p:016x}", least.get(c))) for (i, _), p, c in zip(source, prints, label))
    assert sorted(repr((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got) == want


def test_crowded_cells_lose_no_link(spark, monkeypatch):
    """A dense group of fingerprints and chains across it, in cells far larger than the limit."""
    rng = random.Random(3)
    centre, prints = rng.getrandbits(64), set()
    while len(prints) < 400:
        f = centre
        for _ in range(rng.randint(0, 9)):
            f ^= 1 << rng.randrange(64)
        prints.add(f)
    prints |= {rng.getrandbits(64) for _ in range(100)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    label = components([p % (1 << 64) for p in signed])
    whole = simhash.links(df)
    original = simhash.blocks
    monkeypatch.setattr(simhash, "blocks", lambda cells: original(cells, 16))
    for made in (whole, simhash.links(df)):
        root = {r["node"]: r["root"] for r in connected(made).collect()}
        groups = {}
        for p, c in zip(signed, label):
            groups.setdefault(c, set()).add(root.get(p, p))
        assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_large_cells_are_refined_where_that_saves_pairs(spark, monkeypatch):
    """Fingerprints that agree in two bands and are spread elsewhere are refined; those alike everywhere are not."""
    rng = random.Random(5)
    first, second = simhash.bands()[:2]
    near = lambda f, n: {f ^ (1 << rng.randrange(64)) for _ in range(n)}
    base = rng.getrandbits(64)
    spread = {(base & (first | second)) | (rng.getrandbits(64) & ~(first | second)) for _ in range(150)}
    prints = spread | set().union(*(near(f, 2) for f in sorted(spread)[:40])) | near(rng.getrandbits(64), 60)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    original = simhash.blocks
    made = original(simhash.grid_cells(df), 16).toPandas()
    assert (made["sub"] != 0).any() and (made.groupby(["grid", "cell", "sub", "block"]).size() <= 3 * 16).all()
    monkeypatch.setattr(simhash, "blocks", lambda cells: original(cells, 16))
    root = {r["node"]: r["root"] for r in connected(simhash.links(df)).collect()}
    label = components([p % (1 << 64) for p in signed])
    groups = {}
    for p, c in zip(signed, label):
        groups.setdefault(c, set()).add(root.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)
    for a, b in combinations(simhash.bands(), 2):
        assert sum(simhash.finer_bands(a | b)) == (1 << 64) - 1 - (a | b)


def test_bound_never_exceeds_the_hamming_distance():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**63, 2000, dtype=np.uint64) for _ in range(2))
    ea, eb = (f - ((f >> np.uint64(1)) & simhash.LOW) for f in (a, b))
    assert (simhash._manhattan(ea, eb) <= np.bitwise_count(a ^ b)).all()
    assert sum(simhash.bands()) == (1 << 64) - 1


def test_one_document_of_each_group_stays(docs):
    kept = simhash.drop_near_duplicates(docs).collect()
    ids = [r["doc_id"] for r in kept]
    assert len(ids) == len(set(ids)) and 2 not in ids and 3 in ids and not {4, 5} & set(ids)
    assert len(kept) == len(set(components([fingerprint(t) for _, t in texts(docs)])))


# -- packing and tokens -------------------------------------------------------------------------------

@pytest.mark.parametrize("table", ["docs", "given"])
def test_packing_keeps_every_token_once(table, request):
    df = request.getfixturevalue(table)
    got = packing.packed(df).toPandas()
    tokenizer = Tokenizer.from_file(packing.VOCABULARY)
    want = []
    for i, t in texts(df):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, n, at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes())) for n, at in enumerate(range(0, len(ids), 2048))]
    whole = lambda v: None if v != v else int(v)
    assert sorted(map(repr, want)) == sorted(repr(tuple(map(whole, r))) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= 1.02 * got["length"].sum() / 2048 + 1


def test_word_ids_are_those_of_the_library():
    tokenizer, rng = Tokenizer.from_file(packing.VOCABULARY), random.Random(12)
    marks = ["\u0307", "\u030c", "\u0331", "\u0308", "\u030a", "\u0301"]
    pools = [list("abtHJTWYIiKz"), marks, list(" \t\n\x0b\x85\xa0\u2003"), list(".,*#&$%!?;:|\"'"), ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'s", "'LL", "<|"],
             list("İıſẞßÅΣςǅŉẖ漢字あ゙ﬁ½²٣"), [chr(c) for c in (*range(0x80, 0x600), *range(0x1E00, 0x2100))]]
    texts = ["ALİ, a <|endoftext|> b", "ALİ.", "J\u030c,", "", "<|endoftext|>"]
    for _ in range(4000):
        mine = rng.sample(pools, rng.randint(1, 4))
        texts.append("".join(rng.choice(rng.choice(mine)) for _ in range(rng.randint(1, 14))))
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randint(1, 10))) for _ in range(4000)]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(tokens.word_ids(text, packing.VOCABULARY), "<u4").tolist() == want.ids, text


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fills = packing.best_fit(np.array([4, 7, 5, 3, 6]), 10)
    assert fills.tolist() == [10, 10, 5] and bins.tolist() == [1, 0, 2, 0, 1] and offsets.tolist() == [6, 0, 0, 7, 0]


def test_tree_levels_fill_what_partitions_leave(spark):
    rng = random.Random(5)
    lengths = [rng.randint(1, 99) for _ in range(600)]
    items = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECE).repartition(30)
    got = packing.pack(items, 100, fan_in=4, keep=5).toPandas()
    assert sorted(got["length"]) == sorted(lengths) and got.groupby("sequence_id")["length"].sum().max() <= 100
    assert got["sequence_id"].nunique() <= 1.1 * sum(lengths) / 100 + 1


def test_packing_fills_bins_when_lengths_come_in_runs(spark):
    rng = random.Random(6)
    lengths = [rng.randint(1050, 1299) for _ in range(12_000)] + [rng.randint(600, 799) for _ in range(12_000)]
    items = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECE).coalesce(1)
    got = packing.pack(items, keep=500).toPandas()
    assert sorted(got["length"]) == sorted(lengths) and got.groupby("sequence_id")["length"].sum().max() <= 2048
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
    print("sequences", got["sequence_id"].nunique())
    assert got["sequence_id"].nunique() <= 1.02 * 12_000


@pytest.mark.parametrize("table", ["docs", "given"])
def test_byte_bpe_equals_the_library(table, request):
    df = request.getfixturevalue(table)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in texts(df):
        ids = plain.encode_ordinary(t)
        want.append((i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(t.encode())))
    assert rows(bpe.digest(df)) == sorted(map(repr, want))
    assert [bytes(r["data"]).decode() for r in bpe.decoded(bpe.encoded(df.filter("doc_id = 10 AND n_chars < 100"))).collect()] == [
        t for i, t in texts(df.filter("doc_id = 10 AND n_chars < 100"))]


def test_long_texts_are_cut_where_no_token_crosses():
    rng = random.Random(2)
    text = "".join(rng.choice(["a", "word", " ", "  ", "\n", " \n", "'s", "12", "!!", " x", "é", "\u3000"]) for _ in range(5000))
    parts = tokens.safe_parts(text, 50)
    assert len(parts) > 20 and "".join(parts) == text
    one = tokens.byte_bpe(bpe.RANKS).encode_ordinary
    assert [i for p in parts for i in one(p)] == one(text)


# -- personal data ------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def counts(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if n % 2 == 0 else sum(divmod(2 * d, 10)) for n, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if counts(k, m.group())] for k, p in PLAIN.items()}


ODD = ["a@b.c_d@e.f x+1@y.z@w.v..", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.4 0000000000000000000000255.1.1.1", "+1 (2) 3-4567890. 4111 1111-1111 1111 41111111111111111",
       "é 4111111111111111 ü +12345678 𝒳 jo@a.b", "a@b a@b.c@d.e", "+1 +1 +1 234-5678 9+12345678", "....@.a@b..c@d.e", "a.a." * 3000 + "@b" + ".c" * 3000, "1" * 3000, "+1" + " -" * 3000, None, ""]


@pytest.mark.parametrize("table", ["docs", "given", "odd"])
def test_base_spans_equal_plain_patterns(spark, table, request):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string") if table == "odd" else request.getfixturevalue(table)
    want = []
    for i, t in texts(df):
        spans = base_spans(t)
        want.append((i, *(len(spans[k]) for k in pii.KINDS), hashlib.sha256(",".join(sum(spans.values(), [])).encode()).hexdigest()))
    got = pii.digest(df)
    assert rows(got.drop("spans")) == sorted(map(repr, want))
    for i, t in texts(df):
        assert any(set(sum(base_spans(t).values(), [])) <= set(r["spans"].split(",")) | {""} for r in got.filter(F.col("doc_id").eqNullSafe(i)).collect())


def card(seed):
    rng = random.Random(seed)
    while True:
        digits = "".join(rng.choice("0123456789") for _ in range(16))
        if counts("card", digits):
            return digits


def test_trusted_contexts_find_other_identifiers(spark):
    said = [(i, f"hello there my card is number {card(i)} and so on") for i in range(10)]
    other = [(100, "xx my card is number 1234-5678-9012-3 and so on"), (101, "nothing 12 here 999999999999999 ok"), (102, "is number 12 and so")]
    df = spark.createDataFrame(said + other, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(df).collect()}
    assert spans[100] == "card:21:37" and spans[101] == "" and spans[102] == "" and spans[0].startswith("card:30:46")
    masked = {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}
    assert masked[100] == "xx my card is number <CARD> and so on" and masked[0] == "hello there my card is number <CARD> and so on"


def test_rounds_go_on_while_trust_grows(spark):
    """What the first pattern finds teaches a second one, and what that finds, some rounds later, a third."""
    code = lambda n: f"9{n:03d}-{n:04d}-777{n:03d}-{n:02d}"
    said = [f"the card is number {card(i)} and so on" for i in range(40)]
    said += [t for n in range(20) for t in (f"the card is number {code(n)} and so on", f"digits they read {code(n)} out loud")]
    said += [t for n in range(30, 50) for t in (f"digits they read {code(n)} out loud", f"plastic of kind {code(n)} was lost")]
    said += [f"plastic of kind {code(60)} was lost", f"never of any {code(61)} was here"]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    spans = [r["spans"] for r in pii.digest(df).orderBy("doc_id").collect()]
    assert all(s.startswith("card:") for s in spans[:-1]) and spans[-1] == ""


def test_many_matches_in_one_text_take_time_that_grows_with_it(spark):
    text = "10.0.0.1 and 10.2.3.4, " * 10_000
    began = time.monotonic()
    row = pii.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_ip"] == 20_000 and row["base_sha256"] == hashlib.sha256(",".join(base_spans(text)["ip"]).encode()).hexdigest()
    assert time.monotonic() - began < 60
    sizes = spark.createDataFrame([(n, [3] * n) for n in (0, 1, 255, 256, 257, 1000)], "n int, sizes array<int>")
    for r in sizes.select("n", pii._running(F.col("sizes")).alias("sums")).collect():
        assert r["sums"] == [3 * i for i in range(1, r["n"] + 1)]


def test_masking_takes_added_spans_only_beside_base_ones(spark):
    said = [(i, f"my card is number {card(i)} and so on") for i in range(10)]
    df = spark.createDataFrame([*said, (50, "my card is number +12345678-9012 and so on"), (51, "my card is number 1234-5678-9012-3 and so on")], "doc_id long, text string")
    masked = {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}
    assert masked[50] == "my card is number <PHONE> and so on" and masked[51] == "my card is number <CARD> and so on"


def test_masking_leaves_no_base_span(docs):
    kept = {(r["doc_id"], r["text"]) for r in pii.mask(docs).collect()}
    assert (3, None) in kept and (None, "<EMAIL> wrote <PHONE>") in kept and (11, "<CARD>, <IP>, 300.1.1.1") in kept


# -- models ---------------------------------------------------------------------------------------------

def test_forward_pass_sums_all_segmentations():
    path, rng = langid.VOCABULARY, np.random.default_rng(0)
    pieces = {p: n for n, p in enumerate(langid.vocabulary(path))}
    prob = rng.random((len(pieces) + 1, 2))
    prob[-1] = langid.FLOOR

    def total(word, at, column):
        if at == len(word):
            return 1.0
        out = 0.0
        for end in range(at + 1, len(word) + 1):
            n = pieces.get(word[at:end], len(pieces) if end == at + 1 else None)
            out += 0.0 if n is None else prob[n, column] * total(word, end, column)
        return out

    words = ["the", "a", "schön", "漢字x", "tionthe"]
    got = np.exp(langid.word_scores(words, prob, path))
    for w, scores in zip(words, got):
        assert scores == pytest.approx([total(langid.START + w, 0, c) for c in (0, 1)], rel=1e-9)
    long_words = ["tion" * 50, "schön漢" * 30, "x" * 25, "y" * 24]
    for w, scores in zip(long_words, langid.word_scores(long_words, prob, path)):
        for c in (0, 1):
            sums = [Fraction(1)]
            for end in range(1, len(w) + 2):
                parts = [(at, pieces.get((langid.START + w)[at:end], len(pieces) if at == end - 1 else None)) for at in range(max(0, end - 40), end)]
                sums.append(sum((sums[at] * Fraction(prob[n, c]) for at, n in parts if n is not None), Fraction(0)))
            assert scores[c] == pytest.approx(math.log(sums[-1].numerator) - math.log(sums[-1].denominator), rel=1e-12)
    counts, short = rng.random((len(words) + 2, 2)), langid.SHORT
    both = langid.expected_pieces([*words, "x" * 30, "tionthe" * 9], counts, prob, path)
    langid.SHORT = 2
    try:
        assert langid.expected_pieces([*words, "x" * 30, "tionthe" * 9], counts, prob, path) == pytest.approx(both, rel=1e-9, abs=1e-12)
    finally:
        langid.SHORT = short
    expected = langid.expected_pieces(["the"], np.array([[2.0, 0.0]]), prob, path)
    assert expected[:, 1].sum() == 0 and sum(expected[n, 0] * len(p) for p, n in pieces.items()) == pytest.approx(2 * len("▁the"))


def test_languages_are_learned_from_what_is_not_held_out(spark, given):
    got = langid.digest(given).join(given.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_a_rare_language_is_learned_among_many_rows(spark):
    said = lambda ids, lang, text: spark.createDataFrame([(i, text, lang) for i in ids], "doc_id long, text string, lang string")
    rare = [i for i in range(100_000, 100_040) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    many = spark.range(80_000).selectExpr("id AS doc_id", "'the house is green' AS text", "'en' AS lang")
    model = langid.fit(many.unionByName(said(rare, "xx", "zuqo vexi wyka")))
    column = model.probabilities[:-1, model.languages.index("xx")]
    print("largest over smallest probability of the rare language", column.max() / column.min())
    assert model.predict(["zuqo vexi wyka", "the house"])[0] == ["xx", "en"] and column.max() > 2 * column.min()


def test_language_of_awkward_rows(spark, docs, given):
    model = langid.fit(given)
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    assert {(3, "und", 0.0), (4, "und", 0.0), (8, "und", 0.0)} <= got
    kept = {r["doc_id"] for r in langid.keep_identified(docs, model).collect()}
    assert not {3, 4, 5, 8} & kept and {1, 2, 6} <= kept
    none = langid.fit(given.limit(0))
    assert none.languages == [] and {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert {3, 8} & {r["doc_id"] for r in langid.keep_identified(docs, none).collect()} == set()


def test_quality_separates_the_labels(spark, given):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(given, labels)
    got = quality.score(given, model).join(labels, "doc_id").toPandas()
    good, bad = (got[got["quality"] == q]["score"].to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert quality.keep_good(given, model).count() == quality.score(given, model).filter("keep").count()


def test_every_sure_unlabelled_document_teaches(spark, monkeypatch):
    """Of 12,000 unlabelled documents that a view is sure of, all teach the other, at no more weight than labels have."""
    good, bad = "plain words that say something of use", "zzqq zzqq zzqq zzqq zzqq"
    known = [(i, bad if i % 2 else good, "en", "b" if i % 2 else "a", 1) for i in range(200)]
    loose = [(i, bad if i % 2 else good, "en", "b" if i % 2 else "a", 1) for i in range(1000, 13_000)]
    df = spark.createDataFrame(known + loose, SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i, *_ in known], "doc_id long, quality int, toxic int")
    fitted, seen = quality._fitted, []

    def counted(rows, view):
        r = rows.selectExpr("count(*) AS n", "sum(weight) AS w").first()
        seen.append((r["n"], r["w"]))
        return fitted(rows, view)

    monkeypatch.setattr(quality, "_fitted", counted)
    quality.train(df, labels, rounds=1)
    print("rows fitted on", seen)
    assert all(n == seen[0][0] + 12_000 and w <= 1.3 * seen[0][1] + 1e-6 for n, w in seen[2:])


def test_quality_without_labels_has_the_prior(spark, docs):
    labels = lambda made: spark.createDataFrame(made, "doc_id long, quality int, toxic int")
    assert {r["score"] > 0.99 for r in quality.score(docs, quality.train(docs, labels([]))).collect()} == {True}
    one = quality.train(docs, labels([(1, 1, 0), (2, 1, 0), (6, None, 0), (None, 0, 1), (7, 5, 0)]))
    assert one.text is None and {r["keep"] for r in quality.score(docs, one).collect()} == {True}


# -- all of them ------------------------------------------------------------------------------------------

OPERATORS = {
    "pii": lambda df: pii.digest(df), "simhash": lambda df: simhash.digest(df), "packing": lambda df: packing.packed(df).drop("sequence_id", "offset"),
    "bpe": lambda df: bpe.digest(df), "langid": lambda df: langid.digest(df),
    "quality": lambda df: quality.score(df, quality.Model(None, None, 0.0)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_and_empty_tables(docs, name):
    apply = OPERATORS[name]
    assert rows(apply(clashing(docs))) == rows(apply(docs))
    assert apply(docs.limit(0)).count() == 0


def test_pipeline_stages_on_clashing_columns_and_empty_tables(spark, docs):
    wide = clashing(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, SF).columns == wide.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_pipeline_keeps_clean_documents_and_packs_them(spark, given):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs, seen = given, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF).cache()
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    source = dict(texts(given))
    assert len(seen["language identification"]) >= 0.99 * len(source)
    kept = seen["quality classifier"]
    assert np.mean([kept.get(i) is not None for i, q in labels.items() if q == 1]) > 0.97
    assert np.mean([i in kept for i, q in labels.items() if q == 0]) < 0.2
    label = components([fingerprint(source[i]) for i in kept])
    assert len(seen["simhash near-duplicates"]) == len(set(label))
    assert all(not sum(base_spans(t).values(), []) for t in seen["personal data"].values())
    made = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert made.select("doc_id").distinct().count() == len(seen["personal data"])
