"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find well-formed identifiers in every whole text. They are the seeds: the words around
them are lexical patterns, and pattern and instance make up a bipartite graph over the corpus. In each
round a pattern is trusted as far as its instances are, an instance as far as its patterns are.
Instances of the right shape that reach the threshold by patterns with enough trusted instances are
further identifiers; all their occurrences in trusted contexts are reported beside the base ones.

Positions are code points. Splitting a text at a pattern gives what lies between the matches, so the
lengths of gaps and matches add up to the positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfleet.llm.common import cut, row_key, text_or_empty, unused

KINDS = ("email", "ip", "card", "phone")

# The base patterns. A run of characters is never entered in its middle, unless a match ended there,
# and never given back, which finds the same matches in time that grows with the text only.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<!\S)[^\s0-9@+]*+[0-9@+]\S*+"            # a word that might be an identifier of another form
ANY = f"(?:{PATTERNS['email']}|{PATTERNS['ip']}|{PATTERNS['card']}|{PATTERNS['phone']}|{TOKEN})"
TAGS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}

TRUST, SUPPORT = 0.8, 3
GAIN = 1e-3     # rounds end when no trust grows by more
RUN = 256       # lengths that are added up in one go
CONTEXT = 80    # code points on either side in which context words are looked for

SPAN = "array<struct<kind:int,start:int,end:int>>"


def _luhn(digits: Column) -> Column:
    def digit(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + digit(i))
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """Whether a match of the base pattern counts."""
    if kind == "ip":
        small = lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).cast("int") <= 255)
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(small(p), F.lit(False)))
    if kind == "card":
        digits = F.translate(match, " -", "")
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.translate(match, "+ ().-", "")).between(8, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _running(sizes: Column) -> Column:
    """Running sums of an array, runs of ``RUN`` at a time: arrays grow by copying, so a long one is not grown whole."""
    added = lambda xs, first: F.aggregate(xs, first, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x)))
    none = F.array().cast("array<int>")
    runs = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda r: added(F.slice(xs, r * RUN + 1, F.lit(RUN)), none))
    before = lambda sums: added(F.transform(sums, lambda s: F.get(s, F.size(s) - 1)), F.array(F.lit(0)))
    joined = lambda sums: F.flatten(F.zip_with(sums, F.slice(before(sums), F.lit(1), F.size(sums)), lambda s, at: F.transform(s, lambda e: e + at)))
    # The arrays are named by a transform over one of them, as what a lambda refers to is worked out anew each time.
    return F.flatten(F.transform(F.array(sizes), lambda xs: F.when(F.size(xs) == 0, none).otherwise(
        F.flatten(F.transform(F.array(runs(xs)), joined)))))


def _located(text: Column, pattern: str, matches: Column) -> Column:
    """``matches`` with their positions: structs of start, end, text and the gaps on both sides."""
    gaps = F.split(text, pattern, -1)
    before, after = (F.slice(gaps, F.lit(n), F.size(matches)) for n in (1, 2))
    ends = _running(F.zip_with(before, matches, lambda g, m: F.length(g) + F.length(m)))
    return F.transform(F.arrays_zip(matches.alias("m"), ends.alias("e"), before.alias("g"), after.alias("h")),
                       lambda x: F.struct((x["e"] - F.length(x["m"])).alias("start"), x["e"].alias("end"), x["m"].alias("m"),
                                          F.right(x["g"], F.lit(CONTEXT)).alias("left"), F.left(x["h"], F.lit(CONTEXT)).alias("right")))


def base_spans(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the base spans of ``text`` by kind, then start."""
    names = {k: unused(df, f"{out}_{k}") for k in KINDS}
    gate = {"email": "@", "phone": "+"}   # most texts have no such character
    df = df.withColumns({names[k]: F.when(F.col(text).contains(gate[k]), _matches(F.col(text), p)) if k in gate else _matches(F.col(text), p)
                         for k, p in PATTERNS.items()})
    empty = F.array().cast(SPAN)
    parts = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        matches = F.col(names[kind])
        good = F.filter(_located(F.col(text), pattern, matches), lambda x: valid(kind, x["m"]))
        spans = F.transform(good, lambda x: F.struct(F.lit(number).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        parts.append(F.when(F.exists(matches, lambda m: valid(kind, m)), spans).otherwise(empty))
    return df.withColumn(out, F.concat(*parts)).drop(*names.values())


def _shapes(match: Column) -> Column:
    """The kinds that an unknown identifier may be of, by its characters."""
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    plain = F.rlike(match, F.lit(r"^[0-9 ().+-]+$"))
    fits = (F.when(match.contains("@"), F.lit("email")), F.when(F.rlike(match, F.lit(r"^[0-9]+[.:][0-9]+[.:][0-9]+[.:][0-9]+$")), F.lit("ip")),
            F.when(plain & digits.between(13, 19), F.lit("card")), F.when(plain & digits.between(7, 15), F.lit("phone")))
    return F.array_compact(F.array(*fits))


def occurrences(docs: DataFrame) -> DataFrame:
    """``(row, kind, instance, seed, start, end, pattern)``: a row per possible identifier, kind and pattern.

    The patterns are the two words before, and the word before with the one behind.
    """
    texts = docs.select(row_key(docs["doc_id"], text_or_empty(docs)).alias("row"), text_or_empty(docs).alias("text"))
    texts = texts.filter(F.rlike("text", F.lit("[0-9@]"))).withColumn("found", _matches(F.col("text"), ANY))
    found = texts.filter(F.size("found") > 0).select("row", F.explode(_located(F.col("text"), ANY, F.col("found"))).alias("x"))
    # A token sheds the punctuation around it.
    core = F.regexp_extract("x.m", r"[0-9A-Za-z(+](?s:.*)[0-9A-Za-z]", 0)
    lead = F.instr("x.m", core) - 1
    found = found.select("row", "x.left", "x.right", core.alias("m"), (F.col("x.start") + lead).alias("start")).filter(F.length("m") > 2)
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(F.rlike("m", F.lit(f"^(?:{pattern})$")) & valid(name, F.col("m")), F.lit(name)).otherwise(kind)
    found = found.withColumn("known", kind).withColumn("kind", F.explode(F.when(F.col("known").isNotNull(), F.array("known")).otherwise(_shapes(F.col("m")))))
    word = lambda text, pattern, none: F.lower(F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit(none)))
    near, far = word(F.col("left"), r"(\S+)\s*$", "^"), word(F.col("left"), r"(\S+)\s+\S+\s*$", "^")
    after = word(F.col("right"), r"^\s*(\S+)", "$")
    instance = F.lower(F.when(F.col("kind") == "email", F.col("m")).otherwise(F.regexp_replace("m", r"[^0-9.:]", "")))
    return found.select("row", "kind", instance.alias("instance"), F.col("known").isNotNull().alias("seed"), "start",
                        (F.col("start") + F.length("m")).alias("end"),
                        F.explode(F.array(F.concat_ws(" ", far, near, F.lit("_")), F.concat_ws(" ", near, F.lit("_"), after))).alias("pattern"))


def discovered(docs: DataFrame, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """``(row, added)``: per document, by ``row_key``, the spans that trusted patterns add.

    A pattern's trust is the sum of its instances' over one more than their number; it extracts only
    with ``support`` trusted instances or more. An instance's trust is one less the chance that all its
    extracting patterns err. Trust never shrinks; rounds go on until none grows by over ``GAIN``. Edges are
    counted once per pattern and instance before they are joined.
    """
    seen = cut(occurrences(docs), "occurrences")
    edges = cut(seen.groupBy("kind", "pattern", "instance").agg(F.max(F.col("seed").cast("double")).alias("trust")), "edges")
    state, gain = edges, 1.0
    while gain > GAIN:
        patterns = state.groupBy("kind", "pattern").agg((F.sum("trust") / (F.count("*") + 1)).alias("confidence"),
                                                        F.sum((F.col("trust") >= trust).cast("int")).alias("trusted"))
        patterns = cut(patterns.filter(F.col("trusted") >= support).select("kind", "pattern", "confidence"), "patterns")
        doubt = F.exp(F.sum(F.log(1 - F.coalesce("confidence", F.lit(0.0)))))
        instances = (edges.join(patterns, ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - doubt).alias("reached")))
        known = state.join(instances, ["kind", "instance"], "left")
        grown = F.greatest("trust", F.coalesce("reached", F.lit(0.0)))
        state = cut(known.select("kind", "pattern", "instance", grown.alias("trust"), (grown - F.col("trust")).alias("gain")), "edges")
        gain = state.agg(F.max("gain")).first()[0] or 0.0
    good = state.groupBy("kind", "instance").agg(F.max("trust").alias("trust")).filter(F.col("trust") >= trust).select("kind", "instance")
    new = seen.filter("NOT seed").join(patterns.filter(F.col("confidence") >= trust), ["kind", "pattern"]).join(good, ["kind", "instance"])
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    return new.groupBy("row").agg(F.collect_set(F.struct(number.alias("kind"), F.col("start").cast("int").alias("start"),
                                                         F.col("end").cast("int").alias("end"))).alias("added"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _apart(added: Column, base: Column) -> Column:
    """The added spans that overlap neither a base span nor an earlier added one."""
    clear = F.array_sort(F.filter(added, lambda a: ~F.exists(base, lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]))))
    by_place = F.array_sort(F.transform(clear, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("kept"))
    return F.aggregate(by_place, first, lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(
        acc["kept"], F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"])


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, spans)`` per row: base spans, and all spans with those that the corpus adds.

    Spans are structs of kind (a number into ``KINDS``), start and end, by kind, then start. A null text
    counts as empty. Rows alike in id and text get the same spans; null ids stay null. No rows give no
    rows; other columns are not read.
    """
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs["doc_id"], text_or_empty(docs)).alias("row"),
                         text_or_empty(docs).alias("text"))
    based = base_spans(narrow, "text", "base").select("doc_id", "row", "base")
    joined = based.join(discovered(docs), "row", "left")
    added = F.when(F.col("added").isNull(), F.array().cast(SPAN)).otherwise(_apart(F.col("added"), F.col("base")))
    return joined.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the number of base spans by kind, their digest, and all spans as text."""
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return find(docs).select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _masked(text: Column, kind: str, pattern: str) -> Column:
    matches = _matches(text, pattern)
    gaps = F.split(text, pattern, -1)
    shown = F.transform(matches, lambda m: F.when(valid(kind, m), F.lit(TAGS[kind])).otherwise(m))
    pieces = F.zip_with(gaps, shown, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return F.when(F.exists(matches, lambda m: valid(kind, m)), F.array_join(pieces, "")).otherwise(text)


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with a tag in place of every identifier; a null text stays null, other columns as they are.

    Added spans are those of ``find``. They are taken out first, where they were found, from the last to the
    first, so that the positions before them still hold.
    """
    row, found, base, searched = (unused(docs, name) for name in ("row", "found", "base", "searched"))
    keyed = docs.withColumn(row, row_key(docs["doc_id"], text_or_empty(docs)))
    joined = keyed.join(discovered(docs).select(F.col("row").alias(row), F.col("added").alias(found)), row, "left")
    tags = F.array(*[F.lit(TAGS[k]) for k in KINDS])
    joined = base_spans(joined.withColumn(searched, F.when(F.col(found).isNotNull(), F.col("text"))), searched, base)
    by_place = F.array_sort(F.transform(_apart(F.col(found), F.col(base)),
                                        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    out = F.when(F.col(found).isNull(), F.col("text")).otherwise(
        F.aggregate(F.reverse(by_place), F.col("text"), lambda acc, s: F.concat(
            F.substr(acc, F.lit(1), s["start"]), F.get(tags, s["kind"]), F.substr(acc, s["end"] + 1))))
    joined = joined.withColumn("text", out)
    for kind, pattern in PATTERNS.items():
        joined = joined.withColumn("text", _masked(F.col("text"), kind, pattern))
    return joined.select(*docs.columns)
