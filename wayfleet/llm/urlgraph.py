"""URL filters: rules first, then trust and distrust that spread over the links between hosts.

Hosts with pages that a rule allows are trusted seeds, hosts with pages that a rule blocks are
distrusted seeds, each as far as the share of its pages goes. Personalised PageRank spreads trust
along links and distrust against them: who links to a distrusted host is distrusted himself. A host
whose distrust reaches the threshold and exceeds its trust is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfleet.llm.common import cut

# Fixed rules of the query: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

DAMPING, ROUNDS = 0.85, 8    # rounds after which the change is looked at, again and again
TOLERANCE = 1e-6             # change of all hosts together in a round at which the scores are final
THRESHOLD = 0.5 * (1 - DAMPING)   # what a host of its own keeps if half of its pages are blocked
LINK = r"""(?i)\bhref\s*+=\s*+["']?(?:https?:)?//([^/?#"'\s<>]+)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``(page_id, host, path, rule, by_rule)`` per page."""
    parts = pages.select(pages["page_id"].cast("long").alias("page_id"), host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parts.select("*", rule.alias("rule"), verdict.alias("by_rule"))


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, forth, back)`` per linked pair of different hosts: the share of src's links that go
    to dst, and the share of the links to dst that come from src. Relative links stay on their host."""
    links = pages.select(host_of(pages["url"]).alias("src"),
                         F.explode(F.regexp_extract_all(pages["html"], F.lit(LINK), F.lit(1))).alias("dst"))
    pairs = cut(links.select("src", lower_ascii(F.col("dst")).alias("dst")).filter("src <> '' AND src <> dst")
                     .groupBy("src", "dst").agg(F.count("*").alias("n")), "host_links")
    sent = pairs.groupBy("src").agg(F.sum("n").alias("sent"))
    got = pairs.groupBy("dst").agg(F.sum("n").alias("got"))
    shares = pairs.join(sent, "src").join(got, "dst")
    return cut(shares.select("src", "dst", (F.col("n") / F.col("sent")).alias("forth"), (F.col("n") / F.col("got")).alias("back")), "host_edges")


def host_scores(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, damping: float = DAMPING,
                rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``(host, trust, distrust)`` for every host that has a page or is linked to.

    Rounds go on until all scores together change by no more than ``tolerance``, which every ``rounds``
    rounds are asked for. What is still to come is then at most ``damping / (1 - damping)`` times as much, for
    any host, however many link to it: a round passes on no more than ``damping`` of a change.
    """
    share = lambda verdict: F.avg(F.when(F.col("by_rule") == verdict, 1.0).otherwise(0.0))
    own = (ruled(pages, rules).filter("host <> ''").groupBy("host")
           .agg(share("allow").alias("good"), share("block").alias("bad")))
    edges = host_edges(pages)
    linked = edges.select(F.col("dst").alias("host")).distinct().select("host", F.lit(0.0).alias("good"), F.lit(0.0).alias("bad"))
    seeds = cut(own.unionByName(linked).groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "host_seeds")
    ranks = seeds.select("host", (F.col("good") * (1 - damping)).alias("trust"), (F.col("bad") * (1 - damping)).alias("distrust"))
    if edges.isEmpty():   # nothing spreads
        return ranks
    zero, moved = F.lit(0.0), None
    while moved is None or moved > tolerance:
        for _ in range(rounds):
            onward = edges.join(ranks, edges["src"] == ranks["host"]).select(
                F.col("dst").alias("host"), (F.col("trust") * F.col("forth")).alias("t"), zero.alias("d"), zero.alias("was_t"), zero.alias("was_d"))
            backward = edges.join(ranks, edges["dst"] == ranks["host"]).select(
                F.col("src").alias("host"), zero.alias("t"), (F.col("distrust") * F.col("back")).alias("d"), zero.alias("was_t"), zero.alias("was_d"))
            before = ranks.select("host", zero.alias("t"), zero.alias("d"), F.col("trust").alias("was_t"), F.col("distrust").alias("was_d"))
            sums = [F.sum(c).alias(c) for c in ("t", "d", "was_t", "was_d")]
            came = onward.unionByName(backward).unionByName(before).groupBy("host").agg(*sums)
            mixed = lambda seed, part: F.col(seed) * (1 - damping) + F.col(part) * damping
            stepped = cut(seeds.join(came, "host").select("host", mixed("good", "t").alias("trust"), mixed("bad", "d").alias("distrust"),
                                                          "was_t", "was_d"), "host_ranks")
            ranks = stepped.select("host", "trust", "distrust")
        change = F.abs(F.col("trust") - F.col("was_t")) + F.abs(F.col("distrust") - F.col("was_d"))
        moved = stepped.agg(F.sum(change)).first()[0] or 0.0
    return ranks


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` per row of ``pages(page_id, url, html)``.

    A null url, or one without ``://``, has empty host and path; such a page has no scores and is
    allowed. A null html has no links. Equal rows are judged alike and count as pages each; equal trust
    and distrust allow. No rows give no rows; other columns are not read.
    """
    scores = host_scores(pages, rules)
    blocked = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    own = F.when(F.coalesce(blocked, F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return ruled(pages, rules).join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "trust", "distrust")
