"""URL verdicts from rules and from trust that flows over host links, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written

SALTS = 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str  # starts with /


#: The rules of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_and_path(url):
    """After the first ://, up to /, ? or #, A-Z lower-cased; and what follows up to ? or #. Both are empty for null and for urls without ://."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format("url"))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """pages (page_id, url, ...) with host, path, and the longest fitting rule and its verdict, or nulls. A rule fits its host and all subdomains."""
    host, path = host_and_path(F.col("url"))
    pages = pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))

    def fits(rule):
        return ((F.col("host") == rule.host) | F.endswith("host", F.lit("." + rule.host))) & F.startswith("path", F.lit(rule.path))

    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):  # the longest is asked first
        found = F.when(fits(r), F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return pages.withColumn("_found", found).withColumn("rule", F.col("_found.rule")).withColumn("_verdict", F.col("_found.verdict")).drop("_found")


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst: pairs of different hosts of which one links to the other; from absolute and //host links in html."""
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), F.lit(1))
    pairs = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(targets)).alias("dst"))
    return pairs.select("src", F.translate("dst", UPPER, UPPER.lower()).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").distinct()


def spread(seeds: DataFrame, edges: DataFrame, damping: float, rounds: int | None, least: float) -> DataFrame:
    """Personalised PageRank: host, rank, where rank = (1 - damping) * seed + damping * what the hosts that point here pass on, in equal shares.

    seeds: host, seed (0 to 1, not null). edges: src, dst, distinct. Rounds end when no host changes by more than least. As all changes
    together shrink by damping each round, that comes after a number of rounds which the sum of seeds gives; rounds sets another bound, and
    ranks that still change then are an error. Each round is written to the checkpoint folder, so plans stay short; what hosts pass on, their seeds and their last ranks meet in one aggregation. A host with very many links is dealt to SALTS tasks by its targets.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("degree")).withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    dealt = cut(edges.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int")).join(degree, ["src", "salt"]))
    base = seeds.select("host", ((1 - damping) * F.col("seed")).alias("seed"))
    rank = base.select("host", F.col("seed").alias("rank"))
    if dealt.isEmpty():
        return rank
    if rounds is None:
        total = base.agg(F.sum("seed")).first()[0] or 0.0
        rounds = 2 + max(0, math.ceil(math.log(least / max(total, least)) / math.log(damping)))
    for _ in range(rounds):
        sent = rank.where("rank > 0").withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS))))).withColumnRenamed("host", "src")
        got = dealt.join(sent, ["src", "salt"]).select(F.col("dst").alias("host"), (damping * F.col("rank") / F.col("degree")).alias("rank"), F.lit(0.0).alias("_old"))
        parts = got.union(base.select("host", "seed", F.lit(0.0))).union(rank.select("host", F.lit(0.0), "rank"))
        new = written(parts.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("_old").alias("_old")))
        change = new.agg(F.max(F.abs(F.col("rank") - F.col("_old")))).first()[0] or 0.0
        rank = new.select("host", "rank")
        if change <= least:
            return rank
    raise RuntimeError(f"ranks still change by {change} after {rounds} rounds")


def host_scores(pages: DataFrame, damping: float = 0.85, rounds: int | None = None, least: float = 1e-6) -> DataFrame:
    """host, trust and distrust of each host of judged pages, and of hosts they link to.

    A host's seed of trust is the share of its pages that a rule allows, of distrust the share that a rule blocks. Trust follows
    links; distrust follows them backwards, from what is linked to what links there.
    """
    edges = cut(host_links(pages))
    share = {v: F.avg(F.when(F.col("_verdict") == v, 1.0).otherwise(0.0)).alias(v) for v in ("allow", "block")}
    hosts = cut(pages.where("host <> ''").groupBy("host").agg(*share.values()))
    trust = spread(hosts.select("host", F.col("allow").alias("seed")), edges, damping, rounds, least)
    distrust = spread(hosts.select("host", F.col("block").alias("seed")), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), damping, rounds, least)
    return trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = 0.75, damping: float = 0.85) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each page.

    Where no rule fits, a host is blocked if its distrust is at least threshold of its trust and distrust together, and at least what a host has by
    itself of whose pages rules block one half. So hosts that little is known about, and pages without a host, are allowed. A host with a large share of all pages is dealt to SALTS tasks.
    Null urls have no host; null html has no links; urls and html are read whole, however long; repeated rows are judged alike. No rows: no rows.
    """
    own = judged(pages.select("page_id", "url", "html"), rules)
    scores = host_scores(own.select("host", "_verdict", "html"), damping).withColumn("_salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    bare = own.select("page_id", "host", "path", "rule", "_verdict", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("_salt"))
    known = bare.join(scores, ["host", "_salt"], "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    bad = (distrust >= (1 - damping) / 2) & (distrust >= threshold * (trust + distrust))
    return known.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
