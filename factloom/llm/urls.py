"""URL filters: rules, then trust and distrust spread over the graph of hosts.

A url takes the verdict of the longest rule that fits. Hosts of allowed urls
seed trust, hosts of blocked urls distrust. Trust is a personalised PageRank
along links; distrust one along reversed links, since a page answers for what it
links to. Links are gathered per pair of hosts before anything else, so the graph
has one row per pair, and each round is two joins and two sums by host. Ranks
are divided among all hosts, so they do not decide. A host is blocked when its
distrusted share, the chance that a walk along its links meets a blocked host, is
above a threshold and above its trusted share, the same chance for allowed hosts
along reversed links; neither depends on how many other hosts do as it does.

The list of rules is a parameter and part of the query; it is not meant for
millions of rules.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule, has no links and is allowed; null html has no links; repeated rows
are judged alike and count as links each; links to the own host do not count;
without seeds or links (or in an empty table) nothing spreads; other columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fixed

#: Share that follows links; rounds at most, more than the tolerance can need (2 * 0.85**90 < 1e-6); change at which rounds end.
DAMPING, ROUNDS, TOLERANCE = 0.85, 100, 1e-6
#: Distrusted share that blocks; 1 is a host whose urls are all blocked.
THRESHOLD = 0.5
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)


def lowered(column: Column) -> Column:
    return F.translate(column, ascii_uppercase, ascii_lowercase)


def host_and_path(url: str) -> tuple[Column, Column]:
    filled = F.coalesce(F.col(url), F.lit(""))
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return lowered(F.regexp_extract(filled, form, 1)), F.regexp_extract(filled, form, 2)


def fitting(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n) from pages with ``host`` and ``html``, one row per pair of different hosts."""
    targets = F.explode(F.regexp_extract_all("html", F.lit(LINK), 1))
    return (
        pages.where("host <> ''").select(F.col("host").alias("src"), targets.alias("dst"))
        .select("src", lowered(F.col("dst")).alias("dst")).where("src <> dst and dst <> ''")
        .groupBy("src", "dst").agg(F.count("*").alias("n"))
    )


def spread(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, rank): personalised PageRank of seeds (host, seed) along links (src, dst, n).

    Seeds sum to 1. What hosts without links hold goes back to the seeds.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    shares = fixed(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")))
    ranks = fixed(seeds.select("host", F.col("seed").alias("rank")))
    for _ in range(rounds):
        sent = (
            shares.join(ranks, shares.src == ranks.host)
            .groupBy("dst").agg((DAMPING * F.sum(F.col("rank") * F.col("share"))).alias("got"))
        )
        moved = sent.agg(F.sum("got")).first()[0] or 0.0
        following = seeds.join(sent, seeds.host == sent.dst, "full").select(
            F.coalesce("host", "dst").alias("host"),
            (F.coalesce("got", F.lit(0.0)) + F.coalesce("seed", F.lit(0.0)) * (1 - moved)).alias("rank"),
        )
        following = fixed(following)
        old = ranks.select("host", F.col("rank").alias("old"))
        change = following.join(old, "host", "full").agg(
            F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))
        ).first()[0]
        ranks = following
        if (change or 0.0) < TOLERANCE:
            break
    return ranks


def reach(links: DataFrame, marks: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, reach): chance that a walk from the host along links (src, dst, n) meets marks (host, mark).

    The walk stops at a host with the chance ``mark`` and goes on from it with
    ``DAMPING``; hosts that are left out have 0.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    shares = fixed(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")))
    met = marks.select("host", F.col("mark").alias("reach"))
    for _ in range(rounds):
        ahead = (
            shares.join(met, shares.dst == met.host)
            .groupBy("src").agg((DAMPING * F.sum(F.col("reach") * F.col("share"))).alias("ahead"))
        )
        mark = F.coalesce("mark", F.lit(0.0))
        following = fixed(marks.join(ahead, marks.host == ahead.src, "full").select(
            F.coalesce("host", "src").alias("host"), (mark + (1 - mark) * F.coalesce("ahead", F.lit(0.0))).alias("reach"),
        ))
        old = met.select("host", F.col("reach").alias("old"))
        change = following.join(old, "host", "left").agg(F.max(F.col("reach") - F.coalesce("old", F.lit(0.0)))).first()[0]
        met = following
        if (change or 0.0) < TOLERANCE:
            break
    return met


def seeds(hosts: DataFrame, column: str) -> DataFrame:
    """(host, seed) from hosts with a weight, summing to 1."""
    chosen = hosts.where(F.col(column) > 0).select("host", F.col(column).alias("w"))
    return chosen.select("host", (F.col("w") / chosen.agg(F.sum("w").alias("w")).scalar()).alias("seed"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust, trusted_share and distrusted_share of every page."""
    host, path = host_and_path("url")
    parsed = pages.select(
        F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")
    ).withColumns({"host": host, "path": path})
    rule, ruled = fitting(rules, F.col("host"), F.col("path"))
    judged = parsed.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))
    links = fixed(host_links(parsed))
    hosts = fixed(
        judged.where("host <> ''").groupBy("host").agg(
            F.avg((F.coalesce("ruled", F.lit("")) == "allow").cast("int")).alias("good"),
            F.avg((F.coalesce("ruled", F.lit("")) == "block").cast("int")).alias("bad"),
        )
    )
    trust = spread(links, fixed(seeds(hosts, "good"))).withColumnRenamed("rank", "trust")
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = spread(back, fixed(seeds(hosts, "bad"))).withColumnRenamed("rank", "distrust")
    marked = lambda column: fixed(hosts.where(F.col(column) > 0).select("host", F.col(column).alias("mark")))
    trusted = reach(back, marked("good")).withColumnRenamed("reach", "trusted_share")
    distrusted = reach(links, marked("bad")).withColumnRenamed("reach", "distrusted_share")
    figures = ["trust", "distrust", "trusted_share", "distrusted_share"]
    known = hosts.select("host")
    for found in (trust, distrust, trusted, distrusted):
        known = known.join(found, "host", "left")
    # Fixed, so that both sides of the join with the pages come straight from a shuffle and hot hosts are split.
    known = fixed(known.select("host", *(F.coalesce(x, F.lit(0.0)).alias(x) for x in figures)))
    found = judged.join(known, "host", "left").withColumns({x: F.coalesce(x, F.lit(0.0)) for x in figures})
    bad = F.col("distrusted_share")
    by_graph = F.when((bad > THRESHOLD) & (bad > F.col("trusted_share")), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_graph).alias("verdict"), *figures)
