"""URL filters: rules by host and path, and for hosts that no rule speaks of, trust and distrust carried along links.

A rule is an allowed or blocked prefix such as ``example.com/en/``: it fits its host and all subdomains where the URL's
path starts with the rule's, and the longest that fits wins (of equally long ones that of the longer host, then a
blocking one). Rules join the pages by every suffix of the host, so their number isn't limited.

The other pages go by their host. The pages of a host link to other hosts: absolute and scheme-relative ``href``s, counted
by pair of hosts; a host and the domain above it are linked both ways as well (not a top-level domain). Hosts
with allowed pages are seeds of trust, those with blocked pages seeds of distrust, each by their number of such
pages. Trust is personalised PageRank along the links, distrust the same against them: who links to blocked
hosts is distrusted. A host is blocked where its distrust is larger than its trust and at least ``LEAST`` times the mean.

Ranks are whole numbers, ``UNITS`` in all, and every share is cut down to a whole number, so a sum doesn't depend on the
order of its terms and a lost task's repetition gives the same bits. What the cuts and hosts without links
lose goes back to the seeds. Contributions are summed before they are shuffled, and a host with a third of all links is split
by the join's skew handling.

Cases: a null URL, or one without ``://``, has an empty host and path, which fit no rule and link nowhere: allowed. A null or
empty html has no links. Repeated rows are judged alike, and count as links and seeds each. Without pages
the result is empty; without seeds, or without a path from any, every host is allowed. Very long pages are read by
Spark's own expressions, one page at a time. Other columns are not looked at. Names are compared as they are written, with
port and user if there are any, but for A-Z.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import FEW, lower_ascii, stored

#: Rank in all: sums of whole numbers below 2**53 are exact as doubles too.
UNITS = 10**15
DAMPING = 0.85
ROUNDS = 12
#: Distrust of a blocked host, in means over hosts.
LEAST = 1.0
#: What a host and the domain above it pass on to each other, in links.
DOMAIN_LINKS = 1
#: An absolute or scheme-relative link of a page.
HREF = r"""[hH][rR][eE][fF][ \t\n\f\r]*=[ \t\n\f\r]*["']?(?:[hH][tT][tT][pP][sS]?:)?//([^"'<>/?# \t\n\f\r]+)"""


class Rule(NamedTuple):
    """``prefix``: host, then a path that starts with a slash."""

    prefix: str
    allow: bool


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """of_host, of_path, rule, allow."""
    rows = [(h.lower(), f"/{p}", r.prefix, r.allow) for r in rules for h, _, p in (r.prefix.partition("/"),)]
    return spark.createDataFrame(rows, "of_host string, of_path string, rule string, allow boolean")


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (row, host, path, ...) with the longest rule that fits and what it says (null, null for none)."""
    n = rules.limit(FEW + 1).count()
    rules = F.broadcast(rules) if n <= FEW else rules
    near = pages.filter("host != ''").select("row", "path", F.explode(suffixes(F.col("host"))).alias("of_host")).join(rules, "of_host")
    place = F.struct(F.length("rule").alias("long"), F.length("of_host").alias("near"), (~F.col("allow")).alias("strict"), "rule", "allow")
    best = near.filter(F.col("path").startswith(F.col("of_path"))).groupBy("row").agg(F.max(place).alias("best"))
    return pages.join(best, "row", "left").select(*pages.columns, "best.rule", "best.allow")


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links of pages (host, html) between different hosts, and between each host and the domain above it."""
    found = pages.filter("host != ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1))).alias("dst"))
    found = found.withColumn("dst", lower_ascii(F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))
    found = stored(found.filter("src != dst"), "links")
    hosts = pages.select("host").filter("host != ''").distinct().union(found.select("dst")).distinct()
    above = F.filter(suffixes(F.col("host")), lambda s: s.contains("."))
    steps = F.explode(F.transform(F.sequence(F.lit(1), F.size("above")), lambda i: F.struct(F.element_at("above", i).alias("low"), F.get("above", i).alias("high"))))
    steps = hosts.select(above.alias("above")).filter("size(above) > 1").select(steps.alias("s")).select("s.*").filter("high IS NOT NULL").distinct()
    n = F.lit(DOMAIN_LINKS).cast("long").alias("n")
    ways = F.explode(F.array(F.struct(F.col("low").alias("src"), F.col("high").alias("dst")), F.struct(F.col("high").alias("src"), F.col("low").alias("dst"))))
    steps = steps.select(ways.alias("w")).select("w.src", "w.dst", n)
    return found.unionByName(steps).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """kind, host, rank: personalised PageRank in whole units along ``links`` (kind, src, dst, n) from ``seeds`` (kind, host, n), for each kind by itself.

    Rank that is not passed on (hosts without links, cuts to whole units) goes back to the seeds in the next round.
    """
    whole = lambda c: F.floor(c).cast("long")
    every = F.broadcast(seeds.groupBy("kind").agg(F.sum("n").alias("every")))  # a row for each kind
    share = F.col("n").cast("double") / F.col("every").cast("double")
    seeds = stored(seeds.filter("n > 0").join(every, "kind").select("kind", "host", share.alias("share")), "seeds")
    out = links.groupBy("kind", "src").agg(F.sum("n").alias("every"))
    arcs = stored(links.join(out, ["kind", "src"]).select("kind", "src", "dst", share.alias("weight")), "arcs")

    def ranks(came: DataFrame) -> DataFrame:
        sums = F.broadcast(came.groupBy("kind").agg(F.sum("rank").alias("sum")))
        back = (F.lit(UNITS) - F.coalesce("sum", F.lit(0))).cast("double")
        again = seeds.join(sums, "kind", "left").select("kind", "host", whole(F.col("share") * back).alias("rank"))
        return came.unionByName(again).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))

    came = seeds.select("kind", "host", F.lit(0).cast("long").alias("rank")).limit(0)
    for _ in range(rounds):
        known = ranks(came).withColumnRenamed("host", "src")
        sent = known.join(arcs, ["kind", "src"]).select("kind", F.col("dst").alias("host"), whole(F.col("rank").cast("double") * F.col("weight") * damping).alias("rank"))
        came = stored(sent.groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "came")
    return ranks(came)


def judge_hosts(judged: DataFrame, links: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, least: float = LEAST) -> DataFrame:
    """host, trust, distrust, blocked for all hosts that have either. judged: host, allow (null for pages without a rule)."""
    links = stored(links, "host-links")
    kind = F.when(F.col("allow"), "trust").otherwise("distrust").alias("kind")
    seeds = judged.filter("allow IS NOT NULL AND host != ''").groupBy(kind, "host").agg(F.count("*").alias("n"))
    ways = F.array(F.struct(F.lit("trust").alias("kind"), "src", "dst", "n"), F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    ranks = propagate(links.select(F.explode(ways).alias("w")).select("w.*"), seeds, rounds, damping)
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(F.lit(0))).alias(k)
    both = ranks.groupBy("host").agg(of("trust"), of("distrust"))
    hosts = judged.select("host").filter("host != ''").union(links.select("src")).union(links.select("dst")).distinct().agg(F.count("*").cast("double")).scalar()
    blocked = (F.col("distrust") > F.col("trust")) & (F.col("distrust").cast("double") * hosts >= float(least * UNITS))
    return both.withColumn("blocked", blocked)


def judge_urls(pages: DataFrame, rules: Iterable[Rule] | DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, least: float = LEAST) -> DataFrame:
    """page_id, host, path, rule, verdict: one row for each row of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    rules = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    url = F.col("url").cast("string")
    narrow = stored(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("row", F.monotonically_increasing_id()), "urls")
    matched = stored(match_rules(narrow, rules), "matched")
    links = host_links(pages.select(host_of(url).alias("host"), "html"))
    bad = stored(judge_hosts(matched.select("host", "allow"), links, rounds, damping, least).filter("blocked").select("host", "blocked"), "blocked")
    bad = F.broadcast(bad) if bad.count() <= FEW else bad
    allowed = F.coalesce("allow", F.col("blocked").isNull())
    return matched.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.when(allowed, "allow").otherwise("block").alias("verdict"))
