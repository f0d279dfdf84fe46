"""Verdicts on urls: rules first, else trust and distrust that spread over the links between hosts.

A rule names a host and a path; it fits that host and its subdomains where the url's path starts
with the rule's, and the longest fitting rule decides. Where none fits, the url's host decides:
hosts are seeded by their pages that rules allow (trust) or block (distrust); trust follows links,
distrust goes against them, from a host to those that link to it. Both are personalised PageRanks
of a fixed number of rounds. A host is blocked if its distrust exceeds its trust by more than
half of the restart mass that it would have were all of its pages blocked.

Masses are whole numbers (a page counts `UNIT`), so sums don't depend on their order and the
result is the same in every run. Links are made distinct by pairs of hosts, partly before they
move. While there are few hosts their masses are broadcast (counted first) and links stay where
they are; else a host with very many links has them dealt into parts of bounded size, and its
mass is sent to each part. Each round is written and read back; the round before it is dropped.

Defined results: null urls, and those without ://, have an empty host and path: no rule fits,
and they are allowed, as an empty host takes no part in the graph. Links are absolute or
protocol-relative hrefs to another host; others stay within their host and say nothing. Hosts that
are only linked to pass masses on, and have no page to judge. Null html has no links. Repeated
rows are repeated, and count as pages of their own; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

UNIT = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"(?s)\A.*?://([^/?#]*)"
PATH = r"(?s)\A.*?://[^/?#]*([^?#]*)"
LINK = r"""[\x09-\x0D\x20"'/][hH][rR][eE][fF][\x09-\x0D\x20]*=[\x09-\x0D\x20]*["']?(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"'<>\x00-\x20]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def ruled(host: Column, path: Column, rules: list[Rule]) -> Column:
    """rule and verdict of the longest rule that fits (of equal ones, that of the longer host); null fields if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """source, target: distinct pairs of different hosts where a page of the one links to the other. pages: host, html."""
    links = pages.where("host <> ''").select(F.col("host").alias("source"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)).alias("target"))
    return links.withColumn("target", F.translate("target", UPPER, LOWER)).where("source <> target").distinct()


def spread(spark: SparkSession, seeds: DataFrame, links: DataFrame, rounds: int = 12, damping: int = 85, few_hosts: int = 100_000, part_links: int = 100_000) -> DataFrame:
    """host, trust, distrust after so many rounds. seeds: host, trust, distrust (longs); links: source, target, distinct."""
    scratch = Scratch(spark, "spread")
    links = scratch.cut(links, "links")
    both = links.select(F.lit(True).alias("trusted"), F.col("source").alias("host"), F.col("target").alias("to")).union(links.select(F.lit(False), "target", "source"))
    degrees = both.groupBy("trusted", "host").agg(F.count("*").alias("degree")).withColumn("parts", F.ceil(F.col("degree") / part_links))
    degrees = scratch.cut(degrees, "degrees")
    masses = seeds.select("host", F.explode(F.array(F.struct(F.lit(True).alias("trusted"), F.col("trust").alias("mass")), F.struct(F.lit(False).alias("trusted"), F.col("distrust").alias("mass")))).alias("s"))
    masses = scratch.cut(masses.select("s.trusted", "host", "s.mass").where("mass > 0"), "round0")
    restart = masses.select("trusted", "host", F.expr(f"mass * {100 - damping} div 100").alias("mass"))
    small = degrees.limit(few_hosts + 1).count() <= few_hosts
    dealt = both if small else both.join(degrees, ["trusted", "host"]).withColumn("part", F.pmod(F.xxhash64("to"), F.col("parts"))).select("trusted", "host", "part", "to")
    if links.limit(1).count() == 0:
        rounds, masses = 0, restart
    for i in range(1, rounds + 1):
        shares = masses.join(degrees, ["trusted", "host"]).select("trusted", "host", "parts", F.expr(f"mass * {damping} div (100 * degree)").alias("mass"))
        if small:  # at most as many rows as there are hosts with links
            sent = dealt.join(F.broadcast(shares.drop("parts")), ["trusted", "host"])
        else:
            sent = dealt.join(shares.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts"), ["trusted", "host", "part"])
        met = sent.select("trusted", F.col("to").alias("host"), "mass").union(restart).groupBy("trusted", "host").agg(F.sum("mass").alias("mass"))
        masses = scratch.cut(met, f"round{i}")
        if i > 1:
            scratch.drop(f"round{i - 1}")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("trusted") == kind, F.col("mass"))), F.lit(0))
    return masses.groupBy("host").agg(of(True).alias("trust"), of(False).alias("distrust"))


def judge(spark: SparkSession, pages: DataFrame, rules: list[Rule], rounds: int = 12, damping: int = 85, few_hosts: int = 100_000, salts: int = 32) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages: page_id, url, html."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = ruled(F.col("host"), F.col("path"), rules)
    judged = rows.withColumn("found", found).select("page_id", "host", "path", "found.rule", F.col("found.verdict").alias("said"))

    counted = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), (F.count_if(F.col("said") == "allow") * UNIT).alias("trust"), (F.count_if(F.col("said") == "block") * UNIT).alias("distrust"))
    counted = Scratch(spark, "hosts").cut(counted, "counted")
    links = host_links(pages.select(host_of(F.col("url")).alias("host"), "html"))
    masses = spread(spark, counted, links, rounds, damping, few_hosts)
    limit = F.expr(f"pages * {UNIT * (100 - damping) // 100}")
    bad = counted.select("host", "pages").join(masses, "host").where(2 * (F.col("distrust") - F.col("trust")) > limit).select("host", F.lit("block").alias("spread"))
    bad = Scratch(spark, "blocked").cut(bad, "hosts")
    if bad.limit(few_hosts + 1).count() <= few_hosts:
        joined = judged.join(F.broadcast(bad), "host", "left")
    else:  # a host may hold a third of all pages
        salted = bad.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        joined = judged.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts))).join(salted, ["host", "salt"], "left")
    return joined.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", F.coalesce("said", "spread", F.lit("allow")).alias("verdict"))
