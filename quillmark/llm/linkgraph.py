"""URL filters: rules on host and path, and trust over the link graph.

Trust flows along links from trusted seed hosts; distrust flows against them from blocked ones, so who links to blocked
hosts is distrusted. Both are personalised PageRank over the edges between hosts. A host whose distrust outweighs its trust is
blocked. DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import materialize


@dataclass(frozen=True)
class Rule:
    """pattern: host/path-prefix, as net/ or example.com/de/. It fits the host and all its subdomains."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]


RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: str) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://, null or not."""
    return F.coalesce(F.translate(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1), *LOWER), F.lit(""))


def path_of(url: str) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: str, path: str, rules=RULES, what: str = "pattern") -> Column:
    """The longest rule that fits (its pattern, or its verdict); null if none does. Ties: the first in the list."""
    fits = [(F.col(host) == r.host) | F.col(host).endswith("." + r.host) for r in rules]
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i].pattern))
    out = F.lit(None).cast("string")
    for i in reversed(order):
        out = F.when(fits[i] & F.col(path).startswith(rules[i].path), F.lit(getattr(rules[i], what))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, from the absolute or scheme-relative href targets of the pages."""
    links = F.expr(r"""regexp_extract_all(html, '(?i)href\\s*=\\s*["\']?\\s*((?:https?:)?//[^"\'\\s>]+)', 1)""")
    edges = pages.where("html is not null").select(host_of("url").alias("src"), F.explode(links).alias("_to")).where("src <> ''")
    edges = edges.select("src", F.translate(F.regexp_extract("_to", r"^(?:[A-Za-z]+:)?//([^/?#]*)", 1), *LOWER).alias("dst")).where("dst <> '' and src <> dst")
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float, every: int = 4) -> DataFrame:
    """(host, rank): personalised PageRank of (src, dst, n) edges from (host, seed) weights that sum to 1.

    Ranks of hosts without out-links go back to the seeds: that multiplies all ranks by the same factor, so the mass that links carry is summed
    and scaled to 1 at the end. Each round moves on what the last one brought, until that is at most `tolerance` of the sum at every host; a host
    that is reached for the first time has all of its sum from that round, so rounds go on while there are any. They run as joins; a table is
    written every few rounds. Ranks too small for a double are 0."""
    out = edges.groupBy("src").agg(F.sum("n").alias("_out"))
    flow = materialize(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("_out")).alias("part")))
    hosts = flow.select(F.col("src").alias("host")).union(flow.select(F.col("dst").alias("host"))).union(seeds.select("host")).distinct()
    mass = hosts.join(seeds, "host", "left").select("host", F.coalesce("seed", F.lit(0.0)).alias("sum")).withColumn("new", F.col("sum"))
    while True:
        for _ in range(every):
            sent = flow.join(mass.where("new > 0").select(F.col("host").alias("src"), "new"), "src").groupBy("dst").agg((F.sum(F.col("new") * F.col("part")) * damping).alias("got"))
            got = F.coalesce("got", F.lit(0.0))
            mass = mass.join(sent.withColumnRenamed("dst", "host"), "host", "left").select("host", (F.col("sum") + got).alias("sum"), got.alias("new"))
        mass = materialize(mass)
        end = mass.agg(F.max(F.when(F.col("new") > 0, F.col("new") / F.col("sum"))).alias("most"), F.sum("sum").alias("all")).first()
        if (end["most"] or 0.0) <= tolerance:
            return mass.select("host", (F.col("sum") / F.lit(end["all"] or 1.0)).alias("rank"))


def judge(pages: DataFrame, rules=RULES, damping: float = 0.85, threshold: float = 0.0, tolerance: float = 1e-9) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each page.

    A rule's verdict holds where one fits. Else a host is blocked if its distrust is more than `threshold` above its trust:
    hosts with a page that an allow rule takes are trusted seeds, those with a page that a block rule takes are blocked
    seeds, in proportion to such pages. Differences within a thousand tolerances of the trust are ties, which don't block. Without seeds or links nothing but the rules blocks. Null urls, and urls without ://, have an empty host and path and are
    allowed; null html has no links; repeated rows are judged each by itself; an empty table gives no rows; other
    columns are neither read nor returned.
    """
    url = pages.select("page_id", "url", host_of("url").alias("host"), path_of("url").alias("path"))
    url = url.withColumns({"rule": rule_for("host", "path", rules), "_said": rule_for("host", "path", rules, "verdict")})
    counts = materialize(url.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("_said") == "allow", 1)).alias("_good"), F.count(F.when(F.col("_said") == "block", 1)).alias("_bad")))
    edges = materialize(host_edges(pages))
    total = counts.agg(F.sum(F.col("_good") / F.col("_n")).alias("_g"), F.sum(F.col("_bad") / F.col("_n")).alias("_b"))
    seeded = counts.join(F.broadcast(total))  # one row
    good = seeded.where("_good > 0").select("host", (F.col("_good") / F.col("_n") / F.col("_g")).alias("seed"))
    bad = seeded.where("_bad > 0").select("host", (F.col("_bad") / F.col("_n") / F.col("_b")).alias("seed"))
    trust = pagerank(edges, good, damping, tolerance).withColumnRenamed("rank", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = pagerank(back, bad, damping, tolerance).withColumnRenamed("rank", "distrust")
    scores = materialize(counts.select("host").join(trust, "host", "left").join(distrust, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    out = url.join(scores, "host", "left").withColumn("verdict", F.coalesce("_said", F.when(F.coalesce(F.col("distrust") - F.col("trust") * (1 + 1000 * tolerance) > threshold, F.lit(False)), "block").otherwise("allow")))
    return out.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
