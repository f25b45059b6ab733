"""Page verdicts from URL rules, and from trust and distrust along links for URLs without a rule. SQL functions only.

Trust starts at hosts whose pages the rules allow and follows links (personalised PageRank); distrust starts at hosts
whose pages the rules block and follows links backwards, to the hosts that point there. A host's seed is the share of
its pages with such a rule, so a host with one blocked section isn't wholly distrusted. Scores are iterated until
none moves by more than TOLERANCE. Links are counted per pair of hosts before anything else, so a host with a third
of all pages is one row from then on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import table

#: (host, path, verdict): a rule fits the host and its subdomains, where the path begins with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, TOLERANCE = 0.85, 1e-4
#: A host all of whose pages are blocked by rules has a distrust of 0.15 at least.
THRESHOLD = 0.1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([a-z][a-z0-9+.-]*://[^"'\s>]*)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty if it is null or has no `://`."""
    there = url.contains("://")
    rest = F.when(there, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    return F.translate(F.coalesce(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), F.lit("")), UPPER, LOWER), F.coalesce(F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path in one string) and its verdict; null without one."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    tests = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ordered]
    pick = lambda values: F.coalesce(*(F.when(t, F.lit(v)) for t, v in zip(tests, values, strict=True)), F.lit(None).cast("string"))
    return pick([h + p for h, p, _ in ordered]), pick([v for *_, v in ordered])


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """host, score: score = (1 - DAMPING) * seed + DAMPING * sum over edges (src, dst, weight) of score(src) * weight.

    Every step leaves DAMPING of what is still to change at most, so that it ends once nothing moves by TOLERANCE. What
    reaches a host without links goes no further.
    """
    base = table(seeds.select("host", (F.col("seed") * (1 - DAMPING)).alias("seed")))
    scores = base.select("host", F.col("seed").alias("score"))
    while True:
        gained = edges.join(scores, edges.src == scores.host).groupBy("dst").agg(F.sum(F.col("score") * F.col("weight")).alias("gained")).withColumnRenamed("dst", "host")
        new = base.join(gained, "host", "left").select("host", (F.col("seed") + DAMPING * F.coalesce("gained", F.lit(0.0))).alias("score"))
        both = table(new.join(scores.withColumnRenamed("score", "before"), "host", "left"))
        scores = both.select("host", "score")
        if both.where(F.abs(F.col("score") - F.col("before")) > TOLERANCE).isEmpty():
            return scores


def weighted(links: DataFrame, source: str, target: str) -> DataFrame:
    """src, dst, weight: each source's links shared out over its targets."""
    totals = links.groupBy(source).agg(F.sum("n").alias("total"))
    return table(links.join(totals, source).select(F.col(source).alias("src"), F.col(target).alias("dst"), (F.col("n") / F.col("total")).alias("weight")))


def judge_urls(pages: DataFrame, rules=RULES, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    The verdict is the rule's; without a rule it is block if the host's distrust is at least THRESHOLD and more than its
    trust, else allow. Hosts are those of the pages and of absolute links in their html. URLs without host are allowed
    unless a rule fits and take no part in the graph. Repeated rows count as pages of their own; no rows give none.
    """
    host, path = host_and_path(F.col(url_column))
    plain = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"), F.regexp_extract_all(F.coalesce(F.col(html_column), F.lit("")), F.lit(LINK), F.lit(1)).alias("links"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    slim = table(plain.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), "links"))
    target = slim.where("host != '' AND size(links) > 0").select("host", F.explode("links").alias("link"))
    target = target.select("host", host_and_path(F.col("link"))[0].alias("target")).where("target != '' AND target != host")
    links = table(target.groupBy("host", "target").agg(F.count(F.lit(1)).cast("double").alias("n")))
    counted = slim.where("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad"))
    seeds = table(counted.unionByName(links.select(F.col("target").alias("host"), *(F.lit(0).cast("long").alias(c) for c in ("n", "good", "bad")))).groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "good", "bad"))))
    share = lambda c: seeds.select("host", F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0)).alias("seed"))
    trust = propagate(share("good"), weighted(links, "host", "target")).withColumnRenamed("score", "trust")
    distrust = propagate(share("bad"), weighted(links, "target", "host")).withColumnRenamed("score", "distrust")
    scored = slim.join(trust.join(distrust, "host"), "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    by_graph = F.when((F.col("distrust") >= THRESHOLD) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_graph).alias("verdict"), "trust", "distrust")
