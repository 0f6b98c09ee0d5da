"""URL filter by rules, and by propagation over the host graph where no rule fits.

Host edges come from absolute links in the pages. Trust is personalised PageRank from the hosts of pages that rules allow;
distrust is the same over reversed edges from the hosts of pages that rules block, so a host that links to blocked hosts
gets some. A host is blocked where distrust is more than ``threshold`` of both.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import read_table, staged

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
LINK = r"(?i)(?:href|src|action)\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"
DAMPING = 0.85
STEPS = 30
THRESHOLD = 0.5


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as ``struct(rule, verdict)``, else null; of equally long ones the first in order."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        inside = (host == name) | host.endswith(f".{name}")
        fits.append(F.when(inside & path.startswith(f"/{rest}"), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: number of links between different hosts; summed per task before the shuffle."""
    links = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))
    found = pages.select(host_of(F.col("url")).alias("src"), links.alias("link"))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    edges = found.select("src", host_of(target).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


def page_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS, tolerance: float = 1e-6) -> DataFrame:
    """Personalised PageRank ``host, score`` over ``edges(src, dst, n)`` from ``seeds(host, weight)``; scores sum to 1.

    Rank of hosts without links goes back to the seeds. Every step is written to the shared folder. A host with many
    links is summed per task first; without seeds the result is empty.
    """
    total = seeds.agg(F.sum("weight")).first()[0]
    if not total:
        return seeds.select("host", F.lit(0.0).alias("score")).limit(0)
    base = staged(seeds.groupBy("host").agg((F.sum("weight") / F.lit(float(total))).alias("base")), "seeds")
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    share = staged(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share")), "shares")
    rank = base.select("host", F.col("base").alias("score"))
    if share.isEmpty():
        return rank
    for _ in range(steps):
        flow = rank.join(share, rank["host"] == share["src"]).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("flow"))
        moved = flow.agg(F.sum("flow")).first()[0] or 0.0
        back = 1.0 - damping * moved
        joined = flow.join(base, "host", "full").select("host", (damping * F.coalesce("flow", F.lit(0.0)) + back * F.coalesce("base", F.lit(0.0))).alias("score"))
        new = staged(joined, "ranks")
        change = new.withColumnRenamed("score", "now").join(rank, "host", "full")
        moved = change.agg(F.sum(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("score", F.lit(0.0))))).first()[0]
        rank = new
        if moved < tolerance:
            break
    return rank


def host_verdicts(judged: DataFrame, pages: DataFrame, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """``host, trust, distrust, blocked`` of every host that either propagation reaches."""
    edges = staged(host_links(pages), "host-links")
    counts = judged.where("host <> '' and verdict is not null").groupBy("host", "verdict").agg(F.count("*").alias("weight"))
    counts = staged(counts, "seeds")
    trust = page_rank(edges, counts.where("verdict = 'allow'"), **settings)
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = page_rank(turned, counts.where("verdict = 'block'"), **settings)
    both = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
    both = both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    return both.withColumn("blocked", F.expr(f"distrust > {threshold} * (trust + distrust)"))


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url, html)``.

    A fitting rule decides. Else the host does: blocked if its distrust passes the threshold, allowed otherwise, also where no
    propagation reaches it (an empty host among them). Null urls and ones without ``://`` have an empty host and path. Null
    html has no links. Without any links only hosts with judged pages have scores. Repeated rows each get a row; an empty
    table gives an empty result; other columns are not read.
    """
    pages = pages.select("page_id", "url", "html")
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = named.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "fit.rule", "fit.verdict")
    blocked = staged(host_verdicts(judged, pages, threshold, **settings).where("blocked").select("host"), "blocked-hosts")
    decided = judged.where("verdict is not null")
    open_ = judged.where("verdict is null")
    marked = open_.join(blocked.withColumn("bad", F.lit(True)), "host", "left")
    method = F.when(F.col("bad"), "block").otherwise("allow").alias("verdict")
    return decided.unionByName(marked.select("page_id", "host", "path", "rule", method))


def op5_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))


QUERIES = {"op5_link_graph": op5_link_graph}
ORACLES: dict[str, str] = {}
