"""URL filter by link-graph propagation, in DataFrame functions only.

Method. Rules judge what they name. For the rest, trust and distrust spread over the links between hosts: a
personalised PageRank from hosts that allow rules cover, along links, and one from hosts that block rules cover,
against them (who links to blocked hosts is suspect). A host is blocked if distrust makes up more than a threshold
of what reached it.

Ranks are whole numbers (units of one SCALE-th), so sums don't depend on their order. Links are aggregated to host
edges on the map side; a round is one join of ranks and edges and one sum, and every round is written to the shared
folder. Hosts, not pages, take part in the rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.store import written

#: (verdict, host, path): a rule fits its host and all subdomains where the path begins with its own.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ROUNDS = 10
SCALE = 10**12
DAMPING = 85  # percent
#: A host is blocked if distrust is over this percentage of trust and distrust together.
DISTRUST = 60

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """host (A-Z lower-cased) and path of a url; both empty for null and where `://` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; of equally long ones the first in the list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(judged: DataFrame) -> DataFrame:
    """source, target, weight: links from pages of one host to another."""
    linked = judged.select("host", F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("to"))
    target = F.regexp_replace(F.translate("to", _UPPER, _LOWER), r"^.*@|:\d*$", "")
    edges = linked.select(F.col("host").alias("source"), target.alias("target"))
    edges = edges.filter("source <> target AND source <> '' AND target <> ''")
    return edges.groupBy("source", "target").agg(F.count("*").alias("weight"))


def _share(rank: str, weight: str, total: str) -> Column:
    """rank * weight div total, multiplied first and in 38 digits, so that no share is rounded away."""
    wide = "cast({} as decimal(19,0))"
    return F.expr(f"{wide.format(rank)} * {wide.format(weight)} div {wide.format(total)}")


def _weighted(edges: DataFrame, source: str, target: str, kind: str) -> DataFrame:
    total = edges.groupBy(source).agg(F.sum("weight").alias("total"))
    return edges.join(total, source).select(
        F.lit(kind).alias("kind"), F.col(source).alias("source"), F.col(target).alias("target"), "weight", "total"
    )


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, host, rank after the rounds; seeds: kind, host, weight; edges: source, target, weight."""
    totals = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = seeds.join(totals, "kind").select("kind", "host", _share("weight", f"{SCALE}L", "total").alias("rank"))
    start = written(start, "seeds")
    both = _weighted(edges, "source", "target", "trust").unionByName(_weighted(edges, "target", "source", "distrust"))
    both = written(both.withColumnRenamed("source", "host"), "edges")
    restart = start.withColumn("rank", F.expr(f"rank * {100 - DAMPING} div 100"))
    ranks = start
    for _ in range(rounds):
        moved = ranks.join(both, ["kind", "host"]).groupBy("kind", F.col("target").alias("host")).agg(
            F.sum(_share(f"rank * {DAMPING} div 100", "weight", "total")).alias("rank")
        )
        ranks = written(restart.unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "ranks")
    return ranks


def judge_urls(
    pages: DataFrame, rules=RULES, rounds: int = ROUNDS, distrust: int = DISTRUST, links: DataFrame | None = None
) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page.

    pages: page_id, url, html; other columns are ignored. A host is a seed of trust (distrust) if more than half of
    its pages fall under allow (block) rules, with its pages as weight. links: host edges (source, target, weight) to
    use besides those in html. A null url has an empty host and path and is no seed; a null html has no links; pages
    without a rule whose host nothing reached are allowed. Repeated rows come out as often as they go in and count as
    pages; an empty table gives no rows.
    """
    host, path = url_parts(F.col("url").cast("string"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    judged = parts.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    edges = host_edges(judged)
    if links is not None:
        edges = edges.unionByName(links.select("source", "target", F.col("weight").cast("long").alias("weight")))
        edges = edges.filter("source <> target").groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    hosts = judged.filter("host <> ''").groupBy("host").agg(
        F.count("*").alias("weight"), F.count_if(F.col("found.verdict") == "allow").alias("allowed"),
        F.count_if(F.col("found.verdict") == "block").alias("blocked"),
    )
    seeds = hosts.select("host", "weight", F.when(F.expr("2 * allowed > weight"), F.lit("trust")).when(
        F.expr("2 * blocked > weight"), F.lit("distrust")
    ).alias("kind")).filter("kind IS NOT NULL")
    ranks = propagate(seeds, written(edges, "edges"), rounds)
    reached = ranks.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0)).alias("distrust"),
    )
    suspect = F.expr(f"100 * distrust > {distrust} * (trust + distrust)")
    verdict = F.coalesce(F.col("found.verdict"), F.when(suspect, F.lit("block")), F.lit("allow"))
    zero = F.lit(0).cast("long")
    return judged.drop("html").join(reached, "host", "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"),
        F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"),
    )
