"""URL filters: list rules first, then trust and distrust propagated over the host graph.

Edges run from a page's host to the hosts it links to (absolute links of its html, relative ones
lead to the host itself) and between a host and its parent domain where both have pages, in both
directions, since subdomains of a site vouch for each other. Trust is personalised PageRank from
the hosts that allow rules cover; distrust is the same walk along reversed edges from every host with
a page that block rules hit, each by the blocked share of its pages, because who links to a bad host
is suspect. Walks go on until no rank changes by `TOLERANCE` of an even share.

The threshold is applied per host, to ranks in units of what a wholly blocked (or trusted) host gets
as a seed: a host is blocked where its distrust exceeds its trust by more than `MARGIN` of that. So
a host with one blocked page in fifty stays, as does who links to it; a host with a fifth of its
pages blocked goes, and so does one whose links lead to a wholly blocked host alone.

Ranks are tables of one row per host, edges are aggregated to one row per pair of hosts, and each
round aggregates before it joins, so a host with a third of all pages is one row here.

Defined cases: a NULL url or one without `://` has an empty host and path, follows no rule and is
judged as the empty host: allowed, since nothing leads to it; NULL html has no links; repeated
pages each give a row and count as links once per row; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.llm.words import fresh
from tillweave.operators.scalars import beside
from tillweave.session import stash

# The rules, as (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

DAMPING, KEEP_EVERY = 0.85, 4
TOLERANCE = 1e-6  # of the rank of an even share, 1 / hosts
MARGIN = 0.1  # of a wholly blocked host's own share
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, Latin capitals lowered."""
    host = F.when(F.instr(url, "://") > 0, F.regexp_extract(_after(url), r"^([^/?#]*)", 1))
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _after(url: Column) -> Column:
    """What follows the first `://`."""
    return F.substr(url, F.instr(url, "://") + F.lit(3))


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, NULL where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):  # longer ones overwrite
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame) -> DataFrame:
    """Pages with `_host`, `_path`, `_rule` and `_listed`."""
    out = pages.withColumns({"_host": host_of(F.col("url")), "_path": path_of(F.col("url"))})
    rule, verdict = rule_of(F.col("_host"), F.col("_path"))
    return out.withColumns({"_rule": rule, "_listed": verdict})


def edges_of(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between hosts, and site edges between a host and its parents."""
    links = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    target = F.array_distinct(F.transform(links, lambda u: F.when(F.instr(u, "://") > 0, host_of(u)).otherwise(F.lit(""))))
    # per page one row per host it links to; an empty target is the page's own host
    linked = pages.filter("_host <> ''").select(F.col("_host").alias("src"), F.explode(target).alias("dst"))
    links = linked.select("src", F.when(F.col("dst") == "", F.col("src")).otherwise(F.col("dst")).alias("dst"))
    hosts = pages.filter("_host <> ''").select(F.col("_host").alias("host")).distinct()
    labels = F.split("host", r"\.")
    ups = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    above = hosts.filter(F.size(labels) > 1).select("host", F.explode(ups).alias("parent"))
    site = above.join(hosts.select(F.col("host").alias("parent")), "parent")
    both = site.select(F.col("host").alias("src"), F.col("parent").alias("dst")).union(site.select(F.col("parent").alias("src"), F.col("host").alias("dst")))
    return links.union(both).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def pagerank(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, tolerance: float = 0.0) -> DataFrame:
    """(host, rank): personalised PageRank; seeds (host, share) sum to 1, ranks start there.

    What reaches a host without edges out ends there. Without `rounds` the walk goes on until no
    rank changes by more than `tolerance` in a round. The ranks are written every `KEEP_EVERY`
    rounds, which cuts the lineage; only then is the change looked at.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = stash(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("part")))
    rank = seeds.select("host", F.col("share").alias("rank"))
    restart = seeds.select("host", (F.col("share") * (1 - DAMPING)).alias("rank"))
    k = 0
    while rounds is None or k < rounds:
        k += 1
        moved = share.join(rank, share["src"] == rank["host"]).select(F.col("dst").alias("host"), (DAMPING * F.col("rank") * F.col("part")).alias("rank"))
        arrived = moved.union(restart)
        if k % KEEP_EVERY:
            rank = arrived.groupBy("host").agg(F.sum("rank").alias("rank"))
            continue
        beside_old = arrived.withColumn("old", F.lit(0.0)).union(rank.select("host", F.lit(0.0), "rank"))
        kept = stash(beside_old.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old")))
        rank = kept.select("host", "rank")
        if rounds is None and (kept.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) <= tolerance:
            break
    return rank.filter("rank > 0")


def scores(pages: DataFrame) -> DataFrame:
    """(host, trust, distrust, excess) of every host with pages or links; ranks times the number of
    hosts, so that 1 is an even share whatever the size of the graph. `excess` is distrust less
    trust in units of what one whole seed gets of the restart."""
    edges = stash(edges_of(pages))
    seeds = stash(pages.filter("_host <> ''").groupBy("_host").agg(
        F.count_if(F.col("_listed") == "allow").alias("good"), F.count_if(F.col("_listed") == "block").alias("bad"), F.count("*").alias("pages"),
    ))

    nodes = stash(edges.select(F.col("src").alias("host")).union(edges.select("dst")).union(seeds.select("_host")).distinct())
    tolerance = TOLERANCE / max(1, nodes.count())
    blocked = F.col("bad") / F.col("pages")
    whole = seeds.agg(F.sum(F.when(F.col("good") > F.col("bad"), 1.0)).alias("_good"), F.sum(F.when(F.col("bad") > 0, blocked)).alias("_bad"))

    def shares(chosen: DataFrame, weight: Column) -> DataFrame:
        one = chosen.select(F.col("_host").alias("host"), weight.alias("_w"))
        return stash(beside(one, one.agg(F.sum("_w").alias("_n"))).select("host", (F.col("_w") / F.col("_n")).alias("share")))

    trust = pagerank(edges, shares(seeds.filter("good > bad"), F.lit(1.0)), tolerance=tolerance)
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = pagerank(reverse, shares(seeds.filter("bad > 0"), blocked), tolerance=tolerance)
    ranks = trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).union(distrust.select("host", F.lit(0.0), "rank"))
    ranks = nodes.join(ranks.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "host", "left")
    scaled = beside(beside(ranks, nodes.agg(F.count("*").alias("_n"))), whole)
    of_seed = lambda c, n: F.coalesce(F.col(c) * F.col(n) / (1 - DAMPING), F.lit(0.0))
    excess = F.round(of_seed("distrust", "_bad") - of_seed("trust", "_good"), 9).alias("excess")
    return scaled.select("host", *[F.coalesce(F.round(F.col(c) * F.col("_n"), 12), F.lit(0.0)).alias(c) for c in ("trust", "distrust")], excess)


def with_verdicts(pages: DataFrame) -> DataFrame:
    """Pages with host, path, rule, verdict, trust and distrust in a struct `_url`; a taken name gets
    an underscore."""
    name = fresh(pages.columns, "_url")
    listed = judged(pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_page"), "url", "html"))
    known = stash(scores(listed))  # one row per host, of a size the planner knows
    made = listed.join(known.withColumnRenamed("host", "_host"), "_host", "left")
    method = F.when(F.coalesce("excess", F.lit(0.0)) > MARGIN, "block").otherwise("allow")
    found = F.struct(
        F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.coalesce("_listed", method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
    return made.select("_page.*", found.alias(name))


def report(pages: DataFrame) -> DataFrame:
    """One row per page: host, path, rule and verdict, with the host's scores."""
    return with_verdicts(pages.select("page_id", "url", "html")).select("page_id", *[F.col(f"_url.{c}").alias(c) for c in ("host", "path", "rule", "verdict", "trust", "distrust")])
