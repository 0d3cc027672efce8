"""URL filters: block and allow rules, and link-graph propagation for the pages that no rule fits.

Hosts are judged by two personalised PageRanks over the host graph: trust flows along links from hosts whose pages
are allowed, distrust flows against links from hosts whose pages are mostly blocked (who links to bad hosts is
suspect). Both run as DataFrame joins over tables per host and per pair of hosts; each round is written to the
shared folder, which cuts the lineage. Rounds go on until no host's ranks move any more, measured by each host's own
ranks, so that hosts far from every seed are judged by ranks as settled as those of others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Temporary, materialise, temporary

#: (verdict, rule): host, a slash, and the path's beginning.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Share of a rank that follows links; rounds end when the ranks of every host move by less than this part of them.
DAMPING, STILL = 0.85, 1e-3
#: Share of a host's pages that must be blocked for it to be a seed of distrust; share of distrust that blocks a host.
#: Distrust needs that share and trust none, since a host blocked as a whole costs its clean pages, and a few blocked
#: pages on it are met by their rules anyway; a host trusted for a few pages costs nothing that a rule would block.
SEED_SHARE, THRESHOLD = 0.5, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null. A rule fits its host and all subdomains if the path starts with its path."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, begin = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{begin}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, pages): on how many pages a host links to another. ``pages`` has host and html; null html has no links."""
    link = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>:]+)"
    return (
        pages.filter(F.col("html").isNotNull() & (F.col("host") != ""))
        .select(F.col("host").alias("source"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(link), 1), lambda x: F.translate(x, _UPPER, _LOWER)))).alias("target"))
        .filter("target <> source")
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).alias("pages"))
    )


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, still: float = STILL) -> DataFrame:
    """(host, trust, distrust) from ``hosts`` (host, trusted, distrusted: the seeds' weights) over ``edges`` (source, target, pages).

    Linked hosts that have no page take part with no weight of their own. A table without edges leaves the seeds' weights.
    A host that ranks reach first after n rounds has moved by all it has in that round, so rounds go on; each round
    leaves ``damping`` of what moved, so they end about log(still) / log(damping) rounds (43) after the last host was reached.
    """
    with temporary() as made:
        ranks = _settled(hosts, edges, damping, still, made)
        made.keep(ranks)
    return ranks.select("host", "trust", "distrust")


def _settled(hosts: DataFrame, edges: DataFrame, damping: float, still: float, made: Temporary) -> DataFrame:
    known = hosts.select("host", "trusted", "distrusted")
    linked = edges.select(F.explode(F.array("source", "target")).alias("host")).distinct().join(known, "host", "left_anti")
    seeds = materialise(known.unionByName(linked.select("host", F.lit(0.0).alias("trusted"), F.lit(0.0).alias("distrusted"))), "seeds")
    both = edges.select(F.col("source").alias("host"), F.col("target").alias("to"), "pages", F.lit(True).alias("onward")).unionAll(
        edges.select(F.col("target").alias("host"), F.col("source").alias("to"), "pages", F.lit(False).alias("onward"))
    )
    out = materialise(both.groupBy("host", "onward").agg(F.sum("pages").alias("all")), "degrees")
    flows = materialise(both.join(out, ["host", "onward"]).select("host", "to", "onward", (F.col("pages") / F.col("all")).alias("share")), "flows")
    own = lambda c: (1 - damping) * F.col(c)
    ranks = materialise(seeds.select("host", own("trusted").alias("trust"), own("distrusted").alias("distrust")), "ranks")
    moving = not flows.isEmpty()
    while moving:
        sent = F.when(F.col("onward"), F.col("trust")).otherwise(F.col("distrust")) * F.col("share")
        got = (
            flows.join(ranks, "host")
            .groupBy(F.col("to").alias("host"))
            .agg(F.sum(F.when(F.col("onward"), sent)).alias("t"), F.sum(F.when(~F.col("onward"), sent)).alias("d"))
        )
        arrived = lambda c: damping * F.coalesce(c, F.lit(0.0))
        new = seeds.join(got, "host", "left").select("host", (own("trusted") + arrived("t")).alias("trust"), (own("distrusted") + arrived("d")).alias("distrust"))
        moved = lambda c, old: F.abs(F.col(c) - F.col(old)) > still * F.col(c)
        before = ranks.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        with temporary() as round_:
            new = materialise(new.join(before, "host").withColumn("moved", moved("trust", "t0") | moved("distrust", "d0")).drop("t0", "d0"), "ranks")
            round_.keep(new)
        made.discard(ranks)
        moving, ranks = not new.filter("moved").isEmpty(), new
    return ranks


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    The longest rule that fits gives the verdict. Without one, a host is blocked if it has distrust and that makes up
    THRESHOLD or more of its ranks; hosts that neither rank reaches, and urls without a host, are allowed. A null
    html has no links; repeated rows are judged alike and count each. Texts are read whole; a table without rows gives
    none. Only page_id, url and html are read, whatever other columns are called.
    """
    blocked = [rule for verdict, rule in rules if verdict == "block"]
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = named.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    by_rule = F.col("rule").isin(blocked)
    hosts = materialise(
        ruled.filter("host <> ''")
        .groupBy("host")
        .agg(share(by_rule).alias("bad"), share(F.col("rule").isNotNull() & ~by_rule).alias("trusted"))
        .select("host", "trusted", F.when(F.col("bad") >= SEED_SHARE, F.col("bad")).otherwise(0.0).alias("distrusted")),
        "hosts",
    )
    ranks = propagate(hosts, materialise(host_edges(named), "edges"))
    shunned = materialise(ranks.filter(F.expr(f"distrust > 0 and distrust >= {THRESHOLD} * (trust + distrust)")).select("host", F.lit(True).alias("shunned")), "shunned")
    verdict = (
        F.when(F.coalesce(by_rule, F.lit(False)), "block")
        .when(F.col("rule").isNotNull(), "allow")
        .when(F.col("shunned"), "block")
        .otherwise("allow")
    )
    return ruled.drop("html").join(shunned, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
