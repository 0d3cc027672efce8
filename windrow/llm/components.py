"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_tasks, materialise, temporary


def _towards_least(links: DataFrame, both_ways: bool, rows: int) -> DataFrame:
    """One star step over links (u, v) with u > v: larger neighbours, or a node and its smaller ones, move to its least neighbour.

    The least neighbours, and what it gives, are at most ``rows`` rows: twice the links."""
    sides = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else links
    # Written first, so that Spark can split what a node with very many links makes one task of the join.
    least = materialise(few_tasks(sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), rows), "least")
    joined = sides.join(least, "u")
    if both_ways:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionAll(joined.select("u", F.col("m").alias("v")))
    return few_tasks(moved.distinct(), rows)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in links (u, v: long): root is the least node that can be reached.

    Alternating large-star and small-star steps; both keep the components and end in one star around each least
    node, after about as many rounds as the logarithm of the longest path. Each round is written to the shared
    folder. Links of a node with itself and repeated links are allowed.
    """
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 40)), F.lit(0))).first())
    with temporary() as whole:
        now = materialise(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        seen = mark(now)
        while seen[0]:
            before = now
            with temporary() as round_:
                large = materialise(_towards_least(before, True, 2 * seen[0]), "large")
                round_.keep(now := materialise(_towards_least(large, False, 2 * seen[0]), "small"))
            whole.discard(before)
            if (new := mark(now)) == seen:
                break
            seen = new
        whole.keep(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
