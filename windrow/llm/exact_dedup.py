"""Exact deduplication with a heavy-hitter split.

A group of copies may hold a third of all rows, so the groups are not simply dealt out by digest:

1. one pass computes a SHA-256 digest per row and writes (doc_id, digest) to the shared folder;
2. Misra-Gries counters (Spark's ``freqItems`` aggregate: one bounded map per task, merged) name every digest
   that can hold more than ``support`` of the rows, 1 / support candidates at most;
3. an exact count of the candidates alone, combined map-side, verifies them: the winners are those that do
   hold that share, again 1 / support rows at most, and are broadcast;
4. rows with a winner's digest get their group from the broadcast table without a shuffle; the remaining digests are
   counted by an ordinary shuffle of one row per digest and task (combined map-side), and the groups of several rows
   meet the rows by a broadcast if they are few, and else by a join that Spark splits where a digest has many rows.

So no task ever holds the rows of a group, however large the group is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialise, normal_text

#: Share of all rows from which a digest counts as heavy. It bounds the broadcast table: 1 / SUPPORT rows.
SUPPORT = 0.001
#: Rows of (digest, keep_id) of ordinary groups that may be broadcast (40 bytes each); more of them join by shuffle.
BROADCAST = 500_000


def heavy_digests(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, keep_id, group_size) of every digest in at least two rows and ``support`` of all rows; at most 1 / support rows."""
    least = max(2.0, support * digests.count())  # one number
    spelled = digests.select(F.hex("digest").alias("spelled"))  # the counters' map compares strings, not byte arrays
    named = spelled.stat.freqItems(["spelled"], support).select(F.explode("spelled_freqItems").alias("spelled"))
    named = named.distinct().select(F.unhex("spelled").alias("digest"))
    counted = (
        digests.join(F.broadcast(named), "digest")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return counted.filter(F.col("group_size") >= least)


def _digest():
    return F.unhex(F.sha2(normal_text(), 256)).alias("digest")


def repeated(digests: DataFrame, heavy: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of the digests in several rows that are not heavy."""
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    counted = rest.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return materialise(counted.filter("group_size > 1"), "several")


def exact_groups(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of ASCII white space became one space; a null text is the
    empty text. keep_id is the smallest doc_id of the group; null ids come after all others, and only a group
    without any id has a null keep_id. Rows that repeat the kept doc_id with the same text are that same
    document and are all marked kept. Other columns of ``docs`` are not read; an empty table gives no rows.
    """
    digests = materialise(docs.select("doc_id", _digest()), "digests")
    heavy = materialise(heavy_digests(digests, support), "heavy")
    common = digests.join(F.broadcast(heavy), "digest")
    several = repeated(digests, heavy)
    rest = (
        digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
        .join(bounded_broadcast(several, several.count(), BROADCAST), "digest", "left")
        # A row that is alone keeps itself; a group of several without any id has no keep_id, nor have its rows an id.
        .withColumn("keep_id", F.coalesce("keep_id", "doc_id"))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    )
    columns = ("doc_id", "keep_id", "group_size", "digest")
    return common.select(*columns).unionAll(rest.select(*columns)).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs``, all columns, that exact_groups marks as kept.

    Heavy groups are decided map-side. Of the others only groups of several rows matter: their table is broadcast
    if it is small, and else meets the rows in a shuffle by digest. Null texts are empty ones; in a group without any
    id all rows stay; rows that repeat the kept id stay; a table without rows gives none. Columns of any name stay.
    """
    digests = materialise(docs.select("doc_id", _digest()), "digests")
    heavy = materialise(heavy_digests(digests, support).select("digest", "keep_id"), "heavy")
    several = repeated(digests, heavy).select("digest", "keep_id")
    kept = docs.select(F.struct("*").alias("row"), _digest())
    for groups in (F.broadcast(heavy), bounded_broadcast(several, several.count(), BROADCAST)):
        found = groups.withColumn("found", F.lit(True))
        kept = kept.join(found, "digest", "left").filter(F.col("found").isNull() | F.col("row.doc_id").eqNullSafe(F.col("keep_id"))).select("row", "digest")
    return kept.select("row.*")
