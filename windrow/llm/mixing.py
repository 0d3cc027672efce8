"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame operations only.

The mix is made of equal blocks of ``BLOCK`` words. Sainte-Lague's highest quotients (target / (2 k + 1)) give
every source an integer number of blocks, and the same rule deals each source's blocks to its shards, in
proportion to their sizes; what is beyond twice a shard's words is dealt again. Within a shard the documents stand in
a seeded order and their words form a ring, cut into blocks; the quota's blocks are those that follow each other round
it from a seeded place. The seed thus chooses through the order of the documents and the place of the first block, not
by a draw for each block: neighbours on the ring are documents that have nothing to do with each other, no word is
taken a third time before all are taken twice, and no table of all blocks is needed.

All tables but the first two are per source or per (source, shard); the documents are dealt out once, by
(source, shard), so that a source with a third of all rows is spread over all shards.

Where the mix is wanted as rows, the blocks are dealt and laid in the same way, and the few documents that an end of
their shard's blocks cuts are taken whole or not, by what they have of the blocks, carried along their source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded_broadcast, materialise

#: Words in a block, words aimed at per shard, shards at most, and the seed of the order.
BLOCK, SHARD_WORDS, MOST_SHARDS, SEED = 32, 131_072, 8192, 20240101
#: Weights of the sources in order, repeating; the share of all words that the mix takes; turns at most.
WEIGHTS, SHARE, TURNS = (5, 2, 1), 1.5, 2
#: Blocks that a corpus has at least where whole documents are taken; a small one has blocks of fewer words. Bits of a part of a document.
LEAST_BLOCKS, BITS = 10_000, 30
#: Rows of (document, copies) that may be broadcast (about 40 bytes each); more of them join by shuffle.
BROADCAST = 500_000


def hash32(salt: str, of: str = "doc_id"):
    """32 bits of md5 over the seed, a salt and a column, as a long: a hash that any SQL engine can repeat."""
    text = F.concat(F.lit(f"{SEED}{salt}"), F.coalesce(F.col(of).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_key():
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, turns: int = TURNS) -> DataFrame:
    """(source, key, source_size, place, target): targets by water-filling.

    A source's target is its weight's share of what the sources below their limit (``turns`` times their size)
    have left, or that limit. With the sources in order of limit / weight, the first j stand at their limits
    where j is the least number for which the next source's share does not exceed its limit.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    level = Window.orderBy("ratio", "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    filled = (
        sized.groupBy("source", "key")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("weight", weight)
        .withColumn("limit", F.lit(turns) * F.col("source_size"))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("limits", F.sum("limit").over(level.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("left", F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("words", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("rate", (F.lit(share) * F.col("words") - F.coalesce("limits", F.lit(0))) / F.col("left"))
        .withColumn("below", F.col("rate") * F.col("weight") <= F.col("limit"))
    )
    rate = F.min(F.when(F.col("below"), F.struct("ratio", "place", "rate"))).over(Window.partitionBy())["rate"]
    reached = F.coalesce(F.least(F.col("limit").cast("double"), rate * F.col("weight")), F.col("limit").cast("double"))
    return filled.withColumn("target", reached).select("source", "key", "source_size", "place", "target")


def apportion(parties: DataFrame, group: list[str], claim: str, seats: str, order: str, out: str) -> DataFrame:
    """Sainte-Lague: deal ``seats`` (a column, equal within a group) by the highest quotients claim / (2 k + 1).

    Only quotients near the cut are ranked. At divisor total / (seats - n) the rounded claims of n parties are
    too few by up to 1.5 n seats, at total / (seats + n) too many, and both sets are ones of highest quotients;
    so the seats below the first are safe, those beyond the second lose, and about 3 n quotients lie between.
    """
    whole = Window.partitionBy(*group)
    at = lambda divisor: F.floor(F.col(claim) / divisor + 0.5).cast("long")
    bounded = (
        parties.withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn("_sum", F.sum(claim).over(whole))
        .withColumn("_few", F.when((F.col(seats) > F.col("_n")) & (F.col("_sum") > 0), at(F.col("_sum") / (F.col(seats) - F.col("_n")))).otherwise(0))
        .withColumn("_many", F.when((F.col(seats) > 0) & (F.col("_sum") > 0), at(F.col("_sum") / (F.col(seats) + F.col("_n"))) + 1).otherwise(0))
        .withColumn("_open", F.col(seats) - F.sum("_few").over(whole))
    )
    ranked = Window.partitionBy(*group).orderBy(F.desc("_quotient"), order, "_k")
    won = (
        bounded.filter(F.col("_many") > F.col("_few"))
        .select(*group, order, claim, "_open", F.explode(F.sequence(F.col("_few"), F.col("_many") - 1)).alias("_k"))
        .withColumn("_quotient", F.col(claim) / (2 * F.col("_k") + 1))
        .filter((F.col("_quotient") > 0))
        .withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") <= F.col("_open"))
        .groupBy(*group, order)
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    keys = list(dict.fromkeys([*group, order]))
    quota = F.col("_few") + F.coalesce("_won", F.lit(0))
    return bounded.join(won, keys, "left").withColumn(out, quota).drop("_n", "_sum", "_few", "_many", "_open", "_won")


def deal_again(pieces: DataFrame, block: int) -> DataFrame:
    """``pieces`` (key, shard, words, blocks, quota) with the whole blocks dealt again that a source has lost.

    Pieces lose what is beyond TURNS times their words. That goes to the source's pieces by the room that each has
    left, in cumulative whole shares: none gets more than its room, and all is dealt as far as there is room.
    """
    whole = Window.partitionBy("key")
    share = lambda upto: F.expr(f"cast(_lost as decimal(19,0)) * cast({upto} as decimal(19,0)) div _rooms")
    return (
        pieces.withColumn("_room", TURNS * F.col("words") - F.col("quota"))
        .withColumn("_rooms", F.sum("_room").over(whole))
        .withColumn("_upto", F.sum("_room").over(whole.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_taken", F.sum("quota").over(whole))
        .withColumn("_lost", F.least(F.expr(f"(blocks * {block} - _taken) div {block} * {block}"), F.col("_rooms")))
        .withColumn("quota", F.col("quota") + F.when(F.col("_lost") > 0, share("_upto") - share("_upto - _room")).otherwise(0))
        .drop("_room", "_rooms", "_upto", "_taken", "_lost")
    )


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")


def _words(sized: DataFrame) -> int:
    return sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]  # one number


def _laid(sized: DataFrame, of: str, block: int, shard_words: int) -> DataFrame:
    """``sized`` (source, key, size and a column ``of`` that tells documents apart) with source_size, target and taken.

    The blocks are dealt to the sources and their shards and laid on the shards' rings; taken is what they hold of a document.
    """
    words = _words(sized)
    shards = max(1, min(MOST_SHARDS, -(-words // shard_words)))
    targets = materialise(source_targets(sized), "targets")
    blocks = targets.withColumn("_blocks", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    quotas = apportion(blocks, [], "target", "_blocks", "place", "blocks").select("key", "source_size", "place", "target", "blocks")
    placed = sized.withColumn("shard", hash32("s", of) % shards)
    pieces = placed.groupBy("key", "shard").agg(F.sum("size").alias("words")).join(quotas, "key")
    pieces = apportion(pieces, ["place"], "words", "blocks", "shard", "quota").withColumn("quota", F.least(F.col("quota") * block, TURNS * F.col("words")))
    pieces = materialise(
        deal_again(pieces, block)
        .withColumn("turns", F.when(F.col("words") > 0, F.expr("quota div words")).otherwise(0))
        .withColumn("rest", F.when(F.col("words") > 0, F.expr("quota % words")).otherwise(0))
        .withColumn("places", F.greatest(F.lit(1), F.ceil(F.col("words") / block).cast("long")))
        .withColumn("start", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), "place", "shard")), 1, 8), 16, 10).cast("long") % F.col("places") * block)
        .select("key", "shard", "source_size", "target", "words", "turns", "rest", "start"),
        "pieces",
    )
    line = Window.partitionBy("key", "shard").orderBy("order", of, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.withColumn("order", hash32("o", of)).withColumn("_end", F.sum("size").over(line)).withColumn("_begin", F.col("_end") - F.col("size"))
    joined = laid.join(pieces, ["key", "shard"])
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(F.col("_end"), b) - F.greatest(F.col("_begin"), a))
    last = F.col("start") + F.col("rest")
    taken = (
        F.col("turns") * F.col("size")
        + overlap(F.col("start"), last)
        + F.when(last > F.col("words"), overlap(F.lit(0), last - F.col("words"))).otherwise(0)
    )
    return joined.withColumn("taken", taken.cast("long"))


def mix(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, and the source's key.

    size is the number of words (null text: 0); sources stand in code-point order, null last and a source like
    any other. A document is taken whole at most TURNS times. Rows that repeat a doc_id stay separate documents; a
    null doc_id is one like any other. Everything follows from the rows alone, so reruns agree. Texts are counted
    whole; a table without rows gives none. Other columns of ``docs`` are not read, whatever their names.
    """
    sized = materialise(
        docs.select("doc_id", "source", source_key().alias("key"), _size()),
        "sizes",
    )
    return _laid(sized, "doc_id", block, shard_words).select("doc_id", "size", "source_size", "target", "taken", "key")


def _copies(sized: DataFrame) -> DataFrame:
    """(key, size, mark, rows, copies) of ``sized`` (source, key, size, mark, rows): whole documents to meet the targets.

    Equal rows are one stretch of their shard's ring. What the blocks hold of it makes whole copies but for a rest, at
    most at the two ends of the shard's blocks. The rests are carried along each source, from the shortest cut document
    to the longest, from a seeded begin; a document whose rest passes a whole number is taken once more. So what the
    rounding adds or takes is no more words than the source's longest cut document has, however many shards there are.
    """
    wide = sized.withColumnRenamed("size", "each").withColumn("size", F.col("each") * F.col("rows"))
    block = max(1, min(BLOCK, _words(wide) // LEAST_BLOCKS))
    taken = _laid(wide, "mark", block, SHARD_WORDS).filter("taken > 0").select("key", F.col("each").alias("size"), "mark", "rows", "taken")
    taken = materialise(taken, "taken")
    line = Window.partitionBy("key").orderBy("size", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.expr(f"shiftleft(taken % size, {BITS}) div size")
    begin = hash32("c", "key") % (1 << BITS)
    upto = begin + F.sum("part").over(line)
    cut = taken.filter("taken % size > 0").withColumn("part", part).withColumn("upto", upto)
    more = F.shiftright("upto", BITS) - F.shiftright(F.col("upto") - F.col("part"), BITS)
    both = cut.withColumn("more", more).drop("part", "upto").unionByName(taken.filter("taken % size = 0").withColumn("more", F.lit(0).cast("long")))
    return both.select("key", "size", "mark", "rows", (F.expr("taken div size") + F.col("more")).cast("int").alias("copies"))


def mix_rows(docs: DataFrame) -> DataFrame:
    """The mix as rows of ``docs``, all columns: every document 0, 1 or 2 times, so that each source meets its target.

    The blocks are those of ``mix``, Sainte-Lague's, laid on the shards' rings; a document that they cut is taken whole or
    not. Documents without words, null texts among them, are left out. Rows that agree in all columns are told apart by
    nothing, so one of them stands for all; columns of kinds that have no hash are not compared. Columns of any name
    stay as they are; a table without rows gives none.
    """
    of = ["key", "size", "mark"]
    compared = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    mark = F.xxhash64(F.lit(SEED), F.array(*(c.isNull() for c in compared)), *compared).alias("mark")
    sized = docs.select("source", source_key().alias("key"), _size(), mark)
    sized = materialise(sized.groupBy("source", *of).agg(F.count(F.lit(1)).alias("rows")), "sizes")
    often = materialise(_copies(sized).filter("copies > 0"), "copies")
    rows = docs.select(F.struct("*").alias("row"), source_key().alias("key"), _size(), mark)
    found = rows.join(bounded_broadcast(often, often.count(), BROADCAST), of)
    if not (several := often.filter("rows > 1")).isEmpty():
        equal = rows.join(bounded_broadcast(several, several.count(), BROADCAST), of).dropDuplicates(of)
        found = found.filter("rows = 1").unionByName(equal)
    return found.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
