"""Near-duplicate detection with bottom-k sketches.

A document is the set of its distinct shingles under one 64-bit hash. Documents with equal sets form a class, and
everything from there on is about classes, so thousands of copies cost as much as one.

1. A class's sketch is its K smallest hashes. An inverted list holds the classes that retain a value.
2. A pair may only be linked if its sketches share OVERLAP of their values (five and a half standard deviations below
   what a similarity of 0.75 gives). So it shares one of each side's rarest K - OVERLAP * K + 1 values, and only those
   are listed; most documents retain so many values of their own that none of the listed ones is shared.
3. Lists of up to LIST classes give their pairs; the sketch of the union, made from both sketches, estimates each
   pair's similarity, and the pairs that can reach 0.75 go on to be checked.
4. A class that has a longer list among its rarest values is crowded. A pair of a crowded and another class was found in
   the other's short lists; pairs of crowded classes are found from whole sets: a pair with similarity 0.75 shares one
   of the rarest seventh of the smaller set's shingles and the rarest quarter of the larger's. In a long list of those,
   all members are measured against its most typical one, which links most of a group of near copies in linear work;
   what is measured also bounds the similarity of the other pairs, and few of those remain to be checked.
5. Links are confirmed by the exact similarity of whole sets, hashed by a second function that shares nothing with
   the first, so a pair is only linked if it is similar under both; connected components follow from the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, few_tasks, lean, materialise, temporary
from .components import components
from .hashing import Spans, groups, joined, mixed, runs

#: Words in a shingle, similarity in hundredths, values in a sketch, share of a sketch that a pair must have in common.
WORDS, PERCENT, K, OVERLAP = 5, 75, 64, 0.45
#: Classes in a list that gives all its pairs; rounds over longer ones; rows of ids that may be broadcast (16 bytes each).
LIST, ROUNDS, BROADCAST = 64, 2, 500_000

_FACTORS, _OTHER_FACTORS = mixed(np.arange(1, 2 * WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, WORDS) | np.uint64(1)
#: The function that links are confirmed with.
SECOND = 1


def shingle_sets(texts: list[str | None], seed: int = 0) -> Iterator[np.ndarray]:
    """For each text its distinct hashed shingles, ascending; none without words, one with fewer words than a shingle."""
    factors = _OTHER_FACTORS if seed else _FACTORS
    whole = [t or "" for t in texts]
    for begin, end in groups(whole):
        codes, begins = joined(whole[begin:end])
        codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint32)
        starts, ends = runs((codes != 32) & ((codes < 9) | (codes > 13)))
        words = Spans(codes, seed).hash(starts, ends)
        bounds = np.searchsorted(starts, begins)
        rolled = np.zeros(len(words), np.uint64)
        if len(words) >= WORDS:
            n = len(words) - WORDS + 1
            for k in range(WORDS):
                rolled[:n] += words[k : k + n] * factors[k]
            rolled = mixed(rolled)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= WORDS:
                yield np.unique(rolled[a : b - WORDS + 1])
            elif b > a:
                yield mixed(np.array([(words[a:b] * factors[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield rolled[:0]


def set_name(values: np.ndarray) -> bytes | None:
    """128 bits that stand for a set of hashes; None for the empty set."""
    if not len(values):
        return None
    return mixed(values + _FACTORS[0]).sum().tobytes() + np.bitwise_xor.reduce(mixed(values ^ _FACTORS[1])).tobytes()


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _texts(batch: pa.RecordBatch, most: int = 500) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for at in range(0, batch.num_rows, most):
        some = batch.slice(at, most)
        yield some, some.column("text").to_pylist()


def _sketch_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some, texts in _texts(batch):
            sizes, names, sketches = [], [], []
            for values in shingle_sets(texts):
                sizes.append(len(values))
                names.append(set_name(values))
                sketches.append(values[:K].copy())
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), _lists(sketches)], ["doc_id", "n", "name", "sketch"])


def _same_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the rows whose text has the set that the row names."""
    for batch in batches:
        for some, texts in _texts(batch):
            same = [set_name(v) == n.as_py() for v, n in zip(shingle_sets(texts), some.column("name"), strict=True)]
            yield some.select(["c", "text"]).filter(pa.array(same))


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some, texts in _texts(batch, 100):
            sets = list(shingle_sets(texts))
            sizes = np.array([len(v) for v in sets])
            rows = [np.repeat(np.array(some.column("c")), sizes), np.concatenate(sets).view(np.int64), np.repeat(sizes, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], ["c", "v", "n"])


def _estimate_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose sketches allow the similarity."""
    for batch in batches:
        good = []
        for a, b, na, nb in zip(batch.column("sa"), batch.column("sb"), batch.column("na").to_pylist(), batch.column("nb").to_pylist(), strict=True):
            a, b = (np.asarray(x.values).view(np.uint64) for x in (a, b))
            common = np.intersect1d(a, b, assume_unique=True)
            union = len(a) + len(b) - len(common)
            if na <= K and nb <= K:
                good.append(100 * len(common) >= PERCENT * union)
                continue
            size = min(K, union)
            last = np.partition(np.union1d(a, b), size - 1)[size - 1]
            good.append(np.count_nonzero(common <= last) >= OVERLAP * size)
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def _verify_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose whole sets are similar enough."""
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            batch = whole.slice(at, 200)
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            texts = dict(zip(a, batch.column("ta").to_pylist(), strict=True)) | dict(zip(b, batch.column("tb").to_pylist(), strict=True))
            sets = dict(zip(texts, (v.copy() for v in shingle_sets(list(texts.values()), SECOND)), strict=True))
            good = [_linked(sets[x], sets[y]) for x, y in zip(a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _ordered(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _similar_sizes(x: str, y: str):
    return F.col(x) * 100 >= F.col(y) * PERCENT


def _short_list_pairs(postings: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes in a list of (v, c, n, f) with f up to LIST; ``short`` marks the entries of the smaller side."""
    left = postings.filter(F.col("f") <= LIST)
    right = left.select("v", F.col("c").alias("d"), F.col("n").alias("m"))
    fits = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("c") < F.col("d")))
    return left.filter("short").join(right, "v").filter(fits & _similar_sizes("n", "m")).select(*_ordered(F.col("c"), F.col("d"))).distinct()


class _Classes:
    """The classes (c, name, rep, n, sketch) of a table of documents."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        self.rows = materialise(docs.select("doc_id", "text").mapInArrow(lean(_sketch_part), "doc_id long, n long, name binary, sketch array<long>"), "sketches")
        grouped = self.rows.filter("name is not null").groupBy("name").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        self.table = materialise(grouped.withColumn("c", F.monotonically_increasing_id()), "classes")

    def listed(self) -> DataFrame:
        """(v, c, n, f): the inverted lists of each class's rarest values; f classes retain v, at least two."""
        retained = self.table.select("c", F.col("n"), F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
        with temporary() as made:
            often = materialise(retained.groupBy("v").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "often")
            by_class = Window.partitionBy("c")
            rank = F.row_number().over(by_class.orderBy("f", "v")) + F.col("s") - F.count(F.lit(1)).over(by_class)
            rarest = F.col("s") - F.ceil(F.lit(OVERLAP) * F.col("s")) + 1
            made.keep(out := materialise(retained.join(often, "v").withColumn("rank", rank).filter(F.col("rank") <= rarest).select("v", "c", "n", "f"), "listed"))
        return out

    def estimated(self, pairs: DataFrame) -> DataFrame:
        side = lambda k: self.table.select(F.col("c").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lean(_estimate_part), "a long, b long")

    def texts(self, wanted: DataFrame) -> DataFrame:
        """(c, text) of the classes in wanted (c), from one document each."""
        key = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
        named = materialise(self.table.select("c", "name", key(F.col("rep")).alias("key")).join(wanted, "c"), "wanted")
        named = bounded_broadcast(named, named.count(), BROADCAST)
        found = self.docs.select(key(F.col("doc_id")).alias("key"), "text").join(named, "key").select("c", "name", "text")
        return materialise(found.mapInArrow(lean(_same_set), "c long, text string").dropDuplicates(["c"]), "texts")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    side = lambda k: texts.select(F.col("c").alias(k), F.col("text").alias(f"t{k}"))
    return materialise(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lean(_verify_part), "a long, b long"), "links")


def _leader_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles a member has in common with a leader, how many of those are in long lists, and whether they are linked."""
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            batch = whole.slice(at, 200)
            c, d = batch.column("c").to_pylist(), batch.column("d").to_pylist()
            texts = dict(zip(c, batch.column("tc").to_pylist(), strict=True)) | dict(zip(d, batch.column("td").to_pylist(), strict=True))
            sets = dict(zip(texts, (v.copy() for v in shingle_sets(list(texts.values()))), strict=True))
            others = dict(zip(texts, (v.copy() for v in shingle_sets(list(texts.values()), SECOND)), strict=True))
            out: tuple[list, list, list] = ([], [], [])
            for x, y, often in zip(c, d, batch.column("often"), strict=True):
                common = np.intersect1d(sets[x], sets[y], assume_unique=True)
                out[0].append(len(common))
                out[1].append(int(np.isin(common, np.asarray(often.values).view(np.uint64)).sum()))
                out[2].append(_linked(others[x], others[y]))
            columns = [batch.column("c"), batch.column("d"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["c", "d", "common", "inside", "linked"])


class _Crowd:
    """Whole sets of crowded classes, and the lists of the rarest part of each.

    sets: (c, v, n); often: (v, f) with f > 1; postings: (v, c, n, f, short, hot), where short marks the entries of
    the smaller side of a pair and hot is how many shingles of the class are in long lists.
    """

    def __init__(self, texts: DataFrame):
        self.texts = texts
        self.sets = materialise(texts.mapInArrow(lean(_whole_sets), "c long, v long, n long"), "sets")
        self.often = materialise(self.sets.groupBy("v").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "often")
        by_class = Window.partitionBy("c")
        rank = F.row_number().over(by_class.orderBy("f", "v")) + F.col("n") - F.count(F.lit(1)).over(by_class)
        larger = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
        # |A & B| >= 0.75 / 1.75 * (|A| + |B|), and |B| >= |A| for the smaller side A.
        smaller = F.col("n") - F.ceil(F.col("n") * (2 * PERCENT) / (100 + PERCENT)) + 1
        hot = F.sum(F.when(F.col("f") > LIST, 1).otherwise(0)).over(by_class)
        ranked = self.sets.join(self.often, "v").withColumn("hot", hot).withColumn("rank", rank)
        self.postings = materialise(ranked.filter(F.col("rank") <= larger).select("v", "c", "n", "f", (F.col("rank") <= smaller).alias("short"), "hot"), "postings")

    def measured(self, pairs: DataFrame) -> DataFrame:
        """(c, d, common, inside, linked) for pairs (c, d) of a member and a leader."""
        leaders = pairs.select(F.col("d").alias("c")).distinct()
        long_ones = self.sets.join(leaders, "c").join(self.often.filter(F.col("f") > LIST), "v").groupBy(F.col("c").alias("d")).agg(F.collect_list("v").alias("often"))
        led = self.texts.select(F.col("c").alias("d"), F.col("text").alias("td")).join(long_ones, "d")
        led = materialise(led, "leaders")
        member = self.texts.select("c", F.col("text").alias("tc"))
        return materialise(pairs.join(led, "d").join(member, "c").mapInArrow(lean(_leader_part), "c long, d long, common long, inside long, linked boolean"), "measured")


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))


def _leaders(lists: DataFrame, round_: int, rows: int) -> DataFrame:
    """(v, d): each list's most typical member outside the components of its earlier leaders."""
    earlier = F.lit(True)
    for r in range(round_):
        earlier = earlier & (F.col("root") != F.col(f"root{r}"))
    typical = F.struct((F.col("hot") / F.col("n")).alias("part"), F.negative("c").alias("c"))
    return materialise(few_tasks(lists.filter(earlier).groupBy("v").agg(F.max(typical).alias("x")).select("v", F.negative("x.c").alias("d")), rows), "leaders")


def _long_list_links(crowd: _Crowd, links: DataFrame) -> DataFrame:
    """(node, root): the components with the links that only long lists of ``crowd`` lead to, beside ``links``.

    In every round all members of a list are measured against a leader; lists in one component are done. For the
    pairs left, what two members have in common is bounded by what each has in common with a leader, plus what each
    has in other long lists (a pair with a value of a short list in common was found there). Only pairs that could
    still be linked, from different components, are checked.
    """
    roots = components(links.toDF("u", "v"))
    lists = crowd.postings.filter(F.col("f") > LIST).drop("f")
    rows = lists.count()  # later ones are parts of them
    for round_ in range(ROUNDS):
        placed = _with_roots(lists, roots)
        for r in range(round_):
            placed = placed.join(roots.select(F.col("node").alias(f"d{r}"), F.col("root").alias(f"root{r}")), f"d{r}", "left").withColumn(f"root{r}", F.coalesce(f"root{r}", f"d{r}"))
        placed = materialise(few_tasks(placed, rows), "placed")
        several = materialise(few_tasks(placed.groupBy("v").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("v"), rows), "several")
        placed = placed.join(several, "v")
        leaders = _leaders(placed, round_, rows)
        if leaders.isEmpty():
            lists = lists.join(several, "v")
            break
        led = materialise(few_tasks(placed.join(leaders, "v"), rows), "led")
        facts = crowd.measured(materialise(few_tasks(led.filter("c <> d").select("c", "d").distinct(), rows), "pairs"))
        found = facts.filter("linked").select(F.col("c").alias("u"), F.col("d").alias("v"))
        if not found.isEmpty():
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(found))
        own = led.drop("root", *(f"root{r}" for r in range(round_))).join(facts.drop("linked"), ["c", "d"], "left")
        common, other = F.coalesce("common", "n"), F.col("hot") - F.coalesce("inside", "hot")
        own = own.withColumn(f"common{round_}", common).withColumn(f"other{round_}", other).withColumnRenamed("d", f"d{round_}").drop("common", "inside")
        lists = materialise(few_tasks(own, rows), "lists")
    measured = [c[6:] for c in lists.columns if c.startswith("common")]
    placed = materialise(few_tasks(_with_roots(lists, roots), rows), "placed")
    renamed = {c: f"{c}_" for c in placed.columns if c != "v"}
    can = F.expr("root <> root_ and (n < n_ or (n = n_ and c < c_))") & _similar_sizes("n", "n_")
    for r in measured:
        most = F.least(f"common{r}", f"common{r}_") + F.least(f"other{r}", f"other{r}_")
        can = can & (most * (100 + PERCENT) >= (F.col("n") + F.col("n_")) * PERCENT)
    pairs = placed.filter("short").join(placed.withColumnsRenamed(renamed), "v").filter(can).select(*_ordered(F.col("c"), F.col("c_"))).distinct()
    found = _verified(materialise(pairs, "pairs"), crowd.texts)
    if found.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(found.toDF("u", "v")))


def near_links(docs: DataFrame) -> tuple[_Classes, DataFrame]:
    """The classes of ``docs`` and (node, root): the component of every class that has a link."""
    classes = _Classes(docs)
    with temporary() as made:
        listed = classes.listed()
        short = materialise(_short_list_pairs(listed.withColumn("short", F.lit(True))), "pairs")
        estimated = materialise(classes.estimated(short), "estimated")
        crowded = materialise(listed.filter(F.col("f") > LIST).select("c").distinct(), "crowded")
        made.keep(estimated, crowded)
    ends = estimated.select(F.explode(F.array("a", "b")).alias("c")).unionAll(crowded).distinct()
    texts = classes.texts(ends)
    links = _verified(estimated, texts)
    if crowded.isEmpty():
        return classes, components(links.toDF("u", "v"))
    crowd = _Crowd(materialise(texts.join(crowded, "c", "left_semi"), "crowded_texts"))
    more = materialise(_short_list_pairs(crowd.postings).join(estimated, ["a", "b"], "left_anti"), "more")
    return classes, _long_list_links(crowd, links.unionAll(_verified(more, crowd.texts)))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    A null text is empty; a document without words has no shingles and is linked with nothing, so it is its own
    component. component_id is the smallest doc_id that links reach; null ids come after all others, and a component
    without any id has none. Rows that repeat the component's id are all kept. Whole texts are read; columns other
    than doc_id and text are not. A table without rows gives none.
    """
    with temporary() as made:
        classes, roots = near_links(docs)
        placed = materialise(_with_roots(classes.table.select("c", "name", "rep"), roots), "placed")
        least = materialise(placed.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
        named = materialise(placed.join(least, "root").select("name", "component_id"), "components")
        made.keep(classes.rows, named)
    rows = classes.rows.select("doc_id", "n", "name")
    component = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(named, "name", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one_of_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of which near_groups keeps the document: one of each component.

    An id that several rows carry stays if near_groups keeps one of them; so do rows without an id whose component
    has none, and documents without words. Texts are read whole; a table without rows gives none; columns of any
    name stay as they are.
    """
    key = lambda: F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("key")
    with temporary() as made:
        dropped = near_groups(docs).groupBy(key()).agg(F.max("kept").alias("kept")).filter("not kept").select("key")
        made.keep(dropped := materialise(dropped, "dropped"))
    rows = docs.select(F.struct("*").alias("row"), key())
    return rows.join(bounded_broadcast(dropped, dropped.count(), BROADCAST), "key", "left_anti").select("row.*")
