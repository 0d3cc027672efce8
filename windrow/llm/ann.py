"""Approximate nearest neighbours by a hash-prefix forest (cosine).

A tree gives every vector a long string of bits, the signs of its products with random directions, and keeps the
strings sorted, so that the vectors sharing a prefix with a query stand in one stretch of the array. A search goes
down to the longest prefix that any tree shares with the query and then up, in all trees at once, so that the
stretches hold ever more candidates, which are scored exactly.

How far up follows from geometry alone, not from the number of rows: a vector at angle t from the query shares l bits of
a tree's string with probability (1 - t / pi) ** l, so one at the angle of the k-th best found so far is in none of
the trees' stretches with probability (1 - (1 - t / pi) ** l) ** trees, and the search ends at the longest prefixes for
which that is MISS at most. Where vectors cluster, that is a long prefix and few candidates; among unrelated directions the
nearest vectors are hardly nearer than others, and no prefix that keeps them excludes much.

The k-th best is bounded at first by a bounded sample of rows, which every query is held against. The rows are dealt
at random into blocks, each with a forest of its own, and the stated queries go to every block; a task holds one block
of rows and one of queries and gives the k nearest it found for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialise

#: Trees, bits of a string, seed of the directions; the chance that a vector as near as the k-th is in no stretch.
TREES, BITS, SEED, MISS = 80, 32, 7, 0.05
#: Rows that queries are first held against, and their components together, at most.
SAMPLE, SAMPLE_NUMBERS = 16_384, 1 << 21
#: Rows and queries that one task holds, and the components of either together. Smaller tables are dealt into up to
#: SPREAD blocks, so that there is work for as many tasks; what is found depends on MISS, not on the blocks.
BLOCK_ROWS, BLOCK_QUERIES, BLOCK_NUMBERS, LEAST_ROWS, SPREAD = 65_536, 65_536, 1 << 22, 1024, 24
#: Marks (queries times rows) and stretches' entries that are held at once.
MARKS, ENTRIES = 1 << 24, 1 << 22
#: Bits above the last level at which the k-th best is looked at first.
LOOK = 4
#: What rounding may take from a product of unit vectors.
SLACK = 1e-9

FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, without null or non-finite components, and not zero."""
    finite = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors divided by a power of two, so that no square overflows or vanishes, and their norms; cosines stay exactly as they were."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x, np.sqrt((x * x).sum(1))


class Forest:
    """Sorted arrays of hash strings over the rows of x (unit vectors)."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS):
        draw = np.random.default_rng(SEED)
        self.x, self.bits, self.trees = x, bits, trees
        self.planes = draw.standard_normal((trees, x.shape[1], bits))
        self.place = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
        self.order, self.strings = [], []
        for plane in self.planes:
            strings = self.hash(x, plane)
            self.order.append((order := np.argsort(strings, kind="stable")).astype(np.int32))
            self.strings.append(strings[order])

    def hash(self, x: np.ndarray, plane: np.ndarray) -> np.ndarray:
        return (x @ plane > 0) @ self.place

    def longest(self, hashed: list[np.ndarray]) -> np.ndarray:
        """Going down: the bits of the longest prefix that each query shares with any row in any tree."""
        out = np.zeros(len(hashed[0]), np.int64)
        for strings, h in zip(self.strings, hashed, strict=True):
            at = np.searchsorted(strings, h)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(strings) - 1)):
                differ = strings[near] ^ h
                out = np.maximum(out, self.bits - np.frexp(differ.astype(np.float64))[1])
        return out

    def depth(self, cosine: np.ndarray) -> np.ndarray:
        """The bits of all trees' prefixes together, as equal as can be, at which a vector with that cosine to the query
        is in no stretch with chance MISS at most; the most of which that holds."""
        shared = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
        absent = lambda bits: np.log1p(-np.minimum(shared**bits, 1 - 1e-16))
        with np.errstate(divide="ignore"):
            bits = np.log(1 - MISS ** (1 / self.trees)) / np.log(shared)
        level = np.clip(np.nan_to_num(bits, nan=self.bits, posinf=self.bits), 0, self.bits).astype(np.int64)
        # With ``short`` trees at that level and the others a bit deeper the chance is still small enough.
        short = np.ceil((np.log(MISS) - self.trees * absent(level + 1)) / np.minimum(absent(level) - absent(level + 1), -1e-300))
        return np.where(level >= self.bits, self.bits * self.trees, (level + 1) * self.trees - np.clip(np.nan_to_num(short, nan=self.trees), 0, self.trees).astype(np.int64))

    def marked(self, hashed: list[np.ndarray], depth: np.ndarray) -> np.ndarray:
        """Which rows are in the stretch of each query's prefix, in any tree; the prefixes have ``depth`` bits together."""
        mark = np.zeros((len(depth), len(self.x)), bool)
        level, deeper = depth // self.trees, depth % self.trees
        # So short a prefix leaves next to no row out.
        everything = self.trees >= 4 << level.clip(0, 40)
        mark[everything] = True
        rest = np.flatnonzero(~everything)
        for tree, (order, strings, h) in enumerate(zip(self.order, self.strings, hashed, strict=True)):
            drop = (self.bits - level[rest] - (tree < deeper[rest])).astype(np.uint64)
            prefix = h[rest] >> drop
            low = np.searchsorted(strings, prefix << drop)
            length = np.searchsorted(strings, prefix + np.uint64(1) << drop) - low
            ends = np.cumsum(length)
            for a, b in _runs(ends, ENTRIES):
                own, before = length[a:b], ends[a - 1] if a else 0
                places = np.repeat(low[a:b] - (ends[a:b] - own - before), own) + np.arange(own.sum())
                mark[np.repeat(rest[a:b], own), order[places]] = True
        return mark

    def search(self, queries: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, cosines) of the candidates; ``bound`` is below the k-th largest cosine of all rows, as far as known."""
        for at in range(0, len(queries), step := max(1, MARKS // len(self.x))):
            some = queries[at : at + step]
            hashed = [self.hash(some, plane) for plane in self.planes]
            own = bound[at : at + step].copy()
            last = self.depth(own)
            first = np.minimum(self.longest(hashed), last // self.trees + LOOK) * self.trees
            cosines = lambda mark, q: (found := np.flatnonzero(mark[q]), self.x[found] @ some[q])
            mark = self.marked(hashed, first)
            higher = np.flatnonzero(first > last)
            for q in higher:
                _, score = cosines(mark, q)
                if len(score) > k + 1:  # the query itself may be among them
                    own[q] = max(own[q], np.partition(score, -k - 1)[-k - 1] - SLACK)
            last = np.minimum(self.depth(own), first)
            if len(higher := np.flatnonzero(first > last)):
                mark[higher] = self.marked([h[higher] for h in hashed], last[higher])
            mark[mark.sum(1) <= k] = True  # up to the roots where the stretches hold too few; one may be the query itself
            for q in range(len(some)):
                found, score = cosines(mark, q)
                yield at + q, found, score


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges whose lengths, given by their sums, come to about ``most``."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(n, -1)


def search_block(both: pa.Table, k: int) -> pa.Table:
    """The k nearest rows found in one block for each query of one block."""
    ids = both.column("vec_id").to_numpy()
    asked = both.column("asked").to_numpy(zero_copy_only=False)
    vectors = _matrix(both.column("vector"), len(ids))
    row_ids = ids[~asked]
    out = ([], [], [])
    if len(row_ids) and asked.any():
        rows, scale = scaled(vectors[~asked])
        queries, norms = scaled(vectors[asked])
        query_ids, bound = ids[asked], both.column("bound").to_numpy()[asked]
        # An id's several rows count once, so only as many distinct ids bound the k-th.
        several = len(np.unique(row_ids)) < len(row_ids)
        for q, found, rough in Forest(rows / scale[:, None]).search(queries / norms[:, None], bound if not several else np.full(len(bound), -2.0), k):
            other = row_ids[found] != query_ids[q]
            found, rough = found[other], rough[other]
            if len(found) > k and not several:
                # All that may be among the k nearest; the products of equal vectors may differ in their last bits.
                found = found[rough >= np.partition(rough, -k)[-k] - SLACK]
            exact = (rows[found] * queries[q]).sum(1) / (scale[found] * norms[q])
            best = np.lexsort((row_ids[found], -exact))
            kept: dict[int, float] = {}
            for i in best:
                kept.setdefault(int(row_ids[found[i]]), float(exact[i]))
                if len(kept) == k:
                    break
            out[0].extend([int(query_ids[q])] * len(kept))
            out[1].extend(kept)
            out[2].extend(kept.values())
    return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])


def _bounded(queries: DataFrame, sample: pa.Table, k: int) -> DataFrame:
    """``queries`` (vec_id, vector, length) with ``bound``: the k-th largest cosine to the sample's rows, or -2 if they are fewer."""
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    lengths = sample.column("length").to_numpy()
    for n in np.unique(lengths):
        own = sample.filter(pa.array(lengths == n))
        ids, first = np.unique(own.column("vec_id").to_numpy(), return_index=True)
        x, norm = scaled(_matrix(own.column("vector"), len(own))[first])
        by_length[int(n)] = ids, x / norm[:, None]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                bound = np.full(batch.num_rows, -2.0)
                lengths = batch.column("length").to_numpy()
                for n, (ids, unit) in by_length.items():
                    own = np.flatnonzero(lengths == n)
                    if len(own) and len(ids) > k:
                        x, norm = scaled(_matrix(batch.column("vector").take(pa.array(own)), len(own)))
                        cosine = x / norm[:, None] @ unit.T
                        cosine[ids[None, :] == batch.column("vec_id").to_numpy()[own][:, None]] = -2.0
                        bound[own] = np.partition(cosine, -k, axis=1)[:, -k] - SLACK
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound)], [*batch.schema.names, "bound"])

    return queries.mapInArrow(lean(part), "vec_id long, vector array<double>, length int, bound double")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose vec_id is divisible by ``every``.

    Nearest first, ties to the smaller vec_id; a query's own id is no candidate. Vectors that are null, zero or hold
    null or non-finite components, and rows without a vec_id, take no part; vectors of different lengths aren't
    compared. Repeated rows count once, and of an id's several vectors the nearest counts. Components of any size are
    safe. A table without such rows gives none. Other columns are not read, whatever their names.
    """
    vector = F.col("embedding")
    valid = vectors.filter(F.col("vec_id").isNotNull() & usable(vector)).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.size(vector).alias("length"))
    valid = materialise(valid.distinct(), "vectors")
    count, longest = valid.agg(F.count(F.lit(1)), F.max("length")).first()
    double = F.col("vector").cast("array<double>").alias("vector")
    sample = valid.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(max(k + 1, min(SAMPLE, SAMPLE_NUMBERS // (longest or 1)))).select("vec_id", double, "length").toArrow()
    queries = materialise(_bounded(valid.filter(F.col("vec_id") % every == 0).select("vec_id", double, "length"), sample, k), "queries")
    held = max(BLOCK_NUMBERS // (longest or 1), 1)  # vectors of the longest kind
    blocks = max(-(-count // min(BLOCK_ROWS, held)), min(SPREAD, -(-count // LEAST_ROWS)), 1)
    parts = max(-(-count // every // min(BLOCK_QUERIES, held)), 1)
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = valid.schema["vector"].dataType
    dealt = valid.select("vec_id", "vector", "length", spread(blocks).alias("block"), each(parts).alias("part"), F.lit(False).alias("asked"), F.lit(0.0).alias("bound")).unionAll(
        queries.select("vec_id", F.col("vector").cast(kind).alias("vector"), "length", each(blocks).alias("block"), spread(parts).alias("part"), F.lit(True).alias("asked"), "bound")
    )
    found = dealt.groupBy("length", "block", "part").applyInArrow(lambda key, both: search_block(both, k), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if_several = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = if_several.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
