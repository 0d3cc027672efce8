"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and the beginnings of longer words, hashed; each counts once. Beside a weight, every
term has a small vector, and the product of two terms' vectors is the weight of their occurring together, which lets
a score depend on pairs (an insult and whom it is aimed at) that single weights miss. The machine is trained on the
driver from a bounded sample of labelled rows; every text is then scored where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean
from .hashing import Spans, groups, joined, letters, mixed, runs

#: Lengths of words' beginnings that are terms too.
BEGINNINGS = (4, 5)
#: Labelled rows to train on, of each label at most; least chi-squared of a term and of a pair (there are far more pairs).
SAMPLE, LEAST_CHANCE, PAIR_CHANCE = 3000, 15.0, 40.0
#: Texts, and terms, whose pairs are counted at once.
PAIRED = 256
#: Size of the vectors; rounds, step and penalties (weights, vectors) of the training.
FACTORS, EPOCHS, STEP, PENALTY, VECTOR_PENALTY = 4, 12, 0.1, 2e-4, 2e-3
THRESHOLD = 0.7


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1. A null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def terms_of(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, owner, term) for groups of texts: each text's hashed terms, once each, as sorted pairs of arrays."""
    for begin, end in groups(texts, 250_000):
        codes, begins = joined([t.lower() for t in texts[begin:end]])
        starts, ends = runs(letters()[codes])
        spans = Spans(codes)
        hashed, at = [spans.hash(starts, ends)], [starts]
        for length in BEGINNINGS:
            longer = starts[ends - starts > length]
            hashed.append(mixed(spans.hash(longer, longer + length) + np.uint64(length)))
            at.append(longer)
        owner = np.searchsorted(begins, np.concatenate(at), side="right") - 1
        # 40 bits of a term's hash below the text's number: one sort gives each text's distinct terms.
        keys = np.unique(owner.astype(np.uint64) << np.uint64(40) | np.concatenate(hashed) >> np.uint64(24))
        yield begin, (keys >> np.uint64(40)).astype(np.int64), keys & np.uint64((1 << 40) - 1)


def telling_terms(documents: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """The terms whose occurrence depends on the label beyond chance (chi-squared), alone or in a pair, sorted."""
    if not documents:
        return np.zeros(0, np.uint64)
    terms, of = np.unique(np.concatenate(documents), return_inverse=True)
    lengths = [len(d) for d in documents]
    label = np.repeat(toxic, lengths)
    both = np.bincount(of, label, len(terms))
    one, n, positive = np.bincount(of, minlength=len(terms)), len(toxic), toxic.sum()
    off = np.maximum(np.abs(n * both - one * positive) - n / 2, 0)
    chance = n * off**2 / np.maximum(one * (n - one) * positive * (n - positive), 1)
    telling = chance >= LEAST_CHANCE
    telling[telling_pairs(of, np.repeat(np.arange(n), lengths), toxic, one, both)] = True
    return terms[telling]


def telling_pairs(of: np.ndarray, owner: np.ndarray, toxic: np.ndarray, one: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Places of the terms that are in a pair which depends on the label beyond what either of its terms says.

    A pair is held against the rates of toxic texts among all texts and among those with each of its terms; the least
    of the three chi-squared counts. A pair in k texts has at most k (1 - rate) / rate, or k rate / (1 - rate) on the
    clean side, so terms that are in too few texts of a label for that can't be in such a pair and aren't paired.
    """
    n, rate = len(toxic), toxic.mean()
    if not 0 < rate < 1:
        return np.zeros(0, np.int64)
    able = np.flatnonzero((both * (1 - rate) / rate >= PAIR_CHANCE) | ((one - both) * rate / (1 - rate) >= PAIR_CHANCE))
    place = np.full(len(one), -1)
    place[able] = np.arange(len(able))
    kept = place[of] >= 0
    rows, columns = owner[kept], place[of[kept]]
    share, told = (both / one)[able], np.zeros(len(able), bool)
    for begin in range(0, len(able), PAIRED):
        width = min(PAIRED, len(able) - begin)
        count, bad = np.zeros((2, width, len(able)), np.float32)
        for first in range(0, n, PAIRED):  # dense counts of some texts and some terms at once
            some = slice(*np.searchsorted(rows, (first, first + PAIRED)))
            x = np.zeros((min(PAIRED, n - first), len(able)), np.float32)
            x[rows[some] - first, columns[some]] = 1
            y = x[:, begin : begin + width].T
            count += y @ x
            bad += (y * toxic[first : first + PAIRED].astype(np.float32)) @ x
        least = np.full(count.shape, np.inf, np.float32)
        for r in (rate, share[begin : begin + width, None], share[None, :]):
            off = np.maximum(np.abs(bad - count * r) - 0.5, 0)
            np.minimum(least, off * off / np.maximum(count * r * (1 - r), 1e-6), out=least)
        least[np.arange(width), np.arange(begin, begin + width)] = 0
        a, b = np.nonzero(least >= PAIR_CHANCE)
        told[begin + a] = told[b] = True
    return able[told]


class Machine:
    """score = logistic(bias + sum of weights + sum over pairs of the vectors' products)."""

    def __init__(self, documents: list[np.ndarray], toxic: np.ndarray):
        self.terms = telling_terms(documents, toxic)
        rows = [self.known(d) for d in documents]
        draw = np.random.default_rng(11)
        n = len(self.terms)
        self.bias, self.weights = 0.0, np.zeros(n)
        self.vectors = draw.standard_normal((n, FACTORS)) * 0.01
        past_w, past_v, past_b = np.full(n, 1e-2), np.full((n, FACTORS), 1e-2), 1e-2
        class_weight = np.where(toxic, 0.5 / max(toxic.mean(), 1e-9), 0.5 / max(1 - toxic.mean(), 1e-9)) if len(toxic) else toxic
        for _ in range(EPOCHS):
            for i in draw.permutation(len(rows)):
                own = rows[i]
                v = self.vectors[own]
                total = v.sum(0)
                raw = self.bias + self.weights[own].sum() + 0.5 * ((total * total).sum() - (v * v).sum())
                g = class_weight[i] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - toxic[i])
                past_b += g * g
                self.bias -= STEP * g / np.sqrt(past_b)
                if not len(own):
                    continue
                gw = g + PENALTY * self.weights[own]
                gv = g * (total - v) + VECTOR_PENALTY * v
                past_w[own] += gw * gw
                past_v[own] += gv * gv
                self.weights[own] -= STEP * gw / np.sqrt(past_w[own])
                self.vectors[own] -= STEP * gv / np.sqrt(past_v[own])

    def known(self, terms: np.ndarray) -> np.ndarray:
        """Places of the terms that the machine knows."""
        at = np.searchsorted(self.terms, terms)
        return at[self.terms[np.minimum(at, len(self.terms) - 1)] == terms] if len(self.terms) else at[:0]

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for first, owner, terms in terms_of(texts):
            if not len(self.terms):
                continue
            at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
            known = self.terms[at] == terms
            owner, at = owner[known], at[known]
            if not len(owner):
                continue
            n = int(owner[-1]) + 1
            raw = np.bincount(owner, self.weights[at], n)
            for f in range(FACTORS):
                v = self.vectors[at, f]
                raw += 0.5 * (np.bincount(owner, v, n) ** 2 - np.bincount(owner, v * v, n))
            out[first : first + n] += raw
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """Train on the labelled documents that aren't held out, at most ``sample`` of each label, chosen by a hash of their ids.

    Of a document's several labels the largest counts; null labels and labels other than 0 and 1 don't. The sample's
    ids, 2 * sample at most, are broadcast to find the texts. None if there is no labelled text.
    """
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = F.xxhash64("doc_id", F.lit("toxic"))
    chosen = [known.filter(F.col("toxic") == k).orderBy(drawn, "doc_id").limit(sample) for k in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id")
    # Of an id's several rows one counts, combined where they lie, so the driver gets 2 * sample rows at most.
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            held: list[bytes] = [b""] * len(texts)
            for first, owner, terms in terms_of(texts):
                cuts = np.searchsorted(owner, np.arange(owner[-1] + 2)) if len(owner) else [0]
                for k in range(len(cuts) - 1):
                    held[first + k] = terms[cuts[k] : cuts[k + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(held, pa.binary())], ["doc_id", "toxic", "terms"])

    rows = rows.select("doc_id", F.col("toxic").cast("int"), "text").mapInArrow(lean(part), "doc_id long, toxic int, terms binary").collect()
    rows = sorted((r["doc_id"], r["toxic"], bytes(r["terms"])) for r in rows)
    if not rows:
        return None
    return Machine([np.frombuffer(r[2], np.uint64) for r in rows], np.array([float(r[1]) for r in rows]))


def score_toxicity(docs: DataFrame, labels: DataFrame, model: Machine | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Whole texts are scored; null and empty texts have no terms and get the score of the bias alone. Without any
    label to learn from all scores are 0. Repeated rows score alike, and of those with one doc_id one is learned from.
    Texts are read whole; a table without rows gives none; columns other than doc_id, text, toxic are not read,
    whatever their names.
    """
    model = model or train(docs, labels)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            score = model.scores(texts) if model else np.zeros(len(texts))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(lean(part), "doc_id long, held_out boolean, score double, predicted int")
