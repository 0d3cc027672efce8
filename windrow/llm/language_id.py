"""Language identification in two steps: the language's family, then the language within it.

Features are hashed character trigrams of the whole text. Linear support vector machines, one against the rest for
each family and one against one for each pair of languages of a family, are trained on the driver from a bounded
sample of labelled rows; every text is then scored where it lies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean
from .hashing import groups, joined, letters, mixed

#: Families of languages by ISO 639-1 code. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
}
#: Hashed features; rows to train on, shared by all languages, but so many of each at least; the training's rounds and penalty.
FEATURES, SAMPLE, EACH, ROUNDS, PENALTY = 4096, 3000, 30, 200, 1e-4
UNDETERMINED = "und"
#: Score from which a document's language counts as told: the machines that chose it agree more likely than not.
LEAST_SCORE = 0.5


def family_of(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), f"only {language}")


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0. A null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the square roots of hashed trigram counts, and whether a text has a letter.

    Trigrams run over lower-case letters; everything else is one kind of gap, and trigrams of gaps alone don't count.
    """
    counts = np.zeros((len(texts), FEATURES), np.float32)
    lettered = np.zeros(len(texts), bool)
    for begin, end in groups(texts, 200_000):
        codes, begins = joined([t.lower() for t in texts[begin:end]])
        is_letter = letters()[codes]
        codes = np.where(is_letter, codes, 0).astype(np.uint64)
        first, second, third = (np.concatenate((np.zeros(2, np.uint64), codes))[k : k + len(codes)] for k in (0, 1, 2))
        hashed = mixed((first * np.uint64(0x110000) + second) * np.uint64(0x110000) + third) % np.uint64(FEATURES)
        some = is_letter | (second > 0)
        owner = np.repeat(np.arange(end - begin), np.diff(begins))
        for k in range(0, end - begin, 64):
            own = slice(begins[k], begins[min(k + 64, end - begin)])
            keys = ((owner[own] - k) * FEATURES + hashed[own].astype(np.int64))[some[own]]
            n = min(64, end - begin - k)
            counts[begin + k : begin + k + n] = np.sqrt(np.bincount(keys, minlength=n * FEATURES)).reshape(n, FEATURES)
        lettered[begin:end] = np.add.reduceat(is_letter, begins[:-1]) > 0
    counts /= np.maximum(np.sqrt((counts * counts).sum(1, keepdims=True)), 1e-9)
    return counts, lettered


def train_machine(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """A linear support vector machine (weights, then the bias) by averaged subgradient steps on the hinge loss."""
    sign = np.where(positive, 1, -1).astype(np.float32)
    weight = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)).astype(np.float32)
    w, mean = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float32)
    for t in range(ROUNDS):
        wrong = sign * (x @ w[:-1] + w[-1]) < 1
        pull = np.where(wrong, sign * weight, np.float32(0))
        step = np.float32(20 / np.sqrt(1 + t))
        w[:-1] += step * (pull @ x - np.float32(PENALTY) * w[:-1])
        w[-1] += step * pull.sum() * np.float32(0.1)
        mean += w
    return mean / ROUNDS


class Hierarchy:
    """The trained machines."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        self.languages = sorted(set(languages))
        of = np.array(languages)
        families = np.array([family_of(x) for x in languages])
        self.families = sorted(set(families.tolist()))
        self.members = [[k for k, l in enumerate(self.languages) if family_of(l) == f] for f in self.families]
        self.pairs = [(a, b) for own in self.members for n, a in enumerate(own) for b in own[n + 1 :]]
        machines = [train_machine(x, families == f) for f in self.families] if len(self.families) > 1 else []
        for a, b in self.pairs:
            own = np.isin(of, (self.languages[a], self.languages[b]))
            machines.append(train_machine(x[own], of[own] == self.languages[a]))
        stacked = np.array(machines, np.float32).reshape(len(machines), -1) if machines else np.zeros((0, FEATURES + 1), np.float32)
        self.weights, self.bias = stacked[:, :-1].T.copy(), stacked[:, -1]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each row's language and a score from 0 to 1."""
        margins = x @ self.weights + self.bias
        several = len(self.families) > 1
        family = margins[:, : len(self.families)].argmax(1) if several else np.zeros(len(x), np.int64)
        sure = 1 / (1 + np.exp(-3 * margins[np.arange(len(x)), family])) if several else np.ones(len(x))
        language = np.array([m[0] for m in self.members])[family]
        offset = len(self.families) if several else 0
        for f, own in enumerate(self.members):
            rows = np.flatnonzero(family == f)
            if len(own) < 2 or not len(rows):
                continue
            votes, least = np.zeros((len(rows), len(self.languages))), np.full((len(rows), len(self.languages)), np.inf)
            for n, (a, b) in enumerate(self.pairs):
                if a in own:
                    m = margins[rows, offset + n]
                    # A machine's vote counts one; its margin only orders languages with equal votes.
                    votes[:, a] += (m >= 0) + 1e-3 * np.tanh(m)
                    votes[:, b] += (m < 0) - 1e-3 * np.tanh(m)
                    least[:, a], least[:, b] = np.minimum(least[:, a], m), np.minimum(least[:, b], -m)
            best = np.array(own)[votes[:, own].argmax(1)]
            language[rows] = best
            sure[rows] *= 1 / (1 + np.exp(-3 * least[np.arange(len(rows)), best]))
        return language, sure


def train(docs: DataFrame, sample: int = SAMPLE, least: int = EACH) -> Hierarchy | None:
    """Train on the rows of ``docs`` that aren't held out and have a language and a text with letters.

    Every label is learned. At most ``sample`` rows reach the driver, the same number at most for each label, or ``least``
    of each if there are so many labels that fewer would be left; they are chosen by a hash of their ids. Of an id's
    several rows of one language one counts, however many they are. None if there is no such row.
    """
    open_rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    counts = open_rows.groupBy("lang").count().collect()
    if not counts:
        return None
    each = max(least, sample // len(counts))
    share = F.map_from_arrays(F.array(*(F.lit(r["lang"]) for r in counts)), F.array(*(F.lit(min(1.0, each / r["count"])) for r in counts)))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30)) / float(1 << 30)
    chosen = open_rows.withColumn("drawn", drawn).filter(F.col("drawn") < F.try_element_at(share, F.col("lang")))
    # An id that many rows share is one draw: combined where the rows lie, and no label sends more than its share.
    chosen = chosen.groupBy("lang", "drawn", "doc_id").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "doc_id"))
    chosen = chosen.withColumn("place", place).filter(F.col("place") <= each)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, lettered = trigram_counts([t.as_py() for t in batch.column("text")])
            held = pa.array([v.astype(np.float16).tobytes() if ok else None for v, ok in zip(x, lettered, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("drawn"), batch.column("lang"), held], ["drawn", "lang", "x"])

    rows = chosen.select("drawn", "lang", "text").mapInArrow(lean(part), "drawn double, lang string, x binary").filter("x is not null").collect()
    rows = sorted(((r["lang"], r["drawn"], bytes(r["x"])) for r in rows))
    if not rows:
        return None
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float16).reshape(len(rows), FEATURES).astype(np.float32)
    return Hierarchy(x, [r[0] for r in rows])


def predict(model: Hierarchy | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Languages and scores; ``und`` with score 0 for a null text, one without a letter, or without a model."""
    if model is None or not texts:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    x, lettered = trigram_counts([t or "" for t in texts])
    language, score = model.predict(x)
    return [model.languages[k] if ok else UNDETERMINED for k, ok in zip(language, lettered, strict=True)], np.where(lettered, score, 0.0)


#: Texts whose features are held at once.
AT_ONCE = 512


def identify(docs: DataFrame, model: Hierarchy | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from ``docs`` unless given a model. Whole texts are read; a null text or one without a letter is ``und``
    with score 0, and so is every text if there is nothing to learn from. Repeated rows are predicted alike, and of
    languages with equal votes the first by name is chosen. A table without rows gives none. Columns other than
    doc_id, text and lang are not read, whatever their names.
    """
    model = model or train(docs)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                language, score = predict(model, [t.as_py() for t in some.column("text")])
                columns = [some.column("doc_id"), some.column("held_out"), pa.array(language, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(lean(part), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Hierarchy | None = None, least: float = LEAST_SCORE, languages: Iterable[str] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose predicted language is one of ``languages`` (any learned one if None) with
    a score of ``least`` or more.

    Texts in a language or script that wasn't learned, or in none, come out with low scores and are rejected, as are
    null texts, texts without a letter, and all texts if there is nothing to learn from. Repeated rows are treated
    alike; a table without rows gives none; columns of any name stay as they are.
    """
    model = model or train(docs)
    wanted = None if languages is None else frozenset(languages)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                language, score = predict(model, [t.as_py() for t in some.column("text")])
                good = [x != UNDETERMINED and s >= least and (wanted is None or x in wanted) for x, s in zip(language, score, strict=True)]
                yield some.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(lean(part), docs.schema)
