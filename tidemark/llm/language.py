"""Language identification: multinomial logistic regression on character n-grams.

A text becomes the counts of its letter unigrams, bigrams and trigrams, hashed to
:data:`FEATURES` cells, as ``(1 + ln tf) * idf`` of unit length.  Document
frequencies come from all learning documents; the regression is fitted on a
bounded sample of them (:data:`PER_CLASS` documents of each language, the first by
a hash of the row) by FTRL-proximal with elastic-net penalties, so that most
weights are exactly zero.  A temperature fitted on the part of the sample that the
regression has not seen makes the probabilities honest.

A null text or one without a letter is ``und`` with score 0, also where nothing
can be learnt.  Rows without language or without letters teach nothing.  Ties go
to the language first in code-point order.  Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrays import text_blocks

FEATURE_BITS = 14
FEATURES = 1 << FEATURE_BITS
#: Documents per language that the regression is fitted on.
PER_CLASS = 1000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.001
#: One sample document in so many is kept for the temperature.
CALIBRATION = 5
UNKNOWN = "und"


def _letter_table() -> np.ndarray:
    """Whether each character below 65,536 is a letter."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


class Featurizer:
    def __init__(self):
        self.letters = _letter_table()

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """The cells of a text's n-grams and their counts; None without a letter."""
        if not text:
            return None
        points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        letter = self.letters[np.minimum(points, 0xFFFF)]
        for high in np.unique(points[points > 0xFFFF]).tolist():
            letter = letter | (points == high) if chr(high).isalpha() else letter & (points != high)
        if not letter.any():
            return None
        ends = np.zeros(len(points) + 2, np.uint64)
        ends[1:-1] = np.where(letter, points, 0)  # what is no letter parts words
        one = ends + np.uint64(1)
        two = one[:-1] * np.uint64(1_000_003) + one[1:]
        three = two[:-1] * np.uint64(1_000_003) + one[2:]
        cells = [
            (grams * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)) >> np.uint64(64 - FEATURE_BITS)
            for size, grams in enumerate((one, two, three))
        ]
        found = np.bincount(np.concatenate(cells).astype(np.int64), minlength=FEATURES)
        places = np.flatnonzero(found)
        return places, found[places]


def weighted(places: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1 + np.log(counts)) * idf[places]
    norm = np.sqrt((values * values).sum())
    return values / norm if norm else values


def _softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow the regularised leader, one set of per-coordinate rates for each class."""

    def __init__(self, classes: int):
        self.z = np.zeros((FEATURES + 1, classes))
        self.n = np.zeros((FEATURES + 1, classes))

    def weights(self, places) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        shrunk = np.sign(z) * L1 - z
        return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, places: np.ndarray, values: np.ndarray, wanted: int) -> None:
        places = np.append(places, FEATURES)  # the last cell is the constant
        values = np.append(values, 1.0)
        weights = self.weights(places)
        error = _softmax(values @ weights)
        error[wanted] -= 1
        gradient = values[:, None] * error
        n = self.n[places]
        rate = (np.sqrt(n + gradient**2) - np.sqrt(n)) / ALPHA
        self.z[places] += gradient - rate * weights
        self.n[places] = n + gradient**2


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, found: tuple[np.ndarray, np.ndarray] | None) -> tuple[str, float]:
        if found is None or not self.languages:
            return UNKNOWN, 0.0
        values = weighted(*found, self.idf)
        chances = _softmax((values @ self.weights[found[0]] + self.weights[FEATURES]) / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """Fit on rows of language, cells and counts, in the order given."""
    languages = sorted({language for language, _, _ in rows})
    number = {language: k for k, language in enumerate(languages)}
    samples = [(number[language], places, weighted(places, counts, idf)) for language, places, counts in rows]
    learner = Ftrl(len(languages))
    kept = [sample for k, sample in enumerate(samples) if k % CALIBRATION]
    for _ in range(EPOCHS):
        for wanted, places, values in kept or samples:
            learner.learn(places, values, wanted)
    weights = learner.weights(slice(None))
    scores = np.array([values @ weights[places] + weights[FEATURES] for _, places, values in samples[::CALIBRATION]])
    truth = np.array([wanted for wanted, _, _ in samples[::CALIBRATION]], int)
    return Model(languages, idf, weights, _temperature(scores, truth) if len(languages) > 1 else 1.0)


def _temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, by golden section between 1/50 and 50."""
    rows = np.arange(len(truth))

    def loss(log_t: float) -> float:
        return float(-np.log(np.maximum(_softmax(scores / np.exp(log_t))[rows, truth], 1e-12)).sum())

    low, high, golden = -np.log(50.0), np.log(50.0), (np.sqrt(5.0) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """Columns ``cell`` and ``df``: one row per feature cell; cell -1 counts the documents with letters."""
    rows = docs.select(docs[text].alias("_text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer, total = Featurizer(), np.zeros(FEATURES + 1, np.int64)
        for block in text_blocks(batches, "_text"):
            for value in block.column("_text").to_pylist():
                found = featurizer.counts(value)
                if found is not None:
                    total[found[0]] += 1
                    total[FEATURES] += 1
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(cells == FEATURES, -1, cells), pa.int32()), pa.array(total[cells], pa.int64())], ["cell", "df"]
        )

    return rows.mapInArrow(count, "cell int, df long").groupBy("cell").agg(F.sum("df").alias("df"))


def bounded_sample(docs: DataFrame, text: str, lang: str, order: Column) -> DataFrame:
    """At most :data:`PER_CLASS` rows of each language: ``_lang``, ``_order``, ``_text``.

    A count by language without the texts gives the share of each language to draw,
    with some to spare, so that only about the wanted number of texts is moved.
    """
    rows = docs.select(docs[lang].alias("_lang"), order.alias("_order"), docs[text].alias("_text"))
    sizes = rows.groupBy("_lang").agg(F.count("*").alias("_size"))
    share = F.least(F.lit(1.0), (F.lit(PER_CLASS) + 10 * F.sqrt(F.lit(PER_CLASS)) + 20) / F.col("_size"))
    drawn = rows.join(F.broadcast(sizes.select("_lang", share.alias("_share"))), "_lang").where(
        F.pmod("_order", F.lit(1 << 30)) < F.col("_share") * (1 << 30)
    )
    ranked = Window.partitionBy("_lang").orderBy("_order", F.md5("_text"))
    return drawn.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= PER_CLASS)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """A model from all rows of ``docs`` that have a language; ``key`` and text order the sample, whatever ids are null or equal."""
    learning = docs.where(docs[lang].isNotNull() & docs[text].isNotNull())
    counted = {row.cell: row.df for row in document_frequencies(learning, text).collect()}  # at most FEATURES + 1 rows
    total = counted.pop(-1, 0)
    idf = np.full(FEATURES, np.log(1.0 + total) + 1)
    for cell, df in counted.items():
        idf[cell] = np.log((1 + total) / (1 + df)) + 1
    # Rows that share an id, or have none, are drawn by their texts.
    order = F.xxhash64(docs[key].cast("string"), docs[text], F.lit("language"))
    sample = bounded_sample(learning, text, lang, order)

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer()
        for block in text_blocks(batches, "_text"):
            found = [featurizer.counts(value) for value in block.column("_text").to_pylist()]
            kept = pa.array([row is not None for row in found])
            packed = [(p.astype(np.int32).tobytes(), c.astype(np.int32).tobytes()) for p, c in filter(None, found)]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("_lang").filter(kept),
                    block.column("_order").filter(kept),
                    pa.array([p for p, _ in packed], pa.binary()),
                    pa.array([c for _, c in packed], pa.binary()),
                ],
                ["lang", "place", "cells", "counts"],
            )

    picked = sample.select("_lang", "_order", "_text").mapInArrow(
        cells, "lang string, place long, cells binary, counts binary"
    )
    rows = sorted(picked.collect(), key=lambda row: (row.place, row.lang, bytes(row.cells)))  # bounded by the sample
    return fit([(r.lang, np.frombuffer(r.cells, np.int32), np.frombuffer(r.counts, np.int32)) for r in rows], idf)


def predict_languages(
    docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score``; nothing but the text is read for them."""
    rows = docs.select(*keep, docs[text].alias("_text"))
    # Broadcasts are pickled by reference, so only plain values go in.
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.idf, model.weights, model.temperature))

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer, own = Featurizer(), Model(*shared.value)
        for block in text_blocks(batches, "_text"):
            found = [own.predict(featurizer.counts(value)) for value in block.column("_text").to_pylist()]
            kept = [block.column(name) for name in keep]
            columns = [pa.array([name for name, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*keep, "lang_pred", "score"])

    kept = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in keep)
    return rows.mapInArrow(predict, f"{kept}, lang_pred string, score double")
