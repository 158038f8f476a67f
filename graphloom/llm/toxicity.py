"""Toxicity: logistic regression on hashed word n-grams and skip-grams, trained by FTRL-proximal.

Words also count by their first bytes, as many languages inflect and compound.

Each coordinate has its own learning rate, and the L1 term leaves most weights at zero, so that the broadcast model is
the short list of the others. A feature counts once a text, however often it occurs.

The L1 term also shrinks scores towards the share of toxic texts. So they are calibrated: models that leave out a part of the
training texts score it, and a logistic curve through these scores, a factor and a shift, is applied to the final model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fold, labelled_sample, map_rows, table, text_of


#: Bytes that words have in common with their inflected and compounded forms.
STEM = 5
#: Words that a task knows the numbers of at a time; it works out a forgotten one again.
KNOWN = 100_000


@dataclass(frozen=True)
class Params:
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.01
    epochs: int = 4
    #: Bound on the labelled rows that the model learns from, the first by a hash of their id.
    max_rows: int = 16_000
    seed: int = 11
    #: Parts that are left out in turn for the calibration.
    folds: int = 3


#: ASCII punctuation and digits part words; letters beyond ASCII are lower-cased before encoding.
_PARTS = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return (text.lower() if text.isascii() else text.decode().lower().encode()).translate(_PARTS).split()


class Hashes(dict):
    """Number of a word in 64 bits; forgets all beyond a bound."""

    def __init__(self):
        self.stems = Stems()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = n = zlib.crc32(word) << 32 | zlib.crc32(word, 77)
        return n


class Stems(dict):
    """Number of a word's first ``STEM`` bytes; zero for a word that is no longer than these."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        stem = word[:STEM]
        self[word] = n = 0 if stem == word else zlib.crc32(stem, 5) << 32 | zlib.crc32(stem, 78)
        return n


def features_of(words: list[bytes], hashes: Hashes, bits: int) -> np.ndarray:
    """Buckets of all words, their stems, pairs of neighbours and pairs with one word between, repeats included."""
    n = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    stems = np.fromiter(map(hashes.stems.__getitem__, words), np.uint64, len(words))
    odd, other, down = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(64 - bits)
    return np.concatenate(
        [n * odd >> down, stems[stems != 0] * odd >> down, (n[:-1] * other + n[1:]) * odd >> down, (n[:-2] * other + n[2:] + np.uint64(1)) * odd >> down]
    ).astype(np.int64)


def train(texts: list[bytes], labels: list[int], p: Params = Params()) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets with a weight, their weights, bias), calibrated. With one label only there are no weights, just the bias."""
    hashes = Hashes()
    rows = [np.unique(features_of(words_of(t), hashes, p.bits)).astype(np.int32) for t in texts]
    y = np.array(labels, np.int64)
    at, weights, bias = ftrl(rows, y, p)
    if not len(at) or not p.folds:
        return at, weights, bias
    part = np.random.default_rng(p.seed).permutation(len(rows)) % p.folds
    logits = np.zeros(len(rows))
    for k in range(p.folds):
        rest = np.flatnonzero(part != k)
        some, w, b = ftrl([rows[n] for n in rest], y[rest], p)
        full = np.zeros(1 << p.bits)
        full[some] = w
        for n in np.flatnonzero(part == k):
            logits[n] = full[rows[n]].sum() + b
    factor, shift = logistic_curve(logits, y)
    return at, weights * factor, bias * factor + shift


def logistic_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, c) by Newton's method so that a * x + c are the log odds of y; a is positive. A weak pull to (1, 0) keeps it finite
    where x separates y."""
    a, c = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * x + c, -35, 35)))
        v = q * (1 - q)
        slope = np.array([((q - y) * x).sum() + (a - 1), (q - y).sum() + c])
        bend = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1]])
        step = np.linalg.solve(bend, slope)
        step /= max(1.0, float(np.abs(step).max()))  # at most one at a time
        a, c = max(0.1, a - float(step[0])), c - float(step[1])
        if np.abs(step).max() < 1e-9:
            break
    return a, c


def ftrl(rows: list[np.ndarray], labels: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets with a weight, their weights, bias) of rows of distinct buckets, by FTRL-proximal."""
    ones = int(labels.sum())
    prior = float(np.log((ones + 0.5) / (len(labels) - ones + 0.5)))
    if not 0 < ones < len(labels):
        return np.zeros(0, np.int64), np.zeros(0), prior
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    bias, bias_n = prior, 0.0
    rng = np.random.default_rng(p.seed)

    def weights_at(i):
        zi = z[i]
        return np.where(np.abs(zi) <= p.l1, 0.0, -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for k in rng.permutation(len(rows)):
            i = rows[k]
            w = weights_at(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[k]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha
            z[i] += g - sigma * w
            n[i] += g * g
            bias_n += g * g
            bias -= 0.1 * g / (1 + np.sqrt(bias_n))
    every = weights_at(np.arange(1 << p.bits))
    at = np.flatnonzero(every)
    return at, every[at], float(bias)


def toxicity_scores(documents: DataFrame, labels: DataFrame, training: DataFrame | None = None, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from the whole text alone.

    Labels are read only where crc32(doc_id) mod 3 is not 1, and at most ``p.max_rows`` of them (a documented bound).
    A null text counts as empty: its score is that of the bias. Null ids are scored, not learnt from; repeated rows get
    equal scores; without usable labels every score is equal.
    """
    sample = labelled_sample(training if training is not None else documents, labels, "toxic", fold("doc_id", 3) != 1, p.max_rows)
    at, weights, bias = train(*sample, p)
    model = documents.sparkSession.sparkContext.broadcast((at, weights))  # at most 2**bits weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, hashes = np.zeros(1 << p.bits), Hashes()
        full[model.value[0]] = model.value[1]

        def score(text: bytes) -> float:
            i = features_of(words_of(text), hashes, p.bits)
            i = np.unique(i[full[i] != 0])
            return float(1 / (1 + np.exp(-np.clip(full[i].sum() + bias, -500, 500))))

        for batch in batches:
            scores = np.array([score(t) for t in batch.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.7).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    narrow = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold("doc_id", 3) == 1).alias("held_out"),
        text_of().cast("binary").alias("text"),
    )
    return map_rows(narrow, run, "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
