"""A supervised subword classifier: averaged vectors of hashed words and character n-grams, softmax, numpy SGD.

A document's vector is the average of the learned vectors of all its words, word pairs and character n-grams, each of
these families having an equal share. As average and output layer are linear, a trained model reduces to one number a
bucket: scoring a text is a lookup and a mean, and the model that is broadcast has a fixed size.
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


@dataclass(frozen=True)
class Params:
    #: Buckets of each family: words, pairs of neighbours, character 2-grams, character 3-grams (all over UTF-8 bytes).
    bits: int = 16
    dim: int = 6
    #: Bound on the labelled rows that the model learns from, the first by a hash of their id.
    max_rows: int = 8_000
    epochs: int = 3
    batch: int = 32
    rate: float = 0.15
    seed: int = 7


FAMILIES = 4


def families_of(text: bytes, p: Params) -> list[np.ndarray]:
    """Buckets of the words, word pairs, 2-grams and 3-grams of a text, repeats included.

    A word followed by itself makes the pair feature 0; spaces count as characters, so n-grams know the ends of words.
    """
    words = text.split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    a, b = h[:-1], h[1:]
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - p.bits)
    pairs = np.where(a == b, np.uint64(0), np.maximum(mixed, np.uint64(1)))
    c = np.frombuffer(text, np.uint8).astype(np.uint32)
    two = c[:-1] << 8 | c[1:]
    three = two[:-1] << 8 | c[2:]
    multiplied = [(x * np.uint32(2654435761)) >> np.uint32(32 - p.bits) for x in (h.astype(np.uint32), two, three)]
    return [multiplied[0], pairs.astype(np.uint32), *multiplied[1:]]


def packed(text: bytes, p: Params) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(buckets of each family in turn, how often each occurs, number of buckets of each family), in the narrowest integers."""
    found = [np.unique(f, return_counts=True) for f in families_of(text, p)]
    ids, counts = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    narrow = np.min_scalar_type(int(counts.max(initial=0)))
    return ids.astype(np.min_scalar_type((1 << p.bits) - 1)), counts.astype(narrow), [len(i) for i, _ in found]


def spread(row: tuple[np.ndarray, np.ndarray, list[int]], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Of a packed text, its buckets over all families and their weights; those of a family add up to its share."""
    ids, counts, sizes = row
    family = np.repeat(np.arange(FAMILIES), sizes)
    total = np.bincount(family, counts, FAMILIES)
    return ids + (family << p.bits), counts / (total[family] * FAMILIES)


def _sparse(texts: list[bytes], p: Params) -> list[tuple[np.ndarray, np.ndarray]]:
    return [spread(packed(text, p), p) for text in texts]


def gradients(vectors: np.ndarray, out: np.ndarray, bias: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
    """(buckets, gradients of their vectors, of the output layer, of its bias) of the summed cross entropy of a batch."""
    dim = vectors.shape[1]
    ids, share = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    weighted = vectors[ids] * share[:, None]
    hidden = np.stack([np.bincount(doc, weighted[:, d], len(rows)) for d in range(dim)], 1)
    logits = hidden @ out + bias
    odds = np.exp(logits - logits.max(1, keepdims=True))
    error = odds / odds.sum(1, keepdims=True)
    error[np.arange(len(rows)), labels] -= 1
    step = (error @ out.T)[doc] * share[:, None]
    unique, at = np.unique(ids, return_inverse=True)
    grad = np.stack([np.bincount(at, step[:, d], len(unique)) for d in range(dim)], 1)
    return unique, grad, hidden.T @ error, error.sum(0)


def train(texts: list[bytes], labels: list[int], p: Params = Params()) -> tuple[np.ndarray, float]:
    """(a number a bucket, bias): their average over a text's features plus the bias is the log odds of label 1.

    Vectors and output layer learn together by minibatch gradient descent with per-coordinate (Adagrad) rates, which
    averaged, hence small, gradients need. Without examples of both labels the score is the same for every text.
    The driver holds the texts packed, about three bytes a feature, and spreads out one batch at a time.
    """
    total = FAMILIES << p.bits
    ones = sum(labels)
    prior = float(np.log((ones + 0.5) / (len(labels) - ones + 0.5)))
    if not 0 < ones < len(labels):
        return np.zeros(total, np.float32), prior
    rng = np.random.default_rng(p.seed)
    rows = [packed(text, p) for text in texts]
    y = np.array(labels, np.int64)
    vectors = rng.normal(0, 0.1, (total, p.dim))
    out, bias = rng.normal(0, 1, (p.dim, 2)), np.array([0.0, prior])
    seen_v, seen_o, seen_b = np.full(total, 1e-8), 1e-8, 1e-8
    for epoch in range(p.epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // p.batch)):
            unique, grad, g_out, g_bias = gradients(vectors, out, bias, [spread(rows[i], p) for i in part], y[part])
            seen_v[unique] += (grad**2).mean(1)
            vectors[unique] -= p.rate * grad / np.sqrt(seen_v[unique])[:, None]
            seen_o, seen_b = seen_o + (g_out**2).mean(), seen_b + (g_bias**2).mean()
            out -= p.rate * g_out / np.sqrt(seen_o)
            bias -= 0.3 * p.rate * g_bias / np.sqrt(seen_b)
    difference = out[:, 1] - out[:, 0]
    return (vectors @ difference).astype(np.float32), float(bias[1] - bias[0])


def score_text(text: bytes, weights: np.ndarray, bias: float, p: Params) -> float:
    odds = bias
    for k, f in enumerate(families_of(text, p)):
        if len(f):
            odds += float(weights[k << p.bits : (k + 1) << p.bits][f].mean(dtype=np.float64)) / FAMILIES
    return float(1 / (1 + np.exp(-np.clip(odds, -500, 500))))


def score_documents(documents: DataFrame, weights: np.ndarray, bias: float, threshold: float, modulus: int, held: int, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from the whole text alone (null: empty)."""
    model = documents.sparkSession.sparkContext.broadcast(weights)  # a fixed number of buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([score_text(t, model.value, bias, p) for t in batch.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    narrow = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold("doc_id", modulus) == held).alias("held_out"),
        text_of().cast("binary").alias("text"),
    )
    return map_rows(narrow, run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(documents: DataFrame, labels: DataFrame, training: DataFrame | None = None, p: Params = Params()) -> DataFrame:
    """Quality of each row of ``documents``, learnt from labelled rows of ``training`` (default: the same documents).

    Labels are read only where crc32(doc_id) mod 5 is not 0, and at most ``p.max_rows`` of them (a documented bound).
    Null texts and texts without a word get the score of no features; rows with null ids are scored, not learnt from;
    repeated rows get equal scores; without usable labels every score is equal.
    """
    texts, y = labelled_sample(training if training is not None else documents, labels, "quality", fold("doc_id", 5) != 0, p.max_rows)
    weights, bias = train(texts, y, p)
    return score_documents(documents, weights, bias, 0.3, 5, 0, p)


def keep_good(documents: DataFrame, labels: DataFrame, training: DataFrame | None = None, threshold: float = 0.3, p: Params = Params()) -> DataFrame:
    """The rows of ``documents`` that are not rejected, with their columns; learnt as in ``quality_scores``. No shuffle."""
    texts, y = labelled_sample(training if training is not None else documents, labels, "quality", fold("doc_id", 5) != 0, p.max_rows)
    weights, bias = train(texts, y, p)
    model = documents.sparkSession.sparkContext.broadcast(weights)  # a fixed number of buckets
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [score_text((t or "").encode(), model.value, bias, p) >= threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
