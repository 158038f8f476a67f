"""The learning steps against plain Python and finite differences, and what they are given."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import classifier, common, toxicity


def test_ftrl_equals_plain_python():
    """The published update, one coordinate at a time."""
    rng = random.Random(3)
    rows = [sorted(rng.sample(range(40), rng.randrange(1, 9))) for _ in range(60)]
    labels = [int(3 in r or rng.random() < 0.2) for r in rows]
    p = toxicity.Params(bits=6, alpha=0.7, beta=0.5, l1=0.3, l2=0.1, epochs=3)
    z, n = dict.fromkeys(range(64), 0.0), dict.fromkeys(range(64), 0.0)
    ones = sum(labels)
    bias, bias_n = math.log((ones + 0.5) / (len(rows) - ones + 0.5)), 0.0

    def weight(i):
        if abs(z[i]) <= p.l1:
            return 0.0
        return -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    turns = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for k in turns.permutation(len(rows)):
            w = {i: weight(i) for i in rows[k]}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - labels[k]
            for i in rows[k]:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
            bias_n += g * g
            bias -= 0.1 * g / (1 + math.sqrt(bias_n))
    at, found, b = toxicity.ftrl([np.array(r) for r in rows], np.array(labels), p)
    wanted = {i: weight(i) for i in range(64) if weight(i)}
    assert dict(zip(at.tolist(), found)) == pytest.approx(wanted) and b == pytest.approx(bias) and len(wanted) < 40


def test_logistic_curve_is_a_minimum():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 2, 300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2.5 * x - 1)))).astype(int)

    def loss(a, c):
        u = a * x + c
        return np.logaddexp(0, u).sum() - (u * y).sum() + ((a - 1) ** 2 + c**2) / 2

    a, c = toxicity.logistic_curve(x, y)
    assert all(loss(a, c) <= loss(a + d, c + e) for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01))
    far, _ = toxicity.logistic_curve(np.array([-1.0, 1.0] * 50), np.array([0, 1] * 50))
    assert 1 < far < 50


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    p = classifier.Params(bits=5, dim=3)
    rows = classifier._sparse([b"one two two", b"", b"a", b"three one !"], p)
    y = np.array([1, 0, 0, 1])
    vectors, out, bias = rng.normal(0, 1, (classifier.FAMILIES << p.bits, p.dim)), rng.normal(0, 1, (p.dim, 2)), rng.normal(0, 1, 2)

    def loss():
        total = 0.0
        for (ids, share), k in zip(rows, y):
            u = (vectors[ids] * share[:, None]).sum(0) @ out + bias
            total += np.logaddexp(*u) - u[k]
        return total

    unique, grad, g_out, g_bias = classifier.gradients(vectors, out, bias, rows, y)
    for array, found in ((vectors, dict(zip(unique.tolist(), grad))), (out, dict(enumerate(g_out))), (bias, dict(enumerate(g_bias)))):
        for i, g in found.items():
            for d in np.ndindex(np.shape(g)):
                at = (i, *d)
                array[at] += 1e-5
                up = loss()
                array[at] -= 2e-5
                assert (up - loss()) / 2e-5 == pytest.approx(g[d], abs=1e-6)
                array[at] += 1e-5


def test_quality_training_holds_packed_features():
    """The driver of a pipeline keeps what training took: 16 bytes a feature of 8,000 texts were 240 MB."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghij klmno") for _ in range(4000)).encode() for _ in range(300)]
    p = classifier.Params(bits=12, dim=1, epochs=1, batch=4)
    wanted = classifier._sparse(texts, p)
    features = sum(len(ids) for ids, _ in wanted)
    for text, (ids, share) in zip(texts[:20], wanted):
        direct = {}
        for k, family in enumerate(classifier.families_of(text, p)):
            for f in family.tolist():
                direct[f + (k << p.bits)] = direct.get(f + (k << p.bits), 0) + 1 / (len(family) * classifier.FAMILIES)
        assert dict(zip(ids.tolist(), share)) == pytest.approx(direct)
    del wanted
    tracemalloc.start()
    classifier.train(texts, [k % 2 for k in range(len(texts))], p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * features


def test_toxicity_words_known_are_bounded():
    """An executor runs a worker a core; numbers of 400,000 words each were most of what such a worker held."""
    tracemalloc.start()
    hashes = toxicity.Hashes()
    for k in range(0, 300_000, 100):
        toxicity.features_of([b"word%07d" % n for n in range(k, k + 100)], hashes, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    again = [toxicity.features_of([b"word0000007", b"word0299999", b"a", b"b"], h, 20).tolist() for h in (hashes, toxicity.Hashes())]
    assert again[0] == again[1] and peak < 40_000_000


def test_long_texts_are_scored_but_no_samples(spark):
    """They differ in no other way from those that a model learns from."""
    long = "moron " + "w " * common.MAX_BYTES
    docs = spark.createDataFrame([(0, long), (1, "x" * common.MAX_BYTES), (2, "y" * (common.MAX_BYTES + 1))], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 1), (1, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    texts, y = common.labelled_sample(docs, labels, "toxic", F.lit(True), 10)
    assert (len(texts), y) == (1, [0])
    assert toxicity.toxicity_scores(docs, labels).count() == classifier.quality_scores(docs, labels).count() == 3


@pytest.mark.parametrize("sf, recall", [("sf0.1", 0.8)])
def test_held_out_accuracy_on_the_tables(spark, sf, recall):
    d = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    for found, column, least in ((toxicity.op3_toxicity(spark, d), "toxic", recall), (classifier.op9_quality_classifier(spark, d), "quality", 0.95)):
        rows = found.where("held_out").join(labels, "doc_id").where(f"{column} IN (0, 1)").groupBy(column, "predicted").count().collect()
        n = {(r[0], r[1]): r[2] for r in rows}
        assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= least and n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) >= 0.95
