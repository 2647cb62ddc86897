import itertools
import math
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import quality
from tests.llm.conftest import AWKWARD


def brute_chain(emission, change):
    n = len(emission)
    weights = {
        path: np.exp(
            sum(e for e, y in zip(emission, path) if y) + sum(change[a, b] for a, b in zip(path, path[1:]))
        )
        for path in itertools.product((0, 1), repeat=n)
    }
    z = sum(weights.values())
    good = [sum(w for p, w in weights.items() if p[i]) / z for i in range(n)]
    pairs = np.zeros((2, 2))
    for p, w in weights.items():
        for a, b in zip(p, p[1:]):
            pairs[a, b] += w / z
    return good, pairs, np.log(z)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([3, 1, 7, 2, 7])
    emission, change = rng.normal(0, 3, counts.sum()), rng.normal(0, 1, (2, 2))
    good, pairs, log_z = quality.forward_backward(emission, change, counts)
    at = 0
    for i, n in enumerate(counts):
        g, p, z = brute_chain(emission[at : at + n], change)
        assert np.allclose(good[at : at + n], g) and np.allclose(pairs[i], p) and np.isclose(log_z[i], z)
        at += n


def test_gradient_raises_the_likelihood():
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 6, 80)
    features = rng.normal(0, 1, (counts.sum(), quality.FEATURES))
    labels = rng.integers(0, 2, 80).astype(float)
    features[:, 0] += 2 * np.repeat(labels, counts)
    model = quality.fit(features, np.ones(counts.sum()), counts, labels)
    assert model.weights[0] > 1 and model.slope > 0


def prose(rng, n, bad):
    words = ["the", "of", "and", "river", "stone", "house", "light", "walks", "under", "green"]
    lines = []
    for _ in range(n):
        line = rng.choices(words, k=rng.randrange(4, 30))
        if bad == "shout":
            line = [w.upper() + "!!" for w in line]
        elif bad == "junk":
            line = [w + rng.choice(["###", "$$$", "***"]) for w in line]
        elif bad == "repeat":
            line = [w for w in line[:4] for _ in range(9)]
        lines.append(" ".join(line).capitalize() + "." if not bad else " ".join(line))
    return "\n".join(lines)


def corpus(n=500):
    rng = random.Random(7)
    kinds = [None, None, None, "shout", "junk", "repeat"]
    docs, labels = [], []
    for i in range(n):
        kind = rng.choice(kinds)
        docs.append((i, prose(rng, rng.randrange(1, 12), kind)))
        if rng.random() < 0.8:
            labels.append((i, int(kind is None), 0))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark, docs_of):
    docs, labels = corpus()
    table = docs_of(docs + AWKWARD)
    marks = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, table, marks, quality.train(table, marks)


def test_held_out_accuracy(fitted):
    docs, labels, table, _, model = fitted
    found = quality.score(table.repartition(3), model).collect()
    assert len(found) == len(docs) + len(AWKWARD)
    truth = {i: q for i, q, _ in labels}
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 50
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    empty = [r.score for r in found if r.doc_id in (7, 8) and r.score == model.prior]
    assert len(empty) >= 2


def test_held_out_labels_are_not_used(spark, fitted):
    _, labels, table, _, model = fitted
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    marks = spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")
    again = quality.train(table, marks)
    assert np.allclose(again.weights, model.weights)


def test_rejected_rows_go(fitted):
    docs, _, table, _, model = fitted
    left = quality.keep_good(table, model)
    assert left.columns == table.columns
    predicted = quality.score(table, model).where("predicted = 1")
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in predicted.collect())


def test_without_labels_and_rows(spark, docs_of, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(awkward, none)
    assert {r.score for r in quality.score(awkward, model).collect()} == {0.5}
    assert quality.score(awkward.where("false"), model).count() == 0
    one = spark.createDataFrame([(3, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert {round(r.score, 3) for r in quality.score(awkward, quality.train(awkward, one)).collect()} <= {1.0}


def test_document_scores_equal_sums_over_labellings(fitted):
    docs, _, table, _, model = fitted
    found = {r.doc_id: r.score for r in quality.score(table, model).collect() if r.doc_id is not None}
    tried = 0
    for doc_id, text in docs:
        features, sizes, counts = quality.line_features([text.encode()])
        if counts[0] > 8 or doc_id < 20:  # the awkward rows repeat the first ids
            continue
        good, _, _ = brute_chain(np.clip(features @ model.weights, -30, 30), model.change)
        mean = sum(s * g for s, g in zip(sizes, good)) / sum(sizes)
        odds = math.log(min(max(mean, 1e-4), 1 - 1e-4) / (1 - min(max(mean, 1e-4), 1 - 1e-4)))
        assert abs(found[doc_id] - 1 / (1 + math.exp(-(model.slope * odds + model.shift)))) < 1e-6
        tried += 1
        if tried == 40:
            break
    assert tried == 40
