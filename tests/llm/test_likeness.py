"""Near copies from a similarity of 0.8, against exact similarities of planted copies."""

import random

import numpy as np
import pytest

from lodestone.llm import likeness, simhash


def similarity(a, b):
    def grams(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def planted(rng, low, high):
    """A text and a copy with substituted words, of a similarity in [low, high)."""
    while True:
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(80, 400))]
        copy = list(words)
        for _ in range(rng.randrange(1, 2 + len(words) // 20)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
        pair = " ".join(words), " ".join(copy)
        if low <= similarity(*pair) < high:
            return pair


def test_recall_in_every_band_and_clean_texts_stay(spark):
    rng = random.Random(5)
    bands = [(0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.0)]
    rows = []
    for at, band in enumerate(bands):
        for n in range(150):
            a, b = planted(rng, *band)
            rows += [(10_000 * at + 2 * n, a), (10_000 * at + 2 * n + 1, b)]
    below = [planted(rng, 0.55, 0.8) for _ in range(100)]
    passage = " ".join(f"p{i}" for i in range(60))
    clean = [t for pair in below for t in pair]
    clean += [passage + " " + " ".join(f"w{rng.randrange(5000)}" for _ in range(90)) for _ in range(300)]
    rows += [(90_000 + i, t) for i, t in enumerate(clean)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    kept = {r.doc_id for r in likeness.drop_similar(docs).collect()}
    # Below 0.8 only what the 64-bit rule links goes.
    linked = {r.doc_id for r in simhash.near_duplicates(docs).where("component_id <> doc_id").collect()}
    gone = {i for i, _ in rows if i >= 90_000} - kept
    assert gone <= linked and len(gone) < 10
    for at in range(len(bands)):
        assert all(10_000 * at + 2 * n in kept for n in range(150))
        caught = sum(10_000 * at + 2 * n + 1 not in kept for n in range(150)) / 150
        assert caught >= 0.9, (bands[at], caught)


def test_large_group_of_copies_is_a_forest_not_all_pairs(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]

    def copy():
        words = list(base)
        for _ in range(4):
            words[rng.randrange(200)] = f"y{rng.randrange(9000)}"
        return " ".join(words)

    texts = [" ".join(base)] + [copy() for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(4)
    links = [(r.a, r.b) for r in likeness.similar_links(rows).collect()]
    assert all(similarity(texts[a], texts[b]) >= 0.8 for a, b in links)
    assert len(set(links)) == len(links) < 40 * len(texts)
    root = list(range(len(texts)))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert root.count(0) >= 0.9 * len(texts)


def test_edges_become_their_ends_once_a_round(spark, monkeypatch):
    """Edges of a large group are many, so each step of a round reads the same ends."""
    ends, rounds, plain, deal = [], [], likeness.ends_of, likeness.suggested
    monkeypatch.setattr(likeness, "ends_of", lambda edges: ends.append(1) or plain(edges))
    monkeypatch.setattr(likeness, "suggested", lambda *args: rounds.append(1) or deal(*args))
    texts = [" ".join(f"w{i}" if i != at else "y" for i in range(90)) for at in range(0, 90, 3)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(4)
    assert likeness.similar_links(rows).count() >= len(texts) - 1
    assert len(ends) <= 2 * len(rounds)  # those of what is suggested and of what is found


def test_forest_equals_plain_kruskal():
    rng = np.random.default_rng(3)
    n = 60
    i, j = np.triu_indices(n, 1)
    apart = rng.integers(0, likeness.RADIUS + 1, len(i))
    pick = rng.permutation(len(i))[:500]
    forest = likeness.Forest(n)
    for part in np.array_split(pick, 7):
        forest.add(i[part], j[part], apart[part])
    root, weight, edges = list(range(n)), 0, 0
    for at in sorted(pick, key=lambda p: apart[p]):
        a, b = int(i[at]), int(j[at])
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        if a != b:
            root[a], weight, edges = b, weight + apart[at], edges + 1
    assert forest.apart.sum() == weight and len(forest.i) == edges


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_rows(spark, awkward, odd_columns, empty):
    for docs in (awkward, odd_columns):
        docs = docs.where("false") if empty else docs
        kept = likeness.drop_similar(docs)
        assert kept.schema == docs.schema
        assert (kept.count() == 0) == empty


def test_exactly_the_threshold_counts():
    assert similarity("a b c d e f g h i j k l m", "a b c d e f g h i j k l q") == 0.8
