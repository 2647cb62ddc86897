"""Hard negatives against a plain search, and the progress of their pruning."""

import math

import numpy as np
import pytest

from lodestone.llm import negatives as op

FIELDS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows):
    kept = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        moved = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        kept.append((vec_id, [math.floor(256 * x) for x in vector], moved))

    def order(scored):
        return sorted(scored, key=lambda s: (-s[0], s[1] is None, s[1] or 0))

    out = []
    for i, (anchor, a, label) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scores = [(sum(x * y for x, y in zip(a, b)), j) for j, (_, b, _) in enumerate(kept)]
        alike = order((s, kept[j][0]) for s, j in scores if j != i and kept[j][2] == label)[:5]
        others = order((s, kept[j][0]) for s, j in scores if kept[j][2] != label)
        for s, positive in alike:
            good = [(t, n) for t, n in others if 80 * s <= 100 * t <= 100 * s][:5]
            out += [(anchor, positive, rank, n, s, t) for rank, (t, n) in enumerate(good, 1)]
    return sorted(out, key=str)


def _rows(n, size, seed, ids=None):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(4, size))
    vectors = (middle[rng.integers(0, 4, n)] + rng.normal(size=(n, size))) / 8
    return [(int(i), [float(x) for x in np.float32(v)], int(rng.integers(0, 10))) for i, v in zip(ids if ids is not None else range(n), vectors)]


def _table(spark, rows):
    wide = [(*r, 3, [1], "x") for r in rows]
    return spark.createDataFrame(wide, "vec_id long, embedding array<float>, label int, row int, ints array<int>, slot string")


def _result(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=str)


def test_against_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(op, "ROW_BLOCK", 200)
    monkeypatch.setattr(op, "ANCHOR_BLOCK", 3)
    rows = _rows(900, 16, 1)
    rows += [(7, None, 1), (8, [0.5] * 16, None), (9, [float("nan")] * 16, 2), (10, [float("inf")] + [0.0] * 15, 2), (11, [None] + [0.1] * 15, 2)]
    rows += [(None, rows[100][1], rows[100][2]), (None, None, None), rows[100], rows[200], (300, rows[300][1], 5)]  # copies of anchors
    rows += [(1000 + i, rows[400][1], i % 3) for i in range(300)]  # one vector a quarter of all rows: ties by id
    want = plain(rows)
    assert len(want) > 50
    assert _result(op.hard_negatives(_table(spark, rows))) == want


@pytest.mark.parametrize("rows", [
    [],
    [(100, [], 1), (1, [], 1), (2, [], 2)],
    [(0, [0.5, 0.5], 9), (1, [0.5], 0), (2, [0.5, 0.25, 4.0], 3), (3, [-0.5, -0.5], 0)],  # several lengths; label 9 becomes 0
    [(100, [-0.5], 1), (1, [0.5], 1), (2, [0.5], 2)],  # a negative score has no window
    [(100, [1.0], 1), (2, [1.0], 2)],  # no positive
])
def test_small_tables(spark, rows):
    assert _result(op.hard_negatives(_table(spark, rows))) == plain(rows)


def test_scores_that_fit_no_long(spark):
    with pytest.raises(ValueError):
        op.hard_negatives(_table(spark, [(100, [1e30], 1), (1, [1.0], 1)]))


@pytest.mark.parametrize("scale", [1, 50, 300_000])
def test_planes_tighten_and_prune(scale):
    rng = np.random.default_rng(3)
    anchors = rng.integers(-90 * scale, 90 * scale, (20, 64))
    rows = rng.integers(-90 * scale, 90 * scale, (3000, 64))
    allowed = rng.random((20, 3000)) < 0.8
    bits = int(np.abs(rows).max()).bit_length()
    exact = anchors @ rows.T
    best = np.sort(np.where(allowed, exact, -op.ANY), 1)[:, -5:]
    left = []
    least, most = np.full((20, 1), -op.ANY), np.full((20, 1), op.ANY)
    a, r, s = op.search(anchors, rows, bits, allowed, least, most, 5, left)
    assert (s == exact[a, r]).all()
    for i in range(20):
        assert sorted(s[a == i])[-5:] == best[i].tolist()
    assert left == sorted(left, reverse=True) and len(left) == bits + 1
    # Pairs are gone before the last planes are read.
    assert left[-1] < 300 and left[-3] < allowed.sum() // 10
    most = best
    least = -(-80 * most // 100)
    a, r, s = op.search(anchors, rows, bits, allowed, least, most, 3)
    got = {(i, j) for i, j in zip(a.tolist(), r.tolist())}
    for i in range(20):
        for w in range(5):
            inside = [j for j in np.flatnonzero(allowed[i]) if least[i, w] <= exact[i, j] <= most[i, w]]
            inside.sort(key=lambda j: -exact[i, j])
            assert all((i, j) in got for j in inside[:3])
