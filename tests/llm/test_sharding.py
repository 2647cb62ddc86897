import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import sharding
from tests.llm.conftest import AWKWARD


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    p = sharding.Feistel(n)
    places = p.place(np.arange(n))
    assert sorted(places.tolist()) == list(range(n))
    assert p.number(places).tolist() == list(range(n))


def test_shuffles():
    places = sharding.Feistel(10_000).place(np.arange(10_000))
    assert abs(np.corrcoef(places, np.arange(10_000))[0, 1]) < 0.05


def test_shards(spark, docs_of, awkward):
    rows = AWKWARD + [(i, f"t{i}" if i % 3 else "same") for i in range(100, 400)]
    out = {}
    for parts in (1, 5):
        found = sharding.shard_rows(docs_of(rows).repartition(parts)).collect()
        counts = Counter(r.shard for r in found)
        assert max(counts.values()) - min(counts.values()) <= 1 and sum(counts.values()) == len(rows)
        for shard, n in counts.items():
            assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))
        out[parts] = sorted((r.row_number, r.shard, r.slot, r.size, r.text_crc32) for r in found)
    assert out[1] == out[5]
    sizes = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((s, c) for *_, s, c in out[1]) == sizes
    assert sharding.shard_rows(awkward.where("false")).count() == 0


def slow_place(number, n, rounds=sharding.ROUNDS, key=sharding.KEY):
    """Place of a row number in the permutation, in whole numbers."""
    mask64 = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask64
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask64
        return x ^ x >> 31

    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    while True:
        left, right = number >> half, number & low
        for r in range(1, rounds + 1):
            left, right = right, left ^ (mix(right + mix(r * 0x9E3779B97F4A7C15 + key & mask64) & mask64) & low)
        number = left << half | right
        if number < n:
            return number


def test_shards_and_slots_equal_a_slow_permutation(docs_of):
    rows = [(i, f"text {i * 7 % 31}") for i in range(257)] + AWKWARD
    found = sharding.shard_rows(docs_of(rows).repartition(4)).collect()
    order = sorted(found, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32))
    key = lambda r: (r.doc_id, r.size, r.text_crc32)
    assert [key(r) for r in sorted(found, key=lambda r: r.row_number)] == list(map(key, order))
    for r in found:
        place = slow_place(r.row_number, len(rows))
        assert (r.shard, r.slot) == (place % 16, place // 16)
