import hashlib
import random
import re
from collections import defaultdict

import pytest

from lodestone.llm import exact_dedup
from tests.llm.conftest import AWKWARD


def normal(text):
    return re.sub(rb"[\x20\x09-\x0D]+", b" ", (text or "").encode())


def collide(text):
    return len(text) % 2 - 1


def check(rows, found):
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(str(i) for i, _ in rows)
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[hashlib.sha256(normal(text)).hexdigest()].append(doc_id)
    by_sha = defaultdict(list)
    for r in found:
        by_sha[r.text_sha256].append(r)
    assert by_sha.keys() == groups.keys()
    for sha, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        assert {r.keep_id for r in by_sha[sha]} == {keep}
        assert {r.group_size for r in by_sha[sha]} == {len(ids)}
        assert [r.doc_id for r in by_sha[sha] if r.kept] == [keep]


@pytest.mark.parametrize("hash_text", [exact_dedup.default_hash, collide])
def test_groups_equal_brute_force(spark, awkward, hash_text):
    check(AWKWARD, exact_dedup.exact_groups(awkward.repartition(3), hash_text=hash_text).collect())


def test_hot_group_and_small_buckets(spark, docs_of):
    rng = random.Random(1)
    rows = [(i, "hot text" if rng.random() < 0.4 else f"text {rng.randrange(300)}") for i in range(900)]
    rng.shuffle(rows)
    found = exact_dedup.exact_groups(docs_of(rows).repartition(7), capacity=5).collect()
    check(rows, found)
    assert len({r.bucket for r in found}) > 20


def test_directory_doubles_only_at_full_depth():
    d = exact_dedup.Directory()
    low, high = d.split((0, 0))
    assert d.depth == 1 and d.buckets() == [(1, 0), (1, 1)]
    d.split(low)
    assert d.depth == 2 and d.cells == [(2, 0), (2, 1), high, high]
    d.split(high)
    assert d.depth == 2 and d.starts() == [0, 1 << 62, 2 << 62, 3 << 62]


def test_directory_of_keys_that_share_long_prefixes(spark):
    keys = spark.createDataFrame([(i,) for i in range(-40, 40)], "key long")
    starts = exact_dedup.build_directory(keys, capacity=4).starts()
    values = sorted(i % (1 << 64) for i in range(-40, 40))
    edges = [*starts, 1 << 64]
    assert all(sum(a <= v < b for v in values) <= 4 for a, b in zip(edges, edges[1:]))


def test_empty_table(spark, docs_of):
    assert exact_dedup.exact_groups(docs_of([(1, "a")]).where("false")).count() == 0


def test_rows_left_keep_their_columns(spark, awkward):
    left = exact_dedup.drop_exact_copies(awkward)
    assert left.columns == awkward.columns
    rows = left.collect()
    assert len(rows) == len({normal(t) for _, t in AWKWARD})
    assert {r.doc_id for r in rows if normal(r.text) == b"a b c"} == {3}


def test_columns_of_any_name_and_type_are_kept(odd_columns):
    left = exact_dedup.drop_exact_copies(odd_columns)
    assert left.schema == odd_columns.schema
    rows = [r.asDict() for r in left.collect()]
    assert sorted((str(r["doc_id"]), r["__id"], r["a.b"], r["tags"]["k"]) for r in rows) == [
        ("1", "u", 1, "x"),
        ("4", "w", 4, "x"),
        ("None", "z", 5, "x"),
    ]
    assert exact_dedup.drop_exact_copies(odd_columns.where("false")).count() == 0


def test_directory_stays_small_however_deep():
    d = exact_dedup.Directory()
    bucket = (0, 0)
    for _ in range(64):
        bucket = d.split(bucket)[1]
    assert d.depth == 64 and len(d.buckets()) == 65
    assert d.starts() == sorted(d.starts())
