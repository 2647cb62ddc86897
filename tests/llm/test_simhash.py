import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import simhash
from lodestone.llm.components import components, join_hubs
from tests.llm.conftest import AWKWARD


def slow_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def check(rows, found):
    prints = [slow_print(t) for _, t in rows]
    roots = slow_components(prints)
    least = {}
    for (doc_id, _), r in zip(rows, roots):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    expected = sorted((str(i), f"{p:016x}", str(least.get(r))) for (i, _), p, r in zip(rows, prints, roots))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == expected


def near_texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=120)
    rows = []
    for i in range(n):
        text = base[:] if i % 3 else rng.choices(words, k=rng.randrange(0, 60))
        for _ in range(rng.randrange(6) if i % 3 else 0):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((1000 - i, " ".join(text).upper() if i % 5 == 0 else "\t".join(text)))
    return rows


@pytest.mark.parametrize("group_nodes", [4096, 3])
def test_components_equal_brute_force(docs_of, group_nodes):
    rows = near_texts(240, 1) + AWKWARD
    found = simhash.near_duplicates(docs_of(rows).repartition(4), group_nodes=group_nodes).collect()
    check(rows, found)
    assert any(r.linked for r in found)


def test_long_text():
    text = " ".join(random.Random(4).choices(["a", "b", "c", "dd"], k=20_000))
    assert simhash.fingerprint(text.encode()) == slow_print(text)


def test_index_equals_all_pairs():
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    prints = np.concatenate([centres[rng.integers(0, 30, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)), centres])
    prints = np.unique(prints)
    groups = np.sort(rng.integers(0, 3, len(prints)))
    order = np.lexsort((simhash.gray_rank(prints), groups))
    prints, groups = prints[order], groups[order]
    index = simhash.GrayIndex(groups, prints)
    assert len(index.levels) > 1
    found = [tuple(p) for i, j in index.links(3) for p in zip(i.tolist(), j.tolist())]
    n = len(prints)
    expected = [
        (i, j)
        for i in range(n)
        for j in range(i + 1, n)
        if groups[i] == groups[j] and int(prints[i] ^ prints[j]).bit_count() <= 3
    ]
    assert sorted(found) == expected


def test_upper_nodes_exist_and_prune():
    prints = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 8000, dtype=np.uint64))
    prints = np.unique(np.concatenate([prints, prints[:50] ^ np.uint64(0b101 << 40)]))
    prints = prints[np.argsort(simhash.gray_rank(prints))]
    index = simhash.GrayIndex(np.zeros(len(prints), np.int64), prints)
    assert len(index.levels) >= 6 and len(index.levels[-1][0]) == 1
    shared = [np.bitwise_count(mask).mean() for _, _, mask, _ in index.levels]
    assert all(low > high for low, high in zip(shared, shared[1:]))
    found = sum(len(i) for i, _ in index.links(3))
    assert found == 50
    assert index.compared < 0.2 * len(prints) ** 2 / 2


def test_owners_get_every_link_however_the_table_is_dealt(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    near = base[0] ^ (np.uint64(1) << rng.integers(0, 20, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(20, 64, 300, dtype=np.uint64))
    prints = np.unique(np.concatenate([base, near]))
    nodes = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    grouped, total = simhash._grouped(nodes, 4)
    groups = {}
    for r in grouped.collect():
        groups.setdefault(r.group, set()).add(r.print % (1 << 64))
    held = {frozenset(p) for g in groups.values() for p in [(a, b) for a in g for b in g if a < b]}
    values = prints.tolist()
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                assert frozenset((a, b)) in held
    assert max(map(len, groups.values())) < len(prints) / 2 and total >= sum(map(len, groups.values()))


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(64, dtype=np.uint64)
    order = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


def test_distributed_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 90), (100, 90), (95, 100)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long").repartition(5)).collect())
    assert got == {i: 0 for i in range(61)} | {90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hubs_are_dealt_to_many_tasks(spark):
    rows = spark.createDataFrame([(i % 7 and 1, i) for i in range(900)] + [(2, 1), (3, 5)], "a long, b long")
    facts = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    plain = sorted(tuple(r) for r in rows.join(facts.drop("degree"), "a").collect())
    for limit in (5, 10_000):
        found = join_hubs(rows, facts, "a", 0, limit)
        assert sorted(tuple(r) for r in found.select("a", "b", "m").collect()) == plain


def test_columns_of_any_name_and_type_are_kept(odd_columns):
    left = simhash.drop_near_copies(odd_columns)
    assert left.schema == odd_columns.schema
    assert sorted(r["__id"] for r in left.collect()) == ["u", "w", "z"]


def test_one_row_of_each_component_stays(docs_of, awkward):
    rows = near_texts(90, 2) + AWKWARD
    table = docs_of(rows).repartition(3)
    left = simhash.drop_near_copies(table)
    assert left.columns == table.columns
    prints = [slow_print(t) for _, t in rows]
    roots = slow_components(prints)
    best = {}
    for (doc_id, _), r in zip(rows, roots):
        best[r] = min(best.get(r, (True, 0)), (doc_id is None, doc_id or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted(best.values())
    assert simhash.drop_near_copies(awkward.where("false")).count() == 0
