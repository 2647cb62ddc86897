import itertools
import random

from lodestone.llm import decontaminate as dc


def brute(docs, items, least=1):
    found = set()
    for (doc_id, text), (item_id, item_text) in itertools.product(docs, items):
        a, b = dc.tokens(text), dc.tokens(item_text)
        w = min(dc.WINDOW, len(b))
        if len(b) < least:
            continue
        for i in range(len(a) - w + 1):
            for j in range(len(b) - w + 1):
                if sum(x == y for x, y in zip(a[i : i + w], b[j : j + w])) >= dc.needed(w):
                    found.add((doc_id, item_id))
    return found


def test_seeds_hit_every_allowed_substitution():
    for window in range(1, dc.WINDOW + 1):
        holes = window - dc.needed(window)
        for places in itertools.combinations(range(window), holes):
            assert any(
                all(o + i not in places for i, c in enumerate(m) if c == "1")
                for m in dc.masks_for(window)
                for o in range(window - len(m) + 1)
            ), (window, places)


def test_leaks_equal_brute_force(spark, docs_of):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["É", "straße"]
    items = [(n, " ".join(rng.choices(words, k=rng.choice([1, 4, 5, 7, 11, 13, 20, 40])))) for n in range(30)]
    items += [(30, None), (31, ""), (32, items[5][1]), (None, items[6][1])]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(120)]
    for i in range(120, 220):
        item = rng.choice(items[:30])[1].split()
        for _ in range(rng.randrange(0, 5)):
            item[rng.randrange(len(item))] = "zz"
        docs.append((i, " ".join([*rng.choices(words, k=rng.randrange(20)), *item, *rng.choices(words, k=3)]).upper()))
    docs += [(300, None), (301, ""), (None, items[7][1]), (302, "\n\n".join(items[8][1].split()) + "!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = docs_of(docs)
    expected = brute(docs, items, 5)
    for block in (dc.BLOCK_TOKENS, 25):
        found = dc.benchmark_leaks(table, bench, block_tokens=block, min_item=5).collect()
        assert {(r.doc_id, r.item_id) for r in found} == expected
    assert len(expected) > 30
    short = dc.benchmark_leaks(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in short} == brute(docs, items) > expected
    clean = dc.drop_leaks(table, bench, min_item=5)
    assert clean.columns == table.columns
    leaked = {d for d, _ in expected}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in docs if i not in leaked)


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    docs = docs_of([(1, "a b c d e f")])
    assert dc.benchmark_leaks(docs, bench).count() == 1
    assert dc.benchmark_leaks(docs, bench.where("false")).count() == 0
    assert dc.benchmark_leaks(docs.where("false"), bench).count() == 0
    assert dc.drop_leaks(docs, bench.where("false")).count() == 1


def test_columns_of_any_name_and_type_are_kept(spark, odd_columns):
    bench = spark.createDataFrame([(1, "quite another text")], "item_id long, text string")
    left = dc.drop_leaks(odd_columns, bench)
    assert left.schema == odd_columns.schema
    assert sorted(r["__id"] for r in left.collect()) == ["u", "v", "z", "z"]


def test_very_long_text(spark, docs_of):
    words = " ".join(f"x{i}" for i in range(200_000))
    bench = spark.createDataFrame([(1, " ".join(f"x{i}" for i in range(199_900, 199_920)))], "item_id long, text string")
    found = dc.benchmark_leaks(docs_of([(1, words)]), bench).first()
    assert (found.doc_start, found.overlap_tokens) == (199_900, 20)
