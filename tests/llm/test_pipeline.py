import random

import pytest

import corpus_pipeline
from lodestone.llm import decontaminate, exact_dedup, packing, quality
from tests.llm.test_likeness import similarity
from tests.llm.test_quality import prose
from tests.llm.test_simhash import slow_components, slow_print


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    bench = [(i, " ".join(f"q{rng.randrange(500)}" for _ in range(30))) for i in range(3)]
    docs = [(i, prose(rng, rng.randrange(2, 9), rng.choice([None, None, None, "shout", "junk"]))) for i in range(240)]
    docs += [(1000 + i, docs[i][1].replace(" ", "  ")) for i in range(30)]
    docs += [(2000 + i, prose(rng, 3, None) + "\n" + bench[i % 3][1]) for i in range(6)]
    docs += [(3000, None), (3001, ""), (None, "the house under the river"), (5, docs[5][1]), (6, "another text of six")]
    labels = [(i, int("!!" not in t and "###" not in t and "$$$" not in t and "***" not in t), 0) for i, t in docs[:200]]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*d, "en", "s", 1) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows(df):
    return sorted(map(str, ((r.doc_id, r.text) for r in df.collect())))


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]

    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = stages["quality"](spark, docs, folder).cache()
    kept = [r for r in docs.collect() if model.scores([(r.text or "").encode()])[0] >= 0.3]
    assert rows(good) == sorted(str((r.doc_id, r.text)) for r in kept) and len(kept) < docs.count()

    exact = stages["exact_dedup"](spark, good, folder).cache()
    best = {}
    for r in kept:
        key = exact_dedup.normalise_blanks((r.text or "").encode())
        best[key] = min(best.get(key, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    left = exact.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == sorted(best.values())

    near = stages["near_dedup"](spark, exact, folder).cache()
    roots, first = slow_components([slow_print(r.text) for r in left]), {}
    for r, root in zip(left, roots):
        first[root] = min(first.get(root, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    # Of those, rows of a similarity of 0.8 or more are one group too.
    texts = {(r.doc_id is None, r.doc_id or 0): r.text for r in left}
    stay = sorted(first.values())
    group = list(range(len(stay)))
    for i, j in ((i, j) for i in range(len(stay)) for j in range(i)):
        if group[i] != group[j] and similarity(texts[stay[i]] or "", texts[stay[j]] or "") >= 0.8:
            x, y = group[i], group[j]
            group = [min(x, y) if g in (x, y) else g for g in group]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in near.collect()) == [stay[g] for g in sorted(set(group))]

    clean = stages["decontamination"](spark, near, folder).cache()
    leaked = {r.doc_id for r in decontaminate.benchmark_leaks(near, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert rows(clean) == sorted(str((r.doc_id, r.text)) for r in near.collect() if r.doc_id not in leaked)
    for part in (good, exact, near, clean):
        assert part.columns == docs.columns

    pieces = stages["packing"](spark, clean, folder).collect()
    assert sorted(str(r.doc_id) for r in pieces if r.start == 0) == sorted(str(r.doc_id) for r in clean.collect())
    assert all(r.offset + r.length <= packing.SEQUENCE for r in pieces)


def test_run_applies_all_stages(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert set(found.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert 0 < found.select("doc_id").distinct().count() < 240
    assert not {r.doc_id for r in found.select("doc_id").collect()} & {2000, 2001, 2002, 2003, 2004, 2005}


def test_empty_table_and_extra_columns_pass_every_stage_but_the_last(spark, folder, odd_columns):
    stages = [stage for name, stage in corpus_pipeline.STAGES if name != "packing"]
    for docs in (odd_columns, odd_columns.where("false")):
        for stage in stages:
            docs = stage(spark, docs, folder)
        assert docs.schema == odd_columns.schema
    assert docs.count() == 0
