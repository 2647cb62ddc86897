"""Few queries against all chunks in one pass: what leaves a task, and that nothing of the best is lost."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import pruning, retrieval, retrievers, scan
from lodestone.plans import catalog


def test_best_of_slices_with_many_ties():
    rng, floors = np.random.default_rng(5), np.full(6, -np.inf)
    scores = rng.integers(0, 4, (6, 400)).astype(float)
    scores[:, ::7] = -np.inf
    scores[5] = -np.inf
    held = []
    for at in range(0, 400, 50):
        i, j = scan.best(scores[:, at : at + 50], 5, floors)
        held += [(q, -scores[q, at + c], at + c) for q, c in zip(i.tolist(), j.tolist())]
    for q in range(6):
        want = sorted((-s, c) for c, s in enumerate(scores[q]) if s > -np.inf)[:5]
        assert sorted((s, c) for x, s, c in held if x == q)[:5] == want
    assert len(held) < 6 * 5 * 8  # floors keep later slices short


def test_vectors_leave_their_tasks_only_as_best_rows(spark):
    """5000 vectors that all reach the threshold, most of them copies: 3 rows of each query a block, not 5000."""
    vectors = spark.range(5000).repartition(1).select(
        F.col("id").alias("vec"), F.array(F.lit(0.6), F.when(F.col("id") % 10 == 0, 0.7).otherwise(0.8)).alias("vector"), F.when(F.col("id") == 4999, 1.5).otherwise(1.0).alias("w")
    )
    queries = spark.createDataFrame([(1, [0.6, 0.8]), (2, [1.0, 0.0])], "query_id long, query_vector array<double>")
    found = retrieval.vector_scores(queries, vectors, "cosine", 0.25, 3, ("w",)).collect()
    assert len(found) < 2 * 3 * 4
    best = {q: sorted((-r.score, r.vec) for r in found if r.query_id == q)[:3] for q in (1, 2)}
    assert best[1] == [(-1.5, 4999), (-1.0, 1), (-1.0, 2)] and best[2] == [(-0.9, 4999), (-0.6, 0), (-0.6, 1)]


def test_vectors_meet_queries_in_blocks_however_they_come(spark, monkeypatch):
    """Small batches of Arrow are gathered into blocks, so a block's best rows leave it and not each batch's."""
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + n), pa.int64())], ["a"]) for i, n in ((0, 0), (0, 3), (3, 9), (12, 1), (13, 2))]
    found = [b.column(0).to_pylist() for b in retrieval.blocks(iter(batches), 4)]
    assert [len(x) for x in found] == [4, 4, 4, 3] and sum(found, []) == list(range(15)) and not list(retrieval.blocks(iter([]), 4))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
        test_vectors_leave_their_tasks_only_as_best_rows(spark)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_features_are_counted_as_arrays(monkeypatch):
    """Against one feature at a time: short and empty texts, wide alphabets, long n-grams, and tables that overflow and collide."""
    texts = ["", "a", "ab", " x  y ", "\u4e2d\u6587ab\U0001f600 c", "x" * 3000, "a\nb\tc a", "".join(map(chr, range(0x4E00, 0x6000))), " ".join(f"w{i}" for i in range(400))]

    def plain(body, dim, sizes):
        out, joined = np.zeros(dim), body.replace(" ", "_")
        found = [(f"tok:{w}", 1.0) for w in body.split()]
        for f, w in found + [(f"ch{n}:{joined[i : i + n]}", 0.35) for n in sizes for i in range(len(joined) - n + 1)]:
            out[int(hashlib.sha1(f.encode()).hexdigest()[:16], 16) % dim] += w
        return out

    for known, dim, sizes in ((retrieval.KNOWN_FEATURES, 256, range(3, 6)), (700, 17, range(1, 6)), (700, 64, range(2, 8)), (700, 31, ())):
        monkeypatch.setattr(retrieval, "KNOWN_FEATURES", known)
        retrieval.feature_buckets.cache_clear()
        for _ in range(2):
            got = np.vstack([retrieval.feature_weights(texts[i : i + 4], dim, sizes) for i in range(0, len(texts), 4)])
            assert np.allclose(got, [plain(x, dim, sizes) for x in texts], rtol=0, atol=1e-9)
    retrieval.feature_buckets.cache_clear()


def test_embedding_takes_a_part_of_the_time(monkeypatch):
    """A text of 120 words has some two thousand features: hashed or looked up one by one they took 3 ms."""
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(97, 105, rng.integers(2, 9)))) for _ in range(2000)]
    texts = [" ".join(rng.choice(words, 120)) for _ in range(1024)]
    retrieval.feature_weights(texts, 256, range(3, 6))
    began = time.perf_counter()
    retrieval.feature_weights(texts, 256, range(3, 6))
    assert time.perf_counter() - began < 1.2


def test_ranker_scans_and_joins_alike(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, 0, " ".join(["a"] * (i % 5) + ["b"] * (i % 3) + ["c"])) for i in range(300)], "doc_ord long, chunk_index int, text string")
    queries = spark.createDataFrame([(1, "a b"), (2, "b zz"), (3, "zz"), (4, "")], "query_id long, query string")
    ask = lambda: sorted(map(tuple, retrieval.rank_by_counts(queries, chunks, 4).select("query_id", "rank", "doc_ord", "score").collect()))
    assert "Join" not in (plan := scan.best_rows(
        chunks.select("doc_ord", "chunk_index", F.split("text", " ").alias("terms")), queries,
        scan.Asked.of(queries.select("query_id", F.lit(1).alias("asked"), F.explode(F.split("query", " ")).alias("term")), "count"), 0.0, 4, retrieval.KEY, [],
    )._jdf.queryExecution().toString()) and "Exchange" not in plan
    scanned = ask()
    monkeypatch.setattr(retrieval, "SCANNED", -1)
    assert scanned == ask() and len(scanned) == 16


def test_tasks_of_postings_hold_a_stated_number_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(pruning, "TASK_CHUNKS", 10)
    held = spark.range(100).select(F.shiftright("id", 4).alias("block"), F.col("id").alias("doc_ord"), F.lit(0).alias("chunk_index"), F.lit("Aa aa b_1 K").alias("text"))
    counts = pruning.term_counts(held)
    assert {tuple(sorted(zip(r.terms, r.tfs))) for r in counts.collect()} == {(("aa", 2), ("b_1", 1))}
    assert pruning.flat_postings(counts, 100).rdd.getNumPartitions() == 10


def test_postings_of_frequent_terms_stay_where_they_are(spark, monkeypatch):
    """Beyond what a broadcast holds, terms of fewer chunks are looked up in a shuffle, and no others."""
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 20)
    n = F.col("id") % 64
    index = spark.range(0, 4096, 1, 8).select(F.col("id").alias("doc_ord"), F.concat(F.lit("t"), F.when(n < 16, n).otherwise(F.col("id"))).alias("term"))
    index = index.withColumn("home", F.spark_partition_id())
    weights = index.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", 1 / F.col("df"))
    assert retrieval.frequent(weights) == 2
    found = retrieval.with_idf(index, weights).withColumn("at", F.spark_partition_id()).collect()
    assert len(found) == 4096 and all(r.idf == (1 / 64 if r.doc_ord % 64 < 16 else 1.0) for r in found)
    assert all(r.at == r.home for r in found if r.doc_ord % 64 < 16)


def test_lengths_are_summed_where_the_chunks_lie(spark, monkeypatch, tmp_path):
    """With all terms looked up, and with only the most frequent ones, against plain sums; a small vocabulary moves no posting."""
    rows = [(0, i, i % 3, [f"t{j}" for j in range(i % 7)] + [f"u{i}"] * (i % 4 == 1), [j + 1 for j in range(i % 7)] + [i] * (i % 4 == 1)) for i in range(300)]
    counts = spark.createDataFrame(rows, "block long, doc_ord long, chunk_index int, terms array<string>, tfs array<long>").repartition(3)
    df = Counter(x for r in rows for x in r[3])
    idf = {x: 1 + 1 / n for x, n in df.items()}
    weights = spark.createDataFrame([(x, n, idf[x]) for x, n in df.items()], "term string, df long, idf double")
    want = {(r[1], r[2]): (sum((f * idf[x]) ** 2 for x, f in zip(r[3], r[4])) ** 0.5, len(r[3])) for r in rows if r[3]}
    monkeypatch.setattr(pruning, "exploded", lambda rows, real=pruning.exploded: moved.append(rows.count()) or real(rows))
    for limit, n in ((1_000_000, []), (10, [75])):
        moved = []
        monkeypatch.setattr(retrieval, "BROADCAST_TERMS", limit)
        found = pruning.lengths(counts, weights, f"file://{tmp_path}/lengths{limit}").collect()
        got = {(r.doc_ord, r.chunk_index): (r.norm, r.distinct_terms) for r in found}
        assert got.keys() == want.keys() and moved == n
        assert all(abs(got[k][0] - x) < 1e-9 and got[k][1] == n for k, (x, n) in want.items())


def test_a_threshold_of_zero_scans_once(spark, monkeypatch):
    """Rows that fill a list up are looked for beside the hits, not beside a second scan."""
    plans, real = [], retrievers.Work.written
    monkeypatch.setattr(retrievers.Work, "written", lambda work, table, name: plans.append(table._jdf.queryExecution().toString()) or real(work, table, name))
    found = catalog.QUERIES["lex_zero_threshold_topk"](spark, "/root/testdata/sf0.001")
    assert found.count() and ["MapInArrow" in plan for plan in plans] == [True, False]


def test_only_asked_terms_are_moved_to_their_factors(spark):
    counts = spark.createDataFrame([(1, 0, ["a", "b", "c"], [3, 1, 2]), (2, 0, ["d"], [1]), (3, 1, [], []), (4, 0, ["c", "x"], [7, 1])], "doc_ord long, chunk_index int, terms array<string>, tfs array<long>")
    found = scan.narrowed(counts, ["c", "a", "zz"]).collect()
    assert sorted((r.doc_ord, r.chunk_index, r.terms, r.tfs) for r in found) == [(1, 0, ["a", "c"], [3, 2]), (4, 0, ["c"], [7])]


def test_counts_equal_tokens(spark):
    """Tokens of all kinds of texts, against a plain count; letters that lower-case to ASCII are none of a token's."""
    texts = ["", None, " ", "a", " A b_1  a\n9Z ", "\u212a \u0130x na\u00efve \u4e2d\u6587ab\U0001f600C", "x" * 70_000, "\x00a\x00\u00a0b"]
    rows = spark.createDataFrame([(i, 0, i, x) for i, x in enumerate(texts)], "block long, chunk_index int, doc_ord long, text string").coalesce(1)
    got = {r.doc_ord: dict(zip(r.terms, r.tfs)) for r in pruning.term_counts(rows).collect()}
    assert got == {i: dict(Counter(x.lower() for x in re.findall("[A-Za-z0-9_]+", text or ""))) for i, text in enumerate(texts)}


def test_products_are_of_single_precision_where_that_is_exact(monkeypatch):
    """Counts of half the size of 2 ** 24 in single precision, twice as large ones in double, with exact sums in both."""
    asked = scan.Asked([1], np.array([2.0]), np.ones(1), ["a", "b"], np.array([0, 0]), np.array([0, 1]), np.ones(2), "count")
    kinds, product = [], scan.product
    monkeypatch.setattr(scan, "product", lambda m, held: kinds.append(held.dtype) or product(m, held))
    for n in (1 << 22, 1 << 24):
        rows = pa.RecordBatch.from_pydict({"doc_ord": [0], "terms": [["a", "b"]], "tfs": [[n, n + 1]]})
        (part,) = scan._slices(iter([rows]), asked, ["doc_ord"], [])
        assert part.base.tolist() == [[2.0 * n + 1]] and part.base.dtype == float
    assert kinds == [np.float32, np.float64]
