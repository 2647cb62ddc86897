"""Best rows by block maxima against plain scores of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.operators import chunking, lifecycle, pruning, retrieval, retrievers
from lodestone.operators.retrievers import RECORD, Index, Request


def _words(rng, n, common, rare):
    return " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """2000 chunks, some of them copies and some of few words, and queries that are parts of chunks."""
    rng = random.Random(3)
    common, rare = [f"c{i}" for i in range(20)], [f"r{i}" for i in range(3000)]
    texts = [_words(rng, rng.choice([5, 30, 60]), common, rare) for _ in range(2000)]
    for i in range(0, 2000, 50):
        texts[i] = texts[7]
    rows = [(i, 0, f"data/{i}.txt", "manual" if i % 9 == 0 else "note", text, i % 13 == 0 and "soft_deleted" or "active") for i, text in enumerate(texts)]
    rows.append((2000, 0, "data/2000.txt", "note", "... !", "active"))  # no token
    chunks = spark.createDataFrame(rows, "doc_ord long, chunk_index int, source string, doc_type string, text string, status string")
    chunks = chunks.withColumn("source_unit_id", F.col("source"))
    queries = [(q, " ".join(texts[q * 37].split()[:25])) for q in range(40)] + [(90, "nowhere zzz"), (91, "... !"), (92, "c1")]
    return Index.write(chunks, f"file://{tmp_path_factory.mktemp('blocks')}"), spark.createDataFrame(queries, "query_id long, query string")


def request(corpus, **options):
    index, queries = corpus
    options = {"metadata_weight_rules": {"doc_type": {"manual": 1.3}}} | options
    spark = queries.sparkSession
    return Request(queries, index, Settings(**options), None, spark.createDataFrame([], RECORD), F.to_timestamp(F.lit("2024-02-01T00:00:00Z")))


def plain(asked_for, backend, k):
    """(query_id, rank, doc_ord, score) from scores of all pairs."""
    settings = asked_for.settings
    kept, asked = retrievers.candidates(asked_for), retrievers.asked_terms(asked_for)
    stay = kept.where("filter_reason is null")
    index = asked_for.index
    postings = index.postings.drop("block").join(stay.select(*retrieval.KEY), retrieval.KEY, "left_semi")

    def weighed(scores):
        rows = scores.join(stay, retrieval.KEY).withColumn("final", F.col("base") * F.col("metadata_weight") * F.col("boilerplate_penalty"))
        return retrieval.ranked(rows.where(F.col("final") >= settings.min_retrieval_score).withColumn("score", F.round("final", 4)), None)

    lexical = lambda: weighed(retrieval.lexical_scores(asked, postings, settings.lexical_similarity_metric))
    tfidf = lambda: weighed(retrieval.tfidf_scores(asked, postings, stay.count()))
    rows = {"lexical": lexical, "tfidf": tfidf, "hybrid": lambda: retrieval.ranked(retrieval.rrf(lexical(), tfidf(), settings.hybrid_rrf_k), None)}[backend]()
    return sorted((r.query_id, r["rank"], r.doc_ord, r.score) for r in rows.where(F.col("rank") <= k).collect())


def found(asked_for):
    return sorted((r.query_id, r["rank"], r.doc_ord, r.score) for r in retrievers.retrieve(asked_for).ranked.collect())


@pytest.mark.parametrize("options", [
    {}, {"lexical_similarity_metric": "jaccard", "min_retrieval_score": 0.01}, {"retrieval_backend": "tfidf", "min_retrieval_score": 0.02, "top_k": 30},
    {"retrieval_backend": "hybrid", "min_retrieval_score": 0.02},
], ids=str)
def test_equal_to_scores_of_all_pairs(corpus, options, monkeypatch):
    monkeypatch.setattr(pruning, "WORTH_A_FLOOR", 0)
    asked_for = request(corpus, **options)
    want = plain(asked_for, options.get("retrieval_backend", "lexical"), asked_for.settings.top_k)
    assert len(want) > 40 and found(asked_for) == want  # few hits: scored directly
    monkeypatch.setattr(pruning, "DIRECT_HITS", 0)
    assert found(asked_for) == want


def test_few_pairs_are_scored(spark, tmp_path, monkeypatch):
    """Where passages recur, at most a fifth of the pairs that share a term are scored."""
    monkeypatch.setattr(pruning, "WORTH_A_FLOOR", 0)
    monkeypatch.setattr(pruning, "DIRECT_HITS", 0)
    rng = random.Random(4)
    common, rare = [f"c{i}" for i in range(250)], [f"r{i}" for i in range(4000)]
    passages = [_words(rng, 25, common, rare) for _ in range(40)]
    texts = [_words(rng, 20, common, rare) + (" " + passages[i % 40] if i % 7 == 0 else "") for i in range(3000)]
    rows = [(i, 0, f"data/{i}.txt", text) for i, text in enumerate(texts)]
    index = Index.write(spark.createDataFrame(rows, "doc_ord long, chunk_index int, source string, text string"), f"file://{tmp_path}/index")
    queries = spark.createDataFrame(list(enumerate(passages)), "query_id long, query string")
    for backend in ("lexical", "tfidf"):
        asked_for = request((index, queries), retrieval_backend=backend, min_retrieval_score=0.05)
        work = retrievers.Work(asked_for, retrievers.candidates(asked_for).cache(), retrievers.asked_terms(asked_for).cache(), f"file://{tmp_path}/{backend}")
        scorer = retrievers.BACKENDS[backend]().scorer(work)
        work.best(scorer, 5, "x")
        scored = scorer.exact(spark.read.parquet(f"file://{tmp_path}/{backend}/x-pairs")).count()
        every = retrieval.lexical_scores(work.asked, index.postings).count()
        print(f"{backend}: {scored} of {every} pairs scored")
        assert every > 40_000 and 0 < scored * 5 < every


def test_bounds_hold_and_statistics_follow_the_filter(corpus, tmp_path):
    asked_for = request(corpus, retrieval_backend="tfidf", min_retrieval_score=0.0001)
    work = retrievers.Work(asked_for, retrievers.candidates(asked_for), retrievers.asked_terms(asked_for), f"file://{tmp_path}")
    for backend in ("lexical", "tfidf"):
        scorer = retrievers.BACKENDS[backend]().scorer(work)
        bounds = work.bounds(scorer, backend)
        rows = work.weighed(scorer.exact(bounds.select("query_id", "block"))).join(work.kept.select(*retrieval.KEY, "block"), retrieval.KEY)
        assert rows.join(bounds, ["query_id", "block"]).where(F.col("final") > F.col("bound") * pruning.SLACK).count() == 0
    index = asked_for.index
    gone = work.kept.where("filter_reason is not null").select(*retrieval.KEY)
    statistics = index.statistics(gone)
    stay = index.postings.join(gone, retrieval.KEY, "left_anti")
    df = {r.term: r["count"] for r in stay.groupBy("term").count().collect()}
    assert {r.term: r.df for r in statistics.weights.collect()} == df
    assert statistics.growth > 1 and statistics.n == index.chunks.count() - gone.count()


def test_a_threshold_of_zero_admits_chunks_without_hits(corpus):
    """Behind all hits come chunks in corpus order; chunks without tokens and queries without terms have none."""
    for backend in ("lexical", "hybrid"):
        got = found(request(corpus, retrieval_backend=backend, min_retrieval_score=0.0, top_k=4))
        assert [r[1:3] for r in got if r[0] == 90] == [(1, 1), (2, 2), (3, 3), (4, 4)]  # 0 is deleted
        assert not [r for r in got if r[0] == 91] and not [r for r in got if r[2] == 2000]
    alone = Index.write(corpus[0].chunks.drop("block").where("doc_ord in (3, 4, 5, 2000)"), f"{corpus[0].path}-few")
    spark = corpus[1].sparkSession
    word = alone.chunks.where("doc_ord = 5").first().text.split()
    queries = spark.createDataFrame([(1, next(w for w in word if w.startswith("r")))], "query_id long, query string")
    got = found(request((alone, queries), min_retrieval_score=0.0, top_k=9))
    assert [r[2] for r in got] == [5, 3, 4] and [r[3] > 0 for r in got] == [True, False, False]
    assert found(request((alone, queries), min_retrieval_score=0.001, top_k=9)) == got[:1]


def test_a_text_that_fills_the_corpus_fills_no_task(spark, monkeypatch):
    """A third of all chunks alike: their rows stay where they are, and the largest task has under four times the median."""
    monkeypatch.setattr(chunking, "HEAVY_ROWS", 100)
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for c, v in zip(before, ("-1", "false")):
        spark.conf.set(c, v)
    try:
        keys = spark.range(0, 30_000, 1, 8).select(
            F.col("id").alias("doc_ord"), F.lit(0).alias("chunk_index"),
            F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("pair"), F.floor(F.col("id") / 6))).otherwise(F.concat(F.lit("own"), "id")).alias("boilerplate_key"),
        )
        found = chunking.repeat_counts(keys, chunking.repeated_keys(keys), 30_000)
        sizes = sorted(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] < 4 * sizes[len(sizes) // 2]
        assert found.where("boilerplate_key = 'hot' and repeat_count = 10000").count() == 10_000
        assert found.where("boilerplate_key like 'pair%'").select("repeat_count").distinct().collect()[0][0] == 2
        assert found.where("boilerplate_key like 'own%'").count() == 0
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_filter_reasons_are_kept(corpus):
    kept = retrievers.candidates(request(corpus))
    assert kept.where("filter_reason = 'soft_deleted'").count() == len(range(0, 2000, 13))
    assert set(lifecycle.REASONS) >= {r[0] for r in kept.select("filter_reason").distinct().collect() if r[0]}
