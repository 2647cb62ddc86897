import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lodestone.llm import attention as at
from lodestone.llm import lm_scoring as lm
from lodestone.llm import subwords
from tests.llm.conftest import AWKWARD

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def corpus(n=300):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("the", "sto", "ri", "wal", "é") for b in ("ne", "ver", "k", "s", "", "ing")]
    return [(i, " ".join(rng.choices(words, k=rng.randrange(0, 50))).title()) for i in range(n)] + AWKWARD


def tokens(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return [*re.findall(rb"[^\x20\x09-\x0D]+", low), None]


def brute_base(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(t for (i, x), h in zip(rows, held) if not h and i is not None for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    norm = n + 0.1 * (v + 1)
    return [
        (
            str(i),
            h,
            len(tokens(x)),
            sum(counts[t] > 0 for t in tokens(x)),
            n,
            round(sum(math.log10((counts[t] + 0.1) / norm) for t in tokens(x)), 4),
        )
        for (i, x), h in zip(rows, held)
    ]


@pytest.fixture(scope="module")
def scored(docs_of):
    rows = corpus()
    return rows, [
        lm.score(docs_of(rows).repartition(3), PATH, public_tokenizers.PATTERN, top_words=k, steps=120).collect() for k in (0, 12, 10_000)
    ]


def test_base_equals_brute_force(scored):
    rows, runs = scored
    for found in runs:
        got = [
            (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found
        ]
        for a, b in zip(sorted(got), sorted(brute_base(rows)), strict=True):
            assert a[:5] == b[:5] and abs(a[5] - b[5]) < 2e-4 * max(1, abs(b[5]))


def test_model_beats_the_baseline_on_held_out_texts(docs_of):
    rng = random.Random(2)
    rhyme = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = [(i, " ".join((rhyme * 9)[(k := rng.randrange(12)) : k + rng.randrange(30, 90)])) for i in range(300)]
    found = lm.score(docs_of(rows).repartition(3), PATH, public_tokenizers.PATTERN, steps=300).collect()
    held = [r for r in found if r.held_out]
    assert len(held) > 10 and all(r.score < 0 for r in held)
    # Negative sums: the model's must be the smaller ones, here by far, as the words before tell the next.
    assert sum(r.score for r in held) > 0.5 * sum(r.base_score for r in held)


def test_words_that_nothing_foretells_cost_no_more_than_by_counts(scored):
    _, runs = scored
    held = [r for r in runs[0] if r.held_out and r.n_tokens < 1000]
    assert len(held) > 10 and all(r.score < 0 for r in held)
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + math.log10(0.98) * sum(r.n_tokens for r in held)


def test_words_determine_ids():
    cache = subwords.byte_bpe(PATH, public_tokenizers.PATTERN, limit=5)
    import base64

    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(PATH, "rb"))}
    for text in [b"a don't  b\xc3\xa9 ### x1", b"", "  你".encode()]:
        ids = np.frombuffer(cache.ids_of(text), np.uint32)
        assert b"".join(ranks[int(i)] for i in ids).split() == text.split()


def tiny():
    counts = np.r_[np.arange(60)[::-1] * 5, 7]
    return at.Vocabulary.of_counts(counts, np.arange(61) % 2 == 0)


def test_probabilities_sum_to_one():
    voc = tiny()
    assert np.allclose(np.bincount(voc.class_of, np.exp(voc.log_share)), 1)
    model = at.fit(voc, [np.arange(40) % 7] * 3, steps=3)
    history = np.array([3, 1, 4, 1, 5] * 4)
    stem = [model.text_scores([np.r_[history, i]]) - model.text_scores([np.r_[history, i, 0]]) for i in range(3)]
    assert all(np.isfinite(stem))
    # P(end | h) + sum over ids of P(id | h) = 1, with P(id | h) from texts that share h.
    ends = np.exp(model.text_scores([history]))[0]
    total = ends
    prefix = brute(model, history)
    assert abs(np.exp(prefix[1]).sum() - 1) < 1e-4
    assert abs(prefix[0] - np.log(total)) < 1e-3


def brute(model, ids):
    """(log probability of ids and end, log distribution after the last id), one position at a time."""
    voc, d = model.vocabulary, at.WIDTH
    end = len(voc.class_of) - 1
    x = model.embed[voc.row_of[np.r_[end, ids]]].astype(float)
    total = 0.0
    for t, target in enumerate([*ids, end]):
        low = max(0, (t // at.BLOCK - 1) * at.BLOCK)
        q = x[t] @ model.project[:, :d]
        k, v = x[low : t + 1] @ model.project[:, d : 2 * d], x[low : t + 1] @ model.project[:, 2 * d :]
        s = k @ q / math.sqrt(d) + model.distance[t - np.arange(low, t + 1)]
        p = np.exp(s - s.max())
        state = np.r_[p @ v / p.sum() + x[t], 1]
        outer = state @ model.families
        outer = outer - np.log(np.exp(outer).sum())
        inner = [state @ m - np.log(np.exp(state @ m).sum()) for m in model.output.astype(float)]
        classes = np.concatenate([a + b for a, b in zip(outer, inner)])
        dist = classes[voc.class_of] + voc.log_share
        total += dist[target]
    return total, dist


def test_blocks_equal_one_position_at_a_time():
    rng = np.random.default_rng(3)
    model = at.fit(tiny(), [rng.integers(0, 60, 50) for _ in range(4)], steps=20)
    texts = [rng.integers(0, 60, n) for n in (0, 1, 15, 16, 17, 31, 32, 33, 100)]
    got = model.text_scores(texts)
    assert np.allclose(got, [brute(model, t)[0] for t in texts], rtol=1e-4)
    assert np.allclose(got, np.concatenate([model.text_scores([t]) for t in texts]), rtol=1e-5)


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    model = at.Attention.untrained(tiny())
    for name in ("embed", "project", "distance", "families", "output"):
        setattr(model, name, getattr(model, name).astype(float))
    inputs, targets, first = at.cut_flat(*at.flat([rng.integers(0, 60, 70), rng.integers(0, 60, 20)]), 60)
    args = inputs, inputs[np.maximum(np.arange(len(inputs)) - 1, 0)], first, targets
    _, gradients = model.gradients(*args)
    for w, g in zip(model.weights(), gradients):
        flat = np.argsort(-np.abs(g).ravel())[[0, 3, 9]]
        for i in flat:
            place = np.unravel_index(i, w.shape)
            old = w[place]
            w[place] = old + 1e-3
            up = model.gradients(*args)[0]
            w[place] = old - 1e-3
            down = model.gradients(*args)[0]
            w[place] = old
            assert abs((up - down) / 2e-3 - g[place]) < 1e-3 * max(1, abs(g[place]))


def test_empty_tables(docs_of, awkward):
    assert lm.score(awkward.where("false"), PATH, public_tokenizers.PATTERN, steps=5).count() == 0
    alone = lm.score(docs_of([(None, "a b"), (None, None)]), PATH, public_tokenizers.PATTERN, steps=5).collect()
    assert {(r.train_tokens, r.n_known, r.base_score) for r in alone} == {(0, 0, 0.0)}


def test_cached_ids_equal_the_library():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    cache = subwords.byte_bpe(PATH, public_tokenizers.PATTERN, limit=3)
    text = "word, word. don't o'clock' été!! straße? x1, 12. a'b, ... 'tis we'll, 你好， end"
    ids = np.frombuffer(cache.ids_of(text.encode()), np.uint32).tolist()
    assert ids == [i for w in text.split(" ") for i in library.encode_ordinary(" " + w)]


def test_score_does_not_depend_on_the_words_sent_to_tasks(scored):
    _, runs = scored
    few, some, all_words = (sorted((str(r.doc_id), r.held_out, r.n_tokens, r.score) for r in found) for found in runs)
    for a, b, c in zip(few, some, all_words, strict=True):
        assert a[:3] == b[:3] == c[:3]
        assert math.isclose(a[3], c[3], rel_tol=1e-9) and math.isclose(b[3], c[3], rel_tol=1e-9)


def test_every_training_document_is_learned_from(docs_of):
    rows = [(i, "one two three four " * 40) for i in range(60)]
    (model, _), (moved, _) = (
        lm.train(docs, lm.word_counts(docs), PATH, public_tokenizers.PATTERN, sample_docs=0, steps=5)
        for docs in (docs_of(rows).repartition(3), docs_of(rows).coalesce(1))
    )
    start = at.fit(model.vocabulary, [])
    assert any(not np.allclose(a, b) for a, b in zip(model.weights(), start.weights()))
    ids = np.frombuffer(subwords.byte_bpe(PATH, public_tokenizers.PATTERN).ids_of(rows[0][1].encode()), np.uint32)
    assert model.text_scores([ids.astype(np.int64)])[0] > start.text_scores([ids.astype(np.int64)])[0]
    assert all(np.allclose(a, b) for a, b in zip(model.weights(), moved.weights()))


def test_mixture_of_ratios_equals_occurrence_by_occurrence():
    ratio = np.random.default_rng(4).normal(-1, 3, 2000)
    share = 0.5
    for _ in range(30):
        share = float(np.mean(share * np.exp(ratio) / (share * np.exp(ratio) + 1 - share)))
    steps, place = np.unique(np.floor(ratio * lm.RATIO_STEPS), return_inverse=True)
    assert abs(lm._mixture(zip(np.bincount(place), np.bincount(place, ratio))) - share) < 1e-3


def test_the_mixture_is_fitted_on_every_training_document():
    """Every word of every text enters the histogram or, beyond the table, goes on to the counts."""
    texts = [b"one two two", b"three", b"", b"one four five"] * 5
    table = lm.Table({b"one": -1.0, b"two": -1.2}, 2.0, -1.0)
    shared = lambda x: SimpleNamespace(value=x)
    run = lm._learn(shared(at.fit(tiny_bytes(), [])), shared(table), PATH, public_tokenizers.PATTERN)
    found = [r for b in run(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])])) for r in b.to_pylist()]
    assert sum(r["n"] for r in found if r["kind"] == lm._RATIO) == 5 * 4
    assert sum(r["kind"] == lm._BEYOND for r in found) == 5 * 3


def tiny_bytes():
    """A vocabulary of all byte-level ids, each met once."""
    counts = np.ones(lm.IDS + 1, np.int64)
    return at.Vocabulary.of_counts(counts, lm._starts_word(PATH))
