import random
import zlib

import numpy as np
import pytest

from lodestone.llm import language as lg
from tests.llm.conftest import AWKWARD

WORDS = {
    "en": "the of and river stone house light under green walks with that".split(),
    "fr": "le la les été où rivière pierre maison lumière sous verte avec".split(),
    "de": "der die das fluß stein häuser licht unter grün läuft mit über".split(),
}


def corpus(n=420):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randrange(8, 60))), lang if rng.random() < 0.9 else None))
    return rows


def test_segments():
    codes, of_text = lg.segments([b"abcde", b"", b"xyz"], 4)
    assert codes.T.tolist() == [[97, 98, 99, 100], [101, 256, 256, 256], [120, 121, 122, 256]]
    assert of_text.tolist() == [0, 0, 2]


def test_backpropagation_equals_differences():
    rng = np.random.default_rng(0)
    net = lg.train_network([b"abc"] * 3, ["a", "b", "c"], steps=1, hidden=3)
    for part in (net.ahead, net.back):
        part.inputs, part.carry = part.inputs.astype(float), part.carry.astype(float)
    codes = rng.integers(97, 103, (6, 5)).astype(np.int16)
    codes[4:, 1] = 256
    truth = np.array([0, 1, 2, 0, 1])
    weights = [net.ahead.inputs, net.ahead.carry, net.back.inputs, net.back.carry, net.output]
    for w, g in zip(weights, lg._gradients(net, codes, truth)):
        for at in [(0, 0), (2, 1), (1, 2)] if w.shape[1] < 200 else [(0, 98), (4, 99), (8, 100)]:
            old, step = w[at], 3e-2
            w[at] = old + step
            up = lg.loss(net, codes, truth)
            w[at] = old - step
            down = lg.loss(net, codes, truth)
            w[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 3e-3


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus() + [(i, t, "en") for i, t in AWKWARD] + [(900, "123 !? 45", "fr"), (901, "ß", "de")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, score int, row int")
    net = lg.train(docs)
    return rows, docs, net, lg.predict(docs.repartition(3), net).collect()


def test_held_out_accuracy(scored):
    rows, _, net, found = scored
    assert net.languages == ["de", "en", "fr"] and len(found) == len(rows)
    truth = {i: lang for i, _, lang in corpus() if lang}
    for r in found:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_texts_without_letters(scored):
    _, _, _, found = scored
    assert {r.doc_id for r in found if r.lang_pred == "und"} >= {7, 8, 10, 900}
    assert all(r.score == 0 for r in found if r.lang_pred == "und")
    assert next(r for r in found if r.doc_id == 901).lang_pred != "und"


def test_documents_do_not_depend_on_their_neighbours(scored):
    rows, _, net, _ = scored
    texts = [t.encode() for _, t, _ in rows[:40]]
    together = net.documents(texts)
    assert np.allclose(together, np.concatenate([net.documents([t]) for t in texts]), atol=1e-4)


def test_degenerate_training(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in lg.predict(docs, lg.train(docs)).collect()} == {"und"}
    one = spark.createDataFrame([(i, "abc", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in lg.predict(one, lg.train(one)).collect()} == {("en", 1.0)}
    assert lg.predict(one.where("false"), lg.train(one)).count() == 0


def step_by_step(net, text):
    """Distribution over languages of one whole text, one byte and one number at a time."""
    squash = lambda x: x / (1 + abs(x))
    h = net.ahead.carry.shape[1]

    def read(gated, codes):
        state, out = [0.0] * h, []
        for c in codes:
            carried = [sum(float(gated.carry[r, k]) * state[k] for k in range(h)) for r in range(3 * h)]
            given = [float(gated.inputs[r, c]) for r in range(3 * h)]
            update = [0.5 + 0.5 * squash(given[k] + carried[k]) for k in range(h)]
            reset = [0.5 + 0.5 * squash(given[h + k] + carried[h + k]) for k in range(h)]
            fresh = [squash(given[2 * h + k] + reset[k] * carried[2 * h + k]) for k in range(h)]
            state = [update[k] * state[k] + (1 - update[k]) * fresh[k] for k in range(h)]
            out.append(state)
        return out

    total = [0.0] * len(net.languages)
    for at in range(0, len(text), lg.SEGMENT):
        codes = list(text[at : at + lg.SEGMENT])
        full = codes + [256] * (lg.SEGMENT - len(codes))
        ahead, back = read(net.ahead, full), read(net.back, full[::-1])[::-1]
        for t in range(len(codes)):
            both = [*ahead[t], *back[t], 1.0]
            logits = [sum(float(w) * x for w, x in zip(row, both)) for row in net.output]
            log_z = np.log(sum(np.exp(x - max(logits)) for x in logits)) + max(logits)
            total = [a + x - log_z for a, x in zip(total, logits)]
    shares = np.exp(np.array(total) / max(1, len(text)))
    return shares / shares.sum()


def test_predictions_equal_a_network_of_single_steps(scored):
    rows, _, net, found = scored
    texts = {i: t for i, t, _ in rows if i is not None and t and len(t) < 400}
    some = [r for r in found if r.doc_id in texts and r.lang_pred != "und"][:12]
    assert len(some) == 12
    for r in some:
        shares = step_by_step(net, texts[r.doc_id].encode())
        assert net.languages[int(shares.argmax())] == r.lang_pred and abs(shares.max() - r.score) < 1e-3
