"""Personal data: rules against plain patterns, messages against enumeration, likeness over distance."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from lodestone.llm import pii as op

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_base(text):
    """Spans of the rules in code points, by the patterns as they are stated."""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and plain_luhn(digits(m))]
    found += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def card(seed):
    rng = random.Random(seed)
    head = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(head + c for c in "0123456789" if plain_luhn(head + c))


def prepared(text):
    data = text.encode()
    classes = op._CLASS[np.frombuffer(data, np.uint8)]
    base = op.base_spans(data, classes)
    return data, base, op.tokens_of(data, classes, base)


def test_rules_equal_the_stated_patterns():
    rng = random.Random(5)
    bits = ["a", "b.c", "@", "x@y.zz", ".", "..", "-", "+", "+1 ", "(743) ", "555-3824", " ", " ", "é", "192.168.0.1", "256.1.1.1", "007.0.0.9", card(1), card(2)[:15], "12", "\n", "%", "4 4", "1.2.3.4.5.6.7.8", "!", "a@b", "@c.d"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        data, base, _ = prepared(text) if text else (b"", [], None)
        assert op._joined(op._places(data, base)).split(",") == (plain_base(text) or [""]), text


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "1 " * 200_000, "a@" * 100_000, "+1" + " " * 300_000, "." * 300_000 + "1", "1." * 150_000, "(" * 300_000 + "@"])
def test_endless_runs_take_linear_time(text):
    began = time.perf_counter()
    prepared(text)
    assert time.perf_counter() - began < 20


def _random_graph(rng, n, hubs):
    follows = rng.random(n) < 0.6
    follows[0] = False
    member = np.concatenate([rng.choice(n, size, replace=False) for size in hubs]) if hubs else np.zeros(0, np.int64)
    hub = np.repeat(np.arange(len(hubs)), hubs)
    return rng.normal(size=(n, op.LABELS)), rng.normal(size=(op.LABELS, op.LABELS)), follows, member.astype(np.int64), hub.astype(np.int64)


def _enumerated(nodes, change, follows, member, hub, alike):
    n, n_hubs = len(nodes), int(hub.max(initial=-1)) + 1
    out = np.zeros_like(nodes)
    for ys in itertools.product(range(op.LABELS), repeat=n):
        score = sum(nodes[i, y] for i, y in enumerate(ys)) + sum(change[ys[i - 1], ys[i]] for i in np.flatnonzero(follows))
        weight = np.exp(score)
        for h in range(n_hubs):  # a hub's label is summed out
            own = [ys[i] for i in member[hub == h]]
            weight *= sum(np.exp(alike * sum(y == label for y in own)) for label in range(op.LABELS))
        out[np.arange(n), list(ys)] += weight
    return out / out.sum(1, keepdims=True)


def test_messages_are_exact_without_loops():
    rng = np.random.default_rng(2)
    for _ in range(5):
        nodes, change, follows, *_ = _random_graph(rng, 5, [])
        none = np.zeros(0, np.int64)
        assert np.allclose(np.exp(op.beliefs(nodes, change, follows, none, none, 1.0)), _enumerated(nodes, change, follows, none, none, 1.0))
    for _ in range(5):  # one hub, no chains: a star
        nodes, change, follows, member, hub = _random_graph(rng, 5, [4])
        follows[:] = False
        got = np.exp(op.beliefs(nodes, change, follows, member, hub, 1.5))
        assert np.allclose(got, _enumerated(nodes, change, follows, member, hub, 1.5))
    nodes, change, follows, *_ = _random_graph(rng, 5, [])  # two chains and a hub between them: a tree
    follows[:] = [False, True, False, True, True]
    member, hub = np.array([1, 3]), np.array([0, 0])
    assert np.allclose(np.exp(op.beliefs(nodes, change, follows, member, hub, 2.0)), _enumerated(nodes, change, follows, member, hub, 2.0))


def test_messages_are_close_with_loops():
    rng = np.random.default_rng(4)
    for _ in range(8):
        nodes, change, follows, member, hub = _random_graph(rng, 5, [3, 2])
        got = np.exp(op.beliefs(nodes, change, follows, member, hub, 1.0, rounds=40))
        want = _enumerated(nodes, change, follows, member, hub, 1.0)
        assert np.abs(got - want).max() < 0.12 and (got.argmax(1) == want.argmax(1)).mean() >= 0.8


def corpus():
    """Documents with planted data in the style of the tables, and clean ones."""
    rng = random.Random(9)
    words = "the of and river stone light over under quiet green field about".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(400):
        found = [
            f"{rng.choice(words)}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com",
            ".".join(str(rng.randint(1, 250)) for _ in range(4)),
            card(i),
            f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
            f"in {rng.randint(1900, 2030)}",
            f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}",
            f"{rng.randint(1, 500)} items",
        ]
        again = found[i % 7] if i % 3 == 0 else say(2)
        rows.append((i, f"{say(5)} {found[i % 7]} {say(5)} {found[(i // 7) % 7]} {say(3)} {again} {say(1)}."))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return op.train(spark.createDataFrame(corpus(), "doc_id long, text string"))


def _added(model, text):
    data, base, tokens = prepared(text)
    (labels,) = model.labels([tokens])
    return [(op.KINDS[k - 1], data[a:b].decode()) for a, b, k in op.added_spans(data, tokens, labels, base)]


def test_likeness_carries_labels_over_distance(model):
    number, far = card(777), "the quiet river " * 500
    assert _added(model, f"{number} {far} {number} {number} end") == [("card", number), ("card", number)]  # no rule finds the pair
    assert ("phone", "743-555-3824") in _added(model, f"call +1 (743) 555-3824 {far} or 743-555-3824 now")
    assert ("email", "stone.42") in _added(model, f"to stone.42@mail7.example.com {far} ask stone.42 about")
    # The same tokens without their likes are plain.
    assert _added(model, f"{far} ask stone.42 about") == []


def test_clean_documents_are_left_alone(model):
    for text in ["in 1998 the river", "version 2.1 of 3 items, 40 of 77", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "no number at all", "a @ b 5"]:
        assert _added(model, text) == [], text


def test_rows(spark, awkward, odd_columns, model):
    texts = [t for _, t in corpus()[:40]] + ["", None, "é " * 10 + "hein.19@mail5.example.com é " + card(3) + " " + card(3), "1" * 50_000]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(1, texts[1]), (1, texts[1])]
    got = sorted(map(tuple, op.find(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()), key=str)
    want = []
    for i, t in rows:
        base = plain_base(t or "")
        spans = []
        if t:
            data, found, tokens = prepared(t)
            spans = op._places(data, op.added_spans(data, tokens, model.labels([tokens])[0], found))
        every = sorted([(int(s.split(":")[1]), op.KINDS.index(s.split(":")[0]), s) for s in base] + [(a, k - 1, f"{op.KINDS[k - 1]}:{a}:{b}") for a, b, k in spans])
        count = [sum(s.startswith(k) for s in base) for k in op.KINDS]
        want.append((i, *count, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(s for *_, s in every), len(spans)))
    assert got == sorted(want, key=str)
    assert op.find(awkward, model).count() == awkward.count()
    assert op.find(odd_columns, model).count() == odd_columns.count()
    empty = spark.createDataFrame([], "doc_id long, text string")
    untrained = op.train(empty)
    assert not untrained.trained and op.find(empty, untrained).count() == 0
    assert op.find(awkward, untrained).agg({"n_added": "sum"}).first()[0] == 0
