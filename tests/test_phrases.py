"""Phrases found in texts by anchors against a plain search."""

import random

from lodestone.operators import evaluation


def test_anchored_phrases_equal_a_plain_search(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += ["a  b\tc d e\nf", "a b c d e f", "", None, "xw1 w2 w3 w4y", "dots. and, marks!"]
    phrases = []
    for i in range(80):
        text = texts[rng.randrange(300)]
        start = rng.randrange(len(text) + 1)
        phrases.append(text[start : start + rng.randint(0, 30)])
    phrases += ["", None, "b\tc d e", "b c d e f", "w1 w2 w3 w4", "w1 w2", "never said by any text here", " w1 w2 w3 ", "nd, marks", "w1"]
    a = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    b = spark.createDataFrame(list(enumerate(phrases)), "item long, phrase string")
    found = evaluation.containing(a, b, "doc", "item")
    got = sorted(map(tuple, found.collect()))
    want = sorted((k, i) for k, p in enumerate(phrases) for i, t in enumerate(texts) if p is not None and t is not None and p in t)
    assert found.columns == ["item", "doc"] and got == want
    plan = evaluation.containing(a, b.where("length(phrase) > 12"), "doc", "item")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert evaluation.containing(a.limit(0), b, "doc", "item").count() == 0
    assert evaluation.containing(a, b.limit(0), "doc", "item").count() == 0
