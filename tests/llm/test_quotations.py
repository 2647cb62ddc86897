import random
import re
from collections import Counter, defaultdict

import pytest

from lodestone.llm import quotations

QUOTE = re.compile(r"^(?:[ \t]{0,3}>)+[ \t]?")


def normal(x):
    return re.sub(r"\s+", " ", x).strip(" ").lower()


def parse(text):
    out = []
    for pos, line in enumerate(re.split(r"\r?\n", text or "")):
        m = QUOTE.match(line)
        level = m[0].count(">") if m else 0
        norm = normal(line[m.end() :] if m else line)
        if norm:
            out.append((pos, level, norm))
    return out


def runs(lines):
    out = []
    for pos, level, norm in lines:
        if out and out[-1][0] == level and out[-1][1] + len(out[-1][2]) == pos:
            out[-1][2].append(norm)
        else:
            out.append((level, pos, [norm]))
    return out


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or "", turn))
    out = []
    for conv, messages in convs.items():
        messages.sort(key=lambda m: m[:4])
        said, parents, stats = [], [], []
        for seq, (*_, text, turn) in enumerate(messages):
            lines = parse(text)
            best, passages, linked = None, 0, 0
            for level, pos, norms in runs([x for x in lines if x[1] > 0]):
                passages += 1
                whole = " ".join(norms)
                origin = max((s for s in range(seq) if whole in said[s]), default=None)
                if origin is None:
                    votes = Counter()
                    for norm in norms:
                        hits = [s for s in range(seq) if norm in said[s]]
                        if hits:
                            votes[max(hits)] += 1
                    origin = max(((n, s) for s, n in votes.items()), default=(0, None))[1]
                if origin is not None:
                    linked += 1
                    best = min(best or (level, pos, origin), (level, pos, origin))
            own = [x for x in lines if x[1] == 0]
            said.append(
                {n for *_, n in own} | {" ".join(ns) for *_, ns in runs(own)} | {" ".join(n for *_, n in own)}
            )
            parents.append(best[2] if best else seq - 1)
            body = "\n".join(x for x in re.split(r"\r?\n", text) if not QUOTE.match(x))
            stats.append((passages, linked, re.sub(r"^(?:[ \t]*\n)+|\s+$", "", body)))
        order, stack = [], [s for s in range(len(messages)) if parents[s] == -1][::-1]
        while stack:
            s = stack.pop()
            order.append(s)
            stack += [c for c in range(len(messages)) if parents[c] == s][::-1]
        for seq, (m, st) in enumerate(zip(messages, stats)):
            reply = messages[parents[seq]][4] if parents[seq] >= 0 else None
            out.append((str(conv), str(m[4]), seq, order.index(seq), str(reply), *st))
    return sorted(out)


def dialogue(seed):
    rng = random.Random(seed)
    words = ["yes", "no", "maybe", "the plan", "is fine", "we go", "Tomorrow", "at  noon"]
    rows = []
    for conv in range(25):
        texts = []
        for turn in range(rng.randrange(1, 14)):
            lines = []
            for _ in range(rng.randrange(0, 3)):
                if texts and rng.random() < 0.8:
                    source = rng.choice(texts).split("\n")
                    a = rng.randrange(len(source))
                    part = source[a : a + rng.randrange(1, 4)]
                    lines += [rng.choice(["> ", ">", " >> ", ">  "]) + x.upper() for x in part]
                    if rng.random() < 0.5:
                        lines.append("> something never said %d" % rng.randrange(99))
                lines.append(rng.choice(["", " ".join(rng.choices(words, k=3)) + f" {rng.randrange(6)}"]))
            texts.append("\n".join(lines))
            rows.append((conv, turn * 700, rng.choice(["user", "assistant", None]), texts[-1]))
    return rows


AWKWARD = [
    (None, 1, "user", "hello"),
    (None, None, None, None),
    (None, 2, "user", "> hello\nhi"),
    (77, 5, "user", "same"),
    (77, 5, "user", "same"),
    (77, 5, "system", "> same"),
    (78, 0, "user", ""),
    (79, 0, "user", "> quoted before it was said"),
    (79, 1, "user", "quoted before it was said"),
    (80, 0, "user", "a > b is no quote"),
    (81, 0, "user", "line\n" * 5000),
    (81, 1, "user", "> line\n" * 5000 + "end"),
]


def shape(found):
    return sorted(
        (str(r.conv_id), str(r.turn), r.seq, r.position, str(r.reply_to_turn), r.passages, r.linked, r.body) for r in found
    )


def table(spark, rows):
    return spark.createDataFrame(
        [(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, seq int, level int"
    )


def test_equals_brute_force(spark):
    rows = dialogue(1) + AWKWARD
    random.Random(2).shuffle(rows)
    found = quotations.link_quotations(table(spark, rows).repartition(3)).collect()
    assert shape(found) == brute(rows)
    assert sum(r.linked for r in found) > 50 and any(r.position != r.seq for r in found)


def test_one_long_conversation_over_many_blocks(spark):
    rng = random.Random(4)
    rows = [(1, 0, "user", "first line")]
    for t in range(1, 2500):
        quote = rng.choice(["", "> first line\n", f"> said {rng.randrange(t)}\n" if t > 1 else ""])
        rows.append((1, t, "user", f"{quote}said {t}"))
    found = quotations.link_quotations(table(spark, rows)).collect()
    assert shape(found) == brute(rows)


def test_plan_has_no_python(spark, capsys):
    quotations.link_quotations(table(spark, dialogue(3))).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_empty(spark):
    assert quotations.link_quotations(table(spark, AWKWARD).where("false")).count() == 0


@pytest.mark.parametrize("text,level", [(">> a", 2), ("> > a", 2), ("   > a", 1), ("    > a", 0), ("a > b", 0), (">", 1)])
def test_levels(text, level):
    m = QUOTE.match(text)
    assert (m[0].count(">") if m else 0) == level
