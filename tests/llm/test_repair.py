"""Conversation repair against an exhaustive search, and in every cut of a conversation."""

import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import repair as op

KINDS = [letter + fault for letter in "sua " for fault in "xt-"]


def exhaustive(rows):
    """Cheapest (cost, audit, lines) over all edits of (role, text, fault) rows, up to two insertions a gap."""
    best = None
    gaps = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]

    def edits(role, text, fault):
        yield 2, "D", None
        if fault in ("sound", "truncated"):
            late = 5 if fault == "truncated" else 0
            yield late, "K", (role, text)
            for new in ("user", "assistant"):
                yield 1 + late, "R", (new, text)

    choices = [list(edits(*row)) for row in rows]
    for edit in itertools.product(*choices):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, turns = 0, "", []
            for i, new in enumerate(put):
                cost, audit, turns = cost + 5 * len(new), audit + "I" * len(new), turns + [(r, "") for r in new]
                if i < len(rows):
                    cost, audit = cost + edit[i][0], audit + edit[i][1]
                    turns += [edit[i][2]] if edit[i][2] else []
            initials = "".join(r[:1] for r, _ in turns)
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, [f"{r}:{t}" for r, t in turns]
    return best


_FAULT = {"x": "blank", "t": "truncated", "-": "sound"}
_ROLE = {"s": "system", "u": "user", "a": "assistant", " ": "tool"}


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_matrices_find_the_cheapest_edits(n):
    pick = itertools.product(KINDS, repeat=n) if n < 3 else itertools.islice(itertools.product(KINDS, repeat=3), 0, None, 23)
    for kinds in pick:
        rows = [(_ROLE[k[0]], f"t{i}", _FAULT[k[1]]) for i, k in enumerate(kinds)]
        cost, audit = op.cheapest(op.block_matrix("".join(kinds)))
        want = exhaustive(rows)
        assert (cost, audit) == want[:2], kinds
        assert list(op.repaired_lines(audit, [(r, t) for r, t, _ in rows])) == want[2], kinds


def test_products_are_associative():
    for kinds in itertools.islice(itertools.product(KINDS, repeat=5), 0, None, 4001):
        text = "".join(kinds)
        whole = op.block_matrix(text)
        for cut in range(0, len(text) + 1, 2):
            assert op.product(op.block_matrix(text[:cut]), op.block_matrix(text[cut:])) == whole


def plain(rows, damage):
    """The result for rows (conv, turn, role, text), one at a time."""
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, counts, kinds = set(), dict.fromkeys(("blank", "duplicate", "truncated", "sound"), 0), ""
        for _, role, text in found:
            blank = not re.search(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if blank else "duplicate" if (role, text) in seen else "sound" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated"
            seen.add((role, text))
            counts[fault] += 1
            kinds += (role[:1] if role[:1] in "sua" and role else " ") + {"sound": "-", "truncated": "t"}.get(fault, "x")
        cost, audit = op.cheapest(op.block_matrix(kinds))
        lines = list(op.repaired_lines(audit, [(r, t) for _, r, t in found]))
        initials = [k for k in kinds[::2]]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So."), (1, 3, "user", "Why?"), (1, 5, "assistant", "cut"),
    (2, 0, "assistant", "Hello."), (2, 0, "assistant", "Hello."), (2, None, "user", None), (2, 3, None, "No role."),
    (3, None, None, None), (4, 7, "", "Odd!"), (5, 1, "tool", "x" * 50_000 + "."), (5, 2, "user", "é?\n \t"),
    (None, 1, "user", "Null id."), (None, 2, "assistant", "Yes!"), (6, 4, "user", "Alone.\nLine."),
]
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _result(df):
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in df.collect()}


@pytest.mark.parametrize("damage", [False, True])
def test_awkward_rows(spark, damage):
    wide = [(*row, 1, "x", 2) for row in ROWS]
    df = spark.createDataFrame(wide, "conv_id long, turn long, role string, text string, conv long, kind string, at int")
    assert _result(op.repair(df, damage=damage)) == plain(ROWS, damage)


def test_every_id_is_returned_when_all_rows_are_dropped(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert _result(op.repair(df, damage=True)) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert op.repair(df.limit(0)).count() == 0


def test_a_conversation_over_many_ranges(spark, monkeypatch):
    """Most rows in one conversation, blocks and fans small, so the tree has several levels."""
    monkeypatch.setattr(op, "BLOCK", 16)
    monkeypatch.setattr(op, "FAN", 2)
    rows = [(7, i, ["user", "assistant", "user"][i % 3], "Same." if i % 5 == 0 else f"Turn {i}{'.' if i % 7 else ''}") for i in range(3000)]
    rows += [(c, t, "user", f"{c} {t}.") for c in range(8, 30) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(9)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = df.repartitionByRange("conv_id", "turn").where("conv_id = 7").select(F.spark_partition_id()).distinct().count()
        assert ranges > 4
        assert _result(op.repair(df, damage=True)) == plain(rows, True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
