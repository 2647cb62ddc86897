"""Repair of conversation structure by a scan of min-plus matrices.

*Damage* (for tests of the repair): a message is dropped, emptied, stripped of sentence ends, repeated or given
to the user, as the CRC-32 of ``conv:turn`` decides.

*Faults.*  A message is blank, a duplicate of an earlier one (role and text), truncated (its last visible
character ends no sentence), or sound; its first fault counts.

*Repair.*  The roles of a sound conversation are ``(s?(ua)+)?``, accepted by an automaton of four states:
nothing yet, after the system's turn, after the user's, after the assistant's.  Each message becomes a 4x4
matrix whose cell (i, j) holds the cheapest edits, as (cost, audit), that lead from state i to state j over
this message: any insertions (their closure), then Keep, Rerole or Delete.  Products of matrices under
(min, +) are associative: they add costs, join audits, and take the lesser pair, so of equal costs the
ASCII-least audit.  Audits of one cell that cost the same have equally many insertions, hence equal
lengths, so the lesser of two stays the lesser whatever follows it.

*Scan.*  Messages are sorted into ranges, and a conversation may fill many of them.  Runs of at most
``BLOCK`` messages become one element each (matrix, counts, first and last role); elements meet in a tree
of groups of ``FAN`` neighbouring ranges, so no task ever gathers a whole conversation.  A conversation
inside one range needs no further step.  Which message is a duplicate is found by the least place of each
(role, text) and looked up by place, so a text that fills a conversation meets no other row of its key.

*Digest.*  The repaired conversation is hashed as it streams by in order, one message at a time; a SHA-256
has no other order, so one conversation's digest is one task's work, of constant memory but for its audit,
which the result holds as one value anyway.

Defined cases: null roles and texts count as one space, and so do null ids and turns in the damage's key; null
conversation ids form one conversation, whose id stays null; null turns come first; rows that repeat a
turn are ordered by role and text; a role is judged by its first letter, an empty one by a blank; a
conversation that lost all messages has zeros, an empty audit and the digest of nothing; turns are whole
numbers; an empty table gives an empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import column, discard, materialise, new_folder, small_batches

#: Messages of one element, ranges that meet in one group of the tree.
BLOCK, FAN = 2048, 16
RANGE_BITS = 33

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)

Cell = tuple[int, str] | None
Matrix = tuple[tuple[Cell, ...], ...]

#: Where a turn of a role leads; a missing pair is not allowed.
_NEXT = {
    (NOTHING, "s"): SYSTEM,
    (NOTHING, "u"): USER,
    (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT,
    (ASSISTANT, "u"): USER,
}
#: The state after a turn that is made or rewritten, by the state before: only user and assistant can be.
_MADE = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE_OF = {USER: "user", ASSISTANT: "assistant"}


def product(left: Matrix, right: Matrix) -> Matrix:
    """The min-plus product over (cost, audit)."""
    rows = []
    for row in left:
        out = []
        for j in range(4):
            best = None
            for via, back in zip(row, right):
                onward = back[j]
                if via is not None and onward is not None:
                    both = via[0] + onward[0], via[1] + onward[1]
                    if best is None or both < best:
                        best = both
            out.append(best)
        rows.append(tuple(out))
    return tuple(rows)


IDENTITY: Matrix = tuple(tuple((0, "") if i == j else None for j in range(4)) for i in range(4))


def _least(*matrices: Matrix) -> Matrix:
    return tuple(
        tuple(min((m[i][j] for m in matrices if m[i][j] is not None), default=None) for j in range(4)) for i in range(4)
    )


def _closure(step: Matrix) -> Matrix:
    """All powers of ``step``; a path through four states needs three steps at most."""
    found = _least(IDENTITY, step)
    return product(found, product(found, found))


#: Any number of insertions.
INSERTIONS = _closure(tuple(tuple((INSERT, "I") if _MADE[i] == j else None for j in range(4)) for i in range(4)))


@lru_cache(maxsize=None)
def turn_matrix(kind: str) -> Matrix:
    """The matrix of one message, described by its role's letter and its fault: x blank or duplicate,
    t truncated, - sound."""
    letter, fault = kind
    cells: list[list[Cell]] = [[(DELETE, "D") if i == j else None for j in range(4)] for i in range(4)]
    if fault != "x":
        more = TRUNCATED if fault == "t" else 0
        for i in range(4):
            cells[i][_MADE[i]] = REROLE + more, "R"
        for (i, role), j in _NEXT.items():
            if role == letter:
                cells[i][j] = KEEP + more, "K"
    return product(INSERTIONS, tuple(map(tuple, cells)))


@lru_cache(maxsize=50_000)
def _short(kinds: str) -> Matrix:
    half = len(kinds) // 4 * 2  # a whole number of kinds, each of two letters
    return turn_matrix(kinds) if len(kinds) == 2 else product(_short(kinds[:half]), _short(kinds[half:]))


def block_matrix(kinds: str) -> Matrix:
    """The product over messages, two letters each, as a balanced tree whose short runs are remembered."""
    if not kinds:
        return IDENTITY
    found = [_short(kinds[i : i + 8]) for i in range(0, len(kinds), 8)]
    while len(found) > 1:
        found = [product(*found[i : i + 2]) if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
    return found[0]


def cheapest(whole: Matrix) -> tuple[int, str]:
    """Cost and audit of the best repair: from nothing to nothing or to an assistant's turn."""
    ends = product(whole, INSERTIONS)[NOTHING]
    return min(ends[j] for j in (NOTHING, ASSISTANT) if ends[j] is not None)


def legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


ELEMENT = (
    "conv string, node long, first string, last string, blank long, duplicate long, truncated long, illegal long, "
    "costs array<long>, audits array<string>"
)
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def element(conv: str, node: int, kinds: str, counts: tuple[int, int, int]) -> tuple:
    """The element of one run of messages."""
    roles = kinds[::2]
    illegal = sum(not legal(roles[i : i + 2]) for i in range(len(roles) - 1))
    return conv, node, roles[0], roles[-1], *counts, illegal, *_flat(block_matrix(kinds))


def _flat(matrix: Matrix) -> tuple[list, list]:
    cells = [cell or (None, None) for row in matrix for cell in row]
    return [c for c, _ in cells], [a for _, a in cells]


def _matrix(costs, audits) -> Matrix:
    cells = [None if a is None else (int(c), a) for c, a in zip(costs, audits)]
    return tuple(tuple(cells[4 * i : 4 * i + 4]) for i in range(4))


def _joined(rows: pd.DataFrame) -> tuple:
    """One element for neighbouring ones, given in order."""
    level = [_matrix(c, a) for c, a in zip(rows["costs"], rows["audits"])]
    while len(level) > 1:
        level = [product(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    seams = sum(not legal(a + b) for a, b in zip(rows["last"].iloc[:-1], rows["first"].iloc[1:]))
    counts = [int(rows[c].sum()) for c in _COUNTS]
    counts[3] += seams
    return rows["first"].iloc[0], rows["last"].iloc[-1], *counts, *_flat(level[0])


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) rows with nulls as one space, damaged by the CRC-32 of ``conv:turn``."""
    key = F.concat_ws(":", F.coalesce("conv_id", F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        rows.withColumn("kind", kind)
        .where("kind <> 0")
        .select(
            "conv",
            "turn",
            F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            text.alias("text"),
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def _ordered(messages: DataFrame, path: str) -> DataFrame:
    """Messages in sorted ranges, written with ``at``: the range, then the place in it."""
    order = ["conv", "turn", "role", "text", "read"]
    ranged = messages.withColumn("read", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ranged.withColumn("at", F.monotonically_increasing_id()).drop("read"), "ordered", path=path)


def _kinds(placed: DataFrame) -> DataFrame:
    """(conv, at, fault, kind) of every message: the fault's name and the two letters of its matrix."""
    seen = placed.select("conv", "at", "role", F.sha2("text", 256).alias("digest"), _letter().alias("letter"), _fault().alias("own"))
    # Least places are told apart by their own, so a text that fills a conversation is met row by row.
    firsts = seen.where("own <> 'blank'").groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    fault = F.when((F.col("own") == "blank") | F.col("new"), F.col("own")).otherwise("duplicate")
    mark = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", "t").otherwise("-")
    return (
        seen.drop("role", "digest").join(firsts, "at", "left")
        .withColumn("fault", fault)
        .select("conv", "at", "fault", F.concat("letter", mark).alias("kind"))
    )


def _letter() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise(" ")


def _fault() -> Column:
    return (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
        .otherwise("sound")
    )


def _elements(kinds: DataFrame) -> DataFrame:
    """Elements of runs: of one conversation, one range, and ``BLOCK`` places of it at most."""
    run = F.floor(F.col("at") / BLOCK).cast("long")
    count = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    runs = kinds.groupBy("conv", run.alias("node")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "kind"))), lambda x: x["kind"]), "").alias("kinds"),
        *(count(name) for name in ("blank", "duplicate", "truncated")),
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [element(c, n, k, counts) for c, n, k, *counts in zip(*(col.to_pylist() for col in batch.columns))]
            yield _batch(rows)

    return runs.mapInArrow(build, ELEMENT)


_ARROW = pa.schema(
    [("conv", pa.string()), ("node", pa.int64()), ("first", pa.string()), ("last", pa.string())]
    + [(name, pa.int64()) for name in _COUNTS]
    + [("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW)], schema=_ARROW)


def _met(elements: DataFrame, shift: int) -> DataFrame:
    """Elements of one conversation joined where ``shift`` lower bits of their nodes are all that differs."""

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        joined = _joined(rows.sort_values("node"))
        return pd.DataFrame([(key[0], key[1], *joined)], columns=_ARROW.names)

    parent = F.shiftright("node", shift)
    return elements.withColumn("parent", parent).groupBy("conv", "parent").applyInPandas(join, ELEMENT)


def _scan(elements: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """(one element for each conversation, folders that hold it): a tree over those that have several."""
    spark = elements.sparkSession
    folders = [new_folder(spark, name)]
    elements = materialise(elements, name, path=folders[0])
    several = elements.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")
    folders.append(new_folder(spark, name))
    rest = materialise(elements.join(several, "conv", "left_semi"), name, path=folders[1])
    done = [elements.join(several, "conv", "left_anti")]
    in_range = RANGE_BITS - BLOCK.bit_length() + 1
    top = rest.agg(F.max("node")).first()[0]
    shift, fan = (in_range, FAN.bit_length() - 1)
    while top is not None:
        folders.append(new_folder(spark, name))
        rest = materialise(_met(rest, shift), name, path=folders[-1])
        if top >> shift == 0:
            break
        top, shift = top >> shift, fan
    return reduce(DataFrame.unionByName, [*done, rest]), folders


def repaired_lines(audit: str, roles_and_texts: Iterable[tuple[str, str]]) -> Iterator[str]:
    """The lines ``role:text`` of a repaired conversation, by its messages in order and its audit."""
    # As turns alternate, an odd number of them begins with the system's.
    turns = len(audit) - audit.count("D")
    at, state = 0, NOTHING
    for role, text in roles_and_texts:
        while audit[at] == "I":
            state = _MADE[state]
            yield f"{_ROLE_OF[state]}:"
            at += 1
        edit = audit[at]
        at += 1
        if edit == "R":
            state = _MADE[state]
            yield f"{_ROLE_OF[state]}:{text}"
        elif edit == "K":
            state = SYSTEM if state == NOTHING and turns % 2 else _MADE[state]
            yield f"{role}:{text}"
    for _ in audit[at:]:
        state = _MADE[state]
        yield f"{_ROLE_OF[state]}:"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, repaired_sha256) from rows sorted by conversation: its audit, then its messages in order."""
    names = ["conv", "repaired_sha256"]
    out: list[tuple[str, str]] = []

    def conversation(first: tuple, rest: Iterator[tuple]) -> tuple | None:
        """Hash one conversation; returns the row that begins the next."""
        conv, audit = first[0], first[2]
        follows: list[tuple] = []

        def own() -> Iterator[tuple[str, str]]:
            for row in rest:
                if row[0] != conv:
                    follows.append(row)
                    return
                yield row[3], row[4]

        digest, between = hashlib.sha256(), b""
        for line in repaired_lines(audit, own()):
            digest.update(between)
            digest.update(line.encode())
            between = b"\n"
        out.append((conv, digest.hexdigest()))
        return follows[0] if follows else None

    rows = _stream(batches)
    row = next(rows, None)
    while row is not None:
        row = conversation(row, rows)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=names)
            out.clear()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=names)


def repair(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    damage: bool = False,
) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``damage`` breaks the messages first; conversations that lose all of them are returned too.
    """
    spark = messages.sparkSession
    small_batches(spark)
    conv = F.coalesce(F.concat(F.lit("="), column(conv_col).cast("string")), F.lit(""))
    given = messages.select(column(conv_col).alias("own_id"), conv.alias("conv"))
    rows = messages.select(
        column(conv_col).cast("string").alias("conv_id"),
        conv.alias("conv"),
        column(turn_col).cast("long").alias("turn"),
        F.coalesce(column(role_col), F.lit(" ")).alias("role"),
        F.coalesce(column(text_col), F.lit(" ")).alias("text"),
    )
    placed = _ordered(damaged(rows) if damage else rows.drop("conv_id"), new_folder(spark, "ordered"))
    folder = new_folder(spark, "kinds")
    kinds = materialise(_kinds(placed), "kinds", path=folder)
    whole, folders = _scan(_elements(kinds), "elements")

    @F.pandas_udf("cost long, audit string")
    def best(costs: pd.Series, audits: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cheapest(_matrix(c, a)) for c, a in zip(costs, audits)], columns=["cost", "audit"])

    judged = materialise(
        whole.withColumn("best", best("costs", "audits")).select("conv", *_COUNTS, F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit")),
        "judged",
    )
    for done in [folder, *folders]:
        discard(spark, done)
    nothing = F.lit(None).cast("string")
    stream = judged.select("conv", F.lit(-1).cast("long").alias("at"), "audit", nothing.alias("role"), nothing.alias("text")).unionByName(
        placed.select("conv", "at", nothing.alias("audit"), "role", "text")
    )
    digests = stream.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(_digests, "conv string, repaired_sha256 string")
    # Turns that repeat are counted once before a conversation's turns meet.
    turns = placed.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one"))
    spans = turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return (
        given.groupBy("conv").agg(F.first("own_id").alias("own_id"))
        .join(judged, "conv", "left").join(spans, "conv", "left").join(digests, "conv", "left")
        .select(
            F.col("own_id").alias("conv_id"),
            zero("gaps"),
            *(zero(name) for name in _COUNTS),
            zero("cost"),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
        )
    )
