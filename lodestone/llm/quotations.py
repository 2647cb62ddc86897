"""Chat formatting by quotation linking, with DataFrame operations alone.

*Parse.*  A line's quote level is the number of ``>`` before its content.  Consecutive quoted lines of
one level are a passage.

*Link.*  Passages and their lines are normalised (lower case, single blanks) and hashed, and so are the
unquoted lines, paragraphs and whole bodies of the conversation's messages.  A passage's original is the
latest earlier message that holds it as a whole, else the message that is the latest earlier one for
most of its lines, the latest of those that tie.  Levels above one are linked the same way, as each level quotes what some
message said itself.

*Order.*  A message replies to the original of its first linked passage of the lowest level, else to the
message before it.  Conversations are put in reply order: every message is followed by its replies, depth
first, replies by age.  The order comes from an Euler tour of the reply tree ranked by pointer
doubling, in a logarithmic number of joins on unique keys.

No conversation, and no line that recurs in one, is ever gathered in one task: messages are numbered in
sorted ranges; as-of lookups and next siblings are found in blocks of 1024 places, and only one row of
each block meets the others of its group.

Defined cases: a null text is empty; null conversation ids form one conversation; null turns come
first in theirs; rows that repeat a turn are ordered by role and text, those alike in all as they are read; quotes of nothing said before stay
unlinked and are dropped from the body like all others; an empty table gives an empty one; other columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import column, materialise

_BLOCK_BITS = 10
_QUOTE = r"^(?:[ \t]{0,3}>)+[ \t]?"
_KEY = ["conv", "seq"]


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _block(place: str) -> Column:
    return F.shiftright(F.col(place), _BLOCK_BITS)


def _numbered(messages: DataFrame) -> DataFrame:
    """Messages with ``seq``, their place in the conversation by turn, role and text, from 0.

    Messages are sorted into ranges, so one conversation may fill many of them, and rows alike in all of that
    are told apart by their place in the input.  A range numbers its rows by itself; counts of the ranges and
    the first number of each conversation make those numbers places.
    """
    order = ["conv", "turn", "role", "text", "read"]
    ranged = messages.withColumn("read", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(ranged.withColumn("at", F.monotonically_increasing_id()).drop("read"), "ordered-messages")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("part")).count()
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("part", F.coalesce(before, F.lit(0)).alias("offset"))  # one row for each range
    rows = placed.withColumn("part", part).join(F.broadcast(firsts), "part").withColumn("number", F.col("offset") + within)
    local = rows.groupBy("part", "conv").agg(F.min("number").alias("first"))
    starts = local.groupBy("conv").agg(F.min("first").alias("start"))
    # A conversation meets its start once for each of its ranges, then range by range.
    known = local.select("part", "conv").join(starts, "conv")
    return rows.join(known, ["part", "conv"]).withColumn("seq", F.col("number") - F.col("start")).drop(
        "at", "part", "offset", "number", "start"
    )


def _lines(messages: DataFrame) -> DataFrame:
    """(conv, seq, pos, level, norm) of every line that is not blank."""
    line = F.posexplode(F.split("text", "\r?\n")).alias("pos", "line")
    prefix = F.regexp_extract("line", _QUOTE, 0)
    return (
        messages.select(*_KEY, line)
        .select(
            *_KEY,
            "pos",
            F.length(F.regexp_replace(prefix, "[^>]", "")).alias("level"),
            _normal(F.regexp_replace("line", _QUOTE, "")).alias("norm"),
        )
        .where("norm <> ''")
    )


def _passages(lines: DataFrame) -> DataFrame:
    """Runs of neighbouring lines of one level in a message: conv, seq, level, run, pos, whole, lines."""
    run = F.col("pos") - F.row_number().over(Window.partitionBy(*_KEY, "level").orderBy("pos"))
    return (
        lines.withColumn("run", run)
        .groupBy(*_KEY, "level", "run")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "norm"))).alias("found"))
        .select(
            *_KEY,
            "level",
            "run",
            F.col("found")[0]["pos"].alias("pos"),
            F.sha2(F.array_join("found.norm", " "), 256).alias("whole"),
            F.transform("found.norm", lambda x: F.sha2(x, 256)).alias("lines"),
        )
    )


def _latest_before(asked: DataFrame, said: DataFrame) -> DataFrame:
    """(conv, unit, seq, origin) of every asked (conv, unit, seq): the latest earlier seq that said the unit."""
    keys = ["conv", "unit"]
    points = said.select(*keys, "seq", F.col("seq").alias("origin")).unionByName(
        asked.select(*keys, "seq", F.lit(None).cast("long").alias("origin"))
    )
    points = points.groupBy(*keys, "seq").agg(F.max("origin").alias("origin")).withColumn("block", _block("seq"))
    blocks = points.groupBy(*keys, "block").agg(F.max("origin").alias("last"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "block", F.max("last").over(earlier).alias("carried"))
    within = Window.partitionBy(*keys, "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (
        points.withColumn("near", F.max("origin").over(within))
        .join(carried, [*keys, "block"])
        .select(*keys, "seq", F.coalesce("near", "carried").alias("origin"))
        .join(asked.select(*keys, "seq").distinct(), [*keys, "seq"], "left_semi")
        .where("origin is not null")
    )


def _links(messages: DataFrame) -> DataFrame:
    """(conv, seq, level, run, pos, origin) of every quoted passage; origin is null if nothing earlier said it."""
    quoting = messages.where(F.col("text").rlike("(?m)" + _QUOTE))
    passages = materialise(_passages(_lines(quoting).where("level > 0")), "passages")
    convs = passages.select("conv").distinct()
    own = _lines(messages.join(convs, "conv", "left_semi")).where("level = 0")
    paragraphs = _passages(own)
    bodies = own.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "norm"))).alias("found"))
    said = reduce(
        DataFrame.unionByName,
        [
            own.select(*_KEY, F.sha2("norm", 256).alias("unit")),
            paragraphs.select(*_KEY, F.col("whole").alias("unit")),
            bodies.select(*_KEY, F.sha2(F.array_join("found.norm", " "), 256).alias("unit")),
        ],
    ).distinct()
    parts = passages.select(*_KEY, "level", "run", F.posexplode("lines").alias("nth", "unit"))
    asked = passages.select(*_KEY, F.col("whole").alias("unit")).unionByName(parts.select(*_KEY, "unit")).distinct()
    said = said.join(asked.select("conv", "unit").distinct(), ["conv", "unit"], "left_semi")
    found = materialise(_latest_before(asked, said), "originals")
    by_line = (
        parts.join(found, ["conv", "seq", "unit"])
        .groupBy(*_KEY, "level", "run", "origin")
        .agg(F.count("*").alias("n"))
        .groupBy(*_KEY, "level", "run")
        .agg(F.max(F.struct("n", "origin"))["origin"].alias("by_line"))
    )
    return (
        passages.select(*_KEY, "level", "run", "pos", F.col("whole").alias("unit"))
        .join(found, ["conv", "seq", "unit"], "left")
        .join(by_line, [*_KEY, "level", "run"], "left")
        .select(*_KEY, "level", "run", "pos", F.coalesce("origin", "by_line").alias("origin"))
    )


def _next_sibling(nodes: DataFrame) -> DataFrame:
    """(conv, seq, parent, sibling): the next reply to the same message, null for the last."""
    keys = ["conv", "parent"]
    rows = nodes.withColumn("block", _block("seq"))
    firsts = rows.groupBy(*keys, "block").agg(F.min("seq").alias("first"))
    later = F.lead("first").over(Window.partitionBy(*keys).orderBy("block"))
    return (
        rows.withColumn("near", F.lead("seq").over(Window.partitionBy(*keys, "block").orderBy("seq")))
        .join(firsts.select(*keys, "block", later.alias("far")), [*keys, "block"])
        .select("conv", "seq", "parent", F.coalesce("near", "far").alias("sibling"))
    )


def _reply_order(nodes: DataFrame) -> DataFrame:
    """(conv, seq, position) of trees given as (conv, seq, parent), roots having parent -1.

    Every message is entered (2 seq) and left (2 seq + 1); entries weigh one.  Doubling sums the weights
    from each step of the tour to its end.
    """
    siblings = _next_sibling(nodes)
    children = nodes.groupBy("conv", F.col("parent").alias("seq")).agg(F.min("seq").alias("child"))
    tree = siblings.join(children, ["conv", "seq"], "left")
    leave = 2 * F.col("seq") + 1
    upward = F.when(F.col("parent") >= 0, 2 * F.col("parent") + 1)
    tour = tree.select(
        "conv",
        F.explode(
            F.array(
                F.struct((2 * F.col("seq")).alias("at"), F.coalesce(2 * F.col("child"), leave).alias("to"), F.lit(1).cast("long").alias("rank")),
                F.struct(leave.alias("at"), F.coalesce(2 * F.col("sibling"), upward).alias("to"), F.lit(0).cast("long").alias("rank")),
            )
        ).alias("step"),
    ).select("conv", "step.*")
    tour = materialise(tour, "tour")
    while not tour.where("to is not null").isEmpty():
        ahead = tour.select("conv", F.col("at").alias("to"), F.col("to").alias("next"), F.col("rank").alias("more"))
        tour = materialise(
            tour.join(ahead, ["conv", "to"], "left").select(
                "conv", "at", F.col("next").alias("to"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank")
            ),
            "tour",
        )
    entered = tour.where("at % 2 = 0").select("conv", F.shiftright("at", 1).alias("seq"), "rank")
    totals = entered.groupBy("conv").agg(F.max("rank").alias("total"))
    return entered.join(totals, "conv").select("conv", "seq", (F.col("total") - F.col("rank")).alias("position"))


def link_quotations(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per message: conv_id, turn, role, seq, position (in reply order), reply_to_turn, passages,
    linked (passages with an original), body (the text without quotes) and chat (body under its role)."""
    rows = messages.select(
        column(conv_col).cast("long").alias("conv_id"),
        column(turn_col).cast("long").alias("turn"),
        column(role_col).alias("role"),
        F.coalesce(column(text_col), F.lit("")).alias("text"),
    ).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    numbered = materialise(_numbered(rows), "messages")
    links = materialise(_links(numbered), "links")
    linked = links.groupBy(*_KEY).agg(
        F.count("*").alias("passages"),
        F.count("origin").alias("linked"),
        F.min_by("origin", F.when(F.col("origin").isNotNull(), F.struct("level", "pos"))).alias("origin"),
    )
    own = F.filter(F.split("text", "\r?\n"), lambda x: ~x.rlike(_QUOTE))
    nodes = materialise(
        numbered.join(linked, _KEY, "left").select(
            "conv",
            "conv_id",
            "turn",
            "role",
            "seq",
            F.coalesce("origin", F.col("seq") - 1).alias("parent"),
            F.coalesce("passages", F.lit(0)).alias("passages"),
            F.coalesce("linked", F.lit(0)).alias("linked"),
            F.regexp_replace(F.array_join(own, "\n"), r"^(?:[ \t]*\n)+|\s+$", "").alias("body"),
        ),
        "nodes",
    )
    # Where every message follows the one before it, the order is that of the turns.
    branched = nodes.where("parent <> seq - 1").select("conv").distinct()
    places = _reply_order(nodes.join(branched, "conv", "left_semi").select("conv", "seq", "parent"))
    turns = nodes.select("conv", F.col("seq").alias("parent"), F.col("turn").alias("reply_to_turn"))
    return (
        nodes.join(places, _KEY, "left")
        .join(turns, ["conv", "parent"], "left")
        .select(
            "conv_id",
            "turn",
            "role",
            "seq",
            F.coalesce("position", "seq").alias("position"),
            "reply_to_turn",
            "passages",
            "linked",
            "body",
            F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body")).alias("chat"),
        )
    )
