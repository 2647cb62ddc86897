"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Every step is two aggregations and joins over edges, in which the edges of a hub are dealt to many tasks;
neither edges nor components reach the driver, only a count and a checksum that tell whether the last step
changed anything.  The steps halve the
distance to each component's smallest node, so a logarithmic number of rounds is enough.  Each round
is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import discard, materialise, new_folder

#: Rows of one key that a task may meet; keys with more are hubs.  Hubs there can be, and tasks that share one.
HUB_ROWS, HUBS, SHARES = 4096, 500, 256


def join_hubs(rows: DataFrame, facts: DataFrame, key: str, total: int, hub_rows: int = HUB_ROWS) -> DataFrame:
    """``rows`` joined with their key's row of ``facts``, which counts the key's rows as ``degree``.

    The rows of a hub are dealt to ``SHARES`` tasks, each with a copy of the hub's facts.  ``total`` is the
    number of rows, so a hub has more than a ``HUBS``-th of them and the broadcast list stays below ``HUBS``.
    """
    limit = max(hub_rows, -(-total // HUBS))
    is_hub = F.col("degree") > limit
    hubs = facts.where(is_hub).select(key, F.lit(True).alias("hub"))
    share = F.when(F.col("hub"), F.pmod(F.xxhash64(*rows.columns), F.lit(SHARES))).otherwise(F.lit(0).cast("long"))
    dealt = rows.join(F.broadcast(hubs), key, "left").withColumn("share", share).drop("hub")
    shares = F.when(is_hub, F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long")))
    copies = facts.withColumn("share", F.explode(F.coalesce(shares, F.array(F.lit(0).cast("long")))))
    return dealt.join(copies, [key, "share"]).drop("share", "degree")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("degree"))
    return join_hubs(both, least, "a", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    moved = join_hubs(down, least, "a", n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.bit_xor(F.hash("a", "b"))).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge table (a long, b long); root is its component's smallest node.

    Self-loops and repeated edges are allowed; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    folder = new_folder(spark, "edges")
    current = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", path=folder
    )
    state = _state(current)
    while state[0]:
        # The distinct of the step's result is hash partitioned and combines before its shuffle.
        last, folder = folder, new_folder(spark, "edges")
        current = materialise(_small_star(_large_star(current, state[0]).distinct(), state[0]).distinct(), "edges", path=folder)
        discard(spark, last)
        before, state = state, _state(current)
        if state == before:
            break
    roots = current.select("b").distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root"))
    )
