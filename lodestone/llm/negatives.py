"""Hard negatives by bit-sliced integer products.

Vectors become integers, ``floor(256 * x)``.  An anchor's positives are the best rows of its label by inner product; the
negatives of a positive are the best rows of other labels whose score is between 80 % and 100 % of the positive's.

*Bit slices.*  A row's components are written in two's complement, one 0/1 matrix for each bit.  Products of
anchors with these planes are added from the most significant plane on.  What the planes still to come can add lies
between minus the anchor's negative and plus its positive components, times the largest remainder, so every
pair has a score interval that tightens with each plane.  A pair is dropped once its interval leaves every
window that is asked for, or once enough pairs are surely better in each of them.  Planes are multiplied densely while many
pairs are left, then pair by pair.  Survivors of the last plane have exact scores.

*Spark.*  Rows and anchors are dealt to blocks of bounded size by a hash of their row number, so neither labels nor copies
of one vector gather in a task.  Every (block of anchors, block of rows) is one group of a cogroup: rows
are copied once for each block of anchors, anchors once for each block of rows.  A group hands on
at most the best few rows of each anchor and window; windows with a rank limit merge them.  One pass finds the
positives, a second the negatives.

Defined cases: rows with a null label, a null vector or any null or non-finite component take no part; rows of a
null id do, but are no anchors and come last among equal scores; rows that repeat an id are rows of their own, so
a copy of an anchor is one of its positives; vectors of several lengths are padded with zeros; an anchor
without positives, and a positive without negatives, has no row in the result; scores beyond a 64-bit integer raise
an error; an empty table gives an empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import column, discard, materialise, new_folder, steady

#: Positives of an anchor, negatives of a positive, and the least share (of 100) of the positive's score.
POSITIVES, NEGATIVES, LEAST = 5, 5, 80
ANCHORS_EVERY, MOVED_EVERY, LABELS = 100, 7, 10
#: Anchors and rows of one group; cells of one dense product; share of pairs below which planes meet pairs one by one.
ANCHOR_BLOCK, ROW_BLOCK, CELLS, SPARSE = 8192, 8192, 1 << 21, 16
ANY = np.iinfo(np.int64).max


def _kth(groups: np.ndarray, values: np.ndarray, n_groups: int, k: int) -> np.ndarray:
    """The k-th largest value of each group, or the least integer where it has fewer."""
    out = np.full(n_groups, -ANY, np.int64)
    order = np.lexsort((-values, groups))
    groups, values = groups[order], values[order]
    starts = np.searchsorted(groups, np.arange(n_groups))
    at = starts + k - 1
    there = at < len(groups)
    there[there] = groups[at[there]] == np.flatnonzero(there)
    out[there] = values[at[there]]
    return out


def _alive(anchor: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray, k: int) -> np.ndarray:
    """Which pairs can still be among the ``k`` best of a window of their anchor.

    A pair of ``anchor`` has a score from ``low`` to ``high``; windows (anchors x windows) reach from ``least`` to ``most``.
    """
    found = np.zeros(len(anchor), bool)
    for w in range(least.shape[1]):
        lower, upper = least[anchor, w], most[anchor, w]
        sure = (low >= lower) & (high <= upper)
        bar = np.maximum(lower, _kth(anchor[sure], low[sure], len(least), k)[anchor])
        found |= (low <= upper) & (high >= bar) & (lower <= upper)
    return found


def search(
    anchors: np.ndarray, rows: np.ndarray, bits: int, allowed: np.ndarray, least: np.ndarray, most: np.ndarray, k: int,
    left: list[int] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all ``allowed`` pairs that may be among the ``k`` best of a window, scores exact.

    ``bits`` are those of the largest component without its sign; ``left`` gets the number of pairs after each plane.
    """
    plus, minus = np.maximum(anchors, 0).sum(1), np.maximum(-anchors, 0).sum(1)
    top = int(np.abs(anchors).max(initial=0)) * anchors.shape[1]
    kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
    factors = anchors.astype(kind)
    known = np.zeros(allowed.shape, np.int64)
    anchor, row = np.nonzero(allowed)
    score = np.zeros(len(anchor), np.int64)
    dense = True
    for p in range(bits, -1, -1):
        plane = (rows >> p) & 1
        weight = -(1 << p) if p == bits else 1 << p
        if dense:
            known += (factors @ plane.T.astype(kind)).astype(np.int64) * weight
            score = known[anchor, row]
        else:
            for at in range(0, len(anchor), CELLS >> 6):
                part = slice(at, at + (CELLS >> 6))
                score[part] += np.einsum("ij,ij->i", anchors[anchor[part]], plane[row[part]]) * weight
        rest = (1 << p) - 1
        stays = _alive(anchor, score - minus[anchor] * rest, score + plus[anchor] * rest, least, most, k)
        anchor, row, score = anchor[stays], row[stays], score[stays]
        dense = dense and len(anchor) * SPARSE > allowed.size
        if left is not None:
            left.append(len(anchor))
    return anchor, row, score


def _vectors(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """The integer vectors of an Arrow column, padded to ``size`` components."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), size), np.int64)
    out[np.arange(size) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


_FOUND = "anchor long, slot int, row long, vec_id long, score long"
_FOUND_ARROW = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _best(anchors: pa.Table, rows: pa.Table, size: int, bits: int, same: bool, k: int) -> pa.Table:
    """The ``k`` best rows of each anchor and window of one group."""
    if not anchors.num_rows or not rows.num_rows:
        return _FOUND_ARROW.empty_table()
    left, right = _vectors(anchors["ints"], size), _vectors(rows["ints"], size)
    of_anchor, of_row = anchors["label"].to_numpy(), rows["label"].to_numpy()
    number, numbers = anchors["row"].to_numpy(), rows["row"].to_numpy()
    ids = rows["vec_id"].to_pandas().fillna(ANY).to_numpy(np.int64)
    if same:
        least, most = np.full((len(left), 1), -ANY), np.full((len(left), 1), ANY)
    else:
        scores = anchors["scores"].to_pylist()
        most = np.array([s + [-1] * (POSITIVES - len(s)) for s in scores], np.int64).reshape(len(left), POSITIVES)
        least = np.where(most < 0, 0, -(-LEAST * most // 100))
    tile = max(1, CELLS // len(right))
    out = []
    for at in range(0, len(left), tile):
        cut = slice(at, at + tile)
        alike = of_anchor[cut, None] == of_row[None]
        allowed = alike & (number[cut, None] != numbers[None]) if same else ~alike
        anchor, row, score = search(left[cut], right, bits, allowed, least[cut], most[cut], k)
        for w in range(least.shape[1]):
            inside = (score >= least[cut][anchor, w]) & (score <= most[cut][anchor, w])
            a, r, s = anchor[inside], row[inside], score[inside]
            order = np.lexsort((numbers[r], ids[r], -s, a))
            a, r, s = a[order], r[order], s[order]
            first = np.arange(len(a)) - np.searchsorted(a, a) < k
            a, r, s = a[first], r[first], s[first]
            out.append((number[cut][a], np.full(len(a), w, np.int32), numbers[r], rows["vec_id"].take(pa.array(r)).combine_chunks(), s))
    return pa.table([pa.chunked_array([pa.array(x) for x in col], type=t.type) for col, t in zip(zip(*out), _FOUND_ARROW)], schema=_FOUND_ARROW)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best of each key, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, ints) of the rows that take part, labels moved."""
    value = column(vector_col)
    whole = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    moved = (column(label_col) + 1) % LABELS
    return vectors.where(column(label_col).isNotNull() & value.isNotNull() & whole).select(
        column(id_col).cast("long").alias("vec_id"),
        F.when(column(id_col) % MOVED_EVERY == 0, moved).otherwise(column(label_col)).cast("long").alias("label"),
        F.transform(value, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("ints"),
    )


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and positive."""
    spark = vectors.sparkSession
    steady(spark)
    folders = [new_folder(spark, "vectors")]
    rows = materialise(
        prepared(vectors, id_col, vector_col, label_col).withColumn("row", F.monotonically_increasing_id()), "vectors", path=folders[0]
    )
    is_anchor = F.col("vec_id") % ANCHORS_EVERY == 0
    largest = F.greatest(F.array_max("ints"), -1 - F.array_min("ints"))
    n, asked, size, top = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1)), F.max(F.size("ints")), F.max(largest)).first()
    size, bits = max(1, size or 0), int(top or 0).bit_length()
    if (1 << 2 * bits) * size * 128 >= 1 << 63:
        raise ValueError("scores of these vectors do not fit 64-bit integers")
    cores = spark.sparkContext.defaultParallelism
    row_blocks = max(1, -(-n // ROW_BLOCK), min(cores, -(-n // 1024)))
    anchor_blocks = max(1, -(-asked // ANCHOR_BLOCK))
    kind = "array<short>" if bits < 16 else "array<int>" if bits < 32 else "array<long>"
    packed = rows.withColumn("ints", F.col("ints").cast(kind))

    def dealt(table: DataFrame, own: str, blocks: int, other: str, copies: int) -> DataFrame:
        block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
        return table.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).groupBy("a", "r")

    def met(anchors: DataFrame, same: bool, k: int) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return _best(left, right, size, bits, same, k)

        pairs = dealt(anchors, "a", anchor_blocks, "r", row_blocks).cogroup(dealt(packed, "r", row_blocks, "a", anchor_blocks))
        return pairs.applyInArrow(run, _FOUND)

    anchors = packed.where(is_anchor)
    folders.append(new_folder(spark, "positives"))
    positives = materialise(_first(met(anchors, True, POSITIVES), ["anchor"], POSITIVES), "positives", path=folders[1])
    scores = positives.groupBy(F.col("anchor").alias("row")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores")  # POSITIVES at most
    )
    folders.append(new_folder(spark, "asked"))
    asking = materialise(anchors.join(scores, "row"), "asked", path=folders[2])
    found = _first(met(asking, False, NEGATIVES), ["anchor", "slot"], NEGATIVES)
    known = positives.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = materialise(
        found.join(known, ["anchor", "slot"]).join(ids, "anchor").select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ),
        "negatives",
    )
    for folder in folders:
        discard(spark, folder)
    return out
