"""Sequence packing: first-fit decreasing on a tournament tree, in randomised groups.

Documents become token ids plus one end id.  Ids beyond a whole sequence are cut off in full pieces;
what remains is the last piece.  Pieces are dealt to groups by a hash, and each group is packed by
first-fit decreasing on its own: a tournament tree over the bins holds the largest free capacity
below every node, so the first bin that fits is found by one walk from the root.  Groups are of a
fixed expected size whatever the input, so tasks neither grow nor depend on each other, and the
padding is that of a group of thousands of pieces.

Defined cases: a null text counts as empty and holds the end id alone; null ids stay null; repeated
rows are packed each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import subwords
from lodestone.llm.shared import column, materialise, small_batches, text_bytes

SEQUENCE = 2048
END_ID = 1
#: Expected pieces in a group.
GROUP_PIECES = 4096

PIECES = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("row", "doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [("ids", pa.binary())]
)


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each size; bins are numbered in the order they are opened."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    width = 1
    while width < len(sizes):
        width *= 2
    free = [capacity] * (2 * width)  # node i has the children 2i and 2i+1; leaves are bins
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in order:
        size, node = sizes[i], 1
        while node < width:
            node *= 2
            if free[node] < size:
                node += 1
        bins[i] = node - width
        offsets[i] = capacity - free[node]
        free[node] -= size
        while node > 1:
            node >>= 1
            left, right = free[2 * node], free[2 * node + 1]
            best = left if left >= right else right
            if free[node] == best:
                break
            free[node] = best
    return bins, offsets


def _pieces(tokenizer_path: str, sequence: int, end_id: int, with_ids: bool):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(tokenizer_path)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for at, texts in subwords.slices(batch.column(1)):
                found = cache.batch(texts)
                data = found.ids.tobytes()
                begin = 0
                for doc_id, stop in zip(batch.column(0).slice(at, len(texts)).to_pylist(), (4 * found.ends).tolist()):
                    ids = data[begin:stop] + end
                    begin = stop
                    total = len(ids) // 4
                    for start in range(0, total, sequence):
                        piece = ids[4 * start : 4 * (start + sequence)]
                        out.append(
                            (row, doc_id, start, len(piece) // 4, zlib.crc32(piece), total, piece if with_ids else None)
                        )
                    row += 1
            columns = zip(*out) if out else [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW
            )

    return run


_CACHES: dict[str, subwords.WordCache] = {}


def _cache(path: str) -> subwords.WordCache:
    """The worker's own cache of this vocabulary."""
    if path not in _CACHES:
        _CACHES.clear()
        _CACHES[path] = subwords.word_bpe(path)
    return _CACHES[path]


def _pack_group(sequence: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "row", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pieces["length"].tolist(), sequence)
        group = pieces["group"].to_numpy()
        return pieces.drop(columns="group").assign(
            sequence_id=(group << np.int64(24)) + np.array(bins, np.int64), offset=np.array(offsets, np.int64)
        )

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence: int = SEQUENCE,
    end_id: int = END_ID,
    group_pieces: int = GROUP_PIECES,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: row, doc_id, start, length, ids_crc32, doc_tokens, ids (little-endian unsigned
    32-bit; null unless ``with_ids``), sequence_id, offset.

    ``row`` tells repeated ids apart.  A group never holds 2**24 pieces unless its expected size does.
    """
    small_batches(docs.sparkSession)
    source = docs.select(column(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    pieces = materialise(source.mapInArrow(_pieces(tokenizer_path, sequence, end_id, with_ids), PIECES), "pieces")
    groups = -(-pieces.count() // group_pieces) or 1
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(_pack_group(sequence), PIECES + ", sequence_id long, offset long")
