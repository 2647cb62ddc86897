"""Scores of few queries against all chunks in one pass: no pair leaves the task that scores it.

A chunk is one row of its distinct terms and their counts.  A task multiplies slices of chunks with the matrix of
the asked terms, so scores of all pairs are made, but only rows that can be among a query's best of all leave it: those
of each slice, and none below the best that the task has met already.  What is shuffled grows with the chunks, not with
the pairs, and a task holds one slice, however many chunks it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Numbers of a slice, chunks by asked terms or chunks by queries, and chunks of one at most.
SLICE, SLICE_CHUNKS = 1 << 22, 4096
#: Digits of a ranked score.
PLACES = 1e4


def rounded(values: np.ndarray) -> np.ndarray:
    """Numbers at four places, halves away from zero, in units of the last place; numbers are not negative."""
    scaled = values * PLACES
    whole = np.floor(scaled)
    return whole + (scaled - whole >= 0.5)


def best(scores: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best of each row of ``scores``, the first of equals, from the row's floor on; ``-inf``
    never counts.  ``floors`` are lifted to the k-th best, as what is below cannot be among the best later."""
    n = scores.shape[1]
    if n > k:
        np.maximum(floors, np.partition(scores, n - k, axis=1)[:, n - k], out=floors)
    i, j = np.nonzero((scores >= floors[:, None]) & (scores > -np.inf))
    order = np.lexsort((j, -scores[i, j], i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep]


@dataclass(frozen=True)
class Asked:
    """Queries as arrays: their ids, numbers of terms and norms, and for each of their terms its place among the distinct ones."""

    ids: list
    sizes: np.ndarray
    norms: np.ndarray
    terms: list[str]
    query_of: np.ndarray
    term_of: np.ndarray
    weights: np.ndarray
    metric: str
    least: float = 0.0
    depth: int | None = None

    @classmethod
    def of(cls, asked: DataFrame, metric: str) -> Asked:
        """From (query_id, asked, term), for ``tfidf`` also (idf, q_norm), of few queries."""
        found = asked.toArrow()
        ids = found["query_id"].unique()
        terms = found["term"].unique()
        query_of = pa.compute.index_in(found["query_id"], value_set=ids).to_numpy()
        term_of = pa.compute.index_in(found["term"], value_set=terms).to_numpy()
        per_query = lambda c: _last(query_of, found[c].to_numpy().astype(float), len(ids))
        weighed = metric == "tfidf"
        weights = found["idf"].to_numpy() ** 2 if weighed else np.ones(len(found))
        norms = per_query("q_norm") if weighed else np.ones(len(ids))
        return cls(ids.to_pylist(), per_query("asked"), norms, terms.to_pylist(), query_of, term_of, weights, metric)

    def matrix(self) -> np.ndarray:
        """Queries by terms."""
        out = np.zeros((len(self.ids), len(self.terms)))
        out[self.query_of, self.term_of] = self.weights
        return out


def _last(places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.ones(n)
    out[places] = values
    return out


def product(matrix: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Sums of queries by chunks."""
    return (matrix @ held.T).astype(float)


@dataclass(frozen=True)
class Slice:
    """Chunks in the order of their keys, with bases, finals and scores (in units of the last place) of queries by chunks."""

    rows: pa.RecordBatch
    base: np.ndarray
    final: np.ndarray
    score: np.ndarray


def _slices(batches: Iterator[pa.RecordBatch], asked: Asked, keys: list[str], factors: list[str]) -> Iterator[Slice]:
    """``batches`` have the keys, terms, counts of them as tfs or none, factors, and for ``tfidf`` norm."""
    # Sums of whole numbers below 2 ** 24 are exact in single precision, at half the time of a product.
    whole = asked.metric != "tfidf" and asked.weights.max(initial=0) == 1
    single, vocabulary = asked.matrix().astype(np.float32 if whole else float), pa.array(asked.terms, pa.string())
    width, presence = len(vocabulary), asked.metric in ("containment", "jaccard")
    step = max(1, min(SLICE_CHUNKS, SLICE // max(width, len(asked.ids), 1)))
    for batch in batches:
        batch = batch.take(pa.array(np.lexsort([batch.column(k).to_numpy() for k in reversed(keys)])))
        lists = batch.column("terms")
        widths = np.diff(lists.offsets.to_numpy())
        place = pa.compute.index_in(lists.flatten(), value_set=vocabulary).fill_null(-1).to_numpy()
        known = place >= 0
        counts = (batch.column("tfs").flatten().to_numpy() if "tfs" in batch.schema.names else np.ones(len(place)))[known]
        row, place = np.repeat(np.arange(len(widths)), widths)[known], place[known].astype(np.int64)
        # A chunk's counts together bound each of its sums.
        exact = whole and np.bincount(row, counts, 1).max() < 1 << 24
        matrix, kind = (single, np.float32) if exact else (single.astype(float), float)
        for at in range(0, batch.num_rows, step):
            rows = batch.slice(at, step)
            n = rows.num_rows
            a, b = np.searchsorted(row, (at, at + n))
            held = np.bincount((row[a:b] - at) * width + place[a:b], counts[a:b], n * width).reshape(n, width)
            total = product(matrix, (held > 0 if presence else held).astype(kind, copy=False))
            if asked.metric == "tfidf":
                base = total / (rows.column("norm").to_numpy()[None, :] * asked.norms[:, None])
            elif asked.metric == "jaccard":
                base = total / (asked.sizes[:, None] + widths[None, at : at + n] - total)
            elif asked.metric == "count":
                base = total
            else:
                base = total / asked.sizes[:, None]
            final = base
            for f in factors:
                final = final * rows.column(f).to_numpy()[None, :]
            yield Slice(rows, base, final, np.where((total > 0) & (final >= asked.least), rounded(final), -np.inf))


def narrowed(counts: DataFrame, terms: list[str]) -> DataFrame:
    """The rows of ``counts`` that hold any of ``terms``, with these alone in their ``terms`` and ``tfs``; nothing is moved."""
    schema, rest = to_arrow_schema(counts.schema), [c for c in counts.columns if c not in ("terms", "tfs")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(terms, pa.string())
        for batch in batches:
            lists = batch.column("terms")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            held = np.flatnonzero(pa.compute.is_in(lists.flatten(), value_set=vocabulary).to_numpy(zero_copy_only=False))
            rows, starts = np.unique(row[held], return_index=True)
            offsets, taken = pa.array(np.append(starts, len(held)), pa.int32()), pa.array(held)
            cut = {c: pa.ListArray.from_arrays(offsets, batch.column(c).flatten().take(taken)) for c in ("terms", "tfs")}
            kept = {c: batch.column(c).take(pa.array(rows)) for c in rest}
            yield pa.RecordBatch.from_arrays([(cut | kept)[f.name].cast(f.type) for f in schema], schema=schema)

    return counts.mapInArrow(run, counts.schema)


def _typed(arrays: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x).cast(f.type) if not isinstance(x, pa.Array) else x.cast(f.type) for x, f in zip(arrays, schema)], schema=schema)


def _fields(queries: DataFrame, rows: DataFrame, keys: list[str], numbers: list[str]) -> T.StructType:
    doubles = [T.StructField(c, T.DoubleType()) for c in numbers]
    return T.StructType([queries.schema["query_id"], *[rows.schema[k] for k in keys], *doubles])


def best_rows(rows: DataFrame, queries: DataFrame, asked: Asked, least: float, depth: int | None, keys: list[str], factors: list[str]) -> DataFrame:
    """(query_id, keys, base, factors, final, score) of the pairs that share a term and reach ``least``, of each query at least
    its ``depth`` best (all without it) by score, then keys."""
    out = _fields(queries, rows, keys, ["base", *factors, "final", "score"])
    schema, asked = to_arrow_schema(out), replace(asked, least=least, depth=depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, floors = pa.array(asked.ids), np.full(len(asked.ids), -np.inf)
        for part in _slices(batches, asked, keys, factors):
            i, j = np.nonzero(part.score > -np.inf) if asked.depth is None else best(part.score, asked.depth, floors)
            if len(i):
                taken = [part.rows.column(c).take(pa.array(j)) for c in (*keys, *factors)]
                held, weights = taken[: len(keys)], taken[len(keys) :]
                yield _typed([ids.take(pa.array(i)), *held, part.base[i, j], *weights, part.final[i, j], part.score[i, j] / PLACES], schema)

    return rows.mapInArrow(run, out)


def rows_ahead(rows: DataFrame, targets: DataFrame, asked: Asked, least: float, keys: list[str], factors: list[str]) -> DataFrame:
    """(query_id, keys, ahead) for ``targets`` (query_id, keys, score), which are few: how many pairs of the query come before."""
    out = T.StructType([*_fields(targets, rows, keys, []), T.StructField("ahead", T.LongType())])
    schema, asked = to_arrow_schema(out), replace(asked, least=least)
    found = targets.select("query_id", *keys, "score").toArrow()
    query_of = pa.compute.index_in(found["query_id"], value_set=pa.array(asked.ids)).to_numpy()
    wanted = np.rint(found["score"].to_numpy() * PLACES).astype(np.int64)
    names = [found[k].to_numpy() for k in keys]
    ids = found["query_id"].to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = np.zeros(len(wanted), np.int64)
        order = np.lexsort(names[::-1])
        of_query = [np.flatnonzero(query_of == q) for q in range(len(asked.ids))]
        for part in _slices(batches, asked, keys, factors):
            n = part.rows.num_rows
            place = _places([part.rows.column(k).to_numpy() for k in keys], names, order)
            for q, own in enumerate(of_query):
                some = np.flatnonzero(part.score[q] > -np.inf)
                if len(own) and len(some):
                    # Better scores first, then keys: one number tells the place of a pair.
                    code = np.sort(-part.score[q, some].astype(np.int64) * (n + 1) + some)
                    ahead[own] += np.searchsorted(code, -wanted[own] * (n + 1) + place[own])
        yield _typed([ids, *names, ahead], schema)

    return rows.mapInArrow(run, out)


def _places(held: list[np.ndarray], names: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """How many of the sorted keys ``held`` come before each of ``names``, which ``order`` sorts."""
    n, m = len(held[0]), len(order)
    both = [np.concatenate((name[order], key)) for key, name in zip(held, names)]
    # Of equal keys the asked ones come first, so a row is never ahead of itself.
    merged = np.lexsort((np.repeat((0, 1), (m, n)), *both[::-1]))
    before = np.cumsum(merged >= m)
    out = np.empty(m, np.int64)
    mine = merged < m
    out[order[merged[mine]]] = before[mine]
    return out
