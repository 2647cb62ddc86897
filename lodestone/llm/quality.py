"""Document quality from a linear-chain conditional random field over lines.

Each line is described by shares of character kinds, repetition of words and length, and by the same
figures of the lines beside it.  A chain with two labels, bad and good, is fitted on a bounded sample
of labelled documents whose lines all carry their document's label; forward-backward gives each line's
marginal, and their mean weighted by line length is the document's raw quality.  A logistic curve,
fitted on the same sample, turns it into a probability.

Only the text is ever looked at when scoring.  The model has a few dozen weights and is sent to the
tasks with their code; every document is scored on its own, without a shuffle.

Defined cases: null and empty texts, and texts of blanks, have no weight in any line and get the share
of good documents in the sample; null ids stay null and are never held out; rows that repeat are scored
alike; without any label of one kind every score is the share of good documents (0.5 without labels);
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import column, id_crc32, small_batches, text_bytes

#: Labelled documents that the model is fitted on, at most.
SAMPLE_DOCS = 4000
#: Lowest score that counts as good.
THRESHOLD = 0.3
STEPS = 150

_KINDS = np.zeros(256, np.uint8)
for _kind, _chars in enumerate(
    ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"()-", "!", "|"), 1
):
    _KINDS[[ord(c) for c in _chars]] = _kind
_KINDS[128:] = 7
_KINDS[[c for c in range(33, 127) if not _KINDS[c]]] = 8
_OWN = 12
FEATURES = 3 * _OWN + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, bytes of each line, lines of each text)."""
    split = [t.split(b"\n") for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    lines = [line for s in split for line in s]
    if not lines:
        return np.zeros((0, FEATURES)), np.zeros(0), counts
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    kinds = _KINDS[np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)]
    starts = np.cumsum(sizes + 1) - sizes - 1
    shares = np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int32) for k in range(1, 9)], 1).astype(float)
    words = np.zeros((len(lines), 3))
    for i, line in enumerate(lines):
        found = line.split()
        if found:
            words[i] = len(found), sum(map(eq, found, islice(found, 1, None))), len(found) - len(set(found))
    n, per = np.maximum(words[:, 0], 1), np.maximum(sizes, 1)
    letters = np.maximum(shares[:, 0] + shares[:, 1], 1)
    own = np.stack(
        [
            shares[:, 1] / letters,
            shares[:, 2] / per,
            np.minimum(shares[:, 3] / n, 3),
            np.minimum(shares[:, 4] / n, 3),
            np.minimum(shares[:, 5] / n, 3),
            shares[:, 6] / per,
            np.minimum(shares[:, 7] / n, 3),
            words[:, 1] / n,
            words[:, 2] / n,
            np.log1p(words[:, 0]) / 5,
            np.minimum(sizes / n / 10, 5),
            words[:, 0] == 0,
        ],
        1,
    )
    ends = np.cumsum(counts)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[ends[:-1]] = 0
    after[ends - 1] = 0
    return np.concatenate([own, before, after, np.ones((len(own), 1))], 1), sizes * (words[:, 0] > 0), counts


def forward_backward(
    emission: np.ndarray, change: np.ndarray, counts: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of all chains at once.

    ``emission`` holds the log-odds of good for each line, ``change`` the log potentials of
    (label, next label).  Returns the marginal of good per line, the expected label pairs per chain,
    and log Z per chain.
    """
    n, total = len(counts), len(emission)
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    by_length = counts[order]
    weight = np.exp(change - change.max())
    top = np.maximum(emission, 0)
    potential = np.exp(np.stack([-top, emission - top], 1))
    alpha, beta = np.zeros((total, 2)), np.ones((total, 2))
    log_z = np.zeros(n)
    active = [int(np.searchsorted(-by_length, -t, "left")) for t in range(int(by_length[0]) + 1)] if n else []
    state = None
    for t in range(len(active) - 1):
        chains = order[: active[t]]
        at = starts[chains] + t
        if t == 0:
            state = potential[at] * 0.5
            log_z[chains] += np.log(2)
        else:
            state = (state[: len(chains)] @ weight) * potential[at]
            log_z[chains] += change.max()
        scale = state.sum(1, keepdims=True)
        state = state / scale
        log_z[chains] += np.log(scale[:, 0]) + top[at]
        alpha[at] = state
    pairs = np.zeros((n, 2, 2))
    for t in range(len(active) - 2, -1, -1):
        chains = order[: active[t]]
        on = order[: active[t + 1]]  # chains that have a next line
        at = starts[on] + t
        if len(on):
            ahead = potential[at + 1] * beta[at + 1]
            back = ahead @ weight.T
            joint = alpha[at][:, :, None] * weight[None] * ahead[:, None, :]
            pairs[on] += joint / joint.sum((1, 2), keepdims=True)
            beta[at] = back / back.sum(1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(1), pairs, log_z


@dataclass
class LineField:
    """Weights of the chain and of the curve on top of it."""

    weights: np.ndarray
    change: np.ndarray
    slope: float
    shift: float
    prior: float

    def raw(self, features: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each text; NaN where no line has weight."""
        if not len(counts):
            return np.zeros(0)
        emission = np.clip(features @ self.weights, -30, 30)
        good, _, _ = forward_backward(emission, self.change, counts)
        starts = np.cumsum(counts) - counts
        weight = np.add.reduceat(sizes.astype(float), starts)
        with np.errstate(invalid="ignore"):
            return np.where(weight > 0, np.add.reduceat(sizes * good, starts) / weight, np.nan)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        raw = self.raw(*line_features(texts))
        return np.where(np.isnan(raw), self.prior, _sigmoid(self.slope * _log_odds(raw) + self.shift))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(np.nan_to_num(p, nan=0.5), 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _adam(gradient, at: np.ndarray, steps: int, rate: float) -> np.ndarray:
    first, second = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, steps + 1):
        g = gradient(at)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        at = at - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return at


def fit(
    features: np.ndarray, sizes: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = STEPS
) -> LineField:
    """Conditional likelihood by gradient ascent; every document counts alike."""
    prior = float(labels.mean()) if len(labels) else 0.5
    model = LineField(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, float(_log_odds(np.array([prior]))[0]), prior)
    if prior in (0.0, 1.0) or not len(labels):
        return model
    of_line = np.repeat(np.arange(len(counts)), counts)
    share = (1 / counts)[of_line]
    target = labels[of_line].astype(float)
    same = np.stack([(counts - 1) * (labels == 0), (counts - 1) * (labels == 1)], 1)

    def gradient(at: np.ndarray) -> np.ndarray:
        emission = np.clip(features @ at[:FEATURES], -30, 30)
        good, pairs, _ = forward_backward(emission, at[FEATURES:].reshape(2, 2), counts)
        pairs = pairs - same[:, :, None] * np.eye(2)
        return np.concatenate(
            [
                features.T @ ((good - target) * share) / len(counts) + 1e-4 * at[:FEATURES],
                ((pairs / counts[:, None, None]).sum(0) / len(counts)).ravel() + 1e-3 * at[FEATURES:],
            ]
        )

    best = _adam(gradient, np.zeros(FEATURES + 4), steps, 0.15)
    model.weights, model.change = best[:FEATURES], best[FEATURES:].reshape(2, 2)
    raw = model.raw(features, sizes, counts)
    seen = ~np.isnan(raw)
    x, y = _log_odds(raw[seen]), labels[seen]

    def curve(at: np.ndarray) -> np.ndarray:
        error = _sigmoid(at[0] * x + at[1]) - y
        return np.array([(error * x).mean(), error.mean()]) + 1e-4 * at

    model.slope, model.shift = map(float, _adam(curve, np.array([1.0, 0.0]), 300, 0.05))
    return model


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            features, sizes, _ = line_features([text])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([doc_id], pa.int64()),
                    pa.array([features.astype(np.float32).tobytes()], pa.binary()),
                    pa.array([sizes.astype(np.int64).tobytes()], pa.binary()),
                ],
                names=["doc_id", "features", "sizes"],
            )


def held_out(id_col: str | Column) -> Column:
    """Documents that no label is learned from."""
    return F.coalesce(id_crc32(id_col) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_docs: int = SAMPLE_DOCS,
) -> LineField:
    """Fit on the ``sample_docs`` labelled documents with the smallest id hashes, held-out ones excepted.

    The sample is the only thing bounded here; a document with contradicting labels takes their
    rounded mean, and of rows that repeat an id that with the smallest text digest is learned from.
    """
    small_batches(docs.sparkSession)
    known = labels.select(column(id_col).cast("long").alias("doc_id"), column(label_col).alias("label"))
    known = known.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    chosen = [
        (r.doc_id, float(r.label >= 0.5))
        for r in known.groupBy("doc_id")
        .agg(F.avg("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_docs)
        .collect()
    ]
    if not chosen:
        return fit(np.zeros((0, FEATURES)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
    wanted = docs.sparkSession.createDataFrame([(i,) for i, _ in chosen], "doc_id long")
    source = docs.select(column(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    digest = F.sha2("text", 256).alias("digest")
    rows = (
        source.join(F.broadcast(wanted), "doc_id", "left_semi")  # at most sample_docs ids
        .groupBy("doc_id")
        .agg(F.min(F.struct(digest, "text")).alias("least"))
        .select("doc_id", "least.text")
        .mapInArrow(_sample_features, "doc_id long, features binary, sizes binary")
        .collect()
    )
    label_of = dict(chosen)
    rows.sort(key=lambda r: (r.doc_id, r.features))
    features = [np.frombuffer(r.features, np.float32).reshape(-1, FEATURES) for r in rows]
    return fit(
        np.concatenate(features).astype(float) if rows else np.zeros((0, FEATURES)),
        np.concatenate([np.frombuffer(r.sizes, np.int64) for r in rows]) if rows else np.zeros(0),
        np.array([len(f) for f in features], np.int64),
        np.array([label_of[r.doc_id] for r in rows]),
    )


def score(docs: DataFrame, model: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(scores, pa.float64()),
                    pa.array((scores >= THRESHOLD).astype(np.int32)),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    doc_id = column(id_col).cast("long")
    return docs.select(
        doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), text_bytes(text_col).alias("text")
    ).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: LineField, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns kept, in one pass without a shuffle."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores([t.encode() for t in texts]))

    return docs.where(scored(F.coalesce(column(text_col), F.lit(""))) >= THRESHOLD)
