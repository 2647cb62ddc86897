"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into segments of 64 bytes; in each a forward and a backward gated unit read the bytes, and
a softmax over both states labels every position.  The mean log-probability of all positions of the
whole text, turned back into a distribution, is the document's.  Gates and states use the
rational curves x / (1 + |x|) in place of sigmoid and tanh, which vectorise well.

The network is trained in numpy by backpropagation through time on a bounded sample of documents of
every language, and sent to the tasks with their code.  Every document is scored on its own.

Defined cases: null texts and texts without a letter are ``und`` with score 0; documents without a
language are never learned from; null ids are never held out and, as their fold is unknown, never
learned from; repeated rows are scored alike; without any training document all are ``und``; with a
single language that one is predicted with score 1; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import column, id_crc32, small_batches, text_bytes

SEGMENT = 64
HIDDEN = 8
#: Training documents of each language, expected; and segments of one text that training looks at.
SAMPLE_DOCS, SAMPLE_SEGMENTS = 500, 12
STEPS, MINIBATCH, RATE = 400, 256, 0.02
#: Segments that are read side by side when scoring.
SIDE_BY_SIDE = 4096
UNDEFINED = "und"
_PAD = 256


def segments(texts: list[bytes], length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """(codes by step and segment, text of each segment); codes are bytes, or 256 past the end."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    per = -(-sizes // length)
    codes = np.full(int(per.sum()) * length, _PAD, np.int16)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    shift = (np.cumsum(per) - per) * length - (np.cumsum(sizes) - sizes)
    codes[np.arange(len(raw)) + np.repeat(shift, sizes)] = raw
    return np.ascontiguousarray(codes.reshape(-1, length).T), np.repeat(np.arange(len(texts)), per)


@dataclass
class Gated:
    """One direction: ``inputs`` (3H, 257) holds the share of each byte, ``carry`` (3H, H) that of the state.

    Rows are update gate, reset gate, candidate.  Segments lie along the last axis throughout, so that
    gates are contiguous blocks.
    """

    inputs: np.ndarray
    carry: np.ndarray

    def read(self, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each step (steps, H, segments), in the order of ``codes``; and what training needs."""
        steps, n = codes.shape
        h = self.carry.shape[1]
        out = np.empty((steps, h, n), np.float32)
        state = np.zeros((h, n), np.float32)
        gates, from_state, size = (np.empty((3 * h, n), np.float32) for _ in range(3))
        update_reset, candidate = gates[: 2 * h], gates[2 * h :]
        update, reset = gates[:h], gates[h : 2 * h]
        kept = []
        for t in range(steps):
            np.take(self.inputs, codes[t], axis=1, out=gates, mode="clip")
            np.matmul(self.carry, state, out=from_state)
            update_reset += from_state[: 2 * h]
            bound = size[: 2 * h]
            np.abs(update_reset, out=bound)
            bound += 1
            update_reset /= bound
            update_reset *= 0.5
            update_reset += 0.5
            bound = size[2 * h :]
            np.multiply(reset, from_state[2 * h :], out=bound)
            candidate += bound
            np.abs(candidate, out=bound)
            bound += 1
            candidate /= bound
            fresh = out[t]
            np.subtract(state, candidate, out=fresh)
            fresh *= update
            fresh += candidate
            if keep:
                kept.append((state, gates.copy(), from_state[2 * h :].copy()))
            state = fresh
        return out, kept

    def learn(self, codes: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of ``inputs`` and ``carry`` by backpropagation through time."""
        h = self.carry.shape[1]
        d_inputs, d_carry = np.zeros_like(self.inputs), np.zeros_like(self.carry)
        d_state = np.zeros_like(d_out[0])
        for t in range(len(kept) - 1, -1, -1):
            state, gates, from_candidate = kept[t]
            update, reset, candidate = gates[:h], gates[h : 2 * h], gates[2 * h :]
            d = d_state + d_out[t]
            d_candidate = d * (1 - update) * (1 - np.abs(candidate)) ** 2
            d_update = d * (state - candidate) * _gate_slope(update)
            d_reset = d_candidate * from_candidate * _gate_slope(reset)
            back = np.concatenate([d_update, d_reset, d_candidate * reset])
            d_carry += back @ state.T
            d_state = d * update + self.carry.T @ back
            back[2 * h :] = d_candidate
            order = np.argsort(codes[t], kind="stable")
            sorted_codes = codes[t][order]
            first = np.flatnonzero(np.concatenate(([True], sorted_codes[1:] != sorted_codes[:-1])))
            d_inputs[:, sorted_codes[first]] += np.add.reduceat(back[:, order], first, axis=1)
        return d_inputs, d_carry


def _gate_slope(gate: np.ndarray) -> np.ndarray:
    """Derivative of 0.5 + 0.5 x / (1 + |x|) by its value."""
    return 0.5 * (1 - np.abs(2 * gate - 1)) ** 2


@dataclass
class ByteNetwork:
    languages: list[str]
    ahead: Gated
    back: Gated
    output: np.ndarray  # (languages, 2H + 1)

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Log-probabilities of every language at every position (steps, languages, segments)."""
        h = self.ahead.carry.shape[1]
        logits = self.output[:, :h] @ self.ahead.read(codes)[0]
        logits += self.output[:, h : 2 * h] @ self.back.read(codes[::-1])[0][::-1]
        logits += self.output[:, 2 * h :]
        top = logits.max(1, keepdims=True)
        logits -= top
        np.exp(logits, out=(shares := np.empty_like(logits)))
        logits -= np.log(shares.sum(1, keepdims=True))
        return logits

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Distribution over languages of each text."""
        codes, of_text = segments(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for at in range(0, codes.shape[1], SIDE_BY_SIDE):
            part = np.ascontiguousarray(codes[:, at : at + SIDE_BY_SIDE])
            labels = self.positions(part)
            labels *= (part != _PAD)[:, None, :]
            np.add.at(total, of_text[at : at + SIDE_BY_SIDE], labels.sum(0).T)
        total /= np.maximum(np.fromiter(map(len, texts), np.int64, len(texts)), 1)[:, None]
        total = np.exp(total - total.max(1, keepdims=True))
        return total / total.sum(1, keepdims=True)


def train_network(
    texts: list[bytes], labels: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = 1, sample_segments: int = SAMPLE_SEGMENTS
) -> ByteNetwork | None:
    """Fit by Adam on segments of the texts; every language weighs the same.  None without any text."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    k, h = len(languages), hidden

    def gated() -> Gated:
        return Gated(
            rng.normal(0, 0.3, (3 * h, _PAD + 1)).astype(np.float32),
            rng.normal(0, 0.3, (3 * h, h)).astype(np.float32),
        )

    net = ByteNetwork(languages, gated(), gated(), rng.normal(0, 0.3, (k, 2 * h + 1)).astype(np.float32))
    codes, of_text = segments(texts)
    if k == 1 or not codes.shape[1]:
        return net
    number = np.array([languages.index(x) for x in labels])
    chosen = np.concatenate(
        [rng.permutation(np.flatnonzero(of_text == i))[:sample_segments] for i in range(len(texts))]
    )
    by_language = [chosen[number[of_text[chosen]] == j] for j in range(k)]
    by_language = [(j, s) for j, s in enumerate(by_language) if len(s)]
    weights = [net.ahead.inputs, net.ahead.carry, net.back.inputs, net.back.carry, net.output]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    per = max(1, MINIBATCH // len(by_language))
    for step in range(1, steps + 1):
        picked = np.concatenate([rng.choice(s, per) for _, s in by_language])
        truth = np.repeat([j for j, _ in by_language], per)
        gradients = _gradients(net, np.ascontiguousarray(codes[:, picked]), truth)
        rate = RATE * min(1, 3 * (1 - step / (steps + 1)))
        for w, g, a, b in zip(weights, gradients, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def loss(net: ByteNetwork, codes: np.ndarray, truth: np.ndarray) -> float:
    """Mean negative log-probability of the true language over all positions."""
    labels = net.positions(codes)[:, truth, np.arange(len(truth))]
    inside = codes != _PAD
    return float(-(labels * inside).sum() / inside.sum())


def _gradients(net: ByteNetwork, codes: np.ndarray, truth: np.ndarray) -> list[np.ndarray]:
    h = net.ahead.carry.shape[1]
    steps, n = codes.shape
    ahead, kept_ahead = net.ahead.read(codes, keep=True)
    back, kept_back = net.back.read(codes[::-1], keep=True)
    both = np.concatenate([ahead, back[::-1], np.ones((steps, 1, n), np.float32)], 1)
    logits = net.output @ both
    logits = np.exp(logits - logits.max(1, keepdims=True))
    error = logits / logits.sum(1, keepdims=True)
    error[:, truth, np.arange(n)] -= 1
    inside = codes != _PAD
    error *= inside[:, None, :] / np.float32(inside.sum())
    d_output = (error @ both.transpose(0, 2, 1)).sum(0)
    d_both = net.output.T @ error
    return [
        *net.ahead.learn(codes, kept_ahead, d_both[:, :h]),
        *net.back.learn(codes[::-1], kept_back, d_both[::-1, h : 2 * h]),
        d_output,
    ]


def held_out(id_col: str | Column) -> Column:
    """Documents whose language is not learned from."""
    return F.coalesce(id_crc32(id_col) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    sample_segments: int = SAMPLE_SEGMENTS,
) -> ByteNetwork | None:
    """Fit on about ``sample_docs`` documents of each language, picked by a hash of the id, and on
    ``sample_segments`` segments from all over each of them.

    Languages are counted over all training documents; the sample alone is bounded.  Of rows that repeat id
    and language that with the smallest text is learned from.
    """
    small_batches(docs.sparkSession)
    doc_id = column(id_col).cast("long")
    known = docs.where(column(lang_col).isNotNull() & doc_id.isNotNull() & ~held_out(doc_id))
    counts = sorted(tuple(r) for r in known.groupBy(column(lang_col).alias("lang")).count().collect())
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in counts:
        share = F.when(column(lang_col) == lang, F.lit(min(1.0, sample_docs / n))).otherwise(share)
    place = F.pmod(F.xxhash64(doc_id, F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # Training looks at a few segments of a text, so no more than their bytes need to be gathered.
    picked = known.where(place < share).select(
        doc_id.alias("i"), column(lang_col).alias("lang"), _spread(text_col, sample_segments).alias("text")
    )
    rows = picked.groupBy("i", "lang").agg(F.min("text").alias("text")).collect()
    rows = sorted((r.i, r.lang, bytes(r.text)) for r in rows)
    return train_network([t for _, _, t in rows], [lang for _, lang, _ in rows], sample_segments=sample_segments)


def _spread(text_col: str, pieces: int) -> Column:
    """Pieces from all over a text, of a bounded total size."""
    text = F.coalesce(column(text_col), F.lit(""))
    n = pieces + 4
    length = F.length(text)
    parts = [text.substr((length * i / n).cast("int") + 1, F.lit(2 * SEGMENT)) for i in range(n)]
    return F.when(length <= n * 2 * SEGMENT, text).otherwise(F.concat(*parts)).cast("binary")


def predict(docs: DataFrame, net: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            known = [i for i, t in enumerate(texts) if net is not None and _has_letter(t)]
            names, scores = [UNDEFINED] * len(texts), [0.0] * len(texts)
            if known:
                shares = net.documents([texts[i] for i in known])
                for i, best, value in zip(known, shares.argmax(1).tolist(), shares.max(1).tolist()):
                    names[i], scores[i] = net.languages[best], min(1.0, value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    doc_id = column(id_col).cast("long")
    return docs.select(
        doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), text_bytes(text_col).alias("text")
    ).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def _has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))
