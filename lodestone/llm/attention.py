"""A small causal self-attention model over subword ids, in numpy.

The model predicts the class of the next subword in two steps, first a family of classes, then the class
inside it; inside its class a subword has its share of the training corpus.  Frequent subwords are classes
of their own.  With x the embedding of the last subword and a its attention over the window, scores of families
and of the classes of a family are linear maps of x + a, so a subword costs two short softmaxes, not one of
all classes.

Texts are scored in blocks: the queries of a block attend causally to the block itself and the one
before, so windows of two blocks overlap by one and every subword is scored exactly once, after at
least a block of context wherever there is one.  Blocks of many texts run side by side, and masks keep
texts apart.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BLOCK = 16
WIDTH = 16
#: Subwords with a class, and with an embedding, of their own; and classes shared by all others.
OWN_CLASSES, OWN_ROWS, SHARED_CLASSES = 239, 2048, 16
#: Classes of a family.
FAMILY = 16
#: Blocks that run side by side.
SIDE_BY_SIDE = 128
STEPS, MINIBATCH, RATE = 2500, 192, 0.01
#: Rate of the steps of a pass over the whole corpus, which starts from fitted weights.
PASS_RATE = 0.002


@dataclass
class Vocabulary:
    """Classes and input rows of all ids, from their counts in the training corpus; the last id is the end."""

    class_of: np.ndarray
    row_of: np.ndarray
    log_share: np.ndarray  # natural log of an id's share of its class
    class_counts: np.ndarray

    @classmethod
    def of_counts(cls, counts: np.ndarray, starts_word: np.ndarray) -> Vocabulary:
        n = len(counts)
        end = n - 1
        smooth = counts + 0.1
        order = np.lexsort((np.arange(n), -counts))
        order = order[order != end]
        own = order[:OWN_CLASSES]
        class_of = np.full(n, -1, np.int32)
        class_of[own] = np.arange(len(own))
        class_of[end] = len(own)
        rest = order[OWN_CLASSES:]
        next_class = len(own) + 1
        for flag in (True, False):
            some = rest[starts_word[rest] == flag]
            if len(some):
                mass = np.cumsum(smooth[some])
                band = np.minimum((mass - smooth[some]) / mass[-1] * (SHARED_CLASSES // 2), SHARED_CLASSES // 2 - 1)
                _, band = np.unique(band.astype(np.int64), return_inverse=True)
                class_of[some] = next_class + band
                next_class += int(band.max()) + 1
        class_counts = np.bincount(class_of, smooth, next_class)
        row_of = class_of + OWN_ROWS
        row_of[order[:OWN_ROWS]] = np.arange(min(OWN_ROWS, len(order)))
        return cls(class_of, row_of, np.log(smooth / class_counts[class_of]), class_counts)

    @property
    def classes(self) -> int:
        return len(self.class_counts)


def cut_flat(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, first) of all blocks of texts given by their joined ids and their sizes.

    Targets are ids with the end, -1 past it; inputs are the ids before them, the end before the first;
    ``first`` marks a text's first block.
    """
    with_end = sizes + 1
    per = -(-with_end // BLOCK)
    total = int(per.sum())
    targets = np.full(total * BLOCK, -1, np.int32)
    inputs = np.full(total * BLOCK, end, np.int32)
    begin = (np.cumsum(per) - per) * BLOCK
    places = np.arange(len(ids)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
    targets[places] = ids
    inputs[places + 1] = ids
    targets[begin + sizes] = end
    inputs[begin] = end
    first = np.zeros(total, bool)
    first[begin // BLOCK] = True
    return inputs.reshape(-1, BLOCK), targets.reshape(-1, BLOCK), first


def flat(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(joined ids, sizes) of texts given one by one."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return (np.concatenate(texts) if texts else np.empty(0, np.int64)), sizes


def _exp(x: np.ndarray) -> np.ndarray:
    """Replace ``x`` by its exponential; rows are lowered by their largest value only if any is large.

    Returns what each row was lowered by.
    """
    shift = np.zeros(x.shape[:-1], x.dtype)
    if x.max(initial=0) > 60:
        shift = x.max(-1)
        x -= shift[..., None]
    np.exp(x, out=x)
    return shift


@dataclass
class Attention:
    vocabulary: Vocabulary
    embed: np.ndarray  # (rows, d)
    project: np.ndarray  # (d, 3d): query, key, value
    distance: np.ndarray  # (2 * BLOCK,): score by distance
    families: np.ndarray  # (d + 1, families), the last row a bias
    output: np.ndarray  # (families, d + 1, FAMILY), the last row a bias
    _table: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def untrained(cls, vocabulary: Vocabulary, seed: int = 1) -> Attention:
        rng = np.random.default_rng(seed)
        d, rows = WIDTH, OWN_ROWS + vocabulary.classes
        n = -(-vocabulary.classes // FAMILY)
        share = np.zeros(n * FAMILY)
        share[: vocabulary.classes] = vocabulary.class_counts / vocabulary.class_counts.sum()
        share = share.reshape(n, FAMILY)
        families = rng.normal(0, 0.1, (d + 1, n))
        families[d] = np.log(share.sum(1))
        output = rng.normal(0, 0.1, (n, d + 1, FAMILY))
        output[:, d] = np.log(np.maximum(share / share.sum(1, keepdims=True), 1e-30))  # places without a class stay out
        return cls(
            vocabulary,
            rng.normal(0, 0.1, (rows, d)).astype(np.float32),
            rng.normal(0, 0.3, (d, 3 * d)).astype(np.float32),
            np.zeros(2 * BLOCK, np.float32),
            families.astype(np.float32),
            output.astype(np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.project, self.distance, self.families, self.output]

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def _scores_bias(self) -> np.ndarray:
        """Added to scores by (query, key) place; far below zero where the key is later."""
        gap = np.arange(BLOCK, 2 * BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :]
        return np.where(gap >= 0, self.distance[np.abs(gap)], np.float32(-1e4)).astype(np.float32)

    def text_scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each text's ids and the end after them."""
        ids, sizes = flat(texts)
        scores = self.id_scores(ids, sizes)
        return np.add.reduceat(scores, np.cumsum(sizes + 1) - (sizes + 1)) if len(texts) else np.zeros(0)

    def id_scores(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural log probability of every id given those before it, each text's end after its ids."""
        voc, d = self.vocabulary, WIDTH
        if self._table is None:
            project = self.project.copy()
            project[:, :d] *= np.float32(1 / np.sqrt(d))
            self._table = np.ascontiguousarray(np.concatenate([self.embed, self.embed @ project], 1))
        inputs, targets, first = cut_flat(ids, sizes, len(voc.class_of) - 1)
        found = []
        bias = self._scores_bias()
        rows_of = voc.row_of[inputs]
        ones = np.ones(2 * BLOCK, np.float32)
        state = np.ones((SIDE_BY_SIDE, BLOCK, d + 1), np.float32)  # the last place takes the bias
        for at in range(0, len(inputs), SIDE_BY_SIDE):
            to = min(at + SIDE_BY_SIDE, len(inputs))
            low = max(at - 1, 0)
            rows = np.take(self._table, rows_of[low:to], axis=0)  # one block more than is scored
            here = rows[at - low :]
            n = to - at
            keys = np.empty((n, 2 * BLOCK, 2 * d), np.float32)
            keys[:, BLOCK:] = here[:, :, 2 * d :]
            if low < at:
                keys[:, :BLOCK] = rows[:-1, :, 2 * d :]
            else:
                keys[0, :BLOCK] = 0
                keys[1:, :BLOCK] = rows[:-1, :, 2 * d :]
            scores = np.matmul(here[:, :, d : 2 * d], keys[:, :, :d].transpose(0, 2, 1))
            scores += bias
            scores[first[at:to], :, :BLOCK] = -1e4
            _exp(scores)
            part = np.matmul(scores, keys[:, :, d:])
            part /= (scores @ ones)[:, :, None]
            np.add(part, here[:, :, :d], out=state[:n, :, :d])
            wanted = targets[at:to].ravel()
            inside = np.flatnonzero(wanted >= 0)
            found.append(self._log_classes(state[:n].reshape(-1, d + 1)[inside], wanted[inside])[0])
        return np.concatenate(found) if found else np.zeros(0)

    def _log_classes(self, state: np.ndarray, wanted: np.ndarray, keep: bool = False) -> tuple:
        """(natural log probabilities of ids, and for learning: order by family, its cuts, softmaxes)."""
        voc = self.vocabulary
        classes = voc.class_of[wanted]
        family = (classes // FAMILY).astype(np.uint8)
        every = np.arange(len(wanted))
        order = np.argsort(family, kind="stable")
        cuts = np.searchsorted(family[order], np.arange(len(self.output) + 1))
        logits = state @ self.families
        sorted_state = state[order]
        inner = np.empty((len(wanted), FAMILY), np.float32)
        for g in range(len(self.output)):
            if cuts[g] < cuts[g + 1]:
                np.matmul(sorted_state[cuts[g] : cuts[g + 1]], self.output[g], out=inner[cuts[g] : cuts[g + 1]])
        value = logits[every, family].astype(float)
        value[order] += inner[every, (classes % FAMILY)[order]]
        shift = _exp(logits)
        total = logits.sum(1)
        value -= np.log(total) + shift
        shift = _exp(inner)
        inner_total = inner.sum(1)
        value[order] -= np.log(inner_total) + shift
        value += voc.log_share[wanted]
        if not keep:
            return (value,)
        logits /= total[:, None]
        inner /= inner_total[:, None]
        return value, family, classes, order, cuts, sorted_state, logits, inner

    def gradients(
        self, inputs: np.ndarray, before: np.ndarray, first: np.ndarray, targets: np.ndarray
    ) -> tuple[float, list[np.ndarray]]:
        """Mean class loss of some blocks, each with the inputs of the block before it, and its gradients."""
        voc, d = self.vocabulary, WIDTH
        n = len(inputs)
        rows = voc.row_of[np.concatenate([before, inputs], 1)]
        x = self.embed[rows]
        q = x[:, BLOCK:] @ self.project[:, :d]
        kv = x @ self.project[:, d:]
        k, v = kv[:, :, :d], kv[:, :, d:]
        scale = 1 / float(np.sqrt(d))  # a numpy scalar would turn single precision into double
        scores = np.matmul(scale * q, k.transpose(0, 2, 1))
        scores += self._scores_bias().astype(scores.dtype)
        scores[first, :, :BLOCK] = -1e4
        _exp(scores)
        p = scores
        p /= p.sum(2, keepdims=True)
        kind = self.output.dtype
        state = np.ones((n, BLOCK, d + 1), kind)
        state[:, :, :d] = np.matmul(p, v) + x[:, BLOCK:]
        inside = np.flatnonzero(targets.ravel() >= 0)
        wanted = targets.ravel()[inside]
        states = state.reshape(-1, d + 1)[inside]
        value, family, classes, order, cuts, sorted_state, outer, inner = self._log_classes(states, wanted, keep=True)
        count = max(1, len(inside))
        loss = float(-(value - voc.log_share[wanted]).sum() / count)

        every = np.arange(len(inside))
        outer[every, family] -= 1
        inner[every, (classes % FAMILY)[order]] -= 1
        outer, inner = outer.astype(kind) / kind.type(count), inner.astype(kind) / kind.type(count)
        d_families = states.T @ outer
        d_states = outer @ self.families.T
        d_output = np.zeros_like(self.output)
        from_inner = np.empty_like(d_states)
        for g in range(len(self.output)):
            a, b = cuts[g], cuts[g + 1]
            if a < b:
                d_output[g] = sorted_state[a:b].T @ inner[a:b]
                from_inner[a:b] = inner[a:b] @ self.output[g].T
        d_states[order] += from_inner
        d_state = np.zeros((n * BLOCK, d), kind)
        d_state[inside] = d_states[:, :d]
        d_state = d_state.reshape(n, BLOCK, d)
        d_p = np.matmul(d_state, v.transpose(0, 2, 1))
        d_kv = np.empty_like(kv)
        np.matmul(p.transpose(0, 2, 1), d_state, out=d_kv[:, :, d:])
        d_p -= (d_p * p).sum(2, keepdims=True)
        d_p *= p
        d_scores = d_p
        gap = np.arange(BLOCK, 2 * BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :]
        d_distance = np.bincount(np.abs(gap).ravel(), (d_scores.sum(0) * (gap >= 0)).ravel(), 2 * BLOCK)
        d_q = scale * np.matmul(d_scores, k)
        np.matmul(d_scores.transpose(0, 2, 1), scale * q, out=d_kv[:, :, :d])
        d_x = d_kv @ self.project[:, d:].T
        d_x[:, BLOCK:] += d_state + d_q @ self.project[:, :d].T
        d_project = np.concatenate(
            [x[:, BLOCK:].reshape(-1, d).T @ d_q.reshape(-1, d), x.reshape(-1, d).T @ d_kv.reshape(-1, 2 * d)], 1
        )
        order = np.argsort(rows.ravel(), kind="stable")
        sorted_rows = rows.ravel()[order]
        starts = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
        d_embed = np.zeros_like(self.embed)
        d_embed[sorted_rows[starts]] = np.add.reduceat(d_x.reshape(-1, d)[order], starts, axis=0)
        return loss, [d_embed, d_project, d_distance, d_families, d_output]


class Adam:
    """Steps of a model's weights, in place, with running moments of the gradients."""

    def __init__(self, model: Attention) -> None:
        self.model, self.step = model, 0
        self.moments = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights()]

    def take(self, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray, at: np.ndarray, rate: float) -> None:
        """One step by the gradients of the blocks ``at``."""
        self.step += 1
        _, gradients = self.model.gradients(inputs[at], inputs[np.maximum(at - 1, 0)], first[at], targets[at])
        for w, g, (a, b) in zip(self.model.weights(), gradients, self.moments):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (rate * (a / (1 - 0.9**self.step)) / (np.sqrt(b / (1 - 0.99**self.step)) + 1e-8)).astype(w.dtype)


def learn(adam: Adam, ids: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> int:
    """One pass over all blocks of the texts, in random order; returns their number."""
    inputs, targets, first = cut_flat(ids, sizes, len(adam.model.vocabulary.class_of) - 1)
    order = rng.permutation(len(inputs))
    for start in range(0, len(order), MINIBATCH):
        adam.take(inputs, targets, first, order[start : start + MINIBATCH], PASS_RATE)
    adam.model._table = None
    return len(inputs)


def fit(vocabulary: Vocabulary, texts: list[np.ndarray], steps: int = STEPS, seed: int = 1) -> Attention:
    """Train by Adam on random blocks of the texts."""
    model = Attention.untrained(vocabulary, seed)
    if not texts:
        model.families[:-1] = 0
        model.output[:, :-1] = 0
        return model
    rng = np.random.default_rng(seed)
    inputs, targets, first = cut_flat(*flat(texts), len(vocabulary.class_of) - 1)
    adam = Adam(model)
    for step in range(1, steps + 1):
        at = rng.integers(0, len(inputs), MINIBATCH)
        adam.take(inputs, targets, first, at, RATE * min(1, 2 * (1 - step / (steps + 1))))
    return model
