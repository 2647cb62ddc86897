"""Personal data by a skip-chain conditional random field over rules.

*Base.*  Rules find e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers.  They are exact and stay in the
result whatever the model says.

*Model.*  A token is a run of letters, digits and ``._%+@()-`` of ASCII.  Only tokens with a digit or an ``@`` can
carry a label, so all others are plain in every labelling and split a text into short chains.  A token's label (plain,
email, ip, card, phone) depends on its own form, on the words and tokens beside it, on its neighbours' labels in
the chain, and, over any distance, on the labels of like tokens: those with the same letters and digits, the same last
seven digits, or the same part before an ``@``.  Like tokens share potentials with one node for each such key, so
a key of m tokens costs m factors, not m squared.  Labels of tokens inside base spans are known; sum-product message
passing carries them to the rest of the document for ``ROUNDS`` rounds.

*Spans.*  Tokens that the model labels outside base spans are added: a token that is complete in itself (an
e-mail, an IP address, a number of enough digits) as a span of its own, neighbouring parts as one.

*Fit.*  Weights are learned by exact forward-backward on ``SAMPLE`` chains (cut into pieces of ``PIECE`` tokens for
this alone) with the least hashes of document and place, labelled by the base spans; likewise the strength of
likeness from the share of like tokens that agree.  That bound is the only one: every text is searched whole.

Defined cases: a null text is empty; empty texts and those without a digit or ``@`` have no spans; rows that
repeat are searched alike; null ids stay null; texts of one endless word or number are searched in linear time;
a table without any base span gets no added ones; an empty table gives an empty one; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import column, discard, materialise, new_folder, small_batches, text_bytes

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: plain
EMAIL, IP, CARD, PHONE = 1, 2, 3, 4
#: Pieces of chains that weights are learned from, and tokens of one.
SAMPLE, PIECE = 20_000, 32
#: Weight of the squares of all weights: forms never met then say little, and likeness decides.
RIDGE = 1e-3
ROUNDS, STEPS = 10, 120
#: Log potential of a known label.
KNOWN = 12.0
#: Most that likeness can weigh, so that it persuades and does not overrule.
MOST_ALIKE = 6.0
#: Blanks and marks between two neighbouring tokens, at most.
GAP = 2

_OPEN, _NUMERIC, _TOKEN = 1, 2, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*b"0123456789@"]] |= _OPEN
_CLASS[[*b"0123456789 ().+-"]] |= _NUMERIC
_CLASS[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+@()-"]] |= _TOKEN

_LOCAL = re.compile(rb"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match from inside a number would also start at the number's first digit.
_IP = re.compile(rb"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = bytes(c for c in range(256) if c not in b"0123456789")

Span = tuple[int, int, int]  # start, end, label


def luhn(digits: bytes) -> bool:
    values = np.frombuffer(digits, np.uint8).astype(int) - 48
    doubled = values[-2::-2] * 2
    return int(values[-1::-2].sum() + (doubled - 9 * (doubled > 9)).sum()) % 10 == 0


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def _emails(text: bytes) -> Iterator[Span]:
    """Addresses are looked for around each ``@``, so a long word is read once."""
    done, at = 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_BYTES:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end(), EMAIL
            done = domain.end()
        at = text.find(b"@", max(at + 1, done))


_LOCAL_BYTES = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def _small(part: bytes) -> bool:
    part = part.lstrip(b"0")
    return len(part) <= 3 and int(part or b"0") <= 255


def base_spans(text: bytes, classes: np.ndarray) -> list[Span]:
    """The spans of the rules, in bytes, sorted by start and kind."""
    found = list(_emails(text))
    starts, ends = _runs((classes & _NUMERIC) > 0)
    is_digit = (classes & (_OPEN | _NUMERIC)) == (_OPEN | _NUMERIC)
    digits = np.cumsum(is_digit, dtype=np.int64)
    here = digits[ends - 1] - digits[starts] + is_digit[starts] > 1
    for start, end in zip(starts[here].tolist(), ends[here].tolist()):
        for m in _IP.finditer(text, start, end):
            if all(map(_small, m.group().split(b"."))):
                found.append((m.start(), m.end(), IP))
        for m in _CARD.finditer(text, start, end):
            number = m.group().translate(None, _NOT_DIGIT)
            if 14 <= len(number) <= 19 and luhn(number):
                found.append((m.start(), m.end(), CARD))
        for m in _PHONE.finditer(text, start, end):
            if 10 <= len(m.group().translate(None, _NOT_DIGIT)) <= 15:
                found.append((m.start(), m.end(), PHONE))
    return sorted(found, key=lambda s: (s[0], s[2]))


@dataclass
class Tokens:
    """The tokens of one document that can carry a label."""

    spans: list[tuple[int, int]]
    features: np.ndarray  # of each token, ids of its features
    labels: np.ndarray  # of each token, the label of the base span that it lies in, else 0
    follows: np.ndarray  # of each token, whether it follows the one before it in a chain
    keys: list[list[bytes]]  # of each token, what like tokens share


#: Blocks of feature ids: each token has one of every block.
_SIZES = [1, 22, 4, 3, 6, 3, 2, 2, 4, 3, 11, 128, 64, 64, 4, 22, 22]
_BASES = np.cumsum([0, *_SIZES])
FEATURES = int(_BASES[-1])
_SHAPE = bytes.maketrans(
    b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"9" * 10 + b"a" * 26 + b"A" * 26
)
_REPEATS = re.compile(rb"(.)\1+", re.DOTALL)
_WORD_BEFORE = re.compile(rb"([^\x20\x09-\x0D]{1,24})[\x20\x09-\x0D]*\Z")
_WORD_AFTER = re.compile(rb"[\x20\x09-\x0D]*([^\x20\x09-\x0D]{1,24})")
#: Bytes of a token that its form is read from, and bytes beside it that a neighbouring word is read from.
_FORM, _BESIDE = 64, 32


def _bucket(word: bytes | None, size: int) -> int:
    """A word's letters hashed; 0 for none."""
    letters = (word or b"").lower().strip(b".,:;!?()[]\"'")
    return 1 + zlib.crc32(letters) % (size - 1) if letters else 0


def _own(token: bytes, digits: bytes) -> list[int]:
    n_digits = min(len(digits), 21)
    n_letters = len(token) - len(token.translate(None, _LETTERS))
    dots, hyphens = token.count(b"."), token.count(b"-")
    local, at, domain = token.partition(b"@")
    mail = (1 + bool(local and _DOMAIN.fullmatch(domain))) if at else 0
    parts = token.split(b".") if dots == 3 else []
    quad = (1 + all(map(_small, parts))) if len(parts) == 4 and all(p.isdigit() for p in parts) else 0
    check = (1 + luhn(digits)) if 14 <= len(digits) <= 19 else 0
    shape = _REPEATS.sub(rb"\1", token[:_FORM].translate(_SHAPE))
    return [
        0, n_digits, 0 if not n_letters else 1 if n_letters < 4 else 2 if n_letters < 11 else 3, mail,
        min(dots, 5), quad, int(token[:1] == b"+"), int(b"(" in token), min(hyphens, 3), check,
        digits[0] - 47 if digits else 0, zlib.crc32(shape) % 128,
    ]


_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _keys(token: bytes, digits: bytes) -> list[bytes]:
    whole = token.lower().strip(b"._%+()-")
    found = [b"w" + whole.translate(None, b"._%+()-")] if len(whole) > 3 else []
    if len(digits) >= 7 and len(digits) * 2 > len(whole):
        found.append(b"d" + digits[-7:])
    local = whole.partition(b"@")[0]
    if len(local) > 3 and not local.isdigit():
        found.append(b"l" + local)
    return found


def tokens_of(text: bytes, classes: np.ndarray, base: list[Span]) -> Tokens:
    starts, ends = _runs((classes & _TOKEN) > 0)
    opened = np.cumsum(classes & _OPEN, dtype=np.int64)
    here = opened[ends - 1] - opened[starts] + (classes[starts] & _OPEN) > 0
    spans = []
    for start, end in zip(starts[here].tolist(), ends[here].tolist()):
        core = text[start:end].rstrip(b"._%+()-")
        left = len(core) - len(core.lstrip(b"._%)-"))
        spans.append((start + left, start + len(core)))
    own, keys, rows = [], [], []
    for start, end in spans:
        token = text[start:end]
        digits = token.translate(None, _NOT_DIGIT)
        own.append(_own(token, digits))
        keys.append(_keys(token, digits))
    follows = np.array([i > 0 and 0 <= spans[i][0] - spans[i - 1][1] <= GAP for i in range(len(spans))], bool)
    for i, (start, end) in enumerate(spans):
        before = _WORD_BEFORE.search(text[max(0, start - _BESIDE) : start])
        after = _WORD_AFTER.match(text[end : end + _BESIDE])
        back, ahead = bool(follows[i]), i + 1 < len(spans) and bool(follows[i + 1])
        rows.append(
            own[i]
            + [
                _bucket(before and before[1], 64),
                _bucket(after and after[1], 64),
                back + 2 * ahead,
                own[i - 1][1] if back else 0,
                own[i + 1][1] if ahead else 0,
            ]
        )
    labels = np.zeros(len(spans), np.int64)
    bounds = np.array([s for s, _ in spans])
    for start, end, kind in base:
        for i in range(int(np.searchsorted(bounds, start)), len(spans)):
            if spans[i][0] >= end:
                break
            if spans[i][1] <= end and not labels[i]:
                labels[i] = kind
    features = np.array(rows, np.int64).reshape(-1, len(_SIZES)) + _BASES[:-1]
    return Tokens(spans, features, labels, follows, keys)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _unit(x: np.ndarray) -> np.ndarray:
    return x - _log_sum(x, 1)[:, None]


def beliefs(nodes: np.ndarray, change: np.ndarray, follows: np.ndarray, member: np.ndarray, hub: np.ndarray, alike: float, rounds: int = ROUNDS) -> np.ndarray:
    """Log marginals of all tokens by sum-product message passing.

    ``nodes`` has the log potentials of each token, ``change`` those of (label, next label) in a chain; token i is
    joined with i - 1 where ``follows``.  Token ``member[e]`` is joined with hub ``hub[e]``, whose label counts
    ``alike`` more where both agree.  Messages of a round come from those of the round before; chains are
    passed whole in every round, so the number of rounds does not limit their length.
    """
    right = np.flatnonzero(follows)
    n_hubs = int(hub.max(initial=-1)) + 1
    from_hub = np.zeros((len(member), LABELS))
    forward, backward = np.zeros_like(nodes), np.zeros_like(nodes)
    gain = np.expm1(alike)
    # Places in their chains, so that all chains move on together.
    place = np.arange(len(nodes)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(nodes))))
    order = np.argsort(place[right], kind="stable")
    levels = np.split(right[order], np.flatnonzero(np.diff(place[right][order])) + 1) if len(right) else []
    for _ in range(rounds if len(member) else 1):
        local = nodes.copy()
        np.add.at(local, member, from_hub)
        for at in levels:
            forward[at] = _unit(_log_sum((local[at - 1] + forward[at - 1])[:, :, None] + change[None], 1))
        for at in reversed(levels):
            backward[at - 1] = _unit(_log_sum((local[at] + backward[at])[:, None, :] + change[None], 2))
        total = local + forward + backward
        if not len(member):
            break
        to_hub = _unit(total[member] - from_hub)
        # What the hub hears of a token's label: its own label, or any other.
        heard = _unit(np.logaddexp(0, to_hub + np.log(gain)) if gain > 0 else np.zeros_like(to_hub))
        met = np.zeros((n_hubs, LABELS))
        np.add.at(met, hub, heard)
        others = _unit(met[hub] - heard)
        from_hub = _unit(np.logaddexp(0, others + np.log(gain))) if gain > 0 else from_hub
    return _unit(total)


@dataclass
class SkipChain:
    """Weights of features by label, of neighbouring labels, and of likeness."""

    weights: np.ndarray
    change: np.ndarray
    alike: float
    trained: bool = True

    def labels(self, docs: list[Tokens]) -> list[np.ndarray]:
        """The most probable label of every token; known ones stay."""
        if not self.trained:
            return [d.labels for d in docs]
        features = np.concatenate([d.features for d in docs]) if docs else np.zeros((0, len(_SIZES)), np.int64)
        known = np.concatenate([d.labels for d in docs]) if docs else np.zeros(0, np.int64)
        follows = np.concatenate([d.follows for d in docs]) if docs else np.zeros(0, bool)
        nodes = self.weights[features].sum(1)
        nodes[known > 0, known[known > 0]] += KNOWN
        member, hub = hubs(docs)
        best = beliefs(nodes, self.change, follows, member, hub, self.alike).argmax(1)
        best = np.where(known > 0, known, best)
        return np.split(best, np.cumsum([len(d.spans) for d in docs])[:-1]) if docs else []


def hubs(docs: list[Tokens]) -> tuple[np.ndarray, np.ndarray]:
    """(token, hub) of every key that several tokens of a document share; tokens are numbered through all documents."""
    member, hub, first, n = [], [], 0, 0
    for doc in docs:
        at: dict[bytes, list[int]] = {}
        for i, keys in enumerate(doc.keys):
            for key in keys:
                at.setdefault(key, []).append(first + i)
        for tokens in at.values():
            if len(tokens) > 1:
                member += tokens
                hub += [n] * len(tokens)
                n += 1
        first += len(doc.spans)
    return np.array(member, np.int64), np.array(hub, np.int64)


def _complete(text: bytes, label: int) -> bool:
    digits = len(text.translate(None, _NOT_DIGIT))
    return label in (EMAIL, IP) or digits >= (12 if label == CARD else 10)


def added_spans(text: bytes, tokens: Tokens, labels: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of labelled tokens that touch no base span, in bytes."""
    out: list[Span] = []
    taken = np.zeros(len(tokens.spans), bool)
    starts, ends = (np.array([s[i] for s in tokens.spans]) for i in (0, 1))
    for a, b, _ in base:
        taken[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b)] = True
    part: list[int] | None = None  # start, end, label, last token of a span that grows
    for i, ((start, end), label) in enumerate(zip(tokens.spans, labels.tolist())):
        if not label or taken[i]:
            continue
        alone = _complete(text[start:end], label)
        if part and not alone and label == part[2] and part[3] == i - 1 and tokens.follows[i]:
            part[1], part[3] = end, i
            continue
        if part:
            out.append((part[0], part[1], part[2]))
        part = None
        if alone:
            out.append((start, end, label))
        else:
            part = [start, end, label, i]
    if part:
        out.append((part[0], part[1], part[2]))
    return out


def fit(pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]], agree: int = 0, differ: int = 0, steps: int = STEPS) -> SkipChain:
    """Learn from (features, labels, follows) of pieces of chains, and from like tokens that agree and differ."""
    weights, change = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS))
    alike = float(np.clip(np.log((agree + 1) / (differ + 1) * (LABELS - 1)), 0, MOST_ALIKE))
    if not any(labels.any() for _, labels, _ in pieces):
        return SkipChain(weights, change, alike, trained=False)
    features = np.concatenate([f for f, _, _ in pieces])
    labels = np.concatenate([y for _, y, _ in pieces])
    follows = np.concatenate([c for _, _, c in pieces])
    n, right = len(labels), np.flatnonzero(follows)
    place = np.arange(n) - np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    order = np.argsort(place[right], kind="stable")
    levels = np.split(right[order], np.flatnonzero(np.diff(place[right][order])) + 1) if len(right) else []
    seen = np.zeros((LABELS, LABELS))
    np.add.at(seen, (labels[right - 1], labels[right]), 1)
    truth = np.eye(LABELS)[labels]
    moments = [np.zeros((FEATURES + LABELS, LABELS)) for _ in range(2)]
    at = np.zeros((FEATURES + LABELS, LABELS))
    for step in range(1, steps + 1):
        weights, change = at[:FEATURES], at[FEATURES:]
        nodes = weights[features].sum(1)
        forward, backward = np.zeros_like(nodes), np.zeros_like(nodes)
        for i in levels:
            forward[i] = _unit(_log_sum((nodes[i - 1] + forward[i - 1])[:, :, None] + change[None], 1))
        for i in reversed(levels):
            backward[i - 1] = _unit(_log_sum((nodes[i] + backward[i])[:, None, :] + change[None], 2))
        error = np.exp(_unit(nodes + forward + backward)) - truth
        gradient = np.zeros_like(at)
        for y in range(LABELS):
            gradient[:FEATURES, y] = np.bincount(features.ravel(), np.repeat(error[:, y], features.shape[1]), FEATURES)
        pairs = (nodes + forward)[right - 1][:, :, None] + change[None] + (nodes + backward)[right][:, None, :]
        pairs = np.exp(pairs - _log_sum(pairs.reshape(len(right), -1), 1)[:, None, None]) if len(right) else np.zeros((0, LABELS, LABELS))
        gradient[FEATURES:] = pairs.sum(0) - seen
        gradient = gradient / n + RIDGE * at
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        at = at - 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
    return SkipChain(at[:FEATURES], at[FEATURES:], alike)


def _opened(texts: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(row, text, classes of its bytes) of the texts that hold a digit or an ``@``."""
    for i, text in enumerate(texts):
        data = text.as_buffer()
        classes = _CLASS[np.frombuffer(data, np.uint8)] if data is not None and data.size else None
        if classes is not None and (classes & _OPEN).any():
            yield i, data.to_pybytes(), classes


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, data, agree, differ): pieces of chains, and one row a batch that counts like tokens."""
    for batch in batches:
        hashes, data, docs = [], [], []
        for i, text, classes in _opened(batch.column(1)):
            tokens = tokens_of(text, classes, base_spans(text, classes))
            docs.append(tokens)
            owner = str(batch.column(0)[i].as_py()).encode()
            starts = np.flatnonzero(~tokens.follows).tolist() + [len(tokens.spans)]
            for start, end in zip(starts, starts[1:]):
                for cut in range(start, end, PIECE):
                    part = slice(cut, min(cut + PIECE, end))
                    hashes.append(zlib.crc32(owner + b":%d" % cut) << 31 | zlib.crc32(b"%d:" % cut + owner) >> 1)
                    row = np.concatenate([tokens.features[part].ravel(), tokens.labels[part]])
                    data.append(row.astype(np.int32).tobytes())
        member, hub = hubs(docs)
        known = np.concatenate([d.labels for d in docs]) if docs else np.zeros(0, np.int64)
        # In a hub, neighbours stand for pairs.
        pair = np.flatnonzero(np.diff(hub) == 0)
        left, right = known[member[pair]], known[member[pair + 1]]
        either = (left > 0) | (right > 0)
        counts = [0] * len(hashes)
        same, other = int((either & (left == right)).sum()), int((either & (left != right)).sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*hashes, None], pa.int64()),
                pa.array([*data, None], pa.binary()),
                pa.array([*counts, same], pa.int64()),
                pa.array([*counts, other], pa.int64()),
            ],
            names=["hash", "data", "agree", "differ"],
        )


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> SkipChain:
    """Fit on the ``sample`` pieces of chains with the least hashes; each is small, so the driver gets a bounded table."""
    small_batches(docs.sparkSession)
    source = docs.select(column(id_col).cast("string").alias("doc_id"), text_bytes(text_col).alias("text"))
    source = source.where(F.col("text").cast("string").rlike("[0-9@]"))
    folder = new_folder(docs.sparkSession, "pieces")
    found = materialise(source.mapInArrow(_pieces, "hash long, data binary, agree long, differ long"), "pieces", path=folder)
    chosen = found.where("hash is not null").groupBy("hash").agg(F.min("data").alias("data")).orderBy("hash").limit(sample).collect()
    agree, differ = found.where("hash is null").agg(F.sum("agree"), F.sum("differ")).first()
    discard(docs.sparkSession, folder)
    pieces = []
    for row in sorted(chosen):
        values = np.frombuffer(row.data, np.int32).astype(np.int64)
        n = len(values) // (len(_SIZES) + 1)
        pieces.append((values[:-n].reshape(n, -1), values[-n:], np.arange(n) > 0))
    return fit(pieces, agree or 0, differ or 0)


def _places(text: bytes, spans: list[Span]) -> list[Span]:
    """Spans in code points."""
    if text.isascii() or not spans:
        return spans
    starts = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    place = lambda at: int(starts[at - 1]) if at else 0
    return [(place(a), place(b), kind) for a, b, kind in spans]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k - 1]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


_OUT = pa.schema(
    [("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in KINDS]
    + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
)
#: Documents that pass messages together.
_TOGETHER = 256


def find(docs: DataFrame, model: SkipChain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    small_batches(docs.sparkSession)
    nothing = hashlib.sha256().hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(i, 0, 0, 0, 0, nothing, "", 0) for i in ids]
            group: list[tuple[int, bytes, list[Span], Tokens]] = []

            def settle() -> None:
                for (at, text, base, tokens), labels in zip(group, model.labels([g[3] for g in group])):
                    more = added_spans(text, tokens, labels, base)
                    base, more = _places(text, base), _places(text, more)
                    counts = [sum(k == kind for _, _, k in base) for kind in range(1, LABELS)]
                    digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                    rows[at] = ids[at], *counts, digest, _joined(base + more), len(more)
                group.clear()

            for at, text, classes in _opened(batch.column(1)):
                base = base_spans(text, classes)
                group.append((at, text, base, tokens_of(text, classes, base)))
                if len(group) == _TOGETHER:
                    settle()
            settle()
            columns = zip(*rows) if rows else [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _OUT)], schema=_OUT)

    return docs.select(column(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )
