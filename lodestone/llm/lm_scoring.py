"""Language-model scores of whole texts, beside a word-count baseline.

*Counts.*  Every task counts the words of its training documents; the sums of all tasks are the word
table, which covers the whole corpus and grows with it.  Subword counts of the whole corpus follow
from the word table, as each word is tokenised on its own.

*Model.*  A word is either written whole, with its share of the corpus, or spelled in subwords by
``lodestone.llm.attention``: causal self-attention over subword ids whose shares inside classes come from
the subword counts.  The attention weights start from a fit on a sample of training documents
(``sample_docs``) and then pass over all training documents, whole texts, in ``PASSES`` rounds: documents
are dealt by hash to groups whose number grows with the corpus, each group learns from the weights of the
round before, and the new weights are the mean of the groups' by blocks.  How often a word is written
whole maximises the likelihood of all training documents, each scored before the weights see it and each word
left out of its own count; expectation maximisation needs only a histogram of the log ratio of the two
probabilities.

*Scores.*  The most frequent words, at most ``TOP_WORDS`` of them, go to the tasks as a table of bounded
size; every occurrence of a word beyond it is sent, with its probability by spelling, to the word table by
a shuffle join, and baseline and score come back as sums, so neither depends on the size of that table.

Defined cases: a null text counts as empty and holds the end alone; null ids are in no fold, so they are
scored but not learned from; repeated rows are scored each; without training documents counts are zero
and the model is uniform within classes; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import copy
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import subwords
from lodestone.llm.attention import STEPS, Adam, Attention, Vocabulary, fit, learn
from lodestone.llm.shared import column, discard, id_crc32, materialise, new_folder, release, small_batches, text_bytes

#: The end of a text, as a word; no word holds a blank.
END = b"\n"
#: Ids of the byte-level vocabulary; the next one is free and marks the end.
IDS = 50_256
#: Words sent to every task, at most, and words one task counts before it sends sums on.
TOP_WORDS, COUNTED_WORDS = 250_000, 500_000
#: Training documents, expected, and characters of each that the attention weights start from.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 6000
#: Rounds that share out the training documents, and words of one group.
PASSES, GROUP_WORDS = 2, 1_000_000
#: Steps of a unit of the natural logarithm in the histogram that the mixture is fitted on.
RATIO_STEPS = 64
SMOOTH = 0.1


def held_out(id_col: str | Column) -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(id_crc32(id_col) % 10 == 0, F.lit(False))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def sums() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
        )

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(text.lower().split())  # bytes: A-Z and ASCII blanks alone
        counts[END] += batch.num_rows
        if len(counts) > COUNTED_WORDS:
            yield sums()
            counts.clear()
    if counts:
        yield sums()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) over all training documents, the end among the words."""
    doc_id = column(id_col).cast("long")
    training = docs.where(doc_id.isNotNull() & ~held_out(doc_id)).select(text_bytes(text_col).alias("text"))
    counted = training.mapInArrow(_words, "word binary, n long")
    return materialise(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")


def _subwords_of_words(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(path, pattern)
        total = np.zeros(IDS, np.int64)
        for batch in batches:
            ids = cache.encode_many(batch.column(0).to_pylist())
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            np.add.at(total, np.frombuffer(b"".join(ids), np.uint32), np.repeat(batch.column(1).to_numpy(), sizes))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    return run


_CACHES: dict[str, subwords.WordCache] = {}


def _cache(path: str, pattern: str) -> subwords.WordCache:
    """The worker's own cache of this vocabulary."""
    if path not in _CACHES:
        _CACHES.clear()
        _CACHES[path] = subwords.byte_bpe(path, pattern)
    return _CACHES[path]


def _starts_word(path: str) -> np.ndarray:
    """Whether an id begins with a space."""
    import base64

    flags = np.zeros(IDS + 1, bool)
    with open(path, "rb") as lines:
        for word, number in map(bytes.split, lines):
            flags[int(number)] = base64.b64decode(word).startswith(b" ")
    return flags


def _sample(docs: DataFrame, id_col: str, text_col: str, sample_docs: int) -> list[bytes]:
    """Texts of about ``sample_docs`` training documents by a hash of the id; of long texts a piece from anywhere."""
    doc_id = column(id_col).cast("long")
    known = docs.where(doc_id.isNotNull() & ~held_out(doc_id))
    share = min(1.0, sample_docs / max(1, known.count()))
    place = F.pmod(F.xxhash64(doc_id, F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    text = F.coalesce(column(text_col), F.lit(""))
    spare = F.length(text) - SAMPLE_CHARS
    start = F.pmod(F.xxhash64(doc_id, F.lit("start")), F.greatest(spare, F.lit(1)).cast("long")).cast("int") + 1
    piece = F.when(spare <= 0, text).otherwise(text.substr(start, F.lit(SAMPLE_CHARS)))
    # Of rows that repeat an id that with the smallest piece stands for all.
    rows = known.where(place < share).groupBy(doc_id.alias("i")).agg(F.min(piece).alias("t")).collect()
    return [t.encode() for _, t in sorted((r.i, r.t) for r in rows)]


@dataclass(frozen=True)
class Table:
    """Shares of the corpus: log10 by word for the most frequent, and what is known of the rest.

    ``norm`` is the log10 of the smoothed number of words, ``end`` the share of the end, None without any.
    """

    shares: dict[bytes, float]
    norm: float
    end: float | None

    def of(self, words: list[bytes]) -> np.ndarray:
        """Shares of distinct words; zero for those beyond the table."""
        return np.array([self.shares.get(w, 0.0) for w in words], float)

    def without_itself(self, shares: np.ndarray) -> np.ndarray:
        """Natural log of the shares of words whose own occurrence is left out of their count."""
        others = np.maximum(np.rint(10 ** (shares + self.norm) - SMOOTH) - 1, 0)
        return np.log(others + SMOOTH) - self.norm * math.log(10)


def _sizes(batch: subwords.Batch) -> np.ndarray:
    return np.diff(np.concatenate(([0], batch.ends)))


def _word_scores(model: Attention, batch: subwords.Batch) -> tuple[np.ndarray, np.ndarray]:
    """(natural log probability of every word by its spelling, that of every text's end)."""
    scores = model.id_scores(batch.ids, _sizes(batch))
    if not len(scores):
        return np.zeros(0), np.zeros(0)
    texts = np.arange(len(batch.ends))
    of_text = np.repeat(texts, np.diff(np.concatenate(([0], batch.text_chunks))))
    words = np.arange(len(batch.which)) + of_text  # places among words and ends
    ends = batch.text_chunks + texts
    starts = np.empty(len(words) + len(ends), np.int64)
    starts[words] = np.concatenate(([0], batch.chunk_ends[:-1])) + of_text if len(words) else 0
    starts[ends] = batch.ends + texts
    sums = np.add.reduceat(scores, starts)
    return sums[words], sums[ends]


class Ratios(dict):
    """Histogram: step of the log ratio of two probabilities -> [count, sum of the ratios]."""

    def add(self, ratio: np.ndarray) -> None:
        steps, place = np.unique(np.floor(ratio * RATIO_STEPS).astype(np.int64), return_inverse=True)
        for step, count, total in zip(steps.tolist(), np.bincount(place).tolist(), np.bincount(place, ratio).tolist()):
            old = self.setdefault(step, [0, 0.0])
            old[0] += count
            old[1] += total


#: Kinds of rows that learning gives: sums of weights by place, steps of the histogram, words beyond the table.
_WEIGHT, _RATIO, _BEYOND = range(3)
_LEARNED = "kind int, place long, n long, value double, word binary"


def _learn(shared, shared_table, path: str, pattern: str):
    def rows(kind: int, place, n, value, word=None) -> pa.RecordBatch:
        columns = [pa.array(c) for c in (np.full(len(place), kind, np.int32), place, n, value)]
        word = pa.nulls(len(place), pa.binary()) if word is None else word
        return pa.RecordBatch.from_arrays([*columns, word], names=["kind", "place", "n", "value", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared_table.value
        model = copy.deepcopy(shared.value)
        adam, rng, cache, ratios = Adam(model), np.random.default_rng(1), _cache(path, pattern), Ratios()
        blocks = 0
        for batch in batches:
            for _, texts in subwords.slices(subwords.lowered(batch.column(0))):
                found = cache.batch(texts)
                spelled, _ = _word_scores(model, found)  # before the weights see these texts
                shares = table.of(found.distinct)[found.which]
                rare = np.flatnonzero(shares == 0)
                ratios.add(table.without_itself(shares[shares < 0]) - spelled[shares < 0])
                if len(rare):
                    beyond = pa.array(found.distinct, pa.binary()).take(pa.array(found.which[rare]))
                    zeros = np.zeros(len(rare), np.int64)
                    yield rows(_BEYOND, zeros, zeros, spelled[rare], beyond)
                blocks += learn(adam, found.ids, _sizes(found), rng)

        if blocks:
            flat = np.concatenate([w.ravel() for w in model.weights()]).astype(float) * blocks
            yield rows(_WEIGHT, np.arange(len(flat)), np.full(len(flat), blocks), flat)
        if ratios:
            counts, sums = zip(*ratios.values())
            yield rows(_RATIO, np.array(list(ratios), np.int64), np.array(counts, np.int64), np.array(sums, float))

    return run


def _pass_over(
    docs: DataFrame, model: Attention, words: DataFrame, norm: float, table, path: str, pattern: str, id_col: str, text_col: str
) -> tuple[Attention, float]:
    """(weights after one pass over all training documents, share of words that are written whole)."""
    doc_id = column(id_col).cast("long")
    spark = docs.sparkSession
    tokens = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = -(-max(tokens, 1) // (PASSES * GROUP_WORDS))
    rows = docs.where(doc_id.isNotNull() & ~held_out(doc_id)).select(
        doc_id.alias("i"), text_bytes(text_col).alias("text"), F.pmod(F.xxhash64(doc_id, F.lit("pass")), F.lit(PASSES)).alias("p")
    )
    ratios: dict[int, list] = {}
    for number in range(PASSES):
        # Dealt by a hash and sorted, so the weights do not depend on how the input is partitioned.
        dealt = rows.where(F.col("p") == number).repartition(groups, F.xxhash64("i", "text")).sortWithinPartitions("i", "text")
        shared = spark.sparkContext.broadcast(model)
        folder = new_folder(spark, "learned")
        learned = dealt.select("text").mapInArrow(_learn(shared, table, path, pattern), _LEARNED)
        learned = materialise(learned, "learned", ("kind",), folder)
        shared.destroy()
        # Words beyond the table meet their counts here and become steps of the histogram too.
        others = F.log(F.greatest(F.col("c") - 1, F.lit(0)) + F.lit(SMOOTH)) - F.lit(norm * math.log(10))
        beyond = learned.where(F.col("kind") == _BEYOND).select("word", "value").join(words.select("word", F.col("n").alias("c")), "word")
        beyond = beyond.select(
            F.lit(_RATIO).alias("kind"),
            F.floor((others - F.col("value")) * RATIO_STEPS).alias("place"),
            F.lit(1).cast("long").alias("n"),
            (others - F.col("value")).alias("value"),
        )
        sums = learned.where(F.col("kind") != _BEYOND).select("kind", "place", "n", "value").unionByName(beyond)
        # At most one row for each weight and some thousand steps of the histogram.
        found = sums.groupBy("kind", "place").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).toArrow()
        kind, place, n, value = (found[c].to_numpy() for c in ("kind", "place", "n", "value"))
        discard(spark, folder)
        del dealt, learned, beyond, sums
        release(spark)
        for step, count, total in zip(place[kind == _RATIO].tolist(), n[kind == _RATIO].tolist(), value[kind == _RATIO].tolist()):
            old = ratios.setdefault(step, [0, 0.0])
            old[0] += count
            old[1] += total
        some = kind == _WEIGHT
        if not some.any():
            continue
        flat = np.zeros(int(some.sum()))
        flat[place[some]] = value[some] / n[some]
        model, at = copy.deepcopy(model), 0
        for w in model.weights():
            w[...] = flat[at : at + w.size].reshape(w.shape)
            at += w.size
    return model, _mixture(ratios[step] for step in sorted(ratios))


def train(
    docs: DataFrame,
    words: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_docs: int = SAMPLE_DOCS,
    steps: int = STEPS,
    table: Table | None = None,
    shared_table=None,
) -> tuple[Attention, float]:
    """(model, share of words that are written whole): class shares from the word table, attention weights from
    passes over the texts, both of the whole corpus."""
    counts = np.zeros(IDS + 1, np.int64)
    split = words.where(F.col("word") != F.lit(END)).mapInArrow(_subwords_of_words(path, pattern), "id long, n long")
    for number, n in split.groupBy("id").agg(F.sum("n")).collect():  # at most one row for each id
        counts[number] = n
    counts[IDS] = words.where(F.col("word") == F.lit(END)).agg(F.sum("n")).first()[0] or 0
    vocabulary = Vocabulary.of_counts(counts, _starts_word(path))
    cache = subwords.byte_bpe(path, pattern)
    sample = _sample(docs, id_col, text_col, sample_docs)
    texts = [np.frombuffer(cache.ids_of(t.lower()), np.uint32).astype(np.int64) for t in sample]
    table = table or Table({}, 0.0, None)
    shared_table = shared_table or docs.sparkSession.sparkContext.broadcast(table)
    return _pass_over(docs, fit(vocabulary, texts, steps), words, table.norm, shared_table, path, pattern, id_col, text_col)


def _mixture(ratios: Iterable[tuple[int, float]]) -> float:
    """Share of the word table in the probability of a word, by expectation maximisation.

    ``ratios`` are counts, and sums, of the natural log of probability by the table over that by the model.
    """
    found = np.array([(n, total / n) for n, total in ratios], float).reshape(-1, 2)
    n, ratio = found[:, 0], found[:, 1]
    share = 0.5
    for _ in range(30 if len(found) else 0):
        odds = np.exp(-np.abs(x := ratio + math.log(share / (1 - share))))
        part = np.where(x > 0, 1, odds) / (1 + odds)
        share = float(np.clip((n * part).sum() / n.sum(), 0.01, 0.99))
    return share


#: Kinds of rows that scoring writes: documents, and occurrences of words beyond the table.
_DOC, _RARE = range(2)
_OUT = "kind int, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word binary"
_ARROW = pa.schema(
    [
        ("kind", pa.int32()),
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base", pa.float64()),
        ("score", pa.float64()),
        ("word", pa.binary()),
    ]
)


def _mixed(spelled: np.ndarray, shares: np.ndarray, mixture: float) -> np.ndarray:
    """Natural log probability of words: spelled, or written whole where the table has them."""
    out = spelled + math.log(1 - mixture)
    some = shares < 0
    out[some] = np.logaddexp(out[some], shares[some] * math.log(10) + math.log(mixture))
    return out


def _score(shared, shared_table, path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model, mixture), table = shared.value, shared_table.value
        cache = _cache(path, pattern)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, texts in subwords.slices(subwords.lowered(batch.column(2))):
                n = len(texts)
                found = cache.batch(texts)
                shares = table.of(found.distinct)[found.which]
                spelled, ends = _word_scores(model, found)
                sizes = np.diff(np.concatenate(([0], found.text_chunks)))
                of_text = np.repeat(np.arange(n), sizes)
                rare = shares == 0
                known = sizes - np.bincount(of_text[rare], minlength=n)
                mixed = _mixed(spelled[~rare], shares[~rare], mixture)
                end_share = np.full(n, 0.0 if table.end is None else table.end)
                score = np.bincount(of_text[~rare], mixed, n) + _mixed(ends, end_share, mixture)
                base = np.bincount(of_text, shares, n) + end_share
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, _DOC, np.int32)),
                        pa.array(row + at + np.arange(n)),
                        batch.column(0).slice(at, n),
                        batch.column(1).slice(at, n),
                        pa.array(sizes + 1),
                        pa.array(known + (table.end is not None)),
                        pa.array(base),
                        pa.array(score / math.log(10)),
                        pa.nulls(n, pa.binary()),
                    ],
                    schema=_ARROW,
                )
                places = np.flatnonzero(rare)
                m = len(places)
                if m:
                    empty = [pa.nulls(m, f.type) for f in _ARROW]
                    empty[0], empty[1] = pa.array(np.full(m, _RARE, np.int32)), pa.array(row + at + of_text[places])
                    empty[7] = pa.array(spelled[places])
                    empty[8] = pa.array(found.distinct, pa.binary()).take(pa.array(found.which[places]))
                    yield pa.RecordBatch.from_arrays(empty, schema=_ARROW)
            row += batch.num_rows

    return run


#: Steps of a count's logarithm that the cut between frequent and other words is looked for in.
_OCTAVES = 8


def _frequent(words: DataFrame, top_words: int) -> tuple[dict[bytes, int], Column]:
    """The most frequent words, all of a step of counts or none, and the condition that names them."""
    step = F.floor(F.log2(F.col("n").cast("double")) * _OCTAVES)
    sizes = sorted(tuple(r) for r in words.groupBy(step.alias("s")).count().collect())  # a few hundred steps
    total, cut = 0, None
    for s, n in reversed(sizes):
        total += n
        if total > top_words:
            break
        cut = s
    chosen = (step >= cut) if cut is not None else F.lit(False)
    return {bytes(r.word): r.n for r in words.where(chosen).collect()}, chosen


def score(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    top_words: int = TOP_WORDS,
    sample_docs: int = SAMPLE_DOCS,
    steps: int = STEPS,
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_batches(spark)
    words = word_counts(docs, id_col, text_col)
    train_tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    norm = math.log10(train_tokens + SMOOTH * (distinct + 1))
    top, frequent = _frequent(words, top_words)
    shares = {w: math.log10(n + SMOOTH) - norm for w, n in top.items()}
    # A share of exactly zero would need a corpus of one token; the rest of the table then does the work.
    shares = {w: s for w, s in shares.items() if s < 0}
    end = words.where(F.col("word") == F.lit(END)).first()
    table = Table(shares, norm, None if end is None else math.log10(end.n + SMOOTH) - norm)
    shared_table = spark.sparkContext.broadcast(table)
    model, mixture = train(docs, words, path, pattern, id_col, text_col, sample_docs, steps, table, shared_table)
    shared = spark.sparkContext.broadcast((model, mixture))

    doc_id = column(id_col).cast("long")
    source = docs.select(
        doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), text_bytes(text_col).alias("text")
    )
    scored = materialise(source.mapInArrow(_score(shared, shared_table, path, pattern), _OUT), "scored", ("kind",))
    shared.destroy()
    shared_table.destroy()
    rest = words.where(~frequent if top else F.lit(True)).select("word", F.col("n").alias("c"))
    met = scored.where(F.col("kind") == _RARE).select("row", "word", "score").join(rest, "word", "left")
    spelled = F.col("score") + F.lit(math.log(1 - mixture))
    whole = F.log(F.col("c") + F.lit(SMOOTH)) + F.lit(math.log(mixture) - norm * math.log(10))
    mixed = F.greatest(spelled, whole) + F.log1p(F.exp(-F.abs(spelled - whole)))
    rare = met.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH)) - F.lit(norm)).alias("rare_base"),
        F.count("c").alias("rare_known"),
        (F.sum(F.coalesce(mixed, spelled)) / F.lit(math.log(10))).alias("rare_score"),
    )
    end_base = F.lit(0.0 if end is not None else math.log10(SMOOTH) - norm)
    return (
        scored.where(F.col("kind") == _DOC)
        .select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score")
        .join(rare, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(train_tokens).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + end_base).alias("base_score"),
            (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
        )
    )
