"""Subword ids through a bounded cache of words.

Blank-separated chunks of a text are tokenised independently by every tokenizer used here, so a
text's ids are the joined ids of its chunks.  A batch of texts is cut and its distinct chunks are
found by Arrow; the cache is asked once for each distinct chunk, the tokenizer once for each that
neither generation of the cache holds, and the ids of the batch are gathered from those spans.
"""

from __future__ import annotations

import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Chunks kept by one worker in each of two generations.
CACHE_WORDS = 400_000


class WordCache:
    """Maps chunks (bytes) to the bytes of their ids, little-endian unsigned 32-bit each.

    A full generation becomes the older one and its predecessor goes; what is used moves to the younger.
    """

    def __init__(
        self,
        encode: Callable[[bytes], bytes],
        limit: int = CACHE_WORDS,
        any_case: bool = False,
        encode_many: Callable[[list[bytes]], list[bytes]] | None = None,
    ) -> None:
        self.encode = encode
        #: Ids of several chunks; in one call of the library where that is known to give the same.
        self.encode_many = encode_many or (lambda chunks: list(map(encode, chunks)))
        self.limit = limit
        #: Whether ids do not depend on the case of A-Z, special tokens aside.
        self.any_case = any_case
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def ids_of_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each of some distinct chunks."""
        found = list(map(self._young.get, chunks))
        absent = [ids is None for ids in found]
        if any(absent):
            missing = list(compress(chunks, absent))
            ids = list(map(self._old.get, missing))
            fresh = iter(self.encode_many([chunk for chunk, known in zip(missing, ids) if known is None]))
            ids = [next(fresh) if known is None else known for known in ids]
            fresh = iter(ids)
            found = [next(fresh) if none else known for none, known in zip(absent, found)]
            self._make_room(len(missing))
            self._young.update(zip(missing, ids))
        return found

    def _make_room(self, n: int) -> None:
        if len(self._young) + n > self.limit:
            self._old, self._young = self._young, {}

    def keep(self, chunk: bytes, ids: bytes) -> None:
        self._make_room(1)
        self._young[chunk] = ids

    def known(self, chunk: bytes) -> bytes | None:
        found = self._young.get(chunk)
        return self._old.get(chunk) if found is None else found

    def ids_of(self, text: bytes) -> bytes:
        chunks = text.split()
        distinct = list(dict.fromkeys(chunks))
        ids = dict(zip(distinct, self.ids_of_chunks(distinct)))
        return b"".join(map(ids.__getitem__, chunks))

    def batch(self, texts: pa.Array) -> Batch:
        return Batch(self, texts)


class Batch:
    """Chunks and ids of some texts (a binary array that holds UTF-8), in their order.

    ``ids`` are those of all texts; ``ends`` where each text's ids end; ``chunk_ends`` where each
    chunk's ids end; ``text_chunks`` where each text's chunks end; chunk ``i`` is
    ``distinct[which[i]]``.
    """

    def __init__(self, cache: WordCache, texts: pa.Array) -> None:
        texts = texts.view(pa.string())
        if cache.any_case and not pc.any(pc.match_substring(texts, SPECIAL)).as_py():
            texts = pc.ascii_lower(texts)
        self.distinct, self.which, self.text_chunks = distinct_chunks(texts)
        spans = cache.ids_of_chunks(self.distinct)
        pool = np.frombuffer(b"".join(spans), np.uint32)
        sizes = np.fromiter(map(len, spans), np.int64, len(spans)) // 4
        starts = np.cumsum(sizes) - sizes
        size = sizes[self.which]
        self.chunk_ends = np.cumsum(size)
        total = int(self.chunk_ends[-1]) if len(size) else 0
        shift = starts[self.which] - (self.chunk_ends - size)
        self.ids = pool[np.repeat(shift, size) + np.arange(total)]
        ends = np.concatenate(([0], self.chunk_ends))
        self.ends = ends[self.text_chunks]


def distinct_chunks(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct chunks, number of each chunk's among them, where each text's chunks end)."""
    cut = pc.ascii_split_whitespace(texts)
    coded = cut.flatten().dictionary_encode()
    distinct = coded.dictionary.view(pa.binary()).to_pylist()
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = cut.offsets.to_numpy().astype(np.int64)
    ends = offsets[1:] - offsets[0]
    if b"" in distinct:  # blanks at either end of a text cut off an empty chunk
        empty = distinct.index(b"")
        kept = which != empty
        ends = np.concatenate(([0], np.cumsum(kept)))[ends]
        which = which[kept]
        which -= which > empty
        del distinct[empty]
    return distinct, which, ends


#: Bytes of texts that are cut into chunks at a time.
SLICE_BYTES = 8 << 20


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(place of the first, texts) in runs of bounded size; a longer text is a run of its own."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)).astype(np.int64)
    start = held = 0
    for at, size in enumerate(sizes.tolist()):
        if held and held + size > SLICE_BYTES:
            yield start, texts.slice(start, at - start)
            start, held = at, 0
        held += size
    if len(texts) > start:
        yield start, texts.slice(start)


def lowered(texts: pa.Array) -> pa.Array:
    """Texts (a binary array that holds UTF-8) with A-Z in lower case."""
    return pc.ascii_lower(texts.view(pa.string())).view(pa.binary())


#: What special tokens of the vocabulary files begin with.
SPECIAL = "<|"
#: Fixed values of the vocabulary file: how it cuts a normalised text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def word_bpe(path: str, limit: int = CACHE_WORDS) -> WordCache:
    """Ids of the lower-casing word BPE in the tokenizers file at ``path``.

    Words of letters go straight to the library's BPE model, since normalising and cutting leave them as
    they are but for case; every other chunk takes the library's full path.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenize = tokenizer.model.tokenize
    special = SPECIAL.encode()
    marked = regex.compile(rb"(.*[A-Za-z0-9\x80-\xff])([!-/:-@\[-`{-~]+)", regex.DOTALL).fullmatch
    letter_bytes = _byte_letters()
    letters = regex.compile(r"\p{L}+").fullmatch
    ends_in_word = regex.compile(r"[\p{L}\p{N}]").match
    marks: dict[bytes, bytes] = {}

    def packed(ids: list[int]) -> bytes:
        found = array("I", ids)  # four bytes wherever Spark runs
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def word(piece: str) -> bytes:
        """Ids of one word that is lower case already, each byte as its letter."""
        return packed([t.id for t in tokenize(piece)])

    def encode(chunk: bytes) -> bytes:
        if chunk.isalpha():
            return word(chunk.lower().decode())
        text = chunk.decode("utf-8", "replace")
        if letters(text):
            lower = "".join(map(str.lower, unicodedata.normalize("NFC", text)))
            if letters(lower):
                return word(lower.encode().decode("latin-1").translate(letter_bytes))
        # Punctuation after a word is a word of its own, and the word before it may be known.
        elif special not in chunk and (cut := marked(chunk)) is not None:
            stem, mark = cut.groups()
            if ends_in_word(stem.decode("utf-8", "replace")[-1]):
                if (after := marks.get(mark)) is None:
                    if len(marks) >= limit:
                        marks.clear()
                    after = marks[mark] = word(mark.decode())
                if (before := cache.known(stem)) is None:
                    before = encode(stem)
                    cache.keep(stem, before)
                return before + after
        return packed(tokenizer.encode(text, add_special_tokens=False).ids)

    cache = WordCache(encode, limit, any_case=True)
    return cache


def byte_bpe(path: str, pattern: str, limit: int = CACHE_WORDS) -> WordCache:
    """Ids of the byte-level BPE ranks at ``path``; each chunk is encoded with one space before it.

    The ids of a text determine its chunks, so probabilities over ids are probabilities of texts.
    """
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encode_text = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    opens = np.zeros(max(ranks.values(), default=0) + 1, bool)  # ids that begin with a space
    for word, number in ranks.items():
        opens[number] = word.startswith(b" ")

    def encode(chunk: bytes) -> bytes:
        return np.array(encode_text(" " + chunk.decode("utf-8", "replace")), np.uint32).tobytes()

    def encode_many(chunks: list[bytes]) -> list[bytes]:
        if not chunks:
            return []
        text = " " + b" ".join(chunks).decode("utf-8", "replace")
        ids = np.array(encode_text(text), np.uint32)
        starts = np.flatnonzero(opens[ids])
        # Without other blanks inside, every chunk begins with the one id that holds its space.
        if len(text.split()) != len(chunks) or len(starts) != len(chunks) or starts[0]:
            return list(map(encode, chunks))
        data, cuts = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    return WordCache(encode, limit, encode_many=encode_many)


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
