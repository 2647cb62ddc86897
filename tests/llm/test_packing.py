import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from lodestone.llm import packing, subwords

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "don't stop we'll 'tis I'VE",
    "ÉÀ É Straße ǅ İstanbul ΑΣ ΣΑΣ.",
    "a b c\x1cd \u0085x",
    "①²³ 123 4a5b",
    "é café, ́abc",
    "नमस्ते 你好，世界! 🎉",
    'heat### a.%%% "q" (x)',
    "x<|endoftext|>y",
]


def test_cached_ids_equal_the_library():
    library, cache = Tokenizer.from_file(PATH), subwords.word_bpe(PATH, limit=3)
    for text in [*ODD, "", " \n"]:
        ids = cache.ids_of(text.encode())
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(text, add_special_tokens=False).ids


def slow_first_fit(sizes, capacity):
    bins, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, used in enumerate(bins) if used + sizes[i] <= capacity), len(bins))
        if b == len(bins):
            bins.append(0)
        out[i] = (b, bins[b])
        bins[b] += sizes[i]
    return out


def test_tournament_tree_equals_a_scan_of_all_bins():
    rng = random.Random(5)
    for n in (0, 1, 2, 7, 64, 300):
        sizes = [rng.randint(1, 50) for _ in range(n)]
        bins, offsets = packing.first_fit_decreasing(sizes, 50)
        assert list(zip(bins, offsets)) == slow_first_fit(sizes, 50)


def test_round_trip(spark, docs_of):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(ODD, k=rng.randrange(12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "x y"), (102, "long " * 5000), (5, "again"), (5, "again")]
    library = Tokenizer.from_file(PATH)
    found = packing.pack_documents(docs_of(rows).repartition(3), PATH, sequence=64, group_pieces=40).collect()
    by_row, used = defaultdict(list), defaultdict(list)
    for r in found:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_row[r.row].append(r)
        used[r.sequence_id].append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    texts = []
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r.start)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:n]) for n in range(len(pieces))]
        ids = b"".join(p.ids for p in pieces)
        assert len(ids) == 4 * pieces[0].doc_tokens
        texts.append((str(pieces[0].doc_id), struct.unpack(f"<{len(ids) // 4}I", ids)))
    expected = [
        (str(i), (*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID)) for i, t in rows
    ]
    assert sorted(texts) == sorted(expected)
    assert sum(r.length for r in found) / (64 * len(used)) > 0.9
    assert packing.pack_documents(docs_of(rows).where("false"), PATH).count() == 0
