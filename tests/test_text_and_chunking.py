import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions import text as t
from lodestone.operators import chunking


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "x string").select(expression.alias("r")).first().r


@pytest.mark.parametrize(
    "text,expected",
    [("Don't stop_1 ÄB", ["don", "t", "stop_1", "b"]), ("", []), ("\u212a!", [])],
)
def test_tokens(spark, text, expected):
    assert one(spark, t.tokens("x"), text) == expected


def test_text_functions(spark):
    assert one(spark, t.sentences("x"), "One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, t.cells("x"), " a | b,c || ") == ["a", "b", "c"]
    assert one(spark, t.table_line("x"), "A |  B") == "a | b"
    assert one(spark, t.collapse("x"), "  a \t\x1c b\n") == "a b"
    assert one(spark, t.is_header("x"), "Name | Value") and not one(spark, t.is_header("x"), "Name | 10")
    assert not one(spark, t.is_header("x"), "Name")
    assert one(spark, t.hash_index("x", 256), "tok:a") == int(hashlib.sha1(b"tok:a").hexdigest()[:16], 16) % 256
    same = "su_" + hashlib.sha1(b"data/a.txt").hexdigest()[:16]
    assert one(spark, t.source_unit_id("x"), "data//A.txt") == same == one(spark, t.source_unit_id("x"), "data\\./a.txt")
    assert one(spark, t.parse_ts("x"), "nonsense") is None and one(spark, t.parse_ts("x"), "2024-01-01T00:00:00Z")
    assert one(spark, t.grounding_terms("x"), "The value of a 7 row") == ["value", "row"]


def windows(words, size, overlap, least):
    """Windows one after the other, a short one joined to the last chunk."""
    size = max(20, size)
    overlap = min(max(0, overlap), size - 1)
    step = max(1, size - overlap)
    out = []
    for start in range(0, len(words), step):
        part = words[start : start + size]
        if out and len(part) < least:
            out[-1] = (out[-1][0], out[-1][1] + part, start + len(part))
        else:
            out.append((start + 1, part, start + len(part)))
    return out


@pytest.mark.parametrize("size,overlap,least", [(20, 5, 1), (20, 5, 12), (25, 0, 20), (30, 29, 10), (5, 50, 3)])
def test_prose_windows_equal_a_fold(spark, size, overlap, least):
    rng = random.Random(size + overlap)
    rows = [(n, " ".join(f"w{i}" for i in range(rng.randrange(1, 150)))) for n in range(60)]
    units = spark.createDataFrame(rows, "doc_ord long, unit_text string")
    found = chunking.prose_windows(units, size, overlap, least).collect()
    got = sorted((r.doc_ord, r.start_word, r.text_window, r.end_word, r.word_count) for r in found)
    expected = [
        (n, a, " ".join(p), b, len(p)) for n, text in rows for a, p, b in windows(text.split(), size, overlap, least)
    ]
    assert got == sorted(expected)


def test_overlap_is_shared(spark):
    units = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(1, 31)))], "doc_ord long, unit_text string")
    a, b = sorted(chunking.prose_windows(units, 20, 5, 1).collect(), key=lambda r: r.start_word)
    assert a.text_window.split()[-5:] == b.text_window.split()[:5]


def test_cohesion(spark):
    docs = spark.createDataFrame([(0, "s", "alpha beta one. alpha beta two. zebra lion three.")], "doc_ord long, source string, text string")
    units = chunking.prose_units(docs, 0.3).orderBy("unit_index").collect()
    assert [u.unit_text for u in units] == ["alpha beta one. alpha beta two.", "zebra lion three."]
    assert all(u.cohesion_split_applied for u in units) and [u.unit_start for u in units] == [1, 7]


def tables(spark, text, known=None):
    docs = spark.createDataFrame([(0, text, known)], "doc_ord long, text string, known_headers array<string>")
    return chunking.table_sections(docs)


def test_headerless_rows(spark):
    found = chunking.table_windows(tables(spark, "1001 | alpha | open\n1002 | beta | shut"), 1, 0).orderBy("row_start").collect()
    assert [r.row_start for r in found] == [1, 2] and all(r.header is None for r in found)


def test_repeated_headers(spark):
    text = "a note\nName | Value\nx | 1\nname |  value\ny | 2"
    found = chunking.table_windows(tables(spark, text, ["Name | Value"]), 5, 0).orderBy("section_index").collect()
    assert [(r.header_repeat_index, r.header_repeat_count) for r in found] == [(1, 2), (2, 2)]
    assert [r.text_window for r in found] == ["Name | Value\nx | 1", "name |  value\ny | 2"]


def test_sections_of_known_headers_and_their_numbers(spark):
    """Against a plain loop: headers in a row, at the end, of several names, none; and one that recurs twenty thousand times,
    which takes seconds; lines that were compared with all others would take hours."""
    rng, known = random.Random(3), ["A | b", "c,d", "A|B", "x"]
    texts = ["\n".join(rng.choice(["a | B", "C | d", "X ", "1 | 2", "", "row"]) for _ in range(rng.randrange(12))) for _ in range(60)]
    texts.append("\n".join(["a | b", "1 | 2", "3 | 4"] * 20_000))
    docs = spark.createDataFrame([(i, text, known) for i, text in enumerate(texts)], "doc_ord long, text string, known_headers array<string>")
    began = time.perf_counter()
    found = chunking.table_sections(docs.coalesce(1)).where("header_source = 'table_metadata'").drop("text").orderBy("doc_ord", "section_index").collect()
    assert time.perf_counter() - began < 60
    expected = []
    for i, text in enumerate(texts):
        lines = [x.strip() for x in text.split("\n") if x.strip()]
        form = [" | ".join(c.strip() for c in re.split("[|,]", x.lower())) for x in lines]
        starts = [n for n, x in enumerate(form) if x in ("a | b", "c | d", "x")]
        seen, times = Counter(), Counter(form[n] for n in starts)
        for place, (a, b) in enumerate(zip(starts, [*starts[1:], len(lines)])):
            if b > a + 1:
                seen[form[a]] += 1
                expected.append((i, place, lines[a], lines[a + 1 : b], seen[form[a]], times[form[a]], b - a - 1))
    got = [(r.doc_ord, r.section_index, r.header, r.rows, r.header_repeat_index, r.header_repeat_count, r.section_row_count) for r in found]
    assert got == expected and len(got) > 20_020


def test_row_overlap_and_clamp(spark):
    found = chunking.table_windows(tables(spark, "n | v\nr | 1\ns | 2\nt | 3"), 2, 1).orderBy("row_start").collect()
    assert [r.text_window for r in found] == ["n | v\nr | 1\ns | 2", "n | v\ns | 2\nt | 3"]
    clamped = chunking.table_windows(tables(spark, "1 | alpha\n2 | beta"), 1, 5).collect()
    assert len(clamped) == 2 and all(r.overlap_rows == 0 for r in clamped)


def test_tabular_profile(spark):
    assert one(spark, chunking.looks_tabular("x"), "a | b\n1 | 2\n3 | 4")
    assert one(spark, chunking.looks_tabular("x"), "k,1\nm,2\nn,3")
    assert not one(spark, chunking.looks_tabular("x"), "ALICE, who walks in and then speaks at length.\nBOB, her friend from the old town.\nEVE, a stranger to all.")
    assert not one(spark, chunking.looks_tabular("x"), "just one line") and not one(spark, chunking.looks_tabular("x"), "")


def test_document_types(spark):
    def kind(source, text, taxonomy=None, explicit="unknown", method="text_parser"):
        e = chunking.resolved_doc_type(F.lit(explicit), F.lit(source), F.col("x"), F.lit(method), taxonomy)
        return one(spark, e, text)

    assert kind("policy-update.txt", "") == "policy"
    assert kind("a.txt", "philosophy") == "procedure"  # a substring is enough
    assert kind("a.txt", "nothing") == "unknown"
    assert kind("a.txt", "x", explicit=" Memo ") == "memo"
    taxonomy = {"extension_defaults": {".tar": "archive"}, "source_overrides": [{"contains": ["hr/"], "doc_type": "HR"}]}
    assert kind("hr/policy.txt", "x", taxonomy) == "hr" and kind("b.tar.gz", "x", taxonomy) == "archive"
    assert kind("b.doc", "policy bjbj HYPERLINK", method="doc_legacy_parser") == "unknown"


def test_first_by_content(spark):
    docs = spark.createDataFrame([(2, "a "), (1, "a"), (3, " "), (4, "b")], "doc_ord long, text string")
    assert sorted(r.doc_ord for r in chunking.first_by_content(docs).collect()) == [1, 4]


def test_cohesion_of_a_long_paragraph_is_linear():
    """Twenty thousand sentences in one unit take seconds; a fold that cut the unit again in each step would take hours."""
    rng = random.Random(1)
    sentences = [f"Anchor word{rng.randrange(5000)} word{rng.randrange(5000)} s{i}." for i in range(20_000)]
    began = time.perf_counter()
    units = chunking.cohesive_runs(sentences, 1e-9)
    assert time.perf_counter() - began < 10 and units == [" ".join(sentences)]
    assert chunking.cohesive_runs(["a b.", "b c.", "x.", "...", "x."], 0.3) == ["a b. b c.", "x.", "...", "x."]


def _plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_documents_are_cut_where_they_lie(spark):
    """Chunks equal the windows of the units, without moving a text to number them."""
    texts = ["", " \u2003 ", "one", "a b\n \x0b\nc d e\n\n\n", "\x1cx\u00a0y\u3000z. New\n\none? two! three", " ".join(f"w{i}" for i in range(403)) + "\n\n" + " ".join("\u00e9" * 5 for _ in range(77))]
    docs = spark.createDataFrame([(i, f"s/{i}.txt", x, str(i)) for i, x in enumerate(texts)], "doc_ord long, source string, text string, content_fingerprint string").coalesce(1)
    places = ["start_word", "end_word", "word_count", "unit_start", "unit_end", "cohesion_split_applied"]
    for settings in (Settings(), Settings(chunk_size=20, overlap=5, min_chunk_words=9), Settings(cohesion_threshold=0.2)):
        found = chunking.prose_chunks(docs, settings)
        assert "Exchange" not in _plan(found)
        units = chunking.prose_units(docs, settings.cohesion_threshold).drop("text")
        rows = chunking.prose_windows(units, settings.chunk_size, settings.overlap, settings.min_chunk_words).collect()
        rows.sort(key=lambda r: (r.doc_ord, r.unit_index, r.window))
        counts = Counter()
        expected = []
        for r in rows:
            expected.append((r.doc_ord, counts[r.doc_ord], r.text_window, *[r[c] for c in places], r.start_word + r.unit_start - 1))
            counts[r.doc_ord] += 1
        got = [(r.doc_ord, r.chunk_index, r.text, *[r[c] for c in places], r.absolute_start_word) for r in found.collect()]
        assert sorted(got) == expected and len(got) >= 5


def test_texts_are_stripped_without_a_pattern(spark):
    """Of the blanks of Unicode, at both ends and no others."""
    blanks = "".join(c for c in map(chr, range(0x3100)) if c.isspace())
    assert set(t.BLANKS) == set(blanks)
    rows = spark.createDataFrame([(blanks + "\u200ba" + blanks + "b\u00e9" + blanks,), (blanks,), ("",), (None,)], "text string")
    found = rows.select("text", t.strip("text").alias("s"))
    assert [r.s for r in found.collect()] == [r.text and r.text.strip() for r in rows.collect()] and "regexp" not in _plan(found)


def test_lines_are_cut_by_search_where_no_rare_end_is(spark):
    ends = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
    texts = [c.join(["a", " b ", "", "c"]) for c in ends] + ["a\r\nb\nc", "a\n\n b\nc \n", "c"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    found = {r.text: r.got for r in rows.select("text", t.lines("text").alias("got")).collect()}
    assert found == {x: [y.strip() for y in x.splitlines() if y.strip()] for x in texts}
    plan = rows.select(t.lines("text").alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(text") == 2  # the plain end of line has a cut of its own
