import gzip
import hashlib
import random

import pyarrow as pa
import pyarrow.fs
import pytest

from lodestone.llm import warc
from lodestone.llm.shared import new_folder

ROWS = (
    [(i, f"http://a/{i}", random.Random(i).choice(["<p>" + "x" * 200, "short", None, "", "é" * 60, f"page {i} " * 40])) for i in range(80)]
    + [(500, None, "<p>" + "x" * 200), (None, "http://n", "<p>" + "x" * 200), (501, "a b\nc", "q" * 300_000)]
    + [(502, "u1", "z" * 150), (502, "u2", "z" * 150), (502, "u1", "z" * 150), (503, "u2", "z" * 150)]
    + [(None, "n1", "only without ids " * 10), (None, "n1", "only without ids " * 10)]
)


def expected(rows):
    """Of equal payloads of at least 100 bytes one row of the smallest page id is response, all others revisit it."""
    groups = {}
    for page, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    out = []
    for data, pages in groups.items():
        pages.sort(key=lambda p: (p is None, p or 0))
        for nth, page in enumerate(pages):
            revisit = len(data) >= 100 and nth > 0
            kind = "revisit" if revisit else "response"
            out.append((str(page), len(data), hashlib.sha256(data).hexdigest(), kind, str(pages[0] if revisit else None)))
    return sorted(out)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, 1, 2) for r in ROWS], "page_id long, url string, html string, size int, digest int")


@pytest.mark.parametrize("size", [700, 8 << 20])
def test_round_trip(pages, size):
    found = warc.round_trip(pages.repartition(3), size).collect()
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in found]
    assert sorted(got) == expected(ROWS)


def test_ranges_are_read_by_several_tasks(spark, pages):
    archives = warc.write_archives(pages.coalesce(1), new_folder(spark, "warc"))
    ranges = -(-archives.first().size // 700)
    assert warc.read_archives(spark, archives, 700).rdd.getNumPartitions() == ranges > 4


def test_record_names_are_unique(spark, pages):
    archives = warc.write_archives(pages.repartition(2), new_folder(spark, "warc")).collect()
    names = []
    for a in archives:
        fs, path = pyarrow.fs.FileSystem.from_uri(a.archive)
        data = gzip.decompress(fs.open_input_stream(path, compression=None).read())
        names += [x for x in data.split(b"\r\n") if x.startswith(b"WARC-Record-ID")]
    assert len(names) == len(set(names)) == len(ROWS)


def test_payloads_survive_and_members_are_plain_gzip(spark, pages):
    archives = warc.write_archives(pages.coalesce(1), new_folder(spark, "warc")).collect()
    fs, path = pyarrow.fs.FileSystem.from_uri(archives[0].archive)
    data = fs.open_input_stream(path, compression=None).read()
    text = gzip.decompress(data)
    assert len(data) == archives[0].size and text.count(b"WARC/1.1\r\n") == len(ROWS)
    assert ("q" * 300_000).encode() in text


def records_of(data, start, stop):
    return [r[:2] for r in warc.Ranges(pa.BufferReader(data), start, stop).records()]


def test_every_cut_gives_every_record_once():
    rng = random.Random(1)
    members = [warc.record(i, "u", rng.randbytes(rng.randrange(0, 300)) + warc.MAGIC * 3, "d", 1, None) for i in range(20)]
    data = b"".join(members)
    whole = [o for o, _ in records_of(data, 0, len(data))]
    assert whole == [sum(map(len, members[:i])) for i in range(20)]
    for size in (1, 2, 3, 50, 333):
        cut = [o for a in range(0, len(data), size) for o, _ in records_of(data, a, min(a + size, len(data)))]
        assert cut == whole


def test_false_magic_is_not_a_record():
    real = warc.record(1, "u", b"abc", "d", 3, None)
    junk = warc.MAGIC + b"\0" * 30 + gzip.compress(b"no record") + warc.MAGIC
    data = junk + real + junk
    assert [o for o, _ in records_of(data, 0, len(data))] == [len(junk)]


def test_empty(spark, pages):
    assert warc.round_trip(pages.where("false")).count() == 0
