"""WARC archives: a writer, and a splittable reader of byte ranges.

*Writer.*  Every record is a gzip member of its own.  Of records with equal payloads of at least
``REVISIT_BYTES`` bytes, that with the smallest page id is a response and the others are revisits that
refer to it.  Rows are written once with their number, digest and size; from then on payloads stay where they
are.  Which digests repeat, and whose row is the response, is found from one small row for each digest and
part of the table, and a writer looks up the digests of the parts it reads, so a page that a third of all
rows share is no burden on any task.  A task writes one archive under a temporary name and renames it when
it is complete, so a repeated task replaces the same archive with the same content.

*Reader.*  Archives are cut into byte ranges, each of them work of its own.  A task looks for the gzip magic in its range and takes a
candidate for a member only if it inflates and its first bytes are a WARC header.  It owns the records
that start inside its range and reads on past the range's end to finish the last one.  After a
record the next candidate is where its member ended.  Payloads are inflated and digested in pieces.

Files are reached through pyarrow's file systems by URI, in the shared folder or wherever archives lie.

Defined cases: a null payload is empty; null urls are empty; a null page id gives a record without a page
id, which sorts after all others; of rows that repeat page id and payload one is the response, the first as
read, and the others are revisits where the payload is large enough; revisits of a response without a page
id refer to null; an empty table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import PART_BITS, column, materialise, new_folder, parts_of, read_part, small_batches, text_bytes

REVISIT_BYTES = 100
#: Reader tasks, at most; each takes an equal share of the ranges.
READERS = 100_000
#: Bytes of a range, and of one read.
RANGE, READ = 8 << 20, 1 << 20
MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1.1\r\n"

RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def record(
    page_id, url, payload: bytes, digest: str, size: int, refers_to, revisit: bool | None = None, name: str | None = None
) -> bytes:
    """One gzip member; revisits carry no payload.  ``name`` tells records of one page id apart."""
    revisit = refers_to is not None if revisit is None else revisit
    kind = "revisit" if revisit else "response"
    body = b"" if revisit else payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, name or f"page:{page_id}")
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(body)}",
        f"X-Payload-Length: {size}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    if refers_to is not None:
        lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = _VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n"
    return pack.compress(head + body + b"\r\n\r\n") + pack.flush()


def _one_line(url: str | None) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")


def _repeats(folder: str, part: int) -> dict[str, tuple[int, int | None]]:
    """Digests of a part that repeat anywhere, with row and page id of their response."""
    found = read_part(folder, part, ["digest", "first_row", "first_page"])
    return {} if found is None else {d: (r, p) for d, r, p in zip(*(c.to_pylist() for c in found.columns))}


def _write(folder: str, repeats: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        number = TaskContext.get().partitionId()
        final, draft = f"{base}/part-{number:06d}.warc.gz", f"{base}/_draft-{uuid.uuid4().hex}"
        out, size = None, 0
        part, responses = None, {}
        for batch in batches:
            for page_id, url, payload, digest, length, row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(draft, compression=None)
                if row >> PART_BITS != part:
                    part = row >> PART_BITS
                    responses = _repeats(repeats, part)
                first = responses.get(digest) if length >= REVISIT_BYTES else None
                revisit = first is not None and first[0] != row
                data = record(
                    page_id, url, payload, digest, length, first[1] if revisit else None, revisit, f"page:{page_id}:{row}"
                )
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            if fs.get_file_info(final).type != pyarrow.fs.FileType.NotFound:
                fs.delete_file(final)
            fs.move(draft, final)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/part-{number:06d}.warc.gz"]), pa.array([size], pa.int64())], names=["archive", "size"]
            )

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``pages`` (page_id, url, html); returns (archive, size)."""
    spark = pages.sparkSession
    small_batches(spark)
    payload = text_bytes("html")
    rows = materialise(
        pages.select(
            column("page_id").cast("long").alias("page_id"),
            F.coalesce(column("url"), F.lit("")).alias("url"),
            payload.alias("payload"),
            F.sha2(payload, 256).alias("digest"),
            F.octet_length(payload).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "warc-rows",
    )
    # One row for each digest and part, so a digest that many rows share is as small as any.
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    local = rows.where(F.col("size") >= REVISIT_BYTES).groupBy(F.shiftright("row", PART_BITS).alias("part"), "digest")
    local = materialise(local.agg(F.min(place).alias("first"), F.count("*").alias("copies")), "warc-digests")
    heads = local.groupBy("digest").agg(F.min("first").alias("first"), F.sum("copies").alias("copies")).where("copies > 1")
    found = local.select("part", "digest").join(heads, "digest")
    found = found.select(
        F.shiftleft("part", PART_BITS).alias("row"), "digest", F.col("first.row").alias("first_row"), F.col("first.page_id").alias("first_page")
    )
    repeats = parts_of(found, "row", "warc-repeats")
    return materialise(
        rows.select("page_id", "url", "payload", "digest", "size", "row").mapInArrow(
            _write(folder, repeats), "archive string, size long"
        ),
        "archives",
    )


class Ranges:
    """Records of an archive that start inside a range of its bytes."""

    def __init__(self, source, start: int, stop: int) -> None:
        self.source, self.start, self.stop = source, start, stop
        self.size = source.size()

    def _read(self, at: int, n: int = READ) -> bytes:
        self.source.seek(at)
        return self.source.read(min(n, max(0, self.size - at)))

    def candidates(self, at: int) -> int | None:
        """The first place of the magic at or after ``at``, if it is inside the range."""
        while at < self.stop:
            block = self._read(at, min(READ, self.stop - at + len(MAGIC) - 1))
            found = block.find(MAGIC)
            if found >= 0:
                return at + found if at + found < self.stop else None
            if len(block) < len(MAGIC):
                return None
            at += len(block) - len(MAGIC) + 1
        return None

    def records(self) -> Iterator[tuple[int, dict[str, str], str, int]]:
        """(offset, header fields, digest and length of the block) of each record."""
        at = self.start
        while (at := self.candidates(at)) is not None:
            read = self._member(at)
            if read is None:
                at += 1
            else:
                offset, at = at, read[0]
                yield (offset, *read[1:])

    def _member(self, at: int):
        """(end, fields, digest, length) of the member at ``at``, or None if it is no record."""
        unpack = zlib.decompressobj(31)
        head, fields, digest = b"", None, hashlib.sha256()
        length = left = 0
        place, step = at, 4096  # most false candidates fail within their first bytes
        try:
            while not unpack.eof:
                block = self._read(place, step)
                if not block:
                    return None
                place, step = place + len(block), READ
                data = unpack.decompress(block, READ)
                while True:
                    if fields is None:
                        head += data
                        data = b""
                        if not head.startswith(_VERSION[: len(head)]):
                            return None
                        if (end := head.find(b"\r\n\r\n")) >= 0:
                            fields = _fields(head[:end])
                            if fields is None:
                                return None
                            left = length = int(fields["content-length"])
                            data = head[end + 4 :]
                    if fields is not None and left:
                        digest.update(data[:left])
                        left -= min(left, len(data))
                    if not unpack.unconsumed_tail:
                        break
                    data = unpack.decompress(unpack.unconsumed_tail, READ)
        except (zlib.error, ValueError, KeyError):
            return None
        if fields is None or left:
            return None
        return place - len(unpack.unused_data), fields, digest.hexdigest(), length


def _fields(head: bytes) -> dict[str, str] | None:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    pairs = [line.split(": ", 1) for line in lines]
    if any(len(p) != 2 for p in pairs):
        return None
    fields = {k.lower(): v for k, v in pairs}
    return fields if {"warc-type", "warc-record-id", "content-length"} <= fields.keys() else None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
            fs, path = pyarrow.fs.FileSystem.from_uri(archive)
            rows = []
            with fs.open_input_file(path) as source:
                for offset, fields, digest, length in Ranges(source, start, stop).records():
                    response = fields["warc-type"] == "response"
                    named = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    if response and named and named != digest:
                        raise ValueError(f"{archive} at {offset}: the payload does not match its digest")
                    refers = fields.get("x-refers-to-page-id")
                    page = fields.get("x-page-id")
                    rows.append(
                        (
                            None if page is None else int(page),
                            fields.get("warc-target-uri"),
                            length if response else int(fields.get("x-payload-length", length)),
                            digest if response else named,
                            fields["warc-type"],
                            None if refers is None else int(refers),
                            archive,
                            offset,
                        )
                    )
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [field.split()[0] for field in RECORDS.split(", ")]
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def read_archives(spark: SparkSession, archives: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """Every record of ``archives`` (archive, size): page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, archive, offset."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))
    cut = archives.where("size > 0")
    n = cut.agg(F.coalesce(F.sum(F.ceil(F.col("size") / F.lit(range_bytes))), F.lit(0))).first()[0]
    ranges = cut.select("archive", "size", F.explode(starts).alias("start"))
    ranges = ranges.select("archive", "start", F.least(F.col("start") + range_bytes, "size").alias("stop"))
    # Ranges are a few bytes each; a stated number of tasks keeps them from being put together again.
    return ranges.repartition(max(1, min(n, READERS))).mapInArrow(_scan, RECORDS)


def round_trip(pages: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, new_folder(spark, "warc")), range_bytes)
