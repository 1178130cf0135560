"""WARC writer and reader with Zstandard dictionaries (operator 2).

An archive is one ``.zst`` stream of independent frames:

* a leading skippable frame (magic ``0x184D2A5D``) that holds a dictionary
  trained on records of the same archive (raw; empty when there are too few
  records to train on);
* one frame per WARC record, compressed on its own with that dictionary, so any
  record can be read alone;
* between frames an empty skippable frame (magic ``0x184D2A50``, size 0), which
  Zstandard readers pass over.

That separator is what lets Spark write the archives: each frame is one row of a
text table whose line separator is the eight separator bytes, partitioned by archive.  The files go
through Spark's committer to whatever store the path names, a lost task is
simply run again, and no executor needs a file system of its own.  A task holds
the records the dictionary is trained on (``SAMPLE_BYTES`` at most) and then one
record at a time.  An archive is one task's rows; tasks are sized by the shuffle.

The first record of a payload is a ``response``; others with an equal payload of
at least ``REVISIT_BYTES`` bytes are ``revisit`` records that refer to it and
hold no payload.  "First" is the smallest ``page_id``.

Defined cases: a null html is an empty payload.  Rows repeated under the smallest
page_id of a payload are all responses.  A null ``page_id`` never comes first
while another has an id; if none has, all are responses.  A null ``url`` is
written without a target and read back as null.  Extra columns are ignored.  An
empty table gives archives without records.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_BYTES = 100
DICTIONARY_MAGIC = 0x184D2A5D
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("latin-1")
SAMPLE_BYTES = 4_000_000
SAMPLE_RECORD_BYTES = 64_000
DICTIONARY_BYTES = 64_000
LEVEL = 3
ARCHIVE_BYTES = 128_000_000  # of uncompressed records

RECORD_SCHEMA = ("page_id {}, url string, payload_bytes bigint, payload_digest string, "
                 "record_type string, refers_to {}, payload binary")


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select("page_id", "url", payload.alias("payload"))
    p = p.withColumn("payload_digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= REVISIT_BYTES
    shared = (p.where(large).groupBy("payload_digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1"))
    p = p.join(shared.select("payload_digest", "first"), "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.select("page_id", "url", "payload", "payload_digest",
                    F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                    F.when(revisit, F.col("first")).alias("refers_to"))


def record_bytes(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has the headers of its payload but no body."""
    head = ["WARC/1.1", f"WARC-Type: {kind}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + url.encode("unicode_escape").decode())
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    head.append(f"X-Payload-Length: {len(payload)}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[:int(fields["Content-Length"])]
    if rest[len(body):] != b"\r\n\r\n":
        raise ValueError("a WARC record ends early")
    number = lambda k: int(fields[k].removeprefix("<urn:page:").removesuffix(">")) if k in fields else None
    kind = fields["WARC-Type"]
    url = fields.get("WARC-Target-URI")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
        raise ValueError(f"payload of record {number('WARC-Record-ID')} does not match its digest")
    return {"page_id": number("WARC-Record-ID"),
            "url": None if url is None else url.encode().decode("unicode_escape"),
            "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest,
            "record_type": kind, "refers_to": number("WARC-Refers-To"),
            "payload": body if kind == "response" else None}


def train_dictionary(sample: list[bytes]) -> bytes:
    """A dictionary over the sample, or nothing if it is too small to train on."""
    cut = [r[:SAMPLE_RECORD_BYTES] for r in sample]
    size = min(DICTIONARY_BYTES, sum(map(len, cut)) // 8)
    if len(cut) < 8 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, cut).as_bytes()
    except zstandard.ZstdError:  # too uniform to gain from a dictionary
        return b""


def archive_frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one archive: the dictionary, then each record."""
    sample, held = [], 0
    for r in records:
        sample.append(r)
        held += len(r)
        if held >= SAMPLE_BYTES:
            break
    if not sample:
        return
    data = train_dictionary(sample)
    yield struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data
    d = zstandard.ZstdCompressionDict(data) if data else None
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True, write_checksum=True)
    for r in chain(sample, records):
        yield packer.compress(r)


def rolled(records: Iterator[bytes], archive_bytes: int = ARCHIVE_BYTES) -> Iterator[tuple[int, int, bytes]]:
    """(archive, place within it, frame) of the archives that the records fill."""
    records = iter(records)

    def filling(first: bytes) -> Iterator[bytes]:
        held = len(first)
        yield first
        while held < archive_bytes and (r := next(records, None)) is not None:
            held += len(r)
            yield r

    for archive, first in enumerate(records):
        for place, frame in enumerate(archive_frames(filling(first))):
            yield archive, place, frame


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of one archive, decompressed one at a time."""
    view, at, unpack = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if magic == DICTIONARY_MAGIC and size:
                d = zstandard.ZstdCompressionDict(bytes(view[at + 8:at + 8 + size]))
                unpack = zstandard.ZstdDecompressor(dict_data=d)
            at += 8 + size
            continue
        one = unpack.decompressobj()
        yield one.decompress(view[at:])
        at = len(view) - len(one.unused_data)


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) below ``path``: a
    file per task and archive, in folders by the archive's number within its task."""
    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                cols = [b.column(c) for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")]
                for row in zip(*cols):
                    yield record_bytes(*(x.as_py() for x in row))

        def batch():
            kinds = (pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["archive", "place", "frame"])

        out, held = [], 0
        for row in rolled(records(), archive_bytes):
            out.append(row)
            held += len(row[2])
            if held >= 1_000_000:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()

    rows = with_record_types(pages).mapInArrow(frames, "archive int, place bigint, frame binary")
    # the writer keeps this order, so a dictionary stays before its records
    rows = rows.sortWithinPartitions("archive", "place")
    (rows.select("archive", F.col("frame").cast("string")).write.partitionBy("archive")
     .option("lineSep", SEPARATOR).text(path))


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """One row per record; ``payload`` is null for revisits."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                out, held = [], 0
                for record in read_archive(content.as_py()):
                    out.append(parse_record(record))
                    held += len(record)
                    if held >= 4_000_000:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("payload", pa.binary())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(parse, RECORD_SCHEMA.format("bigint", "bigint"))


def archive_round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write the pages, read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to."""
    write_archives(pages, path)
    back = read_archives(pages.sparkSession, path)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle_sql() -> str:
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
SELECT page_id, n::bigint AS payload_bytes, d AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f"""
