"""WARC archives in Zstandard with a dictionary, written and read back.

An archive is a skippable frame that holds the dictionary, then one frame per record, so that each record can be
decoded alone. Archives are rows (archive, path-independent binary ``content``) of a table: Spark's own writers put them into
the shared folder whatever store that is, and commit them once. ``read_archives`` takes any frame with a ``content``
column, such as ``spark.read.format("binaryFile")`` gives for archive files made elsewhere.

Of records with equal payloads of at least ``LEAST`` bytes the one with the smallest id is a response and the others
revisit it. The digests are shuffled (32 bytes a record), payloads once, to their archives of bounded size.

Defined cases: a null payload is the empty one; records with the same id and payload are all responses or all revisits
of another id; a page larger than an archive's bound is an archive of its own, in memory of one task in proportion to it; other columns are ignored; a null id is written as ``null``, is never referred to, and revisits like any other; an archive with a wrong magic number,
a missing dictionary, headers without their required fields, or wrong lengths or digests raises ``ValueError``;
an empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table

LEAST = 100
_SKIPPABLE = 0x184D2A5D
DICTIONARY_SAMPLE, DICTIONARY_BYTES = 256, 1 << 15
ARCHIVE_BYTES = 8 << 20
_REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def encode_record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit's block is the HTTP header alone, with the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    target = "".join(c for c in url or "" if c >= " ")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def decode_record(record: bytes) -> dict:
    """Fields of one record, validated; ``payload`` is None for a revisit."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise ValueError("WARC: no version line")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    if missing := [k for k in _REQUIRED if k not in fields]:
        raise ValueError(f"WARC: no {missing[0]}")
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("WARC: wrong length")
    http, mark, payload = rest[:length].partition(b"\r\n\r\n")
    lines = http.decode("latin-1").split("\r\n")
    if not mark or not lines[0].startswith("HTTP/"):
        raise ValueError("WARC: no HTTP header")
    size = int(dict(line.split(": ", 1) for line in lines[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("WARC: wrong payload")
    if kind == "revisit" and (payload or "WARC-Refers-To" not in fields):
        raise ValueError("WARC: a revisit with a payload or without its response")
    own, other = (fields.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("WARC-Record-ID", "WARC-Refers-To"))
    return {"page_id": None if own == "null" else int(own), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": int(other) if other else None, "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None}


def dictionary_of(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; raw content where the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size] or b"WARC/1.1\r\n"


class ArchiveWriter:
    """Bytes of one archive."""

    def __init__(self, dictionary: bytes, level: int = 3):
        self.parts = [struct.pack("<II", _SKIPPABLE, len(dictionary)), dictionary]
        self.size = 0
        self.codec = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True)

    def add(self, record: bytes) -> None:
        self.parts.append(self.codec.compress(record))
        self.size += len(self.parts[-1])

    def close(self) -> bytes:
        return b"".join(self.parts)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, from its header and the sizes of its blocks; nothing is decompressed."""
    try:
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic != 0xFD2FB528:
            raise ValueError("WARC: no frame where one should begin")
        else:
            flags = data[at + 4]
            single = flags >> 5 & 1
            end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
            last = 0
            while not last:
                block = data[end] | data[end + 1] << 8 | data[end + 2] << 16
                last = block & 1
                end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)  # a run-length block holds one byte
            end += 4 * (flags >> 2 & 1)
    except (struct.error, IndexError) as e:
        raise ValueError("WARC: frame cut short") from e
    if end > len(data):
        raise ValueError("WARC: frame cut short")
    return end


def read_archive(data: bytes) -> Iterator[dict]:
    """Records of one archive, frame by frame."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != _SKIPPABLE:
        raise ValueError("WARC: no leading dictionary frame")
    n = struct.unpack_from("<I", data, 4)[0]
    if len(data) < 8 + n:
        raise ValueError("WARC: dictionary cut short")
    dictionary = data[8 : 8 + n]
    if dictionary[:4] == b"\x28\xb5\x2f\xfd":  # a dictionary that is compressed itself
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    codec, view, at = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)), memoryview(data), 8 + n
    while at < len(view):
        end = frame_end(view, at)
        frame = codec.decompressobj()
        try:
            record = frame.decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise ValueError(f"WARC: {e}") from e
        if not frame.eof:
            raise ValueError("WARC: frame cut short")
        at = end
        yield decode_record(record)


def write_archives(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as archives: a table of (archive, content) in the shared folder."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = rows.where(F.octet_length("html") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("of"), "first")
    sample = [r[0].encode() for r in rows.select(F.substring("html", 1, 8192)).limit(DICTIONARY_SAMPLE).collect()]  # only the coding ratio depends on it: at most 8192 characters of each of these pages
    dictionary = dictionary_of([encode_record("response", 0, "", x, "0" * 64, None) for x in sample if x])
    chosen = rows.join(first, F.col("digest") == F.col("of"), "left").select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(dictionary)

        def done() -> pa.RecordBatch:
            data = writer.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha256(data).hexdigest()[:16]}.warc.zst"]), pa.array([data], pa.binary())], ["archive", "content"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for page_id, url, html, digest, refers in zip(*columns):
                writer.add(encode_record("response" if refers is None else "revisit", page_id, url, html.encode(), digest, refers))
                if writer.size >= ARCHIVE_BYTES:
                    yield done()
                    writer = ArchiveWriter(dictionary)
        if writer.size:
            yield done()

    return materialize(chosen.mapInArrow(archive, "archive string, content binary"), "warc")


def read_archives(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Every record of every archive in column ``content``, validated."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                held, size = [], 0
                for record in read_archive(data.as_py()):
                    size += len(record["payload"] or b"") if keep_payload else 0
                    held.append(record)
                    if not keep_payload:
                        record["payload"] = None
                    if size > 4 << 20 or len(held) >= 5000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * keep_payload
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))
    return archives.select("content").mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * keep_payload)


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    return read_archives(write_archives(table(spark, sf_dir, "pages")), keep_payload=False).drop("url")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id OR first IS NOT NULL AND page_id IS NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id OR page_id IS NULL THEN first END AS refers_to
FROM f
"""
