"""Media columns: payloads stored losslessly as PNG in binary columns, and cosine-transform hashes of them.

Writing and reading back are this module's own: chunks with CRC-32, one zlib stream over the IDAT
chunks, and the five scanline filters undone by numpy. The hash is of the image's low frequencies:
the samples averaged to 32 x 32, an orthonormal cosine transform, and the signs of its lowest 8 x 8
coefficients (without the constant one) about their median. The images are written to a table in a first job; a second one reads that
table and computes everything else from the stored bytes.

Defined cases: a null text is the empty one; the empty text is 64 zero samples; equal texts give equal
values; very long texts are one tall image in memory of one task, in proportion to that text; a null id is kept; rows that repeat an id
each have their own image; an empty table gives an empty result; other columns are ignored; a damaged file raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches, table, tidied
from tessera.llm.textscan import text_buffers

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SIDE, _LOW = 32, 8
_DCT = np.sqrt(2 / _SIDE) * np.cos(np.pi * (2 * np.arange(_SIDE)[None, :] + 1) * np.arange(_LOW)[:, None] / (2 * _SIDE))
_DCT[0] /= np.sqrt(2)


def pad(data: bytes) -> bytes:
    """``data`` and zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def png_encode(payload: bytes, width: int = WIDTH, level: int = 1, chunk_bytes: int = 1 << 16) -> bytes:
    """8-bit grey PNG of the payload, row by row; each row takes the filter (none, sub, up) with the least sum of magnitudes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    tried = (rows, sub, up)
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(1) for x in tried])
    best = cost.argmin(0)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = best
    for k, x in enumerate(tried):
        lines[best == k, 1:] = x[best == k]
    data = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"".join([_SIGNATURE, _chunk(b"IHDR", head), *(_chunk(b"IDAT", data[i : i + chunk_bytes]) for i in range(0, len(data), chunk_bytes)), _chunk(b"IEND", b"")])


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of one-byte pixels from filtered scanlines (the filter in column 0)."""
    kind, rows = lines[:, 0], lines[:, 1:].copy()
    if kind.max(initial=0) > 4:
        raise ValueError("PNG: unknown filter")
    if (kind >= 3).any():  # average and Paeth need the pixels before them: one row after another
        before = np.zeros(rows.shape[1], np.uint8)
        for r, k in enumerate(kind.tolist()):
            row = rows[r]
            if k == 1:
                row[:] = np.cumsum(row, dtype=np.uint8)
            elif k == 2:
                row += before
            elif k >= 3:
                left = diagonal = 0
                for i, (v, u) in enumerate(zip(row.tolist(), before.tolist())):
                    left = (v + ((left + u) >> 1 if k == 3 else _paeth(left, u, diagonal))) & 255
                    row[i], diagonal = left, u
            before = row
        return rows
    sub = kind == 1
    rows[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    start = kind != 2  # rows that need none above them; the rows "up" below one of them add up from it
    start[:1] = True
    sums = np.cumsum(rows, axis=0, dtype=np.uint8)
    of = np.maximum.accumulate(np.where(start, np.arange(len(rows)), 0))
    above = np.where((of > 0)[:, None], sums[of - 1], np.uint8(0))
    return sums - above


def png_decode(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey, not interlaced PNG; checks the signature, every CRC, the order and the lengths."""
    if data[:8] != _SIGNATURE:
        raise ValueError("PNG: bad signature")
    at, head, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("PNG: cut short")
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(data) or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("PNG: bad chunk")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError("PNG: unknown critical chunk")
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("PNG: no end, no header or not 8-bit grey")
    width, height = head[:2]
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"PNG: {e}") from e
    if lines.size != height * (width + 1):
        raise ValueError("PNG: wrong length of samples")
    return unfilter(lines.reshape(height, width + 1))


def cosine_hash(samples: np.ndarray) -> bytes:
    """8 bytes: signs of the lowest 8 x 8 cosine coefficients about their median, row by row."""
    height, width = samples.shape
    wide = samples.reshape(height, _SIDE, width // _SIDE).sum(2, dtype=np.int64) if width % _SIDE == 0 else samples[:, np.arange(_SIDE) * width // _SIDE].astype(np.int64)
    edges = np.arange(_SIDE + 1) * height // _SIDE
    low, count = edges[:-1], np.maximum(1, np.diff(edges))
    tops = np.concatenate([np.zeros((1, _SIDE), np.int64), np.cumsum(wide, axis=0)])
    small = (tops[low + count] - tops[low]) / count[:, None]
    coefficients = np.round(_DCT @ small @ _DCT.T, 6).ravel()
    bits = coefficients > np.median(coefficients[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to (doc_id, n_bytes, media)."""
    for batch in batches:
        offsets, data = text_buffers(batch.column(1))
        ids, lo = batch.column(0), 0
        while lo < batch.num_rows:  # some 4 MB of text at a time
            hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 22), "right")) - 1))
            sizes = np.diff(offsets[lo : hi + 1])
            media = [png_encode(pad(data[offsets[r] : offsets[r + 1]].tobytes())) for r in range(lo, hi)]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
            lo = hi


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n_bytes, media) with the features of the decoded bytes."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        out: list[list] = [[] for _ in kinds]
        for x in batch.column(2):
            media = x.as_py()
            samples = png_decode(media)
            back = samples.tobytes()
            for column, v in zip(out, (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples).hex())):
                column.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, kinds))], names)


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each document's text as a PNG in a binary column, written to the shared folder."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(tidied(_encoded), "doc_id long, n_bytes long, media binary"), "media")


def media_features(stored: DataFrame) -> DataFrame:
    """What is computed from the stored bytes of ``store_media``, read back: damaged ones raise ``ValueError``."""
    small_batches(stored.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(tidied(_features), schema)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and hashes of every document's stored form."""
    return media_features(store_media(table(spark, sf_dir, "documents")))
