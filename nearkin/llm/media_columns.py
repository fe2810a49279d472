"""Media columns: texts as lossless WebP, written, read back and described.

A text's UTF-8 bytes, filled up with zeros to a positive multiple of 64, are the 8-bit samples of a grey image 64 pixels
wide. An image ends after 64 rows, so a longer payload is stored as several WebP files one after another: a task decodes
all images of a slice side by side, and a very long text is many images like those of short ones. `read_media` decodes
the stored bytes, checks that the pixels are grey and opaque, and describes what it has read.

The feature string is ``count:sum:sum of squares:distinct values:sum of steps`` of the samples read, steps being the
absolute differences of neighbours.

Defined cases: a null or empty text is 64 zeros; equal texts get equal bytes; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.textcore import bounded_batches, slices, spread, utf8
from nearkin.llm.webp import chunks_of, read_many, write_strips

WIDTH, ROWS = 64, 64
STRIP = WIDTH * ROWS
MEDIA = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's bytes with zeros up to a positive multiple of 64, and the borders between them."""
    size = np.diff(offsets)
    full = np.maximum(-(-size // WIDTH), 1) * WIDTH
    edge = np.zeros(len(full) + 1, np.int64)
    np.cumsum(full, out=edge[1:])
    out = np.zeros(int(edge[-1]), np.uint8)
    out[spread(edge[:-1], size)] = data
    return out, edge


def encode_texts(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The stored form of each text."""
    samples, edge = payloads(data, offsets)
    strips = -(-np.diff(edge) // STRIP)
    first = np.cumsum(strips) - strips
    begin = edge[:-1].repeat(strips) + (np.arange(int(strips.sum())) - first.repeat(strips)) * STRIP
    files = write_strips(samples, np.append(begin, edge[-1]), WIDTH)
    return [b"".join(files[f : f + n]) for f, n in zip(first.tolist(), strips.tolist(), strict=True)]


def decode_media(media: list[bytes]) -> list[np.ndarray]:
    """The samples of each stored form."""
    chunks = [chunks_of(m) for m in media]
    images = iter(read_many([c for own in chunks for c in own]))
    out = []
    for own in chunks:
        pixels = np.concatenate([next(images).ravel() for _ in own])
        samples = pixels >> 8 & 255
        if (pixels != np.uint32(0xFF000000) | samples << 16 | samples << 8 | samples).any():
            raise ValueError("the image is not grey")
        out.append(samples.astype(np.uint8))
    return out


def feature(samples: np.ndarray) -> str:
    x = samples.astype(np.int64)
    return f"{len(x)}:{x.sum()}:{(x * x).sum()}:{np.count_nonzero(np.bincount(samples, minlength=256))}:{np.abs(np.diff(x)).sum()}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = utf8(b.column(1))
        for first, last in slices(offsets, 4 << 20):
            base = offsets[first : last + 1]
            media = encode_texts(data[base[0] : base[-1]], base - base[0])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(np.diff(base)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = READ.replace(" long", "").replace(" string", "").split(", ")
    for b in batches:
        _, offsets = utf8(b.column("media").cast(pa.binary()))
        for first, last in slices(offsets, 4 << 20):
            part = b.slice(first, last - first)
            media = part.column("media").to_pylist()
            found = [s.tobytes() for s in decode_media(media)]
            columns = [
                pa.array([len(p) for p in found], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in found], pa.string()),
                pa.array([zlib.crc32(p[-64:]) for p in found], pa.int64()),
                pa.array([len(m) for m in media], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                pa.array([feature(np.frombuffer(p, np.uint8)) for p in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names=names)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) with each whole text as lossless WebP."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_store, MEDIA)


def read_media(stored: DataFrame) -> DataFrame:
    """Sizes, digests and features of what the stored bytes decode to."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_describe, READ)


def pixel_arrays(stored: DataFrame) -> DataFrame:
    """(doc_id, width, height, pixels): the decoded samples as rows of pixels, one byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [s.tobytes() for s in decode_media(b.column("media").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([WIDTH] * len(found), pa.int32()), pa.array([len(p) // WIDTH for p in found], pa.int32()), pa.array(found, pa.binary())], names=["doc_id", "width", "height", "pixels"])

    return stored.select("doc_id", "media").mapInArrow(run, "doc_id long, width int, height int, pixels binary")
