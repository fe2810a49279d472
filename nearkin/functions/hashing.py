"""128-bit hashes as two BIGINT columns: distance, text forms, and hashes of texts, vectors and images."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hamming(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    """Number of bits in which two hashes differ."""
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def to_hex(hi: Column, lo: Column) -> Column:
    """32 hex digits, highest first: sorts like the unsigned number."""
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def to_base64(hi: Column, lo: Column) -> Column:
    """Standard alphabet without padding, of the bytes from the lowest on."""
    digits = to_hex(hi, lo)
    swapped = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(15, -1, -1)])
    return F.rtrim(F.base64(F.unhex(swapped)), F.lit("="))


def vector_hash(values: Column, step: int = 8) -> tuple[Column, Column]:
    """Of 64 numbers: hi has the signs, lo whether each is above the one `step` places on."""
    index = F.sequence(F.lit(0), F.lit(63))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    bit = lambda test, i: F.when(test(i), F.call_function("shiftleft", one, i)).otherwise(zero)
    pack = lambda test: F.aggregate(index, zero, lambda acc, i: acc.bitwiseOR(bit(test, i)))
    at = lambda i: F.element_at(values, i.cast("int") + 1)
    return pack(lambda i: at(i) > 0), pack(lambda i: at(i) > at((i + step) % 64))


#: Token digests that a task remembers, and tokens that are summed up at once.
_REMEMBERED, _AT_ONCE = 200_000, 1 << 16


def _text_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct token is digested once as long as it is remembered; a batch's bits are summed in numpy."""
    known: dict[str, bytes] = {}
    for b in batches:
        ids, own = [], []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            tokens = set((text or "").lower().split(" "))
            tokens.discard("")
            if tokens:
                ids.append(key)
                own.append(tokens)
        his, los = [], []
        first = 0
        while first < len(own):
            last, size = first, 0
            while last < len(own) and (last == first or size + len(own[last]) <= _AT_ONCE):
                size += len(own[last])
                last += 1
            if len(known) > _REMEMBERED:
                known.clear()
            for tokens in own[first:last]:
                for t in tokens:
                    if t not in known:
                        known[t] = hashlib.md5(t.encode()).digest()
            digests = np.frombuffer(b"".join([known[t] for tokens in own[first:last] for t in tokens]), np.uint8).reshape(-1, 16)
            n = np.array([len(t) for t in own[first:last]])
            ones = np.add.reduceat(np.unpackbits(digests, axis=1), np.cumsum(n) - n, axis=0, dtype=np.int32)
            packed = np.packbits(2 * ones > n[:, None], axis=1).view(">i8")
            his.append(packed[:, 0])
            los.append(packed[:, 1])
            first = last
        halves = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)) for x in (his, los)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *halves], names=["id", "hi", "lo"])


def text_hash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hi, lo): SimHash of each text's distinct tokens, split at spaces and lower-cased, over their MD5 bits. A bit is
    set where more than half of the tokens have it. Texts without tokens give no row. Nothing is shuffled."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(_text_bits, "id long, hi long, lo long")


# Image hash ----------------------------------------------------------------------------------------------------------
HASH_WIDTH, HASH_HEIGHT = 16, 8


@lru_cache(maxsize=8)
def _cosines(n: int) -> np.ndarray:
    k, x = np.mgrid[0:n, 0:n]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


@lru_cache(maxsize=64)
def _shares(size: int, cells: int) -> np.ndarray:
    """Weights (cells x size) that average a line of `size` values into `cells` stretches of equal length."""
    edge = np.linspace(0, size, cells + 1)
    low = np.maximum(edge[:-1, None], np.arange(size)[None, :])
    high = np.minimum(edge[1:, None], np.arange(size)[None, :] + 1)
    return np.maximum(high - low, 0) * cells / size


def image_hash(grey: np.ndarray) -> tuple[int, int]:
    """Halves of the 128-bit gradient hash of a grey image (height x width): the image is averaged to twice the hash's size,
    its low cosine frequencies are taken, and each bit says whether a coefficient is above the one over it. An image
    without pixels has hash 0."""
    if not grey.size:
        return 0, 0
    rows, columns = 2 * (HASH_HEIGHT + 1), 2 * HASH_WIDTH
    small = _shares(grey.shape[0], rows) @ grey.astype(float) @ _shares(grey.shape[1], columns).T
    low = (_cosines(rows) @ small @ _cosines(columns).T)[: HASH_HEIGHT + 1, :HASH_WIDTH]
    low = np.round(low, 6)
    packed = np.packbits(low[1:] > low[:-1]).tobytes()
    return int.from_bytes(packed[:8], "big", signed=True), int.from_bytes(packed[8:], "big", signed=True)


def difference_hash(grey: np.ndarray) -> int:
    """The older 64-bit hash: each bit says whether one of 9 x 8 averages is below its right neighbour."""
    if not grey.size:
        return 0
    small = np.round(_shares(grey.shape[0], 8) @ grey.astype(float) @ _shares(grey.shape[1], 9).T, 6)
    return int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1]).tobytes(), "big", signed=True)
