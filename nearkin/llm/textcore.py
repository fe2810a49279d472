"""Column-at-a-time text kernels on raw UTF-8 buffers, shared by the operators of this subpackage.

All kernels take whole Arrow string columns, treat null as the empty text and work on slices of bounded bytes, so the
memory of a task depends on the slice size and the longest single text, never on the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.operators.dealing import HOT_KEYS, dealt_join, hot_of, shared_folder
from nearkin.operators.dealing import settled as reliable

__all__ = ["HOT_KEYS", "dealt_join", "hot_of", "reliable", "shared_folder"]

U64 = np.uint64
#: Text bytes that a kernel works on at once; one longer text makes a larger slice of its own.
SLICE_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded rows and bytes for the Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


#: Least and most bits of a filter (8 MB at most), its bits for each hash, and the bits that are asked for a hash.
FILTER_LEAST, FILTER_MOST, _SPARSE, _PROBES = 1 << 20, 1 << 26, 32, 4


def _filter_slots(hashes: np.ndarray, probe: int, slots: int) -> np.ndarray:
    return (mix(hashes + U64(probe)) & U64(slots - 1)).astype(np.int64)


def hash_filter(rows: DataFrame, column: str):
    """A broadcast Bloom filter that a column's hashes and few others pass, or None without hashes. Its bits are set and
    merged by tasks; the driver gets its words only, 16 MB at most however many hashes there are. Beyond two million hashes more
    others pass, up to all: what follows must join exactly, and then only moves more rows."""
    hashes = rows.select(F.col(column).cast("long").alias("h")).where("h is not null").distinct()
    n = hashes.count()
    if not n:
        return None
    slots = min(FILTER_MOST, max(FILTER_LEAST, 1 << (_SPARSE * n - 1).bit_length()))

    def cells(batches):
        for b in batches:
            h = b.column(0).to_numpy().view(U64)
            at = np.unique(np.concatenate([_filter_slots(h, p, slots) for p in range(_PROBES)]))
            cell, first = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(U64(1) << (at & 63).astype(U64), first) if len(first) else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(bits.view(np.int64))], names=["cell", "bits"])

    got = hashes.mapInArrow(cells, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(slots >> 6, np.int64)
    words[got["cell"].to_numpy()] = got["bits"].to_numpy()
    return rows.sparkSession.sparkContext.broadcast(words.tobytes())


def passing(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which hashes pass a filter."""
    words, out = np.frombuffer(bits, U64), np.zeros(len(hashes), bool)
    left = np.arange(len(hashes))
    for probe in range(_PROBES):
        at = _filter_slots(hashes[left], probe, 64 * len(words))
        left = left[(words[at >> 6] >> (at & 63).astype(U64) & U64(1)).astype(bool)]
    out[left] = True
    return out


def free_finished(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are checkpointed: its cleaner acts when the JVM collects. py4j
    tells the JVM only once a second what Python has let go of, so what waits there is told before. One collection was seen to
    leave the last step's files, a second one none."""
    import gc

    waiting = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", ())
    for _ in range(2):
        gc.collect()
        for _ in range(len(waiting)):
            try:
                client, target = waiting.pop()
            except IndexError:  # py4j's own thread was faster
                break
            client.garbage_collect_object(target, False)
        spark.sparkContext._jvm.System.gc()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words with full avalanche."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2^64
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, grown on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, at = len(column), column.offset
    buffers = column.buffers()
    if n == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """(first, last) row ranges of at most `limit` bytes each, or of one row."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def word_table(kind: str) -> np.ndarray:
    """Which bytes belong to words: 'space' splits at ASCII white space, 'line' at line feeds, 'alnum' keeps 0-9, a-z and
    bytes from 0x80."""
    table = np.zeros(256, bool)
    if kind == "line":
        table[:] = True
        table[0x0A] = False
        return table
    if kind == "space":
        table[:] = True
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


TABLES = {k: word_table(k) for k in ("space", "alnum", "line")}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class Words:
    """Words of a slice of texts: start and end bytes, 64-bit hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: str = "space", lower: bool = False):
        data = lower_ascii(data) if lower else data
        inside = TABLES[kind][data]
        n = len(data)
        begins = inside.copy()
        ends = inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            borders = offsets[1:-1]
            at = borders[borders < n]
            begins[at] = inside[at]
            before = borders[borders > 0] - 1
            ends[before] = inside[before]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.data = data
        self._total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[data] * _power(_BASE, n), out=self._total[1:])
        self.hash = self.hashes(self.start, self.end)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of stretches of bytes, alike wherever they stand."""
        return mix((self._total[end] - self._total[start]) * _power(_INV, len(self.data) + 1)[start])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def roll(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of the k consecutive values from each position on; positions near the end have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    factor = U64((0x9E3779B97F4A7C15 + 2 * salt * 0xC2B2AE3D27D4EB4F) % (1 << 64) | 1)
    total = np.full(n, U64(k + 1 + salt))
    for j in range(k):
        total = total * factor + words[j : j + n]
    return mix(total)


def runs(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the values begin[i] .. end[i] - 1: equal runs have equal hashes, wherever they stand."""
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * _power(_BASE, len(words)), out=total[1:])
    return mix((total[end] - total[begin]) * _power(_INV, len(words) + 1)[begin] + (end - begin).astype(U64))


def starts_within(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all k-word windows that stay inside one text, and each text's number of them."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    return spread(first[:-1], counts), counts


def spread(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin[i], begin[i]+1, ... counts[i] of them, for each i in turn."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(begin - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(total)
