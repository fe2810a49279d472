"""MinHash near-dedup with HyperMinHash registers.

A document's set holds its distinct shingles of `k` (5) words, as 64-bit hashes. Its sketch has 128 buckets, chosen by a
hash's first 7 bits; a register keeps of the bucket's smallest hash the number of leading zeros and the 10 bits behind
the first one: 16 bits in place of 64. Documents are linked if 100 * intersection >= percent * union of their sets.

1. Equal sets are merged under the smallest id, by a 128-bit fingerprint and their size.
2. Bands of four registers are the keys of candidates: at a similarity of 0.8 a pair misses all 32 bands with a probability of
   5e-8, at 0.85 of 5e-11. Bands without any shingle are no keys.
3. In each bucket of a band the registers' collision-corrected Jaccard estimate, with a margin of 5.5 standard deviations, tells
   which documents may have a partner, each pair in the first band that it shares. Buckets are dealt by hash into blocks
   of about 256 documents or half a million shingles (4 MB), whichever is less, and pairs of blocks are judged apart, so no task
   holds a large bucket, and only documents come out, never pairs.
4. The full sets of those documents are compared exactly, block pair by block pair, with intersections counted as matrix
   products over the shingles that at least two of them share. What comes out is a spanning forest of the block pair's links, at
   most one fewer than its documents; it keeps every document's class and loses no link between classes.
5. Components come from alternating star contraction.

Words are runs of characters other than ASCII white space, A-Z lower-cased. Defined cases: null texts and texts without
words have empty sets and are linked with nothing; a text of one to k-1 words is one shingle; rows that repeat an id are one node; a
null id is linked with nothing and kept; a text of any length is one set, in a block of its own or with others; tables may be empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.components import components
from nearkin.llm.textcore import U64, Words, bounded_batches, dealt_join, free_finished, hot_of, mix, reliable, roll, slices, spread, utf8

SHINGLE, REGISTERS, BAND = 5, 128, 4
BANDS = REGISTERS // BAND
MANTISSA = 10
#: Chance that different smallest hashes of a bucket share a register: equal leading zeros and mantissa bits.
COLLISION = 1 / (3 << MANTISSA)
MARGIN = 5.5
#: Documents and shingles in a block, as expected of a deal by hash.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19


def shingle_sets(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, text) of the distinct shingles, by text, then hash."""
    n = w.counts()
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), counts)
    at = spread(w.first[:-1], counts)
    h = np.zeros(len(at), U64)
    whole = (n >= k)[text]
    h[whole] = roll(w.hash, k)[at[whole]]
    for i in np.flatnonzero((n > 0) & (n < k)).tolist():
        h[np.searchsorted(text, i)] = roll(w.hash[w.first[i] : w.first[i + 1]], int(n[i]))[0]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


def registers(h: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """HyperMinHash registers of n texts from their sorted sets; 0 is an empty bucket."""
    key = text * REGISTERS + (h >> U64(57)).astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = key[1:] != key[:-1]
    rest = (h[new] & U64((1 << 57) - 1)).astype(np.int64)
    high = rest >> 28  # in halves, which floats hold exactly
    zeros = 57 - np.where(high > 0, 28 + np.frexp(high.astype(float))[1], np.frexp((rest & ((1 << 28) - 1)).astype(float))[1]).astype(np.int64)
    width = 56 - zeros  # bits behind the first one
    mantissa = np.where(width >= MANTISSA, rest >> np.maximum(width - MANTISSA, 0), rest << np.maximum(MANTISSA - width, 0)) & ((1 << MANTISSA) - 1)
    out = np.zeros(n * REGISTERS, np.uint16)
    out[key[new]] = 1 + (zeros << MANTISSA) + np.where(zeros < 57, mantissa, 0)
    return out.reshape(n, REGISTERS)


def estimated(equal: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Jaccard similarity from equal and filled registers, less the expected chance collisions."""
    return np.maximum((equal / np.maximum(filled, 1) - COLLISION) / (1 - COLLISION), 0)


SKETCH = "doc_id long, n long, f1 long, f2 long, registers binary"


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(1))
            for first, last in slices(offsets):
                base, count = offsets[first : last + 1], last - first
                h, text = shingle_sets(Words(data[base[0] : base[-1]], base - base[0], lower=True), k)
                n = np.bincount(text, minlength=count)
                prints = []
                full = np.flatnonzero(n)
                begin = (np.cumsum(n) - n)[full]
                for salt in (1, 2):
                    total = np.zeros(count, U64)
                    if len(full):
                        total[full] = np.add.reduceat(mix(h + U64(salt * 0x9E3779B97F4A7C15 % (1 << 64))), begin)
                    prints.append(pa.array(total.astype(np.int64)))
                packed = registers(h, text, count).astype("<u2")
                regs = pa.array([r.tobytes() for r in packed], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, count), pa.array(n), *prints, regs], names=["doc_id", "n", "f1", "f2", "registers"])

    return run


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each band of each sketch, and which bands are keys at all."""
    parts = regs.reshape(-1, BANDS, BAND)
    key = np.broadcast_to(np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for j in range(BAND):
        key = mix(key + parts[:, :, j] + U64(1))
    return key, parts.any(axis=2)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        regs = np.frombuffer(b"".join(b.column("registers").to_pylist()), "<u2").reshape(-1, REGISTERS)
        key, real = band_keys(regs)
        row, band = np.nonzero(real)
        ids, n = b.column("rep").to_numpy(), b.column("n").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(key[row, band].astype(np.int64)), pa.array(band.astype(np.int32)), pa.array(ids[row]), pa.array(n[row])], names=["key", "band", "rep", "n"])


def _pair_rows(a: np.ndarray, b: np.ndarray):
    """Chunks (rows of a, equal registers as rows x len(b) x registers) of bounded size."""
    step = max(1, (4 << 20) // max(1, b.size))
    for i in range(0, len(a), step):
        yield i, a[i : i + step, None, :] == b[None, :, :]


def possible(regs: np.ndarray, left: np.ndarray, right: np.ndarray, band: int, threshold: float) -> np.ndarray:
    """Which sketches may have a partner between `left` and `right` (row numbers) whose first shared band is `band`."""
    found = np.zeros(len(regs), bool)
    a, b = regs[left], regs[right]
    filled_b = b > 0
    for i, same in _pair_rows(a, b):
        bands = same.reshape(*same.shape[:2], BANDS, BAND).all(axis=3)
        bands &= (a[i : i + len(same)].reshape(len(same), BANDS, BAND).any(axis=2))[:, None, :]
        here = bands[:, :, band] & ~bands[:, :, :band].any(axis=2)
        here &= left[i : i + len(same), None] != right[None, :]
        x, y = np.nonzero(here)
        full_a = a[i : i + len(same)] > 0
        filled = (full_a[x] | filled_b[y]).sum(axis=1)
        equal = (same[x, y] & full_a[x]).sum(axis=1)
        good = estimated(equal, filled) >= threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / np.maximum(filled, 1))
        found[left[i + x[good]]] = True
        found[right[y[good]]] = True
    return found


GROUP = ("key", "band", "p", "q")


def _groups(batches: Iterator[pa.RecordBatch], binary: str):
    """Lists of whole groups out of rows that are sorted by GROUP: for each batch its complete groups, as (numbers by column,
    binary values, borders). What may go on in the next batch is held back; a group has two blocks of rows at most."""
    names = (*GROUP, "rep", "block")
    held, values = {c: np.zeros(0, np.int64) for c in names}, []
    for b in batches:
        now = {c: np.concatenate([held[c], b.column(c).to_numpy().astype(np.int64)]) for c in names}
        values = values + b.column(binary).to_pylist()
        new = np.zeros(len(values), bool)
        for c in GROUP:
            new[1:] |= now[c][1:] != now[c][:-1]
        edges = np.concatenate([[0], np.flatnonzero(new)])
        if edges[-1]:
            yield now, values, edges
        held, values = {c: now[c][edges[-1] :] for c in names}, values[edges[-1] :]
    if values:
        yield held, values, np.array([0, len(values)])


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows of a group together in one partition, group after group."""
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP)


def _judge(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each block pair of a bucket that may have a partner in it."""
        for now, values, edges in _groups(batches, "registers"):
            regs = np.frombuffer(b"".join(values), "<u2").reshape(-1, REGISTERS)
            found = np.zeros(len(regs), bool)
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                block, p, q = now["block"][x:y], now["p"][x], now["q"][x]
                left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
                if len(left) and len(right):
                    found[x:y] = possible(regs[x:y], left, right, int(now["band"][x]), threshold)
            out = [pa.array(now[c][: len(found)][found]) for c in (*GROUP, "rep", "block")]
            yield pa.RecordBatch.from_arrays(out, names=[*GROUP, "rep", "block"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(1))
            for first, last in slices(offsets):
                base, count = offsets[first : last + 1], last - first
                h, text = shingle_sets(Words(data[base[0] : base[-1]], base - base[0], lower=True), k)
                edge = np.searchsorted(text, np.arange(count + 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, count), pa.array([h[edge[i] : edge[i + 1]].tobytes() for i in range(count)], pa.binary())], names=["rep", "shingles"])

    return run


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All linked (left, right) positions, from exact intersections."""
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    tokens, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[at] > 1
    row, at = row[shared], (np.cumsum(df > 1) - 1)[at[shared]]
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    columns = int(at[-1]) + 1 if len(at) else 0
    width = max(1, min(columns, (2 << 20) // max(1, len(sets))))
    edges = np.searchsorted(at, np.arange(0, columns + width, width))
    for i, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        dense = np.zeros((len(sets), width), np.float32)
        dense[row[x:y], at[x:y] - i * width] = 1
        common += dense[left] @ dense[right].T
    both = common.astype(np.int64)
    union = size[left][:, None] + size[right][None, :] - both
    x, y = np.nonzero((100 * both >= percent * union) & (left[:, None] != right[None, :]) & (both > 0))
    return left[x], right[y]


def forest(n: int, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all that the given links join, without cycles."""
    root = list(range(n))
    kept = []
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        i, j = a, b
        while root[i] != i:
            root[i] = i = root[root[i]]
        while root[j] != j:
            root[j] = j = root[root[j]]
        if i != j:
            root[max(i, j)] = min(i, j)
            kept.append((a, b))
    return kept


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A spanning forest of the links of each block pair."""
        for now, values, edges in _groups(batches, "shingles"):
            kept: list[tuple[int, int]] = []
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                block, p, q = now["block"][x:y], now["p"][x], now["q"][x]
                left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
                if len(left) and len(right):
                    sets = [np.frombuffer(s, U64) for s in values[x:y]]
                    kept += [(x + i, x + j) for i, j in forest(len(sets), *links(sets, left, right, percent))]
            rep = now["rep"]
            yield pa.RecordBatch.from_arrays([pa.array([int(rep[i]) for i, _ in kept], pa.int64()), pa.array([int(rep[j]) for _, j in kept], pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_shingles, component_id (the smallest id reachable by links) and kept (it has that id)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = reliable(docs.mapInArrow(_sketch(k), SKETCH))
    usable = sketched.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    equal = reliable(usable.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("registers").alias("registers")))
    bands = equal.select("rep", "n", "registers").mapInArrow(_bands, "key long, band int, rep long, n long")
    crowded = reliable(bands.groupBy("key", "band").agg(F.count("*").alias("m"), F.sum("n").alias("size")).where("m > 1"))
    free_finished(docs.sparkSession)
    members = dealt_join(bands.drop("n"), crowded, ["key", "band"], hot=hot_of(crowded, ["key", "band"], "m"))
    blocks = F.least("m", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES))).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = members.withColumn("other", other).withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    judged = paired.select("key", "band", "p", "q", "rep", "block").join(equal.select("rep", "registers"), "rep")
    found = reliable(_grouped(judged.select(*GROUP, "rep", "block", "registers")).mapInArrow(_judge(percent / 100), "key long, band long, p long, q long, rep long, block long"))
    free_finished(docs.sparkSession)
    wanted = found.select(F.col("rep").alias("doc_id")).distinct()
    sets = docs.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(k), "rep long, shingles binary")
    edges = _grouped(found.join(sets, "rep").select(*GROUP, "rep", "block", "shingles")).mapInArrow(_confirm(percent), "a long, b long")
    # rows that repeat an id are one node, also where their sets differ: its classes are linked
    several = usable.groupBy("doc_id").agg(F.count_distinct("n", "f1", "f2").alias("m")).where("m > 1").select("doc_id")
    theirs = usable.join(several, "doc_id", "left_semi").join(equal.select("n", "f1", "f2", "rep"), ["n", "f1", "f2"]).select("doc_id", "rep").distinct()
    least = theirs.groupBy("doc_id").agg(F.min("rep").alias("b"))
    joined = components(edges.union(theirs.join(least, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")))
    classes = equal.select("n", "f1", "f2", "rep").join(joined, F.col("rep") == F.col("id"), "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("root"))
    named = sketched.join(classes, ["n", "f1", "f2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("root")).alias("component_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
