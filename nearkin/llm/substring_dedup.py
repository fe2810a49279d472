"""Substring dedup: windows of words that an earlier document has, found behind a count-min prefilter.

A window is `k` (13) consecutive words. Each word that a window covers whose words also start somewhere in a document
with a smaller id is removed; windows are judged on the input.

1. Equal texts are known by a 128-bit hash. The smallest id of each stands for its copies, which lose all words that
   windows cover. Texts are dealt by their hash into packs of bounded bytes, which are written to the shared checkpoint folder;
   a task sends a text once, and a text with very many copies (at most 100,000 such are told to all tasks) is sent by its
   first holder only. From here on a pack's contents and order are fixed, so a lost task is done again alike.
2. Each pack sketches its windows: for two hash rows, the sorted cells that they hit, as gaps. The merged sketch has about
   four cells a row for each window of prose and is split into shards, so its size follows the input and no task or
   driver holds the whole; shards add up the packs' cells and answer each pack with one bit for each cell: hit twice or not.
   A pack sends a shard one row; at 100 TB there are about ten windows to a row, so rows follow the windows. The answers
   are streamed in order behind their pack and never gathered.
   A count-min sketch only overestimates, so a window with a cell of one hit in either row is in no other document.
3. The windows left go, once a pack, with their smallest id to exact shards by a 128-bit hash of their words, which
   answer with the smallest id over all packs. A window with 128 equal bits is taken as equal.
4. Each pack marks the covered words of its texts; documents get the results of their text by a join in which texts
   with very many copies are dealt to several tasks.

Data moved are a few bytes for each window, and 24 for each estimated to repeat; no task's input grows with the number
of copies of a text or passage, since packs hold each text and send each window once.

Defined cases: a null text has no words; fewer words than `k` make no window; rows that repeat an id with one text get
equal results; a null id counts as larger than all others; a text is never cut, and one longer than a pack is a pack by itself;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.textcore import HOT_KEYS, Words, bounded_batches, dealt_join, free_finished, mix, reliable, roll, slices, spread, starts_within, utf8

WINDOW = 13
NO_ID = (1 << 63) - 1
U64 = np.uint64
#: Copies from which a text is sent to its pack by its first holder only.
COPIES = 10_000
KEY = ("k1", "k2")
RESULT = "k1 long, k2 long, least long, n_words long, n_removed long, kept string"


def _power_of_two(x: float, low: int, high: int) -> int:
    return 1 << min(high, max(low, int(max(x, 1)).bit_length()))


class Sizes:
    """Packs and shards for so many bytes of text."""

    def __init__(self, total: int):
        self.pack_bytes = min(64 << 20, max(2 << 20, total // 4096))
        self.packs = max(1, -(-total // self.pack_bytes))
        cells = 2 * total // 3
        self.shard_cells = _power_of_two(cells / 128, 18, 26)
        self.shards = max(1, -(-cells // self.shard_cells))

    @property
    def cells(self) -> int:
        return self.shards * self.shard_cells


def _send_texts(hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k1, k2, text, least): each text once a task, and without its text each smaller id that comes later. Of a hot text,
        the smallest id only."""
        least: dict[tuple[int, int], int] = {}
        for b in batches:
            rows = []
            for i, key in enumerate(zip(*(b.column(c).to_pylist() for c in KEY), b.column("id").to_pylist(), strict=True)):
                key, own = key[:2], key[2]
                if hot.value.get(key, own) == own and own < least.get(key, NO_ID + 1):
                    rows.append((i, key in least, own))
                    least[key] = own
            at = pa.array([r[0] for r in rows], pa.int64())
            text = b.column("text").take(at)
            known = pa.array([r[1] for r in rows], pa.bool_())
            text = pc.if_else(known, pa.scalar(None, text.type), text)
            yield pa.RecordBatch.from_arrays([b.column("k1").take(at), b.column("k2").take(at), text, pa.array([r[2] for r in rows], pa.int64())], names=[*KEY, "text", "least"])

    return run


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The pack's different texts, in order of their hashes, as one compressed Arrow stream."""
    least: dict[tuple[int, int], int] = {}
    place: dict[tuple[int, int], int] = {}
    told = pc.is_valid(table["text"]).to_pylist()
    for i, (k1, k2, own, here) in enumerate(zip(*(table[c].to_pylist() for c in (*KEY, "least")), told, strict=True)):
        least[k1, k2] = min(own, least.get((k1, k2), own))
        if here:
            place.setdefault((k1, k2), i)
    order = sorted(place)
    texts = table["text"].combine_chunks().cast(pa.large_string()).take(pa.array([place[k] for k in order], pa.int64()))
    columns = [texts, *(pa.array([k[i] for k in order], pa.int64()) for i in (0, 1)), pa.array([least[k] for k in order], pa.int64())]
    data = pa.record_batch(columns, names=["text", *KEY, "least"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, data.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(data)
    return pa.table({"pack": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


class Pack:
    """A pack's texts, words and windows."""

    def __init__(self, blob: bytes, k: int):
        t = pa.ipc.open_stream(blob).read_all().combine_chunks()
        self.texts, self.k = t.num_rows, k
        self.keys = [t[c].to_numpy() for c in KEY]
        self.least = t["least"].to_numpy()
        self.data, self.offsets = utf8(t["text"])

    def parts(self):
        """(first text, last text, words) of each slice."""
        for first, last in slices(self.offsets):
            base = self.offsets[first : last + 1]
            yield first, last, Words(self.data[base[0] : base[-1]], base - base[0])

    def windows(self, second: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash (and second hash) and text of every window, in order."""
        a, b, text = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for first, last, w in self.parts():
            at, counts = starts_within(w.first, self.k)
            if len(at):
                a.append(roll(w.hash, self.k)[at])
                if second:
                    b.append(roll(w.hash, self.k, salt=1)[at])
                text.append(np.repeat(np.arange(first, last), counts))
        return np.concatenate(a), np.concatenate(b), np.concatenate(text)


def _cells(windows: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (windows if row == 0 else mix(windows + U64(0x632BE59BD9B4E019))) % U64(cells)


def _gaps(cells: np.ndarray) -> bytes:
    """Ascending numbers under 2^32 as 16-bit gaps; 65535 stands for itself plus the next gap."""
    if not len(cells):
        return b""
    steps = np.diff(cells.astype(np.int64), prepend=-1) - 1
    wide, rest = steps // 65535, steps % 65535
    if not wide.any():
        return rest.astype("<u2").tobytes()
    out = np.full(int((wide + 1).sum()), 65535, "<u2")
    out[np.cumsum(wide + 1) - 1] = rest
    return out.tobytes()


def _ungap(blob: bytes) -> np.ndarray:
    steps = np.frombuffer(blob, "<u2")
    ends = steps != 65535
    return np.cumsum(steps.astype(np.int64) + ends)[ends] - 1


def _sketch(windows: np.ndarray, row: int, sizes: Sizes):
    """(shard, cells inside it, which of them the pack hits again) of one hash row; shards ascend."""
    cells, hits = np.unique(_cells(windows, row, sizes.cells), return_counts=True)
    edges = np.searchsorted(cells, (np.arange(sizes.shards + 1, dtype=np.int64) * sizes.shard_cells).astype(U64))
    for shard in np.flatnonzero(np.diff(edges)).tolist():
        own = slice(edges[shard], edges[shard + 1])
        yield shard, cells[own] - U64(shard * sizes.shard_cells), hits[own] > 1


SKETCH = "line int, shard int, pack int, cells binary, again binary"


def _send_sketch(k: int, sizes: Sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, blob in zip(b.column("pack").to_pylist(), b.column("blob").to_pylist(), strict=True):
                windows = Pack(blob, k).windows(second=False)[0]
                rows = [(line, shard, number, _gaps(c), np.packbits(again).tobytes()) for line in (0, 1) for shard, c, again in _sketch(windows, line, sizes)]
                if rows:
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["line", "shard", "pack", "cells", "again"])

    return run


def _merge_sketch(cells: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Adds the packs' cells of a shard; answers each pack with a bit for each of its cells."""
        hits = np.zeros(cells, np.uint8)
        sent = [_ungap(x) for x in table["cells"].to_pylist()]
        for at, again in zip(sent, table["again"].to_pylist(), strict=True):
            more = 1 + np.unpackbits(np.frombuffer(again, np.uint8), count=len(at))
            hits[at] = np.minimum(hits[at] + more, 2)
        bits = [np.packbits(hits[at] > 1).tobytes() for at in sent]
        return pa.table({"pack": table["pack"], "line": table["line"], "shard": table["shard"], "bits": pa.array(bits, pa.binary())})

    return run


class Judged:
    """A pack while the sketch's answers come in, in order of line and shard."""

    def __init__(self, blob: bytes, k: int, sizes: Sizes):
        self.pack, self.sizes = Pack(blob, k), sizes
        self.a, self.b, self.text = self.pack.windows(second=True)
        self.slots = 1 << max(12, min(26, int(len(self.a)).bit_length() + 3))
        self.keep, self.line, self.hit, self.cells = np.ones(len(self.a), bool), None, None, None
        self.exact: list[np.ndarray] = []

    def _close(self) -> None:
        if self.line is not None:
            self.keep &= self.hit[(_cells(self.a, self.line, self.sizes.cells) & U64(self.slots - 1)).astype(np.int64)]

    def answer(self, line: int, shard: int, bits: bytes) -> None:
        """Cells hit twice are looked up by their low bits, which lets a few more windows through."""
        if line != self.line:
            self._close()
            self.line, self.hit = line, np.zeros(self.slots, bool)
            self.cells = np.unique(_cells(self.a, line, self.sizes.cells))
        first = U64(shard * self.sizes.shard_cells)
        own = self.cells[np.searchsorted(self.cells, first) : np.searchsorted(self.cells, first + U64(self.sizes.shard_cells))]
        twice = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
        self.hit[(own[twice] & U64(self.slots - 1)).astype(np.int64)] = True

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows that both rows estimate at two or more: index among the pack's windows, hashes and text."""
        self._close()
        self.line = self.cells = self.hit = None
        at = np.flatnonzero(self.keep)
        return at, self.a[at], self.b[at], self.text[at]


#: Steps of a pack's stream: its blob, the two rows of the sketch, exact answers.
BLOB, EXACT_STEP = -1, 2
STREAM = ("pack", "step", "shard", "data")


def _streamed(*parts: DataFrame) -> DataFrame:
    """Rows (pack, step, shard, data) together in one partition for each pack, in order."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.repartition("pack").sortWithinPartitions("pack", "step", "shard")


def _judged(batches: Iterator[pa.RecordBatch], k: int, sizes: Sizes) -> Iterator[tuple[int, Judged]]:
    """Each pack with all its answers, out of a stream."""
    number, now = None, None
    for b in batches:
        for pack, step, shard, data in zip(*(b.column(c).to_pylist() for c in STREAM), strict=True):
            if step == BLOB:
                if now is not None:
                    yield number, now
                number, now = pack, Judged(data, k, sizes)
            elif step == EXACT_STEP:
                now.exact.append(np.frombuffer(data, np.int64))
            else:
                now.answer(step, shard, data)
    if now is not None:
        yield number, now


def _entries(pack: Pack, a: np.ndarray, b: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows by hash, each with its smallest id, and the entry of each given window."""
    order = np.lexsort((b, a))
    x, y, least = a[order], b[order], pack.least[text[order]]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    entry = np.empty(len(x), np.int64)
    entry[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return x[first], y[first], np.minimum.reduceat(least, first) if len(first) else least, entry


def _shard_edges(a: np.ndarray, shards: int) -> np.ndarray:
    """Borders, in ascending hashes, of equal ranges of the hash space."""
    step = (1 << 64) // shards
    return np.concatenate([[0], np.searchsorted(a, (np.arange(1, shards, dtype=object) * step).astype(U64)), [len(a)]]).astype(np.int64)


EXACT = "shard int, pack int, a binary, b binary, least binary"


def _send_exact(k: int, sizes: Sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, judged in _judged(batches, k, sizes):
            _, a, b, text = judged.repeated()
            a, b, least, _ = _entries(judged.pack, a, b, text)
            edges = _shard_edges(a, sizes.shards)
            some = np.flatnonzero(np.diff(edges)).tolist()
            parts = [[x[edges[s] : edges[s + 1]].tobytes() for s in some] for x in (a, b, least)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([number] * len(some), pa.int32()), *[pa.array(p, pa.binary()) for p in parts]], names=["shard", "pack", "a", "b", "least"])

    return run


def _merge_exact(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The smallest id over all packs, for each window that each pack sent."""
    sent = [[np.frombuffer(x, kind) for x in table[c].to_pylist()] for c, kind in (("a", U64), ("b", U64), ("least", np.int64))]
    a, b, least = map(np.concatenate, sent)
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    first = np.flatnonzero(new)
    over_all = np.empty_like(least)
    over_all[order] = np.minimum.reduceat(least[order], first)[np.cumsum(new) - 1]
    parts = np.split(over_all, np.cumsum([len(s) for s in sent[0]])[:-1])
    return pa.table({"pack": table["pack"], "shard": table["shard"], "least": pa.array([p.tobytes() for p in parts], pa.binary())})


def _finish(k: int, sizes: Sizes, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, judged in _judged(batches, k, sizes):
            yield _result(judged, texts)

    return run


def _result(judged: Judged, texts: bool) -> pa.RecordBatch:
    pack = judged.pack
    at, a, b, text = judged.repeated()
    entry = _entries(pack, a, b, text)[3]
    least = np.concatenate([np.zeros(0, np.int64), *judged.exact])
    gone = at[least[entry] < pack.least[text]] if len(at) else at
    n_words, n_removed, kept = [], [], []
    done = 0  # windows of the slices before
    for first, last, w in pack.parts():
        starts, counts = starts_within(w.first, pack.k)
        own = starts[gone[np.searchsorted(gone, done) : np.searchsorted(gone, done + len(starts))] - done]
        done += len(starts)
        cover = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(cover, own, 1)
        np.add.at(cover, own + pack.k, -1)
        stays = np.cumsum(cover)[:-1] == 0
        own_words = joined(w, stays)
        left = np.concatenate([[0], np.cumsum(stays)])[w.first]
        n_words += w.counts().tolist()
        n_removed += (w.counts() - np.diff(left)).tolist()
        kept += [own_words(i).decode() if texts else hashlib.sha256(own_words(i)).hexdigest() for i in range(last - first)]
    columns = [*pack.keys, pack.least, n_words, n_removed]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(kept, pa.string())], names=[*KEY, "least", "n_words", "n_removed", "kept"])


def joined(w: Words, stays: np.ndarray):
    """A function from a text's number to its kept words, joined by one space."""
    start, length = w.start[stays], (w.end - w.start)[stays]
    ends = np.cumsum(length + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    out[spread(ends - length - 1, length)] = w.data[spread(start, length)]
    before = np.concatenate([[0], np.cumsum(stays)])[w.first]
    edge = np.concatenate([[0], ends])
    return lambda i: out[edge[before[i]] : max(edge[before[i]], edge[before[i + 1]] - 1)].tobytes()


def remove_repeats(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Per document: words, removed words, and the kept words joined by one space (`texts`) or their SHA-256."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    docs = docs.select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "id", "text")
    rows = reliable(docs.select("id", *KEY, F.octet_length("text").alias("bytes")))
    total, n = rows.agg(F.sum("bytes"), F.count("*")).first()
    sizes = Sizes(total or 0)
    held = rows.groupBy(*KEY).agg(F.min("id").alias("least"), F.count("*").alias("n")).where(F.col("n") > max(COPIES, -(-n // HOT_KEYS)))
    hot = spark.sparkContext.broadcast({(r["k1"], r["k2"]): r["least"] for r in held.collect()})  # at most HOT_KEYS
    merged = docs.mapInArrow(_send_texts(hot), "k1 long, k2 long, text string, least long")
    packs = reliable(merged.withColumn("pack", F.pmod("k1", F.lit(sizes.packs)).cast("int")).groupBy("pack").applyInArrow(_pack, "pack int, blob binary"))
    free_finished(spark)
    sketch = packs.mapInArrow(_send_sketch(k, sizes), SKETCH)
    bits = reliable(sketch.groupBy("line", "shard").applyInArrow(_merge_sketch(sizes.shard_cells), "pack int, line int, shard int, bits binary"))
    free_finished(spark)
    judged = (packs.select("pack", F.lit(BLOB).alias("step"), F.lit(0).alias("shard"), F.col("blob").alias("data")), bits.select("pack", F.col("line").alias("step"), "shard", F.col("bits").alias("data")))
    entries = _streamed(*judged).mapInArrow(_send_exact(k, sizes), EXACT)
    exact = entries.groupBy("shard").applyInArrow(_merge_exact, "pack int, shard int, least binary")
    answers = reliable(exact.select("pack", F.lit(EXACT_STEP).alias("step"), "shard", F.col("least").alias("data")))
    del entries, exact
    free_finished(spark)
    found = _streamed(*judged, answers).mapInArrow(_finish(k, sizes, texts), RESULT)
    own = dealt_join(rows.select("id", *KEY), found, list(KEY), COPIES)
    copy = (F.col("id") != F.col("least")) & (F.col("n_words") >= k)
    nothing = F.lit("" if texts else hashlib.sha256(b"").hexdigest())
    return own.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, nothing).otherwise(F.col("kept")).alias("text" if texts else "kept_sha256"),
    )
