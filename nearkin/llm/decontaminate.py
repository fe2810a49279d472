"""Benchmark decontamination as a prefix-filtered set join with exact verification.

A window is `k` (10) consecutive words of a benchmark item; an item of fewer words, but not none, is one window. Each window is
a set of (word, place) tokens that a document must hold entirely, so in an order of tokens by rarity a prefix of it is
necessary. The prefix is the window's word that is rarest over all documents, with the neighbour behind it (in front
of it at the window's end): two tokens at fixed places. The join takes document words whose prefix is some window's; the positional
bound puts the window where its prefix has its place, the length bound drops windows that would leave the document, and
what is left is verified word by word at the window's own size.

Documents are scanned twice, however large the benchmark: word counts for the rarity order are taken over all documents, for
the benchmark's words only; then candidates are found. The join has two forms with equal results:

* up to `broadcast_windows` (100,000, about 20 MB) distinct windows, which are counted, their index is broadcast and
  documents are searched where they are;
* beyond, prefixes and vocabulary are shuffled. Documents send the places whose prefix passes a broadcast filter of at
  most 8 MB, with the 2k-1 words around; each place is joined with the (place, length) shapes that windows of its prefix have, at
  most k(k+1)/2, and then with the windows by all their words, so windows that share a prefix make no pairs. Prefixes and
  windows that very many places have are dealt to several tasks.

Words are lower-cased (A-Z) runs of digits, letters and all characters from U+0080 on, compared by 64-bit hashes of their
bytes. Defined cases: null texts have no words; an item without words has no window; windows of an item without id are hit but
name no item; repeated items all count; rows that repeat an id are judged apart; a text of any length is searched whole, by one task; tables
may be empty; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.textcore import U64, Words, bounded_batches, dealt_join, hash_filter, mix, passing, reliable, slices, spread, utf8

WINDOW = 10
BROADCAST = 100_000
#: Places of one prefix that go to one task together, window candidates that are verified at once, and places in a row.
SHARE, CHUNK, PART = 20_000, 1 << 20, 4_096
WINDOWS = "item_id long, words array<long>"
HITS = "doc_id long, n_words long, hits array<struct<start:int,length:int>>, items array<long>"


def item_windows(benchmark: DataFrame, k: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words) of each distinct window of each item, words as 64-bit hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            data, offsets = utf8(b.column(1))
            for first, last in slices(offsets):
                base = offsets[first : last + 1]
                w = Words(data[base[0] : base[-1]], base - base[0], "alnum", lower=True)
                for i in range(last - first):
                    own = w.hash[w.first[i] : w.first[i + 1]].astype(np.int64)
                    for at in range(max(1, len(own) - k + 1) if len(own) else 0):
                        rows.append((ids[first + i], own[at : at + k].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["item_id", "words"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, WINDOWS).distinct()


def prefix_keys(words: np.ndarray, other: np.ndarray, side: int) -> np.ndarray:
    """Keys of a word with the neighbour behind it (side 1) or in front of it (2), or of a word alone (0)."""
    return mix(words + mix(other + U64(side)) * U64(side > 0) + U64(side))


def prefixes(words: list[int], counts: dict[int, int]) -> tuple[int, int]:
    """Place of a window's rarest word, and the side of its neighbour."""
    place = min(range(len(words)), key=lambda j: (counts.get(words[j], 0), words[j], j))
    return place, 1 if place + 1 < len(words) else 2 if place else 0


def _neighbours(w: Words) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Text of each word, and for each side (words that have that neighbour in their text, keys)."""
    n = len(w.hash)
    text = np.repeat(np.arange(len(w.first) - 1), w.counts())
    inner = np.flatnonzero(text[1:] == text[:-1]) if n else np.zeros(0, np.int64)
    sides = [(np.arange(n), w.hash, w.hash), (inner, w.hash[inner], w.hash[inner + 1]), (inner + 1, w.hash[inner + 1], w.hash[inner])]
    return text, [(at, prefix_keys(own, other, side)) for side, (at, own, other) in enumerate(sides)]


class WindowIndex:
    """Windows, found by their prefixes."""

    def __init__(self, windows: list[tuple[list[int], list[int]]], counts: dict[int, int]):
        """windows: (words, item ids). counts: documents' number of each word."""
        rare = [prefixes(w, counts) for w, _ in windows]
        word = lambda w, j: w[j] if 0 <= j < len(w) else 0
        own = np.array([w[j] for (w, _), (j, _) in zip(windows, rare, strict=True)], np.int64).view(U64)
        other = np.array([word(w, j + (0, 1, -1)[side]) for (w, _), (j, side) in zip(windows, rare, strict=True)], np.int64).view(U64)
        side = np.array([s for _, s in rare], np.int64)
        tokens = np.zeros(len(windows), U64)
        for s in range(3):
            tokens[side == s] = prefix_keys(own[side == s], other[side == s], s)
        order = np.argsort(tokens, kind="stable")
        self.sides = sorted(set(side.tolist()))
        self.tokens, begin, n = np.unique(tokens[order], return_index=True, return_counts=True)
        self.begin, self.n = begin.astype(np.int64), n.astype(np.int64)
        self.place = np.array([j for j, _ in rare], np.int64)[order]
        self.length = np.array([len(w) for w, _ in windows], np.int64)[order]
        width = int(self.length.max()) if len(windows) else 0
        self.words = np.zeros((len(windows), width), U64)
        for row, i in enumerate(order):
            self.words[row, : len(windows[i][0])] = np.array(windows[i][0], np.int64).view(U64)
        self.items = [windows[i][1] for i in order]

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of each occurrence inside one text, in order."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(self.tokens) and len(w.hash):
            text, sides = _neighbours(w)
            for side in self.sides:
                at, keys = sides[side]
                place = np.minimum(np.searchsorted(self.tokens, keys), len(self.tokens) - 1)
                held = self.tokens[place] == keys
                at, place = at[held], place[held]
                # windows that share a prefix are verified in chunks of bounded size
                total = np.cumsum(self.n[place])
                first = 0
                while first < len(at):
                    last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + CHUNK, "right")))
                    found.append(self._verified(w, text, at[first:last], place[first:last]))
                    first = last
        start, window = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((window, start))
        return start[order], window[order]

    def _verified(self, w: Words, text: np.ndarray, held: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        window = spread(self.begin[at], self.n[at])
        start = np.repeat(held, self.n[at]) - self.place[window]
        text = np.repeat(text[held], self.n[at])
        fits = (start >= w.first[text]) & (start + self.length[window] <= w.first[text + 1])
        start, window = start[fits], window[fits]
        for j in range(self.words.shape[1]):
            same = (j >= self.length[window]) | (w.hash[np.minimum(start + j, len(w.hash) - 1)] == self.words[window, j])
            start, window = start[same], window[same]
        return start, window


def _word_slices(batches: Iterator[pa.RecordBatch], column: int):
    for b in batches:
        data, offsets = utf8(b.column(column))
        for first, last in slices(offsets):
            base = offsets[first : last + 1]
            yield b, first, last, Words(data[base[0] : base[-1]], base - base[0], "alnum", lower=True)


def _vocabulary_counts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(word, n): occurrences over all documents of the windows' words."""
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    wanted = hash_filter(vocabulary, "word")
    if wanted is None:
        return docs.sparkSession.createDataFrame([], "word long, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        made = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for _, _, _, w in _word_slices(batches, 0):
            words, n = np.unique(w.hash[passing(wanted.value, w.hash)], return_counts=True)
            for word, more in zip(words.view(np.int64).tolist(), n.tolist(), strict=True):
                held[word] = held.get(word, 0) + more
            if len(held) > CHUNK:
                yield made()
                held.clear()
        yield made()

    counts = docs.select("_text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.join(vocabulary, "word", "left_semi")


def find_windows(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", broadcast_windows: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: its number of words, the distinct word ranges at which windows occur, and those windows' items. The
    columns in `carry` follow unchanged."""
    bounded_batches(docs.sparkSession)
    more = "".join(f", `{c}` {kind}" for c, kind in docs.select(*carry).dtypes) if carry else ""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *carry)
    windows = reliable(item_windows(benchmark, k).groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    counts = reliable(_vocabulary_counts(docs, windows))
    if windows.count() <= (BROADCAST if broadcast_windows is None else broadcast_windows):
        held = sorted((r["words"], r["items"]) for r in windows.toLocalIterator())
        index = WindowIndex(held, {r["word"]: r["n"] for r in counts.toLocalIterator()})
        return docs.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(index)), HITS + more)
    return _joined(docs, windows, counts, k, carry, more)


def _prefixed(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """windows with the place and key of their prefixes."""
    known = counts.select(F.col("word").alias("_word"), F.col("n").alias("_n"))
    each = windows.withColumn("window", F.xxhash64("words")).select("words", "window", F.posexplode("words").alias("place", "_word")).join(known, "_word", "left")
    rarest = each.groupBy("words").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_word").alias("word"), F.col("place"))).alias("rare"))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            side = np.array([1 if j + 1 < len(x) else 2 if j else 0 for x, j in rows], np.int64)
            own = np.array([x[j] for x, j in rows], np.int64).view(U64)
            other = np.array([x[j + (0, 1, -1)[s]] for (x, j), s in zip(rows, side.tolist(), strict=True)], np.int64).view(U64)
            keys = np.zeros(len(rows), U64)
            for s in range(3):
                keys[side == s] = prefix_keys(own[side == s], other[side == s], s)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *b.columns], names=["key", "words", "place"])

    return rarest.select("words", "rare.place").mapInArrow(key, "key long, words array<long>, place int").join(windows, "words")


_PLACES = "row long, doc_id long, n_words long, places array<struct<key:bigint,at:int,first:int,around:array<bigint>>>"


def _joined(docs: DataFrame, windows: DataFrame, counts: DataFrame, k: int, carry: tuple[str, ...], more: str) -> DataFrame:
    """`find_windows` for benchmarks of any size."""
    prefixed = reliable(_prefixed(windows, counts))
    wanted = hash_filter(prefixed, "key")
    place_type = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("around", pa.list_(pa.int64()))]))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a text, numbered within the task: its places in parts of at most `PART`; the first part has n_words."""
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33

        def made(b, rows):
            """Rows (number, index in the batch, n_words, places); what is carried goes with n_words."""
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            at, index, n, found = (pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (place_type,), strict=True))
            own = pc.if_else(pc.is_valid(n), index, pa.scalar(None, pa.int64()))
            return pa.RecordBatch.from_arrays([at, b.column(0).take(index), n, found, *(c.take(own) for c in b.columns[2:])], names=["row", "doc_id", "n_words", "places", *carry])

        for b, first, last, w in _word_slices(batches, 1):
            text, sides = _neighbours(w)
            found = [(at[some], keys[some]) for at, keys in sides for some in [passing(wanted.value, keys)]] if wanted else [(np.zeros(0, np.int64), np.zeros(0, U64))]
            at, keys = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(at, kind="stable")
            at, keys = at[order], keys[order].view(np.int64)
            edge = np.searchsorted(at, w.first)
            rows, size = [], 0
            for i in range(last - first):
                low, high = int(w.first[i]), int(w.first[i + 1])
                for part in range(int(edge[i]), max(int(edge[i + 1]), int(edge[i]) + 1), PART):
                    own = []
                    for p, key in zip(at[part : min(part + PART, edge[i + 1])].tolist(), keys[part : min(part + PART, edge[i + 1])].tolist(), strict=True):
                        begin, end = max(low, p - k + 1), min(high, p + k)
                        own.append({"key": key, "at": p - low, "first": begin - low, "around": w.hash[begin:end].view(np.int64).tolist()})
                    rows.append((number, first + i, high - low if part == edge[i] else None, own))
                    size += len(own)
                    if size >= PART:
                        yield made(b, rows)
                        rows, size = [], 0
                number += 1
            yield made(b, rows)

    scanned = reliable(docs.mapInArrow(places, _PLACES + more))
    each = scanned.select("row", F.explode("places").alias("p")).select("row", "p.*")
    # shapes of the windows of a prefix: few, so that they can follow a prefix of many places to several tasks
    shapes = prefixed.groupBy("key").agg(F.collect_set(F.struct("place", F.size("words").alias("length"))).alias("shapes"))
    shaped = dealt_join(each, shapes, ["key"], SHARE).withColumn("shape", F.explode("shapes"))
    start, inside = F.col("at") - F.col("shape.place"), F.col("at") - F.col("shape.place") - F.col("first")
    fits = (inside >= 0) & (inside + F.col("shape.length") <= F.size("around"))
    candidates = reliable(shaped.where(fits).select("row", start.alias("start"), F.slice("around", inside + 1, F.col("shape.length")).alias("words")))
    hits = dealt_join(candidates, prefixed.select("words", "items"), ["words"], SHARE)
    by_row = hits.groupBy("row").agg(F.collect_set(F.struct("start", F.size("words").alias("length"))).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    out = scanned.where("n_words is not null").drop("places").join(by_row, "row", "left")
    return out.select("doc_id", "n_words", none("hits", "array<struct<start:int,length:int>>").alias("hits"), none("items", "array<bigint>").alias("items"), *carry)


def _search(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            data, offsets = utf8(b.column(1))
            n_words, hits, items = [], [], []
            for first, last in slices(offsets):
                base = offsets[first : last + 1]
                w = Words(data[base[0] : base[-1]], base - base[0], "alnum", lower=True)
                start, window = index.find(w)
                n = last - first
                n_words += w.counts().tolist()
                own_hits, own_items = [[] for _ in range(n)], [set() for _ in range(n)]
                text = np.searchsorted(w.first, start, "right") - 1
                for i, s, x in zip(text.tolist(), (start - w.first[text]).tolist(), window.tolist(), strict=True):
                    own_hits[i].append((s, int(index.length[x])))
                    own_items[i].update(index.items[x])
                hits += [sorted(set(h)) for h in own_hits]
                items += [sorted(s) for s in own_items]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
            made = pa.array([[{"start": s, "length": n} for s, n in h] for h in hits], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), made, pa.array(items, pa.list_(pa.int64())), *b.columns[2:]], names=["doc_id", "n_words", "hits", "items", *b.schema.names[2:]])

    return search


def covered_words(hits: str = "hits"):
    """Column: words inside any of the ranges, which may overlap."""
    ordered = F.array_sort(hits)
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    return F.aggregate(
        ordered,
        zero,
        lambda a, h: F.struct(
            F.greatest(a["to"], h["start"] + h["length"]).alias("to"),
            (a["n"] + F.greatest(h["start"] + h["length"] - F.greatest(a["to"], h["start"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"].cast("long"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, broadcast_windows: int | None = None) -> DataFrame:
    """Per document: words, words inside windows, and the items whose windows occur."""
    found = find_windows(docs, benchmark, k, broadcast_windows=broadcast_windows)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", covered_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


