"""Line dedup by pairwise alignment: blocks of lines that an earlier document has are deleted from the later one.

1. Each non-empty line of a document is kept as a 64-bit hash with its number of words.
2. Overlapping documents are found through shared line hashes. A line that n documents share links each of them to the
   earliest one only, so a line in thousands of documents gives as many pairs and not their square, rare lines are
   followed up like all others without any limit, and each repeated line's first holder is a partner of every later holder.
   Lines of fewer than `min_line_words` (4) words link nothing by themselves, but do as parts of blocks. Blocks link likewise: from each line on, and up to each
   line, the shortest run of `min_block_words` words or more is a key, as is a whole document; these runs cover every line of
   every block that can be deleted, and each links its holders to the first one.
3. Each pair is aligned with patience diff: equal lines at both ends are matched, then lines that occur once in each
   document and stay in order (longest increasing run) are anchors, and the stretches between anchors are aligned likewise.
   Stretches without an anchor match nothing.
4. Aligned lines that follow each other in both documents form a block. Blocks of `min_block_words` (20) words or more are deleted
   from the later document, over all its partners; all documents are judged on the input.
5. A run that an earlier document holds can stay where its first holder has it in another order or among repeated lines. Its document
   is then aligned with all other earlier holders of that run, copies of one document counted once. So the result is that of
   aligning all pairs of documents. The last step takes work with the square of a run's different holders where alignment
   leaves the run in most of them.

Lines are the text between line feeds, compared unchanged by hash; empty lines are not numbered and stay. A line has as many words
as white space makes or, where that is more, a word for every two Han or kana and every four Thai, Lao, Burmese or
Khmer characters, which are written without spaces. Earlier means a
smaller id. Defined cases: null texts stay null and have no lines; rows with a null id link nothing and stay; rows that
share an id are not compared with each other, and each loses lines by its own text (known by a 64-bit hash, the version); a
text of any length is aligned whole, by one task; tables may be empty.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.textcore import U64, Words, bounded_batches, dealt_join, hot_of, mix, reliable, runs, slices, utf8

MIN_LINE_WORDS, MIN_BLOCK_WORDS = 4, 20
#: Characters to a word in scripts without spaces.
HAN, THAI = 2, 4
#: What tells texts apart: rows that share an id may have several.
ROW = ["doc_id", "version"]
#: Pairs of one earlier document that go to one task together.
SHARE = 500


def unspaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words of the lines by their characters of scripts without spaces."""
    at = np.flatnonzero(data >= 0xE0)  # first bytes of characters of three bytes or four
    if not len(at):
        return np.zeros(len(start), np.int64)
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    point = padded[at].astype(np.int64) << 16 | padded[at + 1].astype(np.int64) << 8 | padded[at + 2]
    within = lambda first, last: (point >= int.from_bytes(chr(first).encode()[:3])) & (point <= int.from_bytes(chr(last).encode()[:3]))
    han = within(0x3040, 0x30FF) | within(0x3400, 0x4DBF) | within(0x4E00, 0x9FFF) | within(0xF900, 0xFAFF) | within(0xFF66, 0xFF9D) | within(0x20000, 0x323AF)
    thai = within(0x0E01, 0x0EFF) | within(0x1000, 0x109F) | within(0x1780, 0x17FF)
    quarter = np.zeros(len(at) + 1, np.int64)
    np.cumsum(han * (THAI // HAN) + thai, out=quarter[1:])
    return (quarter[np.searchsorted(at, end)] - quarter[np.searchsorted(at, start)]) // THAI


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = utf8(b.column(1))
        for first, last in slices(offsets):
            base, count = offsets[first : last + 1], last - first
            part = data[base[0] : base[-1]]
            w = Words(part, base - base[0], "line")
            words = Words(part, base - base[0]).start
            n = np.searchsorted(words, w.end) - np.searchsorted(words, w.start)
            line, size = w.hash.astype(np.int64), np.maximum(n, unspaced(part, w.start, w.end)).astype(np.int32)
            edge = pa.array(w.first.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(first, count), b.column(2).slice(first, count), pa.ListArray.from_arrays(edge, pa.array(line)), pa.ListArray.from_arrays(edge, pa.array(size))],
                names=["doc_id", "version", "lines", "words"],
            )


def _blocks(min_block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shortest runs of enough words that begin or end at each line, and whole documents of enough words."""
        for b in batches:
            ids, versions, lines, words = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), b.column(3)
            edge = lines.offsets.to_numpy().astype(np.int64)
            line = lines.values.to_numpy()[edge[0] : edge[-1]].view(U64)
            at = words.offsets.to_numpy()
            total = np.zeros(len(line) + 1, np.int64)
            np.cumsum(words.values.to_numpy()[at[0] : at[-1]], out=total[1:])
            edge = edge - edge[0]
            row, n = np.repeat(np.arange(len(ids)), np.diff(edge)), np.arange(len(line))
            end = np.searchsorted(total, total[:-1] + min_block_words)
            begin = np.searchsorted(total, total[1:] - min_block_words, "right") - 1
            forth, back = end <= edge[row + 1], begin >= edge[row]
            some = np.unique(np.concatenate([np.stack([row, n, end])[:, forth], np.stack([row, begin, n + 1])[:, back]], axis=1), axis=1)
            whole = np.flatnonzero((total[edge[1:]] - total[edge[:-1]] >= min_block_words) & (np.diff(edge) > 0))
            key = np.concatenate([runs(line, some[1], some[2]), mix(~runs(line, edge[whole], edge[whole + 1]))])
            row, begin, end = np.concatenate([some, np.stack([whole, edge[whole], edge[whole + 1]])], axis=1)
            made = [ids[row], versions[row], key.view(np.int64), (begin - edge[row]).astype(np.int32), (end - edge[row]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["doc_id", "version", "key", "start", "end"])

    return run


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience alignment: matched positions of a and b, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        once_a, once_b = Counter(a[i:i2]), Counter(b[j:j2])
        place = {x: y for y, x in enumerate(b[j:j2], j) if once_b[x] == 1}
        anchors = increasing([(x, place[a[x]]) for x in range(i, i2) if once_a[a[x]] == 1 and a[x] in place])
        if anchors:
            out += anchors
            edges = [(i - 1, j - 1), *anchors, (i2, j2)]
            todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:], strict=False)]
    out.sort()
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that ascend in both places; the first places ascend already."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, y) in enumerate(pairs):
        at = bisect_left(tails, y)
        before[n] = ends[at - 1] if at else -1
        tails[at : at + 1] = [y]
        ends[at : at + 1] = [n]
    out = []
    n = ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def deleted(later: list[int], earlier: list[int], words: list[int], min_block_words: int = MIN_BLOCK_WORDS) -> list[int]:
    """Lines of the later document in aligned blocks of enough words."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*align(later, earlier), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[x] for x in block) >= min_block_words:
                out += block
            block = []
        block.append(i)
        last = (i, j)
    return out


def _align(min_block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, versions, gone = [], [], []
            for doc_id, version, lines, words, others in zip(*(b.column(c).to_pylist() for c in ("doc_id", "version", "lines", "words", "earlier")), strict=True):
                found = list(range(len(lines))) if lines == others and sum(words) >= min_block_words else deleted(lines, others, words, min_block_words)
                if found:
                    ids.append(doc_id)
                    versions.append(version)
                    gone.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=[*ROW, "gone"])

    return run


def _aligned(one: DataFrame, pairs: DataFrame, min_block_words: int) -> DataFrame:
    """(doc_id, version, gone) of the pairs (doc_id, version, first) of documents."""
    # a first holder of very many documents is sent to several tasks, each with a share of its pairs
    earlier = one.select(F.col("doc_id").alias("first"), F.col("lines").alias("earlier"))
    both = dealt_join(pairs, earlier, ["first"], SHARE).join(one, ROW)
    return both.select(*ROW, "lines", "words", "earlier").mapInArrow(_align(min_block_words), "doc_id long, version long, gone array<int>")


def _merged(found: DataFrame) -> DataFrame:
    return reliable(found.groupBy(*ROW).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")))


def _covered(gone: DataFrame) -> DataFrame:
    """(doc_id, version, start, until): each deleted line, and the first line after it that stays. One row a line, so a run is
    looked up by its own start and no row holds a document's deleted lines."""
    line = gone.select(*ROW, F.posexplode("gone").alias("n", "line"))
    stretch = line.groupBy(*ROW, F.expr("line - n")).agg(F.min("line").alias("begin"), (F.max("line") + 1).alias("until"))
    return stretch.select(*ROW, F.explode(F.sequence("begin", F.col("until") - 1)).alias("start"), "until")


def repeated_lines(docs: DataFrame, min_line_words: int = MIN_LINE_WORDS, min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(doc_id, version, gone): for texts that lose lines, the numbers of those among their non-empty lines. docs: doc_id, text."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    lines = rows.withColumn("version", F.xxhash64("text")).mapInArrow(_lines, "doc_id long, version long, lines array<long>, words array<int>")
    one = reliable(lines.groupBy(*ROW).agg(F.min(F.struct("lines", "words")).alias("x")).select(*ROW, "x.lines", "x.words"))
    long = one.select(*ROW, F.explode(F.arrays_zip("lines", "words")).alias("x")).where(F.col("x.words") >= min_line_words).select(*ROW, F.col("x.lines").alias("line")).distinct()
    first = reliable(long.groupBy("line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last"))
    linked = dealt_join(long, first.select("line", "first"), ["line"], hot=hot_of(first, ["line"], "n")).where("doc_id > first").select(*ROW, "first")
    blocks = one.mapInArrow(_blocks(min_block_words), "doc_id long, version long, key long, start int, end int")
    holders = reliable(blocks.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last"))
    held = reliable(dealt_join(blocks, holders.select("key", "first"), ["key"], hot=hot_of(holders, ["key"], "n")).where("doc_id > first"))
    pairs = reliable(linked.union(held.select(*ROW, "first")).distinct())
    gone = _merged(_aligned(one, pairs, min_block_words))
    left = reliable(held.join(_covered(gone), [*ROW, "start"], "left").where("until is null or until < end").select(*ROW, "key").distinct())
    if left.isEmpty():
        return gone
    # of earlier holders with the same lines the first one stands for all; `left` has no copies, as whole documents are keys too
    same = [F.size("lines").alias("n"), F.xxhash64("lines").alias("f1"), F.xxhash64(F.lit(1), "lines").alias("f2")]
    firsts = one.select("doc_id", *same).groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("first")).select("first").distinct()
    earlier = blocks.join(left.select("key").distinct(), "key", "left_semi").select("key", F.col("doc_id").alias("first")).join(firsts, "first", "left_semi")
    others = dealt_join(left, earlier, ["key"]).where("doc_id > first").select(*ROW, "first").distinct()
    others = reliable(others.join(pairs, [*ROW, "first"], "left_anti"))
    return gone if others.isEmpty() else _merged(gone.union(_aligned(one, others, min_block_words)))


def kept_text(text: str, gone: set[int]) -> str:
    out, n = [], 0
    for line in text.split("\n"):
        if line:
            if n not in gone:
                out.append(line)
            n += 1
        else:
            out.append(line)
    return "\n".join(out)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, total, removed = [], [], []
        for text, gone in zip(b.column("text").to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
            n = sum(map(bool, text.split("\n"))) if text else 0
            texts.append(kept_text(text, set(gone)) if gone and text else text)
            total.append(n)
            removed.append(sum(x < n for x in gone or ()))
        at = b.schema.get_field_index("text")
        columns = [b.column(i) if i != at else pa.array(texts, pa.string()) for i in range(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*b.schema.names[:-1], "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, min_line_words: int = MIN_LINE_WORDS, min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """The documents with repeated blocks deleted from `text`, other columns unchanged, and two columns more: n_lines and
    n_removed, both of non-empty lines; columns of docs that have these names are replaced. Needs doc_id and text."""
    gone = repeated_lines(docs, min_line_words, min_block_words)
    gone = gone.select(F.col("doc_id").alias("_gone_of"), F.col("version").alias("_gone_version"), F.col("gone").alias("_gone"))
    # the columns travel as one struct, so none of their names can clash
    named = docs.drop("n_lines", "n_removed").withColumn("text", F.col("text").cast("string"))
    packed = named.select(F.col("doc_id").cast("long").alias("_of"), F.xxhash64("text").alias("_version"), F.struct(*named.columns).alias("_row"))
    joined = packed.join(gone, (F.col("_of") == F.col("_gone_of")) & (F.col("_version") == F.col("_gone_version")), "left").select("_row.*", "_gone")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields) + ", n_lines long, n_removed long"
    return joined.mapInArrow(_kept, schema)


def line_digest(kept: DataFrame) -> DataFrame:
    """Counts and the digest of the kept text (null: empty)."""
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
