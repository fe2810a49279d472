"""Hamming-range search: all stored hashes within a distance of each query hash, exactly.

Equal hashes are merged first on both sides, so copies cost nothing; what is searched are distinct hashes, settled in the
shared folder, so hashes that are dear to compute are computed once. There are three ways to the same result:

* `nested`: every pair is tested in a broadcast nested-loop join, where the smaller side is at most `BROADCAST_ROWS`
  distinct hashes (16 bytes each) and the pairs are at most `NESTED_PAIRS`;
* `bands`: the 128 bits are cut into bands. Of hashes within t bits, with t = r * bands + a, one of the first a + 1
  bands differs in at most r bits or another in at most r - 1. The query side sends each band with all masks of so few
  bits and joins the other side's bands by value; the distance is tested in the join, and a pair comes only from the first band in
  which it agrees so far, so there are no repeats to drop. The number of bands is the one for which probes and
  expected candidates are fewest for the stored side's size. Band values that very many hashes have are dealt to several tasks.
  Only the masks are broadcast, at most `MASKS` rows;
* `blocks`: both sides are cut into blocks by a hash, and every pair of blocks is tested in numpy by one task, for a table with
  itself each pair once. Nothing is broadcast; what is shuffled is each hash (16 bytes) once for each block of the other
  side, while bands shuffle it once for each probe, thousands of times where the distance is large.

`find_within` counts the distinct hashes of both sides to choose.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.functions.hashing import hamming, hamming64
from nearkin.operators.dealing import dealt_join, settled

BROADCAST_ROWS, NESTED_PAIRS, MASKS = 1_000_000, 10**10, 100_000
#: Hashes in a block, at least and at most, blocks of a side that are enough for many tasks, and tasks at most.
BLOCK_LEAST, BLOCK_MOST, BLOCKS, BLOCK_TASKS = 4096, 131_072, 16, 10_000
#: Pairs tested side by side, and pairs in blocks that take the time of one probe or candidate of the bands (an estimate).
TILE, PROBE_PAIRS = 32_768, 500
MET = "q_hi long, q_lo long, s_hi long, s_lo long, distance int"


def masks(bits: int, radius: int) -> list[int]:
    """All values of so many bits with at most `radius` bits set."""
    return [sum(1 << b for b in some) for n in range(min(bits, radius) + 1) for some in combinations(range(bits), n)]


def band_plan(bands: int, within: int) -> list[tuple[str, int, int, int]]:
    """(half, shift, bits, radius) of each band that is needed; bands don't cross the halves' border."""
    radius, more = divmod(within, bands)
    cut = [64 * i // (bands // 2) for i in range(bands // 2 + 1)]
    places = [(half, low, high - low) for half in ("lo", "hi") for low, high in zip(cut, cut[1:], strict=False)]
    plan = [(half, shift, bits, radius if i <= more else radius - 1) for i, (half, shift, bits) in enumerate(places)]
    return [p for p in plan if p[3] >= 0]


def plan_cost(plan: list[tuple[str, int, int, int]], n: int) -> float:
    """Probes and expected candidates for each query hash among n stored ones."""
    sizes = [(sum(comb(bits, k) for k in range(min(bits, radius) + 1)), bits) for _, _, bits, radius in plan]
    return sum(m * (1 + n / 2**bits) for m, bits in sizes) if sum(m for m, _ in sizes) <= MASKS else float("inf")


def best_plan(n: int, within: int) -> list[tuple[str, int, int, int]]:
    """The plan with the fewest probes and expected candidates for each query hash among n stored ones."""
    return min((band_plan(bands, within) for bands in range(2, 65, 2)), key=lambda plan: plan_cost(plan, n))


def _distance() -> Column:
    return hamming(F.col("q_hi"), F.col("q_lo"), F.col("s_hi"), F.col("s_lo"))


def distinct_hashes(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(F.col("hi").alias(f"{prefix}_hi"), F.col("lo").alias(f"{prefix}_lo")).distinct()


def nested(q: DataFrame, s: DataFrame, within: int, broadcast_query: bool = False) -> DataFrame:
    left, right = (F.broadcast(q), s) if broadcast_query else (q, F.broadcast(s))
    return left.join(right, _distance() <= within).select("q_hi", "q_lo", "s_hi", "s_lo", _distance().alias("distance"))


def _bits(value: Column, shift: int, bits: int) -> Column:
    return value if bits == 64 else F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def banded(q: DataFrame, s: DataFrame, within: int, plan: list[tuple[str, int, int, int]]) -> DataFrame:
    def cut(rows: DataFrame, p: str) -> DataFrame:
        values = [F.struct(F.lit(i).alias("band"), _bits(F.col(f"{p}_{half}"), shift, bits).alias("value")) for i, (half, shift, bits, _) in enumerate(plan)]
        return rows.withColumn("x", F.explode(F.array(*values))).select(f"{p}_hi", f"{p}_lo", "x.band", "x.value")

    signed = lambda m: m - (m >> 63 << 64)
    near = s.sparkSession.createDataFrame([(i, signed(m)) for i, (_, _, bits, radius) in enumerate(plan) for m in masks(bits, radius)], "band int, mask long")
    probes = cut(q, "q").join(F.broadcast(near), "band").select("q_hi", "q_lo", "band", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    first = F.lit(len(plan))
    for i, (half, shift, bits, radius) in reversed(list(enumerate(plan))):
        differs = F.bit_count(_bits(F.col(f"q_{half}").bitwiseXOR(F.col(f"s_{half}")), shift, bits))
        first = F.when(differs <= radius, F.lit(i)).otherwise(first)
    met = dealt_join(cut(s, "s"), probes, ["band", "value"], where=(_distance() <= within) & (first == F.col("band")))
    return met.select("q_hi", "q_lo", "s_hi", "s_lo", _distance().alias("distance"))


def block_count(n: int) -> int:
    return max(1, -(-n // BLOCK_MOST), min(BLOCKS, -(-n // BLOCK_LEAST)))


def _met(left: np.ndarray, right: np.ndarray, within: int, both: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of rows (hi, lo) of two blocks within the distance; both: also the other way round."""
    names, most = MET.replace(" long", "").replace(" int", "").split(", "), 4 * TILE
    found, waiting = [], 0

    def batch() -> pa.RecordBatch:
        a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
        columns = [*left[:, a], *right[:, b]]
        if both:
            columns = [np.concatenate([x, y]) for x, y in zip(columns, columns[2:] + columns[:2], strict=True)]
            d = np.concatenate([d, d])
        return pa.RecordBatch.from_arrays([*[pa.array(c.view(np.int64)) for c in columns], pa.array(d.astype(np.int32))], names=names)

    for begin in range(0, right.shape[1], TILE // 2):
        hi, lo = right[:, begin : begin + TILE // 2]
        rows = max(2, TILE // len(hi))
        for first in range(0, left.shape[1], rows):
            own = left[:, first : first + rows, None]
            d = np.bitwise_count(own[0] ^ hi)
            d += np.bitwise_count(own[1] ^ lo)
            if d.min() <= within:
                a, b = np.nonzero(d <= within)
                found.append((a + first, b + begin, d[a, b]))
                waiting += len(a)
                if waiting > most:
                    yield batch()
                    found, waiting = [], 0
    if found:
        yield batch()


def _block_pairs(within: int, itself: bool):
    """Rows (i, j, side, hi, lo), sorted by pair of blocks, to the pairs within the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tested() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            same = itself and now[0] == now[1]
            left, right = (np.concatenate(h, axis=1) if h else np.zeros((2, 0), np.uint64) for h in (held[0], held[0] if same else held[1]))
            if left.size and right.size:
                yield from _met(left, right, within, itself and not same)

        now, held = None, ([], [])
        for b in batches:
            i, j, side, hi, lo = (b.column(c).to_numpy() for c in ("i", "j", "side", "hi", "lo"))
            hashes = np.stack([hi, lo]).view(np.uint64)
            change = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(side) != 0)) + 1
            for first, last in zip([0, *change], [*change, len(i)], strict=True):
                if first == last:
                    continue
                pair = (int(i[first]), int(j[first]))
                if pair != now:
                    yield from tested()
                    now, held = pair, ([], [])
                held[side[first]].append(hashes[:, first:last])
        yield from tested()

    return run


def blocked(q: DataFrame, s: DataFrame | None, n: int, m: int, within: int) -> DataFrame:
    """Each pair of blocks of n and m hashes in one task; s None: of q with itself."""

    def dealt(rows: DataFrame, p: str, own: int, others: int, side: int) -> DataFrame:
        block, other = F.pmod(F.xxhash64(f"{p}_hi", f"{p}_lo"), F.lit(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        cut = rows.dropna().select(F.col(f"{p}_hi").alias("hi"), F.col(f"{p}_lo").alias("lo"), block.alias("b"), other.alias("o"))
        if s is None:
            return cut.select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).cast("int").alias("side"), "hi", "lo")
        return cut.select(F.col("o" if side else "b").alias("i"), F.col("b" if side else "o").alias("j"), F.lit(side).alias("side"), "hi", "lo")

    left, right = block_count(n), block_count(m)
    rows = dealt(q, "q", left, right, 0)
    if s is not None:
        rows = rows.unionByName(dealt(s, "s", right, left, 1))
    place = F.col("i") * right + F.col("j") if s is not None else (F.col("j") * (F.col("j") + 1) / 2).cast("int") + F.col("i")
    tasks = left * right if s is not None else left * (left + 1) // 2
    sorted_rows = rows.repartitionById(min(tasks, BLOCK_TASKS), place.cast("int")).sortWithinPartitions("i", "j", "side")
    return sorted_rows.mapInArrow(_block_pairs(within, s is None), MET)


def find_within(query: DataFrame, stored: DataFrame | None, within: int = 23, way: str | None = None) -> DataFrame:
    """(q_hi, q_lo, s_hi, s_lo, distance) for the distinct hashes of two tables with hi and lo; stored None: of one table with
    itself. way: `nested`, `bands`, `blocks`, or None to choose by the sides' sizes."""
    q = settled(distinct_hashes(query, "q"))
    s = settled(distinct_hashes(stored, "s")) if stored is not None else q.withColumnsRenamed({"q_hi": "s_hi", "q_lo": "s_lo"})
    n, m = q.count(), s.count()
    plan = best_plan(m, within)
    if way is None:
        way = "nested" if min(n, m) <= BROADCAST_ROWS and n * m <= NESTED_PAIRS else "bands" if plan_cost(plan, m) * PROBE_PAIRS < (m if stored is not None else m / 2) else "blocks"
    if way == "blocks":
        return blocked(q, s if stored is not None else None, n, m, within)
    return nested(q, s, within, broadcast_query=n < m) if way == "nested" else banded(q, s, within, plan)


def find_within64(query: DataFrame, stored: DataFrame, within: int = 3) -> DataFrame:
    """The older search over 64-bit hashes (column h): distinct pairs and their distance, by four bands of 16 bits."""
    n = 4
    cut = lambda rows, p: rows.select(F.col("h").alias(p)).distinct().withColumn("x", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.shiftrightunsigned(F.col(p), 16 * b).bitwiseAND(65535).cast("int").alias("value")) for b in range(n)]))).select(p, "x.band", "x.value")
    near = F.explode(F.array(*[F.lit(m) for m in masks(16, within // n)]))
    probe = cut(query, "q").withColumn("mask", near).select("q", "band", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    distance = hamming64(F.col("q"), F.col("s"))
    return probe.join(cut(stored, "s"), ["band", "value"]).where(distance <= within).select("q", "s", distance.alias("distance")).distinct()


def classes(rows: DataFrame) -> DataFrame:
    """(hi, lo, rep, n): each distinct hash with its smallest id and how many rows have it."""
    return rows.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count("*").alias("n"))


def similar_classes(rows: DataFrame, within: int = 23, way: str | None = None) -> DataFrame:
    """Pairs of classes of equal hashes, by their smallest ids (a < b), with sizes and distance."""
    c = settled(classes(rows))
    pairs = find_within(c, None, within, way)
    a = c.select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), F.col("rep").alias("a"), F.col("n").alias("n_a"))
    b = c.select(F.col("hi").alias("s_hi"), F.col("lo").alias("s_lo"), F.col("rep").alias("b"), F.col("n").alias("n_b"))
    return pairs.join(a, ["q_hi", "q_lo"]).join(b, ["s_hi", "s_lo"]).where("a < b").select("a", "b", "n_a", "n_b", F.col("distance").cast("int").alias("distance"))


def similar_to_any(rows: DataFrame, ignored: DataFrame, within: int = 23) -> DataFrame:
    """Rows whose hash is within the distance of some ignored hash. rows are read twice, so they should be settled or cheap."""
    hit = find_within(rows, ignored, within).select(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).distinct()
    return rows.join(hit, ["hi", "lo"], "left_semi")


def not_similar_to_any(rows: DataFrame, ignored: DataFrame, within: int = 23) -> DataFrame:
    """The other rows; those without a hash are similar to nothing."""
    hit = find_within(rows, ignored, within).select(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).distinct()
    return rows.join(hit, ["hi", "lo"], "left_anti")


def distance_histogram(rows: DataFrame) -> DataFrame:
    """(distance, n) over all pairs of rows, zero-filled for 0 to 128. Distinct hashes with their multiplicities are paired,
    in blocks of the right side that are broadcast one after another where they are many."""
    spark = rows.sparkSession
    weighted = settled(rows.groupBy("hi", "lo").agg(F.count("*").alias("n")))
    blocks = max(1, -(-weighted.count() // BROADCAST_ROWS))
    parts = []
    for block in range(blocks):
        right = weighted.where(F.pmod(F.xxhash64("hi", "lo"), F.lit(blocks)) == block).select(F.col("hi").alias("s_hi"), F.col("lo").alias("s_lo"), F.col("n").alias("m"))
        left = weighted.select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), "n")
        pairs = left.join(F.broadcast(right), F.struct("q_hi", "q_lo") < F.struct("s_hi", "s_lo"))
        parts.append(pairs.groupBy(_distance().cast("int").alias("distance")).agg(F.sum(F.col("n") * F.col("m")).alias("n")))
    parts.append(weighted.select(F.lit(0).alias("distance"), F.expr("n * (n - 1) div 2").alias("n")))
    counted = parts[0]
    for p in parts[1:]:
        counted = counted.unionByName(p)
    totals = counted.groupBy("distance").agg(F.sum("n").alias("n"))
    every = spark.range(129).select(F.col("id").cast("int").alias("distance"))
    return every.join(totals, "distance", "left").select("distance", F.coalesce("n", F.lit(0)).alias("n"))
