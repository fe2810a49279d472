"""Greedy dedup of a video's frames in time order.

A frame is kept if there is none before it or its hash differs in more than `within` bits from the hash that was pushed
last. Behind a kept key frame its mirrored hash is pushed too if it differs in more than `within` bits from the frame's
own; then that mirrored hash is the last one. Phantom frames have no mirrored hash. Frames that are not kept change
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.operators.sampling import ordered_fold

_ONES = (1 << 64) - 1


def differ(a: tuple[int, int], b: tuple[int, int]) -> int:
    return ((a[0] ^ b[0]) & _ONES).bit_count() + ((a[1] ^ b[1]) & _ONES).bit_count()


def greedy_dedup(frames: DataFrame, key: str, order: list[str], within: int = 23) -> DataFrame:
    """Frames (with hi and lo) that the fold keeps, without mirrored hashes."""

    def accept(last, values):
        now = (values[0], values[1])
        return (True, now) if last is None or differ(last, now) > within else (False, last)

    return ordered_fold(frames, key, order, lambda: None, accept, ["hi", "lo"])


PUSHED = "video string, ts long, id long, hi long, lo long, mirrored string, phantom boolean"


def pushed_hashes(frames: DataFrame, within: int = 23) -> DataFrame:
    """All pushed hashes in order, mirrored ones included. frames: video, ts, id, hi, lo, mirror_hi, mirror_lo, phantom;
    accepted and not ignored ones only. Videos are streamed and never held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, last = object(), None
        for b in batches:
            at, halves, mirrored = [], [], []
            for i, (v, hi, lo, m_hi, m_lo, phantom) in enumerate(zip(*(b.column(c).to_pylist() for c in ("video", "hi", "lo", "mirror_hi", "mirror_lo", "phantom")), strict=True)):
                if v != video:
                    video, last = v, None
                own, other = (hi, lo), (m_hi, m_lo)
                if last is not None and differ(last, own) <= within:
                    continue
                last = own
                at.append(i)
                halves.append(own)
                mirrored.append("Normal")
                if not phantom and m_hi is not None and differ(own, other) > within:
                    last = other
                    at.append(i)
                    halves.append(other)
                    mirrored.append("Mirrored")
            rows = pa.array(at, pa.int64())
            kept = [b.column(c).take(rows) for c in ("video", "ts", "id")]
            hashes = [pa.array([h[i] for h in halves], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*kept, *hashes, pa.array(mirrored, pa.string()), b.column("phantom").take(rows)], names=PUSHED_NAMES)

    columns = frames.select(F.col("video").cast("string"), F.col("ts").cast("long"), F.col("id").cast("long"), "hi", "lo", "mirror_hi", "mirror_lo", F.coalesce("phantom", F.lit(False)).alias("phantom"))
    return columns.repartition("video").sortWithinPartitions("video", "ts", "id").mapInArrow(run, PUSHED)


PUSHED_NAMES = [x.split(" ")[0] for x in PUSHED.split(", ")]


def stored(pushed: DataFrame) -> DataFrame:
    """What goes into an index: neither mirrored nor phantom."""
    return pushed.where((F.col("mirrored") == "Normal") & ~F.col("phantom"))
