"""Which frames of a video are looked at: the part in the middle, the step, the schedule, and the greedy walk along it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

S, MIN = 1_000, 60_000
#: (length from which it holds, skip there, skip at its end) of the skip curve's pieces, in ms; flat where both are equal.
SKIP = ((0, 0, 0), (30 * S, 5 * S, 5 * S), (MIN, 5 * S, 75 * S), (5 * MIN, 75 * S, 75 * S), (32 * MIN, 4 * MIN, 4 * MIN), (60 * MIN, 10 * MIN, 10 * MIN))


def curve(x: Column, pieces: Sequence[tuple[int, int, int]]) -> Column:
    """A piecewise flat or linear curve of whole numbers, cut off; behind the last piece its end value holds, in front of the
    first 0. Pieces ascend in x."""
    if any(a[0] >= b[0] for a, b in zip(pieces, pieces[1:], strict=False)):
        raise ValueError("the pieces of a curve must ascend")
    value = F.lit(0).cast("long")
    for i, (start, low, high) in enumerate(pieces):
        if i + 1 < len(pieces):
            here = F.lit(low).cast("long") + F.floor((x - start) * (high - low) / (pieces[i + 1][0] - start)).cast("long")
        else:
            here = F.lit(high).cast("long")
        value = F.when(x >= start, here).otherwise(value)
    return value


def skip(length_ms: Column) -> Column:
    """How much is left out at the beginning, and as much at the end."""
    return curve(length_ms, SKIP)


def step(length_ms: Column, min_frames: int = 5, max_step_ms: int = 10_000) -> Column:
    """The distance of key frames: so that there are `min_frames`, but not more than `max_step_ms`."""
    return F.least(F.floor(length_ms / min_frames).cast("long"), F.lit(max_step_ms).cast("long"))


def in_window(ts: Column, length_ms: Column) -> Column:
    """Whether a time is neither in the skipped beginning nor end."""
    cut = skip(length_ms)
    return (ts >= cut) & ((cut <= 0) | (cut > length_ms) | (ts <= length_ms - cut))


def schedule(videos: DataFrame, steps: Sequence[Column]) -> DataFrame:
    """(id, at, series): all positive multiples of each series' step up to the video's `length_ms`; where several meet, the
    first series wins. A step of 0 gives none. videos: id, length_ms."""
    rows = []
    for number, each in enumerate(steps):
        every = each.cast("long")
        times = F.when((every > 0) & (every <= F.col("length_ms")), F.expr("sequence(_step, length_ms, _step)"))
        rows.append(videos.withColumn("_step", every).select("id", F.explode(times).alias("at"), F.lit(number).alias("series")))
    merged = rows[0]
    for r in rows[1:]:
        merged = merged.unionByName(r)
    return merged.groupBy("id", "at").agg(F.min("series").alias("series"))


def gaps(steps: Sequence[int], n: int) -> list[tuple[int, int]]:
    """The first n (series, gap to the time before) of the schedule of fixed steps; gaps of 0 don't occur."""
    out: list[tuple[int, int]] = []
    now = 0
    while len(out) < n:
        following = [(now // s + 1) * s for s in steps]
        at = min(following)
        out.append((following.index(at), at - now))
        now = at
    return out


def ordered_fold(rows: DataFrame, key: str, order: Sequence[str], start: Callable[[], object], accept: Callable, columns: Sequence[str]) -> DataFrame:
    """Rows that a fold accepts, key by key in order. `accept(state, row)` gets the values of `columns` and gives (kept, new
    state). Keys are dealt and sorted by Spark and then streamed, so a key's rows are never held together; only the state
    is, which outlives batches of one key."""
    names = rows.columns
    places = [names.index(c) for c in columns]
    at = names.index(key)
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for b in batches:
            keep = []
            for k, *values in zip(b.column(at).to_pylist(), *(b.column(p).to_pylist() for p in places), strict=True):
                if k != now:
                    now, state = k, start()
                kept, state = accept(state, values)
                keep.append(kept)
            yield b.filter(pa.array(keep, pa.bool_()))

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def greedy_sample(frames: DataFrame, key: str, ts: str, step_ms: int, *tie: str, offset_ms: int = 0) -> DataFrame:
    """Frames taken along a walk: the first at `offset_ms` or later, then always the first that is `step_ms` or more behind
    the one taken. The step counts from the frame taken, so the walk drifts. A step of 0 takes every frame."""

    def accept(after, values):
        return (True, values[0] + step_ms) if values[0] is not None and (after is None or values[0] >= after) else (False, after)

    first = offset_ms if offset_ms else None
    return ordered_fold(frames, key, [ts, *tie], lambda: first, accept, [ts])


def legacy_positions(length_s: Column, window_s: float = 20.0, samples: int = 17, seed: int = 0) -> Column:
    """Sampled seconds of the older pipeline: start, middle and end of a window of `window_s` on both sides of the middle, cut
    to the video, and pseudo-random places in it, ascending; these come from the MD5 of seed, number and length."""
    low = F.greatest(length_s / 2 - window_s, F.lit(0.0))
    high = F.least(length_s / 2 + window_s, length_s)
    name = lambda i: F.concat_ws(":", F.lit(str(seed)), i.cast("string"), F.floor(length_s * 1000).cast("string"))
    chance = F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda i: F.conv(F.substring(F.md5(name(i).cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32))
    return F.array_sort(F.transform(F.concat(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)), chance), lambda p: low + p * (high - low)))


def frame_at(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """As-of look-up: for each (video, at) the first frame with ts >= at, with null columns where there is none. Both sides are
    put on one time line for each video and each wanted time takes the next frame from behind. frames: video, ts, ...;
    wanted: video, at."""
    from pyspark.sql.window import Window

    rest = [c for c in frames.columns if c != "video"]
    line = frames.select("video", F.col("ts").alias("_t"), F.lit(1).alias("_kind"), F.struct(*rest).alias("_frame")).unionByName(
        wanted.select("video", F.col("at").alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(frames.select(F.struct(*rest)).schema[0].dataType).alias("_frame"))
    )
    ahead = Window.partitionBy("video").orderBy("_t", "_kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = line.withColumn("_next", F.first("_frame", ignorenulls=True).over(ahead)).where("_kind = 0")
    return found.select("video", F.col("_t").alias("at"), *[F.col(f"_next.{c}") for c in rest])


def scheduled_frames(frames: DataFrame, min_frames: int = 5, max_step_ms: int = 10_000, phantom_steps_ms: Sequence[int] = (4_200,)) -> DataFrame:
    """The frames of a video that are looked at, with `phantom`. The first is the first one behind the skipped beginning;
    each next one is the first at or behind the one before plus the gap that the schedule of key frames and phantoms has
    next, so the walk drifts with the frames while the gaps do not. It ends at the skipped end. frames: video, ts (ms),
    length_ms and any others; a length of 0 gives the first frame only."""
    length = F.col("length_ms")
    rows = frames.withColumn("_skip", skip(length)).withColumn("_step", step(length, min_frames, max_step_ms))
    kept = frames.columns
    at = {c: rows.columns.index(c) for c in ("video", "ts", "length_ms", "_skip", "_step")}
    schema = ", ".join(f"`{c}` {t}" for c, t in frames.dtypes) + ", phantom boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, state = object(), None
        for b in batches:
            keep, phantom = [], []
            for v, ts, total, cut, key_step in zip(*(b.column(at[c]).to_pylist() for c in at), strict=True):
                if v != video:
                    video, state = v, (0, cut or 0, False, False)  # scheduled time, next target, whether a phantom is next, end
                now, target, odd, done = state
                take = not done and ts is not None and ts >= target and not (0 < (cut or 0) <= (total or 0) < ts + cut)
                keep.append(take)
                phantom.append(odd)
                if take:
                    following = [(now // s + 1) * s for s in (key_step or 0, *phantom_steps_ms) if s]
                    if key_step:
                        after = min(following)
                        state = (after, ts + after - now, following.index(after) > 0, False)
                    else:
                        state = (now, target, odd, True)
            mask = pa.array(keep, pa.bool_())
            columns = [b.column(i).filter(mask) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(phantom, pa.bool_()).filter(mask)], names=[*kept, "phantom"])

    return rows.repartition("video").sortWithinPartitions("video", "ts").mapInArrow(run, schema)
