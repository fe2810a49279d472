"""Streams: items searched among all that arrived before and then stored, and the greedy dedup of endless videos."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from nearkin.operators.fold import differ
from nearkin.operators.rangejoin import find_within
from nearkin.plans.index import HashIndex


def search_then_store(frames: DataFrame, index_path: str, results_path: str, checkpoint: str, within: int = 23, ident: str = "video:1", available_now: bool = True) -> StreamingQuery:
    """A stream of frames (seq, hi, lo, src, store): each micro-batch is searched in the index and among the batch's own
    earlier items, collisions are written to the batch's own folder below `results_path`, then the frames to store join the
    index in one change that has the batch's number as its tag. A batch that is run again after a failure finds its tag and does
    nothing, or none and does everything again: its results replace what it had written, and none of its frames is in the index."""

    def batch(rows: DataFrame, number: int) -> None:
        index, tag = HashIndex.open(rows.sparkSession, index_path, ident), f"{checkpoint}#{number}"
        if index.has(tag):
            return
        rows = rows.persist()
        try:
            old = index.search(rows.select("seq", "hi", "lo", "src"), within).select("seq", "src", F.col("other.src").alias("other"), "distance")
            keep = rows.where("store")
            pairs = find_within(rows, keep, within)
            own = pairs.join(rows.select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), "seq", "src"), ["q_hi", "q_lo"]).join(keep.select(F.col("hi").alias("s_hi"), F.col("lo").alias("s_lo"), F.col("seq").alias("before"), F.col("src").alias("other")), ["s_hi", "s_lo"])
            found = old.unionByName(own.where("before < seq").select("seq", "src", "other", "distance"))
            found.write.mode("overwrite").parquet(f"{results_path}/batch={number}")
            index.add(keep, tag)
        finally:
            rows.unpersist()

    writer = frames.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def greedy_dedup_stream(frames: DataFrame, within: int = 23) -> DataFrame:
    """The greedy dedup of `operators.fold` for a stream of (video, ts, id, hi, lo): the last kept hash of each video is
    its state, and a micro-batch's frames are taken in order of ts and id."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(parts), ignore_index=True).sort_values(["ts", "id"], kind="stable")
        kept = []
        for hi, lo in zip(rows["hi"].tolist(), rows["lo"].tolist(), strict=True):
            take = last is None or differ(last, (hi, lo)) > within
            last = (hi, lo) if take else last
            kept.append(take)
        if last is not None:
            state.update(last)
        yield rows[kept]

    schema = "video string, ts long, id long, hi long, lo long"
    return frames.select("video", "ts", "id", "hi", "lo").groupBy("video").applyInPandasWithState(step, schema, "hi long, lo long", "append", GroupStateTimeout.NoTimeout)
