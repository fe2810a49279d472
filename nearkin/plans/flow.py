"""The whole way of new videos: catalogue, quality, ignored frames, greedy dedup, search, reports, storing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.conf import Quality, Sampling, Similarity
from nearkin.functions.imaging import grey
from nearkin.functions.measures import duration_ms
from nearkin.operators import fold, quality, sampling
from nearkin.operators.dealing import settled
from nearkin.operators.numbering import numbered
from nearkin.operators.rangejoin import similar_to_any
from nearkin.plans import collisions
from nearkin.plans.index import HashIndex
from nearkin.schemas import VIDEO
from nearkin.sources.files import list_files, read_images
from nearkin.sources.video import VideoSource


def frame_source(ts: str = "ts", path: str = "video"):
    """The payload column of a stored frame with a millisecond time base."""
    time = F.struct(F.lit(1).alias("tb_num"), F.lit(1000).alias("tb_den"), F.col(ts).alias("ts"), F.lit(0).cast("long").alias("first_ts"))
    return F.struct(time.alias("frame_pos"), F.col(path).alias("path"), F.lit("Normal").alias("mirrored"))


def classify(frames: DataFrame, conf: Quality, within: int, ignored: DataFrame | None) -> DataFrame:
    """Frames with their hashes and the reason that rejects them, or `ok`. The mirrored frame is judged like the frame, so its hash
    goes where it is near an ignored one. frames: id, video, ts, phantom, w, h, px."""
    judged = settled(quality.judge(frames, conf).select("id", "reason", "hi", "lo", "mirror_hi", "mirror_lo"))
    if ignored is not None:
        good = judged.where(F.col("reason") == quality.OK)
        both = good.select("id", "hi", "lo", F.lit(False).alias("mirrored")).unionByName(good.select("id", F.col("mirror_hi").alias("hi"), F.col("mirror_lo").alias("lo"), F.lit(True).alias("mirrored")))
        bad = similar_to_any(both, ignored, within).groupBy("id").agg(F.max(~F.col("mirrored")).alias("_bad"), F.max("mirrored").alias("_bad_mirror"))
        judged = judged.join(bad, "id", "left").withColumn("reason", F.when(F.col("_bad"), quality.IGNORED).otherwise(F.col("reason")))
        judged = judged.withColumns({c: F.when(~F.coalesce("_bad_mirror", F.lit(False)), F.col(c)) for c in ("mirror_hi", "mirror_lo")}).drop("_bad", "_bad_mirror")
    return frames.select("id", "video", "ts", F.coalesce("phantom", F.lit(False)).alias("phantom")).join(judged, "id")


def ignored_hashes(spark: SparkSession, folders: list[str], conf: Quality, within: int) -> DataFrame:
    """(hi, lo) of the accepted pictures in folders and of their mirror images, without those near another one."""
    pictures = numbered(read_images(spark, folders, drop_invalid=True), "path", name="id").select("id", "w", "h", grey(F.col("px")).alias("px"))
    return quality.ignore_list(quality.judge(pictures, conf), within).select("hi", "lo")


def sampled_frames(spark: SparkSession, folders: list[str], decoder: str, sampling_conf: Sampling | None = None) -> tuple[DataFrame, DataFrame]:
    """The frames that are looked at (id, video, ts, phantom, w, h, px) of all files in folders, and (path, error) of the files that
    can't be read, which stop nobody else. Lengths come from a scan without pixels."""
    conf = sampling_conf or Sampling()
    spark.dataSource.register(VideoSource)
    paths = sorted(r["path"] for r in list_files(spark, folders).select("path").collect())  # names of files, for the reader's partitions
    if not paths:
        return spark.createDataFrame([], FRAMES), spark.createDataFrame([], "path string, error string")
    source = lambda columns: spark.read.format("nearkin_video").schema(columns).options(paths=",".join(paths), decoder=decoder, on_error="row").load()
    at = duration_ms(F.col("ts"), F.col("first_ts"), F.col("tb_num"), F.col("tb_den"))
    stamps = "path string, ts long, tb_num int, tb_den int, first_ts long"
    known = settled(source(f"{stamps}, error string").groupBy("path").agg(F.max(at).alias("length_ms"), F.max("error").alias("error")))
    failed = known.where("error is not null").select("path", "error")
    frames = source(f"{stamps}, w int, h int, px array<int>").where("px is not null")
    timed = frames.join(known.where("error is null").select("path", "length_ms"), "path").select(F.col("path").alias("video"), at.alias("ts"), "length_ms", "w", "h", grey(F.col("px")).alias("px"))
    looked = settled(sampling.scheduled_frames(timed, conf.min_frames, conf.step_ms, conf.phantom_steps_ms))
    return looked.select(F.monotonically_increasing_id().alias("id"), "video", "ts", "phantom", "w", "h", "px"), failed


FRAMES = "id long, video string, ts long, phantom boolean, w int, h int, px array<int>"


def find(spark: SparkSession, folders: list[str], index_path: str, out: str, decoder: str, conf: Quality | None = None, similarity: Similarity | None = None, sampling_conf: Sampling | None = None, ignore: list[str] | None = None, limit: int | None = None, create: bool = False) -> dict:
    """From folders of video files to answers: sampling, quality, ignored pictures, dedup, search, reports, storing. Files that can't be
    read are listed below `out`/errors and counted as `failed`; they are neither stored nor taken as gone."""
    conf, similarity = conf or Quality(), similarity or Similarity()
    frames, failed = sampled_frames(spark, folders, decoder, sampling_conf)
    ignored = ignored_hashes(spark, ignore, conf, similarity.threshold) if ignore else None
    failed.write.mode("overwrite").json(f"{out}/errors")
    listed = list_files(spark, folders).select(F.col("path").alias("video"))
    done = process(spark, settled(frames), index_path, out, conf, similarity, ignored, limit, create, listed)
    return done | {"failed": spark.read.schema("path string, error string").json(f"{out}/errors").count()}


def process(spark: SparkSession, frames: DataFrame, index_path: str, out: str, conf: Quality | None = None, similarity: Similarity | None = None, ignored: DataFrame | None = None, limit: int | None = None, create: bool = False, listed: DataFrame | None = None) -> dict:
    """Searches and stores the videos of `frames` (id, video, ts, phantom, w, h, px: sampled frames with grey pixels) that the
    index lacks, marks those that are gone, and writes `collisions` (JSON), `report`, `graveyard` and `paths` below `out`.
    `listed` (video) has the videos that are there, if some of them have no frames. The index changes last, so a run that failed can be repeated. Counts of what was done are its value."""
    conf, within = conf or Quality(), (similarity or Similarity()).threshold
    index = HashIndex.create(spark, index_path, VIDEO) if create else HashIndex.open(spark, index_path, VIDEO)
    live = index.scan().select("hi", "lo", F.col("src.path").alias("path"), F.col("src.frame_pos.ts").alias("ts"))
    new, _ = collisions.catalogue_changes(frames.select(F.col("video").alias("path")), live, limit)
    _, gone = collisions.catalogue_changes((frames if listed is None else listed).select(F.col("video").alias("path")), live)
    new.write.mode("overwrite").parquet(f"{out}/paths/new")
    gone.write.mode("overwrite").parquet(f"{out}/paths/gone")
    new, gone = spark.read.parquet(f"{out}/paths/new"), spark.read.parquet(f"{out}/paths/gone")

    mine = frames.join(new.select(F.col("path").alias("video")), "video", "left_semi")
    classify(mine, conf, within, ignored).write.mode("overwrite").parquet(f"{out}/frames")
    classed = spark.read.parquet(f"{out}/frames")
    rejects = classed.where(F.col("reason") != quality.OK)
    quality.rejected(rejects, classed.select("id", "video", "ts", F.lit("Normal").alias("mirrored"))).write.mode("overwrite").partitionBy("reason").parquet(f"{out}/graveyard")

    fold.pushed_hashes(classed.where(F.col("reason") == quality.OK), within).write.mode("overwrite").parquet(f"{out}/pushed")
    order = numbered(new, "path", name="seq")
    pushed = spark.read.parquet(f"{out}/pushed").join(order, F.col("video") == F.col("path")).select("seq", "path", "hi", "lo", "ts", "mirrored", "phantom")
    kept = fold.stored(pushed)
    old = live.join(gone, "path", "left_anti").select(F.lit(-1).cast("long").alias("seq"), "path", "hi", "lo", "ts")
    stored = old.unionByName(kept.select("seq", "path", "hi", "lo", "ts"))
    collisions.collisions(pushed, stored, within).write.mode("overwrite").json(f"{out}/collisions")
    found = read_collisions(spark, f"{out}/collisions")
    collisions.report(found).write.mode("overwrite").parquet(f"{out}/report")

    removed = index.remove(gone)
    index.add(kept.select("hi", "lo", frame_source("ts", "path").alias("src")))
    return {"new": new.count(), "gone": gone.count(), "removed_rows": removed, "stored_rows": kept.count(), "collisions": found.count(), "duplicates": found.select("reference.path").distinct().count()}


_SIDE = "seq:bigint,path:string,hi:bigint,lo:bigint,ts:bigint"


def read_collisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"reference struct<{_SIDE},mirrored:string,phantom:boolean>, other struct<{_SIDE}>, distance int").json(path)
