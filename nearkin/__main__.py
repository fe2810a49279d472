"""python -m nearkin videos FOLDER... --index INDEX --out OUT | find FRAMES INDEX OUT | edit INDEX GOAL... | compare FOLDER OUT

`videos` goes from folders of video files to answers; `find` takes a Parquet folder of sampled frames (id, video, ts, phantom, w, h, px) in
their place; `compare` the pictures of a folder. Without arguments they are read from .nearkinrc.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nearkin import conf
from nearkin.functions.imaging import grey
from nearkin.operators import quality, rangejoin
from nearkin.operators.numbering import numbered
from nearkin.plans import edit, flow
from nearkin.plans.index import HashIndex
from nearkin.schemas import VIDEO
from nearkin.sources.files import read_images


def compare(spark: SparkSession, folder: str, out: str, within: int) -> None:
    """Distances between all pictures of a folder: `histogram` and the pairs within a distance. Crops are hashed without the
    other quality checks; pictures of which nothing is left have no hash."""
    pictures = numbered(read_images(spark, [folder], drop_invalid=True), "path", name="id").select("id", "path", "w", "h", grey(F.col("px")).alias("px"))
    anything = conf.Quality(one_colour=conf.OneColour(threshold=101.0), emptiness=0.0)
    hashes = quality.judge(pictures, anything).where(F.col("reason") == quality.OK).select("id", "hi", "lo")
    rangejoin.distance_histogram(hashes).coalesce(1).orderBy("distance").write.mode("overwrite").csv(f"{out}/histogram", header=True)
    names = pictures.select("id", "path")
    pairs = rangejoin.similar_classes(hashes, within)
    named = pairs.join(names.select(F.col("id").alias("a"), F.col("path").alias("path_a")), "a").join(names.select(F.col("id").alias("b"), F.col("path").alias("path_b")), "b")
    named.select("distance", "path_a", "path_b", "n_a", "n_b").write.mode("overwrite").json(f"{out}/pairs")


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="nearkin", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("edit")
    one.add_argument("index")
    one.add_argument("goals", nargs="+")
    two = commands.add_parser("find")
    for name in ("frames", "index", "out"):
        two.add_argument(name)
    two.add_argument("--create", action="store_true")
    two.add_argument("--limit", type=int)
    four = commands.add_parser("videos")
    four.add_argument("folders", nargs="+")
    four.add_argument("--index", required=True)
    four.add_argument("--out", required=True)
    four.add_argument("--create", action="store_true")
    four.add_argument("--limit", type=int)
    four.add_argument("--decoder", default="ffmpeg")
    quality_of, sampling_of = conf.Quality(), conf.Sampling()
    for p in (two, four):
        p.add_argument("--ignore-dir", action="append", default=[])
        p.add_argument("--maskify-threshold", type=int, default=quality_of.borders.maskify_threshold)
        p.add_argument("--maximum-whites", type=conf.percent, default=quality_of.borders.maximum_whites)
        p.add_argument("--one-colour-threshold", type=conf.percent, default=quality_of.one_colour.threshold)
        p.add_argument("--one-colour-tolerance", type=int, default=quality_of.one_colour.tolerance)
        p.add_argument("--emptiness", type=conf.percent, default=quality_of.emptiness)
    four.add_argument("--min-frames", type=int, default=sampling_of.min_frames)
    four.add_argument("--step", type=conf.duration_ms, default=sampling_of.step_ms)
    four.add_argument("--phantom-step", type=conf.duration_ms, action="append")
    three = commands.add_parser("compare")
    for name in ("folder", "out"):
        three.add_argument(name)
    for p in (two, three, four):
        p.add_argument("--threshold", type=int, default=conf.Similarity().threshold)
    args = parser.parse_args(conf.arguments(argv))
    spark = SparkSession.builder.appName("nearkin").getOrCreate()
    if args.command == "edit":
        for value in edit.run(HashIndex.open(spark, args.index, VIDEO), args.goals):
            print(json.dumps(value))
    elif args.command in ("find", "videos"):
        kind = conf.Quality(conf.Borders(args.maskify_threshold, args.maximum_whites), conf.OneColour(args.one_colour_threshold, args.one_colour_tolerance), args.emptiness)
        near = conf.Similarity(args.threshold)
        if args.command == "find":
            ignored = flow.ignored_hashes(spark, args.ignore_dir, kind, near.threshold) if args.ignore_dir else None
            done = flow.process(spark, spark.read.parquet(args.frames), args.index, args.out, kind, near, ignored, args.limit, args.create)
        else:
            steps = conf.Sampling(args.min_frames, args.step, tuple(args.phantom_step) if args.phantom_step else conf.Sampling().phantom_steps_ms)
            done = flow.find(spark, args.folders, args.index, args.out, args.decoder, kind, near, steps, args.ignore_dir, args.limit, args.create)
        print(json.dumps(done))
    else:
        compare(spark, args.folder, args.out, args.threshold)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
