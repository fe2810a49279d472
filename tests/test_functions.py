import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearkin import conf
from nearkin.functions import hashing, imaging, measures, paths
from nearkin.operators import sampling


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_configuration_defaults_and_text_forms():
    quality = conf.Quality()
    assert (quality.borders.maskify_threshold, quality.borders.maximum_whites, quality.one_colour.threshold, quality.one_colour.tolerance, quality.emptiness) == (40, 10.0, 90.0, 20, 10.0)
    assert conf.Similarity().threshold == 23 and conf.Sampling().phantom_steps_ms == (4200,)
    assert conf.percent("12.5%") == 12.5
    for bad in ("12", "-1%", "nan%", "inf%"):
        with pytest.raises(ValueError):
            conf.percent(bad)
    assert conf.duration_ms("4.2s") == 4200 and conf.duration_ms("1m 30s") == 90_000
    with pytest.raises(ValueError):
        conf.duration_ms("soon")
    assert conf.override(conf.Similarity(), threshold=5).threshold == 5
    with pytest.raises(TypeError):
        conf.override(conf.Similarity(), other=1)


def test_list_flags():
    assert conf.flag_list((1,), [], "--x") == (1,)
    assert conf.flag_list((1,), ["--x", "2", "3"], "--x") == (2, 3)
    assert conf.flag_list((1,), ["--x", "2", "--y", "9", "--x", "3"], "--x") == (2, 3)
    assert conf.flag_list((1,), ["--x"], "--x") == ()
    with pytest.raises(ValueError):
        conf.flag_list((1,), ["--x", "two"], "--x")


def test_rc_file_only_without_arguments(tmp_path):
    rc = tmp_path / "rc"
    rc.write_text("--a 1\n--b 2")
    assert conf.arguments([], str(rc)) == ["--a", "1", "--b", "2"]
    assert conf.arguments(["--c"], str(rc)) == ["--c"] and conf.arguments([], str(tmp_path / "none")) == []


@pytest.mark.parametrize("a,b,far", [((0, 0), (0, 0), 0), ((-1, -1), (-1, -1), 0), ((0, 0b101), (0, 0b010), 3), ((0, 0b010), (0, 0b101), 3), ((-1, 0), (0, 0), 64), ((-1, -1), (0, 0), 128)])
def test_distances(spark, a, b, far):
    x = [F.lit(v).cast("long") for v in (*a, *b)]
    assert one(spark, hashing.hamming(*x))[0] == far


def test_text_forms_of_hashes(spark):
    five = F.lit(0).cast("long"), F.lit(5).cast("long")
    assert one(spark, hashing.to_base64(*five), hashing.to_hex(*five)) == ("BQAAAAAAAAAAAAAAAAAAAA", "0" * 31 + "5")
    assert one(spark, hashing.to_hex(F.lit(-1).cast("long"), F.lit(-2).cast("long")))[0] == "f" * 31 + "e"


def test_image_hash_properties():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (40, 60))
    assert hashing.image_hash(image) == hashing.image_hash(image.copy()[:, :])
    assert hashing.image_hash(image) != hashing.image_hash(image[:, ::-1])
    assert hashing.image_hash(np.zeros((0, 0))) == hashing.image_hash(image[0:0, 0:0]) == (0, 0)
    assert hashing.image_hash(np.zeros((9, 9))) == hashing.image_hash(np.full((9, 9), 255))
    near = hashing.image_hash(np.clip(image + rng.integers(-3, 4, image.shape), 0, 255))
    far = hashing.image_hash(rng.integers(0, 256, (40, 60)))
    bits = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True))
    assert bits(hashing.image_hash(image), near) < 23 < bits(hashing.image_hash(image), far)
    checker = np.indices((4, 4)).sum(axis=0) % 2 * 255
    assert hashing.image_hash(checker[1:3, 1:3]) != hashing.image_hash(checker)
    assert hashing.difference_hash(image) == hashing.difference_hash(image) and hashing.difference_hash(np.zeros((0, 0))) == 0


@pytest.mark.parametrize("path,good", [("", True), (" ", True), ("a", True), ("a/b", True), (" / ", True), ("a.b/c", True), ("...", True), ("/", False), ("/a", False), ("a/", False), ("a//b", False), ("a/./b", False), ("a/.", False), ("..", False), ("../a", False)])
def test_simple_paths(spark, path, good):
    assert one(spark, paths.is_simple(F.lit(path)))[0] is good


def test_path_forms(spark):
    depth = [one(spark, paths.depth(F.lit(p)))[0] for p in ("", "a", " / ", "a/b", "a/b/c")]
    assert depth == [0, 1, 2, 2, 3]
    assert one(spark, paths.relative_from_file(F.lit("folder/file.txt"), F.lit("x")))[0] == "../x"
    assert one(spark, paths.relative_from_file(F.lit("file.txt"), F.lit("x")))[0] == "x"
    assert one(spark, paths.relative_from_file(F.lit(""), F.lit("x")))[0] is None
    assert one(spark, paths.relative_from_file(F.lit("file.txt"), F.lit("")))[0] == ""
    assert one(spark, paths.relative_from_dir(F.lit("a/b"), F.lit("x")))[0] == "../../x"
    assert one(spark, paths.relative_from_dir(F.lit("a/b"), F.lit("")))[0] == "../.."
    assert [one(spark, paths.below_root(F.lit(p)))[0] for p in ("../x.txt", "../../a/b", "x")] == ["x.txt", "a/b", "x"]
    assert [one(spark, paths.is_basename(F.lit(p)))[0] for p in ("a", "a/b", "..", ".", "")] == [True, False, False, False, False]
    assert one(spark, paths.as_filename(F.lit("a/b/c")))[0] == "a!b!c"


def test_media_times(spark):
    long = lambda x: F.lit(x).cast("long")
    assert [one(spark, measures.clock(long(x)))[0] for x in (50, 1005, -1005, 3_600_000 * 100 + 61_001)] == ["00:00:00.050", "00:00:01.005", "-00:00:01.005", "100:01:01.001"]
    assert one(spark, measures.duration_ms(long(600), long(100), F.lit(1), F.lit(500)))[0] == 1000
    assert one(spark, measures.duration_ms(long(0), long(100), F.lit(1), F.lit(500)))[0] == 0
    assert one(spark, measures.ticks(long(2000), F.lit(1), F.lit(500)))[0] == 1000
    assert one(spark, measures.frame_text(F.lit("a/b"), long(50), F.lit("Mirrored")))[0] == '"a/b":00:00:00.050:M'


def test_percentages_and_interpolation(spark):
    assert one(spark, measures.percent_of(F.lit(1.0), F.lit(4.0)))[0] == 25.0
    with pytest.raises(Exception, match="not a percentage"):
        one(spark, measures.percent_of(F.lit(5.0), F.lit(0.0)))
    assert one(spark, measures.lerp(*[F.lit(float(x)) for x in (1, 5, 10, 20, 3)]))[0] == 15.0
    whole = lambda *x: one(spark, measures.lerp_whole(*[F.lit(v).cast("long") for v in x]))[0]
    assert [whole(0, 2, 0, 10, x) for x in (0, 1, 2)] == [0, 5, 10]
    assert whole(0, 3, 10, 0, 1) == 7 and whole(0, 2, 0, 1, 3) is None and whole(1, 1, 0, 1, 1) is None


def test_statistics(spark):
    x = F.col("x")
    make = lambda values: spark.createDataFrame([(float(v),) for v in values], "x double").agg(measures.mean(x), measures.variance(x), measures.biased_variance(x), measures.deviation(x)).first()
    assert tuple(make([])) == (0, 0, 0, 0)
    got = make([1, 2, 3])
    assert (got[0], got[1], got[3]) == (2, 1, 1) and math.isclose(got[2], 2 / 3)
    assert make([7])[1] == 0


def test_pixel_arrays(spark):
    px, w, h = F.array(*map(F.lit, range(6))), F.lit(3), F.lit(2)
    run = lambda c: one(spark, c)[0]
    image = np.arange(6).reshape(2, 3)
    assert run(imaging.mirror(w, px)) == image[:, ::-1].ravel().tolist()
    for turns, degrees in ((3, 90), (2, 180), (1, 270)):
        assert run(imaging.rotate(w, h, px, degrees)) == np.rot90(image, turns).ravel().tolist()
    assert run(imaging.upright(w, h, px, F.lit(45))) == list(range(6))
    assert run(imaging.upright(w, h, px, F.lit(-180))) == list(range(5, -1, -1))
    assert run(imaging.maskify(px, 2)) == [0, 0, 0, 255, 255, 255]
    assert run(imaging.crop(w, px, F.lit(1), F.lit(0), F.lit(2), F.lit(2))) == [1, 2, 4, 5]
    assert run(imaging.crop(w, px, F.lit(0), F.lit(0), F.lit(0), F.lit(0))) == []
    assert run(imaging.unstride(F.array(*map(F.lit, [1, 2, 9, 3, 4, 9])), F.lit(2), F.lit(2), F.lit(3))) == [1, 2, 3, 4]
    assert run(imaging.filled(2, 2, 7)) == [7] * 4 and run(imaging.is_empty(F.lit(0), F.lit(3)))
    assert run(imaging.mirror(F.lit(0), F.array().cast("array<int>"))) == []
    rgb = F.array(imaging.pack_rgb(F.lit(255), F.lit(255), F.lit(255)), imaging.pack_rgb(F.lit(0), F.lit(255), F.lit(0)))
    assert run(imaging.grey(rgb)) == [255, 182]
    assert run(imaging.rgb_distance((F.lit(0), F.lit(0), F.lit(0)), (F.lit(3), F.lit(4), F.lit(0)))) == 5.0


@pytest.mark.parametrize("seconds,skipped", [(5, 0), (29.9, 0), (30, 5), (50, 5), (60, 5), (180, 40), (300, 75), (600, 75), (1919, 75), (1920, 240), (2400, 240), (3600, 600), (7200, 600)])
def test_skipped_time(spark, seconds, skipped):
    assert one(spark, sampling.skip(F.lit(int(seconds * 1000)).cast("long")))[0] == skipped * 1000


def test_curves(spark):
    at = lambda pieces, *xs: [one(spark, sampling.curve(F.lit(x).cast("long"), pieces))[0] for x in xs]
    assert at((), 0, 5) == [0, 0]
    assert at(((0, 60, 60),), 0, 9) == [60, 60]
    assert at(((0, 0, 4000), (1000, 4000, 4000)), 500, 1000, 5000) == [2000, 4000, 4000]
    assert at(((0, 0, 10), (10, 10, 0), (20, 0, 0)), 5, 10, 15, 25) == [5, 10, 5, 0]
    with pytest.raises(ValueError):
        sampling.curve(F.lit(1), ((5, 0, 0), (5, 1, 1)))


def test_gaps_of_several_series():
    assert sampling.gaps([1], 3) == [(0, 1)] * 3
    assert sampling.gaps([1, 2], 4) == [(0, 1)] * 4
    times, now = [], 0
    for series, gap in sampling.gaps([2, 3], 8):
        now += gap
        times.append((now, series))
    assert times == [(2, 0), (3, 1), (4, 0), (6, 0), (8, 0), (9, 1), (10, 0), (12, 0)]


def test_schedules_equal_the_gaps(spark):
    steps = [4, 6, 7]
    got = sorted((r["at"], r["series"]) for r in sampling.schedule(spark.createDataFrame([(1, 50), (2, 0)], "id long, length_ms long"), [F.lit(s) for s in steps]).collect())
    want, now = [], 0
    for series, gap in sampling.gaps(steps, 40):
        now += gap
        if now <= 50:
            want.append((now, series))
    assert got == want
    assert one(spark, sampling.step(F.lit(20_000)), sampling.step(F.lit(200_000)), sampling.step(F.lit(0))) == (4000, 10_000, 0)


def test_window_of_a_video(spark):
    length = F.lit(100_000).cast("long")
    cut = one(spark, sampling.skip(length))[0]
    inside = [one(spark, sampling.in_window(F.lit(t).cast("long"), length))[0] for t in (0, cut, 50_000, 100_000 - cut, 100_001 - cut)]
    assert inside == [False, True, True, True, False]
    assert one(spark, sampling.in_window(F.lit(0).cast("long"), F.lit(0).cast("long")))[0]
