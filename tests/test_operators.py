import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearkin.conf import Borders, OneColour, Quality
from nearkin.operators import fold, numbering, quality, rangejoin, sampling


def test_modal_grey_and_shares():
    g = np.array([[128, 200, 128]])
    assert quality.modal_grey(g) == 128 and round(quality.near_percent(g, 128, 0)) == 67 and quality.near_percent(g, 128, 100) == 100
    assert quality.modal_grey(np.array([10] * 3 + [200] * 3)) == 200
    with pytest.raises(ValueError):
        quality.near_percent(np.zeros((0, 0)), 1, 1)


@pytest.mark.parametrize(
    "rows,box",
    [([], (0, 0, 0, 0)), (["B" * 9] * 9, (0, 0, 0, 0)), (["WWW"], (0, 0, 3, 1)), (["BWWW"] * 4, (1, 0, 3, 4)), (["WWWB"] * 4, (0, 0, 3, 4)), (["BBBB"] + ["WWWB"] * 3, (0, 1, 3, 3)), (["BBBB", "BWWB", "BWWB", "BBBB"], (1, 1, 2, 2))],
)
def test_border_boxes(rows, box):
    mask = np.array([[255 * (c == "W") for c in r] for r in rows]) if rows else np.zeros((0, 0))
    assert quality.border_box(mask, 0.0) == box


def test_border_share_is_of_the_fullest_line():
    mask = np.zeros((20, 20), int)
    mask[5:15, 5:15] = 255
    mask[0, 5] = 255  # one white pixel of at most ten or eleven: not over ten percent of the fullest row
    assert quality.border_box(mask, 10.0) == (5, 5, 10, 10)
    assert quality.border_box(mask, 0.0) == (5, 0, 10, 15)
    assert quality.border_box_by_length(mask) == (5, 0, 10, 15) and quality.border_box_by_length(mask * 0) is None


def test_verdict_order():
    conf = Quality(Borders(40, 10.0), OneColour(90.0, 20), 10.0)
    rng = np.random.default_rng(1)
    noise = rng.integers(60, 256, (20, 20))
    assert quality.verdict(noise, conf)[0] == quality.OK
    assert quality.verdict(np.full((20, 20), 200), conf)[0] == quality.TOO_ONE_COLOUR
    assert quality.verdict(np.zeros((0, 0), int), conf)[0] == quality.EMPTY
    small = rng.integers(0, 41, (40, 40))
    small[::2, ::2] = 0
    small[10:14, 10:14] = rng.integers(100, 256, (4, 4))
    assert quality.verdict(small, Quality(Borders(40, 10.0), OneColour(100.0, 5), 10.0))[0] == quality.EMPTY
    framed = np.zeros((20, 20), int)
    framed[5:, 5:] = 200
    assert quality.verdict(framed, conf) == (quality.TOO_ONE_COLOUR, (5, 5, 15, 15), 56.25)


def test_judging_images(spark):
    rng = np.random.default_rng(2)
    noise = rng.integers(60, 256, 64).tolist()
    rows = [(1, 8, 8, noise), (2, 8, 8, [7] * 64), (3, 0, 0, []), (4, None, None, None), (5, 8, 8, noise)]
    got = {r["id"]: r for r in quality.judge(spark.createDataFrame(rows, "id long, w int, h int, px array<int>")).collect()}
    assert [got[i]["reason"] for i in range(1, 6)] == ["ok", "too_one_color", "empty", "empty", "ok"]
    assert got[1]["hi"] == got[5]["hi"] and got[2]["hi"] is None and got[3]["modal"] is None
    assert (got[1]["hi"], got[1]["lo"]) != (got[1]["mirror_hi"], got[1]["mirror_lo"])


def test_ignore_list_is_folded_in_order(spark):
    rows = [(1, "ok", 0, 0, -1, -1), (2, "ok", 0, 1, -1, -1), (3, "ok", 0, 3, 5, 5), (4, "empty", None, None, None, None), (5, "ok", 0, 7, 0, 1)]
    judged = spark.createDataFrame(rows, "id long, reason string, hi long, lo long, mirror_hi long, mirror_lo long")
    got = {(r["id"], r["mirrored"]) for r in quality.ignore_list(judged, 1).collect()}
    # 2 is like 1; 3 is like 2 only, which is not kept; 5 is like 3, its mirror like 1
    assert got == {(1, "Normal"), (1, "Mirrored"), (2, "Mirrored"), (3, "Normal"), (3, "Mirrored")}


def test_rejected_frames(spark):
    judged = spark.createDataFrame([(1, "empty"), (2, "ok"), (3, "similar_previous"), (4, "ignored")], "id long, reason string")
    frames = spark.createDataFrame([(1, "Normal", 1001), (2, "Normal", 2000), (3, "Normal", 3000), (4, "Mirrored", 3_723_004), (4, "Normal", 3_723_004)], "id long, mirrored string, ts long")
    assert sorted(r["file"] for r in quality.rejected(judged, frames).collect()) == ["empty_00:00:01.001.jpg", "ignored_01:02:03.004.jpg"]


def test_average_colours(spark):
    pixels = spark.createDataFrame([(1, 0, 0, 0)] * 3 + [(2, 255, 255, 255)] * 2 + [(3, 3, 0, 0), (3, 0, 4, 0)], "id long, r int, g int, b int")
    got = {r["id"]: (r["r"], r["g"], r["b"], r["variance"]) for r in quality.colour_variance(pixels).collect()}
    assert got[1] == (0, 0, 0, 0.0) and got[2] == (255, 255, 255, 0.0) and got[3][:3] == (2, 2, 0)


def test_resizing():
    image = np.add.outer(np.arange(30), np.arange(60))
    small = quality.resize(image, 10)
    assert small.shape == (10, 20) and abs(small.mean() - image.mean()) < 2
    assert quality.worsen(image, 10).shape == (30, 60) and quality.resize(np.full((9, 9), 77), 3).tolist() == [[77] * 3] * 3
    assert quality.resize(np.zeros((0, 0)), 5).size == 0


def test_numbers_over_partitions(spark):
    rows = spark.range(1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(10_000)))
    got = [r["no"] for r in numbering.numbered(rows.repartition(7), "k", "id").orderBy("k", "id").collect()]
    assert got == list(range(1000))


def test_masks():
    assert len(rangejoin.masks(16, 2)) == 1 + 16 + 120 and rangejoin.masks(16, 0) == [0]
    for bands in (2, 6, 8, 24, 40):
        for within in (0, 3, 23, 34):
            plan = rangejoin.band_plan(bands, within)
            # fewer bits than any way to differ everywhere: each band one more than its radius, at least within + 1 in all
            assert sum(radius + 1 for *_, radius in plan) == within + 1 and len({(h, s) for h, s, *_ in plan}) == len(plan)
    sizes = [max(bits for _, _, bits, _ in rangejoin.best_plan(n, 23)) for n in (10**3, 10**6, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[-1]


def differ(a, b):
    return sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("within", [0, 5, 23, 34])
def test_search_equals_brute_force(spark, within):
    rng = random.Random(within)
    centre = tuple(rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(2))

    def flipped(n):
        out = list(centre)
        for b in rng.sample(range(128), n):
            out[b // 64] ^= (1 << b % 64) - (1 << 64 if b % 64 == 63 else 0)
        return tuple(((x + (1 << 63)) % (1 << 64)) - (1 << 63) for x in out)

    stored = [flipped(rng.randint(0, within + 6)) for _ in range(100)] + [flipped(rng.randint(30, 128)) for _ in range(200)]
    stored += stored[:30]
    query = [centre, flipped(3), stored[0]]
    want = {(*q, *s, differ(q, s)) for q in query for s in stored if differ(q, s) <= within}
    make = lambda rows: spark.createDataFrame(rows, "hi long, lo long")
    for way in (None, "nested", "bands"):
        assert {tuple(r) for r in rangejoin.find_within(make(query), make(stored), within, way).collect()} == want
    all_pairs = {}
    for i in range(len(stored)):
        for j in range(i):
            d = differ(stored[i], stored[j])
            all_pairs[d] = all_pairs.get(d, 0) + 1
    assert {r["distance"]: r["n"] for r in rangejoin.distance_histogram(make(stored)).collect()} == {d: all_pairs.get(d, 0) for d in range(129)}


def test_legacy_search(spark):
    rng = random.Random(3)
    hashes = [rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(50)]
    hashes += [h ^ 0b111 for h in hashes[:10]] + [h ^ 0b1111 for h in hashes[:10]]
    rows = spark.createDataFrame([(h,) for h in hashes], "h long")
    want = {(a, b) for a in set(hashes) for b in set(hashes) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert {(r["q"], r["s"]) for r in rangejoin.find_within64(rows, rows, 3).collect()} == want


def test_similar_to_any(spark):
    rows = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 0, 255)], "id long, hi long, lo long")
    ignored = spark.createDataFrame([(0, 0)], "hi long, lo long")
    assert {r["id"] for r in rangejoin.similar_to_any(rows, ignored, 1).collect()} == {1, 2}
    assert {r["id"] for r in rangejoin.not_similar_to_any(rows, ignored, 1).collect()} == {3}


def test_greedy_dedup_keeps_against_the_last_kept(spark):
    values = [0, 1, 255, 254, 65535, 0]
    rows = [("a", i, i, 0, v) for i, v in enumerate(values)] + [("b", 0, 9, 0, 0)]
    frames = spark.createDataFrame(rows, "video string, ts long, id long, hi long, lo long")
    kept = sorted((r["video"], r["ts"], r["lo"]) for r in fold.greedy_dedup(frames, "video", ["ts", "id"], 3).collect())
    assert kept == [("a", 0, 0), ("a", 2, 255), ("a", 4, 65535), ("a", 5, 0), ("b", 0, 0)]


def test_pushed_hashes_compare_with_a_mirrored_one(spark):
    far, rows = (1 << 40) - 1, []
    rows.append(("a", 0, 0, 0, 0, 0, far, False))  # pushes itself and its mirror
    rows.append(("a", 1, 1, 0, 1, 0, 1, False))  # near the first, far from its mirror: kept; symmetric: no mirror
    rows.append(("a", 2, 2, 0, 3, 0, far, True))  # near the last one
    rows.append(("a", 3, 3, 0, 255, 0, far, True))  # a phantom has no mirror
    frames = spark.createDataFrame(rows, "video string, ts long, id long, hi long, lo long, mirror_hi long, mirror_lo long, phantom boolean")
    got = fold.pushed_hashes(frames, 3)
    assert [(r["id"], r["mirrored"]) for r in got.orderBy("ts", F.desc("mirrored")).collect()] == [(0, "Normal"), (0, "Mirrored"), (1, "Normal"), (3, "Normal")]
    assert [r["id"] for r in fold.stored(got).orderBy("id").collect()] == [0, 1]


def test_folds_outlive_batches_and_partitions(spark):
    rng = random.Random(4)
    rows = [(f"v{rng.randint(0, 3)}", t, t, 0, rng.getrandbits(20)) for t in range(5000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    got = {r["id"] for r in fold.greedy_dedup(spark.createDataFrame(rows, "video string, ts long, id long, hi long, lo long"), "video", ["ts"], 8).collect()}
    last, want = {}, set()
    for v, t, i, hi, lo in rows:
        if v not in last or differ(last[v], (hi, lo)) > 8:
            last[v] = (hi, lo)
            want.add(i)
    assert got == want


def test_greedy_sampling_drifts(spark):
    frames = spark.createDataFrame([("a", t) for t in (0, 3, 10, 12, 19, 21, 29, 40)] + [("b", None), ("b", 5)], "v string, ts long")
    take = lambda step, **k: sorted((r["v"], r["ts"]) for r in sampling.greedy_sample(frames, "v", "ts", step, **k).collect())
    assert take(10) == [("a", 0), ("a", 10), ("a", 21), ("a", 40), ("b", 5)]
    assert take(10, offset_ms=12) == [("a", 12), ("a", 29), ("a", 40)]
    assert len(take(0)) == 9


def test_frames_at_wanted_times(spark):
    frames = spark.createDataFrame([("a", 10, "x"), ("a", 20, "y"), ("b", 5, "z")], "video string, ts long, name string")
    wanted = spark.createDataFrame([("a", 0), ("a", 10), ("a", 11), ("a", 21), ("b", 5), ("c", 1)], "video string, at long")
    got = {(r["video"], r["at"]): r["name"] for r in sampling.frame_at(frames, wanted).collect()}
    assert got == {("a", 0): "x", ("a", 10): "x", ("a", 11): "y", ("a", 21): None, ("b", 5): "z", ("c", 1): None}


def test_legacy_positions(spark):
    got = spark.createDataFrame([(10.0,), (1000.0,)], "s double").select(sampling.legacy_positions(F.col("s")).alias("p")).collect()
    assert all(len(r["p"]) == 20 and r["p"] == sorted(r["p"]) for r in got)
    assert (got[0]["p"][0], got[0]["p"][-1]) == (0.0, 10.0) and (got[1]["p"][0], got[1]["p"][-1]) == (480.0, 520.0)


def test_time_columns_of_the_tables(spark):
    from nearkin.plans.queries import micros

    row = spark.createDataFrame([(datetime(1970, 1, 1, 0, 0, 1),)], "ts timestamp_ntz").select(micros("ts").alias("t")).first()
    assert row["t"] == 1_000_000


def test_older_boxes_and_worse_pictures_of_odd_images(spark):
    rows = [(1, 3, 2, [0, 200, 0, 0, 0, 0]), (2, 3, 2, [0] * 6), (3, 0, 0, []), (4, 0, 0, None)]
    images = spark.createDataFrame(rows, "id long, w int, h int, px array<int>")
    boxes = {r["id"]: tuple(r)[1:] for r in quality.boxes_by_length(images).collect()}
    assert boxes == {1: (1, 0, 1, 1), 2: (None,) * 4, 3: (None,) * 4, 4: (None,) * 4}
    worse = {r["id"]: (r["w"], r["h"], r["px"]) for r in quality.worsened(images, 1).collect()}
    assert worse[2] == (2, 2, [0] * 4) and worse[3] == worse[4] == (0, 0, [])
    assert not quality.worsened(images.limit(0), 1).collect()
